"""The pipeline on small documents, and the queries with SQL on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftwell.llm.queries import QUERIES
from siftwell.llm.sql import ORACLE_SQL
from tests.llm.conftest import words
from verify import TABLES, rows

SF = "/root/testdata/sf0.001"


def test_stages(spark, docs, rng, tmp_path):
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(60)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    text = {i: "\n".join(words(rng, 8) for _ in range(5)) + (" you moron." if i % 5 == 0 else "") for i in range(60)}
    text[61] = text[1]  # all lines are later copies
    text[62] = text[2].replace("\n", " ")  # the same words in one line
    docs([(i, t, f"s{i % 3}") for i, t in text.items()] + [(None, None, None), (70, "", "s1")]).drop("_k", "rank").write.parquet(f"{tmp_path}/documents.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, str(tmp_path))
        assert out.columns == d.columns and out.dtypes == d.dtypes
        out.write.parquet(f"{tmp_path}/{name}.parquet")
        d = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        seen[name] = {r["doc_id"] for r in d.collect()}
    clean = {i for i in range(60) if i % 5} | {61, 62, 70, None}
    assert seen["toxicity"] == clean
    assert seen["line_dedup"] == clean - {61}
    assert len(seen["minhash_neardup"] & {2, 62}) == 1 and len(seen["minhash_neardup"]) >= len(clean) - 3
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} <= seen["minhash_neardup"]
    assert all(r["bin_words"] <= 2048 for r in packed)


def labels(spark, path):
    spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int").write.mode("overwrite").parquet(f"{path}/labels.parquet")


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_odd_and_empty_tables(spark, docs, odd_rows, tmp_path, name, stage):
    """Columns whose names operators use inside keep their values; repeated and null ids, empty texts and an empty table pass."""
    labels(spark, tmp_path)
    clash = lambda rows: docs(rows).withColumnsRenamed({"n_chars": "text_k"}).withColumns({c: F.lit(c) for c in ("_row", "runs", "times", "toxic", "score", "component", "h")})
    out, none = stage(spark, clash(odd_rows), str(tmp_path)), stage(spark, clash([]), str(tmp_path))
    assert none.collect() == [] and none.columns == out.columns
    if name == corpus_pipeline.STAGES[-1][0]:
        assert {r["doc_id"] for r in out.collect()} == {r[0] for r in odd_rows}
        return
    assert out.dtypes == clash([]).dtypes
    got = out.collect()
    assert got and all((r["_row"], r["runs"], r["times"], r["_k"], r["rank"], r["h"]) == ("_row", "runs", "times", "clash", 7, "h") for r in got)
    assert {r["doc_id"] for r in got} >= {None, 1, 2, 6}


def test_pipeline_reruns_agree(spark, docs, rng, tmp_path):
    labels(spark, tmp_path)
    rows = [(i % 90, words(rng, rng.randint(3, 40)), rng.choice("abc")) for i in range(240)]
    out = []
    for parts in (1, 7):
        rng.shuffle(rows)
        docs(rows).drop("_k", "rank").repartition(parts).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        out.append(sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=repr))
    assert out[0] and out[0] == out[1]


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
