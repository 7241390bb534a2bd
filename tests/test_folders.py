"""Queries over tables that are folders of files, with rows that the given tables lack."""

import datetime

import duckdb
import pytest

from siftwell.catalog import ORACLE_SQL, QUERIES
from verify import rows


@pytest.fixture
def equal(spark, tmp_path):
    """Run a query over rows that are written as a folder of three files, and its SQL over the same."""

    def run(name, table, made, schema):
        folder = tmp_path / f"{table}.parquet"
        spark.createDataFrame(made, schema).repartition(3).write.parquet(str(folder))
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/*.parquet')")
        got, want = QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(ORACLE_SQL[name]).fetchdf()
        assert len(want) and sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)

    return run


def test_streamed_tokens(equal):
    made = [(i, f"Some words, {i} -- here", "en", "s") for i in range(9)] + [(10, None, "en", "s"), (11, " ", None, None)]
    equal("d03_streamed_tokens", "documents", made, "doc_id long, text string, lang string, source string")


def test_streamed_counts(equal):
    made = [(i, datetime.datetime(2024, 1, 1 + i % 3, 5), f"type{i % 2}") for i in range(20)]
    equal("d01_streamed_counts", "events", made, "event_id long, ts timestamp, event_type string")


def test_base64(equal):
    made = [(i, "https://example.net/" + "é/"[i % 2] * i) for i in range(200)] + [(200, None), (201, "")]
    equal("p21_base64", "pages", made, "page_id long, url string")


def test_coverage(spark, equal):
    made = [(i, ("Web, the EN {} \u0416\u0443\u043a en src1!" * (i % 3)).format(*"abc"), ["en", "de", "und"][i % 3], ["web", "src1 en", ""][i % 2]) for i in range(12)]
    made += [(20, None, "en", "web"), (21, "\u00e9 \t", "en", "web"), (22, "en", "\u00e9", "")]
    equal("x22_coverage", "documents", made, "doc_id long, text string, lang string, source string")


def test_coverage_splits_a_text_once(spark, tmp_path):
    spark.createDataFrame([(1, "a text", "en", "web")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = QUERIES["x22_coverage"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(lower(text") == 1


def test_words_of_coverage(spark):
    from pyspark.sql import functions as F

    from siftwell.functions import text

    every = "".join(f"a{chr(i)}" for i in [*range(0x600), 0x2028, 0xD7FF, 0xE000, 0xFFFF, 0x10000, 0x1F600, 0x10FFFF])
    old = F.split(F.lower(F.lit(every)), "[^A-Za-z\u0430-\u044f\u0410-\u042f0-9" + "".join("\\" + x for x in text.COVERAGE_SYMBOLS) + "]+")
    got, want = spark.range(1).select(text.coverage_words(F.lit(every)), F.filter(old, lambda x: x != "")).first()
    assert got == want and len(got) > 100
