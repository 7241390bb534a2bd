"""Operators against small golden values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.functions import ids, text, vectors
from siftwell.operators import adapt, evaluate, filters, geometry, relational, search, training
from siftwell.sources import readers, sinks
from siftwell.sources.store import Collection, DuplicateError
from siftwell.streaming import queues


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


# Filters


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "en", ["a", "b"], 5, {"url": "u1"}), (2, None, ["c"], 7, {"url": "u2"}), (3, "de", None, None, {"url": None})]
    return spark.createDataFrame([(i, g, t, n, (m["url"],)) for i, g, t, n, m in rows], "id int, lang string, tags array<string>, n int, meta struct<url:string>")


def kept(df, f):
    return sorted(r["id"] for r in filters.apply_filter(df, f).collect())


L = lambda f, o, v: {"field": f, "operator": o, "value": v}
N = lambda o, *c: {"operator": o, "conditions": list(c)}


@pytest.mark.parametrize("f, want", [
    (L("lang", "==", "en"), [1]), (L("lang", "==", None), [2]), (L("lang", "!=", "en"), [2, 3]), (L("lang", "!=", None), [1, 3]), (L("n", ">", 5), [2]), (L("n", ">", None), []),
    (L("n", "<=", 5), [1]), (L("lang", "in", ["en", "de"]), [1, 3]), (L("lang", "not in", ["en"]), [3]), (L("tags", "in", ["b", "c"]), [1, 2]), (L("tags", "==", "a"), [1]),
    (L("meta.url", "==", "u2"), [2]), (L("url", "!=", "u2"), [1, 3]), (N("NOT", L("lang", "==", "en"), L("n", ">", 5)), [1, 2, 3]), (N("NOT", N("NOT", L("lang", "==", "en"))), [1]),
    (N("OR", L("n", ">=", 7), N("AND", L("lang", "==", "de"), L("id", "<", 9))), [2, 3]), (None, [1, 2, 3]),
])
def test_filters(people, f, want):
    assert kept(people, f) == want


@pytest.mark.parametrize("f, error", [
    ([], filters.FilterError), ({"conditions": []}, filters.FilterError), (N("XOR"), filters.FilterError), ({"operator": "AND"}, filters.FilterError), ({"field": "n", "value": 1}, filters.FilterError),
    ({"field": "n", "operator": "=="}, filters.FilterError), (L("n", "~", 1), KeyError), (L("n", ">", "abc"), filters.FilterError), (L("n", "<", [1]), filters.FilterError), (L("n", "in", 1), filters.FilterError),
])
def test_filter_errors(people, f, error):
    with pytest.raises(error):
        filters.compile_filter(people.schema, f)


def test_older_filters(people):
    where = lambda f: sorted(r["id"] for r in people.where(filters.compile_legacy(people.schema, f)).collect())
    assert where({"lang": {"$ne": "en"}}) == [3]  # a missing field makes even a negative comparison false
    assert where({"$not": {"lang": "en", "n": {"$gt": 5}}}) == [3]
    assert where({"n": {"$gte": 5, "$lt": 7}}) == [1]
    assert where({"lang": ["en", "de"]}) == [1, 3]
    assert where({"$or": [{"lang": "de"}, {"n": 7}]}) == [2, 3]
    assert where({"nothing": {"$nin": ["x"]}}) == []


# Text


def test_text_functions(spark):
    assert one(spark, text.clean_text(F.lit(" a \n b\t"))) == "a b" and one(spark, text.clean_text(F.lit(None).cast("string"))) == ""
    assert one(spark, text.tokens(F.lit(" It's, ok! -- "))) == ["its", "ok"]
    assert one(spark, text.tokens_by_word(F.lit("a -- b"))) == ["a", "", "b"]
    assert one(spark, text.prefixed(F.lit("query: a"), "query: ")) == "query: a"
    assert one(spark, text.prefixed_for_training(F.lit(" a "), "query: ")) == "query: a"
    assert one(spark, text.payload_queries(F.lit('{"rephrases": [" a ", "", "b"]}'))) == ["a", "b"]
    assert one(spark, text.render("{{ a.b }}-{{c}}-{{d}}", {"a.b": F.lit(1), "c": F.lit("x")})) == "1-x-"
    assert one(spark, text.term_frequencies(F.array(*map(F.lit, "aba")))) == {"a": 2, "b": 1}
    q, d = F.array(F.lit("a"), F.lit("z")), F.array(F.lit("a"), F.lit("a"))
    assert one(spark, text.inverse_idf_recall(q, d)) == pytest.approx((1 / math.log(3)) / (1 / math.log(3) + 1 / math.log(2)))
    assert one(spark, text.inverse_idf_recall(F.array().cast("array<string>"), d)) == 0
    assert one(spark, text.rfc3339(F.lit("2024-01-02"))) == "2024-01-02T00:00:00.000000Z"


def test_ids(spark):
    assert f"{ids.murmur3_128(b''):x}" == "0"
    h = ids.murmur3_128(b"hello")
    assert f"{h & ((1 << 64) - 1):016x}" == "cbd8a7b341bd9b02" and f"{h >> 64:016x}" == "5b1e906a48ae1d19"
    assert one(spark, ids.name_uuid(F.lit("python.org"))) == "886313e1-3b8a-5372-9b90-0c9aee199e5d"
    assert one(spark, ids.stable_key(F.lit("a"))) >= 0


def test_vectors(spark):
    v = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, vectors.normalise(v)) == pytest.approx([0.6, 0.8])
    assert one(spark, vectors.cosine(v, F.array(F.lit(0.0), F.lit(0.0)))) == 0
    assert one(spark, vectors.project_out(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(-1.0), F.lit(1.0)))) == pytest.approx([0.5, 0.5])
    with pytest.raises(ValueError):
        vectors.truncate(v, 8)


# Documents


def test_documents(spark):
    rows = [("c1", "text", [" q1 ", "", None], "T", None), ("c2", "", None, None, 1.5), (None, "third", ["x"], None, float("nan")), ("c4", None, ["y"], None, 1.0)]
    df = spark.createDataFrame(rows, "chunk_id string, content string, queries array<string>, title string, w double")
    got = {r["content"]: r for r in adapt.to_documents(df).collect()}
    assert set(got) == {"text", "", "third"}
    assert got["text"]["meta"]["labels"] == ["q1"] and got[""]["meta"]["labels"] == []
    assert got["text"]["meta"]["extra"] == {"title": "T"}
    assert {r["content"] for r in adapt.to_documents(df, required=("w",)).collect()} == {""}
    bare = adapt.to_documents(df, preserve_all_fields=False).first()
    assert bare["meta"]["extra"] == {}
    with pytest.raises(ValueError):
        adapt.unique_ids(df.union(df), "chunk_id")
    adapt.unique_ids(df.where("chunk_id is null").union(df), "chunk_id")


@pytest.mark.parametrize("value, want", [("q ", ["q "]), ('["a", " b ", ""]', ["a", "b"]), ("[not a list", ["[not a list"]), ("text [1]", ["text [1]"]), ("", []), (None, [])])
def test_label_shapes(spark, value, want):
    df = spark.createDataFrame([(value,)], "q string")
    assert df.select(adapt.normalised_labels(F.col("q"), df.schema["q"].dataType)).first()[0] == want


# Search and evaluation


def test_bm25_and_errors(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "a dog"), (3, "cat cat cat"), (4, None)], "doc_id long, content string")
    q = spark.createDataFrame([(1, "Cat!"), (2, "zebra"), (3, "")], "query_id long, query string")
    got = [(r["query_id"], r["rank"], r["doc_id"]) for r in search.bm25(docs, q, 5).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 3), (1, 2, 1)]
    for bad in (0, -1, True, 1.5):
        with pytest.raises(ValueError):
            search.check_top_k(bad)
    for bad in (-0.1, 1.1, True, float("nan")):
        with pytest.raises(ValueError):
            search.check_alpha(bad)


def test_vector_checks(spark):
    ok = spark.createDataFrame([([1.0, 2.0],), ([0.0, 1.0],)], "v array<double>")
    search.check_vectors(ok, "v", 2)
    for rows, n in (([([1.0],)], 2), ([([1.0],), ([1.0, 2.0],)], None), ([([],)], None), ([([float("nan")],)], None), ([(None,)], None)):
        with pytest.raises(ValueError):
            search.check_vectors(spark.createDataFrame(rows, "v array<double>"), "v", n)


def test_golden_metrics(spark):
    rows = [(q, r, r == q) for q in (1, 2, 3) for r in range(1, 6)]
    ranked = spark.createDataFrame(rows, "query_id int, rank int, relevant boolean")
    got = {r["name"]: (r["mean"], r["std"]) for r in evaluate.evaluate(ranked, (1, 2, 5)).collect()}
    for k, hit, mrr, ndcg in ((1, 1 / 3, 1 / 3, 1 / 3), (2, 2 / 3, 1 / 2, 0.5436432511904858), (5, 1, 11 / 18, 0.7103099178571526)):
        assert got[f"HitRate@{k}"][0] == pytest.approx(hit)
        assert got[f"mrr@{k}"][0] == got[f"map@{k}"][0] == pytest.approx(mrr)
        assert got[f"ndcg@{k}"][0] == pytest.approx(ndcg)
    assert got["HitRate@1"][1] == pytest.approx(np.std([1, 0, 0], ddof=1))
    assert evaluate.summary(spark.createDataFrame([("m", 1, 0.5)], "name string, k int, value double")).first()["std"] == 0
    assert evaluate.metric_name("HR") == evaluate.metric_name("hit_rate@") == "HitRate"
    assert evaluate.depth(3) == (20, [1, 2, 5, 10, 12, 15, 20])


def test_distribution(spark):
    df = spark.createDataFrame([(0.0,), (0.25,), (0.5,), (0.75,), (1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    r = evaluate.distribution(df, "x").first()
    assert r["mean"] == r["p50"] == 0.5 and r["p05"] == pytest.approx(0.05) and r["std"] == pytest.approx(np.std([0, 0.25, 0.5, 0.75, 1]))
    assert math.isnan(evaluate.distribution(df.limit(0), "x").first()["mean"])


def test_spectrum(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 6))
    s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)
    p = s / s.sum()
    r = geometry.spectrum(spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>")).first()
    assert r["effective_rank"] == pytest.approx(np.exp(-(p * np.log(p)).sum())) and r["anisotropy"] == pytest.approx(s[0] ** 2 / (s**2).sum())


# Training


def test_safe_negatives(spark):
    df = spark.createDataFrame([(0, 0, 1, 1, 1), (0, 1, 1, 2, 2), (0, 2, 3, 3, 3), (0, 3, 4, 3, 4), (1, 0, 7, 7, 7), (1, 1, 7, 7, 7), (1, 2, 7, 7, 7)], "batch int, i int, doc_key int, content_key int, query_key int")
    got = {(r["batch"], r["i"]): r for r in training.safe_negatives(df).collect()}
    assert got[0, 0]["negative"] in (2, 3) and got[0, 2]["negative"] in (0, 1)
    assert sum(r["fallback"] for r in got.values()) == 3 and all(r["negative"] != r["i"] for r in got.values())


def test_rebalance_lowers_duplicates(spark):
    df = spark.createDataFrame(list(enumerate(["a", "a", "b", "c"])), "n long, content string")
    assert training.duplicate_batches(df, "n", "content", 3).first()["batches"] == 1
    out = [r["content"] for r in training.rebalanced(df, "content", "n").orderBy("level", "first").collect()]
    assert out == ["a", "b", "c", "a"]


def test_training_rows_limit_counts_expanded_rows(spark):
    df = spark.createDataFrame([(1, "c", ["a", "b"]), (2, "d", ["e", None, ""]), (3, None, ["f"])], "seq int, content string, queries array<string>")
    got = [r["query"] for r in training.training_rows(df, "queries", "content", "seq", 3).orderBy("seq", "query_pos").collect()]
    assert got == ["a", "b", "e"]
    assert training.reservoir(df, -1, "seq").count() == 3 and training.reservoir(df, 2, "seq").count() == 2 and training.reservoir(df, 0, "seq").count() == 0


def test_weights(spark):
    assert training.warm_up(49, 50) == 0 and training.warm_up(50, 50) == pytest.approx(0.02) and training.warm_up(500, 50) == 1
    sel = spark.createDataFrame([(0, 0, s) for s in range(12)], "batch int, i int, slot int")
    assert training.mass_weight(sel, 8, 0.5).first()["weight"] == pytest.approx(7 / 24)


def test_losses_match_numpy(spark):
    rng = np.random.default_rng(4)
    s = rng.uniform(-1, 1, (5, 5))
    df = spark.createDataFrame([(0, i, j, float(s[i, j])) for i in range(5) for j in range(5)], "batch int, i int, j int, s double")
    z = s / 0.05
    got = [r["loss"] for r in training.info_nce(df, 0.05).orderBy("i").collect()]
    assert got == pytest.approx(list(-np.diag(z) + np.log(np.exp(z).sum(axis=1))))
    off = np.exp(z) * (1 - np.eye(5))
    got = [r["loss"] for r in training.info_nce(df, 0.05, decoupled=True).orderBy("i").collect()]
    assert got == pytest.approx(list(-np.diag(z) + np.log(off.sum(axis=1))))


def test_polynomial(spark):
    df = spark.createDataFrame([(float(x), 1 + 2.0 * x - 3.0 * x * x) for x in range(-4, 5)], "x double, y double")
    assert relational.polynomial(df, "x", "y", 2) == pytest.approx([1, 2, -3])


# Sources and streams


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,content,blob\n1,x,y\n2,z,w\n")
    (tmp_path / "a.json").write_text('{"data": [{"id": 1, "content": "x"}, null, {"id": 2, "content": "z"}]}')
    (tmp_path / "b.json").write_text('[{"id": 1, "content": "x"}]')
    (tmp_path / "a.jsonl").write_text('{"id": 1, "content": "x"}\n{"id": 2, "content": "z"}\n')
    r = readers.read_dataset(spark, str(tmp_path / "a.csv"), limit=1, drop_columns=["blob", "none", " "])
    assert [x.asDict() for x in r.collect()] == [{"id": 1, "content": "x"}]
    assert readers.read_dataset(spark, str(tmp_path / "a.json"), lazy=False).count() == 2
    assert readers.read_dataset(spark, str(tmp_path / "b.json"), lazy=False).count() == 1
    assert readers.read_dataset(spark, str(tmp_path / "a.jsonl")).count() == 2
    assert readers.read_dataset(spark, "demo").count() == 3
    with pytest.raises(readers.DatasetError):
        readers.read_dataset(spark, str(tmp_path / "a.json"))
    with pytest.raises(TypeError):
        readers.read_dataset(spark, "demo", lazy=1)
    for bad in ("http://x/y", "builtin://demo", "hf://a/b", "name", "a/b?c"):
        with pytest.raises(readers.DatasetError):
            readers.resolve(bad)
    assert readers.resolve("a/b") == ("hub", "a/b")
    with pytest.raises(readers.DatasetError):
        readers.read_dataset(spark, "demo", split="train")


def test_hub_splits(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "o/n/test"))
    assert readers.read_dataset(spark, "o/n", split="dev|test", hub_root=str(tmp_path)).count() == 3
    assert readers.hub_files(["c/train-1.parquet", "c/train-0.parquet", "c/test.parquet", "d/train/x.parquet", "x.txt"], "train", "c") == ["c/train-0.parquet", "c/train-1.parquet"]


def test_collection(spark, tmp_path):
    c = Collection(spark, str(tmp_path), "notes")
    make = lambda rows: spark.createDataFrame(rows, "id string, content string, seq int")
    c.write(make([("a", "1", 1), ("b", "1", 1), ("a", "2", 2)]), order="seq")
    assert {r["id"]: r["content"] for r in c.scan().collect()} == {"a": "2", "b": "1"}
    c.write(make([("b", "9", 1), ("c", "9", 1)]), policy="SKIP")
    assert {r["id"]: r["content"] for r in c.scan().collect()} == {"a": "2", "b": "1", "c": "9"}
    with pytest.raises(DuplicateError):
        c.write(make([("b", "9", 1)]), policy="FAIL")
    c.write(make([("b", "8", 1)]))
    assert c.count(L("content", "==", "8")) == 1
    c.delete(make([("a", "", 0)]))
    assert c.count() == 2
    c.clear()
    assert c.count() == 0


def test_sinks(spark, tmp_path):
    one = spark.createDataFrame([(1, 0.5)], "step int, loss double")
    sinks.append_telemetry(spark, str(tmp_path / "t"), one)
    both = sinks.append_telemetry(spark, str(tmp_path / "t"), one.withColumn("lr", F.lit(0.1)))
    assert both.count() == 2 and both.where("lr is null").count() == 1
    m = spark.createDataFrame([("mrr@5", 0.6, 0.3)], "name string, mean double, std double")
    path = sinks.write_metrics(m, str(tmp_path), "a/b c")
    assert spark.read.csv(path, header=True).first()["dataset"] == "a/b c" and path.endswith("a_b_c")


def test_messages(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.txt").write_text('{"message": "hi", "k": "v"}\n{"message": "ho"}\n')
    s = queues.consume(spark, str(tmp_path / "in"))
    q = queues.publish(s, str(tmp_path / "out"), str(tmp_path / "cp"), queues.to_message(F.col("message"), k=F.col("metadata")["k"]))
    q.awaitTermination()
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"message":"hi","k":"v"}', '{"message":"ho"}']


def test_bounded_memory(spark, tmp_path):
    keep = queues.keep_last(spark, str(tmp_path), "seq", 3, warm_up=1)
    for b in range(4):
        keep(spark.createDataFrame([(2 * b,), (2 * b + 1,)], "seq int"), b)
    assert sorted(r["seq"] for r in spark.read.parquet(f"{tmp_path}/v3").collect()) == [5, 6, 7]


def _call(x):
    if x == "bad":
        raise ValueError("no")
    return x.upper()


def test_mapped_calls(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bad")], "id long, text string")
    got = {r["id"]: (r["text"], r["error"]) for r in queues.mapped(df, _call, "text").collect()}
    assert got == {1: ("A", None), 2: (None, "ValueError: no")}
    assert queues.with_retries(_call, 2, 0.0)("x") == "X"
