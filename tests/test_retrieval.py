"""Embedders, indexer, retrievers, configuration and requests on small fixtures."""

import pytest
from pyspark.sql import functions as F

from siftwell.functions import text
from siftwell.operators import evaluate, relational, training
from siftwell.operators import retrieval as r
from siftwell.sources.store import Collection


def marks(texts):
    return [[float(t.count("a")), float(t.count("b")), 1.0] for t in texts]


def short(texts):
    return marks(texts)[1:]


def ragged(texts):
    return [[1.0] * (1 + len(t) % 2) for t in texts]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([("x", "aaa"), ("y", "bbb"), ("z", "ab ab"), ("n", None)], "id string, content string")


def test_embedder(spark, docs):
    e = r.Embedder(marks, r.Profile(document_prefix="ab", batch_size=2))
    got = {x["id"]: x["embedding"] for x in e.documents(docs).collect()}
    # A prefix that stands there already is not put before the text again.
    assert got == {"x": [4, 1, 1], "y": [1, 4, 1], "z": [2, 2, 1], "n": [1, 1, 1]}
    assert r.Embedder(marks).documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("call", [short, ragged])
def test_embedder_refuses(docs, call):
    with pytest.raises(Exception, match="finite vectors of one length|inhomogeneous"):
        r.Embedder(call).documents(docs.coalesce(1)).collect()


def test_ordered_vectors():
    item = lambda i, v: {"index": i, "embedding": v}
    assert r.ordered_vectors({"data": [item(1, [2.0]), item(0, [1.0])]}, 2) == [[1.0], [2.0]]
    for bad in (None, {}, {"data": [item(0, [1.0])]}, {"data": [item(0, [1]), item(0, [1])]}, {"data": [item(True, [1]), item(0, [1])]}, {"data": [item(0, "x"), item(1, [1])]}, {"data": [item(0, [1]), item(2, [1])]}):
        with pytest.raises(r.EmbeddingError):
            r.ordered_vectors(bad, 2)
    sent = []
    call = r.remote_call("m", lambda p: sent.append(p) or {"data": [item(0, [1.0])]}, "float", {"user": "u"})
    assert call(["t"]) == [[1.0]] and sent == [{"user": "u", "model": "m", "input": ["t"], "encoding_format": "float"}]


def test_indexer(spark, docs, tmp_path):
    c = Collection(spark, str(tmp_path), "things")
    assert r.Indexer(c, r.Embedder(marks)).index(docs) == 4
    assert {x["id"]: x["embedding"] for x in c.scan(vectors=True).collect()}["x"] == [3, 0, 1]
    # Without an embedder vectors are cleared.
    assert r.Indexer(c).index(docs.where("id = 'x'")) == 1
    assert {x["id"]: x["embedding"] for x in c.scan(vectors=True).collect()}["x"] is None
    assert c.count() == 4
    with pytest.raises(r.StoreError) as e:
        r.Indexer(c).index(docs.where("id = 'x'"), policy="FAIL")
    assert type(e.value.__cause__).__name__ == "DuplicateError"


def test_unfinished_versions_do_not_count(spark, docs, tmp_path):
    c = Collection(spark, str(tmp_path), "things")
    c.write(docs.where("id = 'x'"))
    (tmp_path / "Things" / "v000002").mkdir()
    assert c.count() == 1
    c.write(docs)
    assert c.count() == 4


def test_retrievers(spark, docs, tmp_path):
    c, e = Collection(spark, str(tmp_path), "things"), r.Embedder(marks)
    q = spark.createDataFrame([(1, "bbb"), (2, "ab")], "query_id long, query string")
    assert r.Retriever(c).retrieve_many(q).count() == 0
    r.Indexer(c, e).index(docs)
    best = lambda x: {(t["query_id"], t["id"]) for t in x.where("rank = 1").collect()}
    assert best(r.Retriever(c).retrieve_many(q)) == {(1, "y"), (2, "z")}
    assert best(r.Retriever(c, "vector", e).retrieve_many(q)) == {(1, "y"), (2, "z")}
    assert best(r.Retriever(c, "hybrid", e).retrieve_many(q, 2)) == {(1, "y"), (2, "z")}
    assert r.Retriever(c, "vector", e).retrieve_many(q.limit(0)).count() == 0
    only = r.Retriever(c, "vector", e).retrieve("bbb", top_k=3, filters={"field": "id", "operator": "!=", "value": "y"}, vectors=True)
    assert "y" not in [x["id"] for x in only.collect()] and "embedding" in only.columns
    for bad in (0, True, 1.5):
        with pytest.raises(ValueError):
            r.Retriever(c).retrieve_many(q, bad)
    with pytest.raises(ValueError):
        r.Retriever(c, "hybrid", e, alpha=1.1)


@pytest.mark.parametrize("config", [
    None, {}, {"mode": "fuzzy", "store": {"collection": "c"}}, {"mode": "vector", "store": {"collection": "c"}}, {"mode": "keyword"}, {"mode": "keyword", "store": {"collection": " "}},
    {"mode": "keyword", "store": {"collection": "c"}, "other": 1}, {"mode": "keyword", "store": {"collection": "c", "port": 1}}, {"mode": "keyword", "alpha": 2, "store": {"collection": "c"}},
    {"mode": "vector", "store": {"collection": "c"}, "embedding": {"backend": "local", "model": "none"}}, {"mode": "vector", "store": {"collection": "c"}, "embedding": {"backend": "remote", "model": "m"}},
    {"mode": "vector", "store": {"collection": "c"}, "embedding": {"backend": "local", "model": "m", "batch_size": 0}},
])
def test_configuration(spark, config):
    with pytest.raises(r.ConfigError):
        r.Runtime(spark, config, {"m": marks})


def test_requests():
    assert r.search_request({"text": " a "}) == {"text": "a", "top_k": 5, "filter_by": None}
    assert r.index_request({"dataset_name_or_docs": [{"content": "x"}], "batch_size": 2})["batch_size"] == 2
    assert r.delete_request({}) == {}
    for f, bad in (
        (r.search_request, []), (r.search_request, {"text": " "}), (r.search_request, {"text": "a", "k": 1}), (r.search_request, {"text": "a", "top_k": True}), (r.search_request, {"text": "a", "filter_by": []}),
        (r.index_request, {}), (r.index_request, {"dataset_name_or_docs": [1]}), (r.index_request, {"dataset_name_or_docs": "d", "batch_size": 0}), (r.delete_request, {"id": 1}),
    ):
        with pytest.raises(r.RequestError):
            f(bad)


def test_idf_negatives(spark):
    rows = [(0, 0, "a", "a", "a", "q", "d0"), (0, 1, "b", "b", "a", "q", "d1"), (0, 2, "c", "a", "c", "q", "d2"), (1, 0, "a", "a", "a", "q", "d"), (1, 1, "a", "b", "b", "q", "d"), (2, 0, "a", "a", "a", "q", "d")]
    df = spark.createDataFrame(rows, "batch int, i int, doc_key string, content_key string, query_key string, query string, doc string")
    score = lambda q, d: F.coalesce(F.substring(d, 2, 1).try_cast("double"), F.lit(0.0)) / 10
    got = lambda **o: {(x["batch"], x["i"]): (x["negative"], x["fallback"]) for x in training.idf_negatives(df, score, **o).collect()}
    # Row 0 has only the query in common with row 1; batch 1 has equal document keys; batch 2 one row.
    assert got() == {(0, 0): (1, False), (0, 1): (2, False), (0, 2): (1, False), (1, 0): (1, True), (1, 1): (0, True), (2, 0): (0, True)}
    assert got(mode="hard-idf", high=0.0)[0, 1] == (2, False)
    with pytest.raises(ValueError):
        got(mode="soft")


def test_bank_identities(spark):
    rows = spark.createDataFrame([(0, 0, "a", "x")], "batch int, i int, doc_key string, query_key string")
    bank = spark.createDataFrame([(0, 0, "a"), (0, 1, "b")], "batch int, slot int, doc_key string")
    match = lambda a, b: [x["match"] for x in training.bank_identities(a, b).orderBy("slot").collect()]
    assert match(rows, bank) == [True, False]
    assert match(rows.drop("doc_key"), bank) == [True, True]


def test_selections_and_scores(spark):
    d, n = spark.range(10).toDF("pid"), spark.createDataFrame([(3,), (3,), (99,)], "pid long")
    got = relational.corpus_selection(d, n, 4).collect()
    assert len(got) == 4 and [x["pid"] for x in got if x["needed"]] == [3]
    assert training.repeated_samples(spark.range(10), 3, 4, "id").groupBy("sample").count().count() == 4
    s = spark.createDataFrame([(1, "q", 1, None, ["q"]), (1, "q", 2, 0.5, ["p"]), (1, "q", 3, None, None)], "query_id int, query string, rank int, score double, labels array<string>")
    assert [(x["score"], x["relevant"]) for x in evaluate.scored_results(s).orderBy("rank").collect()] == [(3.0, True), (0.5, False), (1.0, False)]


def test_coverage(spark):
    c = text.coverage(F.array(F.lit("One two"), F.lit(None).cast("string")), F.lit("two three, four"), F.array(F.struct(F.lit("two").alias("keyword_or_phrase"), F.lit("four").alias("explanation"))))
    got = spark.range(1).select(c.alias("c")).first()["c"].asDict()
    assert got == pytest.approx({"LQ": 1.0, "LD": 3.0, "LQD": 1 / 6, "LKD": 1 / 3, "LKED": 2 / 3})
