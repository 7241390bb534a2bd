"""Search and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators import evaluate, search
from siftwell.plans.registry import query, table

_TERMS = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
# Searches take every query whose id is divisible by 100, with its whole text, against all rows.
_Q = "SELECT item_id AS query_id, text AS query FROM benchmark WHERE item_id % 100 = 0"
_BM25 = f"""
q AS ({_Q}),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_TERMS.format('query')}) AS term FROM q) GROUP BY ALL),
d AS (SELECT doc_id, {_TERMS.format('text')} AS terms FROM documents),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(terms)) AS avgdl FROM d),
p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 12) AS score
  FROM p JOIN df USING (term) JOIN qt USING (term), st GROUP BY ALL)"""


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))


@query(f"WITH {_BM25} SELECT query_id, rank::INT AS rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10")
def r01_bm25_search(spark, d):
    return search.bm25(_documents(spark, d), _queries(spark, d), 10).withColumn("score", F.round("score", 6))


@query(f"WITH {_BM25.replace('AS terms FROM documents)', chr(39).join(['AS terms FROM documents WHERE lang = ', 'en', ')']))} SELECT query_id, rank::INT AS rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5")
def r01_bm25_search_filtered(spark, d):
    from siftwell.operators.filters import apply_filter

    docs = apply_filter(table(spark, d, "documents"), {"field": "lang", "operator": "==", "value": "en"}).select("doc_id", F.col("text").alias("content"))
    return search.bm25(docs, _queries(spark, d), 5).withColumn("score", F.round("score", 6))


_COS = """
v AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE embedding IS NOT NULL),
c AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, q.label = c.label AS relevant, round((1 + list_cosine_similarity(q.v, c.v)) / 2, 12) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id) AS rank FROM c) WHERE rank <= 10)"""


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("doc_id"), "embedding"), e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query(f"WITH {_COS} SELECT query_id, rank::INT AS rank, doc_id, round(score, 6) AS score FROM n")
def r02_vector_search(spark, d):
    docs, q = _vectors(spark, d)
    search.check_vectors(q, "vector")
    return search.vector_search(docs, q, 10).withColumn("score", F.round("score", 6))


_HYBRID = """
WITH kw AS (SELECT orderkey AS query_id, n AS doc_id, k AS score FROM (SELECT l_orderkey % 50 AS orderkey, l_suppkey AS n, sum(l_quantity)::DOUBLE AS k FROM lineitem GROUP BY ALL)),
ve AS (SELECT l_orderkey % 50 AS query_id, l_suppkey AS doc_id, round(sum(l_extendedprice), 2)::DOUBLE AS score FROM lineitem WHERE l_discount > 0.04 GROUP BY ALL),
ks AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS ks FROM kw WINDOW w AS (PARTITION BY query_id)),
vs AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS vs FROM ve WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT query_id, doc_id, round(0.3 * coalesce(vs, 0) + 0.7 * coalesce(ks, 0), 12) AS score FROM ks FULL JOIN vs USING (query_id, doc_id))
SELECT query_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 20
"""


@query(_HYBRID)
def r03_score_fusion(spark, d):
    li = table(spark, d, "lineitem").withColumn("query_id", F.col("l_orderkey") % 50).withColumnRenamed("l_suppkey", "doc_id")
    kw = li.groupBy("query_id", "doc_id").agg(F.sum("l_quantity").cast("double").alias("score"))
    ve = li.where("l_discount > 0.04").groupBy("query_id", "doc_id").agg(F.round(F.sum("l_extendedprice"), 2).cast("double").alias("score"))
    return search.fuse(kw, ve, 0.3, 20).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_BM25}, {_COS.replace('row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id) AS rank FROM c) WHERE rank <= 10', '1 AS rank FROM c) WHERE false').replace('q.vec_id % 100 = 0', 'q.vec_id IN (SELECT query_id FROM q)')},
kc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM s) WHERE r <= 100),
vc AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id) AS r FROM c) WHERE r <= 100),
ks AS (SELECT query_id, doc_id, coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 1.0) AS ks FROM kc WINDOW w AS (PARTITION BY query_id)),
vs AS (SELECT query_id, doc_id, coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 1.0) AS vs FROM vc WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT query_id, doc_id, round(0.5 * coalesce(vs, 0) + 0.5 * coalesce(ks, 0), 12) AS score FROM ks FULL JOIN vs USING (query_id, doc_id))
SELECT query_id, rank::INT AS rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 10""")
def r03_hybrid_search(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    docs = _documents(spark, d)
    q = _queries(spark, d)
    qv = q.join(e.withColumnRenamed("doc_id", "query_id").withColumnRenamed("embedding", "vector"), "query_id")
    return search.fuse(search.bm25(docs, q, 100), search.vector_search(e, qv, 100), 0.5, 10).withColumn("score", F.round("score", 6))


def _ranked(spark, d):
    docs, q = _vectors(spark, d)
    e = table(spark, d, "embeddings")
    r = search.vector_search(docs, q, 10)
    r = r.join(e.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("dl")), "doc_id").join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id")
    return r.select("query_id", "rank", (F.col("dl") == F.col("ql")).alias("relevant"))


def _metric_sql(ks=(1, 5, 10)) -> str:
    parts = []
    for k in ks:
        parts.append(f"""SELECT query_id, 'HitRate' AS name, {k} AS k, max(CASE WHEN rank <= {k} AND rel = 1 THEN 1.0 ELSE 0 END)::DOUBLE AS value FROM r GROUP BY 1
UNION ALL SELECT query_id, 'mrr', {k}, coalesce(1.0 / min(CASE WHEN rank <= {k} AND rel = 1 THEN rank END), 0)::DOUBLE FROM r GROUP BY 1
UNION ALL SELECT query_id, 'map', {k}, coalesce(avg(CASE WHEN rank <= {k} AND rel = 1 THEN seen / rank END), 0)::DOUBLE FROM r GROUP BY 1
UNION ALL SELECT query_id, 'ndcg', {k}, CASE WHEN sum(rel) = 0 THEN 0.0 ELSE sum(CASE WHEN rank <= {k} AND rel = 1 THEN 1 / log2(rank + 1) ELSE 0 END) / list_sum([1 / log2(i + 1) FOR i IN range(1, least(sum(rel)::INT, {k}) + 1)]) END FROM r GROUP BY 1""")
    return f"WITH {_COS}, r AS (SELECT query_id, rank, relevant::INT AS rel, sum(relevant::INT) OVER (PARTITION BY query_id ORDER BY rank) AS seen FROM n), m AS ({' UNION ALL '.join(parts)})"


@query(f"{_metric_sql()} SELECT query_id, name, k, round(value, 6) AS value FROM m")
def m01_metrics_per_query(spark, d):
    return evaluate.per_query(_ranked(spark, d), (1, 5, 10)).withColumn("value", F.round("value", 6))


@query(f"{_metric_sql()} SELECT name || '@' || k AS name, round(avg(value), 6) AS mean, round(CASE WHEN count(*) = 1 THEN 0.0 ELSE stddev_samp(value) END, 6) AS std, 'embeddings' AS dataset FROM m GROUP BY name, k")
def m08_evaluation_table(spark, d):
    return evaluate.evaluate(_ranked(spark, d), (1, 5, 10)).select("name", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.lit("embeddings").alias("dataset"))


@query("""WITH r AS (SELECT conv_id AS query_id, turn + 1 AS rank, role = 'assistant' AS relevant FROM conversations)
SELECT round(avg(m), 6) AS mean_mrr, count(*) AS n FROM (SELECT query_id, coalesce(1.0 / min(CASE WHEN relevant AND rank <= 5 THEN rank END), 0) AS m FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, relevant FROM r) GROUP BY 1)""")
def m02_mrr_of_first_answer(spark, d):
    from pyspark.sql.window import Window

    c = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("rank"), (F.col("role") == "assistant").alias("relevant"))
    v = evaluate.per_query(c, (5,)).where("name = 'mrr'")
    return v.agg(F.round(F.avg("value"), 6).alias("mean_mrr"), F.count(F.lit(1)).alias("n"))


@query("""WITH d AS (SELECT doc_id, [lang, source] AS labels FROM documents), q AS (SELECT DISTINCT lang AS query FROM documents)
SELECT query, count(*) AS relevant FROM q JOIN d ON list_contains(labels, query) GROUP BY 1""")
def j08_label_judgement(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.array("lang", "source").alias("labels"), "lang")
    ranked = docs.select("doc_id", F.col("lang").alias("query"))
    return evaluate.judged(ranked, docs.select("doc_id", "labels")).where("relevant").groupBy("query").agg(F.count(F.lit(1)).alias("relevant"))


_BATCH = """
b AS (SELECT vec_id // 16 AS batch, vec_id % 16 AS i, embedding::DOUBLE[] AS v, label FROM embeddings),
s AS (SELECT a.batch, a.i, c.i AS j, list_inner_product(a.v, c.v) + CASE WHEN a.i = c.i THEN -0.7 ELSE 0 END AS s FROM b a JOIN b c ON a.batch = c.batch)"""


def batch_scores(spark, d, handicap: float = 0.7):
    from siftwell.operators.geometry import batch_similarities

    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 16).alias("batch"), (F.col("vec_id") % 16).alias("i"), F.col("embedding").alias("v"))
    s = batch_similarities(e, e)
    return s.withColumn("s", F.col("s") + F.when(F.col("i") == F.col("j"), -handicap).otherwise(0.0))


@query(f"""WITH {_BATCH}, r AS (SELECT batch, i, rank FROM (SELECT *, row_number() OVER (PARTITION BY batch, i ORDER BY s DESC, j) AS rank FROM s) WHERE i = j)
SELECT batch, sum((rank > 1)::INT)::BIGINT AS errors, round(avg((rank > 1)::INT), 6) AS error_rate, round(avg((rank <= 1)::INT), 6) AS hr1, round(avg((rank <= 3)::INT), 6) AS hr3, round(avg((rank <= 5)::INT), 6) AS hr5,
 round(avg(1.0 / rank), 6) AS mrr, round(avg(rank), 6) AS mean_rank, quantile_disc(rank, 0.5)::BIGINT AS median_rank FROM r GROUP BY 1""")
def m09_in_batch_metrics(spark, d):
    m = evaluate.batch_metrics(batch_scores(spark, d))
    return m.select("batch", "errors", "median_rank", *(F.round(c, 6).alias(c) for c in ("error_rate", "hr1", "hr3", "hr5", "mrr", "mean_rank")))


@query(f"""WITH {_BATCH}, r AS (SELECT batch, i, rank FROM (SELECT *, row_number() OVER (PARTITION BY batch, i ORDER BY s DESC, j) AS rank FROM s) WHERE i = j),
c AS (SELECT batch, i, max(CASE WHEN i = j THEN exp(s / 0.1) END) / sum(exp(s / 0.1)) AS confidence FROM s GROUP BY ALL),
g AS (SELECT CASE WHEN confidence < 1.0 / 3 THEN 'low' WHEN confidence < 2.0 / 3 THEN 'medium' ELSE 'high' END AS bucket, rank FROM r JOIN c USING (batch, i))
SELECT n.bucket, count(g.rank) AS n, coalesce(round(avg((rank = 1)::INT), 6), 'nan'::DOUBLE) AS hr1, coalesce(round(avg(1.0 / rank), 6), 'nan'::DOUBLE) AS mrr FROM (VALUES ('low'), ('medium'), ('high')) n(bucket) LEFT JOIN g USING (bucket) GROUP BY 1""")
def a11_confidence_buckets(spark, d):
    from siftwell.operators.training import confidence

    s = batch_scores(spark, d)
    b = evaluate.confidence_buckets(evaluate.positive_ranks(s).join(confidence(s, 0.1), ["batch", "i"]))
    return b.select("bucket", "n", F.round("hr1", 6).alias("hr1"), F.round("mrr", 6).alias("mrr"))


@query("SELECT round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS max FROM events WHERE isfinite(value)")
def a03_distribution_panel(spark, d):
    p = evaluate.distribution(table(spark, d, "events"), "value")
    return p.select(*(F.round(c, 6).alias(c) for c in p.columns))


@query("""WITH c AS (SELECT quality AS y, toxic AS p, count(*) AS n FROM labels GROUP BY ALL), k AS (SELECT y AS c FROM c UNION SELECT p FROM c),
f AS (SELECT c, 2.0 * coalesce((SELECT sum(n) FROM c x WHERE x.y = k.c AND x.p = k.c), 0) / (coalesce((SELECT sum(n) FROM c x WHERE x.y = k.c), 0) + coalesce((SELECT sum(n) FROM c x WHERE x.p = k.c), 0)) AS f1 FROM k)
SELECT round((SELECT sum(n) FILTER (y = p) / sum(n) FROM c), 6) AS accuracy, round((SELECT sum(n) FILTER (y = p) / sum(n) FROM c), 6) AS f1_micro, round(avg(f1), 6) AS f1_macro FROM f""")
def a15_classification(spark, d):
    c = evaluate.classification(table(spark, d, "labels"), "quality", "toxic")
    return c.select(*(F.round(x, 6).alias(x) for x in c.columns))
