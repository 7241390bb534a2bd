"""Queries over embeddings and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.functions import vectors
from siftwell.operators import geometry, training
from siftwell.plans.registry import query, table
from siftwell.plans.retrieval import _BATCH, batch_scores


def _rounded(df, *keep, digits=6):
    return df.select(*keep, *(F.round(c, digits).alias(c) for c in df.columns if c not in keep))


@query("SELECT round(avg(n), 6) AS norm_mean, round(stddev_pop(n), 6) AS norm_std FROM (SELECT sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)")
def g01_norms(spark, d):
    return _rounded(geometry.norms(table(spark, d, "embeddings"), "embedding"))


@query(f"WITH {_BATCH} SELECT round(avg(s) FILTER (i = j), 6) AS pos_mean, round(stddev_pop(s) FILTER (i = j), 6) AS pos_std, round(avg(s) FILTER (i <> j), 6) AS neg_mean, round(stddev_pop(s) FILTER (i <> j), 6) AS neg_std, round(max(s) FILTER (i <> j), 6) AS neg_max, round(avg(s) FILTER (i = j) - avg(s) FILTER (i <> j), 6) AS gap, round(2 - 2 * avg(s) FILTER (i = j), 6) AS alignment FROM s")
def g02_similarity_panel(spark, d):
    return _rounded(geometry.similarity_panel(batch_scores(spark, d)))


@query(f"WITH {_BATCH} SELECT batch, round(coalesce(ln(avg(exp(-2 * (2 - 2 * s))) FILTER (i <> j)), 'nan'::DOUBLE), 6) AS uniformity FROM s GROUP BY 1")
def g04_uniformity(spark, d):
    return _rounded(geometry.uniformity(batch_scores(spark, d)), "batch")


@query()
def g05_spectrum(spark, d):
    return geometry.spectrum(table(spark, d, "embeddings"), "embedding")


@query(f"WITH {_BATCH} SELECT batch, i, round(-max(s / 0.05) FILTER (i = j) + ln(sum(exp(s / 0.05))), 6) AS loss FROM s GROUP BY ALL")
def t05_info_nce(spark, d):
    return _rounded(training.info_nce(batch_scores(spark, d), 0.05), "batch", "i")


@query(f"WITH {_BATCH} SELECT batch, i, round(coalesce(-max(s / 0.05) FILTER (i = j) + ln(sum(exp(s / 0.05)) FILTER (i <> j)), 0), 6) AS loss FROM s GROUP BY ALL")
def t06_decoupled_info_nce(spark, d):
    return _rounded(training.info_nce(batch_scores(spark, d), 0.05, decoupled=True), "batch", "i")


_BANK = """
bs AS (SELECT b.batch, b.i, k.vec_id AS slot, list_inner_product(b.v, k.embedding::DOUBLE[]) AS s, b.label = k.label AS match FROM b JOIN embeddings k ON k.vec_id >= b.batch * 16 - 24 AND k.vec_id < b.batch * 16)"""


def _bank(spark, d):
    """Each batch of 16 against a first-in-first-out bank of the 24 vectors before it."""
    e = table(spark, d, "embeddings")
    q = e.select(F.floor(F.col("vec_id") / 16).alias("batch"), (F.col("vec_id") % 16).alias("i"), F.col("embedding").alias("v"), "label")
    held = F.explode(F.sequence(F.floor(F.col("vec_id") / 16) + 1, F.floor((F.col("vec_id") + 24) / 16)))
    bank = e.select(held.alias("batch"), F.col("vec_id").alias("slot"), F.col("embedding").alias("bv"), F.col("label").alias("bl"))
    return q.join(bank, "batch").select("batch", "i", "slot", vectors.dot(F.col("v"), F.col("bv")).alias("s"), (F.col("label") == F.col("bl")).alias("match"))


@query(f"WITH {_BATCH}, {_BANK}, sel AS (SELECT batch, i, slot, row_number() OVER (PARTITION BY batch, i ORDER BY s DESC, slot) AS r FROM bs WHERE NOT match) SELECT batch, i, slot FROM sel WHERE r <= 4")
def o02_hard_bank_selection(spark, d):
    return training.bank_selection(_bank(spark, d), "hard", hard=4).select("batch", "i", "slot")


@query(f"""WITH {_BATCH}, {_BANK}, w AS (SELECT batch, i, slot, s, 0.5 * 15 / count(*) OVER (PARTITION BY batch, i) AS weight FROM bs WHERE NOT match),
z AS (SELECT batch, i, s / 0.05 AS z, i = j AS pos FROM s UNION ALL SELECT batch, i, s / 0.05 + ln(weight), false FROM w)
SELECT batch, i, round(ln(sum(exp(z))) - max(z) FILTER (pos), 6) AS loss FROM z GROUP BY ALL""")
def t07_info_nce_with_bank(spark, d):
    w = training.mass_weight(training.bank_selection(_bank(spark, d), "all"), 16, 0.5)
    return _rounded(training.info_nce_with_bank(batch_scores(spark, d), w, 0.05), "batch", "i")


@query(f"""WITH {_BATCH}, {_BANK}, t AS (SELECT batch, i, max(bs.s) AS top FROM bs GROUP BY ALL)
SELECT t.batch, t.i, round(top - s.s, 6) AS g, round(1 / (1 + exp(-(0.1 - (top - s.s)) / 0.05)), 6) AS weight FROM t JOIN s ON t.batch = s.batch AND t.i = s.i AND s.j = s.i""")
def t09_collision_weight(spark, d):
    return _rounded(training.collision_weight(_bank(spark, d), batch_scores(spark, d).where("i = j"), 0.1, 0.05), "batch", "i")


@query(f"WITH {_BATCH} SELECT batch, i, round(avg(s), 6) AS soft_fn FROM (SELECT *, row_number() OVER (PARTITION BY batch, i ORDER BY s DESC, j) AS r FROM s WHERE i <> j) WHERE r <= 3 GROUP BY ALL")
def o09_soft_false_negatives(spark, d):
    return _rounded(training.soft_false_negatives(batch_scores(spark, d), 3), "batch", "i")


@query(f"WITH {_BATCH} SELECT batch, i, round(max(exp(s)) FILTER (i = j) / sum(exp(s)), 6) AS confidence FROM s GROUP BY ALL")
def t14_confidence(spark, d):
    return _rounded(training.confidence(batch_scores(spark, d)), "batch", "i")


@query(f"WITH {_BATCH}, x AS (SELECT s.batch, s.i, s.j, sqrt(greatest(2 - 2 * s.s, 0)) AS d, a.label = c.label AS same FROM s JOIN b a ON a.batch = s.batch AND a.i = s.i JOIN b c ON c.batch = s.batch AND c.i = s.j WHERE s.i <> s.j) SELECT batch, i, round(greatest(0, coalesce(max(d) FILTER (same) - min(d) FILTER (NOT same) + 0.2, 0)), 6)::DOUBLE AS loss FROM x GROUP BY ALL")
def t11_triplet(spark, d):
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 16).alias("batch"), (F.col("vec_id") % 16).alias("i"), "label")
    s = batch_scores(spark, d).join(e, ["batch", "i"]).join(e.withColumnsRenamed({"i": "j", "label": "other"}), ["batch", "j"])
    s = s.select("batch", "i", "j", F.sqrt(F.greatest(2 - 2 * F.col("s"), F.lit(0.0))).alias("d"), (F.col("label") == F.col("other")).alias("same"))
    return _rounded(training.triplet(s), "batch", "i")


@query("""SELECT round(sum(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))) / count(*), 6) AS bce,
 round(avg((CASE WHEN y = 1 THEN 0.25 ELSE 0.75 END) * power(1 - CASE WHEN y = 1 THEN 1 / (1 + exp(-z)) ELSE 1 - 1 / (1 + exp(-z)) END, 2) * (greatest(z, 0) - z * y + ln(1 + exp(-abs(z))))), 6) AS focal,
 round(avg((y * z * z + (1 - y) * power(greatest(0.0, 1 - z), 2)) / 2), 6) AS contrastive FROM (SELECT (doc_id % 7 - 3)::DOUBLE AS z, toxic::DOUBLE AS y FROM labels)""")
def t11_pointwise_losses(spark, d):
    x = table(spark, d, "labels").select((F.col("doc_id") % 7 - 3).cast("double").alias("z"), F.col("toxic").cast("double").alias("y"))
    z, y = F.col("z"), F.col("y")
    return x.agg(F.round(F.avg(training.bce_with_logits(z, y)), 6).alias("bce"), F.round(F.avg(training.focal(z, y)), 6).alias("focal"), F.round(F.avg(training.soft_contrastive(z, y)), 6).alias("contrastive"))


@query("""WITH x AS (SELECT (doc_id % 10) / 10.0::DOUBLE AS p, toxic::DOUBLE AS y FROM labels)
SELECT round(1 - (2 * sum(p * y) + 1) / (sum(p) + sum(y) + 1), 6) AS dice, round(1 - (sum(p * y) + 1) / (sum(p * y) + 0.5 * sum(p * (1 - y)) + 0.5 * sum((1 - p) * y) + 1), 6) AS tversky FROM x""")
def t11_overlap_losses(spark, d):
    x = table(spark, d, "labels").select((F.col("doc_id") % 10 / 10.0).alias("p"), F.col("toxic").cast("double").alias("y"))
    return _rounded(training.overlap_losses(x, "p", "y"))


@query(f"""WITH {_BATCH}, t AS (SELECT batch, i, j, exp(s / 0.2) / sum(exp(s / 0.2)) OVER (PARTITION BY batch, i) AS p FROM s), u AS (SELECT batch - 1 AS batch, i, j, p AS q FROM t)
SELECT batch * 16 + i AS i, round(sum(p * (ln(p) - ln(q))), 6) AS kl, round(-sum(p * ln(p)), 6) AS entropy FROM t JOIN u USING (batch, i, j) GROUP BY 1""")
def t12_neighbourhood_kl(spark, d):
    """Each batch as the teacher of the next one."""
    at = lambda df, shift: df.select(((F.col("batch") - shift) * 16 + F.col("i")).alias("i"), "j", "s")
    s = batch_scores(spark, d)
    return _rounded(training.neighbourhood_kl(at(s, 1), at(s, 0), 0.2), "i")


@query("""WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS g, b.embedding::DOUBLE[] AS r FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
k AS (SELECT vec_id, g, r, CASE WHEN list_inner_product(g, r) < 0 THEN -list_inner_product(g, r) / list_inner_product(r, r) ELSE 0 END AS k FROM p)
SELECT vec_id, round(list_sum([(k * r[i] + g[i]) * r[i] FOR i IN range(1, len(g) + 1)]), 6) + 0.0 AS along FROM k""")
def t13_gradient_projection(spark, d):
    e = table(spark, d, "embeddings")
    p = e.select("vec_id", F.col("embedding").alias("g")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("r")), "vec_id")
    return p.select("vec_id", (F.round(vectors.dot(vectors.project_out(F.col("g"), F.col("r")), F.col("r")), 6) + 0.0).alias("along"))


@query("SELECT vec_id, round(list_inner_product(e, w) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(w, w))), 6) AS cos, round(list_distance(e, w), 6) AS dist, round((list_cosine_similarity(e, w) + 1) / 2, 6) AS unit FROM (SELECT a.vec_id, a.embedding::DOUBLE[] AS e, b.embedding::DOUBLE[] AS w FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)")
def x14_vector_functions(spark, d):
    e = table(spark, d, "embeddings")
    p = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    a, b = F.col("a"), F.col("b")
    return p.select("vec_id", F.round(vectors.cosine(a, b), 6).alias("cos"), F.round(vectors.euclidean(a, b), 6).alias("dist"), F.round(vectors.unit_score(vectors.cosine(a, b), True), 6).alias("unit"))


@query("WITH t AS (SELECT vec_id, embedding[1:32]::DOUBLE[] AS v FROM embeddings) SELECT vec_id, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS first, round(v[32] / sqrt(list_inner_product(v, v)), 6) AS last, 32 AS dim FROM t")
def x24_truncated_vectors(spark, d):
    t = table(spark, d, "embeddings").select("vec_id", vectors.truncate(F.col("embedding"), 32).alias("v"))
    return t.select("vec_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[31], 6).alias("last"), F.size("v").alias("dim"))


@query("""WITH t AS (SELECT vec_id // 8 AS g, vec_id, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT * FROM t WHERE vec_id % 8 <> 7)
SELECT g, round(avg(v[1]), 6) AS mean1, round(max(v[1]), 6) AS max1, round(max_by(v[1], vec_id), 6) AS last1 FROM m GROUP BY 1""")
def x25_pooling(spark, d):
    e = table(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 8).alias("g")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("r"))
    e = e.select("g", F.transform("r", lambda x: x["embedding"]).alias("t"), F.transform("r", lambda x: F.when(x["vec_id"] % 8 == 7, 0).otherwise(1)).alias("m"))
    return e.select("g", *(F.round(vectors.pooled(F.col("t"), F.col("m"), how)[0], 6).alias(f"{how}1") for how in ("mean", "max", "last")))


@query("SELECT event_id, round(1 / (1 + exp(-value / 100)), 6) AS unit FROM events")
def x12_logistic_scale(spark, d):
    return table(spark, d, "events").select("event_id", F.round(vectors.unit_score(F.col("value"), False), 6).alias("unit"))


@query()
def k01_kmeans_topics(spark, d):
    from siftwell.operators.clusters import kmeans

    return kmeans(table(spark, d, "embeddings"), "embedding", 10).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query()
def k02_two_dimensions(spark, d):
    from siftwell.operators.clusters import project_2d

    return project_2d(table(spark, d, "embeddings"), "embedding").select("vec_id", "label", "x", "y")
