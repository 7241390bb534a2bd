"""Retrieval metrics over flat rankings ``(query_id, rank, relevant[, dataset])``.

Only retrieved documents count, also for ideal gains; queries without results are not there and
so are skipped, not zero. Means go with sample deviations, which are 0 for one query.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Default cutoffs and names of metrics.
CUTOFFS = (1, 2, 5, 10, 12, 15, 20)
METRICS = ("HitRate", "mrr", "map", "ndcg")
_ALIASES = {"hr": "HitRate", "hitrate": "HitRate", "mrr": "mrr", "map": "map", "ndcg": "ndcg"}


def metric_name(name: str) -> str:
    key = re.sub(r"[_\-@\s]", "", name.lower())
    if key not in _ALIASES:
        raise ValueError(f"unknown metric {name!r}")
    return _ALIASES[key]


def depth(top_k: int, cutoffs=CUTOFFS) -> tuple[int, list[int]]:
    """How deep to retrieve, and the cutoffs, sorted and unique."""
    ks = sorted(set(cutoffs))
    return max([top_k, *ks]), ks


def judged(ranked: DataFrame, docs: DataFrame) -> DataFrame:
    """Mark results ``(query_id, query, rank, doc_id)`` relevant whose document's ``labels`` hold the query text."""
    return ranked.join(docs.select("doc_id", "labels"), "doc_id").withColumn("relevant", F.coalesce(F.array_contains("labels", F.col("query")), F.lit(False)))


def scored_results(ranked: DataFrame) -> DataFrame:
    """Results ``(query_id, query, rank, score, labels)`` with ``relevant`` and ``score`` for all.

    A label that is plain text is a list of one. Where a score is missing it is the number of the query's results less
    those before it, so that the order stays.
    """
    labels = F.array("labels") if dict(ranked.dtypes)["labels"] == "string" else F.col("labels")
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    default = (n - F.col("rank") + 1).cast("double")
    return ranked.withColumn("relevant", F.coalesce(F.array_contains(labels, F.col("query")), F.lit(False))).withColumn("score", F.coalesce(F.col("score").cast("double"), default))


def per_query(ranked: DataFrame, cutoffs=CUTOFFS) -> DataFrame:
    """Long rows ``query_id, name, k, value``."""
    by = Window.partitionBy("query_id").orderBy("rank")
    rel = F.col("relevant").cast("int")
    r = ranked.select("query_id", "rank", rel.alias("rel"), F.sum(rel).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("seen"))
    aggs = []
    for k in sorted(set(cutoffs)):
        hit = (F.col("rank") <= k) & (F.col("rel") == 1)
        n = F.sum(F.when(hit, 1).otherwise(0))
        dcg = F.sum(F.when(hit, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
        aggs += [
            F.max(F.when(hit, 1.0).otherwise(0.0)).alias(f"HitRate@{k}"),
            F.coalesce(1.0 / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)).alias(f"mrr@{k}"),
            F.coalesce(F.sum(F.when(hit, F.col("seen") / F.col("rank"))) / F.nullif(n, F.lit(0)), F.lit(0.0)).alias(f"map@{k}"),
            F.struct(dcg.alias("dcg"), F.sum("rel").alias("found")).alias(f"ndcg@{k}"),
        ]
    wide = r.groupBy("query_id").agg(*aggs)
    values = []
    for k in sorted(set(cutoffs)):
        best = F.least(F.col(f"ndcg@{k}.found"), F.lit(k))
        ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(best, F.lit(1))).cast("array<double>"), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
        for m in METRICS:
            v: Column = F.col(f"`{m}@{k}`") if m != "ndcg" else F.when(best > 0, F.col(f"`ndcg@{k}`.dcg") / ideal).otherwise(0.0)
            values.append(F.struct(F.lit(m).alias("name"), F.lit(k).alias("k"), v.alias("value")))
    return wide.select("query_id", F.explode(F.array(*values)).alias("m")).select("query_id", "m.*")


def summary(values: DataFrame, *by: str) -> DataFrame:
    """``name`` (as ``metric@k``), ``mean``, ``std`` over queries."""
    std = F.when(F.count("value") == 1, 0.0).otherwise(F.stddev_samp("value"))
    return values.groupBy(*by, F.concat_ws("@", "name", "k").alias("name")).agg(F.avg("value").alias("mean"), std.alias("std"))


def evaluate(ranked: DataFrame, cutoffs=CUTOFFS) -> DataFrame:
    return summary(per_query(ranked, cutoffs))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """One row: mean, population std, min, p05, p50, p95, max of the finite values; NaN without any."""
    c = F.col(column).cast("double")
    x = F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    p = F.percentile(x, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    out = df.agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), p.alias("p"), F.max(x).alias("max"))
    cols = {"mean": F.col("mean"), "std": F.col("std"), "min": F.col("min"), "p05": F.col("p")[0], "p50": F.col("p")[1], "p95": F.col("p")[2], "max": F.col("max")}
    return out.select(*(F.coalesce(v, F.lit(float("nan"))).alias(k) for k, v in cols.items()))


def positive_ranks(scores: DataFrame) -> DataFrame:
    """Rank of the diagonal in each row of ``scores(batch, i, j, s)``."""
    w = Window.partitionBy("batch", "i").orderBy(F.col("s").desc(), "j")
    return scores.withColumn("rank", F.row_number().over(w)).where("i = j").select("batch", "i", "rank")


def batch_metrics(scores: DataFrame) -> DataFrame:
    """Per batch: errors at 1, error rate, HR at 1, 3, 5, MRR, mean and lower median rank of the positive."""
    hr = [F.avg((F.col("rank") <= k).cast("double")).alias(f"hr{k}") for k in (1, 3, 5)]
    return positive_ranks(scores).groupBy("batch").agg(
        F.sum((F.col("rank") > 1).cast("long")).alias("errors"), F.avg((F.col("rank") > 1).cast("double")).alias("error_rate"), *hr,
        F.avg(1.0 / F.col("rank")).alias("mrr"), F.avg("rank").alias("mean_rank"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY rank)").cast("long").alias("median_rank"),
    )


def confidence_buckets(df: DataFrame) -> DataFrame:
    """Thirds of ``confidence`` with count, HR@1 and MRR of ``rank``; empty thirds have NaN."""
    third = F.when(F.col("confidence") < 1 / 3, "low").when(F.col("confidence") < 2 / 3, "medium").otherwise("high")
    got = df.groupBy(third.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("rank") == 1).cast("double")).alias("hr1"), F.avg(1.0 / F.col("rank")).alias("mrr"))
    names = df.sparkSession.createDataFrame([("low",), ("medium",), ("high",)], "bucket string")
    nan = F.lit(float("nan"))
    return names.join(got, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("hr1", nan).alias("hr1"), F.coalesce("mrr", nan).alias("mrr"))


def classification(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Accuracy, micro and macro F1 in one row, from one confusion count."""
    c = df.groupBy(F.col(label).alias("y"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = c.select(F.explode(F.array(F.struct(F.col("y").alias("c"), F.lit(1).alias("t"), F.lit(0).alias("f")), F.struct(F.col("p").alias("c"), F.lit(0).alias("t"), F.lit(1).alias("f")))).alias("s"), "n", (F.col("y") == F.col("p")).alias("hit"))
    per = sides.groupBy("s.c").agg(F.sum(F.col("n") * F.col("s.t")).alias("support"), F.sum(F.col("n") * F.col("s.f")).alias("called"), F.sum(F.when(F.col("hit"), F.col("n") * F.col("s.t")).otherwise(0)).alias("tp"))
    f1 = 2 * F.col("tp") / F.nullif(F.col("support") + F.col("called"), F.lit(0))
    acc = F.sum("tp") / F.sum("support")
    return per.agg(acc.alias("accuracy"), acc.alias("f1_micro"), F.avg(F.coalesce(f1, F.lit(0.0))).alias("f1_macro"))


def histogram_share(df: DataFrame, by: list[str], column: str, threshold: float) -> DataFrame:
    """Rows above and below a threshold per group, and their share of all rows."""
    g = df.groupBy(*by, (F.col(column) >= threshold).alias("above")).agg(F.count(F.lit(1)).alias("n"))
    total = df.count()
    return g.withColumn("share", F.col("n") / F.lit(total))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
