"""Joins, ordered groups, windows and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lookup(requests: DataFrame, docs: DataFrame, ids: str = "ids", key: str = "id") -> DataFrame:
    """Documents of each request's id list; misses are dropped, ``pos`` keeps the order asked for."""
    r = requests.select("request_id", F.posexplode(ids).alias("pos", key))
    return r.join(docs, key)


def first_per(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def last_rows(df: DataFrame, n: int, order: str) -> DataFrame:
    """The ``n`` rows of the highest sequence numbers: a top-n, not a full sort."""
    return df.orderBy(F.col(order).desc()).limit(n)


def moving_average(df: DataFrame, value: str, order: str, width: int, by: list[str]) -> DataFrame:
    """Mean over the centred frame of ``width // 2`` rows on both sides."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(width // 2), width // 2)
    return df.withColumn("smooth", F.avg(value).over(w))


def linear_trend(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Least-squares line per group, from sums."""
    return df.groupBy(*by).agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"))


def polynomial(df: DataFrame, x: str, y: str, degree: int) -> list[float]:
    """Coefficients, lowest first, of the least-squares polynomial; one aggregate of power sums reaches the driver."""
    import numpy as np

    xs = F.col(x).cast("double")
    aggs = [F.sum(F.pow(xs, F.lit(float(i)))).alias(f"x{i}") for i in range(2 * degree + 1)] + [F.sum(F.col(y) * F.pow(xs, F.lit(float(i)))).alias(f"y{i}") for i in range(degree + 1)]
    r = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(*aggs).first()
    a = np.array([[r[f"x{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
    return np.linalg.solve(a, np.array([r[f"y{i}"] for i in range(degree + 1)])).tolist()


def verified_negatives(qrels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Attach to the first qrel of each query the negative of the first pair whose positive is among its qrels.

    ``qrels(qid, pid, seq)``, ``pairs(qid, pos, neg, seq)``.
    """
    ok = pairs.join(qrels.select("qid", F.col("pid").alias("pos")), ["qid", "pos"], "left_semi").groupBy("qid").agg(F.min_by("neg", "seq").alias("neg"))
    nth = F.row_number().over(Window.partitionBy("qid").orderBy("seq"))
    return qrels.withColumn("nth", nth).join(ok, "qid", "left").withColumn("neg", F.when(F.col("nth") == 1, F.col("neg"))).drop("nth")


def seeded(seed: int, *keys: str) -> Column:
    """A repeatable random order of keys: the digest of the seed and the keys, the same in any engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def selection(qrels: DataFrame, train: int, dev: int, seed: int = 42, least: int = 0) -> dict[str, DataFrame]:
    """Seeded train and dev queries without overlap, by hash order with seeds ``seed`` and ``seed + 1``."""
    q = qrels.where("relevance > 0").select("qid").distinct()
    pick = lambda df, n, s: df.orderBy(seeded(s, "qid"), "qid").limit(n)
    a = pick(q, train, seed)
    b = pick(q.join(a, "qid", "left_anti"), dev, seed + 1)
    if least and a.count() < least:
        raise ValueError(f"fewer than {least} training queries")
    return {"train": a, "dev": b}


def corpus_selection(docs: DataFrame, needed: DataFrame, size: int, seed: int = 44) -> DataFrame:
    """``pid, needed``: all needed documents that exist, once each, filled up to ``size`` with others in seeded order."""
    ids = docs.select("pid").distinct()
    have = ids.join(needed.select("pid").distinct(), "pid", "left_semi")
    rest = ids.join(needed.select("pid"), "pid", "left_anti").orderBy(seeded(seed, "pid"), "pid").limit(max(0, size - have.count()))
    return have.withColumn("needed", F.lit(True)).unionByName(rest.withColumn("needed", F.lit(False)))


def selected_titles(df: DataFrame, title: str, titles: list[str] | None, max_rows: int | None, order: str) -> DataFrame:
    """Rows whose title is among those selected (None: all), at most so many, in order."""
    out = df if titles is None else df.where(F.col(title).isin(list(titles)))
    return out if max_rows is None else out.orderBy(order).limit(max(0, max_rows))


def keyword_coverage(df: DataFrame, keywords: str, content: str) -> DataFrame:
    """How many keywords there are and how many the content doesn't hold."""
    k = df.select(F.explode(keywords).alias("k"), F.col(content).alias("c"))
    return k.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.instr(F.lower("c"), F.lower("k")) == 0).alias("absent"))
