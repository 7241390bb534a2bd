"""Geometry of embeddings: norms, similarities, alignment, uniformity, spectrum."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.vectors import dot, norm


def norms(df: DataFrame, column: str = "v") -> DataFrame:
    n = norm(F.col(column))
    return df.agg(F.avg(n).alias("norm_mean"), F.stddev_pop(n).alias("norm_std"))


def batch_similarities(left: DataFrame, right: DataFrame) -> DataFrame:
    """``batch, i, j, s`` from ``(batch, i, v)`` on both sides: a join on the batch, whose size is bounded."""
    a = left.select("batch", "i", F.col("v").alias("va"))
    b = right.select("batch", F.col("i").alias("j"), F.col("v").alias("vb"))
    return a.join(b, "batch").select("batch", "i", "j", dot(F.col("va"), F.col("vb")).alias("s"))


def similarity_panel(scores: DataFrame) -> DataFrame:
    """Positive (diagonal) and negative similarities, their gap, and alignment 2 - 2 * mean(positive)."""
    pos, neg = F.when(F.col("i") == F.col("j"), F.col("s")), F.when(F.col("i") != F.col("j"), F.col("s"))
    return scores.agg(
        F.avg(pos).alias("pos_mean"), F.stddev_pop(pos).alias("pos_std"), F.avg(neg).alias("neg_mean"), F.stddev_pop(neg).alias("neg_std"),
        F.max(neg).alias("neg_max"), (F.avg(pos) - F.avg(neg)).alias("gap"), (2 - 2 * F.avg(pos)).alias("alignment"),
    )


def uniformity(scores: DataFrame) -> DataFrame:
    """``ln mean exp(-2 |x - y|^2)`` over pairs of different rows of unit vectors, per batch; NaN with one row."""
    d2 = 2 - 2 * F.col("s")
    mean = F.avg(F.when(F.col("i") != F.col("j"), F.exp(-2 * d2)))
    return scores.groupBy("batch").agg(F.coalesce(F.log(mean), F.lit(float("nan"))).alias("uniformity"))


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    n, s, g = 0, None, None
    for pdf in batches:
        if len(pdf):
            x = np.stack(pdf["v"].to_numpy()).astype(float)
            n += len(x)
            s = x.sum(axis=0) if s is None else s + x.sum(axis=0)
            g = x.T @ x if g is None else g + x.T @ x
    if n:
        yield pd.DataFrame({"n": [n], "s": [s], "g": [g.ravel()]})


def spectrum(df: DataFrame, column: str = "v") -> DataFrame:
    """Effective rank ``exp(H(s / sum s))`` and anisotropy ``s1^2 / sum s^2`` of the centred matrix's singular values.

    Each partition sends its moments, one row of d + d * d numbers; a d by d matrix is decomposed on the driver.
    """
    spark = df.sparkSession
    total = None
    for r in df.select(F.col(column).alias("v")).where("v is not null").mapInPandas(_moments, "n long, s array<double>, g array<double>").toLocalIterator():
        part = (r["n"], np.array(r["s"]), np.array(r["g"]))
        total = part if total is None else tuple(a + b for a, b in zip(total, part, strict=True))
    if total is None or total[0] < 2:
        return spark.createDataFrame([(float("nan"), float("nan"))], "effective_rank double, anisotropy double")
    n, s, g = total
    cov = g.reshape(len(s), len(s)) - np.outer(s, s) / n
    sv = np.sqrt(np.clip(np.linalg.eigvalsh(cov), 0, None))
    p = sv / sv.sum() if sv.sum() else sv
    p = p[p > 0]
    rank = float(np.exp(-(p * np.log(p)).sum())) if len(p) else float("nan")
    aniso = float(sv.max() ** 2 / (sv**2).sum()) if (sv**2).sum() else float("nan")
    return spark.createDataFrame([(rank, aniso)], "effective_rank double, anisotropy double")


def temperatures(tau: float) -> dict[str, float]:
    return {"Tau": tau, "InvTau": 1 / tau, "LogTau": float(np.log(tau))}
