"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component is its least node.

    Nulls and self-loops link nothing and are left out. Each step groups by a node with
    map-side minima and joins the minima back, so that a star with very many leaves is
    split like any skewed join; no neighbourhood is ever gathered in one row. Each
    round is written to shared storage.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).distinct()
    e = scratch.save(e, f"{name}_0")
    last, i = None, 0
    while True:
        sig = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
        if tuple(sig) == last or sig["n"] == 0:
            break
        last = tuple(sig)
        # large star: every larger neighbour of u points at the least of u and its neighbours
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("mv")).select("u", F.least("u", "mv").alias("m"))
        large = both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # edges to the least neighbour itself are kept, so that nothing is disconnected
        large = large.union(m.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        # small star: smaller neighbours of u, and u, point at the least of them
        m2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m2, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
        )).alias("s")).select("s.u", "s.v").where("u <> v").distinct()
        i += 1
        e = scratch.save(small, f"{name}_{i}")
        scratch.drop(f"{name}_{i - 1}")
    members = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
