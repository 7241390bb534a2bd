"""Sharding by extendible hashing, with DataFrame operations only.

A row's key is 60 bits of the MD5 of its id and its text's MD5. The directory starts with one
bucket; only buckets over the byte limit are split on one more bit, until every shard fits.

Defined cases: null text weighs 0 bytes and a null id counts as empty text; a single row over
the limit, however long, is a shard of its own; rows that share all 60 bits (repeated rows, ties) are not split
further but cut by their number into parts; an empty table gives no shard. Ids of any type do; only ``doc_id`` and
``text`` are read, whatever other columns are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import Scratch, keyed

#: Bytes of text per shard.
LIMIT = 64 << 20
BITS = 60


def shard(docs: DataFrame, limit: int = LIMIT, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, n_bytes, depth, prefix, part, shard_bytes`` per row of ``docs(doc_id, text)``.

    The sums of cells and buckets are made with map-side aggregates; rows are joined to their cell's bucket. A shard is ``(depth, prefix, part)``: the rows whose keys start with the ``depth`` bits
    of ``prefix``. ``part`` is 0 but for repeated rows that one bucket can't hold.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    text_md5 = F.md5(F.coalesce("text", F.lit("")))
    rows = docs.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text_md5)), 1, 15), 16, 10).cast("long").alias("key"),
    )
    rows = scratch.save(rows, "rows")
    total = rows.agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n")).first()
    # Cells fine enough that few buckets need finer bits; cells are sums, not rows.
    fine = min(BITS, max(4, ((total["b"] or 0) // limit).bit_length() + 4))
    cells = scratch.save(
        rows.groupBy(F.shiftright("key", BITS - fine).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")), "cells"
    )
    # ``placed`` has the leaf of each cell; ``deep`` the rows of cells that need finer bits, leaf by leaf.
    placed, deep, todo, depth = None, None, cells, 0
    while True:
        bits, unit, b, n, low, high = (fine, "cell", F.sum("b"), F.sum("n"), "low", "high") if depth <= fine else (BITS, "key", F.sum("n_bytes"), F.count(F.lit(1)), "key", "key")
        todo = todo.withColumn("prefix", F.shiftright(unit, bits - depth))
        here = scratch.save(todo.groupBy("prefix").agg(b.alias("bytes"), n.alias("rows"), (F.min(low) == F.max(high)).alias("same")), f"depth_{depth}")
        done = (F.col("bytes") <= limit) | (F.col("rows") <= 1) | F.col("same")
        leaf = todo.join(here.where(done).drop("rows", "same"), "prefix").withColumn("depth", F.lit(depth))
        if depth <= fine:
            leaf = leaf.select("cell", "depth", "prefix", "bytes")
            placed = leaf if placed is None else placed.union(leaf)
        else:
            leaf = leaf.select("doc_id", "n_bytes", "key", "depth", "prefix", "bytes")
            deep = leaf if deep is None else deep.union(leaf)
        if here.where(~done).isEmpty():
            break
        todo = todo.join(here.where(~done).select("prefix"), "prefix", "left_semi").drop("prefix")
        if depth == fine:
            todo = rows.withColumn("cell", F.shiftright("key", BITS - fine)).join(todo.select("cell"), "cell", "left_semi").drop("cell")
        depth += 1
    directory = scratch.save(placed, "directory")
    out = rows.withColumn("cell", F.shiftright("key", BITS - fine)).join(directory, "cell").select("doc_id", "n_bytes", "key", "depth", "prefix", "bytes")
    if deep is not None:
        out = out.union(deep)
    fits = F.col("bytes") <= limit
    one = out.where(fits).select("doc_id", "n_bytes", "depth", "prefix", F.lit(0).cast("long").alias("part"), F.col("bytes").alias("shard_bytes"))
    # Equal rows only: so many fit a part, in any order. They are numbered in all tasks at once: a range of a very common key is split by ``salt``.
    same = keyed(out.where(~fits).select("key", "doc_id", "n_bytes", "depth", "prefix", F.rand(7).alias("salt")), scratch, "key")
    group = same.groupBy("key").agg(F.min("_k").alias("start"), F.count(F.lit(1)).alias("rows"), F.max(F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("n_bytes")))).alias("fit"))
    same = same.join(group, "key").withColumn("part", F.floor((F.col("_k") - F.col("start")) / F.col("fit")))
    held = F.least(F.col("fit"), F.col("rows") - F.col("part") * F.col("fit"))
    return one.union(same.select("doc_id", "n_bytes", "depth", "prefix", "part", (held * F.col("n_bytes")).alias("shard_bytes")))
