"""Shared helpers: scratch tables on shared storage, row keys, word counts."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegralType, MapType, StructType, VariantType

#: Used only in local mode and where the session names no ``spark.checkpoint.dir``, as in tests on one machine.
FALLBACK_DIR = "/tmp/checkpoints/siftwell"

#: ASCII white space: space and U+0009 to U+000D.
WS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Parquet tables under the shared checkpoint folder, one folder per use.

    Writing a table cuts lineage in a way that survives the loss of executors: what is
    reread is what was committed, never a recomputation.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = FALLBACK_DIR
        self.root = f"{base.rstrip('/')}/{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path, conf, key = f"{self.root}/{name}", self.spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(key, "false")
        # What was exchanged for a table is not read again once it is written: else it stays until the driver collects its garbage.
        conf.set(key, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            conf.set(key, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads; frees disk before the result is read."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text as a long; null counts 0."""
    t = F.coalesce(text, F.lit(""))
    # Splitting leaves an empty piece before leading and after trailing white space.
    return (
        F.size(F.split(t, WS + "+"))
        - t.rlike(rf"^({WS}|\z)").cast("int")
        - t.rlike(WS + r"\z").cast("int")
    ).cast("long")


def _orderable(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    return _orderable(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, (MapType, VariantType))


def keyed(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", key: str = "_k") -> DataFrame:
    """Add a unique, non-null long ``key`` that sorts as ``id_col`` does (nulls last).

    Where ids are integers, unique and not null the key is the id itself. Otherwise it is the row's
    rank by (id, text, all other columns), so that it depends on the rows alone, however they are
    partitioned; rows that tie are equal in all columns. ``key`` must not be a column of ``df``:
    callers pass columns of their own choice, or whole rows as by ``boxed``.
    """
    if key in df.columns:
        raise ValueError(f"column {key} is in use")
    s = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col(id_col)).alias("d")).first()
    if s["n"] == s["d"] and isinstance(df.schema[id_col].dataType, IntegralType):
        return df.withColumn(key, F.col(id_col).cast("long"))
    rest = [f.name for f in df.schema.fields if f.name not in (id_col, "text") and _orderable(f.dataType)]
    by = [F.col(id_col).asc_nulls_last(), *(F.col(f"`{c}`").asc_nulls_first() for c in (["text"] if "text" in df.columns else []) + rest)]
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranked = df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    ranked = scratch.save(ranked.withColumn(key, F.monotonically_increasing_id()), f"keyed_{uuid.uuid4().hex[:6]}")
    # The generated id holds the partition above 33 bits: one count per partition turns it into a rank.
    sizes = {r["p"]: r["n"] for r in ranked.groupBy(F.shiftright(key, 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, rows = 0, []
    for p in sorted(sizes):
        rows.append((p, before - (p << 33)))
        before += sizes[p]
    shift = F.broadcast(df.sparkSession.createDataFrame(rows, "_part long, _shift long"))  # one row per partition
    return ranked.join(shift, F.shiftright(key, 33) == F.col("_part")).withColumn(key, F.col(key) + F.col("_shift")).select(*(F.col(f"`{c}`") for c in df.columns), key)


def boxed(df: DataFrame, *names: str) -> DataFrame:
    """All columns as one struct ``_row`` beside copies of ``names``, so that columns of any name pass through an operator unchanged."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), *names)
