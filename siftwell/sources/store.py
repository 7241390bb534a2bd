"""A collection of documents as versioned Parquet folders: upsert, scan, delete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators.filters import apply_filter
from siftwell.operators.relational import first_per
from siftwell.sources import files

POLICIES = ("NONE", "SKIP", "OVERWRITE", "FAIL")


class DuplicateError(ValueError):
    pass


class Collection:
    """Versions of a table in one folder: the last one that was written to its end counts, so readers see whole versions only."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.name = spark, name[:1].upper() + name[1:].lower()
        self.path = f"{str(root).rstrip('/')}/{self.name}"

    def _folder(self, version: int) -> str:
        return f"{self.path}/v{version:06d}"

    def _version(self) -> int:
        """The highest version whose write was committed, 0 if there is none."""
        for v in sorted((int(n[1:]) for n in files.names(self.spark, self.path) if n[:1] == "v" and n[1:].isdigit()), reverse=True):
            if files.exists(self.spark, f"{self._folder(v)}/_SUCCESS"):
                return v
        return 0

    def _publish(self, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self._folder(self._version() + 1))

    def scan(self, filters: dict | None = None, vectors: bool = False) -> DataFrame | None:
        """All documents that fit the filter; the vectors are read only when asked for."""
        v = self._version()
        if not v:
            return None
        df = self.spark.read.parquet(self._folder(v))
        df = apply_filter(df, filters)
        return df if vectors else df.drop("embedding")

    def count(self, filters: dict | None = None) -> int:
        df = self.scan(filters)
        return 0 if df is None else df.count()

    def write(self, docs: DataFrame, key: str = "id", order: str | None = None, policy: str = "OVERWRITE") -> None:
        """Upsert by id: of equal ids in the input the last by ``order`` counts. NONE is as OVERWRITE."""
        if policy not in POLICIES:
            raise ValueError(f"unknown policy {policy!r}")
        new = first_per(docs, [key], F.col(order).desc()) if order else docs.dropDuplicates([key])
        old = self.scan(vectors=True)
        if old is None:
            self._publish(new)
            return
        if policy == "FAIL":
            hit = old.select(key).join(new.select(key), key, "left_semi").limit(1).collect()
            if hit:
                raise DuplicateError(f"{key} {hit[0][0]!r} is there already")
        if policy == "SKIP":
            new = new.join(old.select(key), key, "left_anti")
        else:
            old = old.join(new.select(key), key, "left_anti")
        self._publish(old.unionByName(new, allowMissingColumns=True))

    def delete(self, ids: DataFrame, key: str = "id") -> None:
        old = self.scan(vectors=True)
        if old is not None:
            self._publish(old.join(ids.select(key), key, "left_anti"))

    def clear(self) -> None:
        old = self.scan(vectors=True)
        if old is not None:
            self._publish(old.limit(0))
