"""Sinks for splits, metrics, telemetry and manifests."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_splits(splits: dict[str, DataFrame], root: str) -> None:
    """One Parquet folder of one file per split: for selections that were limited before."""
    for name, df in splits.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{root}/{name}")


def portable(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]+", "_", name).strip("_")


def write_metrics(metrics: DataFrame, root: str, dataset: str) -> str:
    """``name, mean, std, dataset`` as CSV; one row per metric."""
    path = f"{root}/{portable(dataset)}"
    metrics.select("name", "mean", "std", F.lit(dataset).alias("dataset")).coalesce(1).write.mode("overwrite").csv(path, header=True)
    return path


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_telemetry(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Append rows whose columns may be new: older rows get nulls there. Returns the whole."""
    parts = sorted(p.name for p in Path(path).glob("part=*")) if Path(path).exists() else []
    rows.write.mode("overwrite").json(f"{path}/part={len(parts):06d}")
    frames = [spark.read.json(f"{path}/part={i:06d}") for i in range(len(parts) + 1)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_manifest(path: str, **fields: object) -> None:
    Path(path).write_text(json.dumps(fields, indent=2, ensure_ascii=False, sort_keys=True), encoding="utf-8")
