"""Folders that the driver and all executors share, on any file system that Hadoop reads."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

#: Used only in local mode and where the session names no ``spark.checkpoint.dir``, as in tests on one machine.
LOCAL_DIR = "/tmp/siftwell"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; without one any master but a local one is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (base or LOCAL_DIR).rstrip("/")


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)
