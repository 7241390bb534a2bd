"""Message streams: JSON messages in and out, bounded state, slow calls with time limits."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = "message string, metadata map<string,string>"


def to_message(message: Column, **meta: Column) -> Column:
    """JSON ``{"message": ..., **meta}``."""
    return F.to_json(F.struct(message.alias("message"), *(v.alias(k) for k, v in meta.items())))


def from_message(body: Column) -> Column:
    """Struct ``(message, metadata)`` of a JSON body: all other keys are metadata."""
    m = F.from_json(body, "map<string,string>")
    return F.struct(m["message"].alias("message"), F.map_filter(m, lambda k, _: k != "message").alias("metadata"))


def consume(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Messages from text files that arrive in a folder: one JSON body per line, exactly once by checkpoint."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(folder).select(from_message(F.col("value")).alias("m")).select("m.*")


def publish(df: DataFrame, folder: str, checkpoint: str, body: Column):
    """A started query that appends JSON bodies; what is there is published, then it ends."""
    return df.select(body.alias("value")).writeStream.format("text").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_last(spark: SparkSession, path: str, order: str, size: int, warm_up: int = 0) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: bounded memory of the ``size`` newest rows, a no-op before batch ``warm_up``.

    Each batch reads the version before it, so that a repeated batch gives the same version.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        if batch_id < warm_up:
            return
        whole = batch
        if batch_id > warm_up:
            whole = spark.read.parquet(f"{path}/v{batch_id - 1}").unionByName(batch)
        whole.orderBy(F.col(order).desc()).limit(size).write.mode("overwrite").parquet(f"{path}/v{batch_id}")

    return run


def with_retries(call: Callable[[str], str], attempts: int = 3, first_wait: float = 0.1) -> Callable[[str], str]:
    """Retry with exponentially growing waits."""

    def run(x: str) -> str:
        for i in range(attempts):
            try:
                return call(x)
            except Exception:
                if i == attempts - 1:
                    raise
                time.sleep(first_wait * 2**i)
        raise AssertionError

    return run


def mapped(df: DataFrame, call: Callable[[str], str], column: str, key: str = "id", threads: int = 8, timeout: float = 30.0) -> DataFrame:
    """Call a slow function per row, ``threads`` at a time in each task; late or failed calls give rows with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A late call's thread is left behind: leaving a ``with`` block would wait for it.
        pool = ThreadPoolExecutor(threads)
        try:
            for pdf in batches:
                jobs = [pool.submit(call, x) for x in pdf[column]]
                rows = []
                for k, j in zip(pdf[key], jobs, strict=True):
                    try:
                        rows.append((k, j.result(timeout), None))
                    except Late:
                        rows.append((k, None, "timeout"))
                    except Exception as e:  # noqa: BLE001
                        rows.append((k, None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=["id", "text", "error"])
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    kind = dict(df.dtypes)[key]
    return df.select(key, column).mapInPandas(run, f"id {kind}, text string, error string")


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Extension: events per type and window with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
