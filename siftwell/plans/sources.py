"""Queries over sources, the store and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siftwell.plans.registry import query, stream, table
from siftwell.sources.readers import read_dataset
from siftwell.streaming import queues


@query("SELECT doc_id, text FROM documents")
def s06_parquet_scan(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").drop("lang", "source", "n_chars", "not there")


@query("SELECT * FROM (VALUES ('demo-1', 1), ('demo-2', 1), ('demo-3', 2)) t(chunk_id, n)")
def s14_demo(spark, d):
    return read_dataset(spark, "demo").select("chunk_id", F.size("queries").alias("n"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS version FROM documents")
def s21_upsert(spark, d):
    """Upsert as a plan: new rows take the place of old ones with the same id."""
    old = table(spark, d, "documents").select("doc_id", F.lit("old").alias("version"))
    new = old.where("doc_id % 3 = 0").withColumn("version", F.lit("new"))
    return old.join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new)


@query("SELECT doc_id, lang FROM documents WHERE lang = 'de' AND n_chars > 100")
def s23_filtered_scan(spark, d):
    from siftwell.operators.filters import apply_filter

    f = {"operator": "AND", "conditions": [{"field": "lang", "operator": "==", "value": "de"}, {"field": "n_chars", "operator": ">", "value": 100}]}
    return apply_filter(table(spark, d, "documents"), f).select("doc_id", "lang")


@query("SELECT conv_id, turn, text AS message, role FROM conversations")
def s12_message_round_trip(spark, d):
    c = table(spark, d, "conversations")
    m = c.select("conv_id", "turn", queues.from_message(queues.to_message(F.col("text"), role=F.col("role"))).alias("m"))
    return m.select("conv_id", "turn", "m.message", F.col("m.metadata")["role"].alias("role"))


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n FROM events GROUP BY ALL")
def d01_streamed_counts(spark, d):
    """A stream over the events' folder, drained once into memory, equals the batch count."""
    name = f"counts_{uuid.uuid4().hex}"
    counts = stream(spark, d, "events").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    q = counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select("event_type", F.col("window.start").cast("timestamp").alias("day"), "n")
