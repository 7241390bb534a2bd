"""A training-data pipeline over ``documents``: each stage calls one operator of ``siftwell.llm``.

Stages take ``(spark, docs, sf_dir)`` and return a DataFrame; all but the last return the columns of
their input. ``ORACLE_SQL`` is None: the toxicity grammar and packing have no SQL form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwell.llm import linedup, mixing, neardup, packing, toxicity
from siftwell.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"), Scratch(spark))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go, and documents that consist of such copies only."""
    return linedup.dedup_stage(docs, scratch=Scratch(spark))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return neardup.keep_first(docs, scratch=Scratch(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_rows(docs, scratch=Scratch(spark))


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin of each piece of each document."""
    return packing.pack(docs, scratch=Scratch(spark))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_neardup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_bins),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to shared storage."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
