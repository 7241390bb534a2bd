"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length per source. Whole passes over a source come first;
the rest of its target is fitted on the length counts: a proportional draw for most of it
and a bounded-knapsack dynamic programme for the remaining budget. Documents are then
selected by seeded order within each length.

Defined cases: null text has size 0 and takes 0; a null source is a source of its own, last
in order; an empty table gives an empty result; repeated rows count as rows of their own; of documents of equal length
a seeded hash of their keys chooses, which depend on (id, text, source) alone, so reruns agree however rows are partitioned;
a very long text is taken if its source's target has room for it. Columns of any name pass through unchanged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.llm.common import Scratch, boxed, keyed, n_words

#: Words of each source's target that the dynamic programme fits exactly.
DP_WORDS = 4096
#: Documents of one source and length that one task orders at most, on average.
ORDERED_AT_ONCE = 256


def targets(totals: DataFrame, weights: tuple[float, ...], share: float, most: float, scratch: Scratch) -> DataFrame:
    """``s, source_size, target`` of ``totals(s, source_size)``: shares by weight, none above ``most`` times its size.

    Sources in the order of ``s`` weigh ``weights`` in turn. What capped sources can't take is shared anew by
    weight among the others, until no other reaches its cap. Each turn is one aggregate of sums over all sources.
    """
    order = keyed(totals, scratch, "s", "n_th")
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("n_th") % len(weights) + 1).cast("int"))
    all_ = scratch.save(order.select("s", "source_size", w.alias("w")), "mix_sources")
    cap = F.lit(float(most)) * F.col("source_size")
    whole = share * float(all_.agg(F.sum("source_size")).first()[0] or 0)
    fair, capped, last = F.lit(0.0), F.lit(False), -1
    while True:
        s = all_.agg(F.sum(F.when(capped, F.col("source_size"))).alias("size"), F.sum(F.when(~capped, F.col("w"))).alias("w"), F.count_if(capped).alias("n")).first()
        if s["n"] == last or not s["w"]:
            break
        last = s["n"]
        left = whole - most * float(s["size"] or 0)
        fair = F.lit(left) * F.col("w") / F.lit(s["w"])
        capped = fair > cap
    return all_.select("s", "source_size", F.when(capped, cap).otherwise(fair).alias("target"))


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, dp_words: int = DP_WORDS) -> np.ndarray:
    """How many documents of each length to take so that their words come nearest below ``budget``."""
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return take
    if budget >= total:
        return counts.astype(np.int64)
    share = max(0, budget - dp_words) / total
    carry, order = 0.0, np.argsort(-lengths, kind="stable")
    for i in order:
        n = int(lengths[i])
        if n == 0:
            continue
        carry += float(counts[i]) * n * share
        take[i] = min(int(counts[i]), int(carry // n))
        carry -= float(take[i]) * n
    rest = budget - int((take * lengths).sum())
    reach, steps = 1, []
    keep = (1 << (rest + 1)) - 1
    for i in order:
        n, free = int(lengths[i]), int(counts[i] - take[i])
        if n == 0 or n > rest or not free:
            continue
        free, k = min(free, rest // n), 1
        while free > 0:
            k = min(k, free)
            steps.append((i, k, reach))
            reach |= (reach << (n * k)) & keep
            free, k = free - k, k * 2
        if reach >> rest & 1:
            break
    got = reach.bit_length() - 1
    for i, k, before in reversed(steps):
        if not before >> got & 1:
            take[i] += k
            got -= int(lengths[i]) * k
    return take


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    target, most = float(pdf["target"].iloc[0]), int(pdf["most"].iloc[0])
    lengths, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    total, want = int((lengths * counts).sum()), int(round(target))
    passes = min(most, want // total) if total else 0
    rest = want - passes * total if passes < most else 0
    return pdf[["s", "size", "n", "source_size", "target"]].assign(passes=passes, x=fit_counts(lengths, counts, rest))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most: int = 3, seed: int = 42, scratch: Scratch | None = None) -> DataFrame:
    """All rows with ``size``, ``source_size``, ``target`` and ``taken`` words.

    A source is planned in one task from its length counts: as many rows as it has distinct lengths.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    base = keyed(docs.select("doc_id", "text", "source"), scratch).select(
        "_k", "doc_id", "source", n_words(F.col("text")).alias("size"),
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t")).alias("s"),  # a null source sorts last
    )
    base = scratch.save(base, "mix_base")
    hist = scratch.save(base.groupBy("s", "size").agg(F.count(F.lit(1)).alias("n")), "mix_lengths")
    goals = targets(hist.groupBy("s").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most, scratch)
    plan = hist.join(goals, "s").withColumn("most", F.lit(most)).groupBy("s").applyInPandas(
        _plan, "s string, size long, n long, source_size long, target double, passes long, x long"
    )
    plan = scratch.save(plan, "mix_plan")
    # Seeded order within a length, in buckets so that a length that very many documents share is split.
    d = base.join(plan, ["s", "size"]).withColumn("h", F.xxhash64(F.lit(seed), "_k")).withColumn(
        "b", F.pmod(F.shiftright("h", 20), F.ceil(F.col("n") / F.lit(ORDERED_AT_ONCE)))
    )
    counts = d.where("x > 0 and x < n").groupBy("s", "size", "b").agg(F.count(F.lit(1)).alias("c"))
    before = counts.withColumn("before", F.sum("c").over(Window.partitionBy("s", "size").orderBy("b")) - F.col("c")).drop("c")
    part = d.where("x > 0 and x < n").join(before, ["s", "size", "b"]).withColumn(
        "rn", F.col("before") + F.row_number().over(Window.partitionBy("s", "size", "b").orderBy("h", "_k"))
    ).withColumn("extra", (F.col("rn") <= F.col("x")).cast("long"))
    whole = d.where("not (x > 0 and x < n)").withColumn("extra", (F.col("x") > 0).cast("long"))
    taken = ((F.col("passes") + F.col("extra")) * F.col("size")).alias("taken")
    cols = ["_k", "doc_id", "source", "size", "source_size", "target", taken]
    return part.select(*cols).union(whole.select(*cols))


def mixed_rows(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most: int = 3, seed: int = 42, scratch: Scratch | None = None) -> DataFrame:
    """The rows that the mix takes, with their own columns, each as often as it is taken.

    Rows of size 0 have no words to take or leave: they stay once.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    base = keyed(boxed(docs, "doc_id"), scratch)
    taken = mix(base.select(F.col("_k").alias("doc_id"), F.col("_row.text").alias("text"), F.col("_row.source").alias("source")), weights, share, most, seed, scratch)
    times = F.when(F.col("size") == 0, 1).otherwise((F.col("taken") / F.col("size")).cast("int"))
    taken = scratch.save(taken.select(F.col("doc_id").alias("_k"), times.alias("times")), "mix_taken")
    out = base.join(taken.where("times > 0").hint("merge"), "_k")  # texts are dealt out by key at any size
    out = out.select("_row", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return out.select(*(F.col("_row").getField(x).alias(x) for x in docs.columns))
