"""Line dedup by a suffix array over line-id sequences, with DataFrame operations only.

Non-blank lines of all documents are sequences of line ids. Distributed prefix doubling ranks
the suffixes by their first 1, 2, 4, ... lines, among positions whose prefix repeats; it stops
once prefixes of ``min_lines`` lines are ranked, which are the intervals whose longest common
prefix reaches the threshold: deeper ranks would order suffixes within these intervals, but
delete nothing more. In each interval all suffixes but the first (least document,
then line) start a repeated run; overlapping runs join into maximal ones and are deleted.

Groups of equal prefixes are counted with map-side sums and minima; their ranks and first members
are written before they are joined back, so that a join can split the rows of a very common prefix.

Defined cases: null text stays null with 0 lines; blank lines neither match nor go; an empty table gives none;
documents under ``min_lines`` lines lose nothing, unless ``min_words`` lets shorter runs of so many words
count too, down to one line, as in the pipeline; repeated rows are documents of their own,
the later ones lose their lines; runs may overlap within one document; of ties the row stays whose
document id, then text, then other columns come first. Very long texts take time in proportion to their lines.
Columns of any name pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import WS, Scratch, boxed, keyed, n_words

MIN_LINES = 3
#: In the pipeline, shorter runs of so many words count as well.
MIN_WORDS = 50

BLANK = rf"^{WS}*\z"


def _intervals(at: DataFrame, by: list[str], scratch: Scratch, name: str) -> DataFrame:
    """``by``, ``r`` and ``first`` of each prefix that occurs again: ``r`` sorts as ``by`` does (ids of a range-partitioned sort), ``first`` is the first suffix."""
    parts = max(1, int(at.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    again = at.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_k", "s")).alias("first")).where("n > 1").drop("n")
    order = again.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    return scratch.save(order.withColumn("rank", F.monotonically_increasing_id()), name)


def _ranked(at: DataFrame, by: list[str], scratch: Scratch, h: int, *cols: Column) -> DataFrame:
    """``_k, s, r, later`` and ``cols`` of the suffixes whose prefix of ``h`` lines occurs again."""
    out = at.join(_intervals(at, by, scratch, f"rank_{h}"), by)
    later = (F.col("first._k") != F.col("_k")) | (F.col("first.s") != F.col("s"))
    return scratch.save(out.select("_k", "s", F.col("rank").alias("r"), later.alias("later"), *cols), f"at_{h}")


def later_runs(docs: DataFrame, min_lines: int, scratch: Scratch, min_words: int | None = None) -> DataFrame:
    """``_k, runs``: places ``(s, n)`` of runs of ``docs(_k, text)`` that repeat an earlier one; ``s`` counts non-blank lines.

    With ``min_words``, prefixes grow line by line, so that runs of each length under ``min_lines`` are seen.
    """
    count = min_words is not None
    rows = F.filter(
        F.transform(F.split("text", "\n"), lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit("line"), x).alias("h2"), *([n_words(x).alias("w")] if count else []), x.rlike(BLANK).alias("blank"))),
        lambda x: ~x["blank"],
    )
    lines = docs.where("text is not null").select("_k", F.posexplode(rows).alias("s", "x")).select("_k", "s", "x.h1", "x.h2", *(["x.w"] if count else []))
    lines = scratch.save(lines, "lines")
    # Words of the run and of its last line go along where they count.
    at = _ranked(lines, ["h1", "h2"], scratch, 1, *([F.col("w"), F.col("w").alias("last")] if count else []))
    scratch.drop("lines", "rank_1")
    h, found = 1, []
    while h < min_lines:
        if count:
            found.append(at.where(F.col("later") & (F.col("w") >= min_words)).select("_k", "s", F.lit(h).alias("n")))
        step = 1 if count else min(h, min_lines - h)
        nxt = at.select("_k", (F.col("s") - step).alias("s"), F.col("r").alias("r2"), *([F.col("last").alias("last2")] if count else []))
        pairs = scratch.save(at.join(nxt, ["_k", "s"]), f"pairs_{h}")
        h += step
        at = _ranked(pairs, ["r", "r2"], scratch, h, *([(F.col("w") + F.col("last2")).alias("w"), F.col("last2").alias("last")] if count else []))
        scratch.drop(f"pairs_{h - step}", f"rank_{h}", *([] if count else [f"at_{h - step}"]))
    runs = at.where("later").select("_k", "s", F.lit(min_lines).alias("n"))
    for more in found:
        runs = runs.union(more)
    # As many places as the document has lines, times lengths under min_lines, at most.
    return runs.groupBy("_k").agg(F.collect_list(F.struct("s", "n")).alias("runs"))


def _bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once: an expression put into a lambda would be computed anew for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _without(text: Column, runs: Column) -> Column:
    """``(kept, lines, removed)``: the text without the lines of ``runs``, and how many lines it had and lost."""
    covered = F.array_distinct(F.flatten(F.transform(runs, lambda x: F.sequence(x["s"], x["s"] + x["n"] - 1))))

    def cut(parts: Column) -> Column:
        full = F.filter(F.transform(parts, lambda x, i: F.when(~x.rlike(BLANK), i)), lambda i: i.isNotNull())
        gone = _bound(full, lambda ix: F.transform(covered, lambda s: F.get(ix, s)))
        kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
        return F.struct(
            F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n").alias("kept"),
            F.size(parts).cast("long").alias("lines"), F.size(covered).cast("long").alias("removed"),
        )

    return _bound(F.split(text, "\n"), cut)


def dedup(docs: DataFrame, min_lines: int = MIN_LINES, scratch: Scratch | None = None, min_words: int | None = None) -> DataFrame:
    """``_row, kept, lines, removed`` for every row of ``docs(doc_id, text, ...)``: its columns, the text without later copies, and counts of lines."""
    scratch = scratch or Scratch(docs.sparkSession)
    base = keyed(boxed(docs, "doc_id"), scratch)
    runs = later_runs(base.select("_k", F.col("_row.text").alias("text")), min_lines, scratch, min_words)
    runs = scratch.save(runs, "runs")
    scratch.drop(*(f"at_{h}" for h in range(1, min_lines + 1)))
    # Texts are dealt out by key at any size: no switch to a broadcast where few documents lose lines.
    out = base.join(runs.hint("merge"), "_k", "left")
    text = F.col("_row.text")
    cut = F.when(F.col("runs").isNotNull(), _without(text, F.col("runs"))).otherwise(
        F.struct(text.alias("kept"), F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).cast("long").alias("lines"), F.lit(0).cast("long").alias("removed"))
    )
    out = out.select("_row", cut.alias("cut"))
    lines = F.when(F.col("_row.text").isNull(), 0).otherwise(F.col("cut.lines")).cast("long")
    return out.select("_row", F.col("cut.kept").alias("kept"), lines.alias("lines"), F.col("cut.removed").alias("removed"))


def dedup_stage(docs: DataFrame, min_lines: int = MIN_LINES, scratch: Scratch | None = None, min_words: int | None = MIN_WORDS) -> DataFrame:
    """The documents with later copies of runs deleted; those of which nothing but blank lines is left go."""
    out = dedup(docs, min_lines, scratch, min_words)
    same = F.col("removed") == 0
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast(dict(docs.dtypes).get("n_chars", "long"))}
    old = lambda c: F.col("_row").getField(c)
    cols = [(F.when(same, old(c)).otherwise(new[c]) if c in new else old(c)).alias(c) for c in docs.columns]
    return out.where(same | ~F.col("kept").rlike(BLANK)).select(*cols)
