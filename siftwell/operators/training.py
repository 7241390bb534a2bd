"""Training rows, negatives and forward values of losses, as plans over rows and batches."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.operators.relational import seeded


def missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a floating column."""
    c = F.col(name)
    return c.isNull() | F.isnan(c) if dict(df.dtypes)[name] in ("float", "double") else c.isNull()


def training_rows(df: DataFrame, queries: str, content: str, order: str, limit: int | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """Rows with all fields, one per query; the limit counts expanded rows."""
    for c in {queries, content, *required}:
        df = df.where(~missing(df, c))
    out = df.select("*", F.posexplode(queries).alias("query_pos", "query")).where(F.col("query").isNotNull() & (F.trim("query") != ""))
    return out if limit is None or limit < 0 else out.orderBy(order, "query_pos").limit(limit)


def reservoir(df: DataFrame, n: int, key: str, seed: int = 17) -> DataFrame:
    """``n`` rows by seeded hash order: -1 all, other values below 1 none. Repeatable at any partitioning."""
    if n == -1:
        return df
    return df.orderBy(seeded(seed, key), key).limit(max(0, n))


def repeated_samples(df: DataFrame, n: int, times: int, key: str, seed: int = 17) -> DataFrame:
    """``times`` samples of ``n`` rows each, one below the other; ``sample`` counts them from 0."""
    return reduce(DataFrame.unionByName, [reservoir(df, n, key, seed + t).withColumn("sample", F.lit(t)) for t in range(times)])


def rebalanced(df: DataFrame, content: str, order: str) -> DataFrame:
    """Rows in rounds: the first of each content, then the second, ...; ``level`` and ``first`` are the order keys."""
    w = Window.partitionBy(content)
    return df.withColumn("level", F.row_number().over(w.orderBy(order)) - 1).withColumn("first", F.min(order).over(w))


def duplicate_batches(df: DataFrame, position: str, content: str, batch_size: int) -> DataFrame:
    """How many batches of consecutive positions hold a content twice."""
    b = df.groupBy(F.floor(F.col(position) / batch_size).alias("batch")).agg(F.count(content).alias("n"), F.count_distinct(content).alias("d"))
    return b.agg(F.sum((F.col("n") > F.col("d")).cast("long")).alias("batches"))


def derangement(df: DataFrame, batch: str, key: str, seed: int = 17) -> DataFrame:
    """Partner of each row within its batch: the next in seeded order, the last one's is the first. Nobody is its own but in a batch of one."""
    w = Window.partitionBy(batch).orderBy(seeded(seed, key), key)
    return df.withColumn("partner", F.coalesce(F.lead(key).over(w), F.first(key).over(w)))


KEYS = ("doc_key", "content_key", "query_key")


def safe_negatives(df: DataFrame, seed: int = 17) -> DataFrame:
    """A negative per row of ``(batch, i, doc_key, content_key, query_key)`` that shares no key with it.

    Rows without one fall back to any other row of the batch, then to themselves; ``fallback`` tells.
    """
    left = df.select("batch", "i", *KEYS)
    right = df.select("batch", F.col("i").alias("j"), *(F.col(k).alias("o_" + k) for k in KEYS))
    clash = F.lit(False)
    for k in KEYS:
        clash = clash | (F.col(k) == F.col("o_" + k))
    tier = F.when(F.col("i") == F.col("j"), 2).when(clash, 1).otherwise(0)
    pairs = left.join(right, "batch").withColumn("tier", tier).withColumn("h", seeded(seed, "i", "j"))
    return pairs.groupBy("batch", "i").agg(F.min(F.struct("tier", "h", "j")).alias("m")).select("batch", "i", F.col("m.j").alias("negative"), (F.col("m.tier") > 0).alias("fallback"))


def scored_negatives(scores: DataFrame, mode: str = "hard", low: float = 0.0, high: float = 1.0, k: int = 1) -> DataFrame:
    """The ``k`` best-scored (or, for ``semi-hard``, those within bounds) off-diagonal columns of each row of ``(batch, i, j, s)``."""
    ok = (F.col("i") != F.col("j")) & ((F.col("s") >= low) & (F.col("s") <= high) if mode != "hard" else F.lit(True))
    w = Window.partitionBy("batch", "i").orderBy(F.col("s").desc(), "j")
    return scores.where(ok).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def idf_negatives(
    df: DataFrame, score: Callable[[Column, Column], Column], mode: str = "safe-random", low: float | None = None, high: float | None = None, k: int | None = None, seed: int = 17
) -> DataFrame:
    """A negative per row of ``(batch, i, doc_key, content_key, query_key, query, doc)``, chosen by ``score(query, doc)``.

    Candidates share no key; else they share the query only; else they are any other row (``fallback``), else the row
    itself. Those scored above ``high`` are too near and left out, unless none would remain. ``safe-random`` takes any of
    the rest, ``semi-hard-idf`` and ``hard-idf`` one of the ``k`` best, and of those that reach ``low`` if there are any.
    """
    if mode not in ("safe-random", "semi-hard-idf", "hard-idf"):
        raise ValueError(f"unknown mode {mode!r}")
    other = df.select("batch", F.col("i").alias("j"), *(F.col(c).alias("o_" + c) for c in KEYS), F.col("doc").alias("o_doc"))
    same = {c: F.coalesce(F.col(c) == F.col("o_" + c), F.lit(False)) for c in KEYS}
    tier = F.when(same["doc_key"] | same["content_key"], 2).when(same["query_key"], 1).otherwise(0)
    w = Window.partitionBy("batch", "i")
    pairs = df.join(other, "batch").where("i <> j").withColumn("tier", tier).withColumn("least", F.min("tier").over(w)).where("tier = least")
    p = pairs.select("batch", "i", "j", "tier", score(F.col("query"), F.col("o_doc")).alias("s"))
    p = p.withColumn("safe", F.lit(True) if high is None else F.col("s") <= high)
    p = p.withColumn("good", F.col("safe") & (F.lit(True) if low is None or mode == "safe-random" else F.col("s") >= low))
    p = p.withColumn("any_safe", F.max("safe").over(w)).withColumn("any_good", F.max("good").over(w))
    p = p.where(F.when(F.col("any_good"), F.col("good")).when(F.col("any_safe"), F.col("safe")).otherwise(True))
    if k is not None and mode != "safe-random":
        p = p.withColumn("nth", F.row_number().over(w.orderBy(F.col("s").desc(), "j"))).where(~F.col("any_safe") | (F.col("nth") <= k))
    best = p.groupBy("batch", "i").agg(F.min(F.struct(seeded(seed, "batch", "i", "j").alias("h"), "j", "tier")).alias("m"))
    out = df.select("batch", "i").join(best, ["batch", "i"], "left")
    return out.select("batch", "i", F.coalesce("m.j", "i").alias("negative"), F.coalesce(F.col("m.tier") == 2, F.lit(True)).alias("fallback"))


def bank_identities(rows: DataFrame, bank: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``batch, i, slot, match`` for the rows of a batch and its bank: a slot matches that has any of the row's keys.

    Keys that the bank lacks don't count; with a key that only the rows lack nothing is known to differ, so all match.
    """
    used = [c for c in keys if c in bank.columns]
    pairs = rows.join(bank.select("batch", "slot", *(F.col(c).alias("b_" + c) for c in used)), "batch")
    known = all(c in rows.columns for c in used)
    match = reduce(lambda a, b: a | b, (F.coalesce(F.col(c) == F.col("b_" + c), F.lit(False)) for c in used), F.lit(False)) if known else F.lit(True)
    return pairs.select("batch", "i", "slot", match.alias("match"))


def logsumexp(c: Column, top: Column) -> Column:
    return F.log(F.sum(F.exp(c - top))) + F.max(top)


def info_nce(scores: DataFrame, tau: float, decoupled: bool = False) -> DataFrame:
    """Row losses from cosines ``(batch, i, j, s)``: ``-s_ii / tau + ln sum exp(s_ij / tau)``; decoupled leaves the positive out of the sum, 0 without negatives."""
    z = scores.select("batch", "i", "j", (F.col("s") / tau).alias("z"))
    z = z.withColumn("top", F.max("z").over(Window.partitionBy("batch", "i")))
    pos = F.max(F.when(F.col("i") == F.col("j"), F.col("z")))
    term = F.exp(F.col("z") - F.col("top"))
    total = F.sum(F.when(F.col("i") != F.col("j"), term)) if decoupled else F.sum(term)
    loss = F.coalesce(-pos + F.max("top") + F.log(total), F.lit(0.0))
    return z.groupBy("batch", "i").agg(loss.alias("loss"))


def info_nce_with_bank(scores: DataFrame, bank: DataFrame, tau: float) -> DataFrame:
    """Row losses whose sum also holds bank negatives ``(batch, i, s, weight)``, each times its weight."""
    z = scores.select("batch", "i", (F.col("s") / tau).alias("z"), (F.col("i") == F.col("j")).alias("pos"))
    m = bank.where("weight > 0").select("batch", "i", (F.col("s") / tau + F.log("weight")).alias("z"), F.lit(False).alias("pos"))
    a = z.union(m).withColumn("top", F.max("z").over(Window.partitionBy("batch", "i")))
    return a.groupBy("batch", "i").agg((F.max("top") + F.log(F.sum(F.exp(F.col("z") - F.col("top")))) - F.max(F.when(F.col("pos"), F.col("z")))).alias("loss"))


def bank_selection(bank: DataFrame, mode: str = "mixed", hard: int = 12, random: int = 12, seed: int = 17) -> DataFrame:
    """Negatives of a bank ``(batch, i, slot, s, match)`` per row: all, the hardest, random ones, or both; identity matches never."""
    ok = bank.where(~F.col("match"))
    w = Window.partitionBy("batch", "i")
    h = ok.withColumn("hard", F.row_number().over(w.orderBy(F.col("s").desc(), "slot")) <= hard)
    h = h.withColumn("random", F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), "batch", "i", "slot"), "slot")) <= random)
    keep = {"all": F.lit(True), "hard": F.col("hard"), "random": F.col("random"), "mixed": F.col("hard") | F.col("random")}[mode]
    return h.where(keep)


def mass_weight(selected: DataFrame, batch_size: int, ratio: float) -> DataFrame:
    """Weight of each selected bank negative, so that a row's weigh ``ratio * (N - 1)`` together."""
    return selected.withColumn("weight", F.lit(ratio * (batch_size - 1)) / F.count(F.lit(1)).over(Window.partitionBy("batch", "i")))


def warm_up(step: int, steps: int) -> float:
    """0 before, then a ramp to 1 over as many steps again."""
    return 0.0 if step < steps else min(1.0, (step - steps + 1) / max(1, steps))


def collision_weight(bank: DataFrame, positive: DataFrame, threshold: float, beta: float) -> DataFrame:
    """``sigmoid((threshold - g) / beta)`` with ``g`` the best bank similarity less the positive's."""
    g = bank.groupBy("batch", "i").agg(F.max("s").alias("top")).join(positive.select("batch", "i", F.col("s").alias("pos")), ["batch", "i"])
    gap = F.col("top") - F.col("pos")
    return g.select("batch", "i", gap.alias("g"), (1 / (1 + F.exp(-(threshold - gap) / beta))).alias("weight"))


def soft_false_negatives(scores: DataFrame, k: int) -> DataFrame:
    """Mean of the ``k`` largest off-diagonal similarities of each row."""
    w = Window.partitionBy("batch", "i").orderBy(F.col("s").desc(), "j")
    return scores.where("i <> j").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy("batch", "i").agg(F.avg("s").alias("soft_fn"))


def confidence(scores: DataFrame, tau: float = 1.0) -> DataFrame:
    """Softmax weight of the diagonal in each row."""
    w = Window.partitionBy("batch", "i")
    e = scores.withColumn("e", F.exp(F.col("s") / tau - F.max(F.col("s") / tau).over(w)))
    return e.groupBy("batch", "i").agg((F.max(F.when(F.col("i") == F.col("j"), F.col("e"))) / F.sum("e")).alias("confidence"))


def neighbourhood_kl(student: DataFrame, teacher: DataFrame, tau: float) -> DataFrame:
    """``KL(teacher || student)`` and the teacher's entropy per row of anchor similarities ``(i, j, s)``."""

    def soft(df: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy("i")
        e = df.select("i", "j", F.exp(F.col("s") / tau - F.max(F.col("s") / tau).over(w)).alias("e"))
        return e.select("i", "j", (F.col("e") / F.sum("e").over(w)).alias(name))

    p = soft(teacher, "p").join(soft(student, "q"), ["i", "j"])
    return p.groupBy("i").agg(F.sum(F.col("p") * (F.log("p") - F.log("q"))).alias("kl"), (-F.sum(F.col("p") * F.log("p"))).alias("entropy"))


def soft_contrastive(d: Column, y: Column, margin: float = 1.0) -> Column:
    """``y d^2 + (1 - y) max(0, margin - d)^2``, halved."""
    return (y * d * d + (1 - y) * F.pow(F.greatest(F.lit(0.0), margin - d), F.lit(2))) / 2


def triplet(scores: DataFrame, margin: float = 0.2) -> DataFrame:
    """Hardest-positive, hardest-negative loss per row of distances ``(batch, i, j, d, same)``."""
    g = scores.where("i <> j").groupBy("batch", "i").agg(F.max(F.when(F.col("same"), F.col("d"))).alias("p"), F.min(F.when(~F.col("same"), F.col("d"))).alias("n"))
    return g.select("batch", "i", F.greatest(F.lit(0.0), F.coalesce(F.col("p") - F.col("n") + margin, F.lit(0.0))).alias("loss"))


def bce_with_logits(z: Column, y: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def focal(z: Column, y: Column, gamma: float = 2.0, alpha: float = 0.25) -> Column:
    p = 1 / (1 + F.exp(-z))
    pt = F.when(y == 1, p).otherwise(1 - p)
    a = F.when(y == 1, alpha).otherwise(1 - alpha)
    return a * F.pow(1 - pt, F.lit(gamma)) * bce_with_logits(z, y)


def overlap_losses(df: DataFrame, p: str, y: str, alpha: float = 0.5, beta: float = 0.5, smooth: float = 1.0) -> DataFrame:
    """Dice and Tversky losses over all rows."""
    tp, fp, fn = F.sum(F.col(p) * F.col(y)), F.sum(F.col(p) * (1 - F.col(y))), F.sum((1 - F.col(p)) * F.col(y))
    return df.agg(
        (1 - (2 * tp + smooth) / (F.sum(p) + F.sum(y) + smooth)).alias("dice"),
        (1 - (tp + smooth) / (tp + alpha * fp + beta * fn + smooth)).alias("tversky"),
    )


def bigamma(s: Column, r: Column, g1: float, g2: float) -> Column:
    """``sigmoid(g1) * s + sigmoid(g2) * r``."""
    return s / (1 + F.exp(F.lit(-g1))) + r / (1 + F.exp(F.lit(-g2)))


def gamma_mix(s: Column, r: Column, g: float) -> Column:
    return g * s + (1 - g) * r
