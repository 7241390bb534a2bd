from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import common, mixing
from tests.llm.conftest import words


def water_fill(sizes, weights=(1, 2, 3), most=3.0):
    """Shares by weight, capped, by going through the sources again and again."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, free, out = float(sum(sizes.values())), list(order), dict.fromkeys(order, 0.0)
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > most * sizes[s]]
        for s in over or free:
            out[s] = most * sizes[s] if over else left * w[s] / total
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in over] if over else []
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100}, {"a": 1000, "b": 1, None: 10}, {}, {"a": 0}, {"a": 7, "B": 900, "c": 3, "d": 40, "é": 2, None: 1}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([("t" if s is None else "s" + s, n) for s, n in sizes.items()], "s string, source_size long")
    got = {None if r["s"] == "t" else r["s"][1:]: r["target"] for r in mixing.targets(rows, (1, 2, 3), 1.0, 3.0, common.Scratch(spark)).collect()}
    assert got == pytest.approx(water_fill(sizes))


def test_fit_counts_against_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(60):
        lengths = np.unique(rng.integers(1, 30, 5))
        counts = rng.integers(1, 4, len(lengths))
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + k * int(n) for s in sums for k in range(c + 1)}
        budget = int(rng.integers(0, int((lengths * counts).sum()) + 1))
        take = mixing.fit_counts(lengths, counts, budget)
        assert (take <= counts).all() and (take * lengths).sum() == max(s for s in sums if s <= budget)


def test_fit_counts_beyond_the_programme():
    lengths, counts = np.array([7, 50, 900, 20000]), np.array([5000, 3000, 400, 3])
    take = mixing.fit_counts(lengths, counts, 300_001)
    assert (take <= counts).all() and 300_001 - (take * lengths).sum() < 7
    assert (take > 0).all()


def test_mix(spark, docs, rng):
    rows = [(i, words(rng, rng.randint(0, 40)), rng.choice(["a", "b", "b", "b", "B", None])) for i in range(700)]
    got = mixing.mix(docs(rows)).collect()
    again = mixing.mix(docs(rows).repartition(5)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for i, t, s in rows:
        size[s] += len(t.split())
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 3 * r["size"] and r["source_size"] == size[r["source"]]
    assert target == pytest.approx(water_fill(dict(size)))
    assert all(abs(taken[s] - target[s]) <= 2 for s in target)
    assert sum(target.values()) == pytest.approx(sum(size.values()))


def test_hot_length(spark, docs):
    rows = [(i, "a b c", "s") for i in range(900)] + [(1000 + i, "a b c", "t") for i in range(300)]
    got = mixing.mix(docs(rows)).groupBy("source").agg(F.sum("taken").alias("n")).collect()
    assert {r["source"]: r["n"] for r in got} == {"s": 1200, "t": 2400}


def test_odd_rows(spark, docs, odd_rows):
    assert mixing.mix(docs(odd_rows)).count() == len(odd_rows)
    assert mixing.mix(docs([])).collect() == []
    out = mixing.mixed_rows(docs(odd_rows))
    assert out.columns == docs([]).columns
    assert {(r["_k"], r["rank"]) for r in out.collect()} == {("clash", 7)}


def test_selection_against_brute_force(spark, docs, rng):
    """Within a source the plan's documents of each length are taken, those first by the seeded hash of their keys."""
    rows = [(i, words(rng, rng.randint(0, 12)), rng.choice("ab")) for i in range(400)]
    got = mixing.mix(docs(rows)).withColumn("h", F.xxhash64(F.lit(42), F.col("_k").cast("long"))).toPandas()
    got["h"] = got["h"].astype("int64")
    for _, g in got.groupby(["source", "size"]):
        if g["size"].iloc[0]:
            times = (g["taken"] / g["size"]).astype(int)
            assert times.max() - times.min() <= 1
            more = times > times.min()
            # Buckets of the hash's middle bits come before the hash itself.
            key = list(zip(((g["h"].to_numpy(np.int64) >> 20) % max(1, -(-len(g) // mixing.ORDERED_AT_ONCE))), g["h"]))
            assert sorted(key)[: more.sum()] == sorted(k for k, m in zip(key, more) if m)


def test_reruns_agree_with_repeated_ids(spark, docs, rng):
    rows = [(i % 150, words(rng, rng.randint(1, 9)), rng.choice(["a", "b", None])) for i in range(600)] + [(None, "x y", "a")] * 5
    one = mixing.mix(docs(rows)).drop("_k").collect()
    rng.shuffle(rows)
    two = mixing.mix(docs(rows).repartition(7)).drop("_k").collect()
    assert sorted(map(tuple, one), key=repr) == sorted(map(tuple, two), key=repr)


def test_word_counts(spark):
    texts = [None, "", " ", "a", " a", "a ", " a\tb\x0bc\x1cd ", "\na\n\nb\n", "x\u00a0y z"]
    import re

    df = spark.createDataFrame([(t,) for t in texts], "t string").select(common.n_words(F.col("t")))
    assert [r[0] for r in df.collect()] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
