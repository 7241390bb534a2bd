from collections import defaultdict

import numpy as np
import pandas as pd

from siftwell.llm import packing
from tests.llm.conftest import words


def naive(sizes, masks, capacity):
    """Best fit by looking at every bin."""
    left, used, out = [], [], []
    for s, m in zip(sizes, masks):
        fit = [(left[b], b) for b in range(len(left)) if left[b] >= s and not used[b] & m]
        b = min(fit)[1] if fit else len(left)
        if b == len(left):
            left.append(capacity)
            used.append(0)
        left[b] -= s
        used[b] |= m
        out.append(b)
    return out


def test_bins_match_naive_best_fit():
    rng = np.random.default_rng(3)
    sizes = np.sort(rng.integers(0, 60, 1500))[::-1]
    masks = [1 << int(x) for x in rng.zipf(1.5, 1500) % 50]
    bins = packing.Bins()
    assert [bins.place(int(s), m, 100) for s, m in zip(sizes, masks)] == naive([int(s) for s in sizes], masks, 100)


def test_pack(spark, docs, rng):
    rows = [(i, words(rng, rng.randint(0, 90)), f"s{rng.randint(0, 9)}") for i in range(200)] + [(300, words(rng, 250), "s1")]
    rows += [(400 + i, rows[0][1], f"t{i}") for i in range(5)]
    got = packing.pack(docs(rows), capacity=100, block=64).toPandas()
    size = {i: len(t.split()) for i, t, _ in rows}
    assert got.groupby("doc_id")["size"].sum().to_dict() == size
    for _, b in got.groupby(["block", "bin"]):
        assert b["size"].sum() == b["bin_words"].iloc[0] <= 100
        assert b["source"].is_unique
    text = {i: t for i, t, _ in rows}
    held = defaultdict(list)
    for r in got.itertuples():
        held[r.block, r.bin].append(text[r.doc_id])
    assert all(len(set(v)) == len(v) for v in held.values())


def test_odd_rows(spark, docs, odd_rows):
    got = packing.pack(docs(odd_rows)).toPandas()
    assert len(got[got.piece == 0]) == len(odd_rows)
    assert packing.pack(docs([])).collect() == []
    assert isinstance(got, pd.DataFrame)


def test_pack_against_brute_force(spark, docs, rng):
    """One block: the same bins as by looking at every bin."""
    rows = [(i, words(rng, rng.randint(0, 90)), f"s{rng.randint(0, 5)}") for i in range(150)] + [(200 + i, "same text here", f"t{i}") for i in range(4)]
    got = packing.pack(docs(rows), capacity=100, block=10_000).toPandas()
    got = got.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable")
    bit, text = {}, {i: t for i, t, _ in rows}
    masks = [1 << bit.setdefault(("s", r.source), len(bit)) | 1 << bit.setdefault(("t", text[r.doc_id]), len(bit)) for r in got.itertuples()]
    assert got["bin"].tolist() == naive(got["size"].tolist(), masks, 100)


def test_reruns_agree_with_repeated_ids(spark, docs, rng):
    rows = [(i % 50, words(rng, rng.randint(1, 60)), rng.choice(["a", "b", "c", None])) for i in range(300)] + [(None, "x y", "a")] * 5
    one = packing.pack(docs(rows), capacity=100, block=64).collect()
    rng.shuffle(rows)
    two = packing.pack(docs(rows).repartition(7), capacity=100, block=64).collect()
    assert sorted(map(tuple, one), key=repr) == sorted(map(tuple, two), key=repr)
