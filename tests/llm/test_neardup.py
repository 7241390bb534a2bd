from collections import Counter, defaultdict
from itertools import combinations

import numpy as np

from siftwell.llm import bytesbuf, neardup
from tests.llm.conftest import words


def brute(rows, similarity=0.8):
    sets = [Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else Counter() for _, t, *_ in rows]
    df, n = Counter(g for s in sets for g in s), len(rows)
    idf = {g: 1.0 if c <= neardup.RARE * n else max(neardup.LEAST_IDF, np.log(n / c) / np.log(1 / neardup.RARE)) for g, c in df.items()}
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    total, shared, holders = [sum(v * idf[g] for g, v in s.items()) for s in sets], Counter(), defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    for g, held in holders.items():
        for a, b in combinations(held, 2):
            shared[a, b] += min(sets[a][g], sets[b][g]) * idf[g]
    texts = defaultdict(list)
    for i, (_, t, *_) in enumerate(rows):
        texts[t or ""].append(i)
    same = {(held[0], b) for held in texts.values() for b in held[1:]}
    for a, b in sorted(same | set(shared)):
        least = shared[a, b]
        most = total[a] + total[b] - least
        if (a, b) in same or (most and least / most >= similarity):
            i, j = sorted((find(a), find(b)))
            up[j] = i
    return [rows[find(i)][0] for i in range(n)]


def test_matches_brute_force(spark, docs, rng):
    base, rows = [words(rng, rng.randint(40, 120)) for _ in range(12)], []
    for i in range(150):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = words(rng, 1)
        rows.append((i, " ".join(w) if rng.random() < 0.7 else words(rng, rng.randint(1, 60)), "s"))
    rows += [(200, rows[3][1], "s"), (201, "a b", "s"), (202, "a b", "s"), (203, "a c", "s"), (204, None, "s"), (205, "", "s"), (206, "A B", "s")]
    got = dict(map(tuple, neardup.near_classes(docs(rows)).collect()))
    assert [got[r[0]] for r in rows] == brute(rows)


def test_odd_rows(spark, docs, odd_rows):
    got = neardup.near_classes(docs(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    kept = neardup.keep_first(docs(odd_rows))
    assert kept.columns == docs([]).columns
    assert {(r["_k"], r["rank"]) for r in kept.collect()} == {("clash", 7)}
    assert Counter(r["text"] or "" for r in kept.collect()) == Counter({t or "" for _, t, _ in odd_rows})


def test_empty_table(spark, docs):
    assert neardup.near_classes(docs([])).collect() == []


def test_samples_agree_as_often_as_sets(rng):
    """Weights other than 1: the share of equal samples is the weighted Jaccard similarity."""
    h = bytesbuf.mix(np.arange(1, 61, dtype=np.uint64))
    wa, wb = np.ones(60), np.ones(60)
    wa[:20], wb[:20], wb[20:30] = 2.0, 3.0, 0.3
    s = neardup.Sampler(4000)
    sig = s.signatures(np.repeat([0, 1], 60), np.concatenate([h, h]), np.concatenate([wa, wb]), 2)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.03


def test_recall_against_all_pairs(spark):
    """On given documents: of all pairs of different texts at 0.8 or more, by weighted similarity, 0.9 at least are in one class; and none but linked ones are."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    got = dict(map(tuple, neardup.near_classes(docs).collect()))
    want = dict(zip((i for i, _ in rows), brute(rows)))
    pairs = [(a, b) for a, b in want.items() if a != b]
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)
    assert all(want[i] == want[c] for i, c in got.items())


def test_few_shingles_leave_a_small_partition(spark, rng):
    """However documents are dealt into partitions, shingles that stand once are not sent out."""
    import pyarrow as pa

    texts = [words(rng, 60) for _ in range(450)]
    out = list(neardup._frequent(iter([pa.RecordBatch.from_arrays([pa.array(texts[i : i + 150])], names=["text"]) for i in range(0, 450, 150)])))
    assert sum(b.num_rows for b in out) == 0


def test_very_long_text(spark, docs, rng):
    text = words(rng, 60_000)
    got = dict(map(tuple, neardup.near_classes(docs([(1, text, "s"), (2, text + " more", "s"), (3, "other words are here now", "s")])).collect()))
    assert got == {1: 1, 2: 1, 3: 3}
