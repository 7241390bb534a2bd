"""MinHash near-dedup by improved consistent weighted sampling over TF-IDF shingles.

Shingles of five words weigh tf * idf, with ``idf = ln(1 / max(df / N, RARE)) / ln(1 / RARE)``, at
least ``LEAST_IDF``: shingles in less than the share ``RARE`` of all documents weigh 1 each. So
only shingles above that share need exact document frequencies, and there are at most (mean
shingles per document) / RARE of those at any corpus size. Candidates come from partial counts
(a shingle that frequent must be half as frequent in some block), exact counts from a second scan.

Signatures of ``BANDS * ROWS`` samples are banded. Documents that share a bucket with its first
document are compared with it by weighted Jaccard similarity. In buckets that then hold several
components, the members outside the largest (strays) are compared with all members, block by
block: a tile holds at most two blocks of ``TILE`` members on average and sends on only a
spanning forest of the links it finds. So each bucket's links between components are found,
while no pairs are emitted and the members of a large component never meet each other.

The floor ``LEAST_IDF`` bounds what very common shingles lose: with the share x of two texts' shingles in common, all of
them in a group that holds so much of the corpus that their idf is at the floor, the similarity is 0.5 x / (0.5 x + 1 - x) where it
would be x: pairs from 0.8 to 0.89 by plain count are told apart there, as TF-IDF asks; in groups under 1 % of all documents none are.

Defined cases: equal texts (null counts as empty) are one class; texts without words have no other links; texts
under five words are one shingle; an empty table gives none; repeated rows are copies, and the first by (id, text,
other columns) stays; very long texts are hashed whole; columns of any name pass through unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.bytesbuf import U64, buffers, mix, shingles
from siftwell.llm.common import Scratch, boxed, keyed
from siftwell.llm.graph import connected_components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
RARE, LEAST_IDF = 0.01, 0.5
#: Documents that one task counts at least, on average: few of a block's shingles then are in RARE / 2 of its documents.
COUNTED_AT_ONCE = 4000
#: Shingles that are counted together in one block.
BLOCK_SHINGLES = 2_000_000
#: Members of a block of a bucket, and rows of tiles that one group of a task holds, on average.
TILE, TILES_ROWS = 512, 1024
#: In large tiles, columns that fewer rows share are counted pair by pair; the others by products of so many columns.
DENSE, COLUMNS = 8, 2048
#: Similarities this near the threshold are computed again in double precision.
CLOSE = 1e-4
#: Entries of the table of sampling variables, a power of two.
TABLE_BITS = 20


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles in at least half of ``RARE`` of a block's documents. The last, smaller block is counted with the one before."""
    blocks, parts, n, held = [], [], 0, 0

    def flush(block: tuple[list[np.ndarray], int]) -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(block[0]), return_counts=True)
        some = c >= RARE / 2 * block[1]
        return pa.RecordBatch.from_arrays([pa.array(h[some].view(np.int64)), pa.array(c[some].astype(np.int64))], names=["h", "c"])

    for b in batches:
        for _, raw, offsets in buffers(b.column(0)):
            _, h, _ = shingles(raw, offsets, SHINGLE)
            parts.append(h)
            n, held = n + len(offsets) - 1, held + len(h)
            if held > BLOCK_SHINGLES and RARE * n > 2:
                if blocks:
                    yield flush(blocks.pop())
                blocks.append((parts, n))
                parts, n, held = [], 0, 0
    before, m = blocks.pop() if blocks else ([], 0)
    if before or parts:
        yield flush((before + parts, m + n))


def _counted(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    c = np.zeros(len(wanted), np.int64)
    for b in batches:
        for _, raw, offsets in buffers(b.column(0)):
            _, h, _ = shingles(raw, offsets, SHINGLE)
            at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
            c += np.bincount(at[wanted[at] == h], minlength=len(wanted))
    some = np.flatnonzero(c)
    yield pa.RecordBatch.from_arrays([pa.array(wanted[some].view(np.int64)), pa.array(c[some])], names=["h", "c"])


def idf_table(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and idf of the shingles that are not rare. At most 2 * (mean shingles) / RARE candidates reach the driver."""
    text = docs.select("text")
    n = docs.count()
    none = np.zeros(0, U64), np.zeros(0)
    if not n:
        return none
    # No exchange: neighbouring partitions are read by one task.
    some = text.coalesce(max(1, n // COUNTED_AT_ONCE)).mapInArrow(_frequent, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= RARE / 2 * n)
    wanted = np.sort(np.array([r[0] for r in some.select("h").collect()], np.int64).view(U64))
    if not len(wanted):
        return none
    exact = text.mapInArrow(partial(_counted, wanted=wanted), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") > RARE * n)
    rows = sorted((int(np.int64(r["h"]).view(U64)), r["c"]) for r in exact.collect())
    df = np.array([c for _, c in rows], float) / n
    return np.array([h for h, _ in rows], U64), np.maximum(LEAST_IDF, np.log(1 / df) / np.log(1 / RARE))


def weights(h: np.ndarray, tf: np.ndarray, idf: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    w = tf.astype(float)
    if len(idf[0]) and len(h):
        at = np.minimum(np.searchsorted(idf[0], h), len(idf[0]) - 1)
        hit = idf[0][at] == h
        w[hit] *= idf[1][at[hit]]
    return w


class Sampler:
    """Improved consistent weighted sampling with variables (r, c, beta) from a table.

    A shingle's entry for sample k is given by the top bits of a k-th hash of it. The table
    is sorted by the value ``a`` that an element of weight 1 gets, so such elements are ordered by
    their hash alone; other weights are sampled in full and placed among them.
    """

    def __init__(self, samples: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = 1 << TABLE_BITS
        r, c, beta = rng.gamma(2, 1, n), rng.gamma(2, 1, n), rng.random(n)
        a = c * np.exp(r * beta - r)
        order = np.argsort(a)
        self.r, self.c, self.beta, self.a = r[order], c[order], beta[order], a[order]
        self.mult = rng.integers(0, 1 << 63, samples, dtype=np.int64).astype(U64) * U64(2) + U64(1)
        self.shift = U64(64 - TABLE_BITS)

    def signatures(self, row: np.ndarray, h: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
        """``(n, samples)``; rows without shingles are 0."""
        out = np.zeros((n, len(self.mult)), U64)
        low = (U64(1) << self.shift) - U64(1)
        one = np.flatnonzero(w == 1)
        rest = np.flatnonzero(w != 1)
        top = np.full(n, ~U64(0))
        starts = {}
        for name, part in (("one", one), ("rest", rest)):
            r = row[part]
            s = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(part) else np.zeros(0, np.int64)
            starts[name] = (part, s, r[s] if len(part) else r)
        logw = np.log(w[rest])
        for k, m in enumerate(self.mult):
            best, sig = top.copy(), top.copy()
            part, s, rows = starts["one"]
            if len(part):
                best[rows] = np.minimum.reduceat(h[part] * m, s)
                sig[rows] = best[rows]
            part, s, rows = starts["rest"]
            if len(part):
                v = h[part] * m
                i = (v >> self.shift).astype(np.int64)
                r = self.r[i]
                t = np.floor(logw / r + self.beta[i])
                a = self.c[i] / np.exp(r * (t - self.beta[i]) + r)
                place = np.minimum(np.searchsorted(self.a, a), len(self.a) - 1).astype(U64)
                key = (place << self.shift) | (v & low)
                least = np.minimum.reduceat(key, s)
                won = key == np.repeat(least, np.diff(np.append(s, len(part))))
                at = np.flatnonzero(won)
                _, f = np.unique(row[part][at], return_index=True)
                at = at[f]
                value = v[at] ^ (t[at].astype(np.int64).view(U64) * U64(0x9E3779B97F4A7C15))
                wins = least < best[rows]
                sig[rows[wins]] = value[wins]
            out[:, k] = sig
        return out


def _bands(batches: Iterator[pa.RecordBatch], idf: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """``_k, same, bands``: key, digest of the text, and a bucket per band (none without words)."""
    sampler = Sampler(BANDS * ROWS)
    for b in batches:
        text = b.column(1)
        for first, raw, offsets in buffers(text):
            n = len(offsets) - 1
            row, h, tf = shingles(raw, offsets, SHINGLE)
            sig = sampler.signatures(row, h, weights(h, tf, idf), n).reshape(n, BANDS, ROWS)
            band = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64), (n, BANDS)).copy()
            for j in range(ROWS):
                band = mix(band * U64(0xD1342543DE82EF95) + sig[:, :, j])
            full = np.bincount(row, minlength=n) > 0
            flat = pa.array(band[full].reshape(-1).view(np.int64))
            ends = np.concatenate([[0], np.cumsum(np.where(full, BANDS, 0))]).astype(np.int32)
            data = raw.tobytes()
            same = [hashlib.blake2b(data[offsets[i] : offsets[i + 1]], digest_size=16).digest() for i in range(n)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n), pa.array(same, pa.binary()), pa.ListArray.from_arrays(ends, flat)], names=["_k", "same", "bands"])


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted sets (hashes, weights)."""
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    hit = a[0][at] == b[0] if len(a[0]) else np.zeros(len(b[0]), bool)
    least = np.minimum(a[1][at[hit]], b[1][hit]).sum()
    total = a[1].sum() + b[1].sum() - least
    return float(least / total) if total else 0.0


def _verified(batches: Iterator[pa.RecordBatch], idf: tuple[np.ndarray, np.ndarray], similarity: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = []
        for c in (2, 3):
            sets.append([])
            for _, raw, offsets in buffers(b.column(c)):
                row, h, tf = shingles(raw, offsets, SHINGLE)
                w = weights(h, tf, idf)
                cut = np.searchsorted(row, np.arange(len(offsets)))
                sets[-1] += [(h[i:j], w[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
        keep = pa.array([jaccard(x, y) >= similarity for x, y in zip(*sets, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])


def blocks(n: Column) -> Column:
    return F.ceil(n / F.lit(TILE)).cast("int")


def _tiles() -> list[Column]:
    """The tiles of a bucket's member. Blocks are numbered, strays' first; a tile is a pair of blocks with a stray one: (lesser, greater)."""
    stray = F.col("component") != F.col("main")
    own = F.when(stray, F.pmod(F.xxhash64("_k"), F.col("strays"))).otherwise(F.col("strays") + F.pmod(F.xxhash64("_k"), F.greatest("mains", F.lit(1)))).cast("int")
    others = F.when(stray, F.sequence(F.lit(0), F.col("strays") + F.col("mains") - 1)).otherwise(F.sequence(F.lit(0), F.col("strays") - 1))
    return [F.transform(others, lambda x: F.least(own, x).cast("long") * (1 << 31) + F.greatest(own, x)).alias("tiles")]


def shared_weights(sets: list[tuple[np.ndarray, np.ndarray]], tf: list[np.ndarray]) -> np.ndarray:
    """Sums of the lesser weights for all pairs of rows. The n-th occurrence of a shingle is a column of its own, so minima become products."""
    n = len(sets)
    row = np.repeat(np.arange(n), [int(t.sum()) for t in tf])
    h = np.concatenate([np.repeat(s[0], t) for s, t in zip(sets, tf, strict=True)])
    nth = np.concatenate([np.arange(int(t.sum())) - np.repeat(np.cumsum(t) - t, t) for t in tf])
    w = np.concatenate([np.repeat(s[1] / t, t) for s, t in zip(sets, tf, strict=True)])
    order = np.lexsort((nth, h))
    row, h, nth, w = row[order], h[order], nth[order], w[order]
    new = np.append(True, (h[1:] != h[:-1]) | (nth[1:] != nth[:-1]))
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(h)))
    out = np.zeros((n, n), np.float32)
    least = DENSE if n > 64 else 2
    for c in range(2, least):
        some = at[count == c]
        for i in range(c):
            for j in range(i + 1, c):
                np.add.at(out, (row[some + i], row[some + j]), w[some])
                np.add.at(out, (row[some + j], row[some + i]), w[some])
    many = np.flatnonzero(count >= least)
    for i in range(0, len(many), COLUMNS):
        cols = many[i : i + COLUMNS]
        k = count[cols]
        src = np.repeat(at[cols] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        m = np.zeros((n, len(cols)), np.float32)
        m[row[src], np.repeat(np.arange(len(cols)), k)] = 1
        out += (m * w[at[cols]].astype(np.float32)) @ m.T
    return out


def forest(n: int, component: np.ndarray, pairs: np.ndarray) -> list[int]:
    """Indices of pairs that join what is not yet joined."""
    up, head = list(range(n)), {}
    for i, c in enumerate(component.tolist()):
        up[i] = head.setdefault(c, i)

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for p, (i, j) in enumerate(pairs.tolist()):
        a, b = find(i), find(j)
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append(p)
    return out


def _tile_links(idf: tuple[np.ndarray, np.ndarray], similarity: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # A document stands in many tiles of the group: its shingles are made once.
        once = pdf.drop_duplicates("_k")
        made = {}
        keys = once["_k"].to_numpy()
        for first, raw, offsets in buffers(pa.array(once["text"], pa.large_string())):
            row, h, tf = shingles(raw, offsets, SHINGLE)
            w = weights(h, tf, idf)
            cut = np.searchsorted(row, np.arange(len(offsets)))
            for i in range(len(offsets) - 1):
                s = slice(cut[i], cut[i + 1])
                made[int(keys[first + i])] = (h[s], w[s]), tf[s]
        found = []
        for _, t in pdf.groupby(["bucket", "tile"], sort=False):
            k, component = t["_k"].to_numpy(), t["component"].to_numpy()
            if (component == component[0]).all():
                continue
            sets, tf = zip(*(made[int(x)] for x in k), strict=True)
            least = shared_weights(list(sets), list(tf))
            total = np.array([s[1].sum() for s in sets])
            most = total[:, None] + total[None, :] - least
            part = np.where(most > 0, least / np.where(most > 0, most, 1), 0)
            pairs = np.argwhere(np.triu((part >= similarity - CLOSE) & (component[:, None] != component[None, :]), 1))
            sure = [part[i, j] > similarity + CLOSE or jaccard(sets[i], sets[j]) >= similarity for i, j in pairs.tolist()]
            pairs = pairs[np.array(sure, bool)]
            found += [(int(k[i]), int(k[j])) for i, j in pairs[forest(len(k), component, pairs)].tolist()]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def classes(docs: DataFrame, similarity: float = SIMILARITY, scratch: Scratch | None = None) -> DataFrame:
    """``_k, doc_id, component`` for every row of ``docs(doc_id, text)``: the class's least key stands for it."""
    scratch = scratch or Scratch(docs.sparkSession)
    base = keyed(docs.select("doc_id", "text"), scratch)
    idf = idf_table(base)
    sig = scratch.save(base.select("_k", "text").mapInArrow(partial(_bands, idf=idf), "_k long, same binary, bands array<long>"), "signatures")
    first = scratch.save(sig.groupBy("same").agg(F.min(F.struct("_k", "bands")).alias("m")).select("same", "m.*"), "first")
    entries = scratch.save(first.select("_k", F.explode("bands").alias("bucket")), "entries")
    heads = entries.groupBy("bucket").agg(F.min("_k").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    entries = scratch.save(entries.join(heads, "bucket"), "shared")
    scratch.drop("entries")
    texts = base.join(entries.select("_k").distinct().hint("merge"), "_k", "left_semi").select("_k", "text")
    texts = scratch.save(texts, "texts")

    def verify(pairs: DataFrame) -> DataFrame:
        two = pairs.join(texts.select(F.col("_k").alias("a"), F.col("text").alias("ta")), "a")
        two = two.join(texts.select(F.col("_k").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
        return two.mapInArrow(partial(_verified, idf=idf, similarity=similarity), "a long, b long")

    star = entries.where("_k <> head").select(F.col("_k").alias("a"), F.col("head").alias("b")).distinct()
    star = scratch.save(star, "star")
    links = scratch.save(verify(star), "links_1")
    cc = scratch.save(connected_components(links, scratch, "cc_1"), "components_1")
    where = entries.join(cc.withColumnRenamed("node", "_k"), "_k", "left").select("bucket", "_k", F.coalesce("component", "_k").alias("component"))
    counts = where.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("_k")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "_k")).alias("h2"))
    buckets = counts.groupBy("bucket").agg(
        F.max(F.struct("n", "component")).alias("m"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2")
    ).where("parts > 1")
    # Of buckets with the same members one is enough.
    buckets = buckets.groupBy("n", "h1", "h2").agg(F.min(F.struct("bucket", "m")).alias("b")).select(
        "b.bucket", F.col("b.m.component").alias("main"), blocks(F.col("b.m.n")).alias("mains"), blocks(F.col("n") - F.col("b.m.n")).alias("strays")
    )
    tiles = scratch.save(where.join(buckets, "bucket").select("bucket", "_k", "component", *_tiles()), "tiles")
    tiles = tiles.select("bucket", "_k", "component", F.explode("tiles").alias("tile"))
    parts = max(1, -(-tiles.count() // TILES_ROWS))
    tiles = tiles.withColumn("part", F.pmod(F.xxhash64("bucket", "tile"), F.lit(parts))).join(texts, "_k")
    more = tiles.groupBy("part").applyInPandas(_tile_links(idf, similarity), "a long, b long")
    links = links.union(scratch.save(more, "links_2"))
    cc = scratch.save(connected_components(links, scratch, "cc_2"), "components_2")
    copies = sig.join(first.select("same", F.col("_k").alias("node")), "same").select("_k", "node")
    out = copies.join(cc, "node", "left").select("_k", F.coalesce("component", "node").alias("component"))
    scratch.drop("texts", "shared", "tiles", "star")
    return base.select("_k", "doc_id").join(out, "_k")


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, class_id``: the class's id is the doc_id of its first row."""
    c = classes(docs, similarity, scratch)
    heads = c.where("_k = component").select("component", F.col("doc_id").alias("class_id"))
    return c.join(heads, "component").select("doc_id", "class_id")


def keep_first(docs: DataFrame, similarity: float = SIMILARITY, scratch: Scratch | None = None) -> DataFrame:
    """The first row of each class, with its own columns."""
    scratch = scratch or Scratch(docs.sparkSession)
    base = keyed(boxed(docs, "doc_id"), scratch)
    # The key stands in for the id, so that both sides agree on it where ids repeat.
    c = classes(base.select(F.col("_k").alias("doc_id"), F.col("_row.text").alias("text")), similarity, scratch)
    out = base.join(c.where("_k = component").select("_k").hint("merge"), "_k", "left_semi")
    return out.select(*(F.col("_row").getField(x).alias(x) for x in docs.columns))
