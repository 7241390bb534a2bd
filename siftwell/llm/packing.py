"""Best-fit packing under conflicts.

Pieces of documents are packed into bins of ``capacity`` words. A bin never holds two pieces of
one source or of one duplicate cluster. Open bins are ordered by residual capacity and carry
bitmaps of their sources and clusters; a piece looks for the successor of its size and goes on
until the tightest compatible bin is found, else opens a bin.

Rows are packed in blocks dealt by a hash, each a bounded number of rows in one task; so a hot
source or cluster is spread over all blocks and bins never span blocks.

Defined cases: documents longer than the capacity are cut into pieces, which conflict with
each other; empty and null texts have one piece of size 0; a null source conflicts with
nothing; rows of equal text are one cluster; repeated rows are packed each; of equally long pieces the first by
key comes first; an empty table gives none. Keys depend on (id, source, size, text) alone, so reruns agree however rows are
partitioned. Only ``doc_id`` (integers), ``text``, ``source`` and the cluster column are read, whatever others are called.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import Scratch, keyed, n_words

CAPACITY = 2048
#: Rows of one block, on average.
BLOCK = 4096
#: Bins of one run of the residual order, about.
RUN = 64


class Bins:
    """Open bins in the order of (residual, bin), in runs with the AND of their bitmaps.

    A run all of whose bins conflict with a piece is skipped at once; the AND of a run is
    recomputed when it changes.
    """

    def __init__(self) -> None:
        self.runs: list[list[tuple[int, int]]] = [[]]
        self.common: list[int] = [0]
        self.mask: list[int] = []
        self.left: list[int] = []

    def _refresh(self, r: int) -> None:
        both = -1
        for _, b in self.runs[r]:
            both &= self.mask[b]
            if not both:
                break
        self.common[r] = both if self.runs[r] else 0

    def _insert(self, b: int) -> None:
        item = (self.left[b], b)
        r = 0
        lo, hi = 0, len(self.runs) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            if self.runs[mid] and self.runs[mid][-1] >= item:
                hi = mid
            else:
                lo = mid + 1
        r = lo
        run = self.runs[r]
        run.insert(bisect_left(run, item), item)
        if len(run) > 2 * RUN:
            self.runs[r : r + 1] = [run[:RUN], run[RUN:]]
            self.common[r : r + 1] = [0, 0]
            self._refresh(r + 1)
        self._refresh(r)

    def place(self, size: int, mask: int, capacity: int) -> int:
        """The bin that takes the piece: of the compatible ones the fullest, of those the first opened."""
        at = (size, -1)
        for r, run in enumerate(self.runs):
            if not run or run[-1] < at or self.common[r] & mask:
                continue
            for i in range(bisect_left(run, at), len(run)):
                b = run[i][1]
                if not self.mask[b] & mask:
                    del run[i]
                    if not run and len(self.runs) > 1:
                        del self.runs[r], self.common[r]
                    else:
                        self._refresh(r)
                    return self._put(b, size, mask)
        self.left.append(capacity)
        self.mask.append(0)
        return self._put(len(self.left) - 1, size, mask)

    def _put(self, b: int, size: int, mask: int) -> int:
        self.left[b] -= size
        self.mask[b] |= mask
        self._insert(b)
        return b


def pieces(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and size of each piece: whole capacities first, then the rest."""
    count = np.maximum(1, -(-sizes // capacity))
    row = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, np.minimum(capacity, sizes[row] - nth * capacity)


def _pack(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_k", kind="stable").reset_index(drop=True)
        row, size = pieces(pdf["size"].to_numpy(np.int64), capacity)
        source, cluster = pdf["source"].factorize()[0], pdf["cluster"].factorize()[0]
        n_sources = int(source.max()) + 1
        # Only clusters of several pieces can conflict: the others need no bit.
        often = np.flatnonzero(np.bincount(cluster[row]) > 1)
        bit = {int(c): n_sources + i for i, c in enumerate(often)}
        bins, nth = Bins(), np.arange(len(row)) - np.searchsorted(row, row)
        out = np.zeros(len(row), np.int64)
        for p in np.argsort(-size, kind="stable"):
            r = row[p]
            mask = 1 << int(source[r]) if source[r] >= 0 else 0
            if int(cluster[r]) in bit:
                mask |= 1 << bit[int(cluster[r])]
            out[p] = bins.place(int(size[p]), mask, capacity)
        left = np.array(bins.left, np.int64)
        ids = pdf["doc_id"].astype("Int64").iloc[row].reset_index(drop=True)
        return pd.DataFrame({"doc_id": ids, "piece": nth.astype(np.int32), "size": size, "source": pdf["source"].iloc[row].to_numpy(), "block": pdf["block"].iloc[row].to_numpy(), "bin": out, "bin_words": capacity - left[out]})

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, cluster: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, piece, size, source, block, bin, bin_words``: one row per piece of ``docs(doc_id, text, source)``.

    A bin is ``(block, bin)``. ``cluster`` names a column of duplicate-cluster ids; without
    one, equal texts are a cluster.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    same = F.col(cluster).cast("string") if cluster else F.md5(F.coalesce("text", F.lit("")))
    base = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), same.alias("cluster"))
    base = keyed(scratch.save(base, "pack_base"), scratch)
    blocks = max(1, -(-base.count() // block))
    return base.withColumn("block", F.pmod(F.xxhash64("_k"), F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(
        _pack(capacity), "doc_id long, piece int, size long, source string, block int, bin long, bin_words long"
    )
