"""Nearest neighbours by a block matrix join.

Queries and candidates are dealt into blocks; each pair of blocks is one tile. In a tile the
product of int8 codes gives approximate cosines with a quantisation error bound; pairs that
the bound can't exclude are computed in double precision and kept in a heap per query. The
tiles' short lists are merged by heaps per query block.

Defined cases: vectors that are null, zero, empty or hold null or non-finite components, and null ids take no part;
vectors are near only to those of their own length; with fewer candidates than
asked all are returned; ties go to the smaller id; copies of a vector all count, rows that repeat an id too; very long
vectors are compared whole; an empty table gives none. Only ``vec_id`` and ``embedding`` are read, whatever other columns are called.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import Scratch

#: Rows of a tile's sides at most, about: bounds a task's memory.
QUERY_BLOCK, CANDIDATE_BLOCK, STEP = 2048, 16384, 2048
#: Up to so many components a product of codes, at most 127 * 127 each, is exact in float32.
FLOAT32_EXACT = (1 << 24) // (127 * 127)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise products summed in component order, so that a pair's score is the same in any tile."""
    acc = np.zeros(len(a))
    for d in range(a.shape[1]):
        acc += a[:, d] * b[:, d]
    return acc


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (as floats in which tile products are exact), scales and norms of the error."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None])
    err = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes.astype(np.float32 if unit.shape[1] <= FLOAT32_EXACT else np.float64), scale, err


def tile_top(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """For each query the ``k`` best of the tile as a heap of (score, -id)."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in qid]
    qn, cn = np.sqrt(_dot(q, q)), np.sqrt(_dot(c, c))
    qc, qs, qe = quantise(q / qn[:, None])
    floor = np.full(len(qid), -np.inf)
    for i in range(0, len(cid), STEP):
        ids, part, norm = cid[i : i + STEP], c[i : i + STEP], cn[i : i + STEP]
        cc, cs, ce = quantise(part / norm[:, None])
        near = (qc @ cc.T).astype(np.float64) * qs[:, None] * cs[None, :]
        # |<a,b> - near| <= |a - a'| |b| + |a'| |b - b'|, with |b| = 1 and |a'| <= 1 + |a - a'|
        bound = qe[:, None] + (1 + qe[:, None]) * ce[None, :] + 1e-9
        near[qid[:, None] == ids[None, :]] = -np.inf
        if len(ids) > k:
            low = np.partition(near - bound, len(ids) - k, axis=1)[:, len(ids) - k]
            floor = np.maximum(floor, low)
        row, col = np.nonzero((near + bound >= floor[:, None]) & np.isfinite(near))
        score = _dot(q[row], part[col]) / (qn[row] * norm[col])
        for r, s, j in zip(row.tolist(), score.tolist(), ids[col].tolist(), strict=True):
            h = heaps[r]
            if len(h) < k:
                heapq.heappush(h, (s, -j))
            elif (s, -j) > h[0]:
                heapq.heapreplace(h, (s, -j))
        full = [n for n, h in enumerate(heaps) if len(h) == k]
        floor[full] = np.maximum(floor[full], [heaps[n][0][0] - 1e-9 for n in full])
    return heaps


def _tile(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            qid, cid = left["vec_id"].to_numpy(np.int64), right["cand_id"].to_numpy(np.int64)
            heaps = tile_top(qid, np.stack(left["v"]).astype(float), cid, np.stack(right["cand_v"]).astype(float), k)
            dim, parts = int(left["dim"].iloc[0]), int(left["parts"].iloc[0])
            rows = [(dim, parts, int(n), [-j for _, j in h], [s for s, _ in h]) for n, h in zip(qid, heaps, strict=True)]
        return pd.DataFrame(rows, columns=["dim", "parts", "query_id", "ids", "scores"])

    return run


def _merge(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        best: dict[int, list[tuple[float, int]]] = {}
        for n, ids, scores in zip(pdf["query_id"], pdf["ids"], pdf["scores"], strict=True):
            h = best.setdefault(int(n), [])
            for j, s in zip(ids, scores, strict=True):
                if len(h) < k:
                    heapq.heappush(h, (float(s), -int(j)))
                else:
                    heapq.heappushpop(h, (float(s), -int(j)))
        rows = [(n, r + 1, -j, s) for n, h in best.items() for r, (s, j) in enumerate(sorted(h, reverse=True))]
        return pd.DataFrame(rows, columns=["query_id", "rank", "vec_id", "score"])

    return run


def search(vectors: DataFrame, is_query, k: int = 5, scratch: Scratch | None = None, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest by cosine of every row of ``vectors(vec_id, embedding)`` for which ``is_query`` holds.

    Tiles are pairs of blocks of one vector length; their number is the product of both sides' blocks, each of bounded size.
    """
    scratch = scratch or Scratch(vectors.sparkSession)
    # Components keep their type until a tile computes: float vectors travel as floats.
    good = vectors.select("vec_id", F.col("embedding").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    good = scratch.save(good, "vectors").withColumn("dim", F.size("v"))
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / F.lit(size))).cast("int")
    sizes = good.groupBy("dim").agg(blocks(F.count_if("asked"), query_block).alias("nq"), blocks(F.count(F.lit(1)), candidate_block).alias("nc"), F.count_if("asked").alias("q")).where("q > 0")
    good = good.join(scratch.save(sizes, "sizes"), "dim")
    cut = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(n)).cast("int")
    parts = F.ceil(F.col("q") / F.lit(256)).cast("int").alias("parts")
    queries = good.where("asked").select("dim", cut("nq", 1).alias("qb"), F.explode(F.sequence(F.lit(0), F.col("nc") - 1)).alias("cb"), "vec_id", "v", parts)
    candidates = good.select(F.col("dim").alias("cand_dim"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("cand_qb"), cut("nc", 2).alias("cand_cb"), F.col("vec_id").alias("cand_id"), F.col("v").alias("cand_v"))
    tiles = queries.groupBy("dim", "qb", "cb").cogroup(candidates.groupBy("cand_dim", "cand_qb", "cand_cb")).applyInPandas(
        _tile(k), "dim int, parts int, query_id long, ids array<long>, scores array<double>"
    )
    merged = tiles.withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")))
    return merged.groupBy("dim", "part").applyInPandas(_merge(k), "query_id long, rank int, vec_id long, score double")
