"""Exact substring dedup by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every byte goes that a ``LENGTH``-byte string covers which also starts earlier in the corpus.

1. Anchors: each window of ``LENGTH`` bytes selects its ``GRAM``-byte gram of least hash, the first
   of equal ones. Equal windows select the same gram, so only grams that occur again matter.
   They are found per hash bucket, from one entry per block of documents and gram.
2. Contexts: the bytes of all windows that select such an anchor. Equal contexts are counted
   once per block and once per bucket; all but the first occurrence go as a whole.
3. Different contexts of one anchor are joined to one text per bucket. On its Burrows-Wheeler
   transform the intervals of strings that occur again are extended backwards, breadth first;
   common prefixes appear by increasing value, up to ``LENGTH``. In each interval of that depth
   all windows but the first go.

No group of copies meets in one task: a bucket gets an anchor once per block of documents.

Defined cases: null and empty texts lose nothing; texts under ``LENGTH`` bytes lose nothing; of
repeated rows, shared and null ids the first stays, in the order of (id, text); matches never cross documents;
bytes are UTF-8 and cuts may split characters; very long texts are hashed whole, in one piece each; an
empty table gives none. Only ``doc_id`` (integers) and ``text`` are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.bytesbuf import BASE, U64, buffers, inverse, mix, powers
from siftwell.llm.common import Scratch, keyed

LENGTH, GRAM = 100, 32
#: Starts of grams in one window.
SPAN = LENGTH - GRAM + 1
#: Rows whose contexts are gathered at once.
AT_ONCE = 2000
#: Contexts are dealt to so many times more buckets than anchors, as a power of two: they are ten times as large.
FINER = 5
#: Anchors that one block holds, about.
BLOCK_ANCHORS = 400_000

#: An anchor stands at ``off``; the windows that select it start from ``off - before`` to ``off - after``.
ANCHOR = [("off", "<u4"), ("before", "u1"), ("after", "u1")]
ENTRY = np.dtype([("g", "<u8"), ("row", "<u4"), *ANCHOR])
PLACE = np.dtype([("row", "<u4"), *ANCHOR])
OFFSET = np.dtype(ANCHOR)
CONTEXT = np.dtype([("g", "<u8"), ("c", "<u8"), ("k", "<i8"), ("off", "<u4"), ("left", "u1"), ("size", "u1")])
#: In an entry's row: its gram occurs again in the same block.
KNOWN = 1 << 31


def _sliding(x: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """``f`` over ``x[i : i + width]`` for every full window."""
    n, have = len(x) - width + 1, 1
    while have * 2 <= width:
        x = f(x[: len(x) - have], x[have:])
        have *= 2
    return f(x[:n], x[width - have : width - have + n])


def _prefix(raw: np.ndarray) -> np.ndarray:
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * powers(BASE, len(raw))[: len(raw)], out=total[1:])
    return total


def _hash(total: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice, n: int) -> np.ndarray:
    return mix((total[end] - total[start]) * powers(inverse(BASE), n + 1)[start])


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, offset, before, after and hash of the grams that windows of ``LENGTH`` bytes within a row select."""
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none, np.zeros(0, U64)
    g = _hash(_prefix(raw), slice(0, n - GRAM + 1), slice(GRAM, n + 1), n)
    short = np.maximum((g >> U64(32)).astype(np.uint32), np.uint32(1))
    least = _sliding(short, SPAN, np.minimum)
    ok = np.zeros(n - LENGTH + 2, np.int8)
    size = np.diff(offsets)
    has = np.flatnonzero(size >= LENGTH)
    np.add.at(ok, offsets[has], 1)
    np.add.at(ok, offsets[has] + size[has] - LENGTH + 1, -1)
    valid = np.cumsum(ok[:-1]).astype(bool)
    # A gram can be selected if the greatest least value of the valid windows around is its own; invalid ones count as 0.
    pad = np.zeros(SPAN - 1, np.uint32)
    around = _sliding(np.concatenate([pad, np.where(valid, least, np.uint32(0)), pad]), SPAN, np.maximum)
    can = around[: len(short)] == short
    pos = np.flatnonzero(can)
    window = np.flatnonzero(valid)
    # Of each window: the first such gram from its start on that has its least value.
    which = (np.cumsum(can) - can)[window]
    wrong = np.flatnonzero(short[pos[which]] != least[window]) if len(window) else none
    while len(wrong):
        which[wrong] += 1
        wrong = wrong[short[pos[which[wrong]]] != least[window[wrong]]]
    first = np.flatnonzero(np.append(True, which[1:] != which[:-1])) if len(window) else none
    last = np.append(first[1:], len(which)) - 1 if len(window) else none
    pos = pos[which[first]]
    # Rows without bytes share an offset with the next one; searchsorted takes the last of them.
    row = np.searchsorted(offsets, pos, side="right") - 1
    # Least hashes are small ones: mixed again, so that they spread over the buckets.
    return row, pos - offsets[row], pos - window[first], pos - window[last], mix(g[pos])


def _bits(bucket_bits: int, g: np.ndarray) -> np.ndarray:
    return (g >> U64(64 - bucket_bits)).astype(np.int64) if bucket_bits else np.zeros(len(g), np.int64)


def _cut(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal values."""
    if not len(bucket):
        return
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    for i, j in zip(at, np.append(at[1:], len(bucket)), strict=True):
        yield int(bucket[i]), slice(int(i), int(j))


FOUND = "kind int, block long, bucket long, payload binary"
ENTRIES, PLACES, KEYS = 0, 1, 2


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kind, block, bucket, payload = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(block, pa.int64()), pa.array(bucket, pa.int64()), pa.array(payload, pa.binary())], names=["kind", "block", "bucket", "payload"])


def _places(e: np.ndarray) -> np.ndarray:
    out = np.zeros(len(e), PLACE)
    for name in PLACE.names:
        out[name] = e[name]
    return out


def _find(batches: Iterator[pa.RecordBatch], bucket_bits: int) -> Iterator[pa.RecordBatch]:
    keys: list[np.ndarray] = []
    parts: list[tuple[np.ndarray, ...]] = []
    rows = held = 0

    def flush() -> pa.RecordBatch:
        block = int.from_bytes(os.urandom(8), "little") >> 1
        row, off, before, after, g = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((off, row, g))
        e = np.zeros(len(g), ENTRY)
        e["g"], e["row"], e["off"], e["before"], e["after"] = g[order], row[order], off[order], before[order], after[order]
        first = np.append(True, e["g"][1:] != e["g"][:-1]) if len(e) else np.zeros(0, bool)
        n = np.diff(np.append(np.flatnonzero(first), len(e)))
        again = np.repeat(n > 1, n)
        places = _places(e[again])
        e["row"][again] |= KNOWN
        e = e[first]
        out = [(KEYS, block, 0, np.concatenate(keys).tobytes()), (PLACES, block, 0, places.tobytes())]
        out += [(ENTRIES, block, b, e[s].tobytes()) for b, s in _cut(_bits(bucket_bits, e["g"]))]
        return _batch(out)

    for b in batches:
        ids = b.column(0).to_numpy()
        for first, raw, offsets in buffers(b.column(1)):
            row, off, before, after, g = anchors(raw, offsets)
            parts.append((row + rows, off, before, after, g))
            keys.append(ids[first : first + len(offsets) - 1])
            rows, held = rows + len(offsets) - 1, held + len(g)
            if held > BLOCK_ANCHORS:
                yield flush()
                keys, parts, rows, held = [], [], 0, 0
    if held:
        yield flush()


def _again(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: the places of grams that occur in several blocks."""
    parts = [np.frombuffer(x, ENTRY) for x in pdf["payload"]]
    e, block = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    order = np.argsort(e["g"], kind="stable")
    e, block = e[order], block[order]
    first = np.append(True, e["g"][1:] != e["g"][:-1])
    n = np.diff(np.append(np.flatnonzero(first), len(e)))
    keep = np.repeat(n > 1, n) & (e["row"] < KNOWN)
    e, block = e[keep], block[keep]
    order = np.argsort(block, kind="stable")
    e, block = e[order], block[order]
    places = _places(e)
    ids = pdf["block"].to_numpy()
    rows = [(PLACES, int(ids[b]), 0, places[s].tobytes()) for b, s in _cut(block)]
    return pd.DataFrame(rows, columns=["kind", "block", "bucket", "payload"])


def _by_document(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one block: sorted anchor offsets per document."""
    keys = np.frombuffer(pdf.loc[pdf["kind"] == KEYS, "payload"].iloc[0], np.int64)
    p = np.concatenate([np.frombuffer(x, PLACE) for x in pdf.loc[pdf["kind"] == PLACES, "payload"]])
    p = p[np.lexsort((p["off"], p["row"]))]
    offs = np.zeros(len(p), OFFSET)
    for name in OFFSET.names:
        offs[name] = p[name]
    rows = [(int(keys[r]), offs[s].tobytes()) for r, s in _cut(p["row"].astype(np.int64))]
    return pd.DataFrame(rows, columns=["_k", "offs"])


def _ranges(start: np.ndarray, end: np.ndarray) -> bytes:
    return np.stack([start, end], axis=1).astype("<u4").tobytes()


CONTEXTS, RANGES = 0, 1


def _contexts(batches: Iterator[pa.RecordBatch], bucket_bits: int) -> Iterator[pa.RecordBatch]:
    """From ``_k, text, offs``: first contexts of the block by bucket, and byte ranges of those that repeat one of the block."""
    for b in batches:
        for i in range(0, b.num_rows, AT_ONCE):
            yield from _contexts_of(b.slice(i, AT_ONCE), bucket_bits)


def _contexts_of(b: pa.RecordBatch, bucket_bits: int) -> Iterator[pa.RecordBatch]:
    ids, offs = b.column(0).to_numpy(), b.column(2)
    parts, blobs = [], []
    for first, raw, offsets in buffers(b.column(1)):
        own = [np.frombuffer(offs[first + i].as_py(), OFFSET) for i in range(len(offsets) - 1)]
        row = np.repeat(np.arange(len(own)), [len(x) for x in own])
        if not len(row):
            continue
        at = np.concatenate(own)
        pos = offsets[row] + at["off"]
        start, end = pos - at["before"], pos - at["after"] + LENGTH
        total = _prefix(raw)
        x = np.zeros(len(pos), CONTEXT)
        x["g"] = mix(_hash(total, pos, pos + GRAM, len(raw)))
        x["left"], x["size"] = pos - start, end - start
        x["c"] = mix(_hash(total, start, end, len(raw)) + x["left"].astype(U64) * U64(257) + x["size"].astype(U64))
        x["k"], x["off"] = ids[first + row], start - offsets[row]
        parts.append((x, start))
        blobs.append(raw)
    if not parts:
        return
    shift = np.cumsum([0] + [len(r) for r in blobs[:-1]])
    raw = np.concatenate(blobs)
    x = np.concatenate([p[0] for p in parts])
    start = np.concatenate([p[1] + s for p, s in zip(parts, shift, strict=True)])
    order = np.lexsort((x["off"], x["k"], x["c"], x["g"]))
    x, start = x[order], start[order]
    head = np.append(True, (x["g"][1:] != x["g"][:-1]) | (x["c"][1:] != x["c"][:-1]))
    rest = x[~head]
    rest = rest[np.argsort(rest["k"], kind="stable")]
    # Ranges need no bucket; they are spread over all by their document.
    out = [(RANGES, k, k & ((1 << bucket_bits) - 1), _ranges(rest["off"][s], rest["off"][s].astype(np.int64) + rest["size"][s])) for k, s in _cut(rest["k"])]
    x, start = x[head], start[head]
    for bucket, s in _cut(_bits(bucket_bits, x["g"])):
        size = x["size"][s].astype(np.int64)
        at = np.repeat(start[s] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        out.append((CONTEXTS, len(size), bucket, x[s].tobytes() + raw[at].tobytes()))
    for i in range(0, len(out), 4096):
        yield _batch(out[i : i + 4096])


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array by prefix doubling from 8 bytes on, and where a suffix's first 8 bytes differ from its predecessor's."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(U64)
    key = np.zeros(n, U64)
    for i in range(8):
        key = (key << U64(8)) | padded[i : i + n]
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.append(True, sorted_key[1:] != sorted_key[:-1])
    eight = new.copy()
    rank, have = np.zeros(n, np.int64), 8
    head = np.flatnonzero(new)
    rank[order] = np.repeat(head, np.diff(np.append(head, n)))
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(tied) and have < n:
        # Only suffixes whose prefix is still shared are ordered further.
        p = order[tied]
        nxt = np.where(p + have < n, rank[np.minimum(p + have, n - 1)], -1) + 1
        both = (rank[p] << 32) | nxt
        again = np.argsort(both)
        p, both = p[again], both[again]
        order[tied] = p
        fresh = np.append(True, both[1:] != both[:-1])
        # A group's rank is the place of its first member.
        rank[p] = np.repeat(tied[fresh], np.diff(np.append(np.flatnonzero(fresh), len(p))))
        tied = tied[~(fresh & np.append(fresh[1:], True))]
        have *= 2
    return order, eight


def repeated_intervals(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array and the intervals (first, last) of all strings of ``depth`` symbols that occur again.

    Breadth first by depth: the interval of ``cw`` is the image under the last-to-first map of the rows of
    ``w``'s interval whose Burrows-Wheeler symbol is ``c``. Strings that occur once are dropped, as
    is all that would extend them.
    """
    n = len(text)
    order, eight = suffix_order(text)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = text[order - 1].astype(np.int16)
    before[place[0]] = 256  # the whole text has no symbol before it
    to_first = place[order - 1]
    run_head = np.append(True, before[1:] != before[:-1])
    run = np.cumsum(run_head) - 1
    run_start = np.flatnonzero(run_head)
    run_end = np.append(run_start[1:], n) - 1
    low = np.flatnonzero(eight)
    high = np.append(low[1:], n) - 1
    low, high = low[high > low], high[high > low]
    for _ in range(8, depth):
        if not len(low):
            break
        a, b = run[low], run[high]
        unary = a == b
        f, t = low[unary], high[unary]
        mixed = np.flatnonzero(~unary)
        if len(mixed):
            k = b[mixed] - a[mixed] + 1
            own = np.repeat(mixed, k)
            r = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + a[own]
            start, end = np.maximum(low[own], run_start[r]), np.minimum(high[own], run_end[r])
            key = own * 512 + before[start]
            by = np.argsort(key, kind="stable")
            key, start, end = key[by], start[by], end[by]
            one = np.append(True, key[1:] != key[:-1])
            at = np.flatnonzero(one)
            f, t = np.concatenate([f, start[at]]), np.concatenate([t, end[np.append(at[1:], len(key)) - 1]])
        some = (f < t) & (before[f] < 256)
        low, high = to_first[f[some]], to_first[t[some]]
    return order, low, high


def _bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: byte ranges to remove, by document. Ranges found before pass through."""
    told = pdf.loc[pdf["kind"] == RANGES, ["block", "payload"]].set_axis(["_k", "ranges"], axis=1)
    found = _expanded(pdf[pdf["kind"] == CONTEXTS])
    return pd.concat([told, found]) if len(found) else told


def _expanded(pdf: pd.DataFrame) -> pd.DataFrame:
    if not len(pdf):
        return pd.DataFrame([], columns=["_k", "ranges"])
    metas, texts = [], []
    for n, payload in zip(pdf["block"], pdf["payload"], strict=True):
        x = np.frombuffer(payload, CONTEXT, count=n)
        size = x["size"].astype(np.int64)
        metas.append(np.rec.fromarrays([x["g"], x["c"], x["k"], x["off"].astype(np.int64), size, np.cumsum(size) - size + sum(map(len, texts))], names="g,c,k,off,size,at"))
        texts.append(np.frombuffer(payload, np.uint8, offset=n * CONTEXT.itemsize))
    x, raw = np.concatenate(metas), np.concatenate(texts)
    x = x[np.lexsort((x["off"], x["k"], x["c"], x["g"]))]
    head = np.append(True, (x["g"][1:] != x["g"][:-1]) | (x["c"][1:] != x["c"][:-1]))
    out_k, out_s, out_e = [x["k"][~head]], [x["off"][~head]], [(x["off"] + x["size"])[~head]]
    x = x[head]
    first = np.append(True, x["g"][1:] != x["g"][:-1])
    n = np.diff(np.append(np.flatnonzero(first), len(x)))
    x = x[np.repeat(n > 1, n)]  # anchors with one context only: its first occurrence stays
    if len(x):
        size = x["size"] + 1
        begin = np.cumsum(size) - size
        own = np.repeat(np.arange(len(x)), size)
        inside = np.arange(int(size.sum())) - begin[own]
        text = np.zeros(len(own), np.uint8)
        real = inside < x["size"][own]
        text[real] = raw[(x["at"][own] + inside)[real]]
        order, low, high = repeated_intervals(text, LENGTH)
        count = high - low + 1
        group = np.repeat(np.arange(len(low)), count)
        p = order[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
        window = x["size"][own[p]] - inside[p] >= LENGTH
        p, group = p[window], group[window]
        k, at = x["k"][own[p]], x["off"][own[p]] + inside[p]
        by = np.lexsort((at, k, group))
        k, at, group = k[by], at[by], group[by]
        # The same window may stand in several contexts: only another place is a copy.
        lead = np.append(True, group[1:] != group[:-1])[: len(group)]
        src = np.repeat(np.flatnonzero(lead), np.diff(np.append(np.flatnonzero(lead), len(lead))))
        copy = (k != k[src]) | (at != at[src])
        out_k.append(k[copy])
        out_s.append(at[copy])
        out_e.append(at[copy] + LENGTH)
    k, s, e = np.concatenate(out_k), np.concatenate(out_s), np.concatenate(out_e)
    by = np.lexsort((s, k))
    k, s, e = k[by], s[by], e[by]
    # Join overlapping ranges of a document, so that few are sent on.
    if len(k):
        top = s.copy()
        far = np.maximum.accumulate(e + k_rank(k) * (1 << 33)) - k_rank(k) * (1 << 33)
        new = np.append(True, (k[1:] != k[:-1]) | (top[1:] > far[:-1]))
        at = np.flatnonzero(new)
        k, s, e = k[at], s[at], np.maximum.reduceat(e, at)
    rows = [(int(d), _ranges(s[c], e[c])) for d, c in _cut(k)]
    return pd.DataFrame(rows, columns=["_k", "ranges"])


def k_rank(k: np.ndarray) -> np.ndarray:
    """0, 1, ... per run of equal keys."""
    return np.cumsum(np.append(0, k[1:] != k[:-1])).astype(np.int64)


def merge(ranges: list[bytes]) -> list[tuple[int, int]]:
    """Maximal runs of the union."""
    r = np.concatenate([np.frombuffer(x, "<u4").reshape(-1, 2) for x in ranges]).astype(np.int64)
    r = r[np.argsort(r[:, 0], kind="stable")]
    far = np.maximum.accumulate(r[:, 1])
    at = np.flatnonzero(np.append(True, r[1:, 0] > far[:-1]))
    return list(zip(r[at, 0].tolist(), far[np.append(at[1:], len(r)) - 1].tolist(), strict=True))


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, rows = b.column(0), []
        for first, raw, offsets in buffers(b.column(1)):
            data = raw.tobytes()
            for i in range(len(offsets) - 1):
                t = data[offsets[i] : offsets[i + 1]]
                runs = merge(r) if (r := b.column(2)[first + i].as_py()) else []
                at, kept = 0, []
                for s, e in runs:
                    kept.append(t[at:s])
                    at = e
                kept.append(t[at:])
                rows.append((len(t), sum(e - s for s, e in runs), len(runs), b"".join(kept)))
        n, gone, spans, kept = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removed_ranges(base: DataFrame, scratch: Scratch) -> DataFrame:
    """``_k, ranges`` (list of packed byte ranges) for the documents of ``base(_k, text)`` that lose bytes."""
    parts = base.rdd.getNumPartitions()
    bits = max(1, (2 * parts - 1).bit_length())
    found = scratch.save(base.select("_k", "text").mapInArrow(partial(_find, bucket_bits=bits), FOUND), "anchors")
    again = found.where(F.col("kind") == ENTRIES).groupBy("bucket").applyInPandas(_again, FOUND)
    offs = again.union(found.where(F.col("kind") != ENTRIES)).groupBy("block").applyInPandas(_by_document, "_k long, offs binary")
    offs = scratch.save(offs, "offsets")
    scratch.drop("anchors")
    # Contexts are the largest rows of all: they are exchanged, but not written besides.
    contexts = base.select("_k", "text").join(offs, "_k").select("_k", "text", "offs").mapInArrow(partial(_contexts, bucket_bits=bits + FINER), FOUND)
    told = contexts.groupBy("bucket").applyInPandas(_bucket, "_k long, ranges binary")
    out = scratch.save(told.groupBy("_k").agg(F.collect_list("ranges").alias("ranges")), "ranges")
    scratch.drop("offsets")
    return out


def dedup(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs(doc_id, text)``."""
    scratch = scratch or Scratch(docs.sparkSession)
    base = keyed(docs.select("doc_id", "text"), scratch)
    ranges = removed_ranges(base, scratch)
    return base.join(ranges, "_k", "left").select("doc_id", "text", "ranges").mapInArrow(
        _cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
