"""Vectorised hashing over the bytes of a column of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Odd multipliers of the polynomial hashes modulo 2 ** 64.
BASE, WORD = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
#: Bytes of text that are hashed at once, unless one text is longer, and rows whose texts are copied at once.
AT_ONCE, ROWS_AT_ONCE = 1 << 18, 512


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit over all 64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2 ** 64 for ``i < n`` at least."""
    if base not in _powers or len(_powers[base]) < n:
        p = np.full(max(n, AT_ONCE + 1), base, U64)
        p[0] = 1
        with np.errstate(over="ignore"):
            p = np.cumprod(p)
        if n > 8 * AT_ONCE:
            return p
        _powers[base] = p
    return _powers[base]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def buffers(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` for runs of rows of about ``AT_ONCE`` bytes; null counts as empty."""
    for i in range(0, len(column), ROWS_AT_ONCE):
        part = pc.fill_null(column.slice(i, ROWS_AT_ONCE), "").cast(pa.large_string())
        if isinstance(part, pa.ChunkedArray):
            part = part.combine_chunks()
        n = len(part)
        _, offs, data = part.buffers()
        offsets = np.frombuffer(offs, np.int64)[part.offset : part.offset + n + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        row = 0
        while row < n:
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + AT_ONCE, side="right")) - 1)
            yield i + row, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
            row = end


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (ASCII lower case, white space apart) and the row it stands in."""
    n = len(raw)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    ink = ~_SPACE[raw]
    begin = ink.copy()
    begin[1:] &= ~ink[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    begin[heads] = ink[heads]
    start = np.flatnonzero(begin)
    stop = ink.copy()
    stop[:-1] &= ~ink[1:]
    tails = offsets[1:] - 1
    tails = tails[tails >= 0]
    stop[tails] = ink[tails]
    end = np.flatnonzero(stop) + 1
    total = np.zeros(n + 1, U64)
    np.cumsum((_LOWER[raw].astype(U64) + U64(1)) * powers(BASE, n)[:n], out=total[1:])
    h = (total[end] - total[start]) * powers(inverse(BASE), n + 1)[start]
    return mix(h), np.searchsorted(offsets, start, side="right") - 1


def shingles(raw: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles per row, sorted by (row, hash): row, hash and how often.

    A shingle is ``size`` words in a row; a text of fewer words, but at least one, is one shingle.
    """
    w, row = words(raw, offsets)
    n = len(offsets) - 1
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    m = len(w) - size + 1
    if m > 0:
        h = np.zeros(m, U64)
        for j in range(size):
            h = h * U64(WORD) + w[j : j + m]
        same = row[:m] == row[size - 1 :]
        h, at = mix(h[same]), row[:m][same]
    else:
        h, at = np.zeros(0, U64), np.zeros(0, np.int64)
    few = np.flatnonzero((count > 0) & (count < size))
    if len(few):
        short = np.array([int(np.bitwise_xor.reduce(mix(w[first[r] : first[r] + count[r]] + np.arange(1, count[r] + 1, dtype=U64)))) for r in few], U64)
        h, at = np.concatenate([h, short]), np.concatenate([at, few])
    order = np.lexsort((h, at))
    h, at = h[order], at[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
    pos = np.flatnonzero(new)
    return at[pos], h[pos], np.diff(np.append(pos, len(h)))
