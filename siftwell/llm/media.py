"""Media columns: TIFF files walked directory by directory, one row per page.

Reads both byte orders, strips and tiles, 8-bit grey or multi-sample chunky pages without
compression or with PackBits, LZW or deflate, and undoes horizontal differencing. The
writer makes grey pages for round trips; a payload's pages take all codecs, layouts and
predictors in turn, whatever its length.

Defined cases: a null or malformed file gives no page, nor does one with a page that the reader refuses (samples
other than 8 bits, separate planes, reversed bits, unknown compression or predictor, missing or short strips and tiles, sizes
beyond what the stored bytes can expand to); an empty payload is stored as one padding unit; equal payloads
give equal files, repeated rows equal rows; a very long payload is many pages of bounded size; an empty table gives no
rows. Only the named columns are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# TIFF tags, field types by size, and compression codes.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, FILL_ORDER, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANES = 256, 257, 258, 259, 262, 266, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
TYPES = {1: "B", 2: "B", 3: "H", 4: "I", 16: "Q"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773

#: A payload is whole units of 576 bytes: one row of a page in strips, nine of a page in tiles, which have sides of 32 (the format asks for a multiple of 16).
UNIT, TILED_COLUMNS, TILE = 576, 64, 32
#: Rows of one page and of one strip at most; so a page is a bounded piece of a long payload.
PAGE_ROWS, STRIP_ROWS = 72, 24
#: What a page can be: compression, predictor, tiled. Differences gain nothing under PackBits, which no reader expects there.
MODES = (*((PACKBITS, 1, t) for t in (False, True)), *((how, p, t) for how in (LZW, DEFLATE) for p in (1, 2) for t in (False, True)))
#: Bytes that one stored byte can become at most: 2730 by LZW (a code of 12 bits for 4095 bytes), 1032 by deflate.
EXPANDS = 4096
CLEAR, END = 256, 257
_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def packbits(raw: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(piece: bytes) -> None:
        for i in range(0, len(piece), 128):
            out.append(len(piece[i : i + 128]) - 1)
            out.extend(piece[i : i + 128])

    for m in _RUN.finditer(raw):
        literal(raw[at : m.start()])
        out.append(257 - (m.end() - m.start()))
        out.append(raw[m.start()])
        at = m.end()
    literal(raw[at:])
    return bytes(out)


def unpackbits(data: bytes, most: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < most:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n == 128:
            i += 1
        else:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


#: Bits of codes that are put together or taken apart at once.
AT_ONCE = 512


def lzw(raw: bytes) -> bytes:
    """Variable codes of 9 to 12 bits, most significant bit first, widening one code early."""
    out, acc, bits, width = bytearray(), CLEAR, 9, 9
    codes, new, widen, w = {}, 258, 512, raw[0] if raw else -1
    known = codes.get

    def whole(acc: int, bits: int) -> int:
        out.extend((acc >> (bits & 7)).to_bytes(bits >> 3, "big"))
        return acc & ((1 << (bits & 7)) - 1)

    for c in raw[1:]:
        # A known string is (code of all but its last byte, last byte).
        key = w << 8 | c
        if (n := known(key)) is not None:
            w = n
            continue
        acc, bits = acc << width | w, bits + width
        codes[key] = new
        new += 1
        if new == widen:
            width, widen = width + 1, widen * 2
        elif new == 4094:
            acc, bits = acc << width | CLEAR, bits + width
            codes, new, widen, width = {}, 258, 512, 9
            known = codes.get
        if bits >= AT_ONCE:
            acc, bits = whole(acc, bits), bits & 7
        w = c
    if w >= 0:
        acc, bits = acc << width | w, bits + width
        width += new + 1 == widen
    acc, bits = acc << width | END, bits + width
    whole(acc << (-bits & 7), bits + (-bits & 7))
    return bytes(out)


_BYTES = [bytes([i]) for i in range(256)] + [b"", b""]


def unlzw(data: bytes, most: int) -> bytes:
    """The first ``most`` bytes at least, or all. A code that is not yet known is an error."""
    out, have, table, size, width, widen, prev = [], 0, _BYTES[:], 258, 9, 511, None
    acc = bits = at = 0
    while have < most:
        if bits < width:
            piece = data[at : at + AT_ONCE // 8]
            acc = (acc & ((1 << bits) - 1)) << 8 * len(piece) | int.from_bytes(piece, "big")
            bits, at = bits + 8 * len(piece), at + len(piece)
            if bits < width:
                break
        bits -= width
        code = acc >> bits & ((1 << width) - 1)
        if code < size and code not in (CLEAR, END):
            entry = table[code]
        elif code == CLEAR:
            table, size, width, widen, prev = _BYTES[:], 258, 9, 511, None
            continue
        elif code == END:
            break
        elif code == size and prev is not None:
            entry = prev + prev[:1]
        else:
            raise ValueError("unknown code")
        if prev is not None and size < 4096:
            table.append(prev + entry[:1])
            size += 1
            if size == widen and width < 12:
                width, widen = width + 1, widen * 2 + 1
        out.append(entry)
        have += len(entry)
        prev = entry
    return b"".join(out)


def _encode(raw: bytes, how: int) -> bytes:
    return {NONE: bytes, PACKBITS: packbits, LZW: lzw, DEFLATE: lambda x: zlib.compress(x, 1)}[how](raw)


def _decode(data: bytes, how: int, most: int) -> bytes:
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, max(1, most))
    return {NONE: lambda d, n: d, PACKBITS: unpackbits, LZW: unlzw}[how](data, most)


def write_tiff(pages: list[dict]) -> bytes:
    """A little-endian file. A page has ``samples`` (2-D uint8), ``compression``, ``predictor`` (1 or 2) and ``tiled``."""
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4
    for p in pages:
        a = np.ascontiguousarray(p["samples"], np.uint8)
        rows, cols = a.shape
        if p["tiled"]:
            down, across = -(-rows // TILE), -(-cols // TILE)
            full = np.zeros((down * TILE, across * TILE), np.uint8)
            full[:rows, :cols] = a
            blocks = [b for r in full.reshape(down, TILE, across, TILE).transpose(0, 2, 1, 3) for b in r]
        else:
            step = STRIP_ROWS
            blocks = [a[i : i + step] for i in range(0, rows, step)]
        offsets, counts = [], []
        for b in blocks:
            if p["predictor"] == 2:
                b = np.diff(b, axis=1, prepend=np.zeros((len(b), 1), np.uint8))
            data = _encode(b.tobytes(), p["compression"])
            offsets.append(len(out))
            counts.append(len(data))
            out += data
        tags = [(WIDTH, 4, [cols]), (LENGTH, 4, [rows]), (BITS, 3, [8]), (COMPRESSION, 3, [p["compression"]]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [p["predictor"]])]
        tags += [(TILE_WIDTH, 4, [TILE]), (TILE_LENGTH, 4, [TILE]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if p["tiled"] else [(ROWS_PER_STRIP, 4, [step]), (STRIP_OFFSETS, 4, offsets), (STRIP_COUNTS, 4, counts)]
        fields = b""
        for tag, kind, values in sorted(tags):
            data = struct.pack(f"<{len(values)}{TYPES[kind]}", *values)
            if len(data) > 4:
                data, where = struct.pack("<I", len(out)), data
                out += where
            fields += struct.pack("<HHI4s", tag, kind, len(values), data.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        link = len(out) + 2 + len(fields)
        out += struct.pack("<H", len(tags)) + fields + b"\0\0\0\0"
    return bytes(out)


def read_pages(data: bytes) -> Iterator[np.ndarray]:
    """Samples of each page, as ``(rows, columns * samples)`` uint8. Walks the chain of directories; a cycle ends it."""
    e = {b"II": "<", b"MM": ">"}.get(data[:2])
    if e is None or struct.unpack_from(e + "H", data, 2)[0] != 42:
        return
    at, seen = struct.unpack_from(e + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(e + "H", data, at)
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(e + "HHI", data, at + 2 + 12 * i)
            if kind in TYPES:
                fmt = f"{e}{count}{TYPES[kind]}"
                place = at + 10 + 12 * i
                if struct.calcsize(fmt) > 4:
                    (place,) = struct.unpack_from(e + "I", data, place)
                tags[tag] = struct.unpack_from(fmt, data, place)
        (at,) = struct.unpack_from(e + "I", data, at + 2 + 12 * n)
        yield _page(data, tags)


def _page(data: bytes, tags: dict[int, tuple[int, ...]]) -> np.ndarray:
    one = lambda t, d=None: tags.get(t, (d,))[0]
    rows, cols, per = one(LENGTH), one(WIDTH), one(SAMPLES, 1)
    how, predictor = one(COMPRESSION, NONE), one(PREDICTOR, 1)
    if set(tags.get(BITS, (1,))) != {8} or one(PLANES, 1) != 1 or one(FILL_ORDER, 1) != 1 or predictor not in (1, 2):
        raise ValueError("a kind of page that is not read")
    if TILE_OFFSETS in tags:
        th, tw = one(TILE_LENGTH), one(TILE_WIDTH)
        offsets, counts = tags[TILE_OFFSETS], tags[TILE_COUNTS]
        n, places = -(-rows // th) * -(-cols // tw), ((r, c, th, tw) for r in range(0, rows, th) for c in range(0, cols, tw))
    else:
        step = min(rows, one(ROWS_PER_STRIP, rows)) or 1
        offsets, counts = tags[STRIP_OFFSETS], tags[STRIP_COUNTS]
        n, places = -(-rows // step), ((r, 0, min(step, rows - r), cols) for r in range(0, rows, step))
    if len(offsets) != n or len(counts) != n or rows * cols * per > EXPANDS * sum(counts) or sum(counts) > len(data) * n:
        raise ValueError("more samples than the file holds")
    page = np.zeros((rows, cols * per), np.uint8)
    for offset, count, (r, c, h, w) in zip(offsets, counts, places, strict=True):
        if h * w * per > EXPANDS * count:
            raise ValueError("more samples than the block holds")
        block = np.frombuffer(_decode(data[offset : offset + count], how, h * w * per), np.uint8)[: h * w * per].reshape(h, w, per)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        part = block[: rows - r, : cols - c].reshape(min(h, rows - r), -1)
        page[r : r + len(part), c * per : c * per + part.shape[1]] = part
    return page


def store(payload: bytes) -> bytes:
    """A payload of whole units as a file of pages. Each page takes the mode after the last one's; the first one's is given by the payload's checksum."""
    a = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    start = zlib.crc32(payload)
    modes = (MODES[(start + k) % len(MODES)] for k in range(0, len(a)))
    return write_tiff([{"samples": a[i : i + PAGE_ROWS].reshape(-1, TILED_COLUMNS if t else UNIT), "compression": how, "predictor": p, "tiled": t} for i, (how, p, t) in zip(range(0, len(a), PAGE_ROWS), modes, strict=False)])


def payload_of(text: bytes) -> bytes:
    units = max(1, -(-len(text) // UNIT))
    return text.ljust(units * UNIT, b"\xff")


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            raw = text.encode("utf-8") if isinstance(text, str) else b""
            media = store(payload_of(raw))
            pages = list(read_pages(media))
            back = b"".join(p.tobytes() for p in pages)
            x = np.frombuffer(back, np.uint8)
            feature = f"pages={len(pages)};samples={len(x)};sum={int(x.sum(dtype=np.int64))};min={x.min()};max={x.max()};padded={len(back) - len(raw)}"
            rows.append((doc_id, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        yield pd.DataFrame(rows, columns=DIGEST_COLUMNS).astype({"doc_id": "Int64"})


DIGEST_COLUMNS = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
DIGEST_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(docs: DataFrame) -> DataFrame:
    """Every text stored as a file, read back page by page and described."""
    return docs.select("doc_id", "text").mapInPandas(_digest, DIGEST_SCHEMA)


def _pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for key, data in zip(pdf["key"], pdf["media"], strict=True):
            try:
                found = list(read_pages(bytes(data))) if data is not None else []
            except (struct.error, zlib.error, KeyError, IndexError, ValueError, TypeError, ZeroDivisionError, OverflowError, MemoryError):
                found = []
            rows += [(key, i, p.shape[0], p.shape[1], p.tobytes()) for i, p in enumerate(found)]
        yield pd.DataFrame(rows, columns=["key", "page", "height", "width", "samples"]).astype({"key": "Int64"})


def pages(df: DataFrame, key: str, media: str) -> DataFrame:
    """One row per page of the files in a binary column: key, page, height, width (samples of a row), samples."""
    from pyspark.sql import functions as F

    return df.select(F.col(key).cast("long").alias("key"), F.col(media).alias("media")).mapInPandas(
        _pages, "key long, page int, height int, width int, samples binary"
    )
