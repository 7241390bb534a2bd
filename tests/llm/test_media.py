import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from siftwell.llm import media


@pytest.mark.parametrize("n", [0, 1, 5, 576, 5000, 60000])
@pytest.mark.parametrize("alphabet", [1, 2, 50, 256])
def test_codecs(n, alphabet):
    rng = random.Random(n + alphabet)
    raw = bytes(rng.randrange(alphabet) for _ in range(n))
    assert media.unlzw(media.lzw(raw), n) == raw == slow_unlzw(media.lzw(raw))
    assert media.unpackbits(media.packbits(raw), n) == raw


def slow_unlzw(data):
    """Bit by bit, strings in a dictionary."""
    bits, at, out = "".join(f"{b:08b}" for b in data), 0, b""
    table, width, last = {}, 9, None
    while True:
        code, at = int(bits[at : at + width], 2), at + width
        if code == 257:
            return out
        if code == 256:
            table, width, last = {i: bytes([i]) for i in range(256)}, 9, None
            continue
        if last is None:
            last = table[code]
        else:
            s = table.get(code, last + last[:1])
            table[len(table) + 2] = last + s[:1]
            last = s
        out += last
        n = len(table) + 2
        width = 9 if n < 511 else 10 if n < 1023 else 11 if n < 2047 else 12


def codes(*pairs):
    """Codes of given widths as bytes, most significant bit first."""
    bits = "".join(f"{c:0{w}b}" for c, w in pairs)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def test_published_examples():
    """The examples of the TIFF 6.0 specification (LZW) and of the PackBits note."""
    raw = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    stored = codes(*((c, 9) for c in (256, 7, 258, 8, 8, 258, 6, 6, 257)))
    assert media.lzw(raw) == stored and media.unlzw(stored, len(raw)) == raw
    packed = bytes.fromhex("FE AA 02 80 00 2A FD AA 03 80 00 2A 22 F7 AA")
    assert media.unpackbits(packed, 24) == bytes.fromhex("AA AA AA 80 00 2A AA AA AA AA 80 00 2A 22 AA AA AA AA AA AA AA AA AA AA")


def test_codes_that_are_not_known():
    for bad in (codes((256, 9), (300, 9)), codes((256, 9), (65, 9), (260, 9)), codes((258, 9))):
        with pytest.raises(ValueError):
            media.unlzw(bad, 100)
    # No clear code at the start, one in the middle, and none at the end.
    assert media.unlzw(codes((65, 9), (258, 9), (256, 9), (66, 9)), 9) == b"AAAB"


@pytest.mark.parametrize("length", [0, 2, 600, 5000, 100_000])
def test_every_mode_at_every_length(length):
    seen = set()
    for seed in range(80 if length < 9999 else 40):
        payload = media.payload_of(random.Random(seed).randbytes(length // 2) + b"ab" * (length // 4))
        assert b"".join(p.tobytes() for p in media.read_pages(media.store(payload))) == payload
        seen.add(zlib.crc32(payload) % len(media.MODES))
    assert len(seen) > 7 or length == 0


def one_page(**put):
    tags = {256: (3, 2), 257: (3, 1), 258: (3, 8), 259: (3, 1), 273: (4, 8), 277: (3, 1), 278: (3, 1), 279: (4, 2)} | put.get("tags", {})
    data = bytearray(b"II" + struct.pack("<HI", 42, 10) + b"\x07\x09" + struct.pack("<H", len(tags)))
    for t, (k, v) in sorted(tags.items()):
        data += struct.pack("<HHI", t, k, 1) + (struct.pack("<HH", v, 0) if k == 3 else struct.pack("<I", v))
    return bytes(data + struct.pack("<I", 0))


@pytest.mark.parametrize("tags", [{}, {258: (3, 16)}, {258: (3, 1)}, {284: (3, 2)}, {266: (3, 2)}, {317: (3, 3)}, {259: (3, 7)}, {256: (4, 1 << 31), 257: (4, 1 << 31)}, {257: (3, 2)}, {279: (4, 1)}, {278: (3, 0), 257: (3, 0)}])
def test_refused_pages(spark, tags):
    df = spark.createDataFrame([(1, bytearray(one_page(tags=tags)))], "key long, media binary")
    got = media.pages(df, "key", "media").collect()
    assert [bytes(r["samples"]) for r in got] == ([] if tags else [b"\x07\x09"])


@pytest.mark.parametrize("how", [media.NONE, media.LZW, media.PACKBITS, media.DEFLATE])
def test_pages_round_trip(how):
    rng = np.random.default_rng(how)
    pages = [{"samples": rng.integers(0, 9, (h, w), np.uint8), "compression": how, "predictor": p, "tiled": t} for h, w in ((1, 1), (24, 24), (50, 70), (300, 576)) for p in (1, 2) for t in (True, False)]
    back = list(media.read_pages(media.write_tiff(pages)))
    assert len(back) == len(pages) and all((a["samples"] == b).all() for a, b in zip(pages, back))


def test_big_endian():
    data = bytearray(b"MM" + struct.pack(">HI", 42, 8))
    tags = [(256, 3, 2), (257, 3, 1), (258, 3, 8), (259, 3, 1), (273, 4, 8 + 2 + 7 * 12 + 4), (278, 3, 1), (279, 4, 2)]
    data += struct.pack(">H", len(tags))
    for t, k, v in tags:
        data += struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v))
    data += struct.pack(">I", 0) + b"\x07\x09"
    assert [p.tolist() for p in media.read_pages(bytes(data))] == [[[7, 9]]]


def test_digest_against_brute_force(spark, docs, odd_rows):
    rows = odd_rows + [(7, "x" * 576, "a"), (8, "y" * 577, "a"), (9, "z" * 300_000, "a"), (10, "long text é " * 9000, "b")]
    want = []
    for i, t, _ in rows:
        raw = (t or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        n = -(-len(p) // (576 * media.PAGE_ROWS))
        want.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), f"pages={n};samples={len(p)};sum={sum(p)};min={min(p)};max={max(p)};padded={len(p) - len(raw)}"))
    got = media.digest(docs(rows)).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["feature"]) for r in got), key=repr) == sorted(want, key=repr)
    files = {hashlib.sha256(f := media.store(media.payload_of((t or "").encode()))).hexdigest(): len(f) for _, t, _ in rows}
    assert all(files[r["media_sha256"]] == r["media_bytes"] for r in got)
    assert media.digest(docs([])).collect() == []


def test_rows_per_page(spark):
    data = media.store(bytes(range(256)) * 9 * 576)
    df = spark.createDataFrame([(1, bytearray(data), "x"), (2, None, "x"), (3, bytearray(b"II*\0junk"), "x"), (4, bytearray(b""), "x")], "id long, media binary, page string")
    got = media.pages(df, "id", "media").orderBy("page").collect()
    assert {r["key"] for r in got} == {1} and [r["page"] for r in got] == list(range(len(got)))
    assert b"".join(bytes(r["samples"]) for r in got) == bytes(range(256)) * 9 * 576
