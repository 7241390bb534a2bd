"""Identifiers: built-in expressions, or pandas UDFs over Arrow batches where there are none."""

from __future__ import annotations

import hashlib
import math
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType

#: Fixed namespace of name-based ids.
NAMESPACE = uuid.NAMESPACE_DNS

_M = (1 << 64) - 1


def _rotl(x: int, r: int) -> int:
    return ((x << r) | (x >> (64 - r))) & _M


def _fmix(k: int) -> int:
    # Finaliser constants of the public 128-bit x64 hash.
    for shift, mult in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        k = ((k ^ (k >> shift)) * mult) & _M
    return k ^ (k >> 33)


def murmur3_128(data: bytes, seed: int = 0) -> int:
    """MurmurHash3 x64 128 as one unsigned integer, the first half lowest."""
    c1, c2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
    h1 = h2 = seed
    n = len(data) // 16
    for i in range(n):
        k1 = int.from_bytes(data[16 * i : 16 * i + 8], "little")
        k2 = int.from_bytes(data[16 * i + 8 : 16 * i + 16], "little")
        h1 ^= (_rotl((k1 * c1) & _M, 31) * c2) & _M
        h1 = ((_rotl(h1, 27) + h2) * 5 + 0x52DCE729) & _M
        h2 ^= (_rotl((k2 * c2) & _M, 33) * c1) & _M
        h2 = ((_rotl(h2, 31) + h1) * 5 + 0x38495AB5) & _M
    tail = data[16 * n :]
    if len(tail) > 8:
        h2 ^= (_rotl((int.from_bytes(tail[8:], "little") * c2) & _M, 33) * c1) & _M
    if tail:
        h1 ^= (_rotl((int.from_bytes(tail[:8], "little") * c1) & _M, 31) * c2) & _M
    h1, h2 = h1 ^ len(data), h2 ^ len(data)
    h1 = (h1 + h2) & _M
    h2 = (h2 + h1) & _M
    h1, h2 = _fmix(h1), _fmix(h2)
    h1 = (h1 + h2) & _M
    h2 = (h2 + h1) & _M
    return h2 << 64 | h1


@F.pandas_udf(StringType())
def content_id(text: pd.Series) -> pd.Series:
    """Hex of the 128-bit hash of a text, not zero-padded."""
    return text.map(lambda t: None if t is None else f"{murmur3_128(t.encode('utf-8')):02x}")


def name_uuid(name: Column) -> Column:
    """UUID of version 5: SHA-1 of the namespace and the name, with version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE.hex)), F.encode(name, "UTF-8")))
    part = lambda start, n: F.substring(h, start, n)
    # The two highest bits of the 17th digit are the variant.
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


@F.pandas_udf(LongType())
def stable_key(text: pd.Series) -> pd.Series:
    """63-bit key from an 8-byte BLAKE2b digest."""
    return text.map(lambda t: None if t is None else int.from_bytes(hashlib.blake2b(t.encode("utf-8"), digest_size=8).digest(), "big") & 0x7FFFFFFFFFFFFFFF)


@F.pandas_udf(DoubleType())
def gamma(x: pd.Series) -> pd.Series:
    return x.map(math.gamma)


@F.pandas_udf(DoubleType())
def beta(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([math.gamma(x) * math.gamma(y) / math.gamma(x + y) for x, y in zip(a, b, strict=True)])
