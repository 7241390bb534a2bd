import hashlib

import numpy as np
import pytest

from siftwell.llm import suffixdedup
from tests.llm.conftest import words


def brute(rows, length=100):
    seen, out = set(), []
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")
    for d, t, *_ in sorted(rows, key=key):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, y in zip(b, gone) if not y)
        out.append((d, len(b), sum(gone), (b"\0" + bytes(gone)).count(b"\0\1"), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_matches_brute_force(spark, docs, rng):
    shared = [words(rng, n) for n in (16, 20, 30, 60)]
    rows = []
    for i in range(60):
        parts = [words(rng, rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), words(rng, rng.randint(0, 30))]
        rows.append((i, " ".join(parts), "s"))
    rows += [(100, "ab" * 300, "s"), (101, "ab" * 220 + "x", "s"), (102, "a" * 500, "s"), (103, rows[5][1], "s"), (104, rows[5][1][7:], "s"), (105, "é" * 120, "s")]
    got = sorted(map(tuple, suffixdedup.dedup(docs(rows).repartition(3)).collect()), key=repr)
    assert got == brute(rows)


def test_odd_rows(spark, docs, odd_rows):
    got = sorted(map(tuple, suffixdedup.dedup(docs(odd_rows)).collect()), key=repr)
    assert got == brute(odd_rows)


def test_empty_table(spark, docs):
    assert suffixdedup.dedup(docs([])).collect() == []


@pytest.mark.parametrize("alphabet", [1, 2, 30])
def test_intervals(alphabet):
    rng = np.random.default_rng(alphabet)
    text = rng.integers(97, 97 + alphabet, 700).astype(np.uint8)
    text = np.concatenate([text, text[100:400], [0]]).astype(np.uint8)
    order, low, high = suffixdedup.repeated_intervals(text, 100)
    raw, by = text.tobytes(), {}
    assert [raw[i:] for i in order] == sorted(raw[i:] for i in range(len(raw)))
    for i in range(len(raw) - 100 + 1):
        by.setdefault(raw[i : i + 100], set()).add(i)
    got = [{int(i) for i in order[a : b + 1] if i <= len(raw) - 100} for a, b in zip(low, high)]
    assert sorted(map(sorted, filter(lambda s: len(s) > 1, got))) == sorted(sorted(v) for v in by.values() if len(v) > 1)
