from collections import defaultdict

import duckdb

from siftwell.llm import sharding
from siftwell.llm.sql import op3
from verify import rows as canonical


def test_shards_fit_and_split_only_when_over(spark, docs, rng):
    rows = [(i, "x" * rng.randint(0, 200), "s") for i in range(400)] + [(1000, "y" * 5000, "s")]
    got = sharding.shard(docs(rows), limit=1500).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    size, n = defaultdict(int), defaultdict(int)
    for r in got:
        size[r["depth"], r["prefix"]] += r["n_bytes"]
        n[r["depth"], r["prefix"]] += 1
    assert all(size[r["depth"], r["prefix"]] == r["shard_bytes"] for r in got)
    assert all(b <= 1500 or n[k] == 1 for k, b in size.items())
    # A bucket and its buddy are never both small enough to have stayed one.
    for (d, p), b in size.items():
        if d:
            parent = sum(x for (e, q), x in size.items() if e >= d - 1 and q >> (e - d + 1) == p >> 1)
            assert parent > 1500


def test_repeated_rows(spark, docs):
    got = sharding.shard(docs([(7, "z" * 100, "s")] * 50 + [(1, None, "s")]), limit=1000).collect()
    parts = defaultdict(int)
    for r in got:
        parts[r["depth"], r["prefix"], r["part"]] += r["n_bytes"]
    assert len(got) == 51 and max(parts.values()) <= 1000


def test_odd_rows(spark, docs, odd_rows):
    assert sharding.shard(docs(odd_rows), limit=4000).count() == len(odd_rows)
    assert sharding.shard(docs([])).collect() == []


def test_same_as_sql_where_buckets_split(spark, docs, rng):
    table = docs([(i, "x" * int(rng.paretovariate(0.8)), "s") for i in range(600)] + [(700, None, "s"), (701, "", "s")])
    con = duckdb.connect()
    con.register("documents", table.toPandas())
    got, want = sharding.shard(table, limit=900).toPandas(), con.execute(op3(900)).fetchdf()
    assert got["depth"].nunique() > 3
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)
