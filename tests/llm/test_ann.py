import numpy as np
from pyspark.sql import functions as F

from siftwell.llm import ann


def brute(vectors, queries, k):
    out = []
    for q in queries:
        a = vectors[q]
        s = []
        for j, b in vectors.items():
            if j != q:
                dot = aa = bb = 0.0
                for x, y in zip(a, b):
                    dot, aa, bb = dot + x * y, aa + x * x, bb + y * y
                s.append((-dot / (aa**0.5 * bb**0.5), j))
        out += [(q, r + 1, j, -v) for r, (v, j) in enumerate(sorted(s)[:k])]
    return sorted(out)


def test_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 16)).astype(np.float32)
    v[100:120] = v[0]
    v[200:220] = 3 * v[5]
    vectors = {i: [float(x) for x in r] for i, r in enumerate(v)}
    df = spark.createDataFrame([(i, r, 1) for i, r in vectors.items()], "vec_id long, embedding array<float>, rank int")
    got = sorted(map(tuple, ann.search(df, F.col("vec_id") % 10 == 0, 5, query_block=7, candidate_block=40).collect()))
    assert got == brute(vectors, range(0, 300, 10), 5)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (6, [1.0, 1.0]), (7, [1.0]), (None, [1.0, 0.0]), (50, [0.5, 0.0]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, ann.search(df, F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id").collect()))
    assert got == [(0, 1, 50), (0, 2, 6), (50, 1, 0), (50, 2, 6)]
    both = df.union(spark.createDataFrame([(100, [2.0]), (101, [-1.0])], "vec_id long, embedding array<double>"))
    got = sorted(map(tuple, ann.search(both, F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id").collect()))
    assert got == [(0, 1, 50), (0, 2, 6), (50, 1, 0), (50, 2, 6), (100, 1, 7), (100, 2, 101)]
    assert ann.search(df.where("vec_id = 1"), F.col("vec_id") % 50 == 0).collect() == []
    assert ann.search(df.where("vec_id = 0"), F.col("vec_id") % 50 == 0).collect() == []


def test_many_components(spark):
    rng = np.random.default_rng(2)
    v = np.abs(rng.normal(size=(40, 1500)))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, ann.search(df, F.col("vec_id") % 20 == 0, 3).collect()))
    assert got == brute({i: [float(x) for x in r] for i, r in enumerate(v)}, (0, 20), 3)
