"""Vector functions over arrays of floats or doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalise(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(doubles(v), lambda x: x / F.when(n == 0, 1.0).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 with a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / F.when(n == 0, 1.0).otherwise(n))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def certainty(cos: Column) -> Column:
    return (1 + cos) / 2


def expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def unit_score(score: Column, cosine_like: bool) -> Column:
    """To the unit interval: ``(s + 1) / 2`` for cosines, else a logistic of ``s / 100``."""
    return (score + 1) / 2 if cosine_like else expit(score / 100)


def truncate(v: Column, dim: int) -> Column:
    """The first ``dim`` components, renormalised. ``dim`` is at least 32."""
    if dim < 32:
        raise ValueError("dim must be at least 32")
    return normalise(F.slice(v, 1, dim))


def axpy(a: Column | float, x: Column, y: Column) -> Column:
    k = a if isinstance(a, Column) else F.lit(float(a))
    return F.zip_with(doubles(x), doubles(y), lambda p, q: k * p + q)


def project_out(g: Column, r: Column) -> Column:
    """``g`` without its component along ``r`` where the two conflict (negative dot product); else ``g``."""
    d, n = dot(g, r), dot(r, r)
    k = F.when((d < 0) & (n > 0), -d / F.when(n == 0, 1.0).otherwise(n)).otherwise(0.0)
    return axpy(k, r, g)


def finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def pooled(tokens: Column, mask: Column, how: str) -> Column:
    """Pool token vectors (array of arrays) under a 0/1 mask: mean, max, cls or last."""
    kept = F.transform(F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda z: z["m"] == 1), lambda z: doubles(z["t"]))
    if how == "cls":
        return doubles(tokens[0])
    if how == "last":
        return F.element_at(kept, -1)
    zero = lambda x: F.transform(kept[0], lambda _: F.lit(x))
    if how == "max":
        return F.aggregate(kept, zero(float("-inf")), lambda s, x: F.zip_with(s, x, lambda a, b: F.greatest(a, b)))
    if how == "mean":
        total = F.aggregate(kept, zero(0.0), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
        return F.transform(total, lambda x: x / F.size(kept))
    raise ValueError(f"unknown pooling {how!r}")
