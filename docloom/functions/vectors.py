"""Vector expressions over arrays: norms, distances, truncation, quantisation, hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column | str) -> Column:
    """Unit vector; null for a zero vector."""
    v = F.col(v) if isinstance(v, str) else v
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


def truncated(v: Column | str, dim: int) -> Column:
    """The first ``dim`` components as a unit vector (Matryoshka truncation)."""
    return normalised(F.slice(v, 1, dim))


def l2(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance, the default metric of the vector index."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def int8(v: Column | str) -> Column:
    """Components of a unit vector as signed bytes: (x + 1) / 2 of the range of 255, cut off at its ends, less 128."""
    return F.transform(v, lambda x: F.floor(F.least(F.greatest((x.cast("double") + 1) / 2 * 255, F.lit(0.0)), F.lit(255.0)) - 128 + F.lit(0.0)).cast("tinyint"))


def hashed_terms(terms: Column | str, dim: int = 64) -> Column:
    """A deterministic embedding: counts of terms in ``dim`` cells by hash, unit length."""
    cells = F.transform(terms, lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(cells, lambda c: c == i)).cast("double"))
    return normalised(counts)
