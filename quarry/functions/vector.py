"""Functions of vectors; all sums are in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null if a vector has no length."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def score(distance: Column) -> Column:
    """A missing distance counts as 1."""
    return 1.0 / (1.0 + F.coalesce(distance, F.lit(1.0)))


def verdict(similarity: Column) -> Column:
    """struct(status, risk): above 0.6 fact; from 0.3 fact at high risk; else rejected."""
    return F.struct(
        F.when(similarity >= 0.3, "FACT").otherwise("REJECTED").alias("status"),
        F.when((similarity >= 0.3) & (similarity <= 0.6), "HIGH").alias("risk"),
    )


def hashed_embedding(text: Column, dims: int = 64) -> Column:
    """A stand-in for a learned model: words fall on signed places by hash; unit length."""
    words = F.filter(F.split(F.lower(text), r"[^\p{Alnum}]+", -1), lambda w: w != "")
    place = lambda w: F.pmod(F.xxhash64(w), F.lit(dims))
    sign = lambda w: F.when(F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.aggregate(words, F.lit(0.0), lambda a, w: a + F.when(place(w) == d, sign(w)).otherwise(0.0)))
    return F.transform(raw, lambda x: x / F.greatest(F.sqrt(dot(raw, raw)), F.lit(1e-12)))
