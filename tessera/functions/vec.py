"""Vectors as ARRAY<FLOAT|DOUBLE> columns; arithmetic in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def finite(v: Column) -> Column:
    """True if the vector has entries and each is a number."""
    return (F.size(v) > 0) & F.forall(doubles(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def normalized(v: Column) -> Column:
    """Unit vector; null for empty, non-finite or (near) zero vectors."""
    return F.when(finite(v) & (norm(v) > EPS), F.transform(doubles(v), lambda x: x / norm(v)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity with the denominator damped by 1e-8; null for degenerate vectors."""
    return F.when(finite(a) & finite(b) & (norm(a) > EPS) & (norm(b) > EPS), dot(a, b) / (norm(a) * norm(b) + EPS))


def distance(a: Column, b: Column) -> Column:
    """1 - dot, the dot product held to [-1, 1]."""
    return 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))


def median_of(v: Column) -> Column:
    n = F.size(v)
    middle = F.transform(F.array(F.array_sort(doubles(v))), lambda s: (F.element_at(s, ((n + 1) / 2).cast("int")) + F.element_at(s, (n / 2 + 1).cast("int"))) / 2)  # sorted once
    return F.when(n > 0, F.element_at(middle, 1))


def hamming(a: Column, b: Column) -> Column:
    """Mean differing bits over the common prefix of two hash lists; 999 if either is empty."""
    n = F.least(F.size(a), F.size(b))
    d = F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return F.when(F.coalesce(n, F.lit(0)) <= 0, F.lit(999.0)).otherwise(d / n)


def hash_bits(v: Column) -> Column:
    """As sign_hash, in two 32-bit halves: exact without decimals. The median is found once, not for every entry."""
    half = lambda at, m: F.aggregate(F.slice(v.cast("array<double>"), at, 32), F.lit(0).cast("bigint"), lambda s, x: s * 2 + F.when(x > m, 1).otherwise(0))
    bits = F.transform(F.array(median_of(F.slice(v, 2, F.size(v) - 1))), lambda m: F.shiftleft(half(1, m), 32).bitwiseOR(half(33, m)))
    return F.element_at(bits, 1)


def bhattacharyya(a: Column, b: Column) -> Column:
    """Histogram distance, 0 to 100."""
    total = lambda h: F.aggregate(doubles(h), F.lit(0.0), lambda s, x: s + x)
    mixed = F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: F.sqrt(x * y)), F.lit(0.0), lambda s, x: s + x)
    return 100 * F.sqrt(F.greatest(F.lit(0.0), 1 - mixed / F.sqrt(total(a) * total(b))))
