"""Vector arithmetic on array columns, within code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def cosine(a: Column, b: Column) -> Column:
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(0.0)


def unit(x: Column) -> Column:
    length = norm(x)
    return F.when(length > 0, F.transform(x, lambda v: v / length)).otherwise(x)


def truncated(x: Column, n: int) -> Column:
    """The first ``n`` dimensions, of length one again."""
    return unit(F.slice(x, 1, n))


def sign_bits(x: Column, mean: Column) -> Column:
    """Bit ``d`` is set where component ``d`` is over the mean; 64 dimensions as one long."""
    over = F.zip_with(x, mean, lambda v, m: (v > m).cast("long"))
    return F.aggregate(F.transform(over, lambda bit, d: F.call_function("shiftleft", bit, d)), F.lit(0).cast("long"), lambda a, v: a.bitwiseOR(v))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def asymmetric(query: Column, bits: Column) -> Column:
    """Score of a float query against sign bits: ``(cos + 1) / 2``; 0.5 for a zero query."""
    signed = F.transform(query, lambda q, d: F.when(F.call_function("shiftright", bits, d).bitwiseAND(F.lit(1)) == 1, q).otherwise(-q))
    length = norm(query) * F.sqrt(F.size(query))
    return F.when(length > 0, (total(signed) / length + 1) / 2).otherwise(0.5)


def signs(bits: Column, n: int = 64) -> Column:
    """Sign bits as ``n`` components of 1 or -1."""
    return F.when(bits.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda d: F.when(F.call_function("shiftright", bits, d).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0)))


def views(x: Column, mean: Column, scale: Column, n: int = 16) -> Column:
    """Sign bits at ``n`` thresholds around the mean, ``(i / (n - 1) - 0.5) * scale`` apart."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: sign_bits(x, F.zip_with(mean, scale, lambda m, s: m + (i / (n - 1) - 0.5) * s)))
