"""Vector arithmetic as Column expressions, on array<float> or array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a norm is 0; vectors of different lengths are an error."""
    same = F.when(F.size(a) == F.size(b), dot(a, b)).otherwise(F.raise_error(F.lit("vectors of different lengths")).cast("double"))
    return F.coalesce(F.try_divide(same, norm(a) * norm(b)), F.lit(0.0))


def unit(a: Column) -> Column:
    """The vector over its norm, as doubles; zeros stay zeros."""
    return F.transform(a, lambda x: F.coalesce(F.try_divide(x.cast("double"), norm(a)), F.lit(0.0)))


def sign_bits(a: Column) -> Column:
    """array<bigint>: one bit an element, set where it is positive, 32 a number."""
    words = F.ceil(F.size(a) / 32).cast("int")
    return F.transform(F.sequence(F.lit(0), words - 1), lambda w: F.aggregate(
        F.transform(F.slice(a, w * 32 + 1, F.lit(32)), lambda x, i: F.when(x > 0, F.shiftleft(F.lit(1).cast("long"), 0) * F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"), lambda s, x: s + x))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x).cast("long")
