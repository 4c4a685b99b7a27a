"""Vectors as arrays, hashes as 64-bit numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """0 if the lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), total).otherwise(0.0)


def sign_bits(v: Column) -> Column:
    """The signs of the first 64 values as one number: bit i is set if value i is above 0."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda s, i: s.bitwiseOR(F.when(F.get(v, i) > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))))


def hex_bits(h: Column) -> Column:
    """16 hex digits as a number; null if they are not."""
    return F.when(h.rlike("^[0-9a-fA-F]{16}$"), F.conv(h, 16, -10).cast("bigint"))


def hamming(a: Column, b: Column) -> Column:
    """64 if either is not a hash."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(64))


def hash_similarity(a: Column, b: Column) -> Column:
    """1 for equal hashes, 0 for opposite ones or where either is none, to 4 places."""
    return F.round(1 - hamming(a, b) / 64, 4)


def normalised(v: Column) -> Column:
    """At length 1; a null vector is divided by 1e-12."""
    length = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(length > 0, length).otherwise(1e-12))
