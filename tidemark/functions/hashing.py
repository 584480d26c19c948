"""Perceptual-hash and digest expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit patterns; the sign bit counts like any other."""
    return F.bit_count(a.bitwiseXOR(b))


def _packed(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda h, b: F.shiftleft(h, 1).bitwiseOR(b.cast("bigint")))


def gradient_hash(pixels: Column, rows: int = 8, columns: int = 9, rising: bool = True) -> Column:
    """X25 (right > left) and X26 (left > right) of rows x columns grey values, row by row."""
    at = F.sequence(F.lit(0), F.lit(rows * (columns - 1) - 1))

    def bit(i: Column) -> Column:
        left = F.floor(i / (columns - 1)) * columns + i % (columns - 1)
        a, b = F.get(pixels, left.cast("int")), F.get(pixels, (left + 1).cast("int"))
        return (b > a) if rising else (a > b)

    return _packed(F.transform(at, bit))


def sign_hash(vector: Column) -> Column:
    """64 sign bits of a vector: the stand-in for an image's hash where vectors are given."""
    return _packed(F.transform(F.slice(vector, 1, 64), lambda v: v > 0))


def digest(content: Column) -> Column:
    """SHA-256 in lowercase hexadecimal."""
    return F.sha2(content, 256)
