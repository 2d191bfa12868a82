"""Stable hashes as built-in expressions: buckets for splits, and a uniform number for order and choice."""

from __future__ import annotations

from fractions import Fraction
from math import ceil

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Buckets are 0 .. MODULUS - 1.
MODULUS = 2**63 - 1


def text_of(value: Column) -> Column:
    """The text that is hashed: 'None' for null."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def _hex(digest: Column, start: int, n: int) -> Column:
    return F.conv(F.substring(digest, start, n), 16, 10).cast("decimal(20,0)")


def bucket(value: Column) -> Column:
    """md5 of the text as a 128-bit number, modulo 2^63 - 1: the high half counts twice, as 2^64 is 2 to that modulus."""
    digest = F.md5(text_of(value).cast("binary"))
    whole = _hex(digest, 1, 16).cast("decimal(38,0)") * 2 + _hex(digest, 17, 16)
    return (whole % F.lit(MODULUS).cast("decimal(38,0)")).cast("decimal(20,0)")


def split_bounds(fractions: list[float], index: int) -> tuple[int, int]:
    """The first bucket of a split and the first after it. Sums of fractions are taken as the floats they are."""
    if not 0 <= index < len(fractions):
        raise ValueError(f"split {index} of {len(fractions)}")
    ends = [0.0]
    for f in fractions:
        ends.append(ends[-1] + f)
    low, high = (ceil(Fraction(e * float(MODULUS - 1))) for e in ends[index : index + 2])
    return low, high


def uniform(key: Column) -> Column:
    """A number in [0, 1) from the md5 of a text: its first 52 bits."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(4503599627370496.0)


def order_key(seed: int | str, *parts: Column) -> Column:
    """A text to sort by that shuffles rows; equal for equal seed and parts."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"))
