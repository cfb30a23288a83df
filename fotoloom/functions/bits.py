"""Bit kernels: population counts and Hamming distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def popcount(x: Column) -> Column:
    return F.bit_count(x)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two integers of the same width."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming_binary(a: Column, b: Column) -> Column:
    """Differing bits of two byte strings; the tail of the longer counts its set bits."""
    n = F.greatest(F.length(a), F.length(b))
    # both as hex, filled up with zeros, eight bytes at a time
    wide = F.ceil(n / 8) * 16
    x, y = (F.rpad(F.hex(c), wide.cast("int"), "0") for c in (a, b))
    word = lambda h, i: F.conv(F.substring(h, i * 16 + 1, F.lit(16)), 16, -10).cast("long")
    parts = F.transform(F.sequence(F.lit(0), F.ceil(n / 8).cast("int") - 1), lambda i: F.bit_count(word(x, i).bitwiseXOR(word(y, i))))
    return F.when(n == 0, F.lit(0)).otherwise(F.aggregate(parts, F.lit(0), lambda s, v: s + v))


def to_hex(b: Column) -> Column:
    return F.lower(F.hex(b))


def from_hex(s: Column) -> Column:
    """Bytes of a hex text, null where it has odd length or other characters."""
    return F.when(s.rlike("^([0-9a-fA-F]{2})*$"), F.unhex(s))


def hex_to_long(s: Column) -> Column:
    """A hex text of up to 16 digits as a signed 64-bit number."""
    return F.conv(s, 16, -10).cast("long")
