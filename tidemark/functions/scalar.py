"""Scalar helpers; positions and lengths are in UTF-8 bytes where the name says so."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_length(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def first_line(text: Column) -> Column:
    """Up to the first line feed."""
    return F.substring_index(text, "\n", 1)


def word_at(text: Column, offset: Column) -> Column:
    """The run of ASCII letters, digits and underscores around a byte offset; null if there is none or the offset is outside or within a character.

    Bytes before and after the offset are decoded byte by byte (ISO-8859-1), so
    one character is one byte and nothing beyond ASCII is part of a word.
    """
    b = F.encode(text, "UTF-8")
    as_bytes = lambda part: F.decode(part, "ISO-8859-1")
    before = F.regexp_extract(as_bytes(F.substring(b, F.lit(1), offset.cast("int"))), "[A-Za-z0-9_]*$", 0)
    after = F.regexp_extract(as_bytes(F.substring(b, offset.cast("int") + 1, F.octet_length(b))), "^[A-Za-z0-9_]+", 0)
    return F.when((offset >= 0) & (offset < F.octet_length(b)) & (F.length(after) > 0), F.concat(before, after))


def lcg(value: Column, steps: int, multiplier: int = 6364136223846793005, increment: int = 1442695040888963407) -> Column:
    """A linear congruential generator modulo 2**64 after ``steps`` steps, from its closed form: multiplier**steps x + increment (sum of powers).

    Products modulo 2**64 are put together from 32-bit halves in decimals, since longs overflow.
    The result is the unsigned number as decimal(20,0).
    """
    m, a, c = 2**64, 1, 0
    for bit in bin(steps)[2:]:
        a, c = a * a % m, (c * a + c) % m
        if bit == "1":
            a, c = a * multiplier % m, (c * multiplier + increment) % m
    whole = lambda n: F.expr(f"cast('{n}' as decimal(20,0))")
    unsigned = F.when(value < 0, value.cast("decimal(20,0)") + whole(m)).otherwise(value.cast("decimal(20,0)"))
    half = whole(2**32)
    low, high = unsigned % half, F.floor(unsigned / half)
    low = low.cast("decimal(10,0)")
    high = ((unsigned - low) / half).cast("decimal(10,0)")
    part = lambda x, n: (x * F.expr(f"cast('{n}' as decimal(10,0))")).cast("decimal(21,0)")
    cross = ((part(low, a >> 32) + part(high, a & 0xFFFFFFFF)) % half).cast("decimal(10,0)")
    total = part(low, a & 0xFFFFFFFF).cast("decimal(22,0)") + (cross * half.cast("decimal(11,0)")).cast("decimal(22,0)") + whole(c).cast("decimal(22,0)")
    return (total % whole(m)).cast("decimal(20,0)")
