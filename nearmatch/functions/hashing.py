"""Columns over 64-bit perceptual hashes, stored signed.

Of a packed hash, bit 0 is always 0; ``h63`` shifts it out, which keeps
distances and makes the number non-negative in any engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Distinct bits of a packed hash.
BITS = 63


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def h63(h: Column) -> Column:
    return F.shiftrightunsigned(h, 1)


def hash_hex(h: Column) -> Column:
    return F.lpad(F.lower(F.hex(h)), 16, "0")


def median64(block: Column) -> Column:
    """Median of 64 coefficients: the mean of the middle two."""
    s = F.array_sort(block)
    return (F.element_at(s, 32) + F.element_at(s, 33)) / 2


def pack_bits(block: Column) -> Column:
    """The hash of an 8x8 coefficient block, row by row: bit 64 - i is set where coefficient i, from 1, is above the median."""
    doubles = F.transform(block, lambda x: x.cast("double"))

    def pack(s: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(63)), F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(F.when(F.get(s["v"], i) > s["m"], F.call_function("shiftleft", F.lit(1).cast("long"), 64 - i)).otherwise(F.lit(0).cast("long"))))

    # through an array of one struct, so that the median is not computed again for each coefficient
    once = F.transform(F.array(doubles), lambda v: F.struct(v.alias("v"), median64(v).alias("m")))
    return F.get(F.transform(once, pack), 0)


def usable(h: Column, sign_bit: bool = False) -> Column:
    """Whether a hash says anything: neither null nor 0; with sign_bit, nor only the highest bit."""
    ok = h.isNotNull() & (h != 0)
    return ok & (h != F.lit(-(1 << 63))) if sign_bit else ok


def encode_blob(hashes: Column) -> Column:
    """Little-endian 8-byte numbers, one after another."""
    return F.unhex(F.array_join(F.transform(hashes, lambda h: _reversed_hex(F.lpad(F.hex(h), 16, "0"))), ""))


def _reversed_hex(x: Column) -> Column:
    return F.concat(*[F.substring(x, k, 2) for k in range(15, 0, -2)])


def decode_blob(blob: Column) -> Column:
    """The numbers of a blob; bytes after the last whole one are left out, and a blob without one is an empty array.

    Each number is cut from the bytes, not from a text of the whole blob: the work is in proportion to the blob's length.
    """

    def one(b: Column, k: Column) -> Column:
        return F.conv(_reversed_hex(F.hex(F.substr(b, k * 8 + 1, F.lit(8)))), 16, -10).cast("long")

    def numbers(b: Column) -> Column:
        n = F.floor(F.octet_length(b) / 8).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: one(b, k))).otherwise(F.array().cast("array<bigint>"))

    # through an array of the one blob, so that what it comes from is not computed again for each number
    return F.get(F.transform(F.array(blob), numbers), 0)
