"""Numbers for short strings: hashes and positional codes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Offset basis and prime of 32-bit FNV-1a; of 64-bit FNV-1a the basis in two halves, the prime is 2**40 + 435.
FNV_BASIS, FNV_PRIME = 2166136261, 16777619
FNV64_HIGH, FNV64_LOW, FNV64_PRIME = 0xCBF29CE4, 0x84222325, 435


def _places(text: Column) -> Column:
    """1 .. length; no element for an empty text."""
    return F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))


def fnv1a_32(text: Column) -> Column:
    """FNV-1a hash of an ASCII text."""

    def step(acc: Column, k: Column) -> Column:
        return (acc.bitwiseXOR(F.ascii(F.substr(text, k, F.lit(1))).cast("bigint")) * FNV_PRIME).bitwiseAND(0xFFFFFFFF)

    return F.aggregate(_places(text), F.lit(FNV_BASIS).cast("bigint"), step)


def fnv1a_64(text: Column) -> Column:
    """64-bit FNV-1a hash of an ASCII text, as a signed number.

    The state is kept in halves of 32 bits, so no product overflows.
    """

    def step(acc: Column, k: Column) -> Column:
        low = acc["low"].bitwiseXOR(F.ascii(F.substr(text, k, F.lit(1))).cast("bigint"))
        product = low * FNV64_PRIME
        high = acc["high"] * FNV64_PRIME + F.shiftright(product, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(0xFFFFFFFF).alias("high"), product.bitwiseAND(0xFFFFFFFF).alias("low"))

    start = F.struct(F.lit(FNV64_HIGH).cast("bigint").alias("high"), F.lit(FNV64_LOW).cast("bigint").alias("low"))
    return F.aggregate(_places(text), start, step, lambda acc: F.shiftleft(acc["high"], 32).bitwiseOR(acc["low"]))


def mixed_32(hashed: Column, number: int) -> Column:
    """A 32-bit FNV-1a hash after one more byte."""
    return (hashed.bitwiseXOR(F.lit(number).cast("bigint")) * FNV_PRIME).bitwiseAND(0xFFFFFFFF)


def kmer_number(text: Column, letters: str) -> Column:
    """The text as a number in base ``len(letters) + 1``, its first letter the lowest digit; letters count from 1, others 0."""
    base = len(letters) + 1

    def step(acc: Column, k: Column) -> Column:
        return acc * base + F.instr(F.lit(letters), F.substr(text, F.length(text) - k + 1, F.lit(1))).cast("bigint")

    return F.aggregate(_places(text), F.lit(0).cast("bigint"), step)


def kmer_text(number: Column, letters: str, size: int) -> Column:
    """The text of ``size`` letters that has this number; "?" for the digit 0."""
    base = len(letters) + 1
    digits = [F.floor(number / F.lit(base**k)).cast("bigint") % base for k in range(size)]
    return F.concat(*[F.when(d == 0, F.lit("?")).otherwise(F.substr(F.lit(letters), d.cast("int"), F.lit(1))) for d in digits])
