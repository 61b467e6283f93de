"""Quantisers and bit packing; integers are BIGINT, so that unsigned 32-bit words fit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(v: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def trunc_u8(v: Column) -> Column:
    """0..255, what is behind the point dropped."""
    return clip(v, 0.0, 255.0).cast("long")


def round_even(v: Column) -> Column:
    return F.rint(v)


def unit_quantum(v: Column, low: Column, high: Column, bits: int) -> Column:
    """v within [low, high] as one of 2 ** bits steps, halves up; 0 where the range is below 1e-5."""
    top = float((1 << bits) - 1)
    t = clip(F.floor((v - low) / (high - low) * top + 0.5).cast("double"), 0.0, top).cast("long")
    return F.when(high - low < 1e-5, F.lit(0).cast("long")).otherwise(t)


def pack_10_11(x: Column, y: Column, z: Column) -> Column:
    """Three steps of 11, 10 and 11 bits in one word."""
    return F.shiftleft(x, 21).bitwiseOR(F.shiftleft(y, 11)).bitwiseOR(z)


def unpack_10_11(word: Column) -> tuple[Column, Column, Column]:
    part = lambda shift, mask: F.shiftright(word, shift).bitwiseAND(F.lit(mask).cast("long"))
    return part(21, 0x7FF), part(11, 0x3FF), part(0, 0x7FF)


def pack_8888(r: Column, g: Column, b: Column, a: Column) -> Column:
    return F.shiftleft(r, 24).bitwiseOR(F.shiftleft(g, 16)).bitwiseOR(F.shiftleft(b, 8)).bitwiseOR(a)


def fixed24(v: Column, fraction_bits: int = 12) -> Column:
    """Fixed point in the low 24 bits, halves to even; wraps beyond the range."""
    return F.rint(v * float(1 << fraction_bits)).cast("long").bitwiseAND(F.lit(0xFFFFFF).cast("long"))


def fixed24_decode(word: Column, fraction_bits: int = 12) -> Column:
    return F.when(word >= 0x800000, word - 0x1000000).otherwise(word) / float(1 << fraction_bits)


def sh_u8(v: Column, low: float, high: float, steps: float) -> Column:
    """A coefficient over [low, high) in bytes of `steps` steps, truncated."""
    return trunc_u8((v - low) / (high - low) * steps)


def spz_sh_u8(v: Column, bits: int) -> Column:
    """A coefficient in [-1, 1) to a byte whose low bits are dropped to the middle of `bits`-bit buckets."""
    size = 1 << (8 - bits)
    q = F.rint(v * 128.0 + 128.0).cast("long") + size // 2
    return clip(F.floor(q / size).cast("double") * size, 0.0, 255.0).cast("long")
