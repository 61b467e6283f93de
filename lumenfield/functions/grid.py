"""Cells, curves and hashes over positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def voxel(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(size))


def distance(a: list[Column], b: list[Column]) -> Column:
    total = F.lit(0.0)
    for x, y in zip(a, b):
        total = total + (x - y) * (x - y)
    return F.sqrt(total)


def _spread(n: Column) -> Column:
    """Ten bits with two zeros between neighbours."""
    mask = lambda c, m: c.bitwiseAND(F.lit(m).cast("long"))
    for shift, m in ((16, 0xFF0000FF), (8, 0x0300F00F), (4, 0x030C30C3), (2, 0x09249249)):
        n = mask(n.bitwiseXOR(F.shiftleft(n, shift)), m)
    return n


def morton3(x: Column, y: Column, z: Column) -> Column:
    """Interleaved bits of three ten-bit cell numbers, x lowest."""
    return F.shiftleft(_spread(z), 2).bitwiseOR(F.shiftleft(_spread(y), 1)).bitwiseOR(_spread(x))


def spatial_hash(x: Column, y: Column, z: Column, buckets: Column | int) -> Column:
    n = buckets if isinstance(buckets, Column) else F.lit(buckets)
    return F.pmod((x * 73856093).bitwiseXOR(y * 19349663).bitwiseXOR(z * 83492791), n)
