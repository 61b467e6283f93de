"""Quaternions (w, x, y, z) and the ways formats pack them.  The largest component by size is left out; the
first of equal ones counts as largest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .quant import clip, trunc_u8

SQRT1_2 = 0.7071067811865476


def _largest(q: list[Column]) -> Column:
    top = F.greatest(*map(F.abs, q))
    out = F.lit(3)
    for i in (2, 1, 0):
        out = F.when(F.abs(q[i]) == top, F.lit(i)).otherwise(out)
    return out.cast("long")


def _pick(q: list[Column], at: Column) -> Column:
    out = q[3]
    for i in (2, 1, 0):
        out = F.when(at == i, q[i]).otherwise(out)
    return out


def _others(at: Column, q: list[Column]) -> list[Column]:
    """The three components that stay, in order."""
    return [F.when(at > k, q[k]).otherwise(q[k + 1]) for k in range(3)]


def _unit(q: list[Column], norm: Column) -> list[Column]:
    return [c / norm for c in q]


def _norm2(q: list[Column]) -> Column:
    return q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3]


def _word(at: Column, parts: list[Column]) -> Column:
    out = at
    for p in parts:
        out = F.shiftleft(out, 10).bitwiseOR(p)
    return out


def pack_2_10_10_10(q: list[Column]) -> Column:
    """The larger's index and three ten-bit components over +-sqrt(1/2), halves up."""
    u = _unit(q, F.sqrt(_norm2(q)) + 1e-10)
    at = _largest(u)
    sign = F.signum(_pick(u, at))
    part = lambda v: clip(F.floor((v * sign * SQRT1_2 + 0.5) * 1023.0 + 0.5).cast("double"), 0.0, 1023.0).cast("long")
    return _word(at, [part(v) for v in _others(at, u)])


def unpack_2_10_10_10(word: Column) -> list[Column]:
    part = lambda shift: F.shiftright(word, shift).bitwiseAND(F.lit(1023).cast("long"))
    a, b, c = ((part(s) / 1023.0 - 0.5) / SQRT1_2 for s in (20, 10, 0))
    at = F.shiftright(word, 30).bitwiseAND(F.lit(3).cast("long"))
    left = F.sqrt(clip(1.0 - (a * a + b * b + c * c), 0.0, 1.0))
    return [
        F.when(at == 0, left).otherwise(a),
        F.when(at == 1, left).when(at == 0, a).otherwise(b),
        F.when(at == 2, left).when(at == 3, c).otherwise(b),
        F.when(at == 3, left).otherwise(c),
    ]


def pack_spz(q: list[Column]) -> Column:
    """Order x, y, z, w; a sign bit and nine bits of size for each component that stays."""
    norm = F.sqrt(_norm2(q) + 1e-9)
    u = _unit([q[1], q[2], q[3], q[0]], norm)
    at = _largest(u)
    turned = _pick(u, at) < 0

    def part(v: Column) -> Column:
        size = clip(F.abs(v) * (511.0 / SQRT1_2) + 0.5, 0.0, 511.0).cast("long")
        return F.when((v < 0) != turned, F.lit(512)).otherwise(F.lit(0)).cast("long").bitwiseOR(size)

    return _word(at, [part(v) for v in _others(at, u)])


def sog_bytes(q: list[Column]) -> list[Column]:
    """Three bytes of the components that stay, over +-sqrt(1/2), and the larger's index with 252 added."""
    u = _unit(q, F.sqrt(_norm2(q)))
    at = _largest(u)
    scale = F.signum(_pick(u, at)) * (2.0**0.5)
    return [*(trunc_u8((v * scale * 0.5 + 0.5) * 255.0) for v in _others(at, u)), at + 252]


def splat_bytes(q: list[Column]) -> list[Column]:
    u = _unit(q, F.greatest(F.sqrt(_norm2(q)), F.lit(1e-6)))
    return [trunc_u8(v * 128.0 + 128.0) for v in u]


def legacy_w(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), 1.0 - (x * x + y * y + z * z)))
