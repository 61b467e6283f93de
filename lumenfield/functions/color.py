"""Spherical-harmonic base colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .quant import clip, trunc_u8

#: The constant band of real spherical harmonics.
SH_C0 = 0.28209479177387814
SPZ_COLOR_SCALE = 0.15


def dc_to_linear(dc: Column) -> Column:
    return 0.5 + SH_C0 * dc


def linear_to_dc(c: Column) -> Column:
    return (c - 0.5) / SH_C0


def dc_to_display_u8(dc: Column, gamma: float = 2.2) -> Column:
    return (255 * F.pow(clip(dc_to_linear(dc), 0.0, 1.0), F.lit(1 / gamma))).cast("long")


def spz_color_u8(dc: Column) -> Column:
    return trunc_u8((dc * SPZ_COLOR_SCALE + 0.5) * 255.0)
