"""Activations between stored and shown values."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .quant import clip


def sigmoid(x: Column, limit: float | None = None) -> Column:
    """1 / (1 + exp(-x)), the input held within +-limit if given."""
    x = clip(x, -limit, limit) if limit else x
    return 1 / (1 + F.exp(-x))


def logit(alpha: Column, low: float = 1e-6, high: float = 1 - 1e-6) -> Column:
    """ln(a / (1 - a)) of alpha held within [low, high]."""
    a = clip(alpha, low, high)
    return F.ln(a / (1 - a))


def opacity_threshold(min_u8: int) -> float:
    """The logit at or above which a splat's alpha is at least min_u8 / 255; folded on the driver."""
    a = min(max(min_u8 / 255.0, 1e-6), 1 - 1e-6)
    return math.log(a / (1 - a))


def log_scale(scale: Column, least: float = 1e-6) -> Column:
    return F.ln(F.greatest(scale, F.lit(least)))


def signed_log(v: Column) -> Column:
    return F.signum(v) * F.log1p(F.abs(v))


def signed_log_inverse(v: Column) -> Column:
    return F.signum(v) * F.expm1(F.abs(v))


def splat_importance(scale: list[Column], opacity: Column) -> Column:
    """Volume times alpha: what streamed formats sort by, largest first."""
    return F.exp(scale[0] + scale[1] + scale[2]) * sigmoid(opacity)
