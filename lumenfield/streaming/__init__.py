"""Streams of splats: row-wise steps run on them; what needs a complete table is refused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..convert import Options
from ..operators import filters


def process_stream(df: DataFrame, options: Options) -> DataFrame:
    """cap, crop, alpha and colours on a streaming DataFrame; ValueError for density and outliers."""
    options.check()
    if options.density or options.outliers or options.auto_bbox or options.crop_sh:
        raise ValueError("density, outliers, bounds and content-driven cropping need a complete table")
    df = filters.cap_sh(df, options.sh_level)
    if options.bbox:
        df = filters.crop_bbox(df, options.bbox[:3], options.bbox[3:])
    df = filters.filter_alpha(df, options.min_opacity)
    return filters.add_rgb(df) if options.rgb else df


def windowed_counts(df: DataFrame, time_col: str, size: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Rows and bounds by time window, with a watermark for late rows."""
    return df.withWatermark(time_col, late).groupBy(F.window(time_col, size)).agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{m}_{c}") for c in "xyz" for m, f in (("min", F.min), ("max", F.max))))
