"""One-row reports on a splat table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import active_index


def declared_degree(columns: list[str]) -> int:
    n = sum(c.startswith("f_rest_") for c in columns)
    return 3 if n >= 45 else 2 if n >= 24 else 1 if n >= 9 else 0


def describe(df: DataFrame) -> DataFrame:
    """Rows, bounds, attributes that are there, declared and active degree of the harmonics; one aggregate."""
    rest = [c for c in df.columns if c.startswith("f_rest_")]
    last = F.coalesce(F.max(active_index(rest)), F.lit(-1)) if rest else F.lit(-1)
    active = F.when(last >= 24, 3).when(last >= 9, 2).when(last >= 0, 1).otherwise(0)
    has = lambda c: F.lit(c in df.columns)
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        *(f(c).alias(f"{m}_{c}") for c in "xyz" for m, f in (("min", F.min), ("max", F.max))),
        F.lit(declared_degree(df.columns)).cast("long").alias("declared_degree"),
        active.cast("long").alias("active_degree"),
        has("opacity").alias("has_opacity"),
        has("scale_0").alias("has_scale"),
        has("rot_0").alias("has_rotation"),
        has("nx").alias("has_normals"),
        has("red").alias("has_rgb"),
    )
