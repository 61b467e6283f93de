"""The column functions as SQL functions of a session: CREATE TEMPORARY FUNCTION, bodies in SQL, JVM-side."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .functions.color import SH_C0

BODIES = {
    "splat_sigmoid(x DOUBLE)": ("DOUBLE", "1 / (1 + exp(-x))"),
    "splat_logit(a DOUBLE)": ("DOUBLE", "ln(least(greatest(a, 1e-6D), 1D - 1e-6D) / (1 - least(greatest(a, 1e-6D), 1D - 1e-6D)))"),
    "splat_signed_log(v DOUBLE)": ("DOUBLE", "signum(v) * log1p(abs(v))"),
    "splat_signed_exp(v DOUBLE)": ("DOUBLE", "signum(v) * expm1(abs(v))"),
    "splat_linear(dc DOUBLE)": ("DOUBLE", f"0.5D + {SH_C0}D * dc"),
    "splat_dc(c DOUBLE)": ("DOUBLE", f"(c - 0.5D) / {SH_C0}D"),
    "splat_display(dc DOUBLE)": ("BIGINT", f"cast(255 * pow(least(greatest(0.5D + {SH_C0}D * dc, 0D), 1D), {1 / 2.2!r}D) as bigint)"),
    "splat_fixed24(v DOUBLE)": ("BIGINT", "cast(rint(v * 4096D) as bigint) & 16777215L"),
    "splat_voxel(v DOUBLE, size DOUBLE)": ("BIGINT", "floor(v / size)"),
    "splat_pack_10_11(x BIGINT, y BIGINT, z BIGINT)": ("BIGINT", "shiftleft(x, 21) | shiftleft(y, 11) | z"),
    "splat_pack_8888(r BIGINT, g BIGINT, b BIGINT, a BIGINT)": ("BIGINT", "shiftleft(r, 24) | shiftleft(g, 16) | shiftleft(b, 8) | a"),
    "splat_hash(x BIGINT, y BIGINT, z BIGINT, n BIGINT)": ("BIGINT", "pmod((x * 73856093L) ^ (y * 19349663L) ^ (z * 83492791L), n)"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to spark.sql; returns their names."""
    for head, (kind, body) in BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    return [h.split("(")[0] for h in BODIES]
