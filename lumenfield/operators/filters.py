"""Row filters and projections; each is a plain column expression, so it works on streams too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dc_to_display_u8, opacity_threshold


def _like(df: DataFrame, column: str, value: float) -> Column:
    """A literal of the column's own type, so that comparisons reach the scan."""
    return F.lit(value).cast(df.schema[column].dataType)


def crop_bbox(df: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
    """Rows inside the closed box; NaN positions are outside."""
    inside = F.lit(True)
    for c, a, b in zip("xyz", low, high):
        inside = inside & F.col(c).between(_like(df, c, a), _like(df, c, b))
    return df.where(inside)


def filter_alpha(df: DataFrame, min_u8: int) -> DataFrame:
    """Rows whose alpha is at least min_u8 / 255; 0 keeps all, 255 none.  NaN opacities go."""
    if not 0 <= min_u8 <= 255:
        raise ValueError("min_opacity must lie in 0..255")
    if min_u8 == 0 or "opacity" not in df.columns:
        return df
    if min_u8 == 255:
        return df.where(F.lit(False))
    t = opacity_threshold(min_u8)
    return df.where(~F.isnan("opacity") & (F.col("opacity").cast("double") >= F.lit(t)))


def cap_sh(df: DataFrame, degree: int | None, layout: str = "flat") -> DataFrame:
    """Coefficients above `degree` set to zero; columns stay.  layout: one prefix, or 15 for each channel."""
    if degree is None or degree >= 3:
        return df
    keep = {0: 0, 1: 9, 2: 24}[degree]
    gone = lambda i: i >= keep if layout == "flat" else i % 15 >= keep // 3
    names = [c for c in df.columns if c.startswith("f_rest_") and gone(int(c[7:]))]
    return df.withColumns({c: F.lit(0).cast(df.schema[c].dataType) for c in names}) if names else df


def crop_sh(df: DataFrame) -> DataFrame:
    """Without the f_rest columns behind the last one that holds anything but zero (one aggregate over df)."""
    last = last_active(df)
    return df.drop(*(c for c in df.columns if c.startswith("f_rest_") and int(c[7:]) > last))


def last_active(df: DataFrame) -> int:
    names = [c for c in df.columns if c.startswith("f_rest_")]
    if not names:
        return -1
    row = df.agg(F.max(active_index(names))).first()
    return -1 if row[0] is None else int(row[0])


def active_index(names: list[str]) -> Column:
    """The highest coefficient number that is not zero in a row, -1 if none."""
    return F.greatest(*(F.when(F.col(c) != 0, F.lit(int(c[7:]))).otherwise(F.lit(-1)) for c in names), F.lit(-1))


def degree_of(last: int) -> int:
    return 3 if last >= 24 else 2 if last >= 9 else 1 if last >= 0 else 0


def add_rgb(df: DataFrame) -> DataFrame:
    """red, green, blue (0..255) from the base colour; nothing where they exist or there is none."""
    if "red" in df.columns or "f_dc_0" not in df.columns:
        return df
    return df.withColumns({c: dc_to_display_u8(F.col(f"f_dc_{i}")).cast("short") for i, c in enumerate(("red", "green", "blue"))})


def bounds(df: DataFrame) -> DataFrame:
    """One row: the number of rows and the tight box."""
    return df.agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))))
