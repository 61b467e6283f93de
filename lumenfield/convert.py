"""Conversion of scene files with the fixed order of steps: cap, crop, alpha, density, outliers, colours, write."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .operators import density, filters, neighbours, profile
from .sources import FORMATS, detect, read, write
from .sources import files, ply

#: Highest degree that a format holds, and formats that show colours of their own.
LIMITS = {"splat": 0, "ksplat": 2}
COLOURED = ("cc", "splat", "ksplat", "sog")
ENDINGS = {"3dgs": ".ply", "cc": ".ply", "compressed_ply": ".ply", "splat": ".splat", "ksplat": ".ksplat", "spz": ".spz", "sog": ".sog", "parquet": ".parquet"}


@dataclass
class Options:
    """What to do with a scene; None and False leave a step out."""

    sh_level: int | None = None
    bbox: tuple[float, float, float, float, float, float] | None = None
    min_opacity: int = 0
    density_voxel_size: float | None = None
    density_threshold: float | None = None
    density_sensitivity: float | None = None
    keep_multicluster: bool = False
    sor_k: int | None = None
    sor_sigma: float | None = None
    sor_intensity: float | None = None
    auto_bbox: bool = False
    rgb: bool = False
    crop_sh: bool = False
    extra_elements: bool = False
    compression_level: int = 0
    bucket_size: int = 256
    block_size: float = 5.0

    def check(self) -> None:
        for name, low, high in (("density_sensitivity", 0, 1), ("sor_intensity", 1, 10), ("min_opacity", 0, 255), ("compression_level", 0, 9), ("sh_level", 0, 3)):
            v = getattr(self, name)
            if v is not None and not low <= v <= high:
                raise ValueError(f"{name} must lie in {low}..{high}")

    @property
    def density(self) -> bool:
        return self.density_sensitivity is not None or (self.density_voxel_size is not None and self.density_threshold is not None)

    @property
    def outliers(self) -> bool:
        return self.sor_intensity is not None or (self.sor_k is not None and self.sor_sigma is not None)

    @property
    def changes(self) -> bool:
        """Whether any step changes the table."""
        return bool(self.bbox or self.min_opacity or self.density or self.outliers or self.rgb or self.crop_sh or self.auto_bbox or self.sh_level is not None or self.compression_level)


def process(df: DataFrame, options: Options, target: str = "3dgs") -> DataFrame:
    """The steps in their order; the degree is the least of active, asked and what the target holds."""
    options.check()
    limit = min(LIMITS.get(target, 3), 3 if options.sh_level is None else options.sh_level)
    if limit < 3 and any(c.startswith("f_rest_") for c in df.columns):
        df = filters.cap_sh(df, limit)
    if options.bbox:
        df = filters.crop_bbox(df, options.bbox[:3], options.bbox[3:])
    df = filters.filter_alpha(df, options.min_opacity)
    if options.density:
        df = density.density_filter(df, options.density_voxel_size or 1.0, 0.32 if options.density_threshold is None else options.density_threshold, sensitivity=options.density_sensitivity, keep_multicluster=options.keep_multicluster)
    if options.outliers:
        df = neighbours.outlier_filter(df, options.sor_k or 25, 10.5 if options.sor_sigma is None else options.sor_sigma, intensity=options.sor_intensity)
    if options.rgb or target in COLOURED:
        df = filters.add_rgb(df)
    return df


def convert(spark: SparkSession, source: str, path: str, target: str, options: Options | None = None, *, mode: str = "spec", force: bool = True) -> dict:
    """Read, process, write; returns the bounds if asked for, else an empty report."""
    options = options or Options()
    if target not in FORMATS:
        raise ValueError(f"no format {target}")
    if not force and files.exists(path):
        raise FileExistsError(path)
    scene = read(spark, source, mode=mode)
    df = process(scene.df, options, target)
    report = filters.bounds(df).first().asDict() if options.auto_bbox else {}
    extras = scene.extras if options.extra_elements and target in ("3dgs", "cc") else None
    write(df, path, target, extras=extras, crop_sh=options.crop_sh, compression_level=options.compression_level, sh_level=options.sh_level, bucket_size=options.bucket_size, block_size=options.block_size)
    return report


def info(spark: SparkSession, path: str) -> dict:
    """A report on one file: size, format, header facts and a one-row profile of its rows."""
    scene = read(spark, path)
    row = profile.describe(scene.df).first().asDict()
    size = files.length(path) if scene.format != "parquet" or os.path.isfile(path) else None
    return {"path": path, "format": scene.format, "bytes": size, "extras": sorted(scene.extras), **scene.meta, **row}


def has_extras(path: str) -> bool:
    """Whether a PLY file holds elements besides vertices and faces."""
    return path.lower().endswith(".ply") and any(e.name not in ("vertex", "face") for e in ply.header(path).elements)


def output_path(source: str, target: str, given: str | None = None) -> str:
    """The given path, with the format's ending if it has none; else the source's with ending or suffix changed."""
    if given:
        return given if os.path.splitext(given)[1] else given + ENDINGS[target]
    stem, ending = os.path.splitext(source)
    if ending.lower() != ENDINGS[target]:
        return stem + ENDINGS[target]
    suffix = {"cc": "_cc", "compressed_ply": "_compressed", "3dgs": "_3dgs"}.get(target, "_processed")
    return stem + suffix + ENDINGS[target]


__all__ = ["Options", "convert", "detect", "has_extras", "info", "output_path", "process"]
