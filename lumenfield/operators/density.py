"""Density filter: voxels with enough rows, their face-connected components, rows of the kept ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import voxel
from ..scratch import written
from . import components as connect
from .order import dense_ordinal

KEYS = ["vx", "vy", "vz"]
#: Dense voxels up to which components are found on the driver.  How many there may be follows from the threshold alone:
#: 200 / percent at most, whatever the number of rows.
DRIVER_VOXELS = 200_000


def sensitivity_parameters(s: float) -> tuple[float, float]:
    """(voxel size, threshold in percent) of a slider in 0..1."""
    if not 0 <= s <= 1:
        raise ValueError("sensitivity must lie in 0..1")
    return max(0.1, 2 - 1.8 * s), 0.1 + 0.9 * s


def with_voxels(df: DataFrame, size: float) -> DataFrame:
    """vx, vy, vz; for FLOAT positions the quotient is taken in FLOAT."""
    cell = lambda c: F.floor((F.col(c) / F.lit(size).cast("float")).cast("float")) if df.schema[c].dataType.simpleString() == "float" else voxel(F.col(c), size)
    return df.withColumns({k: cell(c) for k, c in zip(KEYS, "xyz")})


def histogram(df: DataFrame, size: float) -> DataFrame:
    return with_voxels(df, size).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))


def dense_voxels(df: DataFrame, size: float, percent: float) -> DataFrame:
    """Voxels with at least int(rows * percent / 100) rows."""
    counts = histogram(df, size)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return counts.crossJoin(F.broadcast(total)).where(F.col("n") >= F.floor(F.col("total") * percent / 100)).select(*KEYS, "n")


def components(dense: DataFrame, percent: float) -> DataFrame:
    """(vx, vy, vz, n, component) of the dense voxels at a threshold of `percent`: component is the smallest voxel of its
    face-connected component, as text."""
    if not 200 <= DRIVER_VOXELS * percent:
        return _joined(dense)
    cells = {(r.vx, r.vy, r.vz): r.n for r in dense.collect()}  # 200 / percent at most
    label: dict[tuple[int, int, int], tuple[int, int, int]] = {}
    for start in sorted(cells):
        if start in label:
            continue
        label[start], work = start, [start]
        while work:
            x, y, z = work.pop()
            for near in ((x - 1, y, z), (x + 1, y, z), (x, y - 1, z), (x, y + 1, z), (x, y, z - 1), (x, y, z + 1)):
                if near in cells and near not in label:
                    label[near] = start
                    work.append(near)
    out = [(*c, cells[c], "{},{},{}".format(*label[c])) for c in cells]
    return dense.sparkSession.createDataFrame(out, "vx long, vy long, vz long, n long, component string")


def _joined(dense: DataFrame) -> DataFrame:
    """The same for any number of voxels: numbered in order, linked over faces, joined by contraction."""
    cells, path = written(dense_ordinal(dense.select(*KEYS, "n"), KEYS, "id"), "voxels")
    ahead = F.array(*(F.struct(*((F.col(k) + int(k == axis)).alias(k) for k in KEYS)) for axis in KEYS))
    asked = cells.select(F.col("id").alias("a"), F.explode(ahead).alias("c")).select("a", "c.*")
    links = asked.join(cells.select(*KEYS, F.col("id").alias("b")), KEYS).select("a", "b")
    roots = connect.components(links).withColumnRenamed("component", "root")
    of = cells.select(F.col("id").alias("root"), F.concat_ws(",", *(F.col(k).cast("string") for k in KEYS)).alias("component"))
    return cells.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")).join(of, "root").select(*KEYS, "n", "component")


def density_filter(df: DataFrame, size: float = 1.0, percent: float = 0.32, *, sensitivity: float | None = None, keep_multicluster: bool = False) -> DataFrame:
    """Rows in the largest component of dense voxels (most voxels; of equal ones that with the smallest voxel), or
    with keep_multicluster in all components of at least 5 % of its voxels.  No dense voxel: no rows."""
    if df.isStreaming:
        raise ValueError("the density filter needs a complete table")
    if sensitivity is not None:
        size, percent = sensitivity_parameters(sensitivity)
    found = components(dense_voxels(df, size, percent), percent)
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("voxels"), F.min(F.struct(*KEYS)).alias("first"))
    top = sizes.agg(F.max("voxels").alias("most"))
    kept = sizes.crossJoin(F.broadcast(top))
    if keep_multicluster:
        kept = kept.where(F.col("voxels") >= 0.05 * F.col("most"))
    else:
        kept = kept.where(F.col("voxels") == F.col("most")).orderBy("first").limit(1)
    cells = found.join(kept.select("component"), "component", "left_semi").select(*KEYS)
    return with_voxels(df, size).join(cells, KEYS, "left_semi").drop(*KEYS)
