"""Exact nearest neighbours by an octree, and the statistical outlier filter built on them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import delete, written

#: Places in a leaf of the octree at most, levels that a split adds, levels in all, and leaves compared at a time: a task
#: meets LEAF places with LEAF * BLOCK others at most.
LEAF, STEP, BITS, BLOCK = 128, 2, 52, 64
_CELL = ["a", "b", "c"]
_LOW, _HIGH = [f"lo_{c}" for c in "xyz"], [f"hi_{c}" for c in "xyz"]


def intensity_parameters(i: float) -> tuple[int, float]:
    """(k, factor) of a slider in 1..10."""
    if not 1 <= i <= 10:
        raise ValueError("intensity must lie in 1..10")
    return int(10 + (i - 1) * 40 / 9), 20 - (i - 1) * 17 / 9


def _key(level: int) -> list[Column]:
    """The cell of a place at a level."""
    return [F.shiftright(F.col(c), BITS - level).alias(k) for c, k in zip(["ix", "iy", "iz"], _CELL)]


def _name(level: int, cells: list[str] = _CELL) -> Column:
    return F.concat_ws("-", F.lit(str(level)), *(F.col(c).cast("string") for c in cells))


def octree(places: DataFrame) -> tuple[DataFrame, DataFrame, int, list[str]]:
    """(cells: cell, parent, leaf, w, box; places with their leaf; levels; paths of the tables) of places with ix, iy, iz.

    Cells with more than LEAF places are split, so dense regions get small cells and far single places large ones.
    """
    found, settled, paths, level, crowd = [], [], [], 0, None
    while True:
        own = places.select("*", *_key(level))
        if crowd is not None:
            above = crowd.select(*(F.col(c).alias(f"u{c}") for c in _CELL))
            inside = [F.shiftright(F.col(c), STEP) == F.col(f"u{c}") for c in _CELL]
            own = own.join(above, inside, "left_semi")
        box = [f(c).alias(f"{m}_{c}") for m, f in (("lo", F.min), ("hi", F.max)) for c in "xyz"]
        cells = own.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), *box)
        cells, path = written(cells.withColumn("leaf", (F.col("n") <= LEAF) | F.lit(level >= BITS)), "cells")
        paths.append(path)
        up = cells.select("*", *(F.shiftright(F.col(c), STEP).alias(f"u{c}") for c in _CELL))
        found.append(up.select(_name(level).alias("cell"), _name(level - STEP, [f"u{c}" for c in _CELL]).alias("parent"), "leaf", "w", *_LOW, *_HIGH))
        leaves = cells.where("leaf").select(*_CELL)
        settled.append(own.join(leaves, _CELL).select("x", "y", "z", "w", _name(level).alias("cell")))
        crowd = cells.where("not leaf").select(*_CELL)
        if crowd.isEmpty():
            break
        level += STEP
    return reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, settled), level // STEP, paths


def _near_leaves(cells: DataFrame, levels: int, k: int) -> tuple[DataFrame, str]:
    """(q, cell, far) for leaves q and all leaves that may hold one of the k nearest of any place in q.

    Descends the tree for all q at once.  A cell stays while it is no farther from q than a distance within which k + 1
    places lie, whatever place of q is asked.
    """
    asked = cells.where("leaf").select(F.col("cell").alias("q"), *(F.col(c).alias(f"q{c}") for c in (*_LOW, *_HIGH)))
    boxes = [f"q{c}" for c in (*_LOW, *_HIGH)]
    cur, path = written(asked.crossJoin(F.broadcast(cells.where(F.col("parent").startswith("-")))), "near")  # the root: one row
    group = Window.partitionBy("q")
    for _ in range(levels):
        below = cells.withColumnRenamed("parent", "above")
        inner = cur.where("not leaf").select("q", *boxes, F.col("cell").alias("above")).join(below, "above")
        both = cur.where("leaf").select("q", *boxes, "cell", "leaf", "w", *_LOW, *_HIGH).unionByName(inner.drop("above"))
        gap = lambda c: F.greatest(F.lit(0.0), F.col(f"qlo_{c}") - F.col(f"hi_{c}"), F.col(f"lo_{c}") - F.col(f"qhi_{c}"))
        span = lambda c: F.greatest(F.col(f"qhi_{c}") - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"qlo_{c}"))
        both = both.withColumns({"least": sum((gap(c) * gap(c) for c in "xyz"), F.lit(0.0)), "most": sum((span(c) * span(c) for c in "xyz"), F.lit(0.0))})
        before = F.coalesce(F.sum("w").over(group.orderBy("most", "cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        both = both.withColumn("bound", F.when(before <= k, F.col("most"))).withColumn("bound", F.max("bound").over(group))
        old = path
        cur, path = written(both.where(F.col("least") <= F.col("bound") * (1 + 1e-9)).drop("parent", "most", "bound", "least"), "near")
        delete(cells.sparkSession, old)
    return cur.select("q", "cell"), path


def knn_mean_distance(df: DataFrame, k: int, *, id_col: str = "_ord") -> DataFrame:
    """(id, mean_distance): the mean distance of each row to its k nearest others, exact, self left out by id.

    Rows at one place count as one with a weight.  Places lie in an octree whose leaves hold LEAF of them at most; each
    leaf meets the leaves that may hold neighbours, BLOCK at a time, so neither far rows nor dense regions make large
    groups (only places nearer to each other than 2 ** -BITS of the whole extent can).  k is held to rows - 1; a
    single row has no neighbour and a null distance.  Rows with a NaN or null position are left out.
    """
    if df.isStreaming:
        raise ValueError("neighbours need a complete table")
    spark = df.sparkSession
    points = df.select(F.col(id_col).alias("id"), *(F.col(c).cast("double").alias(c) for c in "xyz"))
    points = points.where(" and ".join(f"{c} is not null and not isnan({c})" for c in "xyz"))
    s = points.agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{m}{c}") for c in "xyz" for m, f in (("a", F.min), ("b", F.max)))).first()
    k = min(k, s["n"] - 1)
    if k < 1:
        return points.select("id", F.lit(None).cast("double").alias("mean_distance"))
    side = max(s[f"b{c}"] - s[f"a{c}"] for c in "xyz") or 1.0
    whole = 1 << BITS
    at = [F.least(F.floor((F.col(c) - s[f"a{c}"]) / side * float(whole)), F.lit(whole - 1)).cast("long").alias(f"i{c}") for c in "xyz"]
    places, places_at = written(points.groupBy(*"xyz").agg(F.count(F.lit(1)).alias("w")).select("*", *at), "places")
    cells, settled, levels, paths = octree(places)
    near, near_at = _near_leaves(cells, levels, k)
    dealt = F.floor((F.row_number().over(Window.partitionBy("q").orderBy("cell")) - 1) / BLOCK).alias("block")
    near, dealt_at = written(near.select("q", "cell", dealt), "dealt")
    right = near.join(settled, "cell").select("q", "block", "x", "y", "z", "w").toDF("hq", "hblock", "hx", "hy", "hz", "hw")
    left = near.select("q", "block").distinct().join(settled.withColumnRenamed("cell", "q"), "q").select("q", "block", "x", "y", "z")

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        q, p = (np.stack([t.column(c).to_numpy() for c in names], 1) for t, names in ((left, "xyz"), (right, ["hx", "hy", "hz"])))
        weight = right.column("hw").to_numpy()
        most = min(k + 1, len(p))  # the place itself may be one of them
        out: list[list[dict]] = []
        for a in range(0, len(q), 64):
            diff = q[a : a + 64, None, :] - p[None, :, :]
            own = (diff == 0).all(2)
            d = np.sqrt(np.einsum("qpd,qpd->qp", diff, diff))
            pick = np.argpartition(d, most - 1, 1)[:, :most] if most < len(p) else np.tile(np.arange(len(p)), (len(d), 1))
            rows = np.arange(len(d))[:, None]
            w = weight[pick] - own[rows, pick]
            out += [[{"d": x, "w": n} for x, n in zip(r.tolist(), c.tolist()) if n] for r, c in zip(d[rows, pick], w)]
        return pa.table({"x": q[:, 0], "y": q[:, 1], "z": q[:, 2], "near": pa.array(out, pa.list_(pa.struct([("d", pa.float64()), ("w", pa.int64())])))})

    met = left.groupBy("q", "block").cogroup(right.groupBy("hq", "hblock")).applyInArrow(nearest, "x double, y double, z double, near array<struct<d:double,w:bigint>>")
    every = met.groupBy(*"xyz").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))
    taken = F.aggregate(
        "near",
        F.struct(F.lit(k).cast("long").alias("left"), F.lit(0.0).alias("sum")),
        lambda acc, e: F.struct((acc["left"] - F.least(acc["left"], e["w"])).alias("left"), (acc["sum"] + e["d"] * F.least(acc["left"], e["w"])).alias("sum")),
        lambda acc: acc["sum"] / F.lit(k),
    )
    out, _ = written(points.join(every.select(*"xyz", taken.alias("mean_distance")), list("xyz")).select("id", "mean_distance"), "distances")
    delete(spark, places_at, near_at, dealt_at, *paths)
    return out


def outlier_filter(df: DataFrame, k: int = 25, factor: float = 10.5, *, intensity: float | None = None, id_col: str = "_ord") -> DataFrame:
    """Rows whose mean neighbour distance is below the mean of all plus factor population deviations (strictly)."""
    if intensity is not None:
        k, factor = intensity_parameters(intensity)
    far = knn_mean_distance(df, k, id_col=id_col)
    row = far.agg(F.avg("mean_distance").alias("m"), F.stddev_pop("mean_distance").alias("s")).first()
    if row["m"] is None:
        return df
    keep = far.where(F.col("mean_distance") < F.lit(row["m"] + factor * row["s"])).select(F.col("id").alias(id_col))
    return df.join(keep, id_col, "left_semi")


def brute_force(frame: pd.DataFrame, k: int) -> Iterator[float]:
    """Mean distance to the k nearest others of each row; for tests and small tables."""
    at = frame[["x", "y", "z"]].to_numpy(np.float64)
    for i in range(len(at)):
        d = np.sqrt(((at - at[i]) ** 2).sum(1))
        d = np.delete(d, i)
        yield float(np.sort(d)[:k].mean())
