"""Operators against brute force, and their edge rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenfield import sqlfuncs
from lumenfield.convert import Options
from lumenfield.operators import codebook, density, filters, neighbours, order, palette
from lumenfield.streaming import process_stream, windowed_counts

XYZ = "_ord long, x double, y double, z double"


def frame(points):
    return pd.DataFrame({"_ord": range(len(points)), **{c: [float(p[i]) for p in points] for i, c in enumerate("xyz")}})


def make(spark, points):
    return spark.createDataFrame(frame(points), XYZ) if len(points) else spark.createDataFrame([], XYZ)


CLOUDS = {
    "clustered": [(*p, 0) for p in np.random.default_rng(1).normal(size=(120, 2))] + [(50, 50, 50), (90, -40, 3)],
    "duplicates": [(i // 2, 1, 2) for i in range(60)],
    "identical": [(1, 1, 1)] * 20,
    "line": [(i * i, 0, 0) for i in range(40)],
    "few": [(0, 0, 0), (1, 2, 2)],
}


@pytest.mark.parametrize("name", CLOUDS)
def test_neighbours_equal_brute_force(spark, name):
    points = CLOUDS[name]
    got = {r.id: r.mean_distance for r in neighbours.knn_mean_distance(make(spark, points), 5).collect()}
    want = list(neighbours.brute_force(frame(points), min(5, len(points) - 1)))
    assert len(got) == len(points) and np.allclose([got[i] for i in range(len(points))], want)


def test_neighbours_with_far_rows_and_dense_regions(spark, monkeypatch):
    rng = np.random.default_rng(4)
    points = [tuple(p) for p in rng.normal(size=(900, 3))] + [tuple(p) for p in rng.normal(size=(600, 3)) * 1e-4 + 3] + [(1e6, 0, 0), (1e6, 1, 0), (-3e9, 5, 5)] + [(7, 7, 7)] * 400
    sizes = []
    monkeypatch.setattr(neighbours, "LEAF", 64)
    monkeypatch.setattr(neighbours, "BLOCK", 3)
    whole = neighbours.octree

    def watched(places):
        out = whole(places)
        sizes.append(out[1].groupBy("cell").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(neighbours, "octree", watched)
    got = {r.id: r.mean_distance for r in neighbours.knn_mean_distance(make(spark, points), 9).collect()}
    want = list(neighbours.brute_force(frame(points), 9))
    assert len(got) == len(points) and np.allclose([got[i] for i in range(len(points))], want, rtol=1e-9)
    assert sizes == [max(sizes)] and sizes[0] <= 64


def test_outliers(spark):
    assert neighbours.outlier_filter(make(spark, []), 5, 1.0).count() == 0
    assert neighbours.outlier_filter(make(spark, [(1, 2, 3)]), 5, 1.0).count() == 1
    assert neighbours.outlier_filter(make(spark, CLOUDS["identical"]), 5, 1.0).count() == 0  # no spread: strictly below removes all
    blob = [tuple(p) for p in np.random.default_rng(2).normal(size=(500, 3))] + [(1e4, 0, 0), (-1e4, 0, 0), (0, 1e4, 0), (0, -1e4, 0), (0, 0, 1e4)]
    df = make(spark, blob)
    assert neighbours.outlier_filter(df, intensity=10).count() == 500
    assert neighbours.outlier_filter(df, 25, 10.5).count() == 505


@pytest.mark.parametrize("i, k", list(zip(range(1, 11), (10, 14, 18, 23, 27, 32, 36, 41, 45, 50))))
def test_intensity(i, k):
    assert neighbours.intensity_parameters(i)[0] == k


def test_density(spark):
    blob = [(x + 0.5, 0.5, 0.5) for x in range(10) for _ in range(50)] + [(x + 0.5, 20.5, 0.5) for x in range(4) for _ in range(50)] + [(100 + k * 5, 0, 0) for k in range(20)]
    df = make(spark, blob)
    assert density.density_filter(df, 1.0, 1.0).count() == 500
    assert density.density_filter(df, 1.0, 1.0, keep_multicluster=True).count() == 700
    edge = make(spark, [(0.5, 0.5, 0.5)] * 50 + [(1.5, 1.5, 0.5)] * 50)
    assert density.components(density.dense_voxels(edge, 1.0, 1.0), 1.0).select("component").distinct().count() == 2
    assert density.density_filter(edge, 1.0, 1.0).agg(F.max("x")).first()[0] == 0.5  # a tie goes to the smallest voxel
    assert density.density_filter(make(spark, []), 1.0, 1.0).count() == 0
    snake = [(x + 0.5, y + 0.5, 0.5) for y in range(0, 40, 2) for x in range(40)] + [((39 if y % 4 == 1 else 0) + 0.5, y + 0.5, 0.5) for y in range(1, 39, 2)]
    for cloud in (df, make(spark, snake)):
        dense = density.dense_voxels(cloud, 1.0, 0.01)
        whole = {tuple(r) for r in density.components(dense, 0.01).collect()}
        assert {tuple(r) for r in density.components(dense, 1e-9).collect()} == whole
    assert len({r[4] for r in whole}) == 1 and len(whole) == 819


def test_sensitivity():
    assert [tuple(round(v, 3) for v in density.sensitivity_parameters(s)) for s in (0, 0.5, 1)] == [(2.0, 0.1), (1.1, 0.55), (0.2, 1.0)]


def test_bbox_is_closed_and_opacity_edges(spark):
    one, above = np.float32(0.7), np.nextafter(np.float32(0.7), np.float32(9))
    df = spark.createDataFrame([(float(one), 0.0, 0.0), (float(above), 0.0, 0.0), (float("nan"), 0.0, 0.0)], "x float, y float, z float")
    assert filters.crop_bbox(df, (0, 0, 0), (0.7, 1, 1)).count() == 1
    inf = float("inf")
    o = spark.createDataFrame([(-inf,), (float(np.log((1 / 255) / (254 / 255))),), (0.0,), (inf,), (float("nan"),)], "opacity double")
    assert [filters.filter_alpha(o, u).count() for u in (0, 1, 128, 254, 255)] == [5, 3, 1, 1, 0]
    with pytest.raises(ValueError):
        filters.filter_alpha(o, 256)


def test_harmonics(spark):
    df = spark.createDataFrame([(0.0, 1.0, 0.0)], "f_rest_0 float, f_rest_8 float, f_rest_9 float")
    assert filters.last_active(df) == 8 and filters.degree_of(8) == 1 and filters.crop_sh(df).columns == ["f_rest_0", "f_rest_8"]
    assert tuple(filters.cap_sh(df, 0).first()) == (0, 0, 0) and filters.cap_sh(df, 3) is df
    assert tuple(filters.cap_sh(df, 1, "planar").first()) == (0, 0, 0)


def recursive_morton(points, idx):
    """The refined order by recursion, ties by index."""
    p = np.array([points[i] for i in idx])
    low, high = p.min(0), p.max(0)
    if len(idx) <= 1 or (low == high).all():
        return list(idx)
    wide = high - low
    cell = np.clip(np.where(wide > 0, (p - low) * (1024.0 / np.where(wide > 0, wide, 1)), 0), 0, 1023).astype(int)
    code = [sum(((int(c[a]) >> b) & 1) << (3 * b + a) for b in range(10) for a in range(3)) for c in cell]
    groups = {}
    for c, i in zip(code, idx):
        groups.setdefault(c, []).append(i)
    out = []
    for c in sorted(groups):
        out += recursive_morton(points, groups[c]) if len(groups[c]) > 256 else sorted(groups[c])
    return out


def test_morton_order(spark):
    rng = np.random.default_rng(3)
    points = [tuple(p) for p in rng.uniform(0, 1000, (200, 3))] + [tuple(p) for p in rng.uniform(0.1, 0.2, (400, 3))]
    df = make(spark, points).withColumnRenamed("_ord", "i")
    got = [r.i for r in order.morton_order(df, ["i"]).orderBy("_ord").collect()]
    assert got == recursive_morton(points, range(600))


def test_ordinals_do_not_depend_on_partitions(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 100).alias("k"))
    a, b = ({r.id: r._ord for r in order.dense_ordinal(df.repartition(n), ["k", "id"], partitions=n).collect()} for n in (1, 5))
    assert a == b and sorted(a.values()) == list(range(1000))


def test_codebook_ties(spark):
    df = spark.createDataFrame([(v,) for v in (-9.0, 0.5, 0.49, 1.0, 9.0)], "v double")
    assert [r[0] for r in df.select(codebook.nearest_entry(F.col("v"), [0.0, 1.0, 2.0])).collect()] == [0, 1, 0, 1, 2]
    many = [float(i) for i in range(40)]
    assert [r[0] for r in df.select(codebook.nearest_entry(F.col("v"), many)).collect()] == [0, 1, 0, 1, 9]
    assert df.select(codebook.nearest_centroid([F.col("v")], [[0.0], [1.0]]).alias("i")).collect()[1].i == 0
    labelled, centres = codebook.kmeans(df, ["v"], 9)
    assert len(centres) == 5 and labelled.count() == 5


def test_codebook_is_fitted_on_all_values(spark):
    """More rows than any sample, of few values: none is lost, and counts weigh."""
    df = spark.range(120_000).select((-F.pmod("id", F.lit(40)) / 10.0).alias("v"))
    book = codebook.learn_codebook(df, ["v"], 16)
    assert len(book) == 16 and book[0] < -3.5 and book[-1] > -0.4
    assert codebook.learn_codebook(df, ["v"], 40) == sorted(-i / 10.0 for i in range(40))
    heavy = spark.range(1000).select(F.when(F.col("id") < 998, 0.0).otherwise(F.col("id") - 997.0).alias("v"))
    assert codebook.learn_codebook(heavy, ["v"], 2)[0] < 0.01


def test_palettes(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(5000, 3))
    df = spark.createDataFrame(pd.DataFrame({"_ord": range(5000), **{f"c{i}": v[:, i] for i in range(3)}}))
    names, per = ["c0", "c1", "c2"], palette.segment_rows(5000)
    entries = palette.learn(df, names, 5000, 256)
    assert per == 1250 and [len(e) for e in entries] == [64] * 4
    again = palette.learn(df.repartition(5), names, 5000, 256)
    assert all((a == b).all() for a, b in zip(entries, again))
    got = {r["_ord"]: r["label"] for r in palette.assign(df, names, 5000, entries).collect()}
    for i in range(0, 5000, 7):
        d = ((entries[i // per] - v[i]) ** 2).sum(1)
        assert got[i] == 64 * (i // per) + d.argmin()
    whole = np.concatenate(entries)
    error = ((whole[[got[i] for i in range(5000)]] - v) ** 2).sum(1).mean()
    assert error < 0.25 * (v**2).sum(1).mean()
    few = palette.learn(df, names, 5000, 256, fit_rows=200)  # fitted on a sample: entries for all rows all the same
    assert len(few) == 4 and palette.assign(df, names, 5000, few).where("label is null").count() == 0
    same = palette.fit(np.repeat([[1.0, 2.0], [3.0, 4.0]], [60_000, 5], axis=0), 16)
    assert same.tolist() == [[1.0, 2.0], [3.0, 4.0]]
    assert [palette.size_for(n) for n in (0, 5, 1000, 5000, 65_536, 10**8)] == [256, 256, 512, 4096, 65_536, 65_536] and palette.size_for(10**8, 5) == 16_384 and palette.size_for(10**8, 9) == 4096


def test_frequent_values_do_not_fill_a_codebook(spark):
    df = spark.range(200_000).select(F.when(F.col("id") < 70_000, F.lit(0.5)).otherwise(F.col("id") % 2000).cast("double").alias("v"))
    assert len(codebook.learn_codebook(df, ["v"], 256)) == 256


def test_sql_functions(spark):
    sqlfuncs.register(spark)
    assert tuple(spark.sql("SELECT splat_sigmoid(0D), splat_pack_8888(1L, 2L, 3L, 4L), splat_fixed24(-1D), round(splat_signed_exp(splat_signed_log(-3D)), 9)").first()) == (0.5, 0x01020304, 0xFFF000, -3.0)


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(10).select((F.col("id") * 1.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit(1.0).alias("opacity"), F.lit(0.1).alias("f_dc_0"), F.lit(0.1).alias("f_dc_1"), F.lit(0.1).alias("f_dc_2"), F.timestamp_seconds(F.col("id") * 20).alias("ts")).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    out = process_stream(stream, Options(bbox=(2, -1, -1, 5, 1, 1), min_opacity=10, rgb=True))
    q = out.writeStream.format("memory").queryName("kept").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("kept").count() == 4 and "red" in spark.table("kept").columns
    q = windowed_counts(stream, "ts").writeStream.format("memory").outputMode("complete").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 10
    with pytest.raises(ValueError):
        process_stream(stream, Options(sor_intensity=3))
    with pytest.raises(ValueError):
        density.density_filter(stream, 1.0)
