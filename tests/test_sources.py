"""Round trips of scene files, detection, edge files, conversion."""

import gzip
import json
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenfield import cli
from lumenfield.convert import Options, convert, has_extras, info, output_path, process
from lumenfield.schema import rest, standard
from lumenfield.sources import codecs, detect, files, ply, read, vp8l, write

FORMATS = ["3dgs", "cc", "compressed_ply", "splat", "ksplat", "spz", "sog", "parquet"]
#: Largest position error of each format on cloud().
TOLERANCE = {"compressed_ply": 0.01, "spz": 2**-12, "sog": 0.01}


def cloud(n=600, degree=0, seed=1, planar=False):
    rng = np.random.default_rng(seed)
    c = {k: rng.uniform(-2, 2, n) for k in "xyz"} | {k: np.zeros(n) for k in ("nx", "ny", "nz")}
    c |= {f"f_dc_{i}": rng.uniform(-1.5, 1.5, n) for i in range(3)}
    count = {0: 0, 1: 9, 2: 24, 3: 45}[degree]
    c |= {k: rng.uniform(-0.9, 0.9, n) if i < count else np.zeros(n) for i, k in enumerate(rest(3))}
    c |= {"opacity": rng.uniform(-4, 4, n)} | {f"scale_{i}": rng.uniform(-6, 1, n) for i in range(3)}
    q = rng.normal(size=(n, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    c |= {f"rot_{i}": q[:, i] for i in range(4)}
    frame = pd.DataFrame(c).astype(np.float32)
    frame.insert(0, "_ord", np.arange(n))
    return frame


def rows(df):
    return df.orderBy("_ord").toPandas()


def matched(a, b):
    """Rows of b in the order of a, by nearest position."""
    at = b[["x", "y", "z"]].to_numpy(float)
    pick = [int(((at - p) ** 2).sum(1).argmin()) for p in a[["x", "y", "z"]].to_numpy(float)]
    assert len(set(pick)) == len(a)
    return b.iloc[pick].reset_index(drop=True)


def same_rotation(a, b, tol):
    qa, qb = (x[[f"rot_{i}" for i in range(4)]].to_numpy(float) for x in (a, b))
    assert np.abs(np.abs((qa * qb).sum(1)) / np.linalg.norm(qb, axis=1) - 1).max() < tol


@pytest.mark.parametrize("form", FORMATS)
def test_round_trip(spark, tmp_path, form):
    a = cloud(degree=0)
    path = str(tmp_path / f"scene.{form}")
    write(spark.createDataFrame(a), path, form)
    b = matched(a, rows(read(spark, path, form).df))
    assert len(b) == 600
    assert np.abs(a[["x", "y", "z"]].to_numpy() - b[["x", "y", "z"]].to_numpy()).max() <= TOLERANCE.get(form, 1e-6)
    alpha = lambda f: 1 / (1 + np.exp(-f["opacity"].to_numpy(float)))
    assert np.abs(alpha(a) - alpha(b)).max() < 1.01 / 255
    for i in range(3):
        assert np.abs(a[f"scale_{i}"] - b[f"scale_{i}"]).max() < 0.13
        assert np.abs(a[f"f_dc_{i}"] - b[f"f_dc_{i}"]).max() < 0.03
    same_rotation(a, b, 5e-4 if form in ("splat", "sog") else 1e-5)


@pytest.mark.parametrize("form, degree, tol", [("3dgs", 3, 0), ("cc", 3, 0), ("parquet", 3, 0), ("compressed_ply", 3, 1 / 32), ("compressed_ply", 1, 1 / 32), ("spz", 3, 0.07), ("ksplat", 1, 1e-6), ("ksplat", 2, 1e-6)])
def test_harmonics(spark, tmp_path, form, degree, tol):
    a = cloud(300, degree)
    path = str(tmp_path / "scene")
    write(spark.createDataFrame(a), path, form)
    b = matched(a, rows(read(spark, path, form).df))
    names = [c for c in rest(3) if c in b.columns]
    assert len(names) >= {1: 9, 2: 24, 3: 45}[degree]
    assert np.abs(a[names].to_numpy() - b[names].to_numpy()).max() <= tol


@pytest.mark.parametrize("level", [1, 2, 5])
def test_ksplat_levels(spark, tmp_path, level):
    a = cloud(700, 1)
    path = str(tmp_path / "s.ksplat")
    write(spark.createDataFrame(a), path, "ksplat", compression_level=level)
    b = rows(read(spark, path).df)
    assert np.abs(a[["x", "y", "z"]].to_numpy() - b[["x", "y", "z"]].to_numpy()).max() < 1e-4
    assert np.abs(a[rest(1)].to_numpy() - b[rest(1)].to_numpy()).max() < (1e-3 if level == 1 else 4.1 / 255)
    assert np.abs(a["scale_0"] - b["scale_0"]).max() < 0.01


def test_sog_harmonics(spark, tmp_path):
    a = cloud(400, 1)
    for c in rest(1):
        a[c] = np.round(a[c] * 2) / 2
    path = str(tmp_path / "s.sog")
    write(spark.createDataFrame(a), path, "sog")
    b = matched(a, rows(read(spark, path).df))
    assert np.abs(a[rest(1)].to_numpy() - b[rest(1)].to_numpy()).mean() < 0.35  # a palette of 256 of 400 rows
    meta = read(spark, path).meta
    assert meta["count"] == 400 and meta["declared"] == 9


@pytest.mark.parametrize("form", FORMATS)
def test_empty_scene(spark, tmp_path, form):
    df = spark.createDataFrame(cloud(3)).limit(0)
    path = str(tmp_path / "empty")
    write(df, path, form)
    assert read(spark, path, form).df.count() == 0


def test_splat_order_and_stray_bytes(spark, tmp_path):
    a = cloud(50)
    path = str(tmp_path / "s.splat")
    write(spark.createDataFrame(a), path, "splat")
    b = rows(read(spark, path).df)
    metric = np.exp(b[["scale_0", "scale_1", "scale_2"]].sum(axis=1)) / (1 + np.exp(-b["opacity"]))
    assert (np.diff(metric) < 0.5 * metric.to_numpy()[:-1]).all() and metric[0] > 10 * metric[49] and b["red"].max() > 0
    with open(path, "ab") as f:
        f.write(b"1234567")
    assert read(spark, path).df.count() == 50


def test_ply_variants(spark, tmp_path):
    text = "ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty float scalar_f_dc_0\nproperty int scalar_label\nelement poly 1\nproperty list uchar int idx\nend_header\n1 2 3 .5 7\n4 5 6 .25 8\n3 1 2 3\n"
    path = str(tmp_path / "a.ply")
    open(path, "w").write(text)
    assert detect(path) == "cc" and has_extras(path)
    s = read(spark, path)
    assert [tuple(r) for r in s.df.orderBy("_ord").select("x", "f_dc_0", "label").collect()] == [(1.0, 0.5, 7), (4.0, 0.25, 8)]
    assert s.extras["poly"]["columns"]["idx"] == [[1, 2, 3]]
    out = str(tmp_path / "b.ply")
    write(s.df, out, "3dgs", extras=s.extras)
    t = read(spark, out)
    assert t.extras["poly"]["columns"]["idx"] == [[1, 2, 3]] and t.df.count() == 2
    big = b"ply\nformat binary_big_endian 1.0\nelement vertex 1\nproperty double x\nproperty float y\nproperty float z\nproperty float f_dc_0\nend_header\n" + struct.pack(">dfff", 1.5, 2, 3, 0.5)
    open(path, "wb").write(big)
    assert tuple(read(spark, path).df.select("x", "y", "f_dc_0").first()) == (1.5, 2.0, 0.5)


def test_bad_files(spark, tmp_path):
    path = str(tmp_path / "x.ply")
    open(path, "w").write("ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\n")
    with pytest.raises(ValueError):
        detect(path)
    with pytest.raises(ValueError):
        ply.header(path)
    for raw in (b"nothing here at all", gzip.compress(b"\0" * 40), struct.pack("<IIIBBBB", codecs.SPZ_MAGIC, 4, 0, 0, 12, 0, 0)):
        files.store(str(tmp_path / "x.spz"), [raw])
        with pytest.raises(ValueError):
            read(spark, str(tmp_path / "x.spz"))
    files.store(str(tmp_path / "x.sog"), [b"not a zip"])
    with pytest.raises(ValueError):
        read(spark, str(tmp_path / "x.sog"))


def test_spz_old_versions():
    body = struct.pack("<IIIBBBB", codecs.SPZ_MAGIC, 1, 1, 0, 12, 0, 0) + np.array([1, -2, 0.5], "<f2").tobytes() + bytes([128, 10, 20, 30, 160, 160, 160, 127, 128, 200])
    c, degree = codecs.spz_decode(body)
    assert (c["x"][0], c["y"][0], c["z"][0], degree) == (1, -2, 0.5, 0) and abs(sum(c[f"rot_{i}"][0] ** 2 for i in range(4)) - 1) < 1e-6
    two = struct.pack("<IIIBBBB", codecs.SPZ_MAGIC, 2, 1, 0, 12, 0, 0) + bytes([0, 16, 0, 0, 240, 255, 255, 255, 255]) + bytes(10)
    c, _ = codecs.spz_decode(two)
    assert (c["x"][0], c["y"][0]) == (1.0, -1.0)


def test_vp8l():
    rng = np.random.default_rng(0)
    for im in (rng.integers(0, 256, (12, 20, 4)), np.zeros((4, 4, 4)), np.minimum(rng.geometric(0.1, (33, 7, 4)), 255), np.full((1, 1, 4), 9)):
        im = im.astype(np.uint8)
        assert (vp8l.decode(vp8l.encode(im)) == im).all()
    with pytest.raises(ValueError):
        vp8l.decode(b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0")


def test_convert_and_info(spark, tmp_path):
    a = cloud(500, 1)
    src = str(tmp_path / "a.ply")
    write(spark.createDataFrame(a), src, "3dgs")
    options = Options(bbox=(-1, -1, -1, 1, 1, 1), min_opacity=100, sh_level=0, rgb=True, auto_bbox=True)
    out = str(tmp_path / "b.ply")
    report = convert(spark, src, out, "cc", options)
    want = a[(a[["x", "y", "z"]].abs() <= 1).all(axis=1) & (1 / (1 + np.exp(-a["opacity"])) >= 100 / 255)]
    b = read(spark, out)
    assert b.format == "cc" and b.df.count() == len(want) == report["n"]
    assert b.df.agg(F.max(F.abs("f_rest_0"))).first()[0] == 0 and "red" in b.df.columns
    facts = info(spark, src)
    assert (facts["n"], facts["active_degree"], facts["declared_degree"], facts["format"]) == (500, 1, 3, "3dgs")
    for target in FORMATS:
        path = str(tmp_path / f"to.{target}")
        convert(spark, src, path, target, Options(min_opacity=1))
        assert read(spark, path, target).df.count() > 480
    with pytest.raises(ValueError):
        process(spark.createDataFrame(a), Options(sor_intensity=0.5))


def test_cli(spark, tmp_path, capsys):
    src = str(tmp_path / "a.ply")
    write(spark.createDataFrame(cloud(40)), src, "3dgs")
    assert cli.main(["-i", src]) == 1
    assert cli.main(["-i", src, "-f", "splat"]) == 0
    assert cli.main(["-i", str(tmp_path / "a.*"), "--info"]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert [x["format"] for x in lines[1:]] == ["3dgs", "splat"]
    assert cli.main(["-i", src, "-f", "splat", "--min_opacity", "256"]) == 1
    assert output_path("a/b.ply", "cc") == "a/b_cc.ply" and output_path("b.ply", "spz") == "b.spz" and output_path("b.ply", "sog", "c") == "c.sog" and output_path("b.splat", "splat") == "b_processed.splat"


def test_standard_order():
    assert standard(1)[:3] == ["x", "y", "z"] and len(standard(3)) == 62


def test_spz_in_parts(spark, tmp_path, monkeypatch):
    """Pieces deflated apart make one gzip stream, and no task decodes more than a range of it."""
    from lumenfield.sources import gzips, readers

    parts = [b"abc" * 50, b"", b"x", bytes(range(256)) * 9]
    crc = 0
    for p in parts:
        crc = gzips.joined(crc, zlib.crc32(p), len(p))
    raw = b"".join([gzips.HEAD, *(gzips.piece(p, 6) for p in parts), gzips.tail(crc, sum(map(len, parts)))])
    assert gzip.decompress(raw) == b"".join(parts) and crc == zlib.crc32(b"".join(parts))
    monkeypatch.setattr(readers, "ROWS", 100)
    a, path = cloud(730, 2), str(tmp_path / "s.spz")
    write(spark.createDataFrame(a).repartition(5), path, "spz")
    back = read(spark, path)
    assert back.df.rdd.getNumPartitions() == 8
    whole, _ = codecs.spz_decode(gzip.decompress(files.fetch(path)))
    b = rows(back.df)
    assert all((b[c].to_numpy() == whole[c]).all() for c in whole)
    assert np.abs(a[["x", "y", "z"]].to_numpy() - b[["x", "y", "z"]].to_numpy()).max() <= 2**-12
    files.store(path, [files.fetch(path)[:-300]])
    with pytest.raises(ValueError):
        read(spark, path)


def test_units_shared_by_runs(spark, tmp_path):
    """Buckets and chunks that two partitions of an order share are whole in the file."""
    from lumenfield.operators import order

    a = cloud(2000)
    dense = order.dense_ordinal(spark.createDataFrame(a).withColumnRenamed("_ord", "i"), ["i"], partitions=7).drop("i")
    for level in (0, 1):
        one, two = str(tmp_path / f"one{level}"), str(tmp_path / f"two{level}")
        write(dense, one, "ksplat", compression_level=level, dense=True)
        write(spark.createDataFrame(a).coalesce(1), two, "ksplat", compression_level=level)
        assert files.fetch(one) == files.fetch(two)
    with pytest.raises(ValueError):
        write(dense.where("_ord <> 900"), str(tmp_path / "gap"), "ksplat", dense=True)


@pytest.mark.parametrize("degree", [0, 1])
def test_sog_in_parts(spark, tmp_path, monkeypatch, degree):
    """Pieces coded apart make textures that any decoder reads, and tasks read ranges of them alike."""
    from lumenfield.sources import readers, sog, writers

    monkeypatch.setattr(writers, "ROWS", 512)
    monkeypatch.setattr(readers, "ROWS", 300)
    a, path = cloud(1500, degree), str(tmp_path / "s.sog")
    write(spark.createDataFrame(a).repartition(3), path, "sog")
    back = read(spark, path)
    assert back.df.rdd.getNumPartitions() == 5
    whole, own = sog.decode(files.fetch(path))
    b = rows(back.df)
    assert own == degree and len(b) == 1500 and set(whole) - {"nx", "ny", "nz"} <= set(b.columns)
    assert all((b[c].to_numpy() == whole[c]).all() for c in whole)


def test_vp8l_blocks():
    rng = np.random.default_rng(0)
    for im in (np.minimum(rng.geometric(0.05, (36, 40, 4)), 255), np.full((4, 4, 4), 255), rng.integers(0, 256, (8, 64, 4))):
        flat = im.astype(np.uint8).reshape(-1, 4)
        raw, starts = vp8l.encode_blocks(flat.reshape(im.shape))
        assert (vp8l.decode(raw).reshape(-1, 4) == flat).all()
        assert (vp8l.blocks(raw[vp8l.RIFF_BYTES :], starts, vp8l.tables(raw[: vp8l.HEAD_BYTES]))[: len(flat)] == flat).all()
    with pytest.raises(ValueError):
        vp8l.encode(np.zeros((1, 16385, 4), np.uint8))


@pytest.mark.parametrize("form", ["3dgs", "cc"])
def test_ply_encodes_only_columns_that_are_there(spark, tmp_path, monkeypatch, form):
    from lumenfield.sources import writers

    seen, whole = [], writers._sections
    monkeypatch.setattr(writers, "_sections", lambda df, *more: seen.append(df.columns) or whole(df, *more))
    a, path = cloud(50).drop(columns=[*rest(3), "nx", "ny", "nz"]), str(tmp_path / "a.ply")
    write(spark.createDataFrame(a), path, form)
    assert len(seen[0]) == 15
    b = rows(read(spark, path).df)
    assert (b[rest(3)] == 0).all(axis=None) and (b[list(a.columns)].to_numpy() == a.to_numpy()).all()


@pytest.mark.parametrize("form, orders", [("splat", 1), ("ksplat", 0), ("compressed_ply", 1), ("spz", 0)])
def test_orders_are_made_once_by_partitions_that_follow_rows(spark, tmp_path, monkeypatch, form, orders):
    from lumenfield.operators import order

    monkeypatch.setattr(order, "SORTED", 100)
    made, whole = [], order.dense_ordinal
    dense = whole(spark.createDataFrame(cloud(1000)).withColumnRenamed("_ord", "i"), ["i"]).drop("i")
    assert dense.groupBy(F.spark_partition_id()).count().count() >= 1 and dense.select(F.input_file_name().alias("f")).distinct().count() >= 9
    monkeypatch.setattr(order, "dense_ordinal", lambda *a, **b: made.append(a) or whole(*a, **b))
    write(dense, str(tmp_path / "s"), form, dense=True)
    assert len(made) == orders and read(spark, str(tmp_path / "s"), form).df.count() == 1000
