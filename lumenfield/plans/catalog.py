"""Queries over a splat view of `lineitem` (a projection, the same in both engines) and over `embeddings`."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import (
    SH_C0,
    dc_to_display_u8,
    dc_to_linear,
    fixed24,
    fixed24_decode,
    legacy_w,
    log_scale,
    logit,
    opacity_threshold,
    pack_10_11,
    pack_2_10_10_10,
    pack_8888,
    pack_spz,
    sh_u8,
    sigmoid,
    signed_log,
    signed_log_inverse,
    sog_bytes,
    spatial_hash,
    splat_bytes,
    spz_color_u8,
    spz_sh_u8,
    trunc_u8,
    unit_quantum,
    unpack_10_11,
    unpack_2_10_10_10,
)
from ..operators import codebook, density, filters, neighbours, order, palette, profile

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
#: The columns that the splat view is made of.
SOURCE = [*KEYS, "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
#: The body of the splat view in both engines.
VIEW = """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey,
  l_quantity AS x, l_extendedprice/1000 AS y, l_discount*100 AS z,
  l_tax*20-0.8 AS f_dc_0, l_discount*10-0.5 AS f_dc_1, (l_quantity-25)/20 AS f_dc_2,
  ln(((l_linenumber*10+l_quantity)/130.0)/(1-(l_linenumber*10+l_quantity)/130.0)) AS opacity,
  (l_linenumber*10+l_quantity)/130.0 AS alpha,
  ln(0.01+l_tax) AS scale_0, ln(0.01+l_discount) AS scale_1, ln(l_quantity/100) AS scale_2,
  CAST(l_linenumber AS DOUBLE) AS rot_0, l_quantity-25 AS rot_1,
  CAST(l_partkey%11-5 AS DOUBLE) AS rot_2, CAST(l_suppkey%7-3 AS DOUBLE) AS rot_3"""
WITH = f"WITH splat AS ({VIEW} FROM lineitem)"
ROT = ["rot_0", "rot_1", "rot_2", "rot_3"]
LOW, HIGH = (10.0, 5.0, 1.0), (40.0, 60.0, 8.0)

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def splats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*_parts())


def _parts() -> list[str]:
    """The view's columns one by one."""
    out, depth, held = [], 0, ""
    for c in VIEW.removeprefix("SELECT "):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(held.strip())
            held = ""
        else:
            held += c
    return [*out, held.strip()]


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three dimensions of the embeddings as positions."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")))


POINTS = "p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def rowwise(name: str, columns: dict[str, tuple[Callable[[], Column], str]], doc: str) -> None:
    """A query of column expressions over the splat view, a row for each of its rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return splats(spark, sf_dir).select(*KEYS, *(c().alias(n) for n, (c, _) in columns.items()))

    run.__name__, run.__doc__ = name, doc
    _QUERIES[name] = run
    _SQL[name] = f"{WITH} SELECT {', '.join(KEYS)}, {', '.join(f'{s} AS {n}' for n, (_, s) in columns.items())} FROM splat"


# ---- filters -----------------------------------------------------------------------------------------------
_BOX = " AND ".join(f"{c} BETWEEN {a} AND {b}" for c, a, b in zip("xyz", LOW, HIGH))


@query(f"{WITH} SELECT l_linenumber, COUNT(*) AS n, ROUND(SUM(x), 3) AS sum_x, ROUND(SUM(y), 3) AS sum_y FROM splat WHERE {_BOX} GROUP BY l_linenumber")
def bbox_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = filters.crop_bbox(splats(spark, sf_dir), LOW, HIGH)
    return inside.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 3).alias("sum_x"), F.round(F.sum("y"), 3).alias("sum_y"))


@query(f"{WITH} SELECT l_linenumber, COUNT(*) AS n, ROUND(MIN(opacity), 6) AS least FROM splat WHERE NOT isnan(opacity) AND opacity >= {opacity_threshold(128)!r} GROUP BY l_linenumber")
def alpha_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = filters.filter_alpha(splats(spark, sf_dir), 128)
    return kept.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("opacity"), 6).alias("least"))


@query(f"{WITH} SELECT COUNT(*) AS n, MIN(x) AS min_x, MAX(x) AS max_x, MIN(y) AS min_y, MAX(y) AS max_y, MIN(z) AS min_z, MAX(z) AS max_z FROM splat")
def tight_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.bounds(splats(spark, sf_dir))


# ---- colours, activations, quantisers ----------------------------------------------------------------------
def _clip(v: str, a: float, b: float) -> str:
    return f"least(greatest({v}, {a}), {b})"


def _u8(v: str) -> str:
    return f"CAST(trunc({_clip(v, 0.0, 255.0)}) AS BIGINT)"


_DC = [f"f_dc_{i}" for i in range(3)]
_SC = [f"scale_{i}" for i in range(3)]
rowwise("rgb_from_sh", {n: (lambda c=c: dc_to_display_u8(F.col(c)), f"CAST(trunc(255*pow({_clip(f'0.5+{SH_C0}*{c}', 0.0, 1.0)}, {1 / 2.2!r})) AS BIGINT)") for n, c in zip(("red", "green", "blue"), _DC)}, "Display colours.")
rowwise("dc_linear_rgb", {n: (lambda c=c: F.round(dc_to_linear(F.col(c)), 6), f"round(0.5+{SH_C0}*{c}, 6)") for n, c in zip("rgb", _DC)}, "Linear colours.")
rowwise("spz_colors", {f"c{i}": (lambda c=c: spz_color_u8(F.col(c)), _u8(f"({c}*0.15+0.5)*255.0")) for i, c in enumerate(_DC)}, "Colour bytes at the 0.15 scale.")
rowwise("sigmoid_logit_roundtrip", {"alpha_back": (lambda: F.round(sigmoid(F.col("opacity")), 6), "round(1/(1+exp(-opacity)), 6)"), "logit_back": (lambda: F.round(logit(F.col("alpha"), 1e-7, 1 - 1e-7), 6), f"round(ln({_clip('alpha', 1e-7, 1 - 1e-7)}/(1-{_clip('alpha', 1e-7, 1 - 1e-7)})), 6)"), "narrow": (lambda: F.round(logit(F.col("alpha"), 1 / 255, 0.9999), 6), f"round(ln({_clip('alpha', 1 / 255, 0.9999)}/(1-{_clip('alpha', 1 / 255, 0.9999)})), 6)")}, "Alpha and its logit.")
rowwise("scale_activation", {f"s{i}": (lambda c=c: F.round(F.exp(F.col(c)), 6), f"round(exp({c}), 6)") for i, c in enumerate(_SC)} | {f"q{i}": (lambda c=c: trunc_u8((F.col(c) + 10.0) * 16.0), _u8(f"({c}+10.0)*16.0")) for i, c in enumerate(_SC)} | {"back": (lambda: F.round(log_scale(F.exp(F.col("scale_0"))), 6), "round(ln(greatest(exp(scale_0), 1e-6)), 6)"), "held": (lambda: F.round(F.least(F.greatest(F.col("scale_1") * 10, F.lit(-20.0)), F.lit(20.0)), 6), f"round({_clip('scale_1*10', -20.0, 20.0)}, 6)")}, "Scales, their bytes and bounds.")
rowwise("fixed24_encode_decode", {f"w_{c}": (lambda c=c: fixed24(F.col(c) - 25), f"CAST(round_even(({c}-25)*4096.0, 0) AS BIGINT) & 16777215") for c in "xyz"} | {"back_x": (lambda: fixed24_decode(fixed24(F.col("x") - 25)), "(CASE WHEN (CAST(round_even((x-25)*4096.0, 0) AS BIGINT) & 16777215) >= 8388608 THEN (CAST(round_even((x-25)*4096.0, 0) AS BIGINT) & 16777215) - 16777216 ELSE CAST(round_even((x-25)*4096.0, 0) AS BIGINT) & 16777215 END)/4096.0")}, "24-bit fixed point.")


def _spz_sh(v: str, bits: int) -> str:
    size = 1 << (8 - bits)
    return f"CAST({_clip(f'floor((CAST(round_even({v}*128.0+128.0, 0) AS BIGINT)+{size // 2})/{size}.0)*{size}', 0.0, 255.0)} AS BIGINT)"


rowwise("sh_quant_spz", {f"{n}{i}": (lambda c=c, b=b: spz_sh_u8(F.col(c), b), _spz_sh(c, b)) for i, c in enumerate(_DC) for n, b in (("five", 5), ("four", 4))}, "Coefficient bytes in buckets.")
rowwise("sh_quant_u8", {f"wide{i}": (lambda c=c: sh_u8(F.col(c), -4.0, 4.0, 256.0), _u8(f"({c}+4.0)/8.0*256.0")) for i, c in enumerate(_DC)} | {f"near{i}": (lambda c=c: sh_u8(F.col(c), -2.0, 2.0, 255.0), _u8(f"({c}+2.0)/4.0*255.0")) for i, c in enumerate(_DC)}, "Coefficient bytes over fixed ranges.")
rowwise("u16_byte_split", {"low": (lambda: (F.col("l_partkey") % 65536).bitwiseAND(F.lit(255).cast("long")), "(l_partkey % 65536) & 255"), "high": (lambda: F.shiftright(F.col("l_partkey") % 65536, 8), "(l_partkey % 65536) >> 8"), "back": (lambda: (F.col("l_partkey") % 65536).bitwiseAND(F.lit(255).cast("long")).bitwiseOR(F.shiftleft(F.shiftright(F.col("l_partkey") % 65536, 8), 8)), "l_partkey % 65536")}, "Two bytes of a 16-bit word.")

# ---- rotations ---------------------------------------------------------------------------------------------
_q = lambda: [F.col(c) for c in ROT]
_N2 = "(rot_0*rot_0+rot_1*rot_1+rot_2*rot_2+rot_3*rot_3)"


def _rotation(names: list[str], norm: str) -> tuple[list[str], str, str, list[str]]:
    """SQL of unit components, the largest's index and value, and the three others."""
    u = [f"({c}/{norm})" for c in names]
    top = f"greatest({', '.join(f'abs({c})' for c in u)})"
    at = "(CASE " + " ".join(f"WHEN abs({c}) = {top} THEN {i}" for i, c in enumerate(u[:3])) + " ELSE 3 END)"
    value = f"(CASE {at} WHEN 0 THEN {u[0]} WHEN 1 THEN {u[1]} WHEN 2 THEN {u[2]} ELSE {u[3]} END)"
    return u, at, value, [f"(CASE WHEN {at} > {k} THEN {u[k]} ELSE {u[k + 1]} END)" for k in range(3)]


def _word(at: str, parts: list[str]) -> str:
    return f"((CAST({at} AS BIGINT) << 30) | ({parts[0]} << 20) | ({parts[1]} << 10) | {parts[2]})"


_, _AT, _TOP, _REST = _rotation(ROT, f"(sqrt({_N2})+1e-10)")
_W210 = _word(_AT, [f"CAST({_clip(f'floor(({v}*sign({_TOP})*0.7071067811865476+0.5)*1023.0+0.5)', 0.0, 1023.0)} AS BIGINT)" for v in _REST])
rowwise("quat_pack_2_10_10_10", {"word": (lambda: pack_2_10_10_10(_q()), _W210)}, "Smallest three in ten bits each.")
_, _ATS, _TOPS, _RESTS = _rotation(["rot_1", "rot_2", "rot_3", "rot_0"], f"sqrt({_N2}+1e-9)")
rowwise("quat_spz_v3", {"word": (lambda: pack_spz(_q()), _word(_ATS, [f"((CASE WHEN ({v} < 0) <> ({_TOPS} < 0) THEN 512 ELSE 0 END)::BIGINT | CAST(trunc({_clip(f'abs({v})*{511.0 / 0.7071067811865476!r}+0.5', 0.0, 511.0)}) AS BIGINT))" for v in _RESTS]))}, "Smallest three with signs.")
_, _ATG, _TOPG, _RESTG = _rotation(ROT, f"sqrt({_N2})")
rowwise("quat_sog", {f"b{i}": (lambda i=i: sog_bytes(_q())[i], s) for i, s in enumerate([*(_u8(f"({v}*(sign({_TOPG})*{2.0**0.5!r})*0.5+0.5)*255.0") for v in _RESTG), f"CAST({_ATG}+252 AS BIGINT)"])}, "Three bytes and a tag.")
rowwise("quat_splat_u8", {f"b{i}": (lambda i=i: splat_bytes(_q())[i], _u8(f"{n}/greatest(sqrt({_N2}), 1e-6)*128.0+128.0")) for i, n in enumerate(ROT)}, "Four bytes.")
_u = lambda: [F.col("l_partkey") % 128 / 127.5 - 0.5, F.col("l_suppkey") % 100 / 127.5 - 0.4, F.col("l_linenumber") / 10 - 0.3]
rowwise("quat_legacy", {"w": (lambda: F.round(legacy_w(*_u()), 6), "round(sqrt(greatest(0.0, 1.0-(pow(l_partkey%128/127.5-0.5, 2)+pow(l_suppkey%100/127.5-0.4, 2)+pow(l_linenumber/10-0.3, 2)))), 6)")}, "The fourth component of three.")


@query(f"""{WITH}, w AS (SELECT {', '.join(KEYS)}, {_W210} AS word FROM splat),
u AS (SELECT *, word >> 30 AS big, (((word >> 20) & 1023)/1023.0-0.5)/0.7071067811865476 AS a, (((word >> 10) & 1023)/1023.0-0.5)/0.7071067811865476 AS b, ((word & 1023)/1023.0-0.5)/0.7071067811865476 AS c FROM w),
m AS (SELECT *, sqrt(least(greatest(1.0-(a*a+b*b+c*c), 0.0), 1.0)) AS m FROM u)
SELECT {', '.join(KEYS)}, round(CASE WHEN big = 0 THEN m ELSE a END, 6) AS q0, round(CASE big WHEN 1 THEN m WHEN 0 THEN a ELSE b END, 6) AS q1,
  round(CASE big WHEN 2 THEN m WHEN 3 THEN c ELSE b END, 6) AS q2, round(CASE WHEN big = 3 THEN m ELSE c END, 6) AS q3 FROM m""")
def quat_unpack_2_10_10_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = unpack_2_10_10_10(F.col("word"))
    return splats(spark, sf_dir).select(*KEYS, pack_2_10_10_10(_q()).alias("word")).select(*KEYS, *(F.round(c, 6).alias(f"q{i}") for i, c in enumerate(back)))


# ---- global transforms -------------------------------------------------------------------------------------
@query(f"""{WITH}, l AS (SELECT *, sign(y-50)*ln(abs(y-50)+1) AS ly FROM splat), r AS (SELECT MIN(ly) AS a, MAX(ly) AS b FROM l)
SELECT {', '.join(KEYS)}, round(ly, 6) AS ly, round(sign(ly)*(exp(abs(ly))-1), 6) AS back, CAST(trunc({_clip('(ly-a)/(b-a)*65535', 0.0, 65535.0)}) AS BIGINT) AS u16 FROM l, r""")
def signed_log_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = splats(spark, sf_dir).withColumn("ly", signed_log(F.col("y") - 50))
    ends = logs.agg(F.min("ly").alias("a"), F.max("ly").alias("b"))
    wide = logs.crossJoin(F.broadcast(ends))
    u16 = F.when(F.col("b") > F.col("a"), F.least(F.greatest((F.col("ly") - F.col("a")) / (F.col("b") - F.col("a")) * 65535, F.lit(0.0)), F.lit(65535.0)).cast("long")).otherwise(F.lit(0).cast("long"))
    return wide.select(*KEYS, F.round("ly", 6).alias("ly"), F.round(signed_log_inverse(F.col("ly")), 6).alias("back"), u16.alias("u16"))


# ---- density -----------------------------------------------------------------------------------------------
_VOX = "CAST(floor(x/{0}) AS BIGINT) AS vx, CAST(floor(y/{0}) AS BIGINT) AS vy, CAST(floor(z*2.5/{0}) AS BIGINT) AS vz"
_DENSE = f"""v AS (SELECT *, {_VOX.format(5.0)} FROM splat), h AS (SELECT vx, vy, vz, COUNT(*) AS n FROM v GROUP BY ALL),
dense AS (SELECT * FROM h WHERE n >= floor((SELECT SUM(n) FROM h)*0.1/100))"""
_COMPONENTS = f"""{WITH.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_DENSE},
near AS (SELECT a.vx, a.vy, a.vz, b.vx AS ux, b.vy AS uy, b.vz AS uz FROM dense a JOIN dense b ON abs(a.vx-b.vx)+abs(a.vy-b.vy)+abs(a.vz-b.vz) = 1),
walk AS (SELECT vx, vy, vz, vx AS rx, vy AS ry, vz AS rz FROM dense UNION SELECT n.ux, n.uy, n.uz, w.rx, w.ry, w.rz FROM walk w JOIN near n ON w.vx = n.vx AND w.vy = n.vy AND w.vz = n.vz),
label AS (SELECT vx, vy, vz, MIN(row(rx, ry, rz)) AS r FROM walk GROUP BY vx, vy, vz),
sizes AS (SELECT r, COUNT(*) AS voxels FROM label GROUP BY r)"""


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splats(spark, sf_dir).withColumn("z", F.col("z") * 2.5)


@query(f"{WITH}, {_DENSE} SELECT vx, vy, vz, n FROM h")
def voxel_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.histogram(_scaled(spark, sf_dir), 5.0)


@query(f"{WITH}, {_DENSE} SELECT vx, vy, vz, n FROM dense")
def dense_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.dense_voxels(_scaled(spark, sf_dir), 5.0, 0.1)


@query(f"{_COMPONENTS} SELECT l.vx, l.vy, l.vz, d.n, concat_ws(',', l.r[1], l.r[2], l.r[3]) AS component FROM label l JOIN dense d USING (vx, vy, vz)")
def density_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.components(density.dense_voxels(_scaled(spark, sf_dir), 5.0, 0.1), 0.1).select("vx", "vy", "vz", "n", "component")


_KEPT = "SELECT {0} FROM v JOIN label USING (vx, vy, vz) WHERE r IN ({1})"


@query(f"{_COMPONENTS} {_KEPT.format(', '.join(KEYS), 'SELECT r FROM sizes ORDER BY voxels DESC, r LIMIT 1')}")
def density_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.density_filter(_scaled(spark, sf_dir), 5.0, 0.1).select(*KEYS)


@query(f"{_COMPONENTS} {_KEPT.format(', '.join(KEYS), 'SELECT r FROM sizes WHERE voxels >= 0.05*(SELECT MAX(voxels) FROM sizes)')}")
def density_filter_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.density_filter(_scaled(spark, sf_dir), 5.0, 0.1, keep_multicluster=True).select(*KEYS)


# ---- harmonics ---------------------------------------------------------------------------------------------
#: Twelve coefficients, of which the last two are always zero.
REST = {f"f_rest_{i}": f"CAST(CASE WHEN l_linenumber > {i % 7} AND {i} < 10 THEN (l_suppkey % {i + 3}) / 10.0 ELSE 0 END AS DOUBLE)" for i in range(12)}
_RESTSQL = f"{WITH}, s AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in REST.items())} FROM splat)"


def harmonics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splats(spark, sf_dir).withColumns({n: F.expr(e) for n, e in REST.items()})


_LAST = "coalesce(max(greatest(" + ", ".join(f"CASE WHEN {n} <> 0 THEN {i} ELSE -1 END" for i, n in enumerate(REST)) + ")), -1)"


@query(f"{_RESTSQL} SELECT CAST({_LAST} AS BIGINT) AS last_active, CAST(CASE WHEN {_LAST} >= 24 THEN 3 WHEN {_LAST} >= 9 THEN 2 WHEN {_LAST} >= 0 THEN 1 ELSE 0 END AS BIGINT) AS active_degree, CAST(1 AS BIGINT) AS declared_degree FROM s")
def sh_degree_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = harmonics(spark, sf_dir)
    last = F.coalesce(F.max(filters.active_index(list(REST))), F.lit(-1))
    degree = F.when(last >= 24, 3).when(last >= 9, 2).when(last >= 0, 1).otherwise(0)
    return df.agg(last.cast("long").alias("last_active"), degree.cast("long").alias("active_degree"), F.lit(profile.declared_degree(df.columns)).cast("long").alias("declared_degree"))


@query(f"{_RESTSQL} SELECT {', '.join(f'round(SUM({n}), 3) AS {n}' if i < 9 else f'CAST(0 AS DOUBLE) AS {n}' for i, n in enumerate(REST))} FROM s")
def sh_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.cap_sh(harmonics(spark, sf_dir), 1).agg(*(F.round(F.sum(n), 3).alias(n) for n in REST))


@query(f"{_RESTSQL} SELECT {', '.join(f'round(SUM({n}), 3) AS {n}' for n in list(REST)[:10])} FROM s")
def crop_sh_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = filters.crop_sh(harmonics(spark, sf_dir))
    return kept.agg(*(F.round(F.sum(n), 3).alias(n) for n in kept.columns if n.startswith("f_rest_")))


# ---- order -------------------------------------------------------------------------------------------------
_TIES = ["x", "y", "z", *KEYS, "f_dc_0"]


@query(f"{WITH}, i AS (SELECT {', '.join(KEYS)}, round(exp(scale_0+scale_1+scale_2)/(1+exp(-opacity)), 9) AS importance FROM splat) SELECT * FROM i ORDER BY importance DESC, {', '.join(KEYS)} LIMIT 100")
def importance_order_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    metric = F.round(F.exp(F.col("scale_0") + F.col("scale_1") + F.col("scale_2")) / (1 + F.exp(-F.col("opacity"))), 9)
    return splats(spark, sf_dir).select(*KEYS, metric.alias("importance")).orderBy(F.desc("importance"), *KEYS).limit(100)


_ORD = f"o AS (SELECT *, row_number() OVER (ORDER BY {', '.join(_TIES)}) - 1 AS _ord FROM splat)"


@query(f"{WITH}, {_ORD} SELECT {', '.join(KEYS)}, x, y, z, _ord FROM o")
def lexsort_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.dense_ordinal(splats(spark, sf_dir).select(*KEYS, "x", "y", "z", "f_dc_0"), _TIES).select(*KEYS, "x", "y", "z", "_ord")


@query(f"{WITH}, {_ORD} SELECT _ord // 256 AS chunk_id, COUNT(*) AS n, {', '.join(f'{m.upper()}({c}) AS {m}_{c}' for c in 'xyz' for m in ('min', 'max'))} FROM o GROUP BY 1")
def chunk_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.chunk_bounds(order.dense_ordinal(splats(spark, sf_dir).select(*_TIES), _TIES), ["x", "y", "z"])


@query(f"{WITH}, {_ORD} SELECT _ord // 256 AS bucket_id, COUNT(*) AS n, {', '.join(f'(MIN({c})+MAX({c}))/2 AS center_{c}' for c in 'xyz')} FROM o GROUP BY 1")
def bucket_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.bucket_centers(order.dense_ordinal(splats(spark, sf_dir).select(*_TIES), _TIES))


_BITS = "CAST(CASE WHEN hi_{0} > lo_{0} THEN trunc(least(greatest(({0}-lo_{0})*(1024.0/(hi_{0}-lo_{0})), 0.0), 1023.0)) ELSE 0 END AS BIGINT)"


def _spread_sql(n: str) -> str:
    for shift, mask in ((16, 0xFF0000FF), (8, 0x0300F00F), (4, 0x030C30C3), (2, 0x09249249)):
        n = f"(xor({n}, {n} << {shift}) & {mask})"
    return n


_MORTON = f"""{WITH}, r AS (SELECT {', '.join(f'MIN({c}) AS lo_{c}, MAX({c}) AS hi_{c}' for c in 'xyz')} FROM splat),
g AS (SELECT splat.*, {', '.join(f'{_BITS.format(c)} AS i{c}' for c in 'xyz')} FROM splat, r),
m AS (SELECT *, ({_spread_sql('iz')} << 2) | ({_spread_sql('iy')} << 1) | {_spread_sql('ix')} AS code FROM g)"""


@query(f"{_MORTON} SELECT {', '.join(KEYS)}, code FROM m")
def morton_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.morton_code(splats(spark, sf_dir)).select(*KEYS, "code")


@query(f"{_MORTON} SELECT {', '.join(KEYS)}, code, row_number() OVER (ORDER BY code, {', '.join(_TIES)}) - 1 AS _ord, coalesce(code <> lag(code) OVER (ORDER BY code, {', '.join(_TIES)}), true) AS starts FROM m")
def morton_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    coded = order.dense_ordinal(order.morton_code(splats(spark, sf_dir)).select(*_TIES, "code"), ["code", *_TIES])
    first = F.min("_ord").over(Window.partitionBy("code")) == F.col("_ord")
    return coded.select(*KEYS, "code", "_ord", first.alias("starts"))


def morton_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order along a Morton curve refined in crowded cells, to the end; y in steps of 20, so that cells are crowded."""
    coarse = splats(spark, sf_dir).select(*_TIES).withColumn("y", F.floor(F.col("y") / 20).cast("double"))
    return order.morton_order(coarse, _TIES).select(*KEYS, "_ord")


def _refined_sql() -> str:
    from .scenes import refined_sql

    rows = f"r AS (SELECT * REPLACE (floor(y/20) AS y), row_number() OVER (ORDER BY {', '.join(KEYS)}) AS id FROM splat)"
    return f"{WITH.replace('WITH ', 'WITH RECURSIVE ', 1)}, {rows}, {refined_sql('r', 'id, x, y, z')} SELECT {', '.join(KEYS)}, row_number() OVER (ORDER BY path, {', '.join(_TIES)}) - 1 AS _ord FROM r JOIN path USING (id)"


_QUERIES["morton_refined"] = morton_refined


@query(f"{WITH}, c AS (SELECT CAST(floor(x/7) AS BIGINT) AS cx, CAST(floor(y/7) AS BIGINT) AS cy, CAST(floor(z/7) AS BIGINT) AS cz FROM splat) SELECT ((xor(xor(cx*73856093, cy*19349663), cz*83492791)) % 4096 + 4096) % 4096 AS cell, COUNT(*) AS n FROM c GROUP BY 1")
def spatial_hash_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = [F.floor(F.col(c) / 7) for c in "xyz"]
    return splats(spark, sf_dir).groupBy(spatial_hash(*cells, F.lit(4096).cast("long")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


_BOXED = f"""{WITH}, {_ORD}, b AS (SELECT _ord // 256 AS chunk, {', '.join(f'MIN({c}) AS lo_{c}, MAX({c}) AS hi_{c}' for c in 'xyz')} FROM o GROUP BY 1),
q AS (SELECT o.*, b.*, {', '.join(f"CASE WHEN hi_{c}-lo_{c} < 1e-5 THEN 0 ELSE CAST(least(greatest(floor(({c}-lo_{c})/(hi_{c}-lo_{c})*{t}.0+0.5), 0.0), {t}.0) AS BIGINT) END AS q{c}" for c, t in zip('xyz', (2047, 1023, 2047)))} FROM o JOIN b ON o._ord // 256 = b.chunk),
w AS (SELECT *, (qx << 21) | (qy << 11) | qz AS word FROM q)"""


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order.dense_ordinal(splats(spark, sf_dir).select(*_TIES), _TIES).withColumn("chunk_id", F.floor(F.col("_ord") / order.CHUNK).cast("long"))
    wide = rows.join(order.chunk_bounds(rows, ["x", "y", "z"]).drop("n"), "chunk_id")
    parts = [unit_quantum(F.col(c), F.col(f"min_{c}"), F.col(f"max_{c}"), b) for c, b in zip("xyz", (11, 10, 11))]
    return wide.withColumn("word", pack_10_11(*parts))


@query(f"{_BOXED} SELECT {', '.join(KEYS)}, _ord, word FROM w")
def pack_position_11_10_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).select(*KEYS, "_ord", "word")


@query(f"{_BOXED} SELECT {', '.join(KEYS)}, _ord, round((word >> 21 & 2047)/2047.0*(hi_x-lo_x)+lo_x, 6) AS x, round((word >> 11 & 1023)/1023.0*(hi_y-lo_y)+lo_y, 6) AS y, round((word & 2047)/2047.0*(hi_z-lo_z)+lo_z, 6) AS z FROM w")
def unpack_position_11_10_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = zip("xyz", unpack_10_11(F.col("word")), (2047.0, 1023.0, 2047.0))
    return _packed(spark, sf_dir).select(*KEYS, "_ord", *(F.round(v / t * (F.col(f"max_{c}") - F.col(f"min_{c}")) + F.col(f"min_{c}"), 6).alias(c) for c, v, t in back))


_C8 = [f"CAST(least(greatest(floor((0.5+{SH_C0}*{c}+0.5)/2*255.0+0.5), 0.0), 255.0) AS BIGINT)" for c in _DC]
rowwise("pack_color_8888", {"word": (lambda: pack_8888(*(F.least(F.greatest(F.floor((dc_to_linear(F.col(c)) + 0.5) / 2 * 255.0 + 0.5), F.lit(0)), F.lit(255)).cast("long") for c in _DC), F.least(F.greatest(F.floor(F.col("alpha") * 255.0 + 0.5), F.lit(0)), F.lit(255)).cast("long")), f"({_C8[0]} << 24) | ({_C8[1]} << 16) | ({_C8[2]} << 8) | CAST(least(greatest(floor(alpha*255.0+0.5), 0.0), 255.0) AS BIGINT)")}, "Four bytes of a colour.")

# ---- neighbours --------------------------------------------------------------------------------------------
_KNN = f"""WITH {POINTS}, d AS (SELECT a.vec_id, sqrt(pow(a.x-b.x, 2)+pow(a.y-b.y, 2)+pow(a.z-b.z, 2)) AS d FROM p a JOIN p b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS k FROM d), m AS (SELECT vec_id, AVG(d) AS mean_distance FROM r WHERE k <= 25 GROUP BY vec_id)"""


@query(f"{_KNN} SELECT vec_id, round(mean_distance, 6) AS mean_distance FROM m")
def knn_mean_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.knn_mean_distance(points(spark, sf_dir), 25, id_col="vec_id").select(F.col("id").alias("vec_id"), F.round("mean_distance", 6).alias("mean_distance"))


@query(f"{_KNN}, t AS (SELECT AVG(mean_distance)+2.0*stddev_pop(mean_distance) AS t FROM m) SELECT vec_id FROM m, t WHERE mean_distance < t")
def sor_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.outlier_filter(points(spark, sf_dir), 25, 2.0, id_col="vec_id").select("vec_id")


# ---- codebooks ---------------------------------------------------------------------------------------------
BOOK = [-4.5, -4.0, -3.5, -3.0, -2.75, -2.5, -2.25]
CENTROIDS = [[5.0, 10.0, 1.0], [20.0, 30.0, 5.0], [35.0, 50.0, 8.0], [45.0, 90.0, 2.0]]
_MIDDLES = [(a + b) / 2 for a, b in zip(BOOK, BOOK[1:])]


@query(f"{WITH} SELECT {', '.join(KEYS)}, CAST({' + '.join(f'(CASE WHEN scale_0 >= {m} THEN 1 ELSE 0 END)' for m in _MIDDLES)} AS BIGINT) AS entry, ({BOOK})[1 + {' + '.join(f'(CASE WHEN scale_0 >= {m} THEN 1 ELSE 0 END)' for m in _MIDDLES)}]::DOUBLE AS value FROM splat")
def codebook_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = splats(spark, sf_dir).withColumn("entry", codebook.nearest_entry(F.col("scale_0"), BOOK))
    return found.select(*KEYS, "entry", codebook.entry(F.col("entry"), BOOK).alias("value"))


_D = [f"({'+'.join(f'({c}-{v})*({c}-{v})' for c, v in zip('xyz', row))})" for row in CENTROIDS]


@query(f"{WITH}, d AS (SELECT {', '.join(KEYS)}, {', '.join(f'{s} AS d{i}' for i, s in enumerate(_D))} FROM splat) SELECT {', '.join(KEYS)}, CAST(CASE least(d0, d1, d2, d3) WHEN d0 THEN 0 WHEN d1 THEN 1 WHEN d2 THEN 2 ELSE 3 END AS BIGINT) AS label FROM d")
def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splats(spark, sf_dir).select(*KEYS, codebook.nearest_centroid([F.col(c) for c in "xyz"], CENTROIDS).alias("label"))


@query()
def kmeans_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each of eight learned clusters."""
    labelled, _ = codebook.kmeans(points(spark, sf_dir), ["x", "y", "z"], 8)
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"{WITH}, v AS ({' UNION ALL '.join(f'SELECT round({c}, 6) AS value FROM splat' for c in _SC)}), d AS (SELECT DISTINCT value FROM v) SELECT row_number() OVER (ORDER BY value) - 1 AS entry, value FROM d")
def codebook_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A codebook of up to 256 values learned from the pooled scales, of which fewer differ: those."""
    book = codebook.learn_codebook(splats(spark, sf_dir).select(*(F.round(c, 6).alias(c) for c in _SC)), _SC, 256)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(book)], "entry long, value double").select("entry", F.round("value", 6).alias("value"))


@query(f"""{WITH}, o AS (SELECT s.*, row_number() OVER (ORDER BY {', '.join(_TIES)}) - 1 AS _ord, COUNT(*) OVER () AS n, z/100 AS l_discount, (f_dc_0+0.8)/20 AS l_tax FROM splat s),
g AS (SELECT *, _ord // CAST(ceil(n / greatest(1, least(64, n // 1024))) AS BIGINT) AS segment, round(l_discount, 6) AS discount, round(l_tax, 6) AS tax FROM o),
e AS (SELECT DISTINCT segment, discount, tax FROM g), l AS (SELECT *, row_number() OVER (ORDER BY segment, discount, tax) - 1 AS label FROM e)
SELECT {', '.join(KEYS)}, segment, label, discount, tax FROM g JOIN l USING (segment, discount, tax)""")
def palette_vq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors quantised over runs of the x order: label of each row, and the entry that it stands for.  Fewer vectors
    differ in a run than it may have entries, so that each is its own entry."""
    rows = order.dense_ordinal(splats(spark, sf_dir).select(*_TIES), _TIES).select(*KEYS, "_ord", F.round(F.col("z") / 100, 6).alias("discount"), F.round((F.col("f_dc_0") + 0.8) / 20, 6).alias("tax"))
    n = rows.count()
    entries = palette.learn(rows, ["discount", "tax"], n, palette.size_for(n))
    flat = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(np.concatenate(entries))], "label long, discount double, tax double")
    told = palette.assign(rows.drop("x"), ["discount", "tax"], n, entries).withColumn("segment", palette.segment(n))
    return told.select(*KEYS, "segment", "label").join(flat, "label").select(*KEYS, "segment", "label", F.round("discount", 6).alias("discount"), F.round("tax", 6).alias("tax"))


# ---- sets and projections ----------------------------------------------------------------------------------
@query(f"{WITH} SELECT {', '.join(KEYS)}, x, f_dc_0 AS f_rest_0 FROM splat WHERE l_linenumber <= 3 UNION ALL SELECT {', '.join(KEYS)}, x, 0.0 AS f_rest_0 FROM splat WHERE l_linenumber > 3")
def section_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = splats(spark, sf_dir)
    first = df.where("l_linenumber <= 3").select(*KEYS, "x", F.col("f_dc_0").alias("f_rest_0"))
    return first.unionByName(df.where("l_linenumber > 3").select(*KEYS, "x"), allowMissingColumns=True).fillna(0.0, ["f_rest_0"])


@query(f"{WITH}, v AS ({' UNION ALL '.join(f'SELECT round({c}, 6) AS v FROM splat' for c in _SC)}) SELECT v, COUNT(*) AS n FROM v GROUP BY v")
def pooled_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebook.pooled(splats(spark, sf_dir), _SC).groupBy(F.round("v", 6).alias("v")).agg(F.count(F.lit(1)).alias("n"))


_ALIAS = {"x": "x", "y": "y", "z": "z", "rot_1": "cov_q0", "rot_2": "cov_q1", "rot_3": "cov_q2", "rot_0": "cov_q3", "scale_0": "cov_s0", "scale_1": "cov_s1", "scale_2": "cov_s2", "opacity": "alpha", "f_dc_0": "r_sh0", "f_dc_1": "g_sh0", "f_dc_2": "b_sh0"}


@query(f"{WITH} SELECT {', '.join(KEYS)}, {', '.join(f'round({a}, 6) AS {b}' for a, b in _ALIAS.items())} FROM splat")
def parquet_alias_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splats(spark, sf_dir).select(*KEYS, *(F.round(a, 6).alias(b) for a, b in _ALIAS.items()))


_CC = ["f_dc_0", "f_dc_1", "f_dc_2", "opacity", *_SC, *ROT]


@query(f"{WITH} SELECT {', '.join(KEYS)}, x, y, z, 0.0 AS nx, 0.0 AS ny, 0.0 AS nz, {', '.join(f'round({c}, 6) AS scalar_{c}' for c in _CC)} FROM splat")
def cc_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splats(spark, sf_dir).select(*KEYS, "x", "y", "z", *(F.lit(0.0).alias(n) for n in ("nx", "ny", "nz")), *(F.round(c, 6).alias(f"scalar_{c}") for c in _CC))


@query(f"{WITH} SELECT COUNT(*) AS n, {', '.join(f'{m.upper()}({c}) AS {m}_{c}' for c in 'xyz' for m in ('min', 'max'))}, CAST(0 AS BIGINT) AS declared_degree, CAST(0 AS BIGINT) AS active_degree, true AS has_opacity, true AS has_scale, true AS has_rotation, false AS has_normals, false AS has_rgb FROM splat")
def scene_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.describe(splats(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import scenes

    return _QUERIES | scenes.queries()


def oracle_sql() -> dict[str, str]:
    from . import scenes

    return _SQL | {"morton_refined": _refined_sql()} | scenes.oracle_sql()
