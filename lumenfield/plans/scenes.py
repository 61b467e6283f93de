"""Round trips through scene files: the splat view written and read back, row by row, and SQL for what must come back.

The SQL quantises and decodes on its own; positions, scales and colours are FLOAT as files hold them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import SH_C0
from ..operators import order
from ..scratch import shared_dir
from ..sources import read, write
from . import catalog as c

VALUES = ["x", "y", "z", "f_dc_0", "f_dc_1", "f_dc_2", "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3"]
DIGITS = 4


def scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The splat view as FLOAT columns with a dense ordinal.  The view's few source columns are sorted, not the view."""
    view = dict(reversed(p.rsplit(" AS ", 1)) if " AS " in p else (p, p) for p in c._parts())
    raw = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*c.SOURCE)
    rows = order.dense_ordinal(raw, [view[k] if view[k] in c.SOURCE else F.expr(view[k]) for k in c._TIES])
    return rows.select("_ord", *(F.expr(view[v]).cast("float").alias(v) for v in VALUES))


def _back(form: str, ordered: bool, columns: list[str] = VALUES, **how) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Write the splat view as a scene file and read it back."""
        path = f"{shared_dir(spark)}/scene-{uuid.uuid4().hex}"
        write(scene(spark, sf_dir), path, form, dense=True, **how)
        rows = read(spark, path, form).df
        return rows.select(*(["_ord"] if ordered else []), *(F.round(F.col(v).cast("double"), DIGITS).alias(v) for v in columns))

    return run


# ---- SQL ---------------------------------------------------------------------------------------------------
_F = f"{c.WITH}, {c._ORD}, f AS (SELECT _ord, {', '.join(f'CAST(CAST({v} AS FLOAT) AS DOUBLE) AS {v}' for v in VALUES)} FROM o)"
_F_RECURSIVE = _F.replace("WITH ", "WITH RECURSIVE ", 1)
_Q = ["rot_0", "rot_1", "rot_2", "rot_3"]


def _shown(columns: dict[str, str], ordered: bool, source: str = "f") -> str:
    return f" SELECT {'_ord, ' if ordered else ''}{', '.join(f'round(CAST(CAST({e} AS FLOAT) AS DOUBLE), {DIGITS}) AS {n}' for n, e in columns.items())} FROM {source}"


def _byte(v: str) -> str:
    return f"trunc(least(greatest({v}, 0.0), 255.0))"


def _logit(a: str, low: str, high: str) -> str:
    a = f"least(greatest({a}, {low}), {high})"
    return f"ln({a}/(1-{a}))"


_ALPHA = _byte("1/(1+exp(-opacity))*255")
_COLOURS = {v: f"({_byte(f'(0.5+{SH_C0}*{v})*255')}/255.0-0.5)/{SH_C0}" for v in c._DC}
_SAME = {v: v for v in VALUES}


def _whole(three: list[str], at: str, names: list[str]) -> dict[str, str]:
    """Unit quaternions from three components, the one at `at` positive."""
    left = f"sqrt(least(greatest(1-({'+'.join(f'{t}*{t}' for t in three)}), 0.0), 1.0))"
    return {n: f"(CASE WHEN {at} = {k} THEN {left} WHEN {at} > {k} THEN {three[min(k, 2)]} ELSE {three[max(k - 1, 0)]} END)" for k, n in enumerate(names)}


_NORM = f"greatest(sqrt({c._N2}), 1e-6)"
_BYTES = [f"(({_byte(f'{q}/{_NORM}*128.0+128.0')})-128)/128.0" for q in _Q]
_BYTES_NORM = f"greatest(sqrt({'+'.join(f'{b}*{b}' for b in _BYTES)}), 1e-6)"
_SPLAT = _SAME | _COLOURS | {"opacity": _logit(f"{_ALPHA}/255.0", "1/255.0", "0.9999")} | {s: f"ln(greatest(CAST(CAST(exp({s}) AS FLOAT) AS DOUBLE), 1e-6))" for s in c._SC} | {q: f"{b}/{_BYTES_NORM}" for q, b in zip(_Q, _BYTES)}
_KSPLAT = _SAME | _COLOURS | {"opacity": _logit(f"{_ALPHA}/255.0", "1e-7", "1-1e-7")} | {s: f"ln(greatest(CAST(CAST(exp({s}) AS FLOAT) AS DOUBLE), 1e-30))" for s in c._SC}

# buckets of 256 rows around their middles, steps of 2.5 / 32767
_MIDDLE = f", m AS (SELECT _ord // 256 AS b, {', '.join(f'CAST(CAST((MIN({v})+MAX({v}))/2 AS FLOAT) AS DOUBLE) AS m_{v}' for v in 'xyz')} FROM f GROUP BY 1), j AS (SELECT * FROM f JOIN m ON f._ord // 256 = m.b)"
_BUCKETS = {v: f"(least(greatest(round_even(({v}-m_{v})*(32767/2.5), 0)+32767, 0.0), 65535.0)-32767)*(2.5/32767)+m_{v}" for v in "xyz"}

_SPZ_PART = [f"(trunc(least(greatest(abs({v})*{511.0 / 0.7071067811865476!r}+0.5, 0.0), 511.0))/511.0*0.7071067811865476*(CASE WHEN ({v} < 0) <> ({c._TOPS} < 0) THEN -1 ELSE 1 END))" for v in c._RESTS]
_SPZ = {v: f"round_even({v}*4096.0, 0)/4096.0" for v in "xyz"} | {v: f"({_byte(f'({v}*0.15+0.5)*255')}/255.0-0.5)/0.15" for v in c._DC} | {"opacity": _logit(f"{_ALPHA}/255.0", "1e-7", "1-1e-7")} | {s: f"{_byte(f'({s}+10)*16')}/16.0-10" for s in c._SC} | _whole(_SPZ_PART, c._ATS, ["rot_1", "rot_2", "rot_3", "rot_0"])

# Morton order on FLOAT positions, refined where more than 256 rows share a cell, then chunks of 256 rows
_CELL = "CAST(CASE WHEN hi_{0} > lo_{0} THEN trunc(least(greatest(({0}-lo_{0})::DOUBLE*(1024::DOUBLE/(hi_{0}-lo_{0})::DOUBLE), 0.0), 1023.0)) ELSE 0 END AS BIGINT)"


def _code(source: str, names: str) -> str:
    """SQL that adds `code` to rows with bounds."""
    cells = f"SELECT *, {', '.join(f'{_CELL.format(v)} AS i{v}' for v in 'xyz')} FROM ({source})"
    return f"SELECT {names}, ({c._spread_sql('iz')} << 2) | ({c._spread_sql('iy')} << 1) | {c._spread_sql('ix')} AS code FROM ({cells})"


def refined_sql(rows: str, names: str) -> str:
    """CTEs `walk` and `path`: the Morton codes (a list, one for each refinement) of rows with `id`, x, y and z."""
    ends = ", ".join(f"MIN({v}) OVER {{0}} AS lo_{v}, MAX({v}) OVER {{0}} AS hi_{v}" for v in "xyz")
    first = _code(f"SELECT *, {ends.format('()')} FROM {rows}", names)
    deeper = _code(f"SELECT * FROM (SELECT *, COUNT(*) OVER w AS c, {ends.format('w')} FROM walk WINDOW w AS (PARTITION BY path)) WHERE c > 256 AND (hi_x > lo_x OR hi_y > lo_y OR hi_z > lo_z)", f"{names}, path")
    return f"""walk AS (SELECT {names}, [code] AS path FROM ({first}) UNION ALL SELECT {names}, list_append(path, code) AS path FROM ({deeper})),
path AS (SELECT id, max(path) AS path FROM walk GROUP BY id)"""


_PARTS = {"x": ("x", 2047), "y": ("y", 1023), "z": ("z", 2047)} | {s: (f"least(greatest({s}, -20.0), 20.0)", t) for s, t in zip(c._SC, (2047, 1023, 2047))} | {d: (f"({d}*{SH_C0}+0.5)", 255) for d in c._DC}
_CHUNKS = f"""{_F_RECURSIVE}, p AS (SELECT _ord AS id, CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, CAST(z AS FLOAT) AS z FROM f),
{refined_sql('p', 'id, x, y, z')},
n AS (SELECT f.* REPLACE (row_number() OVER (ORDER BY path, _ord) - 1 AS _ord) FROM f JOIN path ON f._ord = path.id),
b AS (SELECT _ord // 256 AS chunk, {', '.join(f'CAST(CAST(MIN({e}) AS FLOAT) AS DOUBLE) AS lo_{v}, CAST(CAST(MAX({e}) AS FLOAT) AS DOUBLE) AS hi_{v}' for v, (e, _) in _PARTS.items())} FROM n GROUP BY 1),
j AS (SELECT * FROM n JOIN b ON n._ord // 256 = b.chunk)"""


def _stepped(v: str) -> str:
    e, top = _PARTS[v]
    step = f"(CASE WHEN hi_{v}-lo_{v} < 1e-5 THEN 0 ELSE least(greatest(floor(({e}-lo_{v})/(hi_{v}-lo_{v})*{top}.0+0.5), 0.0), {top}.0) END)"
    return f"({step}/{top}.0*(hi_{v}-lo_{v})+lo_{v})"


_TEN = [f"((least(greatest(floor(({v}*sign({c._TOP})*0.7071067811865476+0.5)*1023.0+0.5), 0.0), 1023.0)/1023.0-0.5)/0.7071067811865476)" for v in c._REST]
_COMPRESSED = {v: _stepped(v) for v in (*"xyz", *c._SC)} | {d: f"({_stepped(d)}-0.5)/{SH_C0}" for d in c._DC} | {"opacity": _logit("least(greatest(floor(1/(1+exp(-opacity))*255+0.5), 0.0), 255.0)/255.0", "1e-6", "1-1e-6")} | _whole(_TEN, c._AT, _Q)

_SOG_ENDS = f", l AS (SELECT *, {', '.join(f'sign({v})*ln(1+abs({v})) AS l{v}' for v in 'xyz')} FROM f), e AS (SELECT {', '.join(f'MIN(l{v}) AS lo_{v}, MAX(l{v}) AS hi_{v}' for v in 'xyz')} FROM l), j AS (SELECT * FROM l, e)"
_WORD = {v: f"(CASE WHEN hi_{v} > lo_{v} THEN trunc(least(greatest((l{v}-lo_{v})/(hi_{v}-lo_{v})*65535, 0.0), 65535.0)) ELSE 0 END/65535.0*(hi_{v}-lo_{v})+lo_{v})" for v in "xyz"}
_SOG_THREE = [f"(({_byte(f'({v}*(sign({c._TOPG})*{2.0**0.5!r})*0.5+0.5)*255.0')}/255.0-0.5)*2/{2.0**0.5!r})" for v in c._RESTG]
_SOG = _SAME | {v: f"sign({w})*(exp(abs({w}))-1)" for v, w in _WORD.items()} | {"opacity": _logit(f"{_ALPHA}/255.0", "1/255.0", "0.9999")} | _whole(_SOG_THREE, c._ATG, _Q)

_ALL = {
    "codec_roundtrip_3dgs": (_back("3dgs", True), _F + _shown(_SAME, True)),
    "codec_roundtrip_cc": (_back("cc", True), _F + _shown(_SAME, True)),
    "codec_roundtrip_parquet": (_back("parquet", False), _F + _shown(_SAME, False)),
    "codec_roundtrip_splat": (_back("splat", False), _F + _shown(_SPLAT, False)),
    "codec_roundtrip_ksplat": (_back("ksplat", True), _F + _shown(_KSPLAT, True)),
    "codec_roundtrip_ksplat_buckets": (_back("ksplat", True, ["x", "y", "z"], compression_level=1), _F + _MIDDLE + _shown(_BUCKETS, True, "j")),
    "codec_roundtrip_spz": (_back("spz", True), _F + _shown(_SPZ, True)),
    "codec_roundtrip_compressed_ply": (_back("compressed_ply", True), _CHUNKS + _shown(_COMPRESSED, True, "j")),
    "codec_roundtrip_sog": (_back("sog", False), _F + _SOG_ENDS + _shown(_SOG, False, "j")),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items()}
