"""Scene files as DataFrames with an ordinal column.  Fixed-size records are read in ranges by many tasks."""

from __future__ import annotations

import json
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ORDINAL, RGB, TAIL, rest, standard
from ..scratch import shared_dir
from . import codecs, files, gzips, ply, sog, vp8l
from .detect import FORMATS, detect

#: Rows that a task reads at a time.
ROWS = 1 << 17
_SPARK = {"i1": "tinyint", "u1": "smallint", "i2": "smallint", "u2": "int", "i4": "int", "u4": "bigint", "f4": "float", "f8": "double"}
_ARROW = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}


@dataclass
class Scene:
    """A splat table with what else its file held."""

    df: DataFrame
    format: str
    extras: dict[str, dict] = field(default_factory=dict)
    meta: dict = field(default_factory=dict)


def _ranges(spark: SparkSession, parts: list[tuple], load: Callable[..., codecs.Columns], fields: dict[str, str]) -> DataFrame:
    """A DataFrame of columns that load(*part[1:]) gives; part: (first ordinal, ...), one task's piece each."""
    schema = ", ".join(f"`{n}` {t}" for n, t in {ORDINAL: "bigint", **fields}.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                first, *args = parts[i]
                got = load(*args)
                n = len(next(iter(got.values()))) if got else 0
                columns = [pa.array(np.arange(first, first + n))]
                for name, kind in fields.items():
                    v = got.get(name)
                    columns.append(pa.array(np.zeros(n) if v is None else v).cast(_ARROW[kind], safe=False))
                yield pa.RecordBatch.from_arrays(columns, [ORDINAL, *fields])

    return spark.range(0, len(parts), 1, max(1, len(parts))).mapInArrow(run, schema)


def _pieces(n: int) -> list[tuple[int, int]]:
    return [(a, min(ROWS, n - a)) for a in range(0, n, ROWS)]


# ---- PLY ---------------------------------------------------------------------------------------------------
PREFIXES = ("scalar_scal_", "scalar_", "scal_")


def _plain_names(names: list[str]) -> dict[str, str]:
    """Column of the table -> property of the file; a plain name wins over a prefixed one."""
    out: dict[str, str] = {}
    for n in names:
        short = next((n[len(p) :] for p in PREFIXES if n.startswith(p)), n)
        if short == n or short not in names:
            if short == n or short not in out:
                out[short] = n
    return out


def read_ply(spark: SparkSession, path: str, head: ply.Header, form: str) -> Scene:
    vertex = head.element("vertex")
    if vertex is None:
        raise ValueError(f"{path} has no vertices")
    kinds = dict(vertex.properties)
    names = _plain_names([n for n, t in vertex.properties if not isinstance(t, tuple)])
    core = standard(3, rgb="red" in names)
    extra = [n for n in names if n not in core]
    fields = {n: "smallint" if n in RGB else "float" for n in core} | {n: _SPARK[kinds[names[n]]] for n in extra}
    others = {e.name for e in head.elements} - {"vertex", "chunk", "sh"}
    simple = head.kind != "ascii" and not any(e.lists for e in head.elements[: head.elements.index(vertex) + 1])
    extras = ply.load(path, head, others) if others else {}
    if simple:
        kind, offset = vertex.dtype(head.order), head.offset("vertex")

        def load(start: int, n: int) -> codecs.Columns:
            rows = np.frombuffer(files.fetch(path, offset + start * kind.itemsize, n * kind.itemsize), kind)
            return {c: rows[p].astype(rows[p].dtype.newbyteorder("=")) for c, p in names.items()}

        parts = [(a, a, n) for a, n in _pieces(vertex.count)]
    else:

        def load() -> codecs.Columns:
            got = ply.load(path, head, {"vertex"})["vertex"]
            return {c: got[p] for c, p in names.items()}

        parts = [(0,)] if vertex.count else []
    shapes = {e.name: e for e in head.elements if e.name in extras}
    return Scene(_ranges(spark, parts, load, fields), form, {k: {"element": shapes[k], "columns": v} for k, v in extras.items()}, {"count": vertex.count, "declared": sum(n.startswith("f_rest_") for n in names)})


def read_compressed(spark: SparkSession, path: str, head: ply.Header) -> Scene:
    if head.element("chunk") is None:
        return read_ply(spark, path, head, "3dgs")
    n = head.element("vertex").count
    sh = head.element("sh")
    names = [p for p, _ in sh.properties] if sh else []
    chunk = head.element("chunk").dtype(head.order)

    def load(start: int, rows: int) -> codecs.Columns:
        low = start // codecs.CHUNK
        chunks = -(-(start + rows) // codecs.CHUNK) - low
        raw = np.frombuffer(files.fetch(path, head.offset("chunk") + low * chunk.itemsize, chunks * chunk.itemsize), chunk)
        bounds = np.stack([raw[b] if b in raw.dtype.names else np.full(chunks, float(b.startswith("max"))) for b in codecs.BOUNDS], 1)
        kind = head.element("vertex").dtype(head.order)
        words = np.frombuffer(files.fetch(path, head.offset("vertex") + start * kind.itemsize, rows * kind.itemsize), kind)
        own = None
        if sh:
            own = np.frombuffer(files.fetch(path, head.offset("sh") + start * len(names), rows * len(names)), np.uint8).reshape(rows, -1)
        return codecs.chunks_decode(bounds, np.stack([words[p] for p in codecs.PACKED], 1), own, start - low * codecs.CHUNK)

    fields = {c: "float" for c in [*standard(0)[:9], *TAIL, *names]}
    return Scene(_ranges(spark, [(a, a, k) for a, k in _pieces(n)], load, fields), "compressed_ply", {}, {"count": n, "declared": len(names), "chunks": head.element("chunk").count})


# ---- binary formats ----------------------------------------------------------------------------------------
def read_splat(spark: SparkSession, path: str) -> Scene:
    n, item = files.length(path) // codecs.SPLAT.itemsize, codecs.SPLAT.itemsize
    fields = {c: "smallint" if c in RGB else "float" for c in standard(0, rgb=True)}
    load = lambda start, rows: codecs.splat_decode(files.fetch(path, start * item, rows * item))
    return Scene(_ranges(spark, [(a, a, k) for a, k in _pieces(n)], load, fields), "splat", {}, {"count": n, "declared": 0})


def read_ksplat(spark: SparkSession, path: str, mode: str) -> Scene:
    sections = codecs.ksplat_sections(lambda a, n: files.fetch(path, a, n))
    degree = max((min(s["degree"], 2) for s in sections), default=0)
    parts, base = [], 0
    for s in sections:
        parts += [(base + a, s, a, k) for a, k in _pieces(s["n"])]
        base += s["n"]

    def load(s: dict, start: int, rows: int) -> codecs.Columns:
        return codecs.ksplat_decode(files.fetch(path, s["offset"] + start * s["item"], rows * s["item"]), s, start, mode)

    return Scene(_ranges(spark, parts, load, {c: "float" for c in standard(degree)}), "ksplat", {}, {"count": base, "declared": len(rest(degree)), "sections": len(sections), "level": sections[0]["level"] if sections else 0})


def _inflated(spark: SparkSession, path: str) -> str:
    """A gzip file inflated by one task, a few MB at a time, to the shared folder; another file itself."""
    if files.fetch(path, 0, 2) != b"\x1f\x8b":
        return path
    out = f"{shared_dir(spark)}/inflated-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        error = None
        for _ in batches:
            try:
                files.store(out, gzips.inflated(path))
            except (OSError, EOFError, zlib.error) as e:
                error = str(e)
        yield pa.RecordBatch.from_arrays([pa.array([error], pa.string())], ["error"])

    error = spark.range(0, 1, 1, 1).mapInArrow(run, "error string").first()["error"]
    if error is not None:
        raise ValueError(f"{path} can't be inflated: {error}")
    return out


def read_spz(spark: SparkSession, path: str) -> Scene:
    """A gzip stream can't be split: one task inflates it, many decode."""
    raw = zlib.decompressobj(31).decompress(files.fetch(path, 0, 4096), 16) if files.fetch(path, 0, 2) == b"\x1f\x8b" else files.fetch(path, 0, 16)
    if len(raw) < 16 or int.from_bytes(raw[:4], "little") != codecs.SPZ_MAGIC or not 1 <= int.from_bytes(raw[4:8], "little") <= 3:
        raise ValueError(f"{path} is no SPZ file of version 1 to 3")
    n, degree = int.from_bytes(raw[8:12], "little"), min(raw[12], 3)
    fields = {c: "smallint" if c in RGB else "float" for c in standard(degree, rgb=True)}
    body = _inflated(spark, path)
    if files.length(body) < 16 + n * sum(codecs.spz_widths(raw)):
        raise ValueError(f"{path} is cut short")
    load = lambda start, rows: codecs.spz_part(lambda a, k: files.fetch(body, a, k), start, rows)
    return Scene(_ranges(spark, [(a, a, k) for a, k in _pieces(n)], load, fields), "spz", {}, {"count": n, "declared": len(rest(degree))})


def read_sog(spark: SparkSession, path: str, mode: str) -> Scene:
    """Ranges of a bundle of one's own, whose textures say where their blocks start; the whole in one task of any other."""
    system, name = files.locate(path)
    fetch = lambda a, k: files.fetch(path, a, k)
    with system.open_input_file(name) as f:
        if not zipfile.is_zipfile(f):
            raise ValueError("a SOG bundle is a ZIP file")
        with zipfile.ZipFile(f) as z:
            meta, found = json.loads(z.read("meta.json")), sog.members(z, fetch)
    n, degree = meta["count"], (meta.get("shN") or {}).get("bands", 0)
    if found is None:
        parts, load = [(0,)] if n else [], lambda: sog.decode(files.fetch(path), mode)[0]
    else:
        parts = [(a, a, k) for a, k in _pieces(n)]

        def load(start: int, rows: int) -> codecs.Columns:
            image = lambda texture: sog.rows_of(fetch, found, texture, start, rows)
            colours = None
            if degree:
                texture = meta["shN"]["files"][0]
                colours = sog.rows_of(fetch, found, texture, 0, found[texture + sog.BLOCKS][1] // 8 * vp8l.BLOCK)
            return sog.decode_rows(meta, image, colours, mode)

    return Scene(_ranges(spark, parts, load, {c: "float" for c in standard(degree)}), "sog", {}, {"count": n, "declared": len(rest(degree))})


# ---- parquet -----------------------------------------------------------------------------------------------
#: Names in Parquet scenes, in the order of the file.
PARQUET = {"cov_q0": "rot_1", "cov_q1": "rot_2", "cov_q2": "rot_3", "cov_q3": "rot_0", "cov_s0": "scale_0", "cov_s1": "scale_1", "cov_s2": "scale_2", "alpha": "opacity"} | {f"{ch}_sh{i}": f"f_dc_{k}" if i == 0 else f"f_rest_{15 * k + i - 1}" for k, ch in enumerate("rgb") for i in range(16)}


def read_parquet(spark: SparkSession, path: str) -> Scene:
    """The fixed core; other columns are left out.  The ordinal follows file and row position."""
    raw = spark.read.parquet(path)
    named = {PARQUET.get(c, c): c for c in raw.columns}
    core = standard(3, rgb="red" in named)
    cols = [(F.coalesce(F.col(named[c]).cast("float"), F.lit(0).cast("float")) if c in named else F.lit(0).cast("float")).cast("smallint" if c in RGB else "float").alias(c) for c in core]
    at = F.monotonically_increasing_id() if ORDINAL not in raw.columns else F.col(ORDINAL)
    return Scene(raw.select(at.alias(ORDINAL), *cols), "parquet", {}, {"declared": sum(c.startswith("f_rest_") for c in named)})


def read(spark: SparkSession, path: str, format: str | None = None, mode: str = "spec") -> Scene:
    """The scene in a file, lazily; its format is told from the path or the first bytes if not given."""
    form = format or detect(path)
    if form not in FORMATS:
        raise ValueError(f"no format {form}")
    if form in ("3dgs", "cc", "compressed_ply"):
        head = ply.header(path)
        return read_compressed(spark, path, head) if form == "compressed_ply" else read_ply(spark, path, head, form)
    if form in ("ksplat", "sog"):
        return (read_ksplat if form == "ksplat" else read_sog)(spark, path, mode)
    return {"splat": read_splat, "spz": read_spz, "parquet": read_parquet}[form](spark, path)
