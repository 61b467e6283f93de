"""SOG bundles: a stored ZIP of meta.json and lossless WebP textures whose pixel i is row i."""

from __future__ import annotations

import io
import json
import math
import struct
import zipfile

import numpy as np

from ..schema import coefficients
from . import vp8l
from .codecs import DC, F4, ROT, SCALE, XYZ, Columns, _logit, _others, _put, _sigmoid, _stack, _u8, _whole


def texture_size(n: int) -> tuple[int, int]:
    width = max(4, math.ceil(math.sqrt(n) / 4) * 4)
    return width, max(4, math.ceil(n / width / 4) * 4)


def decode(raw: bytes, mode: str = "spec") -> tuple[Columns, int]:
    """(columns, degree) of a bundle; ValueError if it is none."""
    if not zipfile.is_zipfile(io.BytesIO(raw)):
        raise ValueError("a SOG bundle is a ZIP file")
    z = zipfile.ZipFile(io.BytesIO(raw))
    meta = json.loads(z.read("meta.json"))
    image = lambda name: vp8l.decode(z.read(name)).reshape(-1, 4)
    colours = image(meta["shN"]["files"][0]) if meta.get("shN") else None
    return decode_rows(meta, lambda name: image(name)[: meta["count"]], colours, mode), (meta.get("shN") or {}).get("bands", 0)


def members(z: zipfile.ZipFile, fetch) -> dict[str, tuple[int, int]] | None:
    """(offset, size) of each texture and its blocks in a bundle that this module wrote; None for any other."""
    if json.loads(z.read("meta.json")).get("lumenfield") != {"block": vp8l.BLOCK}:
        return None
    out = {}
    for i in z.infolist():
        if i.compress_type != zipfile.ZIP_STORED:
            return None
        name, extra = struct.unpack("<HH", fetch(i.header_offset + 26, 4))
        out[i.filename] = (i.header_offset + 30 + name + extra, i.file_size)
    return out


def rows_of(fetch, found: dict[str, tuple[int, int]], name: str, start: int, n: int) -> np.ndarray:
    """Pixels of n rows from `start` on of a texture; fetch(offset, size) gives bytes of the bundle."""
    at, size = found[name]
    index, length = found[name + BLOCKS]
    low, high = start // vp8l.BLOCK, -(-(start + n) // vp8l.BLOCK)
    bits = np.frombuffer(fetch(index + low * 8, min((high + 1) * 8, length) - low * 8), "<u8").astype(np.int64)
    first = int(bits[0]) // 8
    end = int(bits[high - low]) // 8 + 1 if len(bits) > high - low else size - vp8l.RIFF_BYTES
    raw = fetch(at + vp8l.RIFF_BYTES + first, end - first)
    got = vp8l.blocks(raw, bits[: high - low] - first * 8, vp8l.tables(fetch(at, min(size, vp8l.HEAD_BYTES))))
    return got[start - low * vp8l.BLOCK :][:n]


def decode_rows(meta: dict, image, colours: np.ndarray | None, mode: str) -> Columns:
    """Columns of the rows whose pixels image(name) gives; colours: the pixels of the palette."""
    out: Columns = {}
    low, high = (image(f)[:, :3].astype(np.float64) for f in meta["means"]["files"])
    mins, maxs = np.array(meta["means"]["mins"]), np.array(meta["means"]["maxs"])
    v = (low + 256 * high) / 65535 * (maxs - mins) + mins
    _put(out, XYZ, np.sign(v) * np.expm1(np.abs(v)))
    _put(out, SCALE, np.array(meta["scales"]["codebook"])[image(meta["scales"]["files"][0])[:, :3]])
    q = image(meta["quats"]["files"][0])
    three = (q[:, :3] / 255.0 - 0.5) * 2
    _put(out, ROT, _whole(three if mode == "legacy" else three / math.sqrt(2), np.clip(q[:, 3].astype(np.int64) - 252, 0, 3)))
    c = image(meta["sh0"]["files"][0])
    _put(out, DC, np.array(meta["sh0"]["codebook"])[c[:, :3]])
    out["opacity"] = _logit(c[:, 3] / 255.0, 1 / 255, 0.9999)
    if colours is not None:
        per = coefficients(meta["shN"]["bands"]) // 3
        i = np.arange(meta["shN"]["count"])
        stride = 64 * per * (3 if mode == "legacy" else 1)
        at = (i // 64 * stride + i % 64 * per)[:, None] + np.arange(per)
        at = np.minimum(at, len(colours) - 1)
        rows = np.array(meta["shN"]["codebook"])[colours[at][:, :, :3]].transpose(0, 2, 1).reshape(len(i), -1)
        labels = image(meta["shN"]["files"][1]).astype(np.int64)
        _put(out, [f"f_rest_{k}" for k in range(3 * per)], rows[labels[:, 0] | labels[:, 1] << 8])
    return out


def nearest(v: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Entries of a sorted codebook, the higher of two equally near."""
    return np.searchsorted((book[1:] + book[:-1]) / 2, v, "right")


def signed_log(v: np.ndarray) -> np.ndarray:
    return np.sign(v) * np.log1p(np.abs(v))


def encode_rows(c: Columns, mins: list[float], maxs: list[float], scales: list[float], colours: list[float]) -> list[bytes]:
    """RGBA bytes of rows in the five textures."""
    n = len(c["x"])
    v = signed_log(_stack(c, XYZ))
    wide = np.array(maxs) - np.array(mins)
    u = np.clip(np.where(wide > 0, (v - mins) / np.where(wide > 0, wide, 1), 0) * 65535, 0, 65535).astype(np.uint16)
    full = lambda rgb, a: np.c_[rgb, np.full(n, 255) if a is None else a].astype(np.uint8).tobytes()
    q = _stack(c, ROT)
    norm = np.linalg.norm(q, axis=1, keepdims=True)
    q = np.where(norm > 0, q / np.where(norm > 0, norm, 1), [1.0, 0, 0, 0])
    big = np.abs(q).argmax(1)
    q *= np.sign(np.take_along_axis(q, big[:, None], 1)) * math.sqrt(2)
    s = nearest(_stack(c, SCALE), np.array(scales))
    d = nearest(_stack(c, DC), np.array(colours))
    return [full(u & 255, None), full(u >> 8, None), full(_u8((_others(q, big) * 0.5 + 0.5) * 255), 252 + big), full(s, None), full(d, _u8(_sigmoid(c["opacity"]) * 255))]


def palette_pixels(rows: np.ndarray, book: list[float]) -> np.ndarray:
    """(height, width, 4): the texture of palette rows, each coefficient the number of an entry of the codebook."""
    per = rows.shape[1] // 3
    index = nearest(rows, np.array(book)).reshape(len(rows), 3, per).transpose(0, 2, 1)
    tall = -(-len(rows) // 64)
    out = np.full((tall * 64 * per, 4), 255, np.uint8)
    out[: len(rows) * per, :3] = index.reshape(-1, 3)
    return out.reshape(tall, 64 * per, 4)


TEXTURES = ["means_l.webp", "means_u.webp", "quats.webp", "scales.webp", "sh0.webp", "shN_labels.webp"]
#: Name behind a texture's of the bits at which its blocks start: 8 bytes each, lowest first.
BLOCKS = ".blocks"


def bundle(out, n: int, textures: list[tuple], mins: list[float], maxs: list[float], scales: list[float], colours: list[float], sh: dict | None) -> None:
    """The ZIP of textures of n rows into a file; a texture: (code lengths, its parts' bytes and bits, bits in all, the
    bits at which blocks start, piece by piece).  sh: bands, palette rows, codebook."""
    width, height = texture_size(n)

    def put(z: zipfile.ZipFile, name: str, pieces) -> None:
        with z.open(name, "w", force_zip64=True) as f:
            for p in pieces:
                f.write(p)

    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, (lengths, parts, bits, starts) in zip(TEXTURES, textures):
            head = vp8l.head_bits(width, height, lengths)
            put(z, name, vp8l.file(width, height, lengths, parts, bits))
            put(z, name + BLOCKS, ((s + head).astype("<u8").tobytes() for s in starts))
        meta = {"version": 2, "asset": {"generator": "lumenfield"}, "count": n, "means": {"mins": mins, "maxs": maxs, "files": TEXTURES[:2]}, "scales": {"codebook": scales, "files": TEXTURES[3:4]}, "quats": {"files": TEXTURES[2:3]}, "sh0": {"codebook": colours, "files": TEXTURES[4:5]}, "lumenfield": {"block": vp8l.BLOCK}}
        if sh:
            rows = np.array(sh["palette"])
            raw, starts = vp8l.encode_blocks(palette_pixels(rows, sh["codebook"]))
            z.writestr("shN_centroids.webp", raw)
            z.writestr("shN_centroids.webp" + BLOCKS, starts.astype("<u8").tobytes())
            meta["shN"] = {"count": len(rows), "bands": sh["bands"], "codebook": sh["codebook"], "files": ["shN_centroids.webp", "shN_labels.webp"]}
        z.writestr("meta.json", json.dumps(meta))
