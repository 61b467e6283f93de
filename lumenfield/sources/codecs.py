"""Bytes of the binary formats to columns and back, with numpy; layouts are fixed by the formats.

Columns are float32 arrays by name.  mode "spec": readers undo what writers do; "legacy": files are read as an
older converter reads them, whose readers and writers are not inverses in some fields.
"""

from __future__ import annotations

import struct

import numpy as np

from ..functions.color import SH_C0, SPZ_COLOR_SCALE
from ..functions.rotation import SQRT1_2
from ..schema import coefficients, rest

Columns = dict[str, np.ndarray]
CHUNK = 256
F4 = np.float32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x.astype(np.float64)))


def _logit(a: np.ndarray, low: float, high: float) -> np.ndarray:
    a = np.clip(a.astype(np.float64), low, high)
    return np.log(a / (1 - a)).astype(F4)


def _u8(v: np.ndarray) -> np.ndarray:
    return np.clip(np.nan_to_num(v), 0, 255).astype(np.uint8)


def _stack(c: Columns, names: list[str]) -> np.ndarray:
    return np.stack([c[n] for n in names], 1).astype(np.float64)


XYZ, DC, SCALE, ROT = list("xyz"), ["f_dc_0", "f_dc_1", "f_dc_2"], ["scale_0", "scale_1", "scale_2"], ["rot_0", "rot_1", "rot_2", "rot_3"]


def _put(out: Columns, names: list[str], rows: np.ndarray) -> None:
    for k, n in enumerate(names):
        out[n] = np.ascontiguousarray(rows[:, k], F4)


def _others(q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The three components of each row that are not the one at `at`, in order."""
    pick = np.arange(3) + (np.arange(3) >= at[:, None])
    return np.take_along_axis(q, pick, 1)


def _whole(three: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Unit quaternions from three components, the one at `at` positive."""
    left = np.sqrt(np.clip(1 - (three**2).sum(1), 0, 1))
    out = np.empty((len(at), 4))
    np.put_along_axis(out, at[:, None], left[:, None], 1)
    np.put_along_axis(out, np.arange(3) + (np.arange(3) >= at[:, None]), three, 1)
    return out


# ---- splat -------------------------------------------------------------------------------------------------
SPLAT = np.dtype([("pos", "<f4", 3), ("scale", "<f4", 3), ("rgba", "u1", 4), ("rot", "u1", 4)])


def splat_decode(raw: bytes) -> Columns:
    """32-byte records; a part of a record at the end is dropped."""
    r = np.frombuffer(raw, SPLAT, len(raw) // SPLAT.itemsize)
    out: Columns = {}
    _put(out, XYZ, r["pos"])
    _put(out, DC, (r["rgba"][:, :3] / 255.0 - 0.5) / SH_C0)
    out["opacity"] = _logit(r["rgba"][:, 3] / 255.0, 1 / 255, 0.9999)
    _put(out, SCALE, np.log(np.maximum(r["scale"].astype(np.float64), 1e-6)))
    q = (r["rot"].astype(np.float64) - 128) / 128
    _put(out, ROT, q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-6))
    for k, n in enumerate(("red", "green", "blue")):
        out[n] = r["rgba"][:, k].astype(np.int16)
    return out


def splat_encode(c: Columns) -> bytes:
    r = np.zeros(len(c["x"]), SPLAT)
    r["pos"], r["scale"] = _stack(c, XYZ), np.exp(_stack(c, SCALE))
    r["rgba"][:, :3] = _u8((0.5 + SH_C0 * _stack(c, DC)) * 255)
    r["rgba"][:, 3] = _u8(_sigmoid(c["opacity"]) * 255)
    q = _stack(c, ROT)
    r["rot"] = _u8(q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-6) * 128 + 128)
    return r.tobytes()


# ---- chunk-compressed PLY ----------------------------------------------------------------------------------
BOUNDS = ["min_x", "min_y", "min_z", "max_x", "max_y", "max_z", "min_scale_x", "min_scale_y", "min_scale_z", "max_scale_x", "max_scale_y", "max_scale_z", "min_r", "min_g", "min_b", "max_r", "max_g", "max_b"]
PACKED = ["packed_position", "packed_rotation", "packed_scale", "packed_color"]


def _steps(v: np.ndarray, low: np.ndarray, high: np.ndarray, bits: tuple[int, int, int]) -> np.ndarray:
    top = (1 << np.array(bits)) - 1
    wide = high - low
    t = np.floor((v - low) / np.where(wide < 1e-5, 1, wide) * top + 0.5)
    return np.where(wide < 1e-5, 0, np.clip(t, 0, top)).astype(np.uint32)


def chunks_encode(c: Columns, sh: list[str]) -> tuple[bytes, bytes, bytes]:
    """(chunk bounds, packed vertices, coefficient bytes) of rows that start at a chunk's first."""
    n = len(c["x"])
    first = np.arange(0, n, CHUNK)
    parts = [_stack(c, XYZ), np.clip(_stack(c, SCALE), -20, 20), _stack(c, DC) * SH_C0 + 0.5]
    ends = [(np.minimum.reduceat(p, first).astype(F4), np.maximum.reduceat(p, first).astype(F4)) for p in parts]
    at = np.arange(n) // CHUNK
    low_high = [(a.astype(np.float64)[at], b.astype(np.float64)[at]) for a, b in ends]
    words = np.zeros((n, 4), "<u4")
    for column, k in ((0, 0), (2, 1)):
        s = _steps(parts[k], *low_high[k], (11, 10, 11))
        words[:, column] = (s[:, 0] << 21) | (s[:, 1] << 11) | s[:, 2]
    q = _stack(c, ROT)
    q /= np.linalg.norm(q, axis=1, keepdims=True) + 1e-10
    big = np.abs(q).argmax(1)
    q *= np.sign(np.take_along_axis(q, big[:, None], 1))
    t = np.clip(np.floor((_others(q, big) * SQRT1_2 + 0.5) * 1023 + 0.5), 0, 1023).astype(np.uint32)
    words[:, 1] = (big.astype(np.uint32) << 30) | (t[:, 0] << 20) | (t[:, 1] << 10) | t[:, 2]
    s = _steps(parts[2], *low_high[2], (8, 8, 8))
    alpha = np.clip(np.floor(_sigmoid(c["opacity"]) * 255 + 0.5), 0, 255).astype(np.uint32)
    words[:, 3] = (s[:, 0] << 24) | (s[:, 1] << 16) | (s[:, 2] << 8) | alpha
    more = np.stack([_u8((c[k].astype(np.float64) / 8 + 0.5) * 256) for k in sh], 1).tobytes() if sh else b""
    return np.concatenate([x for pair in ends for x in pair], 1).astype("<f4").tobytes(), words.tobytes(), more


def chunks_decode(bounds: np.ndarray, words: np.ndarray, sh: np.ndarray | None, start: int = 0) -> Columns:
    """Rows of packed words, the first of which is row `start` of its file; bounds: (chunks, 18) of all chunks."""
    w = words.astype(np.int64)
    b = bounds.astype(np.float64)[(start + np.arange(len(w))) // CHUNK]
    out: Columns = {}

    def wide(word: np.ndarray, shift: tuple, top: tuple, k: int) -> np.ndarray:
        low, high = b[:, k : k + 3], b[:, k + 3 : k + 6]
        return ((word[:, None] >> np.array(shift)) & np.array(top)) / np.array(top) * (high - low) + low

    _put(out, XYZ, wide(w[:, 0], (21, 11, 0), (0x7FF, 0x3FF, 0x7FF), 0))
    for n in ("nx", "ny", "nz"):
        out[n] = np.zeros(len(w), F4)
    _put(out, DC, (wide(w[:, 3], (24, 16, 8), (255, 255, 255), 12) - 0.5) / SH_C0)
    out["opacity"] = _logit((w[:, 3] & 255) / 255.0, 1e-6, 1 - 1e-6)
    _put(out, SCALE, wide(w[:, 2], (21, 11, 0), (0x7FF, 0x3FF, 0x7FF), 6))
    three = (((w[:, 1][:, None] >> np.array([20, 10, 0])) & 1023) / 1023.0 - 0.5) / SQRT1_2
    _put(out, ROT, _whole(three, w[:, 1] >> 30))
    if sh is not None:
        for k in range(sh.shape[1]):
            out[f"f_rest_{k}"] = ((sh[:, k] / 256.0 - 0.5) * 8).astype(F4)
    return out


# ---- ksplat ------------------------------------------------------------------------------------------------
KHEAD, KSECTION = 4096, 1024


def ksplat_record(level: int, degree: int) -> np.dtype:
    n = coefficients(min(degree, 2))
    wide = level == 0
    kinds = [("pos", "<f4" if wide else "<u2", 3), ("scale", "<f4" if wide else "<f2", 3), ("rot", "<f4" if wide else "<f2", 4), ("rgba", "u1", 4)]
    return np.dtype([*kinds, *([("sh", ("<f4", "<f2", "u1")[level], n)] if n else [])])


def ksplat_header(n: int, level: int, degree: int, bucket: int, block: float) -> tuple[bytes, bytes]:
    head, section = bytearray(KHEAD), bytearray(KSECTION)
    head[1] = 1
    struct.pack_into("<IIIIH", head, 4, 1, 1, n, n, level)
    struct.pack_into("<ff", head, 36, -2.0, 2.0)
    full, part = divmod(n, bucket)
    part = int(part > 0)
    struct.pack_into("<II", section, 0, n, n)
    if level:
        struct.pack_into("<IIfH", section, 8, bucket, full + part, block, 12)
        struct.pack_into("<I", section, 24, 32767)
    size = part * 4 + ((full + part) * 12 if level else 0) + n * ksplat_record(level, degree).itemsize
    struct.pack_into("<III", section, 28, size, full, part)
    struct.pack_into("<H", section, 40, degree)
    return bytes(head), bytes(section) + (struct.pack("<I", n % bucket) if part else b"")


def ksplat_encode(c: Columns, level: int, degree: int, bucket: int, block: float) -> tuple[bytes, bytes]:
    """(bucket centres, records) of rows that start at a bucket's first."""
    n = len(c["x"])
    r = np.zeros(n, ksplat_record(level, degree))
    at, centres = _stack(c, XYZ), b""
    if level:
        first = np.arange(0, n, bucket)
        middle = ((np.minimum.reduceat(at, first) + np.maximum.reduceat(at, first)) / 2).astype(F4)
        centres = middle.astype("<f4").tobytes()
        off = at - middle.astype(np.float64)[np.arange(n) // bucket]
        r["pos"] = np.clip(np.rint(off * (32767 / (block / 2))) + 32767, 0, 65535)
    else:
        r["pos"] = at
    r["scale"], r["rot"] = np.exp(_stack(c, SCALE)), _stack(c, ROT)
    r["rgba"][:, :3] = _u8((0.5 + SH_C0 * _stack(c, DC)) * 255)
    r["rgba"][:, 3] = _u8(_sigmoid(c["opacity"]) * 255)
    names = rest(min(degree, 2))
    if names:
        sh = _stack(c, names)
        r["sh"] = _u8((sh + 2) / 4 * 255) if level == 2 else sh
    return centres, r.tobytes()


def ksplat_sections(fetch) -> list[dict]:
    """What the headers say: a dictionary for each section; fetch(offset, size) gives bytes."""
    head = fetch(0, KHEAD)
    if len(head) < KHEAD:
        raise ValueError("a ksplat file cut short")
    most, count, _, _, level = struct.unpack_from("<IIIIH", head, 4)
    low, high = struct.unpack_from("<ff", head, 36)
    low, high = (low, high) if (low, high) != (0.0, 0.0) else (-1.5, 1.5)
    level = min(level, 2)
    at, out = KHEAD + most * KSECTION, []
    for k in range(most):
        s = fetch(KHEAD + k * KSECTION, KSECTION)
        n, room, bucket, buckets, block = struct.unpack_from("<IIIIf", s, 0)
        span = struct.unpack_from("<I", s, 24)[0] or 32767
        full, part = struct.unpack_from("<II", s, 32)
        degree = struct.unpack_from("<H", s, 40)[0]
        lengths = np.frombuffer(fetch(at, 4 * part), "<u4") if part else np.zeros(0, "<u4")
        base = at + 4 * part
        centres = np.frombuffer(fetch(base, 12 * buckets), "<f4").reshape(-1, 3) if level and buckets else None
        base += 12 * buckets if level else 0
        item = ksplat_record(level, degree).itemsize
        if k < count:
            out.append({"n": n, "level": level, "degree": degree, "bucket": bucket, "block": block, "span": span, "full": full, "lengths": lengths, "centres": centres, "offset": base, "low": low, "high": high, "item": item})
        at = base + room * item
    return out


def ksplat_decode(raw: bytes, s: dict, start: int, mode: str = "spec") -> Columns:
    r = np.frombuffer(raw, ksplat_record(s["level"], s["degree"]))
    out: Columns = {}
    if s["level"]:
        ends = np.cumsum(np.r_[np.full(s["full"], s["bucket"]), s["lengths"]])
        bucket = np.searchsorted(ends, start + np.arange(len(r)), "right")
        _put(out, XYZ, (r["pos"].astype(np.float64) - s["span"]) * (s["block"] / 2 / s["span"]) + s["centres"][np.minimum(bucket, len(s["centres"]) - 1)])
    else:
        _put(out, XYZ, r["pos"])
    _put(out, DC, (r["rgba"][:, :3] / 255.0 - 0.5) / SH_C0)
    out["opacity"] = _logit(r["rgba"][:, 3] / 255.0, 1e-7, 1 - 1e-7)
    scale = r["scale"].astype(np.float64)
    _put(out, SCALE, scale if mode == "legacy" else np.log(np.maximum(scale, 1e-30)))
    rot = r["rot"]
    if mode == "legacy" and s["level"]:
        rot = (np.ascontiguousarray(rot).view("<u2").astype(np.float64) - 32767.5) / 32767.5 * 1.41421356
    _put(out, ROT, rot)
    names = rest(min(s["degree"], 2))
    if names:
        sh = r["sh"].astype(np.float64)
        if s["level"] == 2:
            sh = (sh - 128) / 128 if mode == "legacy" else sh / 255 * (s["high"] - s["low"]) + s["low"]
        _put(out, names, sh)
    return out


# ---- SPZ ---------------------------------------------------------------------------------------------------
SPZ_MAGIC, FRACTION = 0x5053474E, 12
DIMS = {0: 0, 1: 3, 2: 8, 3: 15}


def spz_header(n: int, degree: int) -> bytes:
    return struct.pack("<IIIBBBB", SPZ_MAGIC, 3, n, degree, FRACTION, 1, 0)


def spz_layout(degree: int, planar: int) -> list[str]:
    """Coefficient names in file order: red, green, blue of each; planar: names between two channels."""
    return [f"f_rest_{j + ch * planar}" for j in range(DIMS[degree]) for ch in range(3)]


def spz_encode(c: Columns, degree: int, planar: int = 15) -> list[bytes]:
    """The six sections of a version 3 body."""
    fixed = np.rint(_stack(c, XYZ) * (1 << FRACTION)).astype(np.int64) & 0xFFFFFF
    pos = np.stack([fixed & 255, (fixed >> 8) & 255, fixed >> 16], 2).astype(np.uint8)
    q = _stack(c, ["rot_1", "rot_2", "rot_3", "rot_0"])
    q /= np.sqrt((q**2).sum(1, keepdims=True) + 1e-9)
    big = np.abs(q).argmax(1)
    turned = np.take_along_axis(q, big[:, None], 1) < 0
    three = _others(q, big)
    part = (((three < 0) != turned).astype(np.uint32) << 9) | np.clip(np.abs(three) * (511 / SQRT1_2) + 0.5, 0, 511).astype(np.uint32)
    word = (big.astype(np.uint32) << 30) | (part[:, 0] << 20) | (part[:, 1] << 10) | part[:, 2]
    out = [pos.tobytes(), _u8(_sigmoid(np.clip(c["opacity"], -20, 20)) * 255).tobytes(), _u8((_stack(c, DC) * SPZ_COLOR_SCALE + 0.5) * 255).tobytes(), _u8((_stack(c, SCALE) + 10) * 16).tobytes(), word.astype("<u4").tobytes(), b""]
    names = spz_layout(degree, planar)
    if names:
        sh = _stack(c, names)
        size = np.where(np.arange(len(names)) < 9, 8, 16)
        out[5] = np.clip((np.rint(sh * 128 + 128).astype(np.int64) + size // 2) // size * size, 0, 255).astype(np.uint8).tobytes()
    return out


def spz_widths(head: bytes) -> list[int]:
    """Bytes of a row in each section of a file, by its header."""
    _, version, _, degree, *_ = struct.unpack_from("<IIIBBBB", head, 0)
    return [6 if version == 1 else 9, 1, 3, 3, 4 if version == 3 else 3, 3 * DIMS.get(degree, 0)]


def spz_part(fetch, start: int, rows: int) -> Columns:
    """Rows of an inflated file; fetch(offset, size) gives bytes."""
    head = fetch(0, 16)
    magic, version, n, *more = struct.unpack_from("<IIIBBBB", head, 0)
    at, out = 16, [struct.pack("<IIIBBBB", magic, version, rows, *more)]
    for width in spz_widths(head):
        out.append(fetch(at + start * width, rows * width) if width else b"")
        at += n * width
    return spz_decode(b"".join(out))[0]


def spz_decode(raw: bytes) -> tuple[Columns, int]:
    """(columns, degree) of an inflated file; ValueError if it is none."""
    if len(raw) < 16:
        raise ValueError("an SPZ file cut short")
    magic, version, n, degree, fraction, _, _ = struct.unpack_from("<IIIBBBB", raw, 0)
    if magic != SPZ_MAGIC or not 1 <= version <= 3:
        raise ValueError("not an SPZ file of version 1 to 3")
    at = 16

    def take(kind: str, width: int) -> np.ndarray:
        nonlocal at
        if at + n * width * np.dtype(kind).itemsize > len(raw):
            raise ValueError("an SPZ file cut short")
        got = np.frombuffer(raw, kind, n * width, at).reshape(n, width)
        at += got.nbytes
        return got

    out: Columns = {}
    if version == 1:
        _put(out, XYZ, take("<f2", 3))
    else:
        b = take("u1", 9).reshape(n, 3, 3).astype(np.int64)
        v = b[:, :, 0] | (b[:, :, 1] << 8) | (b[:, :, 2] << 16)
        _put(out, XYZ, np.where(v >= 0x800000, v - 0x1000000, v) / (1 << fraction))
    out["opacity"] = _logit(take("u1", 1)[:, 0] / 255.0, 1e-7, 1 - 1e-7)
    dc = (take("u1", 3) / 255.0 - 0.5) / SPZ_COLOR_SCALE
    _put(out, DC, dc)
    _put(out, SCALE, take("u1", 3) / 16.0 - 10)
    if version == 3:
        w = take("<u4", 1)[:, 0].astype(np.int64)
        part = (w[:, None] >> np.array([20, 10, 0])) & 1023
        q = _whole((part & 511) / 511.0 * SQRT1_2 * (1 - 2.0 * (part >> 9)), w >> 30)
    else:
        xyz = take("u1", 3) / 127.5 - 1
        q = np.c_[xyz, np.sqrt(np.maximum(0, 1 - (xyz**2).sum(1)))]
    _put(out, ROT, q[:, [3, 0, 1, 2]])
    dim = DIMS.get(degree, 0)
    if dim:
        _put(out, spz_layout(degree, dim), (take("u1", 3 * dim) - 128.0) / 128.0)
    for k, name in enumerate(("red", "green", "blue")):
        out[name] = _u8((0.5 + SH_C0 * dc[:, k]) * 255).astype(np.int16)
    return out, degree
