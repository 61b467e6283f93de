"""Telephony audio columns: mu-law and A-law by lookup tables, ADPCM with numpy across blocks, resampled PCM.

A payload is stored losslessly as the samples of a WAVE file (format 7, 6 or 17), beside it the PCM that it expands to,
resampled, in a table of the shared folder; what is measured is read back from there.  Payloads of any length up
to half a gigabyte fit: a value of an Arrow table holds less than two, and the PCM takes up to four times as much.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, raw_bytes, stash
from .tokens import gather

#: Payload bytes in one unit; also one ADPCM block: a 4-byte head and 188 bytes of 4-bit steps.
UNIT = 192
RATE, PCM_RATE = 8000, 16000
FORMATS = {"mulaw": 7, "alaw": 6, "adpcm": 17}
BLOCK_SAMPLES = (UNIT - 4) * 2 + 1
#: Blocks that are decoded at a time.
BLOCKS = 1 << 14
#: Bytes of payloads taken at a time, about; their PCM is four times as large, and every copy of it counts.
GATHER = 1 << 20


def _mulaw_table() -> np.ndarray:
    u = ~np.arange(256) & 0xFF
    size = ((((u & 0x0F) << 3) + 0x84) << ((u >> 4) & 7)) - 0x84
    return np.where(u & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    step, low = (a >> 4) & 7, ((a & 0x0F) << 4) + 8
    size = np.where(step == 0, low, (low + 0x100) << np.maximum(step - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


MULAW, ALAW = _mulaw_table(), _alaw_table()
#: Fixed values of the IMA ADPCM format: step sizes, and moves of the step index by code.
_STEPS = [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767]
STEPS = np.array(_STEPS, np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def adpcm_decode(data: bytes) -> np.ndarray:
    """PCM of whole mono IMA ADPCM blocks: one step of all blocks at a time.  A head's step index above 88
    counts as 88."""
    blocks = np.frombuffer(data, np.uint8).reshape(-1, UNIT)
    if len(blocks) > BLOCKS:
        return np.concatenate([adpcm_decode(data[k : k + BLOCKS * UNIT]) for k in range(0, len(data), BLOCKS * UNIT)])
    out = np.empty((len(blocks), BLOCK_SAMPLES), np.int32)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    out[:, 0] = value
    for i in range(BLOCK_SAMPLES - 1):
        code = (blocks[:, 4 + i // 2] >> (4 * (i & 1))) & 15
        step = STEPS[index]
        diff = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - diff, value + diff), -32768, 32767)
        index = np.clip(index + MOVES[code], 0, 88)
        out[:, i + 1] = value
    return out.astype(np.int16).ravel()


def adpcm_encode(pcm: np.ndarray) -> bytes:
    """Mono IMA ADPCM blocks of PCM, the last one padded by repeating its last sample; lossy."""
    n = max(1, -(-len(pcm) // BLOCK_SAMPLES))
    padded = np.concatenate([pcm, np.full(n * BLOCK_SAMPLES - len(pcm), pcm[-1] if len(pcm) else 0, np.int16)]).astype(np.int32).reshape(n, -1)
    blocks = np.zeros((n, UNIT), np.uint8)
    blocks[:, :2] = padded[:, :1].astype("<i2").view(np.uint8)
    value, index = padded[:, 0].copy(), np.zeros(n, np.int32)
    for i in range(BLOCK_SAMPLES - 1):
        step, delta = STEPS[index], padded[:, i + 1] - value
        code, rest, diff = np.where(delta < 0, 8, 0), np.abs(delta), step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            hit = rest >= part
            code, rest, diff = code + np.where(hit, bit, 0), rest - np.where(hit, part, 0), diff + np.where(hit, part, 0)
        value = np.clip(np.where(code & 8, value - diff, value + diff), -32768, 32767)
        index = np.clip(index + MOVES[code], 0, 88)
        blocks[:, 4 + i // 2] |= (code << (4 * (i & 1))).astype(np.uint8)
    return blocks.tobytes()


def expand(data: bytes, codec: str) -> np.ndarray:
    """16-bit PCM of stored samples."""
    if codec == "adpcm":
        return adpcm_decode(data)
    return {"mulaw": MULAW, "alaw": ALAW}[codec][np.frombuffer(data, np.uint8)]


def expand_many(stored: list[bytes], codec: str) -> list[np.ndarray]:
    """expand() of several payloads in one step."""
    whole = expand(b"".join(stored), codec)
    ends = np.cumsum([len(x) if codec != "adpcm" else len(x) // UNIT * BLOCK_SAMPLES for x in stored]).tolist()
    return [whole[a:b] for a, b in zip([0, *ends], ends)]


def resample(pcm: np.ndarray, rate: int = RATE, to: int = PCM_RATE) -> np.ndarray:
    """PCM at another rate by linear interpolation; doubling keeps every sample and adds the means between, halving
    takes the means of pairs."""
    if rate == to or not len(pcm):
        return pcm
    if rate == 2 * to:
        wide = np.append(pcm, pcm[-1:]) if len(pcm) & 1 else pcm
        return ((wide[::2].astype(np.int32) + wide[1::2]) >> 1).astype(np.int16)
    if to == 2 * rate:
        out = np.empty(2 * len(pcm), np.int16)
        out[::2] = pcm
        wide = pcm.astype(np.int32)
        out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
        out[-1] = pcm[-1]
        return out
    n = len(pcm) * to // rate
    return np.round(np.interp(np.arange(n) * (rate / to), np.arange(len(pcm)), pcm)).astype(np.int16)


def padded(raw: bytes | memoryview) -> bytes:
    """raw with bytes 32 up to a positive multiple of UNIT."""
    n = len(raw)
    return bytes(raw).ljust(max(UNIT, -(-n // UNIT) * UNIT), b" ")


def wave(samples: bytes, codec: str = "mulaw") -> bytes:
    """A WAVE file around stored samples: `fmt `, `fact` (sample count) and `data`."""
    if codec == "adpcm":
        fmt = struct.pack("<HHIIHHHH", 17, 1, RATE, RATE * UNIT // BLOCK_SAMPLES, UNIT, 4, 2, BLOCK_SAMPLES)
        count = len(samples) // UNIT * BLOCK_SAMPLES
    else:
        fmt = struct.pack("<HHIIHHH", FORMATS[codec], 1, RATE, RATE, 1, 8, 0)
        count = len(samples)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, count) + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * (len(samples) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def pcm_wave(pcm: np.ndarray, rate: int = PCM_RATE) -> bytes:
    """A 16-bit PCM WAVE file."""
    data = pcm.astype("<i2").tobytes()
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(media: bytes) -> tuple[str, int, bytes]:
    """(codec, rate, stored samples) of a WAVE file; ValueError if it is none that this module knows."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, codec, rate = 12, None, 0
    names = {v: k for k, v in FORMATS.items()} | {1: "pcm"}
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
            codec = names.get(tag)
        elif name == b"data":
            if codec is None or at + 8 + size > len(media):
                raise ValueError("a WAVE file cut short or of another format")
            return codec, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("a WAVE file without data")


def _means(even: np.ndarray, odds: int) -> np.ndarray:
    """Means of neighbours, the last one its own: what doubling puts between samples."""
    wide = np.append(even, even[-1:]).astype(np.int32)
    return ((wide[:-1] + wide[1:]) >> 1)[:odds]


def fold(pcm: np.ndarray) -> np.ndarray:
    """PCM without loss as its samples at even places, then what those at odd places differ by (modulo 2 ** 16) from
    the mean of their neighbours: nothing where PCM was doubled, so that it packs well."""
    even, odd = pcm[::2], pcm[1::2]
    return np.concatenate([even, (odd - _means(even, len(odd))).astype(np.int16)])


def unfold(folded: np.ndarray) -> np.ndarray:
    """The PCM that fold() was given."""
    even, odd = np.split(folded, [len(folded) - len(folded) // 2])
    out = np.empty(len(folded), np.int16)
    out[::2] = even
    out[1::2] = (odd + _means(even, len(odd))).astype(np.int16)
    return out


def features(pcm: np.ndarray) -> str:
    """Length, peak, root mean square, sign changes and checksum of PCM."""
    if not len(pcm):
        return "n=0;peak=0;rms=0.000;zc=0;crc=00000000"
    x = pcm.astype(np.int64)
    neg = pcm < 0
    return f"n={len(pcm)};peak={int(np.abs(x).max())};rms={math.sqrt(int((x * x).sum()) / len(x)):.3f};zc={int((neg[1:] != neg[:-1]).sum())};crc={zlib.crc32(pcm.astype('<i2').tobytes()):08x}"


def store(docs: DataFrame, *, codec: str = "mulaw", rate: int = PCM_RATE, id_col: str = "doc_id", payload_col: str = "text") -> DataFrame:
    """(id, n_bytes, media binary, pcm binary): each payload (string or binary; null: empty), padded, as the samples
    of a WAVE file, and the 16-bit PCM that they expand to at `rate`, as another one.

    The table is written to the shared folder, and the frame returned reads it.  PCM at twice the telephone rate lies
    there folded, and is unfolded as it is read.  Repeated rows give repeated results, an empty table an empty one;
    further columns are not read.
    """
    stored = _store(docs, codec, rate, id_col, payload_col)
    if not _folded(rate):
        return stored

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pcm = [pcm_wave(unfold(np.frombuffer(read_wave(x)[2], "<i2")), rate) for x in b.column(3).to_pylist()]
            yield b.set_column(3, "pcm", pa.array(pcm, pa.binary()))

    return arrow_map(stored, run, f"{id_col} bigint, n_bytes bigint, media binary, pcm binary")


def _folded(rate: int) -> bool:
    return rate == 2 * RATE


def _store(docs: DataFrame, codec: str, rate: int, id_col: str, payload_col: str) -> DataFrame:
    """The table that store() writes, PCM as it lies there."""
    schema = f"{id_col} bigint, n_bytes bigint, media binary, pcm binary"
    kept = fold if _folded(rate) else np.asarray

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gather(batches, GATHER):
            raw = [x for chunk in t.column(1).chunks for x in raw_bytes(chunk)]
            samples = [padded(x) for x in raw]
            pcm = [pcm_wave(kept(resample(x, RATE, rate)), rate) for x in expand_many(samples, codec)]
            yield pa.RecordBatch.from_arrays([_flat(t.column(0)).cast(pa.int64()), pa.array([len(x) for x in raw], pa.int64()), pa.array([wave(x, codec) for x in samples], pa.binary()), pa.array(pcm, pa.binary())], [id_col, "n_bytes", "media", "pcm"])

    return stash(arrow_map(docs.select(id_col, payload_col), run, schema), "media", 6)[0]


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def measure(stored: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Digests of what store() stored, from the bytes read back: id, n_bytes, payload_bytes, payload_sha256, tail_crc32
    (of the last 16), media_bytes, media_sha256, feature.

    feature: features() of the payload as mu-law, as A-law and as ADPCM samples, whichever it is stored as, and of the
    stored PCM.  Equal payloads give equal values.
    """
    return _measure(stored, np.asarray, id_col)


def _measure(stored: DataFrame, plain: Callable[[np.ndarray], np.ndarray], id_col: str) -> DataFrame:
    """measure(); plain: makes PCM of the samples of the stored one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for t in gather(batches, 4 * GATHER):
            media, pcm = t.column(2).to_pylist(), t.column(3).to_pylist()
            back = [read_wave(m)[2] for m in media]
            told = [[f"{name}:{features(x)}" for x in expand_many(back, name)] for name in FORMATS]
            told.append([f"pcm:{features(plain(np.frombuffer(read_wave(x)[2], '<i2')))}" for x in pcm])
            ints = lambda x: pa.array(x, pa.int64())
            text = lambda x: pa.array(x, pa.string())
            yield pa.RecordBatch.from_arrays(
                [_flat(t.column(0)), _flat(t.column(1)), ints([len(x) for x in back]), text([sha(x) for x in back]), ints([zlib.crc32(x[-16:]) for x in back]), ints([len(x) for x in media]), text([sha(x) for x in media]), text([" ".join(x) for x in zip(*told)])],
                [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return arrow_map(
        stored.select(id_col, "n_bytes", "media", "pcm"),
        run,
        f"{id_col} bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    )


def digests(docs: DataFrame, *, codec: str = "mulaw", rate: int = PCM_RATE, id_col: str = "doc_id", payload_col: str = "text") -> DataFrame:
    """measure() of store(): store each payload, read the stored bytes back, and digest both.  Folded PCM is unfolded
    where it is measured: another map would need workers, and memory, of its own."""
    return _measure(_store(docs, codec, rate, id_col, payload_col), unfold if _folded(rate) else np.asarray, id_col)
