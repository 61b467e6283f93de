"""Stored media against decoders that work sample by sample."""

import hashlib
import math
import struct
import zlib

import numpy as np
import pytest

from lumenfield.llm import media, queries

ROWS = [(1, None), (2, ""), (3, "a" * 192), (4, "é" * 97), (5, "The quick brown fox\t\n" * 300), (5, "The quick brown fox\t\n" * 300), (None, "x"), (6, "\u0000\u0001" + "".join(map(chr, range(32, 1200)))), (7, "w " * 400_000)]


def mulaw(b):
    b = ~b & 255
    size = (((b & 15) * 2 + 33) << ((b >> 4) & 7)) - 33
    return 4 * (-size if b & 128 else size)


def alaw(b):
    b ^= 0x55
    e, m = (b >> 4) & 7, b & 15
    size = (m * 2 + 1) * 8 if e == 0 else (m * 2 + 33) * 8 << (e - 1)
    return size if b & 128 else -size


def steps():
    """The step sizes, fixed values of the format."""
    return media._STEPS


def adpcm(block):
    value, index = struct.unpack_from("<hB", block)
    index = min(index, 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = steps()[index]
            diff = step // 8
            for bit, part in ((4, step), (2, step // 2), (1, step // 4)):
                diff += part if code & bit else 0
            value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
            out.append(value)
    return out


def told(x):
    changes = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
    return f"n={len(x)};peak={max(map(abs, x))};rms={math.sqrt(sum(v * v for v in x) / len(x)):.3f};zc={changes};crc={zlib.crc32(struct.pack(f'<{len(x)}h', *x)):08x}"


def test_digests_equal_sample_by_sample_decoding(spark):
    df = spark.createDataFrame([(i, t, "x", b"y") for i, t in ROWS], "doc_id long, text string, media string, pcm binary")
    got = media.digests(df, rate=4000).collect()
    assert len(got) == len(ROWS) and sum(r.doc_id == 5 for r in got) == 2
    for i, t in ROWS:
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        (r,) = {x for x in got if x.doc_id == i}
        mu = [mulaw(b) for b in payload]
        half = [(a + b) >> 1 for a, b in zip(mu[::2], mu[1::2])]
        ad = [v for k in range(0, len(payload), 192) for v in adpcm(payload[k : k + 192])]
        want = f"mulaw:{told(mu)} alaw:{told([alaw(b) for b in payload])} adpcm:{told(ad)} pcm:{told(half)}"
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), want)
        head = b"RIFF" + struct.pack("<I", 50 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHHH", 18, 7, 1, 8000, 8000, 1, 8, 0) + b"fact" + struct.pack("<II", 4, len(payload)) + b"data" + struct.pack("<I", len(payload))
        assert (r.media_bytes, r.media_sha256) == (len(head + payload), hashlib.sha256(head + payload).hexdigest())


@pytest.mark.parametrize("codec", ["alaw", "adpcm"])
def test_other_stored_forms(spark, codec):
    df = spark.createDataFrame(ROWS[:6], "doc_id long, text string")
    stored = media.store(df, codec=codec, rate=8000).collect()
    for r, (_, t) in zip(sorted(stored, key=lambda r: (r.doc_id, r.n_bytes)), sorted(ROWS[:6], key=lambda r: r[0])):
        name, rate, back = media.read_wave(r.media)
        assert (name, rate, back) == (codec, 8000, media.padded((t or "").encode()))
        kind, rate, pcm = media.read_wave(r.pcm)
        assert (kind, rate) == ("pcm", 8000) and (np.frombuffer(pcm, "<i2") == media.expand(back, codec)).all()


def test_pieces_of_blocks(monkeypatch):
    data = np.random.default_rng(1).integers(0, 256, 192 * 37).astype(np.uint8).tobytes()
    want = media.adpcm_decode(data)
    monkeypatch.setattr(media, "BLOCKS", 5)
    assert (media.adpcm_decode(data) == want).all() and want.tolist()[: media.BLOCK_SAMPLES] == adpcm(data[:192])
    assert [x.tolist() for x in media.expand_many([data[:192], b"", data[192:576]], "adpcm")] == [want[:377].tolist(), [], want[377 : 3 * 377].tolist()]


def test_query_keeps_every_sample(spark, tmp_path):
    """PCM of the query: all samples that the payload expands to, and the means between, at 16 kHz."""
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op4_telephony_media(spark, str(tmp_path)).collect()
    assert len(got) == len(ROWS)
    for i, t in ROWS:
        mu = [mulaw(b) for b in media.padded((t or "").encode())]
        wide = [v for a, b in zip(mu, [*mu[1:], mu[-1]]) for v in (a, (a + b) >> 1)]
        (r,) = {x for x in got if x.doc_id == i}
        assert r.feature.endswith(f" pcm:{told(wide)}")


def test_stored_pcm_at_twice_the_rate(spark):
    df = spark.createDataFrame(ROWS[:6], "doc_id long, text string")
    for r in media.store(df, codec="mulaw").collect():
        (t,) = {t for i, t in ROWS[:6] if i == r.doc_id}
        kind, rate, pcm = media.read_wave(r.pcm)
        want = media.resample(media.expand(media.padded((t or "").encode()), "mulaw"))
        assert (kind, rate) == ("pcm", 16000) and pcm == want.astype("<i2").tobytes()


def test_folding_loses_nothing():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 4, 191, 1000):
        x = rng.integers(-32768, 32768, n).astype(np.int16)
        x[: n // 3] = np.resize(np.array([32767, -32768, -32768], np.int16), n // 3)
        assert (media.unfold(media.fold(x)) == x).all() and media.fold(x).dtype == np.int16
        doubled = media.resample(x)
        assert not media.fold(doubled)[n:].any() and (media.unfold(media.fold(doubled)) == doubled).all()
