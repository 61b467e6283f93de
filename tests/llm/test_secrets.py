"""Secret scans: base spans against a version by hand, layers to the fixpoint, windows, edge rows."""

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import urllib.parse
import zlib

import pytest

from lumenfield.llm import secret_scan

SECRET = "password: hunter2hunter2"
RAW = SECRET.encode()
NOISE = random.Random(5).randbytes(90).hex().upper()
VALUE = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


def run_of(text, at, letters):
    while at < len(text) and text[at] in letters:
        at += 1
    return at


def by_hand(text):
    """Base spans found by walking over the text."""
    out = []
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)

    def assign(i):
        for key in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if lower.startswith(key, i):
                at = i + len(key)
                at += at < len(text) and text[at] in "\"'"
                at = run_of(text, at, " ")
                if at >= len(text) or text[at] not in ":=":
                    return None
                at = run_of(text, at + 1, " ")
                at += at < len(text) and text[at] in "\"'"
                end = run_of(text, at, VALUE)
                return (end, end - at >= 8) if end > at else None
        return None

    def simple(start, letters, least):
        def match(i):
            if not text.startswith(start, i):
                return None
            end = run_of(text, i + len(start), letters)
            return (end, end - i >= least) if end > i + (len(start) > 0) * len(start) else None

        return match

    kinds = (assign, simple("AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 16), simple("", set("0123456789abcdef"), 32))
    for kind, match in enumerate(kinds):
        at = 0
        while at < len(text):
            found = match(at)
            if found is None:
                at += 1
                continue
            if found[1]:
                out.append((at, kind, found[0]))
            at = found[0]
    return sorted(out)


def test_base_spans_equal_those_found_by_hand(spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    rng = random.Random(2)
    bits = ["password", "PassWD", "token", "API_KEY", "apikey", "secret", '"', "'", " ", ":", "=", "\t", "AKIA", "ABCDEF0123456789", "0123456789abcdef", "x", "é", "+/._-", "\n", "Z9"]
    texts += ["".join(rng.choices(bits, k=rng.randint(1, 40))) for _ in range(3000)]
    assert sum(len(by_hand(t)) for t in texts) > 500
    for t in texts:
        assert secret_scan.base_spans(t) == by_hand(t), t


def deflate(raw):
    c = zlib.compressobj(9, zlib.DEFLATED, -15)
    return c.compress(raw) + c.flush()


def b64(raw):
    return base64.b64encode(raw).decode()


CASES = {
    "base64+gzip+gzip": b64(gzip.compress(gzip.compress(RAW * 3))),
    "base64+gzip+zlib": b64(gzip.compress(zlib.compress(RAW * 3))),
    "base64+gzip": b64(gzip.compress(b"a first member without any") + gzip.compress(RAW) + gzip.compress(b"third")),
    "base64+bz2": b64(bz2.compress(b"first") + bz2.compress(RAW)),
    "base64+xz": b64(lzma.compress(RAW)),
    "base64+deflate": b64(deflate(RAW * 4)),
    "base64": base64.encodebytes(b"x" * 50 + RAW + b" goes on after the line's end").decode(),
    "url+gzip": urllib.parse.quote_from_bytes(gzip.compress(RAW)),
    "hex": "a" + RAW.hex(),
    "unicode": "\\ud83d\\ude00" + "".join(f"\\u{ord(c):04x}" for c in SECRET),
    "unicode+base64": "".join(f"&#{ord(c)};" for c in b64(RAW)),
    "base64+gzip+base64+url": b64(gzip.compress(b64(urllib.parse.quote(SECRET, safe="").encode()).encode())),
}


@pytest.mark.parametrize("way", CASES)
@pytest.mark.parametrize("left, right", [("before ", " after"), ("é ", "\n")])
def test_layers_to_the_fixpoint(way, left, right):
    text = left + CASES[way] + right
    _, spans = secret_scan.scan(text)
    deep = [s for s in spans if s[1] == f"{way}>assign"]
    assert deep and all(len(left) <= s < e <= len(text) - len(right.strip(" \n")) for s, _, e in deep)
    masked = secret_scan.redact_text(text)
    assert masked.startswith(left) and masked.endswith(right) and not [s for s in secret_scan.scan(masked)[1] if s[1].endswith("assign")]


@pytest.mark.parametrize("glue", ["dir/", "/", "a", "ab", "abc", "path/to/"])
@pytest.mark.parametrize("raw", [RAW, gzip.compress(RAW), zlib.compress(gzip.compress(RAW))], ids=["plain", "gzip", "zlib"])
def test_runs_glued_to_letters(glue, raw):
    if raw[:1] == b"\x78" and len(glue) == 4 or len(glue) > 4:
        raw = gzip.compress(RAW)  # a zlib stream has no mark to find it by within other bytes
    text = f"see {glue}{b64(raw)} here"
    assert any(k.endswith("assign") for _, k, _ in secret_scan.scan(text)[1]) and secret_scan.redact_text(text).startswith(f"see {glue[:-1]}")


def test_wrapped_compressed_run():
    packed = base64.encodebytes(gzip.compress((NOISE + " " + SECRET + " " + NOISE).encode())).decode()
    assert packed.count("\n") > 2
    for text in (packed, packed.replace("\n", "\r\n   "), packed.replace("\n", "\\n")):
        assert "base64+gzip>assign" in {k for _, k, _ in secret_scan.scan("-----\n" + text + "-----")[1]}


def test_positions_survive_several_ways():
    inner = "é€ " + SECRET + " x"
    text = "%41 ü " + b64(inner.encode()) + " %42"
    spans = {(text[s:e], k) for s, k, e in secret_scan.scan(text)[1] if k.endswith("assign")}
    (found,) = {t for t, _ in spans}
    raw = base64.b64decode(b64(inner.encode()))
    a, b = raw.index(RAW) * 4 // 3, -(-(raw.index(RAW) + len(RAW)) * 4 // 3)
    assert found == b64(inner.encode())[a:b]


def test_long_streams_are_scanned_in_windows(monkeypatch):
    monkeypatch.setattr(secret_scan, "WINDOW", 4096)
    monkeypatch.setattr(secret_scan, "_PIECE", 1000)
    rng = random.Random(1)
    for k in range(30):
        filler = lambda: b"".join(rng.choice([b"\0", b"(words)", b"a", b" ", b"\xff"]) * rng.randint(1, 3000) for _ in range(rng.randint(0, 9)))
        nested = gzip.compress(rng.randbytes(rng.randint(0, 9000)) + b"!" + RAW) if k % 2 else RAW
        whole = filler() + b"!" + nested + b"!" + filler()
        kinds = {x for _, x, _ in secret_scan.scan(b64(gzip.compress(whole)))[1]}
        assert ("base64+gzip+gzip>assign" if k % 2 else "base64+gzip>assign") in kinds, k


def test_large_blobs_hide_nothing():
    packed = b64(gzip.compress(b"\0" * (70 << 20) + RAW))
    text = f"{packed} and {packed[:-4]} {b64(gzip.compress(gzip.compress(bytes(40 << 20)) + gzip.compress(RAW)))}"
    spans = secret_scan.scan(text)[1]
    assert len({s for s, k, _ in spans if k.endswith("gzip>assign")}) == 3


def test_odd_bytes_never_raise():
    rng = random.Random(3)
    for _ in range(400):
        raw = rng.randbytes(rng.randrange(90))
        head = rng.choice([b"", b"\x1f\x8b\x08", b"\x78\x9c", b"BZh91AY&SY", b"\xfd7zXZ\x00", gzip.compress(raw)[:-3]])
        text = rng.choice([b64(head + raw), (head + raw).hex(), urllib.parse.quote_from_bytes(head + raw), "\\u" + raw.hex(), "&#x" + raw.hex()[:8] + ";"])
        secret_scan.redact_text(text + " " + text)


def test_cycles_end():
    text = "%2525252541 " + b64(b64(b64(RAW).encode()).encode())
    assert "base64+base64+base64>assign" in {k for _, k, _ in secret_scan.scan(text)[1]}
    assert secret_scan.scan("")[1] == [] and secret_scan.scan("%" * 50 + "&#" * 50 + "\\u" * 50)[1] == []


def test_rows(spark):
    schema = "doc_id long, text string, spans string, n_chars long"
    rows = [(1, "%41" + "word " * 200_000 + SECRET, "x", 9), (2, None, None, None), (3, "", "", 0), (4, SECRET, "x", 1), (4, SECRET, "x", 1), (None, b64(RAW), None, 1)]
    df = spark.createDataFrame(rows, schema)
    got = sorted(((r.doc_id, r.n_assign, r.base_sha256, len(r.spans)) for r in secret_scan.find(df).collect()), key=str)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    at = 3 + 5 * 200_000
    want = [(1, 1, digest(f"assign:{at}:{at + 24}"), 1), (2, 0, digest(""), 0), (3, 0, digest(""), 0), (4, 1, digest("assign:0:24"), 1), (4, 1, digest("assign:0:24"), 1), (None, 0, digest(""), 1)]
    assert got == sorted(want, key=str)
    masked = secret_scan.redact(df)
    assert masked.columns == df.columns and sorted((r.doc_id, r.text) for r in masked.where("doc_id = 4").collect()) == [(4, "[SECRET]")] * 2
    assert secret_scan.redact(df.limit(0)).count() == 0 and masked.where("doc_id is null").first().text == "[SECRET]"
