"""Secret scans: find credentials in a text and in what its encoded parts unfold to.

A worklist holds layers, the text itself first.  Each layer is scanned; encoded runs in it (URL escapes, Unicode
escapes, base64, also broken over lines or glued to other letters, hex, and compressed bytes wherever they lie
in decoded ones, one within another too) are decoded into new layers until nothing new appears.  A layer whose content
was seen at that place is not entered again, which ends cycles.  A layer knows its place in the layer above by
runs, not by code points, so spans found are mapped back to the whole text at no cost in memory.

Nothing is cut off.  Compressed bytes are inflated in pieces; beyond WINDOW bytes they are scanned in windows
that end at bytes which no secret and no encoded run holds, so memory follows the longest run, not the layer.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, texts_of, vacate
from .tokens import gather

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile("AKIA[A-Z0-9]{12,}")
_HEX = re.compile("[0-9a-f]{32,}")
_KEYS = ("passw", "secret", "token", "api_key", "apikey")

_URL = re.compile("(?:%[0-9A-Fa-f]{2})+")
_URL_GZIP = re.compile("[^\\s\"'<>]*%1[Ff]%8[Bb]%08[^\\s\"'<>]*")
_PAIR = r"\\u([dD][89abAB][0-9A-Fa-f]{2})\\u([dD][c-fC-F][0-9A-Fa-f]{2})"
_ESCAPE = re.compile(_PAIR + r"|\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
#: A run, and further lines of it after line breaks, plain or escaped.
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:(?:\r?\n|(?:\\r)?\\n)[ \t]*[A-Za-z0-9+/_-]+)*")
_LINE = re.compile(r"(?:\r?\n|(?:\\r)?\\n)[ \t]*")
_HEXRUN = re.compile("[0-9A-Fa-f]{32,}")
_MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00")
#: Runs of eight code points or more of readable UTF-8 in bytes.
_READABLE = re.compile(rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}){8,}")
#: Where such a run may lie, found faster.
_MAYBE = re.compile(rb"[\t\n\r\x20-\x7e\x80-\xf4]{8,}")
#: Bytes that may stand in a secret or in an encoded run.
_RUN = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_.=:-\"'%\\&#;{} \t\r\n"
#: Inflated bytes up to which a layer is scanned at once.
WINDOW = 32 << 20
_PIECE, _FEED = 1 << 20, 1 << 16


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base patterns, in order."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


class Layer:
    """Text or bytes, the way to it ("url+base64"), the layer above and the place of a span there."""

    __slots__ = ("content", "way", "above", "where")

    def __init__(self, content: str | bytes, way: str = "", above: Layer | None = None, where: Callable[[int, int], tuple[int, int]] | None = None):
        self.content, self.way, self.above, self.where = content, way, above, where

    def below(self, content: str | bytes, name: str, where: Callable[[int, int], tuple[int, int]]) -> Layer:
        return Layer(content, (f"{self.way}+{name}" if self.way else name) if name else self.way, self, where)

    def place(self, a: int, b: int) -> tuple[int, int]:
        """Span in the whole text of a..b of this layer."""
        at = self
        while at.above is not None:
            a, b = at.where(a, b)
            at = at.above
        return a, b


def _fixed(a: int, b: int) -> Callable[[int, int], tuple[int, int]]:
    return lambda *_: (a, b)


# ---- layers below a text -----------------------------------------------------------------------------------
def _replaced(layer: Layer, pattern: re.Pattern, name: str, put: Callable[[re.Match], str | None]) -> Layer | None:
    """The layer with every match of pattern replaced by put(match); its place is kept in runs."""
    text = layer.content
    parts: list[str] = []
    new_at, old_at, old_end = [], [], []  # runs: copied ones end where the next begins, replaced ones are one span
    done = at = 0
    for m in pattern.finditer(text):
        new = put(m)
        if new is None:
            continue
        for piece, a, b in ((text[done : m.start()], done, -1), (new, m.start(), m.end())):
            if piece:
                parts.append(piece)
                new_at.append(at)
                old_at.append(a)
                old_end.append(b)
                at += len(piece)
        done = m.end()
    if not done:
        return None
    parts.append(text[done:])
    new_at.append(at)
    old_at.append(done)
    old_end.append(-1)

    def where(a: int, b: int) -> tuple[int, int]:
        i, j = bisect_right(new_at, a) - 1, bisect_right(new_at, b - 1) - 1
        start = old_at[i] + (a - new_at[i] if old_end[i] < 0 else 0)
        return start, old_end[j] if old_end[j] >= 0 else old_at[j] + b - new_at[j]

    return layer.below("".join(parts), name, where)


def _url(m: re.Match) -> str:
    raw = bytes.fromhex(m[0].replace("%", ""))
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _escape(m: re.Match) -> str | None:
    if m[1]:
        return chr(0x10000 + ((int(m[1], 16) & 0x3FF) << 10 | int(m[2], 16) & 0x3FF))
    code = int(m[8]) if m[8] else int(next(x for x in m.groups()[2:7] if x), 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def _unpacked(layer: Layer) -> Iterator[Layer]:
    """Bytes of the base64 and hex runs of a text, at each way that their letters may be grouped."""
    text = layer.content
    for m in _BASE64.finditer(text):
        cuts, starts, joined, at = [0], [], [], m.start()  # lines: where each begins, joined and in the text
        for gap in _LINE.finditer(text, m.start(), m.end()):
            joined.append(text[at : gap.start()])
            starts.append(at)
            cuts.append(cuts[-1] + len(joined[-1]))
            at = gap.end()
        joined.append(text[at : m.end()])
        starts.append(at)
        run = "".join(joined).translate({45: 43, 95: 47})
        inside = lambda i, cuts=cuts, starts=starts: starts[k := bisect_right(cuts, i) - 1] + i - cuts[k]
        for off in range(4):
            n = len(run) - off
            n -= n % 4 == 1
            raw = base64.b64decode(run[off : off + n] + "=" * (-n % 4))
            # byte i lies in letters 4 i / 3 to 4 (i + 1) / 3
            yield layer.below(raw, "base64", lambda a, b, off=off, n=n, inside=inside: (inside(off + a * 4 // 3), inside(off + min(n, -(-b * 4 // 3)) - 1) + 1))
    for m in _HEXRUN.finditer(text):
        for off in (0, 1):
            n = (m.end() - m.start() - off) // 2 * 2
            s = m.start() + off
            yield layer.below(bytes.fromhex(text[s : s + n]), "hex", lambda a, b, s=s: (s + 2 * a, s + 2 * b))


def _from_text(layer: Layer) -> Iterator[Layer]:
    text = layer.content
    if "%" in text:
        if (new := _replaced(layer, _URL, "url", _url)) is not None:
            yield new
            for m in _URL_GZIP.finditer(text):
                raw = bytes.fromhex("".join(x[1:] if len(x) == 3 else x.encode().hex() for x in re.findall("%[0-9A-Fa-f]{2}|.", m[0], re.S)))
                yield layer.below(raw, "url", _fixed(m.start(), m.end()))
    if ("\\" in text or "&#" in text) and (new := _replaced(layer, _ESCAPE, "unicode", _escape)) is not None:
        yield new
    yield from _unpacked(layer)


# ---- layers below bytes ------------------------------------------------------------------------------------
_MAKE = {"gzip": lambda: zlib.decompressobj(31), "zlib": zlib.decompressobj, "deflate": lambda: zlib.decompressobj(-15), "bz2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor}


class _Inflater:
    """Pieces of what compressed bytes from `at` on unfold to, all members; `end` is where the last whole member,
    or what could be read of a damaged one, ended."""

    def __init__(self, raw: bytes, at: int, kind: str):
        self.raw, self.end, self.kind, self.whole = raw, at, kind, False

    def __iter__(self) -> Iterator[bytes]:
        raw, fed, one = memoryview(self.raw), self.end, _MAKE[self.kind]()
        while fed < len(raw):
            piece = bytes(raw[fed : fed + _FEED])
            fed += len(piece)
            while True:
                try:
                    out = one.decompress(piece, _PIECE)
                except (zlib.error, OSError, lzma.LZMAError, EOFError):
                    return
                if out:
                    self.whole = False
                    yield out
                if one.eof:
                    piece = one.unused_data
                    self.end, self.whole, one = fed - len(piece), True, _MAKE[self.kind]()
                    if self.kind in ("zlib", "deflate"):
                        return
                    if not piece:
                        break
                    continue
                piece = getattr(one, "unconsumed_tail", b"")
                if piece or len(out) == _PIECE or not getattr(one, "needs_input", True):
                    continue
                break
        if not self.whole:
            self.end = len(raw)


def _windows(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """A stream put together up to WINDOW bytes; a longer one is cut where nothing that is looked for goes on."""
    held, want = bytearray(), WINDOW
    for p in pieces:
        held += p
        if len(held) <= want:
            continue
        cut = len(held.rstrip(_RUN))
        if cut and all(_closed(held, m, cut) for m in _MAGIC.finditer(held, 0, cut)):
            yield bytes(held[:cut])
            del held[:cut]
            want = WINDOW
        else:
            want = 2 * len(held)
    if held:
        yield bytes(held)


def _kind(magic: bytes) -> str:
    return "gzip" if magic[:1] == b"\x1f" else "bz2" if magic[:1] == b"B" else "xz"


def _closed(held: bytearray, m: re.Match, cut: int) -> bool:
    """Whether compressed bytes that begin at m end before `cut` or are none."""
    stream = _Inflater(bytes(held[:cut]), m.start(), _kind(m[0]))
    for _ in stream:
        pass
    return stream.end < cut


def _from_bytes(layer: Layer) -> Iterator[Layer]:
    """What compressed bytes within bytes unfold to, and the readable text between them."""
    raw, at, found = layer.content, 0, False
    starts = [(m.start(), _kind(m[0])) for m in _MAGIC.finditer(raw)]
    if len(raw) > 6 and raw[0] & 15 == 8 and (raw[0] << 8 | raw[1]) % 31 == 0:
        starts.insert(0, (0, "zlib"))
    gaps = []
    for start, kind in starts:
        if start < at:
            continue
        stream, some = _Inflater(raw, start, kind), False
        for window in _windows(iter(stream)):
            some = found = True
            yield layer.below(window, kind, lambda *_, s=start, stream=stream: (s, max(s + 1, stream.end)))
        if some:
            gaps.append((at, start))
            at = stream.end
    gaps.append((at, len(raw)))
    for a, b in gaps:
        for m in (m for w in _MAYBE.finditer(raw, a, b) for m in _READABLE.finditer(raw, w.start(), w.end())):
            found = True
            text, s = m[0].decode("utf-8"), m.start()
            byte = (lambda i, s=s: s + i) if text.isascii() else (lambda i, s=s, text=text: s + len(text[:i].encode()))
            yield layer.below(text, "", lambda a, b, byte=byte: (byte(a), byte(b)))
    if not found and len(raw) > 8 and raw[0] & 6 != 6:  # no head tells raw deflate: it has to end with the bytes
        trial, size = _Inflater(raw, 0, "deflate"), 0
        for piece in trial:
            size += len(piece)
        if trial.whole and size >= 8 and len(raw) - trial.end <= 2:
            for window in _windows(iter(_Inflater(raw, 0, "deflate"))):
                yield layer.below(window, "deflate", _fixed(0, len(raw)))


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, str, int]]]:
    """Base spans, and all spans as (start, kind, end) with kinds of deeper layers as "way>kind"."""
    base = base_spans(text)
    deep: set[tuple[int, str, int]] = set()
    seen: set[bytes] = set()
    work = [Layer(text)]
    while work:
        layer = work.pop()
        below = _from_text(layer) if isinstance(layer.content, str) else _from_bytes(layer)
        for new in below:
            content = new.content
            if len(content) < 8:
                continue
            told = isinstance(content, str)
            mark = hashlib.blake2b(content.encode("utf-8", "surrogatepass") if told else content, digest_size=16, key=b"%d-%d" % (told, new.place(0, 1)[0])).digest()
            if mark in seen:
                continue
            seen.add(mark)
            work.append(new)
            if told:
                for start, kind, end in base_spans(content):
                    s, e = new.place(start, end)
                    deep.add((s, f"{new.way}>{KINDS[kind]}", e))
    spans = [(s, KINDS[k], e) for s, k, e in base]
    known = {(s, k, e) for s, k, e in spans}
    # an escape elsewhere in the text leaves a plain secret where it was: not a second finding
    spans += [x for x in deep if (x[0], x[1].rpartition(">")[2], x[2]) not in known]
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(spans, key=lambda x: (x[0], order.get(x[1], len(KINDS)), x[1], x[2]))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<start, kind, end>>, n_assign, n_access, n_hex, base_sha256) of each whole text.

    Positions are code points, end exclusive.  A null text counts as empty and has no spans.  A text of any length,
    and whatever its compressed parts unfold to, is scanned whole.  Repeated rows give repeated results, an empty
    table an empty one; further columns are not read.
    """
    fields = f"{id_col} bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans array<struct<start:bigint,kind:string,end:bigint>>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        for table in gather(batches):
            counts, digests, spans = ([], [], []), [], []
            for text in texts_of(table.column(1)):
                base, every = scan(text)
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest())
                spans.append([{"start": s, "kind": k, "end": e} for s, k, e in every])
            yield pa.RecordBatch.from_arrays([table.column(0).combine_chunks().cast(pa.int64()), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, kind)], [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return arrow_map(docs.select(id_col, text_col), run, fields)


def redact_text(text: str | None, mask: str = "[SECRET]") -> str | None:
    """The text with every found span, plain or encoded, replaced by mask; overlapping spans count as one."""
    if not text:
        return text
    _, spans = scan(text)
    if not spans:
        return text
    out, at = [], 0
    for s, _, e in sorted(spans):
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, *, text_col: str = "text", chars_col: str | None = "n_chars", mask: str = "[SECRET]") -> DataFrame:
    """docs with every secret in the whole text replaced by mask, and chars_col (if docs has it) counted anew.

    All other columns, whatever their names, and the number of rows stay as they are, repeated rows too; a null text
    stays null and its count too; texts of any length are scanned whole; an empty table gives an empty one.
    """
    schema = docs.schema
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        for b in batches:
            new = [redact_text(x, mask) for x in b.column(at).to_pylist()]
            columns = list(b.columns)
            columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    fields = "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in schema.fields) + ">"
    out = arrow_map(docs, run, fields)
    if chars_col and chars_col in docs.columns:
        kind = schema[chars_col].dataType
        out = out.withColumn(chars_col, F.when(F.col(text_col).isNull(), F.col(chars_col)).otherwise(F.char_length(text_col).cast(kind)))
    return out
