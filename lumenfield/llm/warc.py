"""Web archives: write WARC files, turn a monolithic gzip stream into one member for each record, read back.

An archive is first one gzip stream over all of its records.  The normaliser inflates that stream once in
pieces, cuts it at record ends, writes every record as a gzip member of its own and notes where each member
lies; members and notes go to an archive file and a sidecar index beside it, in the shared folder.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, shared_dir, stash

LEVEL = 1
_PIECE = 1 << 18
#: Uncompressed bytes after which a task starts another archive.
ARCHIVE_BYTES = 64 << 20
_DATE = "2024-01-01T00:00:00Z"


def sha1_32(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record(kind: str, record_id: str, uri: str, payload: bytes, digest: str, refers_to: str | None = None) -> bytes:
    """One WARC/1.1 record; a revisit names the record it refers to and has no payload."""
    uri = "".join(c for c in uri if c.isprintable() and c != " ") or "urn:none"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http + (payload if kind == "response" else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    body = rest[: int(fields["content-length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


class _Splitter:
    """Cuts a stream of concatenated records into records."""

    def __init__(self) -> None:
        self.held = bytearray()

    def feed(self, piece: bytes) -> Iterator[bytes]:
        self.held += piece
        at = 0
        while True:
            end = self.held.find(b"\r\n\r\n", at)
            if end < 0:
                break
            length = None
            for line in bytes(self.held[at:end]).split(b"\r\n"):
                if line[:15].lower() == b"content-length:":
                    length = int(line[15:])
            if length is None:
                raise ValueError("a record without its length")
            stop = end + 4 + length + 4
            if len(self.held) < stop:
                break
            yield bytes(self.held[at:stop])
            at = stop
        del self.held[:at]


def inflate(stream: Iterable[bytes]) -> Iterator[bytes]:
    """The content of a gzip stream of one or more members, in bounded pieces; ValueError if cut short."""
    one = zlib.decompressobj(31)
    started = False
    for piece in stream:
        while piece:
            started = True
            out = one.decompress(piece, _PIECE)
            if out:
                yield out
            if one.eof:
                piece, one, started = one.unused_data, zlib.decompressobj(31), False
            else:
                piece = one.unconsumed_tail
    while started and not one.eof:
        out = one.decompress(b"", _PIECE)
        if not out:
            raise ValueError("a gzip stream cut short")
        yield out


def normalise(stream: Iterable[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(record, its own gzip member) of each record of a monolithic gzip stream, which is inflated once."""
    cutter = _Splitter()
    for piece in inflate(stream):
        for raw in cutter.feed(piece):
            packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            yield raw, packer.compress(raw) + packer.flush()
    if cutter.held.strip(b"\r\n"):
        raise ValueError("the stream ends within a record")


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write_archives(folder: str):
    """Rows (page_id, url, html, digest, refers) to archives; a row for each record: archive, offset, length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        pieces: list[bytes] = []
        packer, size = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0

        def close() -> pa.RecordBatch:
            nonlocal packer, size
            pieces.append(packer.flush())
            name = f"{base.rstrip('/')}/{uuid.uuid4().hex}.warc.gz"
            where, at = [], 0
            with fs.open_output_stream(name, compression=None) as out:
                for raw, member in normalise(pieces):
                    out.write(member)
                    where.append((at, len(member)))
                    at += len(member)
            with fs.open_output_stream(name + ".idx", compression=None) as side:
                side.write("".join(json.dumps({"offset": a, "length": n}) + "\n" for a, n in where).encode())
            pieces.clear()
            packer, size = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(where)], pa.int64())], ["archive", "records"])

        for b in batches:
            for page, url, html, digest, refers in zip(*(c.to_pylist() for c in b.columns)):
                raw = record("response" if refers is None else "revisit", f"urn:page:{page}", url or "", (html or "").encode(), digest, None if refers is None else f"urn:page:{refers}")
                pieces.append(packer.compress(raw))
                size += len(raw)
                if size >= ARCHIVE_BYTES:
                    yield close()
        if size:
            yield close()

    return run


def _read_archives(folder: str):
    """Archives to a row for each record, each fetched by its place in the sidecar index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(folder)
        names = ["page_id", "payload_bytes", "payload_digest", "own_digest", "record_type", "refers_to"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
        number = lambda x: None if x is None or x.endswith(":None>") else int(x.strip("<>").rpartition(":")[2])
        for b in batches:
            for name in b.column(0).to_pylist():
                with fs.open_input_stream(name + ".idx", compression=None) as side:
                    index = [json.loads(x) for x in side.read().splitlines()]
                rows = []
                with fs.open_input_file(name) as file:
                    for x in index:
                        file.seek(x["offset"])
                        fields, payload = parse(zlib.decompress(file.read(x["length"]), 31))
                        kind = fields["warc-type"]
                        rows.append((number(fields["warc-record-id"]), len(payload) if kind == "response" else None, fields["warc-payload-digest"].removeprefix("sha1:"), sha1_32(payload) if kind == "response" else None, kind, number(fields.get("warc-refers-to"))))
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return run


def archive(pages: DataFrame, *, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write every row as a WARC record and return (archive, records), the files written.

    Of rows with equal payloads of at least `least_bytes` bytes the one with the smallest id is the response and the
    others are revisits of it; all other rows are responses.  Of rows with that id the one with the smallest url (null
    first) is it, and of wholly equal rows one.  A row with a null id never is while another one has an id; where none
    has, all are responses.  A null payload is empty, a null url is written as urn:none; an empty table gives
    no files; further columns are not read.  Files whose task is run again are written anew under other names, so
    only those named in the result count.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(payload_col).alias("html"))
    text = F.coalesce(F.col("html"), F.lit(""))
    plain = plain.withColumn("hex", F.sha1(text.cast("binary")))
    # who is the response of each payload that repeats: only digests, ids and urls move
    each = plain.where(F.octet_length(text) >= least_bytes).groupBy("hex", "page_id", "url").agg(F.count(F.lit(1)).alias("k"))
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url", "k"))
    first = each.groupBy("hex").agg(F.min(named).alias("f"), F.sum("k").alias("n")).where("n > 1 and f is not null")
    own = F.col("page_id").eqNullSafe(F.col("f.page_id")) & F.col("url").eqNullSafe(F.col("f.url"))
    roles, _ = stash(each.join(first, "hex").select(F.col("hex").alias("h"), F.col("page_id").alias("i"), F.col("url").alias("u"), "k", F.col("f.page_id").alias("first"), own.alias("own")), "roles")
    # payloads meet their roles by digest, id and url, so copies of one payload spread over tasks
    met = plain.join(roles, (F.col("hex") == F.col("h")) & F.col("page_id").eqNullSafe(F.col("i")) & F.col("url").eqNullSafe(F.col("u")), "left")
    row = lambda df, stays: df.select("page_id", "url", F.when(stays, F.col("html")).alias("html"), F.col("hex").alias("digest"), F.when(~stays, F.col("first")).alias("refers"))
    twins = roles.where("own and k > 1")
    if twins.isEmpty():
        rows = row(met, F.col("first").isNull() | F.col("own"))
    else:
        single = F.col("first").isNull() | (F.col("own") & (F.col("k") == 1))
        rows = row(met.where(single | ~F.col("own")), single)
        rows = rows.unionByName(row(met.where("own and k > 1").dropDuplicates(["hex"]), F.lit(True)))
        more = twins.withColumn("nth", F.explode(F.sequence(F.lit(2).cast("long"), "k")))
        rows = rows.unionByName(more.select(F.col("i").alias("page_id"), F.col("u").alias("url"), F.lit(None).cast("string").alias("html"), F.col("h").alias("digest"), F.col("first").alias("refers")))
    return cut(arrow_map(rows, _hex_to_32(_write_archives(folder)), "archive string, records bigint"))


def _hex_to_32(then):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def turned() -> Iterator[pa.RecordBatch]:
            for b in batches:
                digest = pa.array([base64.b32encode(bytes.fromhex(x)).decode() for x in b.column(3).to_pylist()])
                yield pa.RecordBatch.from_arrays([*b.columns[:3], digest, b.column(4)], b.schema.names)

        yield from then(turned())

    return run


def read(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record of archive().

    What a response's payload measures comes from the payload read back; a revisit's from the response that
    it refers to.  ValueError if a payload does not have the digest its record states.
    """
    spark = archives.sparkSession
    folder = shared_dir(spark)
    n = max(1, archives.count())
    got = cut(arrow_map(archives.select("archive").repartition(min(n, 4096)), _read_archives(folder), "page_id bigint, payload_bytes bigint, payload_digest string, own_digest string, record_type string, refers_to bigint"))
    same = F.when((F.col("record_type") == "revisit") | (F.col("own_digest") == F.col("payload_digest")), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("payload of another digest: "), F.col("page_id").cast("string"))))
    got = got.withColumn("payload_digest", same)
    revisits = got.where("record_type = 'revisit'")
    wanted = revisits.select(F.col("refers_to").alias("page_id"), "payload_digest").distinct()
    sizes = got.where("record_type = 'response'").join(wanted, ["page_id", "payload_digest"]).groupBy("page_id", "payload_digest").agg(F.max("payload_bytes").alias("size"))
    sizes = cut(sizes.select(F.col("page_id").alias("r"), F.col("payload_digest").alias("d"), "size"))
    back = revisits.join(sizes, (revisits.refers_to == sizes.r) & (revisits.payload_digest == sizes.d), "left").select("page_id", F.col("size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return got.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").unionByName(back)
