"""BPE encoding and decoding of whole texts as DataFrame operators."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Codec
from .common import arrow_map, spread, texts_of
from .tokens import gather, groups


def encode(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, exact): the token ids of each whole text, and whether decoding them gives it back.

    A null or empty text has no ids and is exact; texts may have any length; repeated rows give repeated results, an
    empty table an empty one; further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(vocabulary)
        for table in gather(batches, 1 << 20):
            texts = texts_of(table.column(1))
            for a, b in groups(texts):
                ids = codec.encode(texts[a:b])
                exact = [codec.decode(x) == t for x, t in zip(ids, texts[a:b])]
                yield pa.RecordBatch.from_arrays([table.column(0).combine_chunks().slice(a, b - a).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(exact, pa.bool_())], [id_col, "ids", "exact"])

    return arrow_map(spread(docs.select(id_col, text_col)), run, f"{id_col} bigint, ids array<int>, exact boolean")


def decode(tokens: DataFrame, vocabulary: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text of each list of ids, special tokens included; a null list is an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([codec.decode(x or []) for x in b.column(1).to_pylist()])], [id_col, "text"])

    return arrow_map(tokens.select(id_col, ids_col), run, f"{id_col} bigint, text string")


def digests(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode each whole text, decode its ids, digest both.

    A null text counts as empty (no ids; both digests those of the empty string).  Repeated rows give
    repeated results; further columns of docs are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(vocabulary)
        sha, name, back = hashlib.sha256, codec.v.id_text.__getitem__, codec.v.bytes_of.__getitem__
        for table in gather(batches):
            texts = texts_of(table.column(1))
            n, left, right = [], [], []
            for a, b in groups(texts):
                for ids in codec.encode(texts[a:b]):
                    n.append(len(ids))
                    left.append(sha(",".join(map(name, ids)).encode()).hexdigest())
                    raw = b"".join(map(back, ids))
                    right.append(sha(raw.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([table.column(0).combine_chunks().cast(pa.int64()), pa.array(n, pa.int64()), pa.array(left, pa.string()), pa.array(right, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(spread(docs.select(id_col, text_col)), run, f"{id_col} bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
