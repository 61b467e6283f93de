"""Token counts: exact counts at every prefix of a text by prefix dynamic programming."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Codec
from .common import arrow_map, spread, texts_of

#: Bytes of text whose words are looked up together.
CHUNK_BYTES = 4 << 20


def groups(texts: list[str], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about `most` characters."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def gather(batches: Iterator[pa.RecordBatch], most: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Small batches put together up to about `most` bytes, so that vectorised steps see enough rows."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, *, id_col: str = "doc_id", text_col: str = "text", prefixes: bool = False) -> DataFrame:
    """Count the tokens of each whole text and answer budget questions from the stored prefix counts.

    Returns id, n_bytes, n_tokens, over_limit, cut_chars (code points of the longest run of whole pre-tokens
    from the start within `limit` tokens) and, with prefixes=True, prefix_tokens: the exact token count of
    every code-point prefix, the empty one first.  A null text counts as empty: 0 tokens.  Repeated rows give
    repeated results; further columns of docs are not read; an empty table gives an empty one.
    """
    fields = f"{id_col} bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, cut_chars bigint" + (", prefix_tokens array<int>" if prefixes else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(vocabulary)
        for table in gather(batches):
            texts = texts_of(table.column(1))
            cuts, counts, dense = [], [], []
            for a, b in groups(texts):
                for t in codec.tables(texts[a:b]):
                    counts.append(t.n_tokens)
                    cuts.append(t.cut_at(limit))
                    if prefixes:
                        dense.append(t.dense())
            sizes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
            columns = [table.column(0).combine_chunks().cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_()), pa.array(cuts, pa.int64())]
            names = [id_col, "n_bytes", "n_tokens", "over_limit", "cut_chars"]
            if prefixes:
                columns.append(pa.array(dense, pa.list_(pa.int32())))
                names.append("prefix_tokens")
            yield pa.RecordBatch.from_arrays(columns, names)

    return arrow_map(spread(docs.select(id_col, text_col)), run, fields)
