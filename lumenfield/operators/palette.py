"""Palettes for vector quantisation: each run of an order learns its own entries, labels count on from run to run."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a segment at least, segments at most, entries of a segment at least.
SEGMENT_ROWS, SEGMENTS, ENTRIES = 1024, 64, 16
#: Rows that a segment's entries are fitted on, about: a uniform sample by a hash of the ordinal.  All rows get labels.
FIT_ROWS = 65_536


def size_for(n: int, level: int = 0) -> int:
    """Entries wanted for n rows: the largest power of two that is not above n, from 256 to 65,536, or to a quarter or a
    sixteenth of that at compression levels from 4 and from 7 on."""
    most = 65_536 >> (0 if level <= 3 else 2 if level <= 6 else 4)
    return max(256, min(most, 1 << max(0, n.bit_length() - 1)))


def segment_rows(n: int) -> int:
    count = max(1, min(SEGMENTS, n // SEGMENT_ROWS))
    return max(1, -(-n // count))


def segment(n: int, ordinal: str = "_ord") -> Column:
    return F.floor(F.col(ordinal) / segment_rows(n)).cast("long")


def nearest(v: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """For each row the nearest entry, the first of equally near ones."""
    out = np.empty(len(v), np.int64)
    own = (entries * entries).sum(1)
    for a in range(0, len(v), 1024):
        part = v[a : a + 1024]
        d = own - 2 * part @ entries.T
        close = d <= d.min(1, keepdims=True) + 1e-9 * (1 + own.max() + (part * part).sum(1, keepdims=True))
        for i, row in enumerate(close):  # near ties are told apart by the differences themselves
            at = np.flatnonzero(row)
            out[a + i] = at[0] if len(at) == 1 else at[((entries[at] - part[i]) ** 2).sum(1).argmin()]
    return out


def fit(v: np.ndarray, k: int, seed: int = 42, iterations: int = 10) -> np.ndarray:
    """k entries for rows v by Lloyd's algorithm from a seeded choice; where no more than k rows differ, those."""
    different, count = np.unique(v, axis=0, return_counts=True)
    if len(different) <= k:
        return different
    centres = different[np.sort(np.random.default_rng(seed).choice(len(different), k, replace=False))]
    for _ in range(iterations):
        label = nearest(different, centres)
        weight = np.bincount(label, count, k)
        total = np.stack([np.bincount(label, count * different[:, j], k) for j in range(v.shape[1])], 1)
        new = np.where(weight[:, None] > 0, total / np.maximum(weight, 1)[:, None], centres)
        if np.array_equal(new, centres):
            break
        centres = new
    return centres


def learn(df: DataFrame, columns: list[str], n: int, size: int, *, seed: int = 42, fit_rows: int = FIT_ROWS, ordinal: str = "_ord") -> list[np.ndarray]:
    """The entries of each segment of df, which has n rows and a dense ordinal: size / segments of them, at least ENTRIES.

    At most about 65,536 entries come to the driver, whatever n is.
    """
    per = segment_rows(n)
    k = max(ENTRIES, -(-size // max(1, -(-n // per))))
    rows = df.select(segment(n, ordinal).alias("segment"), F.col(ordinal).alias("at"), F.array(*(F.col(c).cast("double") for c in columns)).alias("v"))
    if per > fit_rows:
        rows = rows.where(F.pmod(F.xxhash64("at", F.lit(seed)), F.lit(1 << 30)) < int(fit_rows / per * (1 << 30)))

    def entries(t: pa.Table) -> pa.Table:
        t = t.sort_by("at").combine_chunks()
        v = np.nan_to_num(np.array(t.column("v").to_pylist(), np.float64)) + 0.0
        found = fit(v, k, seed)
        return pa.table({"segment": pa.array([t.column("segment")[0].as_py()] * len(found), pa.int64()), "nth": pa.array(range(len(found)), pa.int64()), "v": pa.array(found.tolist(), pa.list_(pa.float64()))})

    got = rows.groupBy("segment").applyInArrow(entries, "segment bigint, nth bigint, v array<double>").collect()
    out: dict[int, list] = {}
    for r in sorted(got, key=lambda r: (r["segment"], r["nth"])):
        out.setdefault(r["segment"], []).append(r["v"])
    count = -(-n // per) if n else 0
    # a segment of which the sample took no row borrows the entries before it
    found, last = [], np.zeros((1, len(columns)))
    for s in range(count):
        last = np.array(out[s]) if s in out else last
        found.append(last)
    return found


def assign(df: DataFrame, columns: list[str], n: int, palette: list[np.ndarray], *, name: str = "label", ordinal: str = "_ord") -> DataFrame:
    """df with the label of each row: its nearest entry among those of its segment, counted over all segments."""
    spark = df.sparkSession
    offsets = np.cumsum([0, *map(len, palette)])
    shared = spark.sparkContext.broadcast((palette, offsets))  # 65,536 entries of 45 values at most, about
    per = segment_rows(n)
    at = [df.columns.index(c) for c in columns]
    own = df.columns.index(ordinal)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, start = shared.value
        for b in batches:
            v = np.nan_to_num(np.stack([b.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in at], 1))
            which = b.column(own).to_numpy() // per
            label = np.empty(b.num_rows, np.int64)
            for s in np.unique(which):
                pick = which == s
                label[pick] = start[s] + nearest(v[pick], entries[s])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(label)], [*b.schema.names, name])

    fields = "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in df.schema.fields) + f",`{name}`:bigint>"
    return df.mapInArrow(run, fields)
