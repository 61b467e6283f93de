"""Shared pieces of the training-data operators: Arrow maps and shared scratch space."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators.components import components
from ..scratch import delete as drop
from ..scratch import shared_dir as named_dir

#: Session setting: shuffle files go when the query that wrote them ends.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows and bytes, about, in one Arrow batch handed to a Python worker: a bound on its memory (one row may be larger).
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
#: Estimated bytes for each core up to which spread() deals rows anew.
SMALL_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, also set for checkpoints."""
    where = named_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there: lineage ends, lost executors cost nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let the context cleaner drop shuffle files whose frames are out of scope."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches of BATCH_ROWS rows and BATCH_BYTES bytes at most.

    Spark reads these sizes from the session when a plan is run, which for a frame that is handed back is later, so the
    settings are lowered for the session and stay so; lower ones of the caller's are kept.
    """
    spark = df.sparkSession
    conf, size_of = spark.conf, spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for what, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{what}"
        old = conf.get(key)
        if old.startswith("-") or not 0 < size_of(old) <= most:
            conf.set(key, str(most))
    return df.mapInArrow(fn, schema)


def spread(df: DataFrame) -> DataFrame:
    """df with its rows dealt over all cores if it is small.  A small file is often one row group, which one task reads;
    its bytes are moved once, and no more than SMALL_BYTES for each core.  Larger tables have tasks enough."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores * 2) if size <= SMALL_BYTES * cores else df


_resident: dict[str, object] = {}


def resident(key: str, make: Callable[[], object]) -> object:
    """The one large thing (a model, a vocabulary with its caches) that a worker process holds: what key names, made if
    another one was held, which goes.  Workers are used again for other stages, whose memory this would take."""
    if key not in _resident:
        _resident.clear()
        give_back()
        _resident[key] = make()
        give_back()  # what making it took
    return _resident[key]


def vacate() -> None:
    """Let go of what resident() holds: for maps that need none of it, in workers that a stage before has used."""
    if _resident:
        _resident.clear()
        give_back()


def give_back() -> None:
    """Hand freed memory of this process back to the system, where its allocators can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """A string column as Python strings, null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def raw_bytes(column: pa.Array) -> list[memoryview]:
    """UTF-8 bytes of each string without a copy, null as empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary() if wide else pa.binary())
    _, offsets, data = column.buffers()
    if not len(column):
        return []
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    view = memoryview(data) if data is not None else memoryview(b"")
    out = [view[a:b] for a, b in zip(at, at[1:])]
    if column.null_count:
        out = [x if ok else view[:0] for x, ok in zip(out, column.is_valid().to_pylist())]
    return out


def stash(df: DataFrame, name: str, level: int = 3) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder: (the table reread, its path).  Smaller on disk than a checkpoint,
    and discard() can free it as soon as what follows has been written.  level: of compression."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    old = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, old)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """drop(), and let go of shuffle files."""
    drop(spark, *paths)
    release(spark)
