"""Orders, dense ordinals, chunks and buckets."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clip, morton3, splat_importance
from ..scratch import delete, shared_dir, written

CHUNK = 256
#: Rows that a task sorts, about.
SORTED = 1 << 18


def dense_ordinal(df: DataFrame, keys: list[Column | str], name: str = "_ord", partitions: int | None = None) -> DataFrame:
    """df with a dense ordinal by keys: range partitions, a sort within each, and the offsets of partitions.

    Partitions grow in number with the rows, so that a task sorts about SORTED of them.  The sorted rows are written
    once, so that counts and numbers come from the same partitions; the offsets are one number for each partition.
    """
    spark = df.sparkSession
    if df.isStreaming:
        raise ValueError("an order needs a complete table")
    n = partitions or partitions_for(spark, df.count())
    path = f"{shared_dir(spark)}/order-{uuid.uuid4().hex}"
    made = {f"__k{i}": k for i, k in enumerate(keys) if not isinstance(k, str)}
    names = [k if isinstance(k, str) else f"__k{i}" for i, k in enumerate(keys)]
    dealt = df.withColumns(made) if made else df
    dealt.repartitionByRange(n, *names).sortWithinPartitions(*names).drop(*made).withColumn("__i", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    counts = {r[0]: r[1] for r in rows.groupBy(F.shiftright("__i", 33)).count().collect()}  # ids have the partition above bit 33
    before, total = [], 0
    for p in range(max(counts, default=0) + 1):
        before.append(total)
        total += counts.get(p, 0)
    at = F.expr(f"element_at(array({', '.join(f'{b}L' for b in before)}), CAST(shiftright(__i, 33) AS INT) + 1)")
    return rows.withColumn(name, F.col("__i").bitwiseAND(F.lit((1 << 33) - 1)) + at).drop("__i")


def partitions_for(spark: SparkSession, rows: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // SORTED))


def chunk_bounds(df: DataFrame, columns: list[str], size: int = CHUNK, ordinal: str = "_ord") -> DataFrame:
    """min and max of columns for each run of `size` ordinals, and its rows."""
    chunk = F.floor(F.col(ordinal) / size).cast("long").alias("chunk_id")
    return df.groupBy(chunk).agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{m}_{c}") for c in columns for m, f in (("min", F.min), ("max", F.max))))


def bucket_centers(df: DataFrame, size: int = CHUNK, ordinal: str = "_ord") -> DataFrame:
    b = chunk_bounds(df, ["x", "y", "z"], size, ordinal)
    return b.select(F.col("chunk_id").alias("bucket_id"), "n", *(((F.col(f"min_{c}") + F.col(f"max_{c}")) / 2).alias(f"center_{c}") for c in "xyz"))


def ten_bits(v: Column, low: Column, high: Column) -> Column:
    """The cell of v among 1024 over [low, high]; 0 on a flat axis."""
    return F.when(high > low, clip((v - low) * (1024.0 / (high - low)), 0.0, 1023.0).cast("long")).otherwise(F.lit(0).cast("long"))


def morton_code(df: DataFrame, name: str = "code", by: list[str] | None = None) -> DataFrame:
    """df with the Morton code of its position within the box of all rows (or of the rows equal in `by`)."""
    ends = [f(c).alias(f"__{m}{c}") for c in "xyz" for m, f in (("a", F.min), ("b", F.max))]
    box = df.groupBy(*by).agg(*ends) if by else df.agg(*ends)
    wide = df.join(box, by) if by else df.crossJoin(F.broadcast(box))
    return wide.withColumn(name, morton3(*(ten_bits(F.col(c), F.col(f"__a{c}"), F.col(f"__b{c}")) for c in "xyz"))).drop(*(f"__{m}{c}" for c in "xyz" for m in "ab"))


def morton_order(df: DataFrame, ties: list[str], most: int = CHUNK, name: str = "_ord") -> DataFrame:
    """df with an ordinal along a Morton curve that is refined within runs of more than `most` equal codes, until each
    such run lies at one point.

    The boxes of crowded runs are written at each level, so that the next one reads them and df, not all before.
    """
    spark = df.sparkSession
    partitions = partitions_for(spark, df.count())
    cur, keys, boxes = morton_code(df, "__m0"), ["__m0"], []
    ends = [f(c).alias(f"__{m}{c}") for c in "xyz" for m, f in (("a", F.min), ("b", F.max))]
    wide = " or ".join(f"__a{c} < __b{c}" for c in "xyz")
    while True:
        crowd, path = written(cur.groupBy(*keys).agg(F.count(F.lit(1)).alias("__c"), *ends).where(f"__c > {most} and ({wide})").drop("__c"), "crowd")
        boxes.append(path)
        if crowd.isEmpty():
            break
        key = f"__m{len(keys)}"
        code = morton3(*(ten_bits(F.col(c), F.col(f"__a{c}"), F.col(f"__b{c}")) for c in "xyz"))
        cur = cur.join(crowd, keys, "left").withColumn(key, F.when(F.col("__ax").isNotNull(), code).otherwise(F.lit(0).cast("long"))).drop(*(f"__{m}{c}" for c in "xyz" for m in "ab"))
        keys.append(key)
    out = dense_ordinal(cur, [*keys, *ties], name, partitions).drop(*keys)
    delete(spark, *boxes)
    return out


def by_importance(df: DataFrame) -> Column:
    """A key that puts the most important splats first."""
    return -splat_importance([F.col(f"scale_{i}") for i in range(3)], F.col("opacity"))
