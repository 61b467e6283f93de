"""Codebooks: nearest entries, scalar and vector quantisation with pyspark.ml."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_entry(v: Column, codebook: list[float]) -> Column:
    """Number of the entry of a sorted codebook that is nearest to v, the higher of two equally near."""
    out = F.lit(0)
    for i in range(1, len(codebook)):
        out = F.when(v >= (codebook[i - 1] + codebook[i]) / 2, F.lit(i)).otherwise(out) if len(codebook) <= 16 else out
    if len(codebook) <= 16:
        return out.cast("long")
    middle = F.array(*(F.lit((a + b) / 2) for a, b in zip(codebook, codebook[1:])))
    return F.size(F.filter(middle, lambda m: m <= v)).cast("long")


def entry(index: Column, codebook: list[float]) -> Column:
    return F.element_at(F.array(*map(F.lit, codebook)), (index + 1).cast("int"))


def pooled(df: DataFrame, columns: list[str], name: str = "v") -> DataFrame:
    return df.select(F.explode(F.array(*(F.col(c).cast("double") for c in columns))).alias(name))


def learn_codebook(df: DataFrame, columns: list[str], k: int = 256, seed: int = 42, iterations: int = 20) -> list[float]:
    """Sorted centres of a one-dimensional k-means over all pooled values, each different value weighted by its
    count; where no more than k values differ they are their own codebook."""
    values = pooled(df, columns).where("not isnan(v) and v is not null").groupBy("v").agg(F.count(F.lit(1)).cast("double").alias("w")).orderBy("v").persist()
    try:
        few = [r.v for r in values.limit(k + 1).collect()]
        if len(few) <= k:
            return sorted(few)
        model = KMeans(k=k, seed=seed, maxIter=iterations, featuresCol="f", weightCol="w").fit(values.select(array_to_vector(F.array("v")).alias("f"), "w"))
        return sorted(float(c[0]) for c in model.clusterCenters())
    finally:
        values.unpersist()


def kmeans(df: DataFrame, columns: list[str], k: int, seed: int = 42, iterations: int = 10) -> tuple[DataFrame, list[list[float]]]:
    """(df with label, centres); where k is not below the number of rows each row is its own centre."""
    n = df.count()
    ready = df.withColumn("__f", array_to_vector(F.array(*(F.col(c).cast("double") for c in columns))))
    if k >= n:
        rows = ready.withColumn("label", F.row_number().over(Window.orderBy(*columns)) - 1)
        return rows.drop("__f"), [list(r.v) for r in rows.orderBy("label").select(vector_to_array("__f").alias("v")).collect()]
    model = KMeans(k=k, seed=seed, maxIter=iterations, featuresCol="__f", predictionCol="label").fit(ready)
    return model.transform(ready).drop("__f"), [list(map(float, c)) for c in model.clusterCenters()]


def nearest_centroid(v: list[Column], centroids: list[list[float]]) -> Column:
    """Number of the nearest centroid, the lowest of equally near ones."""
    d = lambda c: sum(((a - F.lit(b)) * (a - F.lit(b)) for a, b in zip(v, c)), F.lit(0.0))
    return F.array_min(F.array(*(F.struct(d(c).alias("d"), F.lit(i).cast("long").alias("i")) for i, c in enumerate(centroids))))["i"]
