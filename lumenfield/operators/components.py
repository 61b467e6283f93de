"""Connected components by contraction, large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import delete, written

#: Links that are contracted at a time.
LINKS_AT_ONCE = 1 << 20
#: Ids that are sent to all links at most, and links that such an id has at least.
HUBS, LEAST_HUB = 1024, 64


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, root): every end of the links but the roots, with the smallest id that these links tie it to."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(ids))
    while True:
        p, q = low[x], low[y]
        apart = p != q
        if not apart.any():
            break
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(low, np.maximum(p, q), np.minimum(p, q))
        while (low[low] != low).any():
            low = low[low]
    moved = low != np.arange(len(ids))
    return ids[moved], ids[low[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links to the stars that join the same ids, about LINKS_AT_ONCE at a time."""
    held: list[np.ndarray] = []
    n = 0

    def flush() -> tuple[np.ndarray, np.ndarray]:
        both = np.concatenate(held, axis=1)
        held.clear()
        return stars(both[0], both[1])

    def rows(ids: np.ndarray, roots: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(ids), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + (1 << 16)]), pa.array(roots[k : k + (1 << 16)])], ["u", "v"])

    for b in batches:
        held.append(np.stack([c.to_numpy() for c in b.columns]))
        n += b.num_rows
        if n >= LINKS_AT_ONCE:
            found = flush()
            if 2 * len(found[0]) > LINKS_AT_ONCE:
                yield from rows(*found)
                n = 0
            else:  # carried on, so that what comes next joins it
                held.append(np.stack(found))
                n = len(found[0])
    if held:
        yield from rows(*flush())


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `edges` (a, b: long) as (id, component), component the smallest id reached.

    Links are first contracted where they lie: each partition keeps one link from each id to the smallest id that
    it knows to be reached.  So after a shuffle an id has at most as many rows as there were partitions, whatever
    its links, and a hub is no task's burden.  Then large-star and small-star steps alternate with contraction
    until nothing changes.  Each round is written to the shared folder, and the round before it deleted.
    Ids without a link are not returned.  Self-links and repeated links are harmless; null ends are dropped.
    """
    spark = edges.sparkSession
    link = "u bigint, v bigint"
    plain = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(F.col("a").cast("long"), F.col("b").cast("long"))
    once = plain.mapInArrow(_contract, link).distinct()
    last, old = None, []
    while True:
        cur, path = written(once.mapInArrow(_contract, link).distinct(), "links")
        delete(spark, *old)
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or tuple(now) == last:
            return cur.select(F.col("u").alias("id"), F.col("v").alias("component"))
        last = tuple(now)
        # large star: every larger neighbour of u is tied to the smallest of u's neighbourhood
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low, low_at = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("deg")), "low")
        # ids with more than 1 / HUBS of all ends, fewer than HUBS of them, go to the links; the others meet theirs by a join
        many = max(LEAST_HUB, 2 * now[0] // HUBS)
        hubs = low.where(F.col("deg") > many).select(F.col("u").alias("h"), F.col("m").alias("hm"))
        told = cur.join(F.broadcast(hubs), F.col("v") == F.col("h"), "left")
        rest = told.where("hm is null").select("u", "v").join(low.where(F.col("deg") <= many).select(F.col("u").alias("l"), "m"), F.col("v") == F.col("l")).select("u", F.col("m").alias("v"))
        large = told.where("hm is not null").select("u", F.col("hm").alias("v")).unionByName(rest)
        # small star: u and its smaller neighbours are tied to the smallest of them
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(own, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        once, old = small.select("e.u", "e.v").where("u != v"), [path, low_at]
