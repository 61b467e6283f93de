"""Mixing sources to target weights by Sainte-Lague apportionment; DataFrame and SQL functions only.

Every source is dealt over shards by a seeded hash.  Blocks of equally many words are apportioned to sources,
then within a source to its shards, each time to the highest quotients target / (2 s + 1).  A shard's
documents stand in seeded order, so its blocks are runs of words; the quota takes whole rounds of all
blocks, and the rest from a run of blocks that starts at a seeded place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Documents in a shard, and most shards of a source: what a shard's window sorts stays small, and so does
#: the table of a source's shards.
SHARD_ROWS, MOST_SHARDS = 256, 4096
WORD = r"[^\x20\x09-\x0D]+"
#: Times a document may be taken.
MOST_REPEATS = 3
_SEED = "mix-42-"


def seeded(id_col: str = "doc_id") -> Column:
    """32 bits of the MD5 of the seed and the id as text."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(_SEED), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))), 1, 8), 16, 10).cast("long")


def words_in(text: str = "text") -> Column:
    """Words of a text, null: 0.  Runs of white space to one space, then spaces counted: no list of words."""
    flat = F.regexp_replace(F.col(text), r"[\x20\x09-\x0D]+", " ")
    inner = F.trim(flat)
    n = F.char_length(inner) - F.char_length(F.replace(inner, F.lit(" "), F.lit(""))) + 1
    return F.coalesce(F.when(inner == "", 0).otherwise(n), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weight: Column, source: str = "source", repeats: int = MOST_REPEATS) -> DataFrame:
    """Adds target to a table (source, source_size): shares of all sizes by weight, none above repeats times
    its source; what is above is reshared by weight.  Sources stand by code point, null last."""
    whole = Window.partitionBy()
    row = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last()))
    t = sizes.withColumn("rank", row - 1).withColumn("weight", weight)
    # sources reach their cap in the order of cap / weight
    before = Window.orderBy(F.col("source_size") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("left_words", F.sum("source_size").over(whole) - repeats * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    t = t.withColumn("left_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    capped = F.col("weight") * F.col("left_words") >= repeats * F.col("source_size") * F.col("left_weight")
    # the first source that is not capped sets the rate of all from there on
    t = t.withColumn("rate_rank", F.min(F.when(~capped, F.struct((F.col("source_size") / F.col("weight")).alias("o"), "rank", "left_words", "left_weight"))).over(whole))
    free = ~capped & F.col("rate_rank").isNotNull()
    target = F.when(free, F.col("weight") * F.col("rate_rank.left_words") / F.col("rate_rank.left_weight")).otherwise((repeats * F.col("source_size")).cast("double"))
    return t.withColumn("target", target).select(source, "source_size", "weight", "target")


def apportion(t: DataFrame, by: list[str], seats: Column, share: Column, most: Column, order: list[str]) -> DataFrame:
    """Adds quota: `seats` (constant within `by`) apportioned by highest quotients share / (2 s + 1).

    All seats that rank above seats - m by the quotient's own bound are given at once (m rows); the fewer
    than 2 m + 1 quotients around the last seats are ranked one by one.  No row gets more than `most`.
    """
    group = Window.partitionBy(*by)
    t = t.withColumn("__seats", seats.cast("double")).withColumn("__share", share.cast("double")).withColumn("__most", most)
    t = t.withColumn("__m", F.count(F.lit(1)).over(group)).withColumn("__total", F.sum("__share").over(group))
    floor_at = lambda n: F.floor(F.col("__share") * F.greatest(n, F.lit(0.0)) / F.col("__total") + 0.5)
    sure = F.when(F.col("__total") > 0, floor_at(F.col("__seats") - F.col("__m") / 2)).otherwise(F.lit(0))
    upto = F.when(F.col("__total") > 0, floor_at(F.col("__seats") + F.col("__m") / 2) + 1).otherwise(F.lit(0))
    t = t.withColumn("__sure", sure.cast("long")).withColumn("__upto", upto.cast("long"))
    t = t.withColumn("__open", F.col("__seats").cast("long") - F.sum("__sure").over(group))
    one = t.withColumn("__s", F.explode(F.when(F.col("__upto") > F.col("__sure"), F.sequence("__sure", F.col("__upto") - 1)).otherwise(F.array(F.lit(-1).cast("long")))))
    quotient = F.when(F.col("__s") >= 0, F.col("__share") / (2 * F.col("__s") + 1)).otherwise(F.lit(-1.0))
    ranked = one.withColumn("__place", F.row_number().over(group.orderBy(quotient.desc(), *order, "__s")))
    won = F.sum(F.when((F.col("__s") >= 0) & (F.col("__place") <= F.col("__open")), 1).otherwise(0))
    keep = [c for c in t.columns if not c.startswith("__")]
    return ranked.groupBy(*keep, "__sure", "__most").agg(won.alias("__won")).withColumn("quota", F.least(F.col("__sure") + F.col("__won"), F.col("__most"))).select(*keep, "quota")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source_size, target, taken) of every row: how many words the mix takes of it, with repeats.

    size is the words of the text (null: 0).  Sources by code point, null last, weigh 1, 2, 3 in turn and
    share 100 % of all words; a target stops at 3 times its source.  A row is taken at most 3 times; its
    place depends on its id alone, so reruns agree.  Rows with equal ids are told apart by their size only
    and then by chance of order, which changes neither's total.  An empty table gives an empty result.
    """
    base = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words_in(text_col).alias("size")))
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    ranked = cut(sizes.withColumn("rank", rank))
    whole = Window.partitionBy()
    goal = targets(ranked.select("source", "source_size"), (F.col("rank") % 3 + 1).cast("long"))
    n_shards = ranked.select(F.col("source").alias("s"), F.col("rank").alias("src"), F.least(F.ceil(F.col("n") / SHARD_ROWS), F.lit(MOST_SHARDS)).alias("shards"))
    goal = goal.join(n_shards, goal.source.eqNullSafe(n_shards.s)).select("src", "source", "source_size", "target", "shards")
    # blocks: small against the smallest source, at most 64 words
    least = F.min(F.when(F.col("source_size") > 0, F.col("source_size"))).over(whole)
    goal = goal.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(64), F.floor(F.coalesce(least, F.lit(1)) / 64))).cast("long"))
    goal = apportion(goal, [], F.ceil(F.sum("source_size").over(whole) / F.col("block")), F.col("target"), F.lit(1 << 60).cast("long"), ["src"])
    goal = cut(goal.withColumnRenamed("quota", "blocks"))
    placed = base.join(F.broadcast(goal) if goal.count() <= 4096 else goal, base.source.eqNullSafe(goal.source)).select("id", "size", "src", "source_size", "target", "shards", "block", "blocks", seeded("id").alias("at"))
    placed = placed.withColumn("shard", F.floor(F.col("at") * F.col("shards") / F.lit(float(1 << 32))).cast("long"))
    shards = placed.groupBy("src", "shard", "block", "blocks").agg(F.sum("size").alias("words"))
    shards = shards.withColumn("n", F.ceil(F.col("words") / F.col("block")))
    shards = apportion(shards, ["src"], F.col("blocks"), F.col("words"), MOST_REPEATS * F.col("n"), ["shard"])
    start = F.when(F.col("n") > 0, F.pmod(seeded_place("src", "shard"), F.greatest(F.col("n"), F.lit(1)))).otherwise(0)
    shards = cut(shards.select(F.col("src").alias("k_src"), F.col("shard").alias("k_shard"), "quota", "n", start.alias("first")))
    run = Window.partitionBy("src", "shard").orderBy("at", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = placed.withColumn("end", F.sum("size").over(run)).withColumn("begin", F.col("end") - F.col("size"))
    laid = laid.join(shards, (laid.src == shards.k_src) & (laid.shard == shards.k_shard))
    n, first, rest = F.greatest(F.col("n"), F.lit(1)), F.col("first"), F.pmod(F.col("quota"), F.greatest(F.col("n"), F.lit(1)))
    overlap = lambda a, b: F.greatest(F.lit(0), F.least(F.col("end"), b * F.col("block")) - F.greatest(F.col("begin"), a * F.col("block")))
    part = overlap(first, F.least(first + rest, n)) + overlap(F.lit(0), F.greatest(first + rest - n, F.lit(0)))
    taken = F.floor(F.col("quota") / n) * F.col("size") + part
    return laid.select(F.col("id").alias(id_col), F.col("size"), "source_size", "target", taken.cast("long").alias("taken"))


def seeded_place(*cols: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(_SEED), *(F.col(c).cast("string") for c in cols))), 1, 8), 16, 10).cast("long")


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as rows: each row of docs, with its columns, as often as the words that the mix takes of it make
    up whole texts, rounded (0 to 3 times).  Rows with equal id and size are taken alike: the most of any.  Null texts and
    texts without words hold nothing to take and go; a null id or source is as any other; an empty table gives an
    empty one; columns may have any names."""
    plan = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col)
    size, taken = F.col("size"), F.col("taken")
    times = F.when(size > 0, F.floor((2 * taken + size) / (2 * size))).otherwise(F.lit(0))
    plan = plan.groupBy(F.col(id_col).alias("__id"), F.col("size").alias("__size")).agg(F.max(times).cast("int").alias("__times")).where("__times > 0")
    sized = docs.withColumn("__own", words_in(text_col))
    kept = sized.join(plan, sized[id_col].eqNullSafe(plan["__id"]) & (F.col("__own") == F.col("__size")))
    return kept.withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)
