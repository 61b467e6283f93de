"""Targets against water filling by hand, and what the mix takes of each source and row."""

import collections
import random
import re

import pytest

from lumenfield.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target long"


def filled(sizes, repeats=3):
    """Target of each source: shares by weight 1, 2, 3 in turn, none above `repeats` times its size, the rest shared anew."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    left, free, target = float(sum(sizes.values())), set(sizes), {}
    while free:
        whole = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / whole > repeats * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / whole for s in free}
        for s in over:
            target[s] = float(repeats * sizes[s])
            left -= target[s]
        free -= over
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_equal_water_filling(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "Z", "é", "日", None, "", "tiny", "empty"]
    odds = [rng.random() ** 3 for _ in names[:7]]
    rows = [(k, rng.choice([" ", "\t", "\n\n"]).join(["w"] * rng.randint(0, 60)), rng.choices(names[:7], odds)[0], "x", 1) for k in range(900)]
    rows += [(5000, "one two", "tiny", "x", 1), (5001, None, "empty", "x", 1), (5002, " 　 x", "tiny", None, 1), (7, rows[7][1], rows[7][2], "x", 1), (None, "no id here", "a", None, 1)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    sizes = collections.Counter()
    for _, text, source, *_ in rows:
        sizes[source] += words(text)
    target = filled(sizes)
    assert len(got) == len(rows)
    want = collections.Counter((i, words(t), sizes[s], round(target[s], 6)) for i, t, s, *_ in rows)
    assert collections.Counter((r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in got) == want
    taken = collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source_size, round(r.target, 6)] += r.taken
    for (_, t), n in taken.items():
        assert abs(n - t) <= max(64, 0.02 * t)


def test_rows_of_the_mix(spark):
    rows = [(k, "word " * (k % 9), "ab"[k % 2], "x", 1) for k in range(300)] + [(900, None, "a", "x", 1), (901, "", None, "x", 1), (3, "word " * 3, "b", "x", 1), (None, "some words", "b", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    mixed = mixing.mixed(df)
    times = collections.Counter((r.doc_id, r.text) for r in mixed.collect())
    assert mixed.columns == df.columns and set(times) <= {(i, t) for i, t, *_ in rows} and not {(900, None), (901, "")} & set(times)
    assert max(times.values()) <= 6 and times == collections.Counter((r.doc_id, r.text) for r in mixing.mixed(df.repartition(5)).collect())
    assert mixing.mixed(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0
