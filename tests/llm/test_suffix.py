"""Suffix sorting against sorted(); removal of repeats against a brute-force version."""

import hashlib
import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfield.llm import suffix

SCHEMA = "doc_id long, text string, spare string"


def brute(rows):
    """(n_bytes, n_removed, spans, sha) of each (id, text) by a dictionary of all 50-byte strings."""
    least = {}
    for i, t in rows:
        raw = (t or "").encode()
        if i is not None:
            for p in range(len(raw) - 49):
                w = raw[p : p + 50]
                least[w] = min(i, least.get(w, i))
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        if i is not None:
            for p in range(len(raw) - 49):
                if least[raw[p : p + 50]] < i:
                    gone[p : p + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df, **more):
    got = suffix.repeats(df, **more).select("doc_id", "n_bytes", "n_removed", F.size("spans").alias("n"), "kept_sha256")
    return sorted((tuple(r) for r in got.collect()), key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 9))) for _ in range(300)] + ["é", "ü€", "\n"]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [say(rng.randint(5, 60)) for _ in range(6)] + ["x" * 130, "ab" * 90]
    rows = []
    for i in range(n):
        parts = [say(rng.randint(0, 50)) for _ in range(rng.randint(0, 3))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            parts.insert(rng.randint(0, len(parts)), p[rng.randint(0, 20) :])
        rows.append((rng.randint(-5, 10**9), " ".join(parts), "z"))
    for _ in range(n // 3):
        i, t, z = rng.choice(rows)
        rows.append((rng.randint(0, 10**9), t if rng.random() < 0.5 else t.replace(rng.choice(words), "QQ", 1), z))
    return rows


@pytest.mark.parametrize("seed, most", [(1, 512), (2, 512), (3, 2), (4, 0)])
def test_repeats_equal_brute_force(spark, monkeypatch, seed, most):
    monkeypatch.setattr(suffix, "RANGE", 2048)  # many ranges, so that classes lie across their borders
    rows = corpus(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(df, split_above=most) == brute([r[:2] for r in rows])


def test_edge_rows(spark):
    long = "the quick brown fox jumps over the lazy dog and runs away from it all. " * 3
    rows = [(1, None, None), (2, "", None), (3, long, "a"), (3, long, "a"), (4, long, "b"), (None, long, None), (5, long[:49], None), (6, long[7:57], None), (7, "a" * 500_000, None), (8, "b" + "a" * 60, None), (9, "x" * 400_000 + long, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df) == brute([r[:2] for r in rows])


def test_empty_table(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_kept_bytes(spark):
    rows = [(1, "m" * 20 + "0123456789" * 6, None), (2, "head " + "0123456789" * 6 + " tail", None)]
    got = {r.doc_id: r for r in suffix.repeats(spark.createDataFrame(rows, SCHEMA), keep_text=True).collect()}
    assert bytes(got[2].kept) == b"head  tail" and [tuple(s) for s in got[2].spans] == [(5, 65)]
    assert bytes(got[1].kept) == rows[0][1].encode()


def test_equal_suffixes_equal_a_dictionary():
    rng = np.random.default_rng(5)
    buf = rng.choice(np.frombuffer(b"ab", np.uint8), 4000, p=[0.97, 0.03])
    padded = np.concatenate([buf, np.zeros(64, np.uint8)])
    start = np.arange(len(buf) - 49)
    group = rng.integers(0, 3, len(start))
    order, cls = suffix.equal_suffixes(padded, start, group)
    want = {}
    for s, g in zip(start.tolist(), group.tolist()):
        want.setdefault((g, buf[s : s + 50].tobytes()), set()).add(s)
    want = {frozenset(x) for x in want.values() if len(x) > 1}
    got = {}
    for o, c in zip(order.tolist(), cls.tolist()):
        got.setdefault(c, set()).add(o)
    assert {frozenset(x) for x in got.values()} == want


def test_order_equals_sorted():
    rng = np.random.default_rng(6)
    for letters, p in ((b"ab", [0.97, 0.03]), (b"abc\0\xff", [0.2] * 5)):
        buf = rng.choice(np.frombuffer(letters, np.uint8), 3000, p=p)
        padded = np.concatenate([buf, np.zeros(64, np.uint8)])
        start = rng.permutation(len(buf) - 49)
        group = rng.integers(0, 4, len(start))
        order, cls = suffix.sort_suffixes(padded, start, group)
        key = lambda i: (int(group[i]), buf[start[i] : start[i] + 50].tobytes())
        keys = [key(i) for i in order]
        assert sorted(order.tolist()) == list(range(len(start))) and keys == sorted(keys)
        first = {}
        assert cls.tolist() == [first.setdefault(k, n) for n, k in enumerate(keys)]
    order, cls = suffix.sort_suffixes(padded, start[:0], group[:0])
    assert not len(order) and not len(cls)


def test_equal_suffixes_on_both_sides_of_borders(spark, monkeypatch):
    """One passage in many surroundings, so that its suffixes fill several ranges."""
    monkeypatch.setattr(suffix, "RANGE", 300)
    rng = random.Random(7)
    passage = "".join(rng.choices("abcdefgh ", k=120))
    rows = [(i, "".join(rng.choices("xyz", k=rng.randint(1, 40))) + passage[: rng.randint(60, 120)] + "".join(rng.choices("uvw", k=20)), None) for i in range(150)]
    assert found(spark.createDataFrame(rows, SCHEMA), split_above=3) == brute([r[:2] for r in rows])


def stashed(monkeypatch):
    """Rows of each table that repeats() writes, by name."""
    rows, real = {}, suffix.stash

    def spy(df, name, *a):
        out = real(df, name, *a)
        rows[name] = out[0].count()
        return out

    monkeypatch.setattr(suffix, "stash", spy)
    return rows


def test_anchors_that_fit_a_range_are_not_exploded(spark, monkeypatch):
    """A passage in 700 surroundings: its suffixes need no rows of their own."""
    rng = random.Random(8)
    passage = "".join(rng.choices("abcdefgh ", k=90))
    rows = [(i, "".join(rng.choices("xyz", k=40)) + passage + "".join(rng.choices("uvw", k=40)), None) for i in range(700)]
    tables = stashed(monkeypatch)
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute([r[:2] for r in rows])
    assert tables["each"] > 700 and "ranges" not in tables


def test_short_common_phrases_make_no_segments(spark, monkeypatch):
    """Texts that share phrases of 20 bytes only."""
    rng = random.Random(9)
    phrases = ["".join(rng.choices("abcdefgh ", k=20)) for _ in range(5)]
    rows = [(i, "".join(rng.choice(phrases) + "".join(rng.choices(string.ascii_letters, k=30)) for _ in range(10)), None) for i in range(100)]
    tables = stashed(monkeypatch)
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute([r[:2] for r in rows])
    assert tables["segments"] == 0
