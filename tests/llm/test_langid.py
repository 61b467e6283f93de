"""Language ID against a plain scorer over dictionaries, many languages, rejection, edge rows."""

import collections
import math
import random
import re

import pytest

from lumenfield.llm import langid

SCHEMA = "doc_id long, text string, lang string, fit string"


def plain(rows, learned):
    """(language, score, fit) of each text by dictionaries; learned: the (text, language) pairs."""
    words = collections.defaultdict(collections.Counter)
    for text, lang in learned:
        words[lang].update(re.findall(r"[^\W\d_]+", text.lower()))
    grams = collections.defaultdict(collections.Counter)
    for lang, counts in words.items():
        for w, n in counts.items():
            p = f" {w} "
            for size in (1, 2, 3, 4):
                for i in range(len(p) - size + 1):
                    grams[lang][p[i : i + size]] += n
    languages = sorted(words)
    whole = lambda table: {x for c in table.values() for x in c}
    known, pieces = whole(words), whole(grams)
    total = {id(t): {x: sum(t[x].values()) for x in languages} for t in (words, grams)}

    def log(table, names, lang, item):
        return math.log((table[lang][item] + 0.1) / (total[id(table)][lang] + 0.1 * (len(names) + 1)))

    def one(w):
        if w in known:
            return [log(words, known, x, w) for x in languages], 1.0
        p, scores, long = f" {w} ", [0.0] * len(languages), 0
        for i in range(len(p) - 1):
            g = next((p[i : i + n] for n in range(min(4, len(p) - i), 0, -1) if p[i : i + n] in pieces), None)
            long += g is not None and len(g) >= 3
            for k, x in enumerate(languages):
                scores[k] += log(grams, pieces, x, g if g is not None else "\0")
        return [s / (len(p) - 1) for s in scores], long / (len(p) - 1)

    out = []
    for text in rows:
        found = [w for w in re.findall(r"[^\W\d_]+", (text or "").lower()) if any(map(str.isalpha, w))]
        if not found or not languages:
            out.append(("und", 0.0, 0.0))
            continue
        each = [one(w) for w in found]
        z = [sum(s[k] for s, _ in each) / len(each) * min(50, len(each)) for k in range(len(languages))]
        best = max(range(len(z)), key=lambda k: (z[k], -k))
        out.append((languages[best], 1 / sum(math.exp(v - z[best]) for v in z), sum(f for _, f in each) / len(each)))
    return out


def held(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 4 == 2


def against_plain(spark, rows):
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, SCHEMA), keep=["doc_id"]).collect()}
    learned = [(t, x) for i, t, x, _ in rows if t is not None and x is not None and i is not None and not held(i)]
    for (i, *_), (lang, score, fit) in zip(rows, plain([r[1] for r in rows], learned)):
        assert got[i].lang_pred == lang, i
        assert got[i].score == pytest.approx(score, rel=1e-3, abs=1e-6) and got[i].fit == pytest.approx(fit, abs=1e-5), i
    return got


def test_scores_equal_a_plain_scorer(spark):
    rng = random.Random(1)
    letters = ["abcdeé ", "abxyz ", "bcœmno ", "日本語 "]
    say = lambda k, n: "".join(rng.choice(letters[k]) for _ in range(n))
    rows = [(i, say(k := rng.randrange(4), rng.randint(1, 60)), f"l{k}" if rng.random() < 0.8 else None, "x") for i in range(400)]
    rows += [(1000, None, "l0", "x"), (1001, "", "l1", "x"), (1002, "12 3!", "l1", "x"), (1003, "²Ⅷ _", "l2", "x"), (1004, "Zürich ÀÉ", None, "x"), (1005, "abcde" * 3000, None, "x")]
    against_plain(spark, rows)


def test_three_hundred_languages(spark):
    rng = random.Random(2)
    own = [["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(8)] for _ in range(300)]
    rows = [(i, " ".join(rng.choices(own[i % 300], k=12)), f"{i % 300:03d}", None) for i in range(3000)]
    got = against_plain(spark, rows)
    assert sum(got[i].lang_pred == x for i, _, x, _ in rows) > 2950 and len({r.lang_pred for r in got.values()}) == 300


def test_caches_may_start_anew(spark, monkeypatch):
    rows = [(i, f"word{i} some other{i % 7}", "ab"[i % 2], None) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    folder = langid.fit(df)
    texts = [r[1] for r in rows]
    want = langid.Scorer(folder).score(texts)
    monkeypatch.setattr(langid, "CACHE_LETTERS", 10)
    small = langid.Scorer(folder)
    assert [x for k in range(0, 300, 7) for x in small.score(texts[k : k + 7])] == want


def test_acceptance(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["bako", "lumo", "tari"] if i % 2 else ["xenth", "quorr", "zwick"], k=9)), "ab"[i % 2], "x") for i in range(200)]
    odd = [(900, "жщ чъё ьюя", None, "x"), (901, "bakolumo tarix", None, "x"), (902, None, None, "x"), (902, None, None, "x"), (903, rows[0][1], None, "x"), (903, rows[0][1], None, "x"), (None, "lumo bako", None, "x")]
    df = spark.createDataFrame([*rows, *odd], SCHEMA)
    kept = langid.accepted(df)
    left = collections.Counter(r.doc_id for r in kept.collect())
    assert kept.columns == df.columns and left == collections.Counter([*(r[0] for r in rows), 901, 903, 903, None])
    assert langid.accepted(df.limit(0)).count() == 0 and langid.accepted(df.where("lang is null")).count() == 0


def test_sample_is_shared_among_languages(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "if(id % 100 = 0, 'rare', 'often') AS text", "if(id % 100 = 0, 'r', 'o') AS lang")
    folder = langid.fit(df, sample_rows=400)
    n = {r.lang: r.n for r in spark.read.parquet(folder).collect()}
    assert n["r"] == 200 and 130 < n["o"] < 280
