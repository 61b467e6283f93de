"""Language identification by word-first backoff.

A known word scores by its log frequency in each language; an unseen word falls back to character n-grams,
at each position the longest known one, down to single letters.  Counts are tables in the shared folder that every
worker reads, so neither words, n-grams nor languages pass through the driver or are cut off.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, resident, spread, stash, texts_of
from .tokens import gather

_RUN = re.compile(r"[^\W\d_]+")
LONGEST_GRAM = 4
#: N-grams from this length on tell that a word looks like one of the language.
LONG_GRAM = 3
#: Weight that an item not seen in a language has among its counts.
UNSEEN = 0.1
#: Words that a text's score weighs at most, so that long texts do not all end at 1.
MOST_WEIGHT = 50
#: Bytes of scores, and letters of tokens, that a worker keeps before it starts anew.
CACHE_BYTES, CACHE_LETTERS = 16 << 20, 2 << 20
_COUNTED = "lang string, item string, n bigint"


def _grams(word: str) -> Iterator[str]:
    padded = f" {word} "
    for n in range(1, LONGEST_GRAM + 1):
        for i in range(len(padded) - n + 1):
            yield padded[i : i + n]


def _flush(held: Counter) -> pa.RecordBatch:
    keys = list(held)
    out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([held[k] for k in keys], pa.int64())], ["lang", "item", "n"])
    held.clear()
    return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            held.update((lang, w) for w in _RUN.findall(text.lower()))
            if len(held) > 100_000:
                yield _flush(held)
    if held:
        yield _flush(held)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    for b in batches:
        for lang, word, n in zip(*(c.to_pylist() for c in b.columns)):
            for g in _grams(word):
                held[lang, g] += n
            if len(held) > 100_000:
                yield _flush(held)
    if held:
        yield _flush(held)


def fit(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_rows: int = 8_000) -> str:
    """Count words and n-grams of labelled rows by language; returns the folder of the two tables.

    Rows with a null text or label are left out.  sample_rows bounds the rows learned from, about: it is shared evenly
    among languages, each of which gives the rows whose id has a low hash.  All words and n-grams of those rows count.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes, _ = stash(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")  # small, and known to be
    each = sample_rows / max(1, sizes.count())
    most = F.least(F.lit(float(1 << 40)), F.greatest(F.lit(1.0), F.lit(each * (1 << 40)) / F.col("n")))
    shares = sizes.select(F.col("lang").alias("l"), most.alias("most"))
    sample = rows.join(shares, rows.lang == shares.l).where(F.pmod(F.xxhash64("i"), F.lit(1 << 40)) < F.col("most")).select("lang", "text")
    words, at = stash(arrow_map(sample, _count_words, _COUNTED).groupBy("lang", "item").agg(F.sum("n").alias("n")), "words")
    grams = arrow_map(words, _count_grams, _COUNTED).groupBy("lang", "item").agg(F.sum("n").alias("n"))
    grams.write.option("compression", "zstd").parquet(f"{at}-grams")
    return at


class Counts:
    """Log frequencies of items by language, kept for the languages in which an item was seen."""

    def __init__(self, langs: pa.ChunkedArray, items: pa.ChunkedArray, n: np.ndarray, languages: list[str]):
        col = {x: i for i, x in enumerate(languages)}
        coded = langs.combine_chunks().dictionary_encode()
        column = np.array([col[x] for x in coded.dictionary.to_pylist()], np.int32)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int32)
        named = items.combine_chunks().dictionary_encode()
        names, row = named.dictionary.to_pylist(), named.indices.to_numpy()
        total = np.bincount(column, n, len(languages))
        whole = total + UNSEEN * (len(names) + 1)
        order = np.argsort(row, kind="stable")
        self.at = dict(zip(names, range(len(names))))
        self.start = np.append(np.searchsorted(row[order], np.arange(len(names) + 1)), 0)  # the last for -1
        self.column, n = column[order], n[order]
        self.value = np.log((n + UNSEEN) / whole[self.column]).astype(np.float32)
        #: log frequency of an item not seen in a language
        self.floor = np.log(UNSEEN / whole).astype(np.float32)

    def rows(self, ids: np.ndarray) -> np.ndarray:
        """Log frequencies of items by language; -1 is an item not seen at all."""
        out = np.repeat(self.floor[None, :], len(ids), 0)
        n = np.where(ids < 0, 0, self.start[ids + 1] - self.start[ids])
        row = np.repeat(np.arange(len(ids)), n)
        at = np.repeat(self.start[ids] - (np.cumsum(n) - n), n) + np.arange(len(row))
        out[row, self.column[at]] = self.value[at]
        return out


class Scorer:
    """A model read from fit()'s folder, with a bounded cache of the scores of raw tokens."""

    def __init__(self, folder: str):
        import pyarrow.parquet as pq
        from pyarrow import fs

        tables = []
        for path in (folder, f"{folder}-grams"):
            system, base = fs.FileSystem.from_uri(path)
            tables.append(pq.read_table(base, filesystem=system, columns=["lang", "item", "n"]))
        self.languages = sorted(set(tables[0].column(0).unique().to_pylist()))
        self.words, self.grams = (Counts(t.column(0), t.column(1), t.column(2).to_numpy(), self.languages) for t in tables)
        self.reset()

    def reset(self) -> None:
        self.at: dict[str, int] = {}
        self.letters = 0
        self.rows = np.zeros((1024, len(self.languages) + 2), np.float32)  # the last two columns: words, and how many look known

    def pieces(self, w: str) -> tuple[list[int], float]:
        """The longest known n-gram at each position of an unseen word (-1: none), and the share of long ones."""
        padded, found, long = f" {w} ", [], 0
        n = len(padded) - 1
        get = self.grams.at.get
        for p in range(n):
            for size in range(min(LONGEST_GRAM, n + 1 - p), 0, -1):
                g = get(padded[p : p + size])
                if g is not None:
                    found.append(g)
                    long += size >= LONG_GRAM
                    break
            else:
                found.append(-1)
        return found, long / n

    def add(self, counts: Counts, rows: list[int], ids: list[int], weights: list[float]) -> None:
        """Add the log frequencies of items, weighted, to rows; what belongs to a row stands together."""
        step = max(1, (1 << 22) // max(1, len(self.languages)))
        for k in range(0, len(rows), step):
            at = np.array(rows[k : k + step])
            part = counts.rows(np.array(ids[k : k + step])) * np.array(weights[k : k + step], np.float32)[:, None]
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            self.rows[at[first], :-2] += np.add.reduceat(part, first, axis=0)

    def learn(self, tokens: set[str]) -> None:
        new = tokens - self.at.keys()
        most = max(1024, CACHE_BYTES // (4 * self.rows.shape[1]))
        if new and (len(self.at) + len(new) > most or self.letters > CACHE_LETTERS):
            self.reset()
            new = tokens
        known: tuple[list, list, list] = ([], [], [])
        unseen: tuple[list, list, list] = ([], [], [])
        need = len(self.at) + len(new)
        if need > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(need - len(self.rows), len(self.rows)), self.rows.shape[1]), np.float32)])
        words = self.words.at.get
        for t in new:
            k = self.at[t] = len(self.at)
            self.letters += len(t)
            n, looks = 0, 0.0
            for w in (t,) if t.isalpha() else _RUN.findall(t):
                if not w[0].isalpha() and not any(map(str.isalpha, w)):
                    continue
                i = words(w)
                if i is not None:
                    known[0].append(k)
                    known[1].append(i)
                    known[2].append(1.0)
                    looks += 1
                else:
                    found, long = self.pieces(w)
                    unseen[0].extend([k] * len(found))
                    unseen[1].extend(found)
                    unseen[2].extend([1 / len(found)] * len(found))
                    looks += long
                n += 1
            self.rows[k, -2:] = n, looks
        self.add(self.words, *known)
        self.add(self.grams, *unseen)

    def score(self, texts: list[str]) -> list[tuple[str, float, float]]:
        """Language, posterior (uniform prior, the weight of MOST_WEIGHT words at most) and fit of each text: how many of
        its words are known, unknown ones by their long n-grams."""
        split = [t.lower().split() for t in texts]
        self.learn(set().union(*split) if split else set())
        get, out = self.at.__getitem__, []
        step = max(1, (1 << 22) // self.rows.shape[1])
        for tokens in split:
            total = np.zeros(self.rows.shape[1])
            for k in range(0, len(tokens), step):
                total += self.rows[list(map(get, tokens[k : k + step]))].sum(0, dtype=np.float64)
            if not total[-2] or not self.languages:
                out.append(("und", 0.0, 0.0))
                continue
            z = total[:-2] / total[-2] * min(total[-2], MOST_WEIGHT)
            k = int(np.argmax(z))
            out.append((self.languages[k], float(1 / np.exp(z - z[k]).sum()), float(total[-1] / total[-2])))
        return out


def predict(docs: DataFrame, folder: str, *, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of docs with lang_pred, score and fit of each whole text, by the model in fit()'s folder.

    A null text, a text without a letter, or a model without languages gives `und` and 0.  Ties go to the language
    first by code point.  Repeated rows give repeated results, an empty table an empty one; columns that are not
    in `keep` may have any names.  A very long text takes memory for its words.
    """
    plain = spread(docs.select(*keep, F.col(text_col).alias("__text")))
    fields = "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in plain.schema.fields[:-1]) + ",lang_pred:string,score:double,fit:double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gather(batches, 1 << 20):
            got = resident(folder, lambda: Scorer(folder)).score(texts_of(table.column(table.num_columns - 1)))
            columns = [c.combine_chunks() for c in table.columns[:-1]]
            columns = [pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            columns += [pa.array([x for x, *_ in got], pa.string()), pa.array([x for _, x, _ in got], pa.float64()), pa.array([x for *_, x in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*table.column_names[:-1], "lang_pred", "score", "fit"])

    return arrow_map(plain, run, fields)


def held_out(id_col: str = "doc_id") -> "F.Column":
    """crc32 of the id as text leaves 2 by 4; a null id is neither held out nor learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None, **bounds: int) -> DataFrame:
    """Fit on the labelled rows that are not held out, then predict every row; edge rows as in predict()."""
    folder = fit(docs.where(F.col(id_col).isNotNull() & ~held_out(id_col)), text_col=text_col, lang_col=lang_col, id_col=id_col, **bounds)
    return predict(docs, folder, keep=keep or [id_col], text_col=text_col)


def accepted(docs: DataFrame, *, least: float = 0.3, least_fit: float = 0.2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds: int) -> DataFrame:
    """The rows of docs, with their columns whatever their names, whose language is known: predicted, with a score of
    at least `least`, and made of words that are known or look so by at least `least_fit`.

    Null texts and texts without a letter go; repeated rows share their fate; an empty table, or one where nothing is
    labelled, so that no language is known, leaves no rows.
    """
    folder = fit(docs.where(F.col(id_col).isNotNull() & ~held_out(id_col)), text_col=text_col, lang_col=lang_col, id_col=id_col, **bounds)
    inside = docs.select(*(F.col(c).alias(f"__{k}") for k, c in enumerate(docs.columns)))
    told = predict(inside, folder, keep=inside.columns, text_col=f"__{docs.columns.index(text_col)}")
    told = told.where((F.col("lang_pred") != "und") & (F.col("score") >= least) & (F.col("fit") >= least_fit))
    return told.select(*(F.col(f"__{k}").alias(c) for k, c in enumerate(docs.columns)))
