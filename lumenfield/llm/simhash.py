"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints that may lie within the radius share a block of bits, so they meet in a bucket.  There their
bits are stored vertically: word w of plane j holds bit j of 64 fingerprints.  One fingerprint is compared
with 64 at once by exclusive or, distances are counted by carry-save bitwise counters, and a word is
abandoned once all of its lanes exceed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, components, cut, drop, raw_bytes, spread, stash, vacate

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Members of a bucket above which it is split again by the bits that are still free.
SPLIT_ABOVE = 4096
#: Members of a bucket of the looser search above which links that join nothing new are left out.
FOREST_ABOVE = 64
#: Fingerprints whose planes are made at a time, about (a group may exceed it).
PLANE_ROWS = 1 << 14
#: (query, word) pairs that are compared at a time.
JOBS = 1 << 16


def shingle_hashes(raw: bytes, words: int, seed: int) -> np.ndarray:
    """XXH64 of every run of `words` words (A-Z lower-cased), repeats included; fewer words: of the whole."""
    found = raw.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    line = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    size = np.fromiter(map(len, found), np.int64, len(found))
    end = np.cumsum(size + 1) - 1
    a, b = (end - size)[: len(found) - words + 1].tolist(), end[words - 1 :].tolist()
    x = xxhash.xxh64_intdigest
    return np.array([x(line[i:j], seed) for i, j in zip(a, b)], np.uint64)


def fold(h: np.ndarray) -> int:
    """The fingerprint of hashes: a bit is 1 if it is set in over half of them; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 255):  # as many as a byte can count
        ones += np.add.reduce(np.unpackbits(h[k : k + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    """A further 64-bit hash of hashes."""
    h = (h ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(29))


def _lists(table: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1, dtype=np.int32) * table.shape[1]), pa.array(table.ravel().view(np.int64)))


def fingerprints(docs: DataFrame, *, words: int = 3, seed: int = 42, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp array<long>): a SimHash of 64 * lanes bits of each whole text; null counts as empty: zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        for b in batches:
            found = (shingle_hashes(bytes(raw), words, seed) for raw in raw_bytes(b.column(1)))
            fp = np.array([[fold(h if k == 0 else _mix(h, k)) for k in range(lanes)] for h in found], np.uint64).reshape(-1, lanes)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), _lists(fp)], [id_col, "fp"])

    return arrow_map(spread(docs.select(id_col, text_col)), run, f"{id_col} bigint, fp array<bigint>")


def shingle_set(raw: bytes, words: int, seed: int) -> np.ndarray:
    """The different shingle hashes of a text, in order."""
    return np.unique(shingle_hashes(raw, words, seed))


def set_name(h: np.ndarray) -> int:
    """A 64-bit name (signed) of a shingle set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).view(np.int64))


def band_keys(h: np.ndarray, odd: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """For each band a hash of the minima of `rows` hashes over a shingle set."""
    keys = np.zeros(bands, np.uint64)
    if len(h):
        least = np.full(bands * rows, ALL, np.uint64)
        for a in range(0, len(h), 1 << 11):
            least = np.minimum(least, (odd * h[a : a + (1 << 11)]).min(1))
        for r in range(rows):
            keys = _mix(keys ^ least[r::rows], r)
    return keys


def band_factors(bands: int, rows: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, (bands * rows, 1)).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def sketches(docs: DataFrame, *, words: int, seed: int, lanes: int, bands: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, node long, size long, fp array<long>, keys array<long>): name, shingles, SimHash and band keys of each text's
    shingle set; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        odd = band_factors(bands, rows, seed)
        for b in batches:
            sets = [shingle_set(bytes(raw), words, seed) for raw in raw_bytes(b.column(1))]
            fp = np.array([[fold(h if k == 0 else _mix(h, k)) for k in range(lanes)] for h in sets], np.uint64).reshape(-1, lanes)
            keys = np.array([band_keys(h, odd, bands, rows) for h in sets], np.uint64).reshape(-1, bands)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([set_name(h) for h in sets], pa.int64()), pa.array([len(h) for h in sets], pa.int64()), _lists(fp), _lists(keys)], ["id", "node", "size", "fp", "keys"])

    return arrow_map(spread(docs.select(id_col, text_col)), run, "id bigint, node bigint, size bigint, fp array<bigint>, keys array<bigint>")


def planes_of(fp: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints (n, lanes): row j, word w holds bit j of members 64 w to 64 w + 63."""
    n, lanes = fp.shape
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(n, 8 * lanes), axis=1, bitorder="little")
    words = -(-n // 64)
    full = np.zeros((64 * lanes, words * 64), np.uint8)
    full[:, :n] = bits.T
    return np.packbits(full, axis=1, bitorder="little").view(np.uint64)


def within(fp: np.ndarray, planes: np.ndarray, query: np.ndarray, word: np.ndarray, radius: int) -> np.ndarray:
    """For each job (query: row of fp, word of planes) the 64 lanes at most `radius` bits away, as a mask."""
    need = (radius + 1).bit_length()
    out = np.zeros(len(query), np.uint64)
    live = np.arange(len(query))
    counter = [np.zeros(len(query), np.uint64) for _ in range(need)]
    over = np.zeros(len(query), np.uint64)
    offset = (1 << need) - 1 - radius  # counters start here: they carry out when the radius is exceeded
    for k in range(need):
        if (offset >> k) & 1:
            counter[k][:] = ALL
    zero, one = np.uint64(0), np.uint64(1)
    for j in range(len(planes)):
        carry = planes[j][word] ^ (zero - ((fp[query, j >> 6] >> np.uint64(j & 63)) & one))
        for k in range(need):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over |= carry
        if j & 7 == 7:
            stay = over != ALL
            if not stay.all():
                live, query, word, over = live[stay], query[stay], word[stay], over[stay]
                counter = [c[stay] for c in counter]
                if not len(live):
                    return out
    out[live] = ~over
    return out


def links_in(fp: np.ndarray, start: np.ndarray, size: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of fp within the radius, of members of one group; groups are runs (start, size) of rows."""
    big = size > 1
    start, size = start[big], size[big]
    ends = np.cumsum(size)
    for lo, hi in _steps(ends, PLANE_ROWS):
        own = size[lo:hi]
        end = np.repeat(np.cumsum(own), own)  # of each member's group, in rows of this part
        row = np.repeat(start[lo:hi] - (np.cumsum(own) - own), own) + np.arange(len(end))
        part = fp[row]
        planes = planes_of(part)
        # jobs: each member against the words that hold members of its group after it
        first, last = np.arange(len(end)) >> 6, (end - 1) >> 6
        count = last - first + 1
        for a, b in _steps(np.cumsum(count), JOBS):
            n = count[a:b]
            who = np.repeat(np.arange(a, b), n)
            word = first[who] + np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
            mask = within(part, planes, who, word, radius)
            after = np.where(word == first[who], ALL << ((who & 63).astype(np.uint64)) << np.uint64(1), ALL)
            until = np.where(word == last[who], ALL >> (63 - ((end[who] - 1) & 63)).astype(np.uint64), ALL)
            mask &= after & until
            hit = np.flatnonzero(mask)
            if len(hit):
                k, lane = np.nonzero(np.unpackbits(mask[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                yield row[who[hit[k]]], row[word[hit[k]] * 64 + lane]


def _steps(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    lo, done = 0, 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, done + most, "right")))
        yield lo, hi
        lo, done = hi, int(ends[hi - 1])


def _resplit(fp: np.ndarray, lo: int, hi: int, radius: int, blocks: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within rows lo..hi, a group too large: its members meet again by each run of free bits."""
    for a, n in blocks:
        key = (fp[lo:hi, 0] >> np.uint64(a)) & np.uint64((1 << n) - 1)
        order = np.argsort(key, kind="stable")
        cut_at = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        sizes = np.diff(np.r_[cut_at, hi - lo])
        part = fp[lo:hi][order]
        for x, y in links_in(part, cut_at, sizes, radius):
            yield lo + order[x], lo + order[y]


def forest_in(fp: np.ndarray, radius: int, at_once: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the rows of fp, one group, as all links within the radius would.

    Members outside the largest component so far are compared with all members; when none of those is left,
    every pair of members that could still join two components has been compared.
    """
    n = len(fp)
    planes, words = planes_of(fp), -(-n // 64)
    label, asked = np.arange(n), np.zeros(n, bool)
    found: list[tuple[int, int]] = []

    def top(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    while True:
        root = np.array([top(i) for i in range(n)]) if not found or not asked.any() else label[label]
        while (label[root] != root).any():
            root = label[root]
        label[:] = root
        todo = np.flatnonzero(~asked & (root != np.bincount(root).argmax()))
        if not asked.any():
            todo = np.arange(n)[:1]
        if not len(todo):
            return np.array([a for a, _ in found], np.int64), np.array([b for _, b in found], np.int64)
        _, one = np.unique(root[todo], return_index=True)  # one of each component first
        todo = todo[one] if len(one) > 1 and len(one) < len(todo) else todo
        for q in (todo[k : k + at_once] for k in range(0, min(len(todo), at_once), at_once)):
            asked[q] = True
            step = max(1, JOBS // words)
            for a in range(0, len(q), step):
                part = q[a : a + step]
                mask = within(fp, planes, np.repeat(part, words), np.tile(np.arange(words), len(part)), radius)
                hit = np.unpackbits(mask.view(np.uint8), bitorder="little").reshape(len(part), words * 64)[:, :n]
                for i, row in zip(part.tolist(), hit):
                    mates = np.flatnonzero(row)
                    mates = mates[np.unique(label[mates], return_index=True)[1]]  # one of each component
                    for j in mates.tolist():
                        x, y = top(i), top(j)
                        if x != y:
                            label[max(x, y)] = min(x, y)
                            found.append((i, j))


def _bucket_links(radius: int, widths: list[tuple[int, int]], lanes: int):
    """Streams rows (band, key, fp) sorted by band and key into links between fingerprints' ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        rest: pa.Table | None = None
        fields = None

        def links(t: pa.Table) -> Iterator[pa.RecordBatch]:
            t = t.combine_chunks()
            n = t.num_rows
            if n < 2:
                return
            band, key, node = (t.column(k).to_numpy() for k in range(3))
            fp = t.column(3).chunk(0).flatten().to_numpy().view(np.uint64).reshape(n, lanes)
            start = np.flatnonzero(np.r_[True, (band[1:] != band[:-1]) | (key[1:] != key[:-1])])
            size = np.diff(np.r_[start, n])
            huge = size > (SPLIT_ABOVE if lanes == 1 and widths else FOREST_ABOVE)
            found = list(links_in(fp, start[~huge], size[~huge], radius))
            for s, z in zip(start[huge].tolist(), size[huge].tolist()):
                if lanes == 1 and widths:
                    found += _resplit(fp, s, s + z, radius, widths)
                else:
                    x, y = forest_in(fp[s : s + z], radius)
                    found.append((s + x, s + y))
            for x, y in found:
                pairs = np.unique(np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < 1 << 16:
                continue
            t = pa.Table.from_batches(held)
            band, key = t.column(0).to_numpy(), t.column(1).to_numpy()
            # the last group may go on in the next batch
            back = np.flatnonzero((band != band[-1]) | (key != key[-1]))
            full = int(back[-1]) + 1 if len(back) else 0
            if full:
                yield from links(t.slice(0, full))
            held = t.slice(full).combine_chunks().to_batches()
            rows = t.num_rows - full
        if held:
            yield from links(pa.Table.from_batches(held))

    return run


def near_links(nodes: DataFrame, radius: int = 2, lanes: int = 1) -> DataFrame:
    """Links (a, b) between nodes (node long, fp array<long>) whose fingerprints differ in <= radius bits.

    64-bit fingerprints are cut into radius + 2 blocks; two within the radius agree in two whole blocks, so
    every link is found.  Where nodes bring `keys` (array<long>) they meet by those instead: nodes that agree
    in no key are not compared, and of a large bucket only links that join something are given.  Links may
    come more than once.
    """
    widths: list[tuple[int, int]] = []
    if "keys" not in nodes.columns:
        cuts = [round(i * 64 / (radius + 2)) for i in range(radius + 3)]
        blocks = list(zip(cuts, cuts[1:]))
        part = lambda a, b: F.shiftrightunsigned(F.col("fp")[0], a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long"))
        keys = [F.struct(F.lit(n).alias("band"), F.shiftleft(part(*x), 32).bitwiseOR(part(*y)).alias("key")) for n, (x, y) in enumerate(combinations(blocks, 2))]
        thirds = [round(i * 64 / (radius + 1)) for i in range(radius + 2)]
        widths = [(a, b - a) for a, b in zip(thirds, thirds[1:])]
        met = nodes.select("node", "fp", F.explode(F.array(*keys)).alias("k")).select(F.col("k.band").alias("band"), F.col("k.key").alias("key"), "node", "fp")
    else:
        met = nodes.select("node", "fp", F.posexplode("keys").alias("band", "key")).select("band", "key", "node", "fp")
    met = met.repartition("band", "key").sortWithinPartitions("band", "key")
    return arrow_map(met, _bucket_links(radius, widths, lanes), "a bigint, b bigint")


def classes(docs: DataFrame, *, words: int = 3, seed: int = 42, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long, component_id): the SimHash of each whole text and the smallest id reachable over links.

    Equal fingerprints are one node with its smallest id, so a group of copies of any size costs one row from
    there on.  Texts without words (null ones too) have fingerprint 0 and are linked like any other; repeated
    rows share a node; an empty table gives an empty result; further columns are not read.
    """
    prints = cut(fingerprints(docs, words=words, seed=seed, id_col=id_col, text_col=text_col).select(F.col(id_col).alias("id"), F.col("fp")[0].alias("fp")))
    nodes = cut(prints.groupBy("fp").agg(F.min("id").alias("rep")))
    links = near_links(nodes.select(F.col("fp").alias("node"), F.array("fp").alias("fp")), radius)
    found = components(links)
    roots = nodes.join(found, nodes.fp == found.id, "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    least = roots.groupBy("root").agg(F.min("rep").alias("component_id"))
    labels = cut(roots.join(least, "root").select("fp", "component_id"))
    return prints.join(labels, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


#: Fingerprint words of the looser search, and its bands of minima: two texts at similarity s meet in one of
#: them with probability 1 - (1 - s ** ROWS) ** BANDS; at 0.8 three pairs in a million do not.
LOOSE_LANES, LOOSE_BANDS, LOOSE_ROWS = 8, 24, 4


#: Shingles that are compared in one task, and members of a large component that are asked first.
TOGETHER, FIRST_ASKED = 1 << 21, 8


def loose_radius(similarity: float, bits: int) -> int:
    """Differing bits that pairs of shingle sets of at least `similarity` keep within, but for one in ten million.

    Large sets differ in a bit with probability arccos(cosine) / pi.  Of small ones those that differ by one
    shingle do so most: the bit changes where the others are split evenly.
    """
    odds = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    # the fewest shingles of which one may be missing: c of n or of n + 1
    n = ceil(Fraction(str(similarity)) / (1 - Fraction(str(similarity)))) if similarity < 1 else 0
    odds = max(odds, comb(n, n // 2) / 2 ** (n + 1) if n else 0.0)
    return int(odds * bits + 5.3 * np.sqrt(odds * (1 - odds) * bits)) + 1


def similar_groups(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each of some shingle sets (none empty) the group it is in over links of Jaccard similarity >= `similarity`.

    Members outside the largest group so far are compared with all that their size admits; when none of those
    is left, every pair that could still join two groups has been compared.
    """
    asked_for = Fraction(str(similarity))
    num, den = asked_for.numerator, asked_for.denominator
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    order = np.argsort(size, kind="stable")
    size = size[order]
    names, flat = np.unique(np.concatenate([sets[i] for i in order.tolist()]), return_inverse=True)
    ends = np.cumsum(size)
    starts = ends - size
    mark = np.zeros(len(names), bool)
    label, asked = np.arange(len(sets)), np.zeros(len(sets), bool)
    while True:
        left = ~asked & (label != np.bincount(label).argmax()) if asked.any() else ~asked
        if not left.any():
            break
        q = int(left.argmax())
        asked[q] = True
        lo = int(np.searchsorted(size, -(-num * size[q] // den)))
        hi = int(np.searchsorted(size, den * size[q] // num, "right"))
        own = flat[starts[q] : ends[q]]
        mark[own] = True
        both = np.add.reduceat(mark[flat[starts[lo] : ends[hi - 1]]], starts[lo:hi] - starts[lo], dtype=np.int64)
        mark[own] = False
        joined = np.unique(label[lo:hi][both * den >= num * (size[q] + size[lo:hi] - both)])
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]
    out = np.empty(len(sets), np.int64)
    out[order] = label
    return out


def _verified(words: int, seed: int, similarity: float):
    """Streams rows (component, node, text) sorted by component and node into (node, root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        nodes: list[int] = []
        sets: list[np.ndarray] = []
        at = None

        def group() -> pa.RecordBatch:
            label = similar_groups(sets, similarity)
            name = np.array(nodes, np.int64)
            _, first = np.unique(label, return_index=True)
            root = name[first[np.searchsorted(label[first], label)]]
            return pa.RecordBatch.from_arrays([pa.array(name), pa.array(root)], ["node", "root"])

        for b in batches:
            for component, node, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), raw_bytes(b.column(2))):
                if component != at and sets:
                    yield group()
                    nodes, sets = [], []
                at = component
                if nodes and nodes[-1] == node:
                    continue
                h = shingle_set(bytes(raw), words, seed)
                if len(h) and set_name(h) == node:  # else another text of an id that is not unique
                    nodes.append(node)
                    sets.append(h)
        if sets:
            yield group()

    return run


def _sets(words: int, seed: int):
    """Rows (component, part, node, text) to (component, part, node, h): the shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        for b in batches:
            sets = [shingle_set(bytes(raw), words, seed) for raw in raw_bytes(b.column(3))]
            # of an id that is not unique only the text that the node stands for
            ok = [k for k, (h, node) in enumerate(zip(sets, b.column(2).to_pylist())) if len(h) and set_name(h) == node]
            flat = np.concatenate([sets[k] for k in ok]) if ok else np.zeros(0, np.uint64)
            ends = np.cumsum([0, *(len(sets[k]) for k in ok)]).astype(np.int32)
            part = b.take(pa.array(ok, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))], ["component", "part", "node", "h"])

    return run


def _rows_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, ends) of a list column."""
    lists = pa.concat_arrays(column.chunks)
    ends = np.cumsum(lists.value_lengths().to_numpy())
    return lists.flatten().to_numpy(), ends


def cross_links(h: np.ndarray, ends: np.ndarray, label: np.ndarray, q: np.ndarray, q_ends: np.ndarray, q_label: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) for each query and each other label with a member similar to it: that with the lowest row."""
    asked_for = Fraction(str(similarity))
    num, den = asked_for.numerator, asked_for.denominator
    size = np.diff(np.r_[0, ends])
    order = np.argsort(size, kind="stable")
    size, label = size[order], label[order]
    starts = (ends - np.diff(np.r_[0, ends]))[order]
    flat = h[np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    names, flat = np.unique(flat, return_inverse=True)
    tops = np.cumsum(size)
    begins = tops - size
    mark = np.zeros(len(names), bool)
    left, right = [], []
    for k, (a, b) in enumerate(zip(np.r_[0, q_ends[:-1]].tolist(), q_ends.tolist())):
        n = b - a
        lo, hi = int(np.searchsorted(size, -(-num * n // den))), int(np.searchsorted(size, den * n // num, "right"))
        if lo >= hi:
            continue
        at = np.searchsorted(names, q[a:b])
        at = at[(at < len(names)) & (names[np.minimum(at, len(names) - 1)] == q[a:b])]
        mark[at] = True
        both = np.add.reduceat(mark[flat[begins[lo] : tops[hi - 1]]], begins[lo:hi] - begins[lo], dtype=np.int64)
        mark[at] = False
        hit = np.flatnonzero((both * den >= num * (n + size[lo:hi] - both)) & (label[lo:hi] != q_label[k])) + lo
        hit = hit[np.unique(label[hit], return_index=True)[1]]
        left.append(np.full(len(hit), k))
        right.append(order[hit])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _large_groups(texts: DataFrame, sizes: DataFrame, words: int, seed: int, similarity: float) -> tuple[DataFrame, list[str]]:
    """(node, root) of the members of components too large for one task, over links of exact similarity; scratch paths.

    Sets lie in parts of about TOGETHER shingles.  A few members of each component are asked first and meet every part; what
    they join is one group.  Then members outside the largest group of their component are asked, as many as TOGETHER
    shingles hold at a time, until none is left: then every pair that could still join two groups has been compared.
    """
    spark = texts.sparkSession
    parts = sizes.select(F.col("component").alias("c"), F.ceil(F.col("total") / TOGETHER).alias("parts"), F.greatest(F.lit(FIRST_ASKED), F.floor(TOGETHER / (F.col("total") / F.col("n")))).cast("long").alias("most"))
    placed = texts.join(parts, F.col("component") == F.col("c")).select("component", F.pmod(F.xxhash64("node"), "parts").alias("part"), "node", "text")
    sets, sets_at = stash(arrow_map(placed, _sets(words, seed), "component bigint, part bigint, node bigint, h array<bigint>"), "sets")
    members, members_at = stash(sets.select("component", "part", "node").distinct(), "parts")
    scratch, found, asked, rounds = [sets_at, members_at], None, None, 0

    def compare(own: pa.Table, more: pa.Table) -> pa.Table:
        """Sets of a part against the queries among the rows that came with it; the others are the labels of its nodes."""
        label = more.filter(pa.compute.is_null(more.column("qh")))
        queries = more.filter(pa.compute.is_valid(more.column("qh")))
        if not own.num_rows or not queries.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        node = own.column("node").to_numpy()
        named = label.column("q").to_numpy()
        by = np.argsort(named, kind="stable")
        own_label = label.column("qlabel").to_numpy()[by[np.searchsorted(named[by], node)]]
        (h, ends), (q, q_ends) = _rows_of(own.column("h")), _rows_of(queries.column("qh"))
        x, y = cross_links(h, ends, own_label, q, q_ends, queries.column("qlabel").to_numpy(), similarity)
        return pa.table({"a": queries.column("q").to_numpy()[x], "b": node[y]})

    while True:
        told = members
        if found is None:
            told = told.withColumn("label", F.col("node"))
        else:
            told = told.join(components(found).withColumnRenamed("component", "r"), F.col("node") == F.col("id"), "left").select("component", "part", "node", F.coalesce("r", "node").alias("label"))
        told, told_at = stash(told, "labels")
        scratch.append(told_at)
        count = told.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n"))
        top = count.groupBy(F.col("component").alias("c")).agg(F.max(F.struct("n", "label")).alias("top")).select("c", F.col("top.label").alias("top"))
        left = told.join(top, F.col("component") == F.col("c")).where(F.col("label") != F.col("top")).select("component", "node", "label")
        if asked is not None:
            left = left.join(asked, "node", "left_anti")
        one = left if rounds > 1 else left.groupBy("component", "label").agg(F.min("node").alias("node"))  # one of each group first
        dealt = one.join(parts, F.col("component") == F.col("c"))
        most = F.lit(FIRST_ASKED) if rounds == 0 else F.col("most")
        picked = dealt.withColumn("slot", F.pmod(F.xxhash64("node", F.lit(rounds)), most)).groupBy("component", "slot").agg(F.min(F.struct("node", "label")).alias("q"))
        queries, queries_at = stash(picked.select(F.col("component").alias("qc"), F.col("q.node").alias("q"), F.col("q.label").alias("qlabel")), "asked")
        scratch.append(queries_at)
        if queries.isEmpty():
            return told.select("node", F.col("label").alias("root")), scratch
        new = queries.select(F.col("q").alias("node"))
        asked = new if asked is None else asked.unionByName(new)
        full = queries.join(sets.select(F.col("node").alias("m"), F.col("h").alias("qh")), F.col("q") == F.col("m")).join(parts, F.col("qc") == F.col("c"))
        full = full.withColumn("qpart", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("qc", "qpart", "q", "qlabel", "qh")
        full = full.unionByName(told.select(F.col("component").alias("qc"), F.col("part").alias("qpart"), F.col("node").alias("q"), F.col("label").alias("qlabel"), F.lit(None).cast("array<bigint>").alias("qh")))
        links = sets.groupBy("component", "part").cogroup(full.groupBy("qc", "qpart")).applyInArrow(compare, "a bigint, b bigint")
        links, links_at = stash(links, "pairs")
        scratch.append(links_at)
        found = links if found is None else found.unionByName(links)
        rounds += 1


def near_duplicates(docs: DataFrame, *, words: int = 5, similarity: float = 0.8, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id): documents linked where the Jaccard similarity of their sets of shingles is as asked or more.

    Documents meet in buckets by minima of their shingles' hashes; SimHashes within a radius clearly wider than
    asked for make them candidates.  The sets of each component of candidates are compared exactly: in one task where
    they hold TOGETHER shingles at most, in parts over many tasks else; both give the same groups.  Texts without
    words (null ones too) are alike; equal sets are one node; rows with a null id have no component; repeated rows
    share theirs; an empty table gives an empty result; further columns are not read.
    """
    spark = docs.sparkSession
    prints, prints_at = stash(sketches(docs, words=words, seed=seed, lanes=LOOSE_LANES, bands=LOOSE_BANDS, rows=LOOSE_ROWS, id_col=id_col, text_col=text_col), "sketches")
    nodes, nodes_at = stash(prints.where("id is not null").groupBy("node").agg(F.min("id").alias("rep"), F.min("size").alias("size"), F.min("fp").alias("fp"), F.min("keys").alias("keys")), "nodes")
    loose = components(near_links(nodes.select("node", "fp", "keys"), loose_radius(similarity, 64 * LOOSE_LANES), LOOSE_LANES))
    members = loose.select(F.col("id").alias("node"), "component").union(loose.select(F.col("component").alias("node"), "component").distinct())
    asked, asked_at = stash(nodes.select("node", "rep", "size").join(members, "node"), "members")
    large, large_at = stash(asked.groupBy("component").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("n")).where(F.col("total") > TOGETHER), "large")
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    small = texts.join(asked.join(large, "component", "left_anti"), "rep").select("component", "node", "text")
    met = small.repartition("component").sortWithinPartitions("component", "node")
    found = arrow_map(met, _verified(words, seed, similarity), "node bigint, root bigint")
    scratch: list[str] = []
    if not large.isEmpty():
        roots, scratch = _large_groups(texts.join(asked.join(large.select("component"), "component"), "rep").select("component", "node", "text"), large, words, seed, similarity)
        found = found.unionByName(roots)
    found, found_at = stash(found, "groups")
    roots = nodes.select("node", "rep").join(found, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    least = roots.groupBy("root").agg(F.min("rep").alias("component_id"))
    labels = roots.join(least, "root").select("node", "component_id")
    out = prints.select("id", "node").join(labels, "node", "left").select(F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
    out, _ = stash(out, "near")
    drop(spark, prints_at, nodes_at, asked_at, large_at, found_at, *scratch)
    return out


def representatives(docs: DataFrame, *, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, that stand for their group of near-duplicates: its smallest id.

    Of repeated rows (equal id and text) one stays; rows with a null id stay, all of them; columns may have any names;
    an empty table leaves none.
    """
    found = near_duplicates(docs, words=words, similarity=similarity, id_col=id_col, text_col=text_col)
    keep = found.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("__keep")).distinct()
    named = docs.where(F.col(id_col).isNotNull())
    stays = named.join(keep, F.col(id_col) == F.col("__keep"), "left_semi").withColumn("__mark", F.xxhash64(text_col)).dropDuplicates([id_col, "__mark"]).drop("__mark")
    return stays.unionByName(docs.where(F.col(id_col).isNull()))
