"""Exact substring deduplication over suffixes sorted by the deep-shallow method.

Suffixes are compared on their first SPAN bytes, so two of them are equal when the same SPAN-byte string starts
at both.  A suffix array of all texts would not fit one machine; suffixes are dealt to tasks by the smallest
hash of a KGRAM-byte string within their first SPAN bytes (equal suffixes hold the same one), and neighbours
with the same anchor travel together as one segment.  Only anchors that two different texts share go on.
Within a task the suffixes of an anchor are sorted: multikey quicksort to a shallow depth, run on all groups in
step and deeper on large ones, then blind tries for the groups whose members still agree.  The suffixes of an anchor with many segments are
dealt to tasks by ranges of their own bytes first; equal ones that a border parts are brought together by it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, raw_bytes, release, stash
from .tokens import gather

#: KGRAM: a multiple of 8, long enough that texts which share nothing longer seldom share an anchor, however many they are.
SPAN, KGRAM = 50, 24
WIDE = SPAN - KGRAM + 1
#: Bytes of text that are hashed at a time; anchors lie below this plus SPAN, in the low bits of a key.
PIECE = 1 << 17
_LOW = np.uint64((1 << 20) - 1)
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))
#: Suffixes that are sorted at a time, about (the last anchor taken may exceed it by RANGE at most), and in a range.
SORT_AT_ONCE, RANGE = 1 << 20, 1 << 18
#: Segments of an anchor above which its suffixes are dealt by ranges before they are sorted: what fits a range stays whole,
#: as a suffix on its own costs far more than one within its segment, and crowds grow faster than the input.
SPLIT_ABOVE = RANGE // WIDE
#: Members of a group up to which a blind trie orders it; larger ones are partitioned by further characters.
TRIE = 64


def _mixed(words: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of rows of words, given column by column."""
    x = words[0] * _C1
    for w in words[1:]:
        y = (w ^ _C3) * _C2
        y ^= y >> np.uint64(31)
        x += y
        x ^= x >> np.uint64(32)
        x *= _C3
    x ^= x >> np.uint64(29)
    return x


def _hashes(buf: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each KGRAM-byte string."""
    m = len(buf) - KGRAM + 1
    words = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,)).copy()
    return _mixed([words[k : k + m] for k in range(0, KGRAM, 8)])


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` entries."""
    size = 1
    while 2 * size <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (width - size)], v[width - size :]) if size < width else v


def segments(texts: list[memoryview]) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring suffixes with one anchor: (text, start, suffixes, anchor - start, anchor's hash)."""
    out: list[list[np.ndarray]] = [[] for _ in range(5)]

    def flush(held: list[tuple[int, int, memoryview]]) -> None:
        buf = np.frombuffer(b"".join(x for *_, x in held), np.uint8)
        size = np.array([len(x) for *_, x in held])
        end = np.cumsum(size)
        h = _hashes(buf)
        key = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        at = (_least(key, WIDE) & _LOW).astype(np.int64)
        ok = np.ones(len(at) + 1, bool)
        for e in end.tolist():
            ok[max(0, e - SPAN + 1) : e] = False
        ok[len(at) :] = False
        fresh = ok[:-1].copy()
        fresh[1:] &= ~ok[:-2] | (at[1:] != at[:-1])
        s = np.flatnonzero(fresh)
        if not len(s):
            return
        shut = np.flatnonzero(ok[:-1] & (~ok[1:] | np.r_[fresh[1:], False])) + 1
        which = np.searchsorted(end, s, "right")
        text = np.array([i for i, *_ in held])[which]
        base = np.array([b for _, b, _ in held])[which]
        for column, x in zip(out, (text, s - (end - size)[which] + base, shut - s, at[s] - s, h[at[s]])):
            column.append(x)

    held: list[tuple[int, int, memoryview]] = []
    total = 0
    for i, x in enumerate(texts):
        for a in range(0, max(0, len(x) - SPAN + 1), PIECE):  # a long text in pieces: each suffix in one of them
            part = x[a : a + PIECE + SPAN - 1]
            if held and total + len(part) > PIECE + SPAN:
                flush(held)
                held, total = [], 0
            held.append((i, a, part))
            total += len(part)
    if held:
        flush(held)
    return tuple(np.concatenate(c) if c else np.zeros(0, np.uint64 if k == 4 else np.int64) for k, c in enumerate(out))


# ---- deep-shallow sorting ---------------------------------------------------------------------------------
def _words_at(buf: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The first SPAN bytes of suffixes as rows of big-endian words, what is beyond them cleared."""
    n = -(-SPAN // 8)
    rows = np.lib.stride_tricks.sliding_window_view(buf, 8 * n)[start]
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    words[:, -1] &= np.uint64(0xFFFFFFFFFFFFFFFF << (64 - 8 * (SPAN - 8 * (n - 1))) & 0xFFFFFFFFFFFFFFFF)
    return words


def _multikey(key: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort by one character of eight bytes, on all groups in step.

    group: the place at which the group of each entry starts.  Returns (order, group of each entry in that order), groups now
    holding equal characters only.
    """
    order, group = np.arange(len(key)), group.copy()
    slot = order  # of entries in groups that are not partitioned yet
    while True:
        own = group[slot]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else slot
        size = np.diff(np.r_[first, len(own)])
        many = np.repeat(size > 1, size)
        slot, size = slot[many], size[size > 1]
        if not len(slot):
            # groups by the slot at which they start
            return order, group
        begin = np.cumsum(size) - size
        chars = key[order[slot]]
        pivot = np.repeat(chars[begin + size // 2], size)
        side = (chars > pivot).view(np.int8) - (chars < pivot).view(np.int8) + np.int8(1)
        rank = np.repeat(np.arange(len(size)) * 3, size) + side
        if (side == 1).all():
            return order, group
        move = np.argsort(rank, kind="stable")
        order[slot], rank = order[slot][move], rank[move]
        fresh = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
        group[slot] = np.repeat(slot[fresh], np.diff(np.r_[fresh, len(rank)]))
        slot = slot[rank % 3 != 1]


class _BlindTries:
    """One trie for each group; a node holds only the bit at which its two sides part."""

    def __init__(self, words: np.ndarray, groups: int):
        self.words = words
        self.bit = np.zeros(len(words) + 1, np.int32)
        self.down = np.zeros((len(words) + 1, 2), np.int64)
        self.used = 0
        self.root = np.zeros(groups, np.int64)  # >= 0: a node; below: ~leaf

    def _turn(self, leaf: np.ndarray, bit: np.ndarray) -> np.ndarray:
        return ((self.words[leaf, bit >> 6] >> (np.uint64(63) - (bit & 63).astype(np.uint64))) & np.uint64(1)).astype(np.int64)

    def insert(self, group: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Insert one leaf into each group; the leaf that it equals, or itself."""
        cur = self.root[group]
        live = np.flatnonzero(cur >= 0)
        while len(live):  # blind descent: only the bits at which nodes part are looked at
            node = cur[live]
            cur[live] = self.down[node, self._turn(leaf[live], self.bit[node])]
            live = live[cur[live] >= 0]
        mate = ~cur
        apart = self.words[leaf] ^ self.words[mate]
        word = (apart != 0).argmax(1)
        x = apart[np.arange(len(leaf)), word]
        new = np.flatnonzero(x != 0)
        if len(new):
            # the first bit at which it parts from that leaf
            v = x[new].copy()
            top = np.zeros(len(new), np.int64)
            for s in (32, 16, 8, 4, 2, 1):
                high = v >> np.uint64(s)
                some = high != 0
                top[some] += s
                v = np.where(some, high, v)
            where = (word[new] * 64 + 63 - top).astype(np.int32)
            g, own = group[new], leaf[new]
            above, side = np.full(len(new), -1), np.zeros(len(new), np.int64)
            cur = self.root[g]
            live = np.arange(len(new))
            while len(live):
                live = live[cur[live] >= 0]
                live = live[self.bit[cur[live]] < where[live]]
                node = cur[live]
                turn = self._turn(own[live], self.bit[node])
                above[live], side[live] = node, turn
                cur[live] = self.down[node, turn]
            node = self.used + np.arange(len(new))
            self.used += len(new)
            self.bit[node] = where
            turn = self._turn(own, where)
            self.down[node, turn] = ~own
            self.down[node, 1 - turn] = cur
            top_ = above < 0
            self.root[g[top_]] = node[top_]
            self.down[above[~top_], side[~top_]] = node[~top_]
        out = mate.copy()
        out[new] = leaf[new]
        return out


    def ranks(self, size: np.ndarray) -> np.ndarray:
        """Where each leaf stands in the order of its group; size: suffixes that a leaf stands for."""
        levels, at = [], self.root[self.root >= 0]
        while len(at):
            levels.append(at)
            below = self.down[at].ravel()
            at = below[below >= 0]
        weight = np.zeros(self.used, np.int64)
        of = lambda x: np.where(x < 0, size[np.where(x < 0, ~x, 0)], weight[np.where(x < 0, 0, x)])
        for at in reversed(levels):
            weight[at] = of(self.down[at, 0]) + of(self.down[at, 1])
        rank, base = np.zeros(len(size), np.int64), np.zeros(self.used, np.int64)
        for at in levels:
            for x, b in ((self.down[at, 0], base[at]), (self.down[at, 1], base[at] + of(self.down[at, 0]))):
                leaf = x < 0
                rank[~x[leaf]] = b[leaf]
                base[x[~leaf]] = b[~leaf]
        return rank


def sort_suffixes(buf: np.ndarray, start: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by group and their first SPAN bytes: (order, class of each in that order); equal ones of a group
    are one class, named by where it begins in the order."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(group, kind="stable")
    head = np.ndarray((len(buf) - 7,), ">u8", buf, strides=(1,))[start[order]].astype(np.uint64)
    own = group[order]
    start_of = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    move, groups = _multikey(head, np.repeat(start_of, np.diff(np.r_[start_of, len(own)])))  # shallow
    order = order[move]
    for k in range(1, -(-SPAN // 8)):  # one character deeper where many members still agree
        first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
        size = np.diff(np.r_[first, len(groups)])
        slot = np.flatnonzero(np.repeat(size > TRIE, size))
        if not len(slot):
            break
        wide = size[size > TRIE]
        move, part = _multikey(_words_at(buf, start[order[slot]])[:, k], np.repeat(np.cumsum(wide) - wide, wide))
        order[slot], groups[slot] = order[slot][move], slot[part]
    cls = groups.copy()  # of groups that were compared to the end
    first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    size = np.diff(np.r_[first, len(groups)])
    open_ = (size > 1) & (size <= TRIE)
    first, size = first[open_], size[open_]
    if not len(size):
        return order, cls
    # deep: groups by size, so that those that still have a member to insert stand in front
    by_size = np.argsort(-size, kind="stable")
    first, size = first[by_size], size[by_size]
    begin = np.cumsum(size) - size
    slot = np.repeat(first - begin, size) + np.arange(int(size.sum()))  # where a member stands in the order
    words = _words_at(buf, start[order[slot]])
    tries = _BlindTries(words, len(size))
    tries.root[:] = ~begin
    leaf_of = np.arange(len(slot))
    for k in range(1, int(size[0])):
        n = int(np.searchsorted(-size, -k, "left"))  # groups with more than k members
        leaf = begin[:n] + k
        leaf_of[leaf] = tries.insert(np.arange(n), leaf)
    weight = np.bincount(leaf_of, minlength=len(slot))
    at = np.repeat(first, size) + tries.ranks(weight)[leaf_of]  # where the class of a member begins
    move = np.argsort(at, kind="stable")
    place = np.sort(slot)
    order[place], cls[place] = order[slot[move]], at[move]
    return order, cls


def equal_suffixes(buf: np.ndarray, start: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, class) of sort_suffixes() without the suffixes that equal no other one of their group."""
    order, cls = sort_suffixes(buf, start, group)
    keep = np.flatnonzero(np.bincount(cls, minlength=len(order))[cls] > 1) if len(cls) else cls
    return order[keep], cls[keep]


def masks(batch: list[bytes], anchor: np.ndarray, off: np.ndarray, count: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each segment the bits of its suffixes that equal one of a segment of the same anchor with a smaller owner."""
    out = np.zeros(len(batch), np.int64)
    size = np.array([len(x) for x in batch])
    base = np.cumsum(size) - size
    buf = np.frombuffer(b"".join(batch) + b"\0" * 64, np.uint8)
    total = int(count.sum())
    seg = np.repeat(np.arange(len(batch)), count)
    nth = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
    # equal suffixes have their anchor in the same place
    group = np.unique(anchor, return_inverse=True)[1][seg] * 64 + (off[seg] - nth)
    order, cls = equal_suffixes(buf, base[seg] + nth, group)
    if len(order):
        cut_at = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]])
        least = np.repeat(np.minimum.reduceat(owner[seg[order]], cut_at), np.diff(np.r_[cut_at, len(cls)]))
        hit = order[owner[seg[order]] > least]
        np.bitwise_or.at(out, seg[hit], np.int64(1) << nth[hit])
    return out


# ---- DataFrame steps --------------------------------------------------------------------------------------
def _anchors(only_hash: bool):
    """Rows (id, digest, text) to a row for each segment; a mark packs start, suffixes and anchor - start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, start, count, off, h = segments(raw_bytes(b.column(2)))
            if len(text):
                columns = {"anchor": h.view(np.int64), "digest": b.column(1).to_numpy()[text]}
                if not only_hash:
                    columns = {"anchor": columns["anchor"], "id": b.column(0).to_numpy()[text], "digest": columns["digest"], "mark": (start << 12) | (count << 6) | off}
                for k in range(0, len(text), 1 << 16):  # the JVM holds a batch outside its heap
                    yield pa.RecordBatch.from_arrays([pa.array(c[k : k + (1 << 16)]) for c in columns.values()], list(columns))

    return run


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, digest, text, marks) to a row for each marked segment, with its bytes."""
    held: list[list] = [[] for _ in range(5)]

    def flush() -> pa.RecordBatch:
        anchor, seg, i, digest, mark = held
        out = [pa.array(np.concatenate(anchor).view(np.int64)), pa.array(seg, pa.binary()), pa.array(np.concatenate(i)), pa.array(np.concatenate(digest)), pa.array(np.concatenate(mark))]
        for x in held:
            x.clear()
        return pa.RecordBatch.from_arrays(out, ["anchor", "seg", "id", "digest", "mark"])

    for b in batches:
        for i, digest, raw, marks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), raw_bytes(b.column(2)), b.column(3)):
            every, raw = marks.values.to_numpy(), bytes(raw)
            for lo in range(0, len(every), 1 << 14):
                m = every[lo : lo + (1 << 14)]
                start, count, off = m >> 12, (m >> 6) & 63, m & 63
                held[0].append(_hash_at(raw, start + off))
                held[1] += [raw[s:e] for s, e in zip(start.tolist(), (start + count + SPAN - 1).tolist())]
                for k, x in ((2, np.full(len(m), i)), (3, np.full(len(m), digest)), (4, m)):
                    held[k].append(x)
                if len(held[1]) >= 1 << 14:
                    yield flush()
    if held[1]:
        yield flush()


def _hash_at(raw: bytes, at: np.ndarray) -> np.ndarray:
    """The anchor hash of the strings that start at `at`."""
    buf = np.frombuffer(raw, np.uint8)
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(buf, KGRAM)[at])
    return _mixed(list(rows.view("<u8").astype(np.uint64).T))


def _sorted_masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, seg, mark, owner) that stand together by anchor to their masks; owner: the least id."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        anchor, mark, owner = (t.column(k).to_numpy() for k in (0, 2, 3))
        got = np.zeros(len(anchor), np.int64)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        size = np.diff(np.r_[first, len(anchor)])
        pick = np.flatnonzero(np.repeat(size > 1, size))
        seg = t.column(1).take(pa.array(pick)).to_pylist()
        count = (mark[pick] >> 6) & 63
        ends = np.cumsum(count)
        lo = 0
        while lo < len(pick):  # whole anchors, about SORT_AT_ONCE suffixes at a time
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SORT_AT_ONCE, "right")))
            while hi < len(pick) and anchor[pick[hi]] == anchor[pick[hi - 1]]:
                hi += 1
            p = pick[lo:hi]
            got[p] = masks(seg[lo:hi], anchor[p], mark[p] & 63, count[lo:hi], owner[p])
            lo = hi
        return pa.RecordBatch.from_arrays([t.column(0).combine_chunks(), t.column(4).combine_chunks(), t.column(3).combine_chunks(), pa.array(got)], ["anchor", "key", "owner", "mask"])

    rest: pa.Table | None = None
    for t in gather(batches, 8 << 20):
        t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
        anchor = t.column(0).to_numpy()
        back = np.flatnonzero(anchor != anchor[-1])
        whole = int(back[-1]) + 1 if len(back) else 0
        if whole:
            yield solve(t.slice(0, whole))
        rest = t.slice(whole).combine_chunks()
    if rest is not None and rest.num_rows:
        yield solve(rest)


def _ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (suf, anchor, key, owner, nth), a range of suffixes, to those that equal one of a smaller owner.

    The first and the last class of a range may go on in another one: what stands for its least owner there is given
    with its bytes.
    """
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held).combine_chunks()
    raw = b"".join(t.column(0).to_pylist())
    buf = np.frombuffer(raw + b"\0" * 64, np.uint8)
    owner = t.column(3).to_numpy()
    order, cls = sort_suffixes(buf, np.arange(t.num_rows) * SPAN, np.zeros(t.num_rows, np.int64))
    cut_at = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]])
    least = np.repeat(np.minimum.reduceat(owner[order], cut_at), np.diff(np.r_[cut_at, len(cls)]))
    more = owner[order] > least
    edge = ~more & ((cls == cls[0]) | (cls == cls[-1]))
    for pick, told in ((order[more], False), (order[edge], True)):
        for k in range(0, len(pick), 1 << 14):
            rows = t.take(pa.array(pick[k : k + (1 << 14)])).combine_chunks()
            suf = rows.column(0) if told else pa.nulls(rows.num_rows, pa.binary())
            columns = [suf, *rows.columns[1:]]
            yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], ["suf", "anchor", "key", "owner", "nth"])


def _removed(size: int, start: list[int], mask: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by suffixes that are repeats."""
    runs: list[tuple[int, int]] = []
    marks = []
    for s, m in zip(start, mask):
        while m:
            low = (m & -m).bit_length() - 1
            n = ((m >> low) + 1 & ~(m >> low)).bit_length() - 1
            marks.append((s + low, s + low + n - 1 + SPAN))
            m &= ~(((1 << n) - 1) << low)
    for a, e in sorted(marks):
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(e, runs[-1][1]))
        else:
            runs.append((a, e))
    return runs


def _finish(keep_text: bool):
    """Rows (id, text, copy, starts, masks) to what is removed of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, spans, digest, kept = [], [], [], [], []
            for raw, copy, start, mask in zip(raw_bytes(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                size = len(raw)
                runs = [(0, size)] if copy and size >= SPAN else _removed(size, start or [], mask or [])
                left, at = [], 0
                for a, e in runs:
                    left.append(raw[at:a])
                    at = e
                left.append(raw[at:])
                out = b"".join(left)
                n.append(size)
                removed.append(size - len(out))
                spans.append([{"start": a, "end": e} for a, e in runs])
                digest.append(hashlib.sha256(out).hexdigest())
                kept.append(out)
            ints = lambda x: pa.array(x, pa.int64())
            columns = [b.column(0).cast(pa.int64()), ints(n), ints(removed), pa.array(spans, _SPANS), pa.array(digest, pa.string())]
            names = ["id", "n_bytes", "n_removed", "spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.binary())] if keep_text else columns, [*names, "kept"] if keep_text else names)

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _packed(at: str = "mark") -> Column:
    return F.col(at).bitwiseAND(F.lit(4095))


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept_sha256[, kept binary]) of each row: its text without each byte that
    lies in a SPAN-byte string which also starts in a row with a smaller id.

    Strings are taken from the texts as given, in UTF-8 bytes, and never cross rows.  A null text counts as
    empty; texts below SPAN bytes, and rows with a null id, lose nothing and cause no removal.  Rows with the
    same id never remove from each other.  Further columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("digest", F.xxhash64("text"))
    long = src.where((F.octet_length("text") >= SPAN) & F.col("id").isNotNull())
    # texts that stand whole under a smaller id go whole; only the first of each class is searched
    prints = long.select("id", "digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"))
    first = prints.groupBy("sha").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    first, first_at = stash(first, "classes")
    whole, _ = stash(prints.join(first.hint("shuffle_hash"), "sha").where("id > least").select("id", "digest").distinct(), "whole")
    discard(spark, first_at)
    # anchors that two different texts share
    shared = arrow_map(long.select("id", "digest", "text"), _anchors(True), "anchor bigint, digest bigint").groupBy("anchor").agg(F.min("digest").alias("a"), F.max("digest").alias("z")).where("a <> z").select("anchor")
    shared, shared_at = stash(shared, "anchors")
    release(spark)
    found = arrow_map(long.select("id", "digest", "text"), _anchors(False), "anchor bigint, id bigint, digest bigint, mark bigint").join(shared.hint("shuffle_hash"), "anchor").select("id", "digest", "mark")
    marks = found.join(whole, ["id", "digest"], "left_anti").groupBy("id", "digest").agg(F.collect_set("mark").alias("marks"))
    marks, marks_at = stash(marks, "marks")
    discard(spark, shared_at)
    # the marked segments with their bytes, then each different segment once, with its least id
    cut_out = arrow_map(long.join(marks, ["id", "digest"]).select("id", "digest", "text", "marks"), _cut_out, "anchor bigint, seg binary, id bigint, digest bigint, mark bigint")
    cut_out, cut_at = stash(cut_out.withColumn("key", F.xxhash64("seg", _packed())), "segments")
    discard(spark, marks_at)
    each = cut_out.groupBy("anchor", "seg", _packed().alias("mark"), "key").agg(F.min("id").alias("owner"), F.max("id").alias("last"))
    each, each_at = stash(each, "each")
    release(spark)
    crowd = each.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split_above)
    crowd, crowd_at = stash(crowd, "crowded")
    calm = each.join(crowd, "anchor", "left_anti").select("anchor", "seg", "mark", "owner", "key").repartition("anchor").sortWithinPartitions("anchor")
    found = arrow_map(calm, _sorted_masks, "anchor bigint, key bigint, owner bigint, mask bigint").where("mask <> 0")
    many = crowd.agg(F.sum("n")).first()[0]
    if many:
        # anchors with too many segments for one task: their suffixes by ranges, sorted alike
        nth = F.posexplode(F.transform(F.sequence(F.lit(0), (F.shiftright("mark", 6) - 1).cast("int")), lambda i: F.substring(F.col("seg"), i + 1, F.lit(SPAN))))
        single = each.join(crowd, "anchor", "left_semi").select("anchor", "key", "owner", nth.alias("nth", "suf"))
        dealt = single.repartitionByRange(-(-many * WIDE // RANGE), "suf", "key", "nth").select("suf", "anchor", "key", "owner", "nth")
        ranged, ranged_at = stash(arrow_map(dealt, _ranged, "suf binary, anchor bigint, key bigint, owner bigint, nth int"), "ranges")
        edges = ranged.where("suf is not null")
        least = edges.groupBy("suf").agg(F.min("owner").alias("least"), F.max("owner").alias("most")).where("least < most").select(F.col("suf").alias("own"), "least")
        more = edges.join(least, F.col("suf") == F.col("own")).where("owner > least").select("anchor", "key", "owner", "nth")
        hit = ranged.where("suf is null").select("anchor", "key", "owner", "nth").unionByName(more)
        found = found.unionByName(hit.groupBy("anchor", "key", "owner").agg(F.expr("bit_or(shiftleft(1L, nth))").alias("mask")))
    found, found_at = stash(found, "masks")
    # what a segment loses in its own document, and in all documents after its least id
    loss = each.where("owner < last").select("anchor", "key", "owner").join(found, ["anchor", "key", "owner"], "full_outer").select("anchor", "key", "owner", F.coalesce("mask", F.lit(0)).alias("mask"))
    loss, loss_at = stash(loss, "losses")
    discard(spark, each_at, crowd_at, found_at, *([ranged_at] if many else []))
    full = F.expr("shiftleft(1L, cast(shiftright(mark & 4095L, 6) as int)) - 1L")
    lost = cut_out.select("anchor", "key", "id", "digest", "mark").join(loss.hint("shuffle_hash"), ["anchor", "key"]).select("id", "digest", F.shiftright("mark", 12).alias("start"), F.when(F.col("id") > F.col("owner"), full).otherwise(F.col("mask")).alias("mask")).where("mask <> 0")
    lost = lost.groupBy("id", "digest").agg(F.collect_set(F.struct("start", "mask")).alias("lost")).select("id", "digest", F.col("lost.start").alias("starts"), F.col("lost.mask").alias("masks"))
    lost, _ = stash(lost, "lost")
    discard(spark, cut_at, loss_at)
    # one table of what is known of a text joins the texts
    known = lost.withColumn("copy", F.lit(False)).unionByName(whole.withColumn("copy", F.lit(True)), allowMissingColumns=True)
    rows = src.join(known, ["id", "digest"], "left").select("id", "text", "copy", "starts", "masks")
    fields = "id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept_sha256 string" + (", kept binary" if keep_text else "")
    return arrow_map(rows, _finish(keep_text), fields).withColumnRenamed("id", id_col)
