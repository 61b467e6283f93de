"""Byte-pair encoding: segment-tree merging, decoding, and token counts for every prefix.

Pre-tokens are cut by the vocabulary's own pattern.  Words not seen before are encoded together: one segment
tree per word lies in a row of a numpy array, its leaves hold (rank, position) of adjacent pairs, its root
is the leftmost lowest-rank merge, and each merge updates three leaves and their ancestors.  Long words use
the same tree one at a time.
"""

from __future__ import annotations

import json
import re
from itertools import accumulate, chain

import numpy as np
import regex

from .common import resident

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same cut for texts without the characters of _ODD, by the faster library.
_QUICK = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_ODD = re.compile("[\x1c-\x1f\x85²³¹¼-¾]|[^\x00-ɏ‐-‧€]")
_NONE = np.int64(1) << 60
#: About how many bytes of words and tokens a worker keeps before they age: a bound on memory, no effect on results.
CACHE_BYTES = 40 << 20
#: Bytes that an entry takes besides its letters (a cached word with a few tokens), and for each token or prefix count.
_ENTRY, _TOKEN = 180, 16


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that the vocabulary file uses for the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown}
    letters |= {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
    return letters


class _Table:
    """int64 key -> int64 value in open addressing, looked up for whole arrays at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(10, (4 * max(1, len(keys))).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int64)
        todo = np.arange(len(keys))
        slot = self._slot(keys)
        while len(todo):
            free = self.keys[slot[todo]] == -1
            _, first = np.unique(slot[todo[free]], return_index=True)
            put = todo[free][first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where a key is unknown (keys are 0 or more)."""
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        todo = np.flatnonzero((found != keys) & (found != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            found = self.keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out


class Vocabulary:
    """A byte-level BPE vocabulary read from a tokenizers JSON file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        letters = _byte_letters()
        tokens = spec["model"]["vocab"]
        self.bytes_of = [b""] * (max([*tokens.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for text, i in tokens.items():
            self.bytes_of[i] = bytes(letters[c] for c in text)
        self.id_of = {self.bytes_of[i]: i for i in tokens.values()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self.special_cut = re.compile("|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        n = len(merges)
        left, right, made = (np.empty(n, np.int64) for _ in range(3))
        for r, (a, b) in enumerate(merges):
            left[r], right[r], made[r] = tokens[a], tokens[b], tokens[a + b]
        key = (left << 20) | right
        self.pairs = _Table(key, np.arange(n))
        self.rank = {k: r for r, k in enumerate(key.tolist())}
        self.made_by = made
        self.made = made.tolist()
        self.byte_id = np.array([self.id_of[bytes([b])] for b in range(256)], np.int64)
        self.cut = regex.compile(PATTERN)
        self.id_text = [str(i) for i in range(len(self.bytes_of))]
        self.longest = max(map(len, self.id_of))
        # for the prefix counts: the merge that makes a token
        size = len(self.bytes_of)
        self.made_rank = np.full(size, -1, np.int64)
        self.part_left, self.part_right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        for r in range(n - 1, -1, -1):
            self.made_rank[made[r]], self.part_left[made[r]], self.part_right[made[r]] = r, left[r], right[r]

    # ---- cutting -------------------------------------------------------------------------------
    def words(self, text: str) -> list[str]:
        return (self.cut if _ODD.search(text) else _QUICK).findall(text)

    def pieces(self, text: str) -> list[tuple[str, bool]]:
        """Runs of ordinary text and special strings, in order."""
        if not self.special_cut or not self.special_cut.search(text):
            return [(text, False)] if text else []
        out, at = [], 0
        for m in self.special_cut.finditer(text):
            if m.start() > at:
                out.append((text[at : m.start()], False))
            out.append((m[0], True))
            at = m.end()
        if at < len(text):
            out.append((text[at:], False))
        return out

    # ---- merging -------------------------------------------------------------------------------
    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank (or _NONE) of each pair; a part below 0 is none."""
        r = self.pairs.get(np.where((a >= 0) & (b >= 0), (a << 20) | b, 0x7FFFFFFFFFFF).ravel()).reshape(a.shape)
        return np.where(r >= 0, r, _NONE)

    def encode_words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Token ids of each word; words of like length share one array of segment trees."""
        out: list[tuple[int, ...]] = [()] * len(words)
        classes: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            n = len(w)
            if n == 1:
                out[i] = (int(self.byte_id[w[0]]),)
            elif n > 64:
                out[i] = self.encode_long(w)
            elif n:
                classes.setdefault(16 if n <= 16 else 64, []).append(i)
        for leaves, members in classes.items():
            for k in range(0, len(members), 16384):
                part = members[k : k + 16384]
                for i, ids in zip(part, self._encode_class([words[j] for j in part], leaves)):
                    out[i] = ids
        return out

    def _encode_class(self, words: list[bytes], leaves: int) -> list[tuple[int, ...]]:
        n, bits = len(words), leaves.bit_length()
        raw = np.frombuffer(b"".join(w.ljust(leaves, b"\0") for w in words), np.uint8).reshape(n, leaves)
        length = np.array([len(w) for w in words])
        where = np.arange(leaves)
        tok = np.where(where < length[:, None], self.byte_id[raw], -1)
        nxt = np.tile(where + 1, (n, 1))
        prv = np.tile(where - 1, (n, 1))
        right = np.concatenate([tok[:, 1:], np.full((n, 1), -1)], 1)
        rank = self._pairs(tok, right)
        tree = np.full((n, 2 * leaves), _NONE, np.int64)
        tree[:, leaves:] = np.where(rank < _NONE, (rank << bits) | where, _NONE)
        for level in (1 << s for s in range(leaves.bit_length() - 2, -1, -1)):
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        live = np.flatnonzero(tree[:, 1] < _NONE)
        while len(live):
            root = tree[live, 1]
            at = root & ((1 << bits) - 1)
            made = self.made_by[root >> bits]
            gone = nxt[live, at]
            after = nxt[live, gone]
            before = prv[live, at]
            tok[live, at] = made
            tok[live, gone] = -1
            nxt[live, at] = after
            inside = after < leaves
            prv[live[inside], after[inside]] = at[inside]
            end = np.where(inside, tok[live, np.minimum(after, leaves - 1)], -1)
            start = np.where(before >= 0, tok[live, np.maximum(before, 0)], -1)
            r1 = self._pairs(made, end)
            r0 = self._pairs(start, made)
            tree[live, leaves + gone] = _NONE
            tree[live, leaves + at] = np.where(r1 < _NONE, (r1 << bits) | at, _NONE)
            some = before >= 0
            tree[live[some], leaves + before[some]] = np.where(r0 < _NONE, (r0 << bits) | before, _NONE)[some]
            for place in (gone, at, np.maximum(before, 0)):
                node = (leaves + place) >> 1
                while node[0]:
                    tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, 2 * node + 1])
                    node = node >> 1
            live = live[tree[live, 1] < _NONE]
        keep = tok >= 0
        ends = np.cumsum(keep.sum(1)).tolist()
        flat = tok[keep].tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends)]

    def encode_long(self, word: bytes) -> tuple[int, ...]:
        """One word of any length: a segment tree in a list, O(log n) for each merge."""
        tok = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(tok)
        leaves = 1 << max(1, (n - 1).bit_length())
        none = (1 << 60, 0)
        tree = [none] * (2 * leaves)
        rank, made = self.rank, self.made
        for i in range(n - 1):
            r = rank.get((tok[i] << 20) | tok[i + 1])
            if r is not None:
                tree[leaves + i] = (r, i)
        for i in range(leaves - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, v: tuple[int, int]) -> None:
            i += leaves
            tree[i] = v
            i >>= 1
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                tree[i] = a if a <= b else b
                i >>= 1

        while tree[1] is not none and tree[1][0] < (1 << 60):
            r, at = tree[1]
            gone = nxt[at]
            after, before = nxt[gone], prv[at]
            tok[at], tok[gone] = made[r], -1
            nxt[at] = after
            put(gone, none)
            r1 = None
            if after < n:
                prv[after] = at
                r1 = rank.get((tok[at] << 20) | tok[after])
            put(at, none if r1 is None else (r1, at))
            if before >= 0:
                r0 = rank.get((tok[before] << 20) | tok[at])
                put(before, none if r0 is None else (r0, before))
        return tuple(t for t in tok if t >= 0)

    # ---- prefix counts -------------------------------------------------------------------------
    def _candidates(self) -> _Table:
        """The tokens that encode to themselves by the hash of their bytes; what it finds is compared with `spelt`."""
        if not hasattr(self, "_cand"):
            ids = list(self.id_of.values())
            own = self.encode_words([self.bytes_of[i] for i in ids])
            ids = np.array([i for i, o in zip(ids, own) if o == (i,)], np.int64)
            self.whole = frozenset(ids.tolist())
            h = np.array([_hash_bytes(self.bytes_of[i]) for i in ids], np.uint64) & np.uint64(0x7FFFFFFFFFFFFFFF)
            self.apart = len(np.unique(h)) == len(h)  # else one token would hide another
            self.size_of = np.array([len(b) for b in self.bytes_of])
            self.spelt = np.zeros((len(self.bytes_of), 64), np.uint8)
            for i in ids[self.size_of[ids] <= 64].tolist():
                self.spelt[i, : self.size_of[i]] = np.frombuffer(self.bytes_of[i], np.uint8)
            self._cand = _Table(h.astype(np.int64), ids)
        return self._cand

    def _joins(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a, b stay two tokens when their bytes are encoded together (a = -1: start of word).

        The latest merges on the two sides of the seam are undone one by one; if a pair that spans the seam
        could have merged earlier than the merge undone last, the two would not both stand.
        """
        ok = np.zeros(len(a), bool)
        ok[a < 0] = True
        live = np.flatnonzero(a >= 0)
        x, y = a[live].copy(), b[live].copy()
        limit = np.full(len(live), _NONE)
        strict = np.zeros(len(live), bool)  # the limit came from the left part: an equal rank further left wins
        while len(live):
            rank = self._pairs(x, y)
            bad = np.where(strict, rank < limit, rank <= limit) & (rank < _NONE)
            rx, ry = self.made_rank[x], self.made_rank[y]
            done = (rx < 0) & (ry < 0)
            ok[live[~bad & done]] = True
            go = ~bad & ~done
            live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
            takes_x = rx > ry
            # undoing the left part: its merge stood left of the seam pair, so only a lower rank beats it
            limit = np.where(takes_x, rx, ry)
            strict = takes_x
            x, y = np.where(takes_x, self.part_right[x], x), np.where(takes_x, y, self.part_left[y])
        return ok

    def prefix_counts(self, words: list[bytes]) -> list[bytes | list[int]]:
        """For each word the token count of each of its byte prefixes (entry i: the first i + 1 bytes).

        Prefix dynamic programming: the encoding of a prefix ends in the one token that joins the last token
        of what stands before it, so count[i] = count[i - len(token)] + 1.
        """
        out: list[bytes | list[int]] = [b""] * len(words)
        classes: dict[int, list[int]] = {}
        self._candidates()
        for i, w in enumerate(words):
            if len(w) > 64 or not self.apart:
                out[i] = self._prefix_long(w)
            elif len(w):
                classes.setdefault(8 if len(w) <= 8 else 16 if len(w) <= 16 else 64, []).append(i)
        for width, members in classes.items():
            for k in range(0, len(members), 16384):
                part = members[k : k + 16384]
                counts = self._prefix_class([words[j] for j in part], width)
                blob = counts.astype(np.uint8).tobytes()
                for row, i in enumerate(part):
                    out[i] = blob[row * width : row * width + len(words[i])]
        return out

    def _prefix_class(self, words: list[bytes], width: int) -> np.ndarray:
        known = self._candidates()
        n = len(words)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        length = np.array([len(w) for w in words])
        pre = np.zeros((n, width + 1), np.uint64)
        for i in range(width):
            pre[:, i + 1] = pre[:, i] * _BASE + raw[:, i].astype(np.uint64) + np.uint64(1)
        count = np.zeros((n, width + 1), np.int32)
        last = np.full((n, width + 1), -1, np.int64)
        last[:, 0] = -1
        for i in range(1, width + 1):
            todo = np.flatnonzero(length >= i)
            if not len(todo):
                break
            rows, toks, lens = [], [], []
            for size in range(1, min(i, self.longest) + 1):
                h = pre[todo, i] - pre[todo, i - size] * _POWERS[size]
                got = known.get((h & np.uint64(0x7FFFFFFFFFFFFFFF)).astype(np.int64))
                hit = np.flatnonzero(got >= 0)
                hit = hit[self.size_of[got[hit]] == size]
                hit = hit[(raw[todo[hit], i - size : i] == self.spelt[got[hit], :size]).all(1)]
                if len(hit):
                    rows.append(todo[hit])
                    toks.append(got[hit])
                    lens.append(np.full(len(hit), size))
            row, tok, size = np.concatenate(rows), np.concatenate(toks), np.concatenate(lens)
            prior = last[row, i - size]
            pair = ((prior + 1) << 20) | tok
            each, back = np.unique(pair, return_inverse=True)
            fits = self._joins((each >> 20) - 1, each & 0xFFFFF)[back]
            row, tok, size = row[fits], tok[fits], size[fits]
            last[row, i] = tok
            count[row, i] = count[row, i - size] + 1
        return count[:, 1:]

    def _prefix_long(self, word: bytes) -> list[int]:
        self._candidates()
        n = len(word)
        count, last = np.zeros(n + 1, np.int32), [-1] * (n + 1)
        known: dict[tuple[int, int], bool] = {}
        for i in range(1, n + 1):
            for size in range(min(i, self.longest), 0, -1):
                t = self.id_of.get(word[i - size : i])
                if t is None or t not in self.whole:
                    continue
                pair = (last[i - size], t)
                fits = known.get(pair)
                if fits is None:
                    fits = known[pair] = bool(self._joins(np.array([pair[0]]), np.array([t]))[0])
                if fits:
                    last[i], count[i] = t, count[i - size] + 1
                    break
        return count[1:].tolist()


_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([pow(int(_BASE), i, 1 << 64) for i in range(130)], np.uint64)


def _hash_bytes(b: bytes) -> int:
    h = 0
    for x in b:
        h = (h * int(_BASE) + x + 1) & 0xFFFFFFFFFFFFFFFF
    return h


class Codec:
    """A vocabulary with this process's bounded caches of words."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.ids: dict[str, tuple[int, ...]] = {}
        self.ids_old: dict[str, tuple[int, ...]] = {}
        self.prefix: dict[str, bytes | list[int]] = {}
        self.prefix_old: dict[str, bytes | list[int]] = {}
        self.held = {"ids": 0, "prefix": 0}  # bytes of the young words of each cache, about

    @classmethod
    def of(cls, path: str) -> "Codec":
        return resident(path, lambda: cls(path))

    def _cut(self, texts: list[str]) -> list[list[tuple[list[str], int | None]]]:
        """For each text its runs: (words, None), or ([special], id)."""
        v = self.v
        return [[([p], v.special[p]) if special else (v.words(p), None) for p, special in v.pieces(t)] for t in texts]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Token ids of each text, as encode(text, add_special_tokens=False) gives them."""
        runs = self._cut(texts)
        words = set().union(*(words for t in runs for words, s in t if s is None))
        new = self._missing(words, "ids")
        if new:
            self._keep("ids", new, self.v.encode_words([w.encode() for w in new]))
        get = self.ids.__getitem__
        return [[i for words, s in t for i in ([s] if s is not None else chain.from_iterable(map(get, words)))] for t in runs]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.v.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def _keep(self, cache: str, words: list[str], values: list) -> None:
        getattr(self, cache).update(zip(words, values))
        self.held[cache] += sum(map(len, words)) + _ENTRY * len(words) + _TOKEN * sum(map(len, values))

    def _missing(self, words: set[str], cache: str) -> list[str]:
        """Words of neither generation; those of the old one move to the young one, which ages when full."""
        young, old = getattr(self, cache), getattr(self, f"{cache}_old")
        if self.held[cache] > CACHE_BYTES:
            old.clear()
            old.update(young)
            young.clear()
            self.held[cache] = 0
        new = words - young.keys()
        if old and new:
            kept = list(new & old.keys())
            self._keep(cache, kept, [old[w] for w in kept])
            new.difference_update(kept)
        return list(new)

    def _prefix_words(self, words: set[str]) -> None:
        new = self._missing(words, "prefix")
        if new:
            self._keep("prefix", new, self.v.prefix_counts([w.encode() for w in new]))

    def tables(self, texts: list[str]) -> list["PrefixTable"]:
        runs = self._cut(texts)
        self._prefix_words(set().union(*(words for t in runs for words, s in t if s is None)))
        return [PrefixTable(self, t) for t in runs]


class PrefixTable:
    """Token counts of every prefix of one text, answered without encoding again."""

    def __init__(self, codec: Codec, runs: list[tuple[list[str], int | None]]):
        get = codec.prefix.__getitem__
        self.codec = codec
        self.runs = runs
        self.words = [w for words, _ in runs for w in words] if len(runs) != 1 else runs[0][0]
        if len(runs) == 1 and runs[0][1] is None:
            self.counts = [p[-1] for p in map(get, self.words)]
        else:
            self.counts = [c for words, s in runs for c in ([1] if s is not None else [p[-1] for p in map(get, words)])]
        self.n_tokens = sum(self.counts)

    def cut_at(self, budget: int) -> int:
        """Code points of the longest prefix made of whole pre-tokens whose token count is within budget."""
        if self.n_tokens <= budget:
            return sum(map(len, self.words))
        total = chars = 0
        for w, c in zip(self.words, self.counts):
            total += c
            if total > budget:
                break
            chars += len(w)
        return chars

    def count(self, chars: int) -> int:
        """Tokens of the first `chars` code points: stored counts up to the pre-token before the cut, then
        the stored prefix counts of the one or two pre-tokens that the cut touches."""
        if not hasattr(self, "_at"):
            self._at = list(accumulate(map(len, self.words), initial=0))
            self._sum = list(accumulate(self.counts, initial=0))
            self._run = [(k, s) for k, (words, s) in enumerate(self.runs) for _ in words]
        chars = max(0, min(chars, self._at[-1]))
        if chars == self._at[-1]:
            return self.n_tokens
        from bisect import bisect_right

        k = bisect_right(self._at, chars) - 1
        if self._at[k] == chars and not (k and self.words[k - 1].isspace()):
            return self._sum[k]
        c = self.codec
        first, run = k, self._run[k][0]
        if self._run[k][1] is None:
            while first and self._run[first - 1][0] == run and self.words[first - 1].isspace():
                first -= 1  # white space before the cut may be cut otherwise when the text ends there
        else:  # inside a special string, which is then ordinary text and joins the run before it
            while first and self._run[first - 1][0] == run - 1 and self._run[first - 1][1] is None:
                first -= 1
        tail = "".join(self.words[first : k + 1])[: chars - self._at[first]]
        words = c.v.words(tail)
        total = self._sum[first]
        for w in words:
            for whole in (first, k):
                p = c.prefix.get(self.words[whole]) if self._run[whole][1] is None else None
                if p is not None and self.words[whole].startswith(w):
                    total += p[len(w.encode()) - 1]
                    break
            else:
                c._prefix_words({w})
                total += c.prefix[w][-1]
        return total

    def dense(self) -> list[int]:
        """Token count of every code-point prefix, the empty one first."""
        return [self.count(i) for i in range(sum(map(len, self.words)) + 1)]
