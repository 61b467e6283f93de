"""Lossless WebP from its public specification: a full decoder, and an encoder of prefix-coded literals."""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np

#: Fixed by the format: the order of code-length codes, and the near distances (x, y) of codes 1 to 120.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
NEAR = [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7)]
MAGIC = 0x2F


# ---- prefix codes ------------------------------------------------------------------------------------------
def _canonical(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), codes by length then symbol."""
    code, out = 0, {}
    for size in range(1, max(lengths, default=0) + 1):
        for s, n in enumerate(lengths):
            if n == size:
                out[s] = (code, size)
                code += 1
        code <<= 1
    return out


def _lengths(counts: np.ndarray, most: int = 15) -> list[int]:
    """Code lengths by frequency, none above `most`; a lone symbol gets a partner."""
    counts = counts.astype(np.int64).copy()
    if (counts > 0).sum() < 2:
        counts[[0, 1]] += 1
    while True:
        heap = [(int(c), i, (i,)) for i, c in enumerate(counts) if c]
        heapq.heapify(heap)
        size = [0] * len(counts)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for i in a[2] + b[2]:
                size[i] += 1
            heapq.heappush(heap, (a[0] + b[0], a[1], a[2] + b[2]))
        if max(size) <= most:
            return size
        counts = np.where(counts > 0, counts // 4 + 1, 0)


class _Bits:
    """Bits written lowest first."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []

    def put(self, value: int, n: int) -> None:
        self.parts.append(np.array([(value >> k) & 1 for k in range(n)], np.uint8))

    def codes(self, code: np.ndarray, size: np.ndarray) -> None:
        """Codes, highest bit first."""
        total = np.cumsum(size)
        nth = np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - size, size)
        self.parts.append(((np.repeat(code, size) >> (np.repeat(size, size) - 1 - nth)) & 1).astype(np.uint8))

    def bytes(self) -> bytes:
        return np.packbits(np.concatenate(self.parts), bitorder="little").tobytes()


#: Channels of RGBA in the order of the stream, with their alphabets.  Pixels of a block, which can be read by itself.
CHANNELS, BLOCK = ((1, 280), (0, 256), (2, 256), (3, 256)), 256
#: Pixels along a side at most.
MOST = 1 << 14


def counted(flat: np.ndarray) -> np.ndarray:
    """(4, 280): how often each symbol of each channel is in pixels (n, 4)."""
    return np.stack([np.bincount(flat[:, channel], minlength=280) for channel, _ in CHANNELS])


def code_lengths(counts: np.ndarray) -> list[list[int]]:
    return [_lengths(c[:alphabet]) for c, (_, alphabet) in zip(counts, CHANNELS)]


def _head(width: int, height: int, lengths: list[list[int]]) -> np.ndarray:
    """The bits before the first pixel."""
    if not 1 <= width <= MOST or not 1 <= height <= MOST:
        raise ValueError(f"an image of {width} x {height} pixels is too large for WebP")
    bits = _Bits()
    bits.put(MAGIC, 8)
    bits.put(width - 1, 14)
    bits.put(height - 1, 14)
    bits.put(1, 1)
    bits.put(0, 3)
    bits.put(0, 1)  # no transform
    bits.put(0, 1)  # no colour cache
    bits.put(0, 1)  # one group of codes
    for own_lengths in lengths:
        bits.put(0, 1)
        # lengths of code lengths: four bits each for 0..15
        bits.put(15, 4)
        for k in LENGTH_ORDER:
            bits.put(4 if k < 16 else 0, 3)
        bits.put(0, 1)
        own = _canonical([4] * 16)
        bits.codes(np.array([own[n][0] for n in own_lengths]), np.full(len(own_lengths), 4))
    bits.put(0b001, 3)  # distances: one symbol, of one bit
    bits.put(0, 1)
    return np.concatenate(bits.parts)


def pixels(flat: np.ndarray, lengths: list[list[int]]) -> tuple[bytes, int, np.ndarray]:
    """(bytes, bits, the bit at which each block starts) of pixels (n, 4)."""
    tables = []
    for own in lengths:
        table = np.zeros((len(own), 2), np.int64)
        for s, v in _canonical(own).items():
            table[s] = v
        tables.append(table)
    out, starts, total = _Bits(), [], 0
    for a in range(0, len(flat), 1 << 14):
        part = flat[a : a + (1 << 14)]
        both = np.stack([t[part[:, ch]] for (ch, _), t in zip(CHANNELS, tables)], 1).reshape(-1, 2)
        out.codes(both[:, 0], both[:, 1])
        ends = np.cumsum(both[:, 1])
        starts.append(total + np.r_[0, ends[3:-1:4]][::BLOCK])
        total += int(ends[-1])
    return (out.bytes() if out.parts else b""), total, np.concatenate(starts) if starts else np.zeros(0, np.int64)


def file(width: int, height: int, lengths: list[list[int]], parts: Iterable[tuple[bytes, int]], bits: int) -> Iterator[bytes]:
    """A WebP file, piece by piece, of parts (bytes, bits) that have `bits` bits in all."""
    head = _head(width, height, lengths)
    size = -(-(len(head) + bits) // 8)
    even = size + (size & 1)
    yield b"RIFF" + struct.pack("<I", even + 12) + b"WEBPVP8L" + struct.pack("<I", even)
    held, n = 0, 0  # the n bits of a byte that isn't full
    for raw, k in chain([(np.packbits(head, bitorder="little").tobytes(), len(head))], parts):
        out, held, n = _shifted(raw, k, held, n)
        yield out
    yield (bytes([held]) if n else b"") + b"\0" * (size & 1)


def _shifted(raw: bytes, bits: int, held: int, n: int) -> tuple[bytes, int, int]:
    """(full bytes, the bits left, their number) of n held bits and the bits of raw behind them."""
    b = np.frombuffer(raw, np.uint8)
    out = np.zeros(len(b) + 1, np.uint8)
    out[:-1] = b << n if n else b
    if n:
        out[1:] |= b >> (8 - n)
    out[0] |= held
    full, left = divmod(n + bits, 8)
    return out[:full].tobytes(), int(out[full]) if left else 0, left


def head_bits(width: int, height: int, lengths: list[list[int]]) -> int:
    return len(_head(width, height, lengths))


def encode(rgba: np.ndarray) -> bytes:
    """A WebP file of (height, width, 4) bytes."""
    return encode_blocks(rgba)[0]


def encode_blocks(rgba: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(a WebP file, the bit of the image at which each block starts) of (height, width, 4) bytes."""
    height, width = rgba.shape[:2]
    flat = rgba.reshape(-1, 4)
    lengths = code_lengths(counted(flat))
    raw, bits, starts = pixels(flat, lengths)
    return b"".join(file(width, height, lengths, [(raw, bits)], bits)), starts + head_bits(width, height, lengths)


#: Bytes of a file of one's own in which its codes end, and those before the image.
HEAD_BYTES, RIFF_BYTES = 1024, 20


def tables(head: bytes) -> np.ndarray:
    """(4, 32768): symbol and length << 16 for the next 15 bits of the stream, by the first bytes of a file of one's own."""
    r = _Reader(head[RIFF_BYTES:])
    r.bits(8 + 14 + 14 + 1 + 3 + 3)
    out = np.zeros((4, 1 << 15), np.int32)
    for k, (_, alphabet) in enumerate(CHANNELS):
        for (n, code), s in _read_code(r, alphabet).table.items():
            out[k, int(f"{code:0{n}b}"[::-1], 2) :: 1 << n] = s | n << 16
    return out


def blocks(raw: bytes, starts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Pixels (BLOCK * len(starts), 4) of blocks at bits of raw, all blocks at once; behind the last pixel they mean nothing."""
    b = np.frombuffer(raw + b"\0" * 4, np.uint8).astype(np.uint32)
    window = b[:-3] | b[1:-2] << 8 | b[2:-1] << 16
    at, last = starts.astype(np.int64), len(window) - 1
    out = np.empty((BLOCK, len(at), 4), np.uint8)
    for i in range(BLOCK):
        for (channel, _), code in zip(CHANNELS, codes):
            got = code[(window[np.minimum(at >> 3, last)] >> (at & 7).astype(np.uint32)) & 0x7FFF]
            out[i, :, channel] = got & 0xFF
            at = at + (got >> 16)
    return out.transpose(1, 0, 2).reshape(-1, 4)


# ---- decoding ----------------------------------------------------------------------------------------------
class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def bits(self, n: int) -> int:
        while self.n < n:
            piece = self.data[self.at : self.at + 8]
            self.held |= int.from_bytes(piece, "little") << self.n
            self.at += 8
            self.n += 64
            if self.at > len(self.data) + 64:
                raise ValueError("a WebP image cut short")
        out = self.held & ((1 << n) - 1)
        self.held >>= n
        self.n -= n
        return out


class _Code:
    """A prefix code as a dictionary of (length, code)."""

    def __init__(self, lengths: list[int]):
        used = [s for s, n in enumerate(lengths) if n]
        self.only = used[0] if len(used) == 1 else 0 if not used else None
        self.table = {(n, c): s for s, (c, n) in _canonical(lengths).items()}

    def read(self, r: _Reader) -> int:
        if self.only is not None:
            return self.only
        code = n = 0
        table = self.table
        while n < 16:
            code = code << 1 | r.bits(1)
            n += 1
            s = table.get((n, code))
            if s is not None:
                return s
        raise ValueError("a prefix code that is none")


def _read_code(r: _Reader, alphabet: int) -> _Code:
    lengths = [0] * alphabet
    if r.bits(1):
        two = r.bits(1)
        first = r.bits(8 if r.bits(1) else 1)
        lengths[first] = 1
        if two:
            lengths[r.bits(8)] = 1
        return _Code(lengths)
    own = [0] * 19
    for k in range(4 + r.bits(4)):
        own[LENGTH_ORDER[k]] = r.bits(3)
    most = 2 + r.bits(2 + 2 * r.bits(3)) if r.bits(1) else alphabet
    code, i, last = _Code(own), 0, 8
    while i < alphabet and most > 0:
        most -= 1
        s = code.read(r)
        if s < 16:
            lengths[i] = s
            i += 1
            last = s or last
        else:
            value = last if s == 16 else 0
            for _ in range(r.bits(2) + 3 if s == 16 else r.bits(3) + 3 if s == 17 else r.bits(7) + 11):
                if i < alphabet:
                    lengths[i] = value
                    i += 1
    return _Code(lengths)


def _extended(prefix: int, r: _Reader) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + r.bits(extra) + 1


def _image(r: _Reader, width: int, height: int, main: bool) -> list[int]:
    """ARGB pixels of an entropy-coded image."""
    cache_bits = r.bits(4) if r.bits(1) else 0
    cache = [0] * (1 << cache_bits) if cache_bits else []
    group_bits, groups = 0, [0]
    if main and r.bits(1):
        group_bits = r.bits(3) + 2
        wide = (width + (1 << group_bits) - 1) >> group_bits
        tall = (height + (1 << group_bits) - 1) >> group_bits
        groups = [(p >> 8) & 0xFFFF for p in _image(r, wide, tall, False)]
    codes = [[_read_code(r, n) for n in (280 + len(cache), 256, 256, 256, 40)] for _ in range(max(groups) + 1)]
    wide = (width + (1 << group_bits) - 1) >> group_bits if group_bits else 1
    out: list[int] = []
    total, cached = width * height, 0
    while len(out) < total:
        at = len(out)
        group = codes[groups[(at // width >> group_bits) * wide + (at % width >> group_bits)]] if group_bits else codes[0]
        s = group[0].read(r)
        if s < 256:
            red, blue, alpha = group[1].read(r), group[2].read(r), group[3].read(r)
            out.append(alpha << 24 | red << 16 | s << 8 | blue)
        elif s < 280:
            n = _extended(s - 256, r)
            d = _extended(group[4].read(r), r)
            if d > 120:
                d -= 120
            else:
                x, y = NEAR[d - 1]
                d = max(1, x + y * width)
            if d > at:
                raise ValueError("a distance before the image")
            for _ in range(min(n, total - at)):
                out.append(out[-d])
        else:
            while cached < at:
                p = out[cached]
                cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
                cached += 1
            out.append(cache[s - 280])
        if cache and s < 280:
            while cached < len(out):
                p = out[cached]
                cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
                cached += 1
    return out


def _add(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _mean(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _channels(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _joined(v) -> int:
    a, r, g, b = (min(max(x, 0), 255) for x in v)
    return a << 24 | r << 16 | g << 8 | b


def _predicted(mode: int, left: int, up: int, up_left: int, up_right: int) -> int:
    if mode == 0:
        return 0xFF000000
    if mode in (1, 2, 3, 4):
        return (left, up, up_right, up_left)[mode - 1]
    if mode == 5:
        return _mean(_mean(left, up_right), up)
    if mode == 6:
        return _mean(left, up_left)
    if mode == 7:
        return _mean(left, up)
    if mode == 8:
        return _mean(up_left, up)
    if mode == 9:
        return _mean(up, up_right)
    if mode == 10:
        return _mean(_mean(left, up_left), _mean(up, up_right))
    rows = list(zip(_channels(left), _channels(up), _channels(up_left)))
    if mode == 11:
        to_left = sum(abs(u - c) for _, u, c in rows)
        to_up = sum(abs(x - c) for x, _, c in rows)
        return left if to_left < to_up else up
    if mode == 12:
        return _joined(x + u - c for x, u, c in rows)
    middle = _channels(_mean(left, up))
    return _joined(m + int((m - c) / 2) for m, (_, _, c) in zip(middle, rows))


def _signed(v: int) -> int:
    return v - 256 if v > 127 else v


def decode(data: bytes) -> np.ndarray:
    """(height, width, 4) bytes of a lossless WebP file; ValueError for any other."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":
        if at + 8 > len(data) or data[at : at + 4] == b"VP8 ":
            raise ValueError("a WebP file that is not lossless")
        at += 8 + (struct.unpack_from("<I", data, at + 4)[0] + 1 & ~1)
    r = _Reader(data[at + 8 : at + 8 + struct.unpack_from("<I", data, at + 4)[0]])
    if r.bits(8) != MAGIC:
        raise ValueError("not a lossless WebP image")
    width, height = r.bits(14) + 1, r.bits(14) + 1
    r.bits(4)
    steps, wide = [], width
    while r.bits(1):
        kind = r.bits(2)
        if kind in (0, 1):
            size = r.bits(3) + 2
            across = (wide + (1 << size) - 1) >> size
            steps.append((kind, size, across, _image(r, across, (height + (1 << size) - 1) >> size, False)))
        elif kind == 2:
            steps.append((kind,))
        else:
            n = r.bits(8) + 1
            colours = _image(r, n, 1, False)
            for i in range(1, n):
                colours[i] = _add(colours[i], colours[i - 1])
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            steps.append((kind, pack, wide, colours))
            wide = (wide + (1 << pack) - 1) >> pack
    p = _image(r, wide, height, True)
    for step in reversed(steps):
        if step[0] == 2:
            p = [(x & 0xFF00FF00) | ((x & 0x00FF00FF) + ((x >> 8 & 255) * 0x00010001) & 0x00FF00FF) for x in p]
        elif step[0] == 0:
            _, size, across, modes = step
            for y in range(height):
                for x in range(wide):
                    i = y * wide + x
                    if not i:
                        guess = 0xFF000000
                    elif not y:
                        guess = p[i - 1]
                    elif not x:
                        guess = p[i - wide]
                    else:
                        guess = _predicted(modes[(y >> size) * across + (x >> size)] >> 8 & 15, p[i - 1], p[i - wide], p[i - wide - 1], p[i - wide + 1])
                    p[i] = _add(p[i], guess)
        elif step[0] == 1:
            _, size, across, rules = step
            for i, x in enumerate(p):
                rule = rules[(i // wide >> size) * across + (i % wide >> size)]
                a, red, green, blue = _channels(x)
                red = red + (_signed(rule & 255) * _signed(green) >> 5) & 255
                blue = blue + (_signed(rule >> 8 & 255) * _signed(green) >> 5) + (_signed(rule >> 16 & 255) * _signed(red) >> 5) & 255
                p[i] = a << 24 | red << 16 | green << 8 | blue
        else:
            _, pack, full, colours = step
            if pack:
                each, depth = 1 << pack, 8 >> pack
                p = [(p[y * wide + (x >> pack)] >> 8 & 255) >> (x & each - 1) * depth & (1 << depth) - 1 for y in range(height) for x in range(full)]
            else:
                p = [x >> 8 & 255 for x in p]
            p = [colours[x] if x < len(colours) else 0 for x in p]
            wide = full
    v = np.array(p, np.uint32).reshape(height, width)
    return np.stack([v >> 16 & 255, v >> 8 & 255, v & 255, v >> 24], 2).astype(np.uint8)
