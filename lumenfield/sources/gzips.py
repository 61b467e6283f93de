"""One gzip stream from pieces that were deflated apart, and a gzip file inflated piece by piece."""

from __future__ import annotations

import functools
import gzip
import struct
import zlib
from collections.abc import Iterator

from . import files

HEAD = b"\x1f\x8b\x08\0\0\0\0\0\0\xff"
AT_ONCE = 1 << 22


def piece(raw: bytes, level: int) -> bytes:
    """Deflated blocks up to the end of a byte, none of them the last of a stream."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    return packer.compress(raw) + packer.flush(zlib.Z_FULL_FLUSH)


def tail(crc: int, size: int) -> bytes:
    """The last block, which is empty, and the checksum."""
    return b"\x03\0" + struct.pack("<II", crc, size & 0xFFFFFFFF)


def _times(matrix: tuple[int, ...], v: int) -> int:
    out = 0
    for row in matrix:
        if not v:
            break
        if v & 1:
            out ^= row
        v >>= 1
    return out


@functools.lru_cache(1024)
def _behind(n: int) -> tuple[int, ...]:
    """What n zero bytes behind it make of a checksum, bit by bit."""
    out = tuple(1 << k for k in range(32))
    step = (0xEDB88320, *(1 << k for k in range(31)))  # one zero bit
    n *= 8
    while n:
        if n & 1:
            out = tuple(_times(step, v) for v in out)
        step = tuple(_times(step, v) for v in step)
        n >>= 1
    return out


def joined(crc: int, other: int, n: int) -> int:
    """The checksum of bytes with `crc` and the n bytes with `other` behind them."""
    return _times(_behind(n), crc) ^ other


def inflated(path: str) -> Iterator[bytes]:
    system, name = files.locate(path)
    with system.open_input_stream(name, compression=None) as f, gzip.GzipFile(fileobj=f) as z:
        while got := z.read(AT_ONCE):
            yield got
