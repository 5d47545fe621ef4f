"""Vectorised scanning of Arrow string columns.

The text operators share one idea: look at a column of texts as the one UTF-8
byte buffer Arrow already holds, find the words or lines in it with a few
numpy passes, and hash every one of them from a prefix sum.  No Python string
is made for a word.  Separators in all our word definitions are ASCII, and no
byte of a multi-byte UTF-8 character is ASCII, so working on bytes gives the
same words as working on code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text looked at together; bounds a task's memory (a longer single text is taken alone).
SLICE_BYTES = 1 << 19

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (in place): every output bit depends on every input bit."""
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


#: A random-looking odd number for each byte value.
_BYTE = _mix(np.arange(1, 257, dtype=_U64) * _U64(0x2545F4914F6CDD1D)) | _U64(1)

#: A second, 31-bit polynomial modulo a prime: modulo 2**64 alone there are known words with one hash under any base.
_PRIME = (1 << 31) - 1
_SMALL_BASE = 1_367_130_551
_SMALL_INVERSE = pow(_SMALL_BASE, -1, _PRIME)

#: Bytes whose sums are made at a time.
_BLOCK = 1 << 15

_cached: list[np.ndarray] = []


def _modular(base: int, size: int) -> np.ndarray:
    out, n = np.ones(size, dtype=_U64), 1
    while n < size:
        m = min(n, size - n)
        out[n : n + m] = out[:m] * _U64(pow(base, n, _PRIME)) % _U64(_PRIME)
        n += m
    return out


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, and of the small ones modulo the prime, up to ``n`` at least."""
    if not _cached or len(_cached[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        tables = []
        for base in (_BASE, _BASE_INVERSE):
            table = np.full(size, base, dtype=_U64)
            table[0] = 1
            tables.append(np.cumprod(table, dtype=_U64))
        _cached[:] = [*tables, _modular(_SMALL_BASE, size).astype(np.uint32), _modular(_SMALL_INVERSE, size).astype(np.uint32)]
    return _cached


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A lookup table that is true for the bytes in the given inclusive ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


class Texts:
    """Some rows of a string column: ``data`` and, with n + 1 entries, ``offsets``. A null is an empty text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if not pa.types.is_large_string(column.type):
            column = column.cast(pa.large_string())
        if column.null_count:
            column = column.fill_null("")
        n = len(column)
        if n == 0:
            return cls(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
        first, last = int(offsets[0]), int(offsets[-1])
        bytes_ = np.frombuffer(data, np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)
        return cls(bytes_, offsets - first)

    @classmethod
    def of_list(cls, texts: list[str | None]) -> Texts:
        return cls.of(pa.array(texts, pa.large_string()))

    def runs(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of true in ``mask``, none of which crosses texts, and where each text's runs begin (n + 1 entries)."""
        if not len(mask):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self) + 1, np.int64)
        begins, ends = mask.copy(), mask.copy()
        begins[1:] &= ~mask[:-1]
        ends[:-1] &= ~mask[1:]
        edges = self.offsets[:-1][np.diff(self.offsets) > 0]
        begins[edges] = mask[edges]
        ends[edges[1:] - 1] = mask[edges[1:] - 1]
        starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        return starts, stops, np.searchsorted(starts, self.offsets)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Two rows of sums, one for each polynomial; in blocks, so that what is between stays in the processor's cache."""
    powers, _, small, _ = _tables(len(data) + 1)
    sums = np.empty((2, len(data) + 1), dtype=_U64)
    sums[:, 0] = 0
    for at in range(0, len(data), _BLOCK):
        to = min(at + _BLOCK, len(data))
        byte = data[at:to].astype(np.intp)
        own = _BYTE[byte]
        own *= powers[at:to]
        own[:1] += sums[0, at : at + 1]
        np.cumsum(own, out=sums[0, at + 1 : to + 1])
        byte += 1  # 2**39 at most each, with the power
        own = byte.view(_U64)
        own *= small[at:to]
        own[:1] += sums[1, at : at + 1] % _U64(_PRIME)
        np.cumsum(own, out=sums[1, at + 1 : to + 1])
    return sums


def hashes(sums: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal bytes give equal hashes wherever they stand."""
    _, inverses, _, small = _tables(sums.shape[1])
    prime = _U64(_PRIME)
    out = (sums[0, stops] - sums[0, starts]) * inverses[starts]
    second = (sums[1, stops] + (prime - sums[1, starts] % prime)) % prime * small[starts] % prime
    out += (stops - starts).astype(_U64) * _U64(0xD6E8FEB86659FD93) + second * _U64(0xA0761D6478BD642F)
    return _mix(out)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = Texts.of(column).offsets
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, min(to, n)
        at = to
    release()


def _trimmer():
    import ctypes

    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda pad: 0


_trim = _trimmer()


def release() -> None:
    """Give memory that is free back to the system, so that a reused worker does not hold what an earlier stage needed."""
    pa.default_memory_pool().release_unused()
    _trim(0)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1, ... (``count`` of them) of each pair, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return first + np.arange(total)
