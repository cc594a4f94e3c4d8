"""Words and word windows of many texts at once, hashed with numpy, and packed rows that carry hashes through a shuffle.

Word hashes are 64 bits: a sum of byte codes times powers of an odd number, then mixed; a window's hash is made the same
way from its words' hashes. A batch of texts is one byte buffer, so nothing here loops over words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Text that is handled at once, in bytes; a longer text is handled alone.
BATCH_BYTES = 8 << 20
_PIECE = 1 << 20
_U = np.uint64
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_CODES = np.random.Generator(np.random.PCG64(20)).integers(0, 2**64, 256, dtype=_U)
_FOLDED = _CODES.copy()
_FOLDED[65:91] = _CODES[97:123]
#: Whether a byte is white space between words.
_GAPS = np.zeros(256, bool)
_GAPS[[32, *range(9, 14)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def release() -> None:
    """Give freed memory back to the system: a worker that waits for its next task should hold little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(function: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``function``, with :func:`release` after each group."""

    def run(rows: pa.Table) -> pa.Table:
        out = function(rows)
        release()
        return out

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """Bits of ``x`` spread over all bits, one to one."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2^64, ``n`` of each at least."""
    found = _powers.get(base)
    if found is None or len(found[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, base, _U), np.full(size, pow(base, -1, 2**64), _U)
        up[0] = down[0] = 1
        found = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= 4 * _PIECE:
            _powers[base] = found
    return found


def _sums(values: np.ndarray, base: int) -> np.ndarray:
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * _power(base, len(values))[0][: len(values)], out=sums[1:])
    return sums


class Words:
    """The words of a batch: ``data`` (bytes), ``bounds`` (byte offsets of texts), and per word ``start``, ``end``, ``doc``
    and ``hash``; ``first`` has the number of words before each text."""

    def __init__(
        self, data: np.ndarray, bounds: np.ndarray, folded: bool = False, gaps: np.ndarray = _GAPS, cuts: np.ndarray | None = None
    ):
        """``folded``: hashes take A-Z for a-z. ``gaps`` tells bytes between words; ``cuts`` are bytes where a new word begins."""
        self.data, self.bounds = data, bounds
        inside = ~gaps[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = bounds[:-1][bounds[:-1] < bounds[1:]]
        first[edges] = inside[edges]
        edges = bounds[1:][bounds[:-1] < bounds[1:]] - 1
        last[edges] = inside[edges]
        if cuts is not None:
            first[cuts] = True
            last[cuts - 1] = True
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(bounds) - 1), self.count)
        codes, at = (_FOLDED if folded else _CODES), 0
        self.hash = np.empty(len(self.start), _U)
        while at < len(self.start):
            low = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.end, low + _PIECE, "right")))
            sums = _sums(codes[data[low : self.end[to - 1]]], _BYTE_BASE)
            a, b = self.start[at:to] - low, self.end[at:to] - low
            self.hash[at:to] = mix((sums[b] - sums[a]) * _power(_BYTE_BASE, len(sums))[1][a] + (b - a).astype(_U))
            at = to

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of ``length`` words within one text, and the windows' hashes."""
        n = len(self.hash) - length + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, _U)
        at = np.flatnonzero(self.doc[:n] == self.doc[length - 1 :])
        sums = _sums(self.hash, _WORD_BASE)
        return at, mix((sums[at + length] - sums[at]) * _power(_WORD_BASE, n)[1][at] + _U(length))


def batches(
    rows: Iterator[pa.RecordBatch], text: str = "text", size: int = BATCH_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Record batches cut to about ``size`` bytes of text, with the bytes and offsets of the texts; null is empty."""
    for batch in rows:
        texts = batch.column(text).cast(pa.large_binary()).fill_null(b"")
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
        low = 0
        while low < len(batch):
            high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + size, "right")) - 1)
            high = min(high, len(batch))
            own = bounds[low : high + 1]
            yield batch.slice(low, high - low), data[own[0] : own[-1]], own - own[0]
            low = high
    release()


def cut(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary array whose rows are the slices of ``values`` between ``bounds``."""
    offsets = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]
    )


def joined(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    """What :func:`cut` made of several rows, in one array."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of the sorted ``keys`` begins, and their length at the end."""
    n = len(keys[0])
    fresh = np.ones(n, bool)
    if n:
        fresh[1:] = False
        for k in keys:
            fresh[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(fresh), n)
