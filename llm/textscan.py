"""Vectorised byte, word and shingle scans over Arrow string columns.

Helpers for tasks: they take the buffers of one Arrow batch and return numpy
arrays, without a Python loop over rows, words or bytes. A word is a maximal run
of bytes outside a separator set; hashes are 64-bit polynomial hashes over a
random byte table, finished by a mixing step, so equal words have equal hashes
in every task and every run.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _LIBC = None
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_TABLE = np.random.Generator(np.random.PCG64(20240611)).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)

#: Bytes between words: space and the five ASCII white-space controls.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: As WHITE, with ASCII punctuation and controls also counted as separators.
NON_WORD = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])
#: ASCII lower-casing, byte for byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: A batch is scanned in pieces of about this many bytes, which bounds memory.
PIECE = 1 << 20
_STRIP = 1 << 15


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher."""
    x = (x ^ (x >> U64(30))) * _MIX1
    x = (x ^ (x >> U64(27))) * _MIX2
    return x ^ (x >> U64(31))


def _powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    out[1:] = base
    return np.multiply.accumulate(out)


_POW = _powers(1 << 16)
_INV_BASE = U64(pow(int(_BASE), -1, 2**64))


class _Powers:
    """Powers of the base and of its inverse, grown as needed."""

    up = _POW
    down = _powers(1 << 16, _INV_BASE)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(n), _powers(n, _INV_BASE)
        return cls.up, cls.down


def _running(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Running sums of the bytes' numbers times the powers of the base, made strip by strip, so that what is worked on stays in the cache."""
    n = len(data)
    up, sums = _Powers.of(n + 1)[0], np.zeros(n + 1, np.uint64)
    for lo in range(0, n, _STRIP):
        strip = table.take(data[lo : lo + _STRIP])
        strip *= up[lo : lo + len(strip)]
        strip[:1] += sums[lo : lo + 1]
        np.cumsum(strip, out=sums[lo + 1 : lo + 1 + len(strip)])
    return sums


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of whole rows of about ``size`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string()) if column.null_count else column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + size, "right")) - 1)
        yield row, raw[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end
    release()


def release() -> None:
    """Gives freed memory back to the system; workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


class Words:
    """The words of some rows: ``hash``, ``start`` and ``stop`` (bytes), ``row``, and ``first`` (offsets of rows in words)."""

    __slots__ = ("hash", "start", "stop", "row", "first")

    def __init__(self, data: np.ndarray, off: np.ndarray, *, separators: np.ndarray = WHITE, lower: bool = True) -> None:
        n = len(data)
        inside = np.empty(n + 2, bool)
        inside[0] = inside[-1] = False
        np.logical_not(separators.take(data), out=inside[1:-1])
        begins = inside[1:] & ~inside[:-1]
        ends = inside[:-1] & ~inside[1:]
        cuts = off[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        both = cuts[inside[cuts] & inside[cuts + 1]]  # a row ends and the next begins inside a run
        begins[both] = True
        ends[both] = True
        self.start = np.flatnonzero(begins)
        self.stop = np.flatnonzero(ends)
        down = _Powers.of(n + 1)[1]
        sums = _running(_TABLE[LOWER] if lower else _TABLE, data)
        self.hash = mix((sums[self.stop] - sums[self.start]) * down[self.start])
        self.first = np.searchsorted(self.start, off).astype(np.int64)
        self.row = np.repeat(np.arange(len(off) - 1), np.diff(self.first))


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of ``size`` words in a row; a shorter row gives its whole sequence, an empty one nothing."""
    w = words.hash
    n = len(w)
    counts = np.diff(words.first)
    hashes, row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n >= size:
        acc = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            acc = acc * _BASE + w[k : n - size + 1 + k]
        ok = words.row[: n - size + 1] == words.row[size - 1 :]
        hashes, row = mix(acc[ok]), words.row[: n - size + 1][ok]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            more = counts[short] > k
            at = np.minimum(words.first[short] + k, n - 1)
            extra = np.where(more, extra * _BASE + w[at], extra)
        extra = mix(extra + counts[short].astype(np.uint64))
        hashes, row = np.concatenate([hashes, extra]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        hashes, row = hashes[order], row[order]
    return hashes, row


def distinct_by_row(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (row, hash) once, sorted by row and hash."""
    if not len(hashes):
        return hashes, row
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], r[new]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running sums from which :func:`span_hashes` takes the hash of any byte span."""
    return _running(_TABLE, data)


def span_hashes(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return mix((sums[stop] - sums[start]) * _Powers.of(len(sums))[1][start])


def list_offsets(row: np.ndarray, rows: int) -> np.ndarray:
    """Arrow list offsets for values sorted by row."""
    out = np.zeros(rows + 1, np.int32)
    np.cumsum(np.bincount(row, minlength=rows), out=out[1:])
    return out
