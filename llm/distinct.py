"""Different byte strings of a batch and their CRC-32, as whole-array operations.

A long text is cut at separators into parts of bounded size, so memory follows the part and not the text. Words
meet by a 64-bit hash and are then compared byte by byte with the one that stands for them, so a collision of
hashes changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from llm import textscan as ts

#: A row longer than this comes in parts.
PART = 1 << 20
#: Longer strings are folded into rows of so many bytes.
WIDE = 64
_POLY = np.uint32(0xEDB88320)


def parts(column: pa.Array, separators: np.ndarray, more: int = 0, size: int = PART) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, offsets, own): runs of whole rows, or part of one long row.

    Parts are cut at separators. A part goes on for ``more`` words that belong to the next one; words that start at
    ``own`` or later are those.
    """
    for row, data, off in ts.pieces(column, size):
        n = len(data)
        if len(off) > 2 or n <= 2 * size:
            yield row, data, off, n
            continue
        at = 0
        while at < n:
            own = end = at + _gap(data[at:], size, separators)
            for _ in range(more):
                end += _word(data[end:], separators)
            yield row, data[at:end], np.array([0, end - at]), own - at
            at = own


def _first(mask_of: np.ndarray, data: np.ndarray, start: int) -> int:
    """The first place at ``start`` or later whose byte is marked, or the end."""
    step = 4096
    while start < len(data):
        hit = np.flatnonzero(mask_of[data[start : start + step]])
        if len(hit):
            return start + int(hit[0])
        start, step = start + step, step * 2
    return len(data)


def _gap(data: np.ndarray, size: int, separators: np.ndarray) -> int:
    return _first(separators, data, min(size, len(data)))


def _word(data: np.ndarray, separators: np.ndarray) -> int:
    """Bytes up to the end of the next word."""
    return _first(separators, data, _first(~separators, data, 0))


def by_length(length: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places) of each length that occurs."""
    order = np.argsort(length, kind="stable")
    cuts = np.flatnonzero(np.diff(length[order])) + 1
    for at in np.split(order, cuts) if len(order) else ():
        yield int(length[at[0]]), at


def _matrix(data: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """The bytes of equally long strings, one string a column."""
    return data[np.arange(length)[:, None] + start]


def distinct(data: np.ndarray, hashes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of one string of each kind, kind of each string)."""
    _, first, kind = np.unique(hashes, return_index=True, return_inverse=True)
    length = stop - start
    wrong = length != length[first[kind]]
    for n, at in by_length(length):
        for some in np.array_split(at, 1 + n * len(at) // ts.PIECE):
            some = some[~wrong[some]]
            wrong[some] = (_matrix(data, start[some], n) != _matrix(data, start[first[kind[some]]], n)).any(axis=0)
    others: dict[bytes, int] = {}
    places = []
    for i in np.flatnonzero(wrong):
        text = data[start[i] : stop[i]].tobytes()
        if text not in others:
            others[text] = len(first) + len(places)
            places.append(i)
        kind[i] = others[text]
    return np.append(first, np.array(places, first.dtype)), kind


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ ((t & np.uint32(1)) * _POLY)
    return t


_CRC = _table()


def _columns(rows: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """All registers after the bytes of ``rows``, one string a column of the array, byte by byte."""
    for byte in rows:
        crc = _CRC[(crc ^ byte) & np.uint32(255)] ^ (crc >> np.uint32(8))
    return crc


def _after(step: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """Registers after zero bytes; ``step`` has the image of each bit."""
    out = np.zeros_like(crc)
    for i in range(32):
        out ^= ((crc >> np.uint32(i)) & np.uint32(1)) * step[i]
    return out


def _long(text: np.ndarray) -> int:
    """The CRC-32 of one long string: rows of ``WIDE`` bytes at once, then neighbours joined until one is left.

    Inverting the first four bytes stands for the initial register, so zeros before them change nothing.
    """
    rows = np.zeros(-(-len(text) // WIDE) * WIDE, np.uint8)
    rows[len(rows) - len(text) :] = text
    head = len(rows) - len(text)
    rows[head : head + 4] ^= 255
    crc = _columns(np.ascontiguousarray(rows.reshape(-1, WIDE).T), np.zeros(len(rows) // WIDE, np.uint32))
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    step = _columns(np.zeros((WIDE, 32), np.uint8), bits)
    while len(crc) > 1:
        if len(crc) % 2:
            crc = np.append(np.uint32(0), crc)
        crc = _after(step, crc[::2]) ^ crc[1::2]
        step = _after(step, step)
    return int(~crc[0])


def crc32(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of each string ``data[start:stop]``.

    Strings of one length make one array of bytes whose registers go on together, column by
    column; results are scattered back.
    """
    out = np.zeros(len(start), np.uint32)
    for n, at in by_length(stop - start):
        if n > WIDE:
            out[at] = [_long(data[start[i] : stop[i]]) for i in at]
        else:
            for some in np.array_split(at, 1 + n * len(at) // ts.PIECE):
                out[some] = ~_columns(_matrix(data, start[some], n), np.full(len(some), 0xFFFFFFFF, np.uint32))
    return out
