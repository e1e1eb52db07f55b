"""Language-model scoring by online logistic context mixing (operator 8).

A text is coded token by token (lower-cased words, then one end), and each token byte by byte
in the binary decisions of a Huffman tree over bytes. For every decision several predictors
look up, in tables hashed by context and node, how often it went either way: after the last
one to four bytes of the word, and after the whole word so far, some of them also by the class
of the text (a cluster of its last two very frequent words, which tells language and style).
Their log odds are added with weights that a gate selects by place and by how much
the longer contexts have seen, and a last stage refines the sum by what such sums turned out
to mean after the same byte.

Learning is online: texts are dealt to parts by a hash of key and text, so many parts as their bytes give, and a
part's texts are gone through once in the order of the hash, in growing blocks. The different
words of a block are predicted, some at a time, from what the task has seen before; weights and
refinement are corrected by the errors (by steps that allow for the predictors' agreeing), each as often as the word comes (once where its
beginning is new to the task), and the counts updated. Words that begin alike share the decisions of their beginning,
which are made once for all of them. Counts and refinement of all tasks are
added up by Spark, weights are averaged by the curvature that they have seen.

Long contexts are kept for the whole corpus. After some ``EVERY``-th of all runs of ``RUN`` words (chosen
by their hash, and after the first ones of a text) the stretch up to the next such run is
looked up in a Spark table of all stretches that followed that run in the training texts. One more
binary decision tells whether the most frequent of them comes next; if so, it stands for
the whole stretch. Its probability is that of its kind of case (how often and how surely
the stretch has been seen, and whether the last such prediction of the text came true), counted over all training
texts. This table grows with the corpus and is joined by the run's hash. A training text
is predicted by the other training texts: its own stretches are taken from the counts.

The base score's word counts are exact for all words: frequent words are looked up in the
task, all others are joined with the counted words.

Null and empty texts are one end; very long texts are coded whole; ids may be null (then
training) or repeat (each row is counted and scored; rows alike in id and text are one text
to the table of stretches); with no training text every
probability is that of empty counts; empty tables give empty results; further columns are
not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, partial
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm import textscan as ts
from llm.keys import add_key, written
from llm.toxicity import held_out

#: So many words have their counts for the base score in each task.
VOCABULARY = 1 << 17
#: So many of the most frequent words tell words apart by what came before.
FREQUENT = 24
CLUSTERS = 12
#: Words by which the clusters are told apart.
_TELLING = 256
#: Words of a context of the table of stretches, and one in how many contexts has a row there.
RUN, EVERY = 4, 32
#: Slots of the predictors: last byte by class, two bytes, three by class, four, word so far, word so far by class.
SLOTS = (1 << 18, 1 << 18, 1 << 20, 1 << 20, 1 << 22, 1 << 22)
_PRIOR = (0.4, 0.4, 0.3, 0.3, 0.15, 0.15)
#: Bytes of training text to a task, at least; each task sends its tables.
TASK_BYTES = 64 << 20
#: Slots whose counts are sent as one row.
ROW_SLOTS = 1 << 12
#: Symbols between two corrections of weights and counts, at most; smaller blocks have 2 corrections.
BATCH = 160 << 10
#: Bytes of text that are parsed, and the largest block that is worked through at a time.
_PIECE, _BLOCK = 1 << 20, 16 << 20
#: Different words that a task gathers before it sends them, and symbols and words that it works through at a time.
_HELD, _CHUNK, _WORDS = 1 << 20, 1 << 14, 1 << 15
#: Ranges of keys whose pairs of class and word are made different at a time.
_RANGES = 16
#: Words that begin with the same so many bytes are worked through together.
_ALIKE = 3
_END_HASH = ts.mix(np.array([0x5E4D], np.uint64))[0]
_OTHER = 0  # no telling word
_BEGIN = np.uint64(64 - 18)
_STOP, _END, _SYMBOLS = 256, 257, 258  # the end of a word, and of a text
_LIMIT = 8.0
_GATES, _SUMS = 192, 33
_UNIT = 256.0  # of the log odds in a table
_SALTS = [ts.mix(np.array([0xA11CE + k], np.uint64))[0] for k in range(len(SLOTS))]


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, nodes, bits) of each symbol's path; node 0 is the root."""
    n = len(counts)
    heap = [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, bit = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int8)
    top = n
    while len(heap) > 1:
        a, i = heapq.heappop(heap)
        b, j = heapq.heappop(heap)
        parent[i] = parent[j] = top
        bit[j] = 1
        heapq.heappush(heap, (a + b, top))
        top += 1
    root = top - 1
    steps = []
    at, who = np.arange(n), np.arange(n)
    while len(at):
        keep = at != root
        at, who = at[keep], who[keep]
        if len(at):
            steps.append((who, root - parent[at], bit[at]))
            at = parent[at]
    if not steps:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8)
    who, node, bits = (np.concatenate(x) for x in zip(*steps, strict=True))
    level = np.concatenate([np.full(len(s[0]), -k) for k, s in enumerate(steps)])
    order = np.lexsort((level, who))
    return np.concatenate([[0], np.cumsum(np.bincount(who, minlength=n))]), node[order].astype(np.int32), bits[order]


@dataclass
class Spelled:
    """Words as symbols, with the hashed contexts of each."""

    symbol: np.ndarray
    contexts: list[np.ndarray]
    place: np.ndarray
    last: np.ndarray  # byte before + 1, or 0
    word: np.ndarray

    def part(self, s: slice | np.ndarray) -> Spelled:
        return Spelled(self.symbol[s], [c[s] for c in self.contexts], self.place[s], self.last[s], self.word[s])

    def once(self) -> tuple[Spelled, np.ndarray]:
        """Each symbol after each beginning of a word in its class, once, and which of them each symbol is: words that begin alike share decisions."""
        one, back = _once(self.contexts[-1], self.symbol)
        return self.part(one), back


def _once(context: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each symbol stands first in each context, and which of them each symbol is."""
    _, first, back, _ = _unique(context ^ (symbol.astype(np.uint64) * ts._BASE))
    one = np.zeros(len(symbol), bool)
    one[first] = True
    return np.flatnonzero(one), (np.cumsum(one) - 1)[first][back]


@dataclass
class Letters:
    """Words as symbols, before the contexts of each are hashed."""

    symbol: np.ndarray
    before: list[np.ndarray]  # the last four bytes + 1, or 0
    so_far: np.ndarray  # hash of the word up to here
    klass: np.ndarray
    place: np.ndarray
    word: np.ndarray

    def part(self, s: slice | np.ndarray) -> Letters:
        return Letters(self.symbol[s], [b[s] for b in self.before], self.so_far[s], self.klass[s], self.place[s], self.word[s])

    def context(self, k: int) -> np.ndarray:
        """What predictor ``k`` goes by, hashed."""
        if k == 4:
            return ts.mix(self.so_far + _SALTS[4])
        klass = self.klass.astype(np.int64)
        if k == 5:
            return ts.mix(self.so_far + ts.mix(np.arange(256, dtype=np.uint64) + _SALTS[5])[klass])
        before = self.before
        if k == 0:
            plain = before[0] * np.int64(32) + klass
        else:
            plain = before[0] * np.int64(258) + before[1]
            if k > 1:
                plain = plain * 258 + before[2]
                plain = plain * 32 + klass if k == 2 else plain * 258 + before[3]
        return ts.mix(plain.astype(np.uint64) + _SALTS[k])

    def spelled(self) -> Spelled:
        return Spelled(self.symbol, [self.context(k) for k in range(len(SLOTS))], self.place, self.before[0], self.word)

    def once(self) -> tuple[Spelled, np.ndarray]:
        """As that of the spelled words; only the contexts of different symbols are hashed."""
        one, back = _once(self.context(5), self.symbol)
        return self.part(one).spelled(), back


def spell(data: np.ndarray, start: np.ndarray, stop: np.ndarray, klass: np.ndarray) -> Spelled:
    """The spellings of some words, lower-cased; an empty word is the end of a text."""
    return letters(data, start, stop, klass).spelled()


def letters(data: np.ndarray, start: np.ndarray, stop: np.ndarray, klass: np.ndarray) -> Letters:
    """As :func:`spell`, without the contexts."""
    size = stop - start + 1
    ends = np.cumsum(size)
    first = ends - size
    n = int(ends[-1]) if len(ends) else 0
    word = np.repeat(np.arange(len(size)), size)
    place = np.arange(n) - np.repeat(first, size)
    at = np.repeat(start, size) + place
    inside = place < np.repeat(size - 1, size)
    symbol = np.full(n, _STOP, np.int16)
    symbol[inside] = ts.LOWER[data[at[inside]]]
    symbol[first[size == 1]] = _END
    before = []
    for k in range(1, 5):
        c = np.zeros(n, np.int16)
        if n > k:
            np.multiply(symbol[:-k] + np.int16(1), place[k:] >= k, out=c[k:])
        before.append(c)
    sums = ts.prefix_hashes(symbol.astype(np.uint8))
    so_far = sums[:-1] - np.repeat(sums[first], size)
    so_far *= np.repeat(ts._Powers.of(n + 1)[1][first], size)
    so_far += place.view(np.uint64)
    return Letters(symbol, before, so_far, np.repeat(klass.astype(np.int8), size), place.astype(np.int32), word.astype(np.int32))


def _sure(n: np.ndarray) -> np.ndarray:
    """How much a context has seen, from 0 to 3."""
    return ((n > 0).view(np.int8) + (n > 2) + (n > 15)).astype(np.int64)


@dataclass
class Mixer:
    """The byte tree, its tables of log odds, weights and refinement."""

    off: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray
    slots: tuple[int, ...] = SLOTS
    codes: list[np.ndarray] = field(default_factory=list)  # log odds in units, times 4, and how much was seen
    weights: np.ndarray | None = None
    sums: np.ndarray | None = None

    @cached_property
    def hashed(self) -> np.ndarray:
        """A hash of each step's node."""
        return ts.mix(self.nodes.astype(np.uint64) + np.uint64(1))

    def decisions(self, s: Spelled) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(owner, bit, slot of each predictor) of all decisions."""
        size = self.off[s.symbol + 1] - self.off[s.symbol]
        ends = np.cumsum(size)
        owner = np.repeat(np.arange(len(s.symbol)), size)
        at = np.repeat(self.off[s.symbol] - (ends - size), size) + np.arange(len(owner))
        node, slots = self.hashed[at], []
        for c, n in zip(s.contexts, self.slots, strict=True):
            slot = c.take(owner)
            slot ^= node
            slot *= np.uint64(0x165667B19E3779F9)
            slot >>= np.uint64(65 - n.bit_length())
            slots.append(slot.view(np.int64))
        return owner, self.bits[at], slots

    def gate(self, place: np.ndarray, sure: list[np.ndarray]) -> np.ndarray:
        return np.minimum((place + 1) >> 1, 2) * 64 + sure[-3] * 16 + sure[-2] * 4 + sure[-1]

    @property
    def width(self) -> int:
        return len(self.slots) + 1

    @cached_property
    def meant(self) -> np.ndarray:
        """What a sum turned out to mean after each byte; a sum is taken at its word where it has been seen little."""
        grid = np.linspace(-_LIMIT, _LIMIT, _SUMS)
        p = 1 / (1 + np.exp(-grid))
        zero, one = self.sums
        return np.log((one + 20 * p) / (zero + 20 * (1 - p))).astype(np.float32).ravel()

    def refine(self, mixed: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Log odds after the last stage."""
        z = (mixed.clip(-_LIMIT, _LIMIT) + _LIMIT) * ((_SUMS - 1) / (2 * _LIMIT))
        low = np.minimum(z.astype(np.int64), _SUMS - 2)
        f = z - low
        low += last * _SUMS
        return 0.5 * mixed + 0.5 * ((1 - f) * self.meant[low] + f * self.meant[low + 1])

    def log2(self, s: Spelled) -> np.ndarray:
        """log2 probability of each symbol."""
        out = [np.zeros(0)]
        for lo in range(0, len(s.symbol), _CHUNK):
            part = s.part(slice(lo, lo + _CHUNK))
            owner, bit, slots = self.decisions(part)
            x = np.empty((self.width, len(bit)), np.float32)
            sure = []
            for k, (slot, code) in enumerate(zip(slots, self.codes, strict=True)):
                c = code[slot]
                x[k] = c >> 2
                if k >= self.width - 4:
                    sure.append((c & 3).astype(np.int64))
            x[:-1] *= 1 / _UNIT
            x[-1] = 0.3
            gate = self.gate(part.place[owner], sure)
            mixed = np.einsum("kj,kj->j", x, self.wide.take(gate, axis=1))
            z = np.clip(self.refine(mixed, part.last[owner]), -60, 60)
            out.append(np.bincount(owner, weights=-np.log(1 + np.exp(np.where(bit > 0, -z, z))), minlength=len(part.symbol)) / np.log(2))
        return np.concatenate(out)

    @cached_property
    def wide(self) -> np.ndarray:
        return np.ascontiguousarray(self.weights.T.astype(np.float32))


def first_weights(k: int) -> np.ndarray:
    """Weights before any text: the more the word so far has been seen, the more it counts."""
    sure = np.arange(_GATES) // 4 % 4 / 3
    w = np.zeros((_GATES, k + 1))
    w[:, : k - 2] = (1.2 * (1 - sure) / k)[:, None]
    w[:, k - 2 : k] = (1.2 / k + 0.3 * sure)[:, None]
    return w


class Learner:
    """Counts, weights and refinement that a task learns online."""

    def __init__(self, mixer: Mixer) -> None:
        self.mixer = mixer
        k = mixer.width - 1
        self.counts = [np.zeros(2 * n, np.uint32) for n in mixer.slots]
        self.total = 0  # no count is larger
        self.w = first_weights(k)
        self.h = np.full((_GATES, mixer.width), 50.0)
        self.sums = np.zeros((2, _SYMBOLS * _SUMS))

    def learn(self, s: Spelled | Letters, times: np.ndarray) -> None:
        """Goes through symbols that come ``times`` each."""
        m = self.mixer
        step = min(max(len(s.symbol) // 2, 64), BATCH)
        for lo in range(0, len(s.symbol), step):
            cut = slice(lo, lo + step)
            part, back = s.part(cut).once()
            words = np.bincount(back, minlength=len(part.symbol))
            often = np.bincount(back, weights=times[cut], minlength=len(part.symbol)).astype(np.uint32)
            w, up, curved, seen = np.ascontiguousarray(self.w.T, np.float32), np.zeros_like(self.w), np.zeros_like(self.h), []
            for at in range(0, len(part.symbol), _CHUNK):
                few = slice(at, at + _CHUNK)
                seen.append(self._errors(part.part(few), often[few], words[few], w, up, curved))
            self.h += curved
            self.w += up / self.h
            # all symbols are predicted from what came before them, so the counts follow
            for places, much in seen:
                for place, counts in zip(places, self.counts, strict=True):
                    np.add.at(counts, place.astype(np.int64), much)
            del part, back, seen  # before the next ones are made
        self.total += int(times.sum())

    def _errors(self, s: Spelled, often: np.ndarray, words: np.ndarray, w: np.ndarray, up: np.ndarray, curved: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Adds the errors and curvature of some symbols' predictions; (place of each decision in each table, how often it comes)."""
        m = self.mixer
        owner, y, slots = m.decisions(s)
        x = np.empty((m.width, len(y)), np.float32)
        sure = []
        for k, (slot, counts) in enumerate(zip(slots, self.counts, strict=True)):
            both = counts.view(np.uint64).take(slot).view(np.uint32)
            if k >= m.width - 4:
                sure.append(_sure(both[::2] + both[1::2]))
            both = both.astype(np.float32)
            both += np.float32(_PRIOR[k])
            np.divide(both[1::2], both[::2], out=x[k])
        np.log(x[:-1], out=x[:-1])
        much = often[owner]
        learned = np.where(sure[-2] > 0, much, words[owner]).astype(np.float32)
        x[-1] = 0.3
        np.clip(x, -12, 12, out=x)
        # those of a gate stand together, so its sums are sums of runs
        gate = m.gate(s.place, [np.zeros(1, np.int64)] * 3).astype(np.uint8).take(owner) + (sure[-3] * 16 + sure[-2] * 4 + sure[-1]).astype(np.uint8)
        order = np.argsort(gate, kind="stable")
        n = np.bincount(gate, minlength=_GATES)
        gates = np.flatnonzero(n)
        n = n[gates]
        runs = np.cumsum(n) - n
        mixed, size, row = np.zeros(len(y), np.float32), np.full(len(y), 0.3, np.float32), np.empty(len(y), np.float32)
        for k in range(m.width - 1):
            x[k].take(order, out=row, mode="clip")
            x[k] = row
            size += np.abs(row)
            mixed += np.multiply(row, np.repeat(w[k, gates], n), out=row)
        mixed += np.repeat(w[-1, gates] * np.float32(0.3), n)
        bit, learned = y.take(order), learned.take(order)
        p = 1 / (1 + np.exp(-mixed.clip(-20, 20)))
        # predictors mostly agree and are corrected together, so the step of each allows for those of the others; else weights overshoot and grow
        error, curve = (bit - p) * learned, p * (1 - p) * learned * size
        for k in range(m.width):
            up[gates, k] += np.add.reduceat(np.multiply(error, x[k], out=row), runs)
            curved[gates, k] += np.add.reduceat(np.multiply(curve, np.abs(x[k]), out=row), runs)
        at = ((mixed.clip(-_LIMIT, _LIMIT) + _LIMIT) * ((_SUMS - 1) / (2 * _LIMIT)) + 0.5).astype(np.int64)
        at += (s.last * np.int64(_SUMS)).take(owner).take(order)
        at += bit * np.int64(_SYMBOLS * _SUMS)
        self.sums += np.bincount(at, weights=learned, minlength=2 * _SYMBOLS * _SUMS).reshape(2, -1)
        return [(2 * slot + y).astype(np.int32) for slot in slots], much  # held until the batch ends

    def sent(self) -> Iterator[pa.RecordBatch]:
        """Rows (block, body) of all counts, packed, which then begin again."""
        block = 0
        for counts in self.counts:
            rows = counts.reshape(-1, min(len(counts), 2 * ROW_SLOTS))
            used = np.flatnonzero(rows.any(axis=1))
            for lo in range(0, len(used), 256):
                u = used[lo : lo + 256]
                yield pa.record_batch([pa.array((block + u).astype(np.int32)), pa.array([zlib.compress(rows[i].tobytes(), 1) for i in u], pa.binary())], names=["block", "body"])
            block += len(rows)
            counts[:] = 0
        self.total = 0

    def weighed(self) -> pa.RecordBatch:
        """One row of the weights, by the curvature seen, and the refinement."""
        h = self.h - 50.0
        value = np.concatenate([(self.w * h).ravel(), h.ravel(), self.sums.ravel()])
        return pa.record_batch([pa.array([-1], pa.int32()), pa.array([zlib.compress(value.tobytes(), 1)], pa.binary())], names=["block", "body"])


def add_up(batches: Iterable[pa.RecordBatch], slots: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """From rows of all tasks, sorted by block: (block, body), the entries of the tables, and the sums of the weights for block -1."""
    first = np.cumsum([0, *(n // min(n, ROW_SLOTS) for n in slots)])
    now, total = None, np.zeros(0)

    def done() -> pa.RecordBatch:
        body = total if now < 0 else codes(*total.reshape(-1, 2).T, int(np.searchsorted(first, now, "right")) - 1)
        return pa.record_batch([pa.array([now], pa.int32()), pa.array([body.tobytes()], pa.binary())], names=["block", "body"])

    for batch in batches:
        for block, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            more = np.frombuffer(zlib.decompress(body.as_py()), np.float64 if block < 0 else np.uint32)
            if block != now:
                if now is not None:
                    yield done()
                now, total = block, np.zeros(len(more))
            total += more
    if now is not None:
        yield done()


def codes(zero: np.ndarray, one: np.ndarray, k: int) -> np.ndarray:
    """The entries of table ``k`` for some counts."""
    odds = np.log((one + _PRIOR[k]) / (zero + _PRIOR[k])).clip(-12, 12)
    return (np.rint(odds * _UNIT).astype(np.int16) << 2) | _sure(zero + one).astype(np.int16)


@dataclass
class Model:
    telling: np.ndarray  # hashes of the most frequent words, sorted
    number: np.ndarray  # of each, from 1
    hashes: np.ndarray  # of the words with counts, sorted, and the end
    counts: np.ndarray  # training tokens of each
    mixer: Mixer
    tokens: int
    distinct: int
    clusters: np.ndarray  # of each pair of very frequent words; 0 for none
    bits: np.ndarray | None = None

    def symbols(self, h: np.ndarray) -> np.ndarray:
        """The number of each telling word, 0 for others."""
        if self.bits is None:
            self.bits = np.zeros(1 << 16, bool)
            self.bits[self.telling & np.uint64((1 << 16) - 1)] = True
        out = np.full(len(h), _OTHER, np.int64)
        maybe = np.flatnonzero(self.bits[h & np.uint64((1 << 16) - 1)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.telling, h[maybe]), len(self.telling) - 1)
            ok = self.telling[at] == h[maybe]
            out[maybe[ok]] = self.number[at[ok]]
        return out

    def counted(self, h: np.ndarray) -> np.ndarray:
        """Training tokens of the words that have counts here; -1 for others."""
        out = np.full(len(h), -1, np.int64)
        begin = (h >> _BEGIN).view(np.int64)
        at, end = self.begins.take(begin), self.begins.take(begin + 1)
        left = np.flatnonzero(at < end)
        while len(left):
            same = self.hashes[at[left]] == h[left]
            out[left[same]] = self.counts[at[left[same]]]
            left = left[~same]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out

    @cached_property
    def begins(self) -> np.ndarray:
        """Where the hashes with each beginning begin."""
        return np.searchsorted(self.hashes >> _BEGIN, np.arange((1 << 18) + 1, dtype=np.uint64))


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start, stop) of the words of each row and its end."""
    w = ts.Words(data, off)
    rows = len(off) - 1
    ends = w.first[1:] + np.arange(rows)
    word = np.ones(len(w.hash) + rows, bool)
    word[ends] = False
    out = []
    for own, end in ((w.hash, _END_HASH), (w.row, np.arange(rows)), (w.start, 0), (w.stop, 0)):
        both = np.empty(len(word), own.dtype)
        both[word] = own
        both[ends] = end
        out.append(both)
    return tuple(out)


def context_classes(symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The last two very frequent words before each word of a row, as one number."""
    n = len(symbol)
    own = np.where((symbol > _OTHER) & (symbol <= _OTHER + FREQUENT), symbol - _OTHER, 0)
    at = np.maximum.accumulate(np.where(own > 0, np.arange(n), -1)) if n else np.zeros(0, np.int64)
    last = np.concatenate([[-1], at[:-1]]) if n else at
    valid = (last >= 0) & (row[last] == row)
    again = np.where(valid, last[last], -1)
    valid2 = (again >= 0) & (row[again] == row)
    return np.where(valid, own[last], 0) * (FREQUENT + 1) + np.where(valid2, own[again], 0)


def clusters_of(klass: np.ndarray, symbol: np.ndarray, n: np.ndarray, k: int = CLUSTERS) -> np.ndarray:
    """A cluster from 1 to ``k`` for each pair of very frequent words, by the words that follow it; 0 where nothing came before.

    k-means on the square roots of the shares, from centres far apart.
    """
    m = np.zeros(((FREQUENT + 1) ** 2, _TELLING))
    np.add.at(m, (klass, symbol), n)
    out = np.zeros(len(m), np.int64)
    some = np.flatnonzero(m.sum(axis=1) > 0)
    some = some[some > 0]
    if not len(some):
        return out
    weight = m[some].sum(axis=1)
    x = np.sqrt((m[some] + 0.01) / (weight + 0.01 * _TELLING)[:, None])
    centres = x[[weight.argmax()]]
    gap = np.full(len(x), np.inf)
    while len(centres) < min(k, len(x)):
        gap = np.minimum(gap, ((x - centres[-1]) ** 2).sum(axis=1))
        centres = np.vstack([centres, x[(gap * np.sqrt(weight)).argmax()]])
    own = np.zeros(len(x), np.int64)
    for _ in range(40):
        own = (x @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                v = (x[own == c] * weight[own == c, None]).sum(axis=0)
                centres[c] = v / np.linalg.norm(v)
    out[some] = own + 1
    return out


def histories(clusters: np.ndarray, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Cluster of the last two very frequent words before each word."""
    return clusters[context_classes(symbol, row)]


@dataclass
class Parsed:
    """Tokens of some texts, and their different pairs of class and word."""

    row: np.ndarray
    klass: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    stop: np.ndarray

    @property
    def key(self) -> np.ndarray:
        """Of each token's pair."""
        return self.hash ^ ts.mix(self.klass.astype(np.uint64))


@dataclass
class Pairs:
    """Different pairs of class and word, sorted by key, and where the first token of each is."""

    key: np.ndarray
    klass: np.ndarray
    start: np.ndarray
    stop: np.ndarray

    @property
    def hash(self) -> np.ndarray:
        """Of each pair's word."""
        return self.key ^ ts.mix(self.klass.astype(np.uint64))


def parse(model: Model, data: np.ndarray, off: np.ndarray) -> Iterator[Parsed]:
    """The tokens of a block, some whole texts at a time; rows and places are those of the block."""
    lo, rows = 0, len(off) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + _PIECE, "right")) - 1)
        h, row, start, stop = tokens(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        klass = histories(model.clusters, model.symbols(h), row)
        yield Parsed((row + lo).astype(np.int32), klass.astype(np.int8), h, (start + off[lo]).astype(np.int32), (stop + off[lo]).astype(np.int32))
        lo = hi


def _unique(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(different keys in order, where each comes first, which of them each key is, how often each comes)."""
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    n = np.diff(at, append=len(key))
    back = np.empty(len(key), np.int32)
    back[order] = np.repeat(np.arange(len(at), dtype=np.int32), n)
    return key[at], np.minimum.reduceat(order, at) if len(key) else order, back, n


def different(parts: Iterable[Parsed]) -> tuple[Pairs, np.ndarray]:
    """(all pairs of a block, how often each comes); of each part only its pairs are held."""
    held, often, found, times = [], [], [], []
    for p in parts:
        key, first, _, n = _unique(p.key)
        held.append(Pairs(key, p.klass[first], p.start[first], p.stop[first]))
        often.append(n.astype(np.int32))
    for cuts, one, back in _merged(held):
        found.append(one)
        n = np.concatenate([x[c] for x, c in zip(often, cuts, strict=True)])
        times.append(np.bincount(back, weights=n, minlength=len(one.key)).astype(np.int32))
    return _one_after_another(found), np.concatenate(times)


def pairs(parts: Iterable[Parsed]) -> tuple[Pairs, list[tuple[np.ndarray, np.ndarray]]]:
    """(all pairs of a block; row and pair of each part's tokens)."""
    held, tokens, found, size = [], [], [], 0
    for p in parts:
        key, first, back, _ = _unique(p.key)
        held.append(Pairs(key, p.klass[first], p.start[first], p.stop[first]))
        tokens.append((p.row, back))
    place = [np.empty(len(p.key), np.int32) for p in held]
    for cuts, one, back in _merged(held):
        found.append(one)
        for at, c in zip(place, cuts, strict=True):
            at[c], back = back[: c.stop - c.start] + size, back[c.stop - c.start :]
        size += len(one.key)
    return _one_after_another(found), [(row, at[back]) for (row, back), at in zip(tokens, place, strict=True)]


def _merged(held: list[Pairs]) -> Iterator[tuple[list[slice], Pairs, np.ndarray]]:
    """(a slice of each part, their different pairs, which of them each one is), for one range of keys after the other."""
    bounds = np.arange(1, _RANGES).astype(np.uint64) * np.uint64(2**64 // _RANGES)
    edges = [[0, *np.searchsorted(p.key, bounds).tolist(), len(p.key)] for p in held]
    for k in range(_RANGES):
        cuts = [slice(e[k], e[k + 1]) for e in edges]
        key, first, back, _ = _unique(np.concatenate([p.key[c] for p, c in zip(held, cuts, strict=True)]))
        yield cuts, Pairs(key, *(np.concatenate([getattr(p, f)[c] for p, c in zip(held, cuts, strict=True)])[first] for f in ("klass", "start", "stop"))), back


def _one_after_another(found: list[Pairs]) -> Pairs:
    return Pairs(*(np.concatenate([getattr(p, f) for p in found]) for f in ("key", "klass", "start", "stop")))


def stretches(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(run, stretch, first token, token after the last) of all stretches of the rows."""
    n = len(h)
    if n <= RUN:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    acc = np.zeros(n - RUN, np.uint64)
    for k in range(RUN):
        acc = acc * ts._BASE + h[k : n - RUN + k]
    run = ts.mix(acc)
    place = np.arange(n) - np.searchsorted(row, np.arange(rows))[row]
    begins = np.flatnonzero((row[:-RUN] == row[RUN:]) & ((run % np.uint64(EVERY) == 0) | (place[RUN:] == RUN))) + RUN
    ends = np.minimum(np.append(begins[1:], n), np.searchsorted(row, row[begins], "right"))
    up, down = ts._Powers.of(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * up[:n], out=sums[1:])
    stretch = ts.mix((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64))
    return run[begins - RUN], stretch, begins, ends


def _parts(batches: Iterable[pa.RecordBatch], column: int, size: int = _PIECE) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    for batch in batches:
        for row, data, off in ts.pieces(batch.column(column), size):
            yield batch, row, data, off


def _growing(columns: Iterable[pa.Array]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of whole texts, each twice as large as the one before, up to ``_BLOCK``; where they end depends on the texts alone."""
    size, have, held = _PIECE >> 9, 0, []
    for column in columns:
        for _, data, off in ts.pieces(column):
            at, n = 0, len(off) - 1
            while at < n:
                end = min(n, max(at + 1, int(np.searchsorted(off, off[at] + size - have))))
                held.append((data[off[at] : off[end]], off[at : end + 1] - off[at]))
                have += int(off[end] - off[at])
                at = end
                if have >= size:
                    size, have = min(2 * size, _BLOCK), 0
                    yield _joined(held)
    if held:
        yield _joined(held)


def _by_part(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array]]:
    """(part, texts) of batches (part, text) sorted by part."""
    for batch in batches:
        part = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi > lo:
                yield int(part[lo]), batch.column(1).slice(lo, hi - lo)


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, tuple[np.ndarray, np.ndarray]]]:
    """Batches of (key, train, text), some together, up to ``_BLOCK``: (key, train) and the texts."""
    held: list[pa.RecordBatch] = []
    texts: list[tuple[np.ndarray, np.ndarray]] = []

    def together() -> tuple[pa.RecordBatch, tuple[np.ndarray, np.ndarray]]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held.clear()
        return rows, _joined(texts)

    for batch in batches:
        for row, data, off in ts.pieces(batch.column(2), _BLOCK):
            if held and sum(len(d) for d, _ in texts) + len(data) > _BLOCK:
                yield together()
            held.append(batch.slice(row, len(off) - 1).select([0, 1]))
            texts.append((data, off))
    if held:
        yield together()


def _joined(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """All texts of ``held`` as one; it is emptied, so that they aren't held twice."""
    before = np.cumsum([0, *(len(d) for d, _ in held)])
    out = np.concatenate([d for d, _ in held]), np.concatenate([[0], *(o[1:] + b for (_, o), b in zip(held, before, strict=False))])
    held.clear()
    return out


class Tally:
    """Sums by 64-bit key, gathered in parts."""

    def __init__(self) -> None:
        self.keys, self.sums, self.waiting, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        self.waiting.append(np.unique(keys, return_counts=True))
        self.size += len(self.waiting[-1][0])
        if self.size > max(1 << 18, len(self.keys) // 2):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        k = np.concatenate([self.keys, *(w[0] for w in self.waiting)])
        n = np.concatenate([self.sums, *(w[1] for w in self.waiting)])
        self.keys, inverse = np.unique(k, return_inverse=True)
        self.sums = np.bincount(inverse, weights=n, minlength=len(self.keys)).astype(np.int64)
        self.waiting, self.size = [], 0
        return self.keys, self.sums

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.merge()
        self.keys, self.sums = self.keys[:0], self.sums[:0]
        return out


def count_words(docs: DataFrame) -> DataFrame:
    """(kind, hash, n): all tokens of ``docs`` (text) by hash for kind 0; for kind 1 the lower-cased bytes of words, and 256 for their ends."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, letters = Tally(), np.zeros(257, np.int64)

        def out(kind: int, keys: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(keys), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                yield pa.record_batch([pa.array(np.full(len(keys[part]), kind, np.int32)), pa.array(keys[part]), pa.array(sums[part])], names=["kind", "hash", "n"])

        for _, _, data, off in _parts(batches, 0):
            h = tokens(data, off)[0]
            tally.add(h.view(np.int64))
            letters[:256] += np.bincount(ts.LOWER[data], minlength=256)
            letters[_STOP] += len(h) - (len(off) - 1)
            if len(tally.keys) > _HELD:
                yield from out(0, *tally.take())
        yield from out(0, *tally.take())
        letters[:256][ts.WHITE] = 0
        yield from out(1, np.arange(257), letters)

    return docs.select("text").mapInArrow(run, "kind int, hash long, n long").groupBy("kind", "hash").agg(F.sum("n").alias("n"))


def _together(data: np.ndarray, p: Parsed | Pairs, first: np.ndarray) -> np.ndarray:
    """An order of the different words that keeps those of a class together which begin alike, in an order of their hashes otherwise."""
    begin = p.klass[first].astype(np.uint64)
    for k in range(_ALIKE):
        at = p.start[first].astype(np.int64) + k
        inside = np.flatnonzero(at < p.stop[first])
        letter = np.zeros(len(first), np.uint64)
        letter[inside] = ts.LOWER[data[at[inside]]] + np.uint64(1)
        begin = begin * np.uint64(257) + letter
    return np.argsort(ts.mix(begin), kind="stable")


def _spellings(data: np.ndarray, p: Parsed | Pairs, words: np.ndarray) -> Iterator[tuple[slice, Letters]]:
    """Words of a block, some at a time."""
    for lo in range(0, len(words), _WORDS):
        s = slice(lo, min(lo + _WORDS, len(words)))
        yield s, letters(data, p.start[words[s]].astype(np.int64), p.stop[words[s]].astype(np.int64), p.klass[words[s]])


def learn_text(model: Model, learner: Learner, data: np.ndarray, off: np.ndarray) -> None:
    """Goes through one block of texts."""
    p, times = different(parse(model, data, off))
    p.key = p.key[:0]  # not needed any more
    order = _together(data, p, np.arange(len(times), dtype=np.int32))
    times = times[order]
    for part, s in _spellings(data, p, order):
        learner.learn(s, times[part][s.word])
        del s  # before the next one is made


def word_bits(mixer: Mixer, data: np.ndarray, p: Parsed | Pairs, first: np.ndarray) -> np.ndarray:
    """Bits of each of a block's different words."""
    out, order = np.zeros(len(first)), _together(data, p, first)
    for part, s in _spellings(data, p, first[order]):
        one, back = s.once()
        out[order[part]] = -np.bincount(s.word, weights=mixer.log2(one)[back], minlength=part.stop - part.start)
        del s, one, back  # before the next ones are made
    return out


def fit(train: DataFrame, counted: DataFrame, vocabulary: int = VOCABULARY) -> Model:
    """Learns from all rows of ``train`` (key, text), whose words have been counted."""
    spark = train.sparkSession
    letters = np.ones(_SYMBOLS, np.int64)
    # one row for each byte
    for r in counted.where("kind = 1").collect():
        letters[r.hash] = max(1, r.n)
    counted = counted.where("kind = 0")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    end = int(_END_HASH.view(np.int64))
    # a bounded number of words, a parameter of the model
    top = counted.where(F.col("hash") != F.lit(end)).orderBy(F.desc("n"), "hash").limit(vocabulary).select("hash", "n").toArrow()
    ends = counted.where(F.col("hash") == F.lit(end)).first()
    hashes = np.append(top.column("hash").to_numpy(), end).view(np.uint64)
    counts = np.append(top.column("n").to_numpy(), ends.n if ends else 0).astype(np.int64)
    telling = hashes[:-1][: _TELLING - 1]
    order, few = np.argsort(hashes), np.argsort(telling)
    letters[_END] = max(1, int(counts[-1]))
    model = Model(telling[few], few + 1, hashes[order], counts[order], Mixer(*huffman(letters)), total.n, total.v, np.zeros((FREQUENT + 1) ** 2, np.int64))
    bare = spark.sparkContext.broadcast(model)

    def following(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((FREQUENT + 1) ** 2 * _TELLING, np.int64)
        for _, _, data, off in _parts(batches, 0):
            h, row, _, _ = tokens(data, off)
            s = bare.value.symbols(h)
            raw = context_classes(s, row)
            ok = s > _OTHER
            n += np.bincount(raw[ok] * _TELLING + s[ok], minlength=len(n))
        used = np.flatnonzero(n)
        yield pa.record_batch([pa.array(used), pa.array(n[used])], names=["at", "n"])

    # at most as many rows as pairs and telling words
    near = train.select("text").mapInArrow(following, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    near = near.sort_by("at")
    at, n = near.column("at").to_numpy(), near.column("n").to_numpy()
    model.clusters = clusters_of(at // _TELLING, at % _TELLING, n)
    plain = spark.sparkContext.broadcast(model)

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in groupby(_by_part(batches), key=itemgetter(0)):
            learner = Learner(plain.value.mixer)
            for data, off in _growing(column for _, column in own):
                learn_text(plain.value, learner, data, off)
                del data, off
                if learner.total > 1 << 30:  # before a count can overflow
                    yield from learner.sent()
            yield from learner.sent()
            yield learner.weighed()

    mixer = model.mixer
    tasks = max(1, int(letters.sum()) // TASK_BYTES)
    # texts are dealt to parts and put in order by a hash of key and text, so neither files nor the order of rows matter, and copies spread
    order = F.xxhash64("key", "text")
    dealt = train.select(F.pmod(order, F.lit(tasks)).alias("part"), "text", order.alias("_order")).repartition("part").sortWithinPartitions("part", "_order").select("part", "text")
    parts = dealt.mapInArrow(learn, "block int, body binary")
    # one row for each block of the model's slots; sorted by content, too, as sums of weights depend on the order
    got = parts.repartition("block").sortWithinPartitions("block", "body").mapInArrow(partial(add_up, slots=mixer.slots), "block int, body binary").toArrow()
    table, value = np.zeros(sum(mixer.slots), np.int16), np.zeros(0)
    for block, body in zip(got.column("block").to_pylist(), got.column("body").to_pylist(), strict=True):
        if block < 0:
            value = np.frombuffer(body, np.float64)
        else:
            table[block * ROW_SLOTS : (block + 1) * ROW_SLOTS] = np.frombuffer(body, np.int16)
    mixer.codes = np.split(table, np.cumsum(mixer.slots)[:-1])
    n = _GATES * mixer.width
    if not len(value):
        value = np.zeros(2 * n + 2 * _SYMBOLS * _SUMS)
    h = value[n : 2 * n].reshape(_GATES, mixer.width)
    mixer.weights = np.where(h > 1e-3, value[:n].reshape(_GATES, mixer.width) / np.maximum(h, 1e-3), first_weights(mixer.width - 1))
    mixer.sums = value[2 * n : 2 * n + 2 * _SYMBOLS * _SUMS].reshape(2, _SYMBOLS, _SUMS)
    return model


def predicted_stretches(judged: DataFrame) -> DataFrame:
    """(key, bits): what the table of stretches takes from the bits of each text, where it predicts any.

    ``judged`` has key, train and segments (run, stretch, bits). A row of the table holds, for a
    run, the number of its stretches in training texts and its two most frequent ones.
    """
    each = judged.select("key", "train", F.posexplode("segments").alias("pos", "s")).select("key", "train", "pos", "s.*")
    counted = each.where("train").groupBy("run", "stretch").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("n"), F.desc("stretch")))
    best = counted.withColumn("place", place).where("place <= 2")  # Spark keeps two of a run in each task before the shuffle
    of = lambda k, c: F.max(F.when(F.col("place") == k, F.col(c)))
    best = best.groupBy("run").agg(of(1, "stretch").alias("s1"), of(1, "n").alias("n1"), of(2, "stretch").alias("s2"), of(2, "n").alias("n2"))
    table = written(counted.groupBy("run").agg(F.sum("n").alias("n")).join(best, "run").select("run", "s1", "n1", "s2", "n2", "n"))
    # runs with more than one in 4,000 of all stretches, at most 4,000 of them, are dealt out to 64 tasks each
    often = F.col("n") > F.lit(max(1000, (table.agg(F.sum("n")).first()[0] or 0) // 4000))
    hot = table.where(often).select("run", F.lit(True).alias("hot"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("key"), F.lit(64))).otherwise(0).cast("int")
    dealt = each.join(F.broadcast(hot), "run", "left").withColumn("salt", salt).drop("hot")
    salted = table.withColumn("salt", F.explode(F.when(often, F.sequence(F.lit(0), F.lit(63))).otherwise(F.array(F.lit(0)))))
    met = dealt.join(salted, ["run", "salt"]).where("n > 1 or not train").drop("salt")
    # a training text is predicted by the others
    same = Window.partitionBy("key", "run")
    own = lambda c: F.when(F.col("train"), F.sum(F.when(F.col("stretch") == F.col(c), 1).otherwise(0)).over(same)).otherwise(0)
    met = met.repartition("key").withColumns({"o1": own("s1"), "o2": own("s2"), "o": F.when(F.col("train"), F.count("*").over(same)).otherwise(0)})
    met = met.select("key", "train", "pos", "stretch", "bits", "s1", "s2", (F.col("n1") - F.col("o1")).alias("n1"), (F.coalesce("n2", F.lit(0)) - F.col("o2")).alias("n2"), (F.col("n") - F.col("o")).alias("n"))
    first = F.col("n1") >= F.col("n2")
    met = met.where("greatest(n1, n2) > 0").withColumn("most", F.greatest("n1", "n2")).withColumn("hit", F.col("stretch") == F.when(first, F.col("s1")).otherwise(F.col("s2")))
    order = Window.partitionBy("key").orderBy("pos")
    before = F.when(F.lag("pos").over(order) == F.col("pos") - 1, F.when(F.lag("hit").over(order), 1).otherwise(2)).otherwise(0)
    case = before * 64 + F.least(F.floor(F.log2("n")), F.lit(7)) * 8 + F.floor(4 * F.col("most") / F.col("n"))
    met = written(met.select("key", "train", "hit", "bits", case.cast("int").alias("case")))
    # one row for each kind of case
    cases = met.where("train").groupBy("case").agg(F.sum(F.col("hit").cast("long")).alias("hits"), F.count("*").alias("all"))
    cases = cases.select("case", ((F.col("hits") + 0.4) / (F.col("all") + 0.8)).alias("p"))
    p = F.coalesce("p", F.lit(0.5))
    cost = F.when(F.col("hit"), -F.log2(p) - F.col("bits")).otherwise(-F.log2(1 - p))
    return met.join(F.broadcast(cases), "case", "left").groupBy("key").agg(F.sum(cost).alias("saved"))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, train: Column | None = None, vocabulary: int = VOCABULARY) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for each row; learns from the rows where ``train``."""
    train = F.lit(True) if train is None else F.coalesce(train, F.lit(False))
    keyed, unique = add_key(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), train.alias("train")), "id", "text")
    learned = keyed.where("train").select("key", "text")
    counted = written(count_words(learned))
    model = fit(learned, counted, vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scale = model.tokens + 0.5 * (model.distinct + 1)

    def rare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, at, data, off in _parts(batches, 1):
            h, row, _, _ = tokens(data, off)
            other = model.counted(h) < 0
            h, row = h[other], row[other]
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.ones(len(h) + 1, bool)
            new[1:-1] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            first = np.flatnonzero(new)
            key = batch.column(0).to_numpy()[at + row[first[:-1]]]
            yield pa.record_batch([pa.array(h[first[:-1]].view(np.int64)), pa.array(key), pa.array(np.diff(first).astype(np.int64))], names=["hash", "key", "m"])

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, (data, off) in _gathered(batches):
            one, parts = pairs(parse(model, data, off))
            each = word_bits(model.mixer, data, one, np.arange(len(one.key)))
            del data
            word = one.hash
            c = model.counted(word)
            log = np.where(c >= 0, np.log10((np.maximum(c, 0) + 0.5) / scale), 0.0)
            for row, back in parts:
                lo, n = int(row[0]), int(row[-1] - row[0]) + 1  # each row has its end
                row, bits, own = row - lo, each[back], batch.slice(lo, n)
                run, stretch, begin, end = stretches(word[back], row, n)
                # sums of their own, as differences of a running sum depend on what stands before
                spans = np.add.reduceat(np.append(bits, 0.0), np.stack([begin, end], axis=1).ravel())[::2] * (end > begin) if len(begin) else np.zeros(0)
                lists = pa.ListArray.from_arrays(
                    pa.array(ts.list_offsets(row[begin], n)),
                    pa.StructArray.from_arrays([pa.array(run.view(np.int64)), pa.array(stretch.view(np.int64)), pa.array(spans.astype(np.float32))], names=["run", "stretch", "bits"]),
                )
                yield pa.record_batch(
                    [
                        own.column(0),
                        own.column(1),
                        pa.array(np.diff(off[lo : lo + n + 1])),
                        pa.array(np.bincount(row, minlength=n)),
                        pa.array(np.bincount(row[(c > 0)[back]], minlength=n)),
                        pa.array(np.bincount(row, weights=log[back], minlength=n)),
                        pa.array(np.bincount(row, weights=bits, minlength=n)),
                        lists,
                    ],
                    names=["key", "train", "n_bytes", "n_tokens", "n_frequent", "base", "bits", "segments"],
                )

    once = keyed if unique else keyed.dropDuplicates(["key"])
    missing = float(np.log10(0.5 / scale)) if scale else 0.0
    rest = (
        once.select("key", "text")
        .mapInArrow(rare, "hash long, key long, m long")
        .join(counted.where("kind = 0").select("hash", "n"), "hash", "left")
        .groupBy("key")
        .agg(
            F.sum(F.col("m") * F.coalesce(F.log10((F.col("n") + 0.5) / F.lit(scale)), F.lit(missing))).alias("rest"),
            F.sum(F.when(F.col("n").isNotNull(), F.col("m")).otherwise(0)).alias("n_rest"),
        )
    )
    columns = "key long, train boolean, n_bytes long, n_tokens long, n_frequent long, base double, bits double, segments array<struct<run:bigint,stretch:bigint,bits:float>>"
    judged = written(once.select("key", "train", "text").mapInArrow(judge, columns))
    bits = F.col("bits") + F.coalesce("saved", F.lit(0.0))
    scored = judged.drop("segments", "train").join(predicted_stretches(judged), "key", "left").join(rest, "key", "left")
    scored = keyed.select("key", "id").join(scored, "key")
    return scored.select(
        "id",
        "n_tokens",
        (F.col("n_frequent") + F.coalesce("n_rest", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        F.round(-bits * F.log10(F.lit(2.0)), 6).alias("score"),
        F.round(bits / F.greatest("n_bytes", F.lit(1)), 9).alias("bits_per_byte"),
    )


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = score(docs, train=~held_out("doc_id", 5, 1))
    return found.select(F.col("id").alias("doc_id"), held_out("id", 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
