"""Benchmark decontamination with SimHash windows (operator 1).

For each benchmark item, windows of as many words as the item slide over every document,
one word at a time. Windows and items have 64-bit SimHash fingerprints over their
five-word shingles, weighted by multiplicity. A multi-index finds all items of a window's
size within ``RADIUS`` bits: fingerprints are cut into ``BLOCKS`` blocks, and two that
differ in at most ``RADIUS`` = 3 * BLOCKS - 1 bits differ in at most two bits in some block, so
looking up each block with up to two flipped bits misses none. Each candidate is then
verified by the exact weighted similarity of the shingles (sum of the smaller over sum of
the larger multiplicities).

A window that has no shingle in common with any item has similarity 0 to all of them, so
fingerprints are made only where a shingle of an item occurs; all documents and all
positions are looked through for those. Words are runs of ASCII letters, digits and
non-ASCII characters, in lower case, so punctuation and spacing don't matter.

The benchmark is the query set: its items go to the tasks in blocks of ``ITEMS``, one
after the other. Items or documents shorter than five words are one shingle; a document
shorter than an item is one window. Null and empty texts match nothing, on either side, and
items without an id are left out, as a hit could not name them;
an empty benchmark leaves all documents clean; ids may be null or repeat, each row is
judged on its own; further columns are kept, and one that has the result's name is
replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from llm import textscan as ts
from llm.keys import small_batches

SIZE = 5
BLOCKS = 6
RADIUS = 3 * BLOCKS - 1
#: Items that a task holds at a time.
ITEMS = 4096
_EDGES = np.linspace(0, 64, BLOCKS + 1).astype(int)
_BITS = np.arange(64, dtype=np.uint64)
_TABLE_BITS = 22

Hit = StructType([StructField("item_id", LongType()), StructField("similarity", DoubleType()), StructField("word", LongType()), StructField("words", LongType())])


def _signs(hashes: np.ndarray) -> np.ndarray:
    """(n, 64) of +1 and -1."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int8) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


def simhash(hashes: np.ndarray) -> int:
    return int(_pack(_signs(hashes).sum(axis=0, dtype=np.int64)[None, :])[0])


class MultiIndex:
    """Finds all codes within ``RADIUS`` bits."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.tables = []
        for lo, hi in zip(_EDGES[:-1], _EDGES[1:], strict=True):
            flips = [0] + [1 << i for i in range(hi - lo)] + [(1 << i) | (1 << j) for i, j in combinations(range(hi - lo), 2)]
            part = (codes >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)
            keys = (part[:, None] ^ np.array(flips, np.uint64)[None, :]).ravel()
            who = np.repeat(np.arange(len(codes)), len(flips))
            order = np.argsort(keys, kind="stable")
            self.tables.append((lo, hi, keys[order], who[order]))

    def near(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, code) pairs within RADIUS bits."""
        n = len(self.codes)
        pairs = []
        for lo, hi, keys, who in self.tables:
            part = (codes >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)
            begin, end = np.searchsorted(keys, part), np.searchsorted(keys, part, "right")
            size = end - begin
            q = np.repeat(np.arange(len(codes)), size)
            at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
            pairs.append(q * n + who[at])
        pair = np.unique(np.concatenate(pairs))
        q, c = pair // n, pair % n
        ok = np.bitwise_count(codes[q] ^ self.codes[c]) <= RADIUS
        return q[ok], c[ok]


class Items:
    """A block of benchmark items: shingles, fingerprints by number of words, and a table of all shingles."""

    def __init__(self, items: list[tuple[int, str]], threshold: float) -> None:
        self.threshold = threshold
        self.ids = np.array([i for i, _ in items], np.int64)
        texts = pa.array([t for _, t in items], pa.string())
        self.by_size: dict[int, tuple[np.ndarray, MultiIndex]] = {}
        self.counts: list[Counter] = [Counter() for _ in items]
        size = np.zeros(len(items), np.int64)
        codes = np.zeros(len(items), np.uint64)
        every: dict[int, list[np.ndarray]] = {}
        for row, data, off in ts.pieces(texts):
            words = ts.Words(data, off, separators=ts.NON_WORD)
            for i in range(len(off) - 1):
                w = words.hash[words.first[i] : words.first[i + 1]]
                size[row + i] = len(w)
                if len(w):
                    k = min(SIZE, len(w))
                    sh = word_runs(w, k)
                    self.counts[row + i] = Counter(sh.tolist())
                    codes[row + i] = simhash(sh)
                    every.setdefault(k, []).append(sh)
        for n in np.unique(size[size > 0]):
            who = np.flatnonzero(size == n)
            self.by_size[int(n)] = (who, MultiIndex(codes[who]))
        self.every = {k: np.unique(np.concatenate(v)) for k, v in every.items()}
        self.table = {}
        for k, v in self.every.items():
            self.table[k] = np.zeros(1 << _TABLE_BITS, bool)
            self.table[k][v & np.uint64((1 << _TABLE_BITS) - 1)] = True

    def search(self, words: ts.Words) -> Iterator[tuple[int, int, float, int, int]]:
        """(row, item, similarity, first word, words) of the best window of each row and item that reaches the threshold."""
        for k, table in self.table.items():
            n = len(words.hash)
            if n < k:
                continue
            sh = word_runs(words.hash, k)
            maybe = np.flatnonzero(table[sh & np.uint64((1 << _TABLE_BITS) - 1)] & (words.row[: n - k + 1] == words.row[k - 1 :]))
            known = self.every[k]
            hits = maybe[known[np.minimum(np.searchsorted(known, sh[maybe]), len(known) - 1)] == sh[maybe]]
            if not len(hits):
                continue
            for row in np.unique(words.row[hits]):
                lo, hi = words.first[row], words.first[row + 1]
                yield from self._row(int(row), sh[lo : hi - k + 1], hits[words.row[hits] == row] - lo, int(hi - lo), k)

    def _row(self, row: int, sh: np.ndarray, hits: np.ndarray, n: int, k: int) -> Iterator[tuple[int, int, float, int, int]]:
        sums = np.zeros((len(sh) + 1, 64), np.int32)
        np.cumsum(_signs(sh), axis=0, out=sums[1:])
        marks = np.concatenate([[0], np.cumsum(np.bincount(hits, minlength=len(sh)))])
        best: dict[int, tuple[float, int, int]] = {}
        for size, (who, index) in self.by_size.items():
            if min(SIZE, size) != k:
                continue
            w = min(size, n)
            many = w - k + 1  # shingles of a window
            start = np.arange(n - w + 1)
            start = start[marks[start + many] > marks[start]]
            if not len(start):
                continue
            q, c = index.near(_pack(sums[start + many] - sums[start]))
            for s, i in zip(start[q].tolist(), who[c].tolist(), strict=True):
                ours, theirs = Counter(sh[s : s + many].tolist()), self.counts[i]
                both = sum(min(x, theirs[h]) for h, x in ours.items() if h in theirs)
                value = both / (many + sum(theirs.values()) - both)
                if value >= self.threshold and value > best.get(i, (0.0,))[0]:
                    best[i] = (value, s, w)
        for i in sorted(best):
            yield row, int(self.ids[i]), *best[i]


def word_runs(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, rows not looked at."""
    acc = np.zeros(len(w) - k + 1, np.uint64)
    for j in range(k):
        acc = acc * ts._BASE + w[j : len(w) - k + 1 + j]
    return ts.mix(acc)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    block: list[tuple[int, str]] = []
    for item, text in benchmark.select(F.col(item_col).cast("long"), F.col(text_col)).where(F.col(text_col).isNotNull() & F.col(item_col).isNotNull()).toLocalIterator():
        block.append((item, text))
        if len(block) == ITEMS:
            yield block
            block = []
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", out_col: str = "leaks", threshold: float = 0.8) -> DataFrame:
    """``docs`` with ``out_col``: for each item that a document holds, (item_id, similarity, word, words) of its best window."""
    small_batches(docs.sparkSession)
    docs = docs.drop(out_col)
    at = docs.columns.index(text_col)
    out = docs.withColumn(out_col, F.lit(None).cast(ArrayType(Hit)))
    schema = out.schema
    for block in _blocks(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def search(batches: Iterable[pa.RecordBatch], shared=shared, at=at) -> Iterator[pa.RecordBatch]:
            items = None
            for batch in batches:
                items = items or Items(shared.value, threshold)
                found: list[list[dict]] = [x or [] for x in batch.column(batch.num_columns - 1).to_pylist()]
                for row, data, off in ts.pieces(batch.column(at)):
                    for r, item, value, word, words in items.search(ts.Words(data, off, separators=ts.NON_WORD)):
                        found[row + r].append({"item_id": item, "similarity": value, "word": word, "words": words})
                kind = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("word", pa.int64()), ("words", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind)], names=batch.schema.names)

        out = out.mapInArrow(search, schema)
    return out.withColumn(out_col, F.coalesce(out_col, F.array().cast(ArrayType(Hit))))


def leaked(col: str = "leaks") -> Column:
    return F.size(col) > 0


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        leaked().alias("contaminated"),
        F.array_sort(F.transform("leaks", lambda x: x.item_id)).alias("item_ids"),
        F.coalesce(F.array_max(F.transform("leaks", lambda x: x.similarity)), F.lit(0.0)).alias("similarity"),
    )
