"""Removal of repeated byte strings by suffix sorting (operator 3).

A byte is removed if a string of ``length`` bytes covering it also starts earlier, in a
document with a smaller id or earlier in the same one. All windows of ``length`` bytes
are judged, on the input.

Cutting into buckets. Each window is put down to the smallest hash among its
``ANCHOR``-byte substrings, its anchor. Neighbouring windows with one anchor form a
segment, so a text gives one row for some forty bytes. Equal windows have equal anchors at
equal offsets, hence fall into the same bucket of suffixes. Segments equal as a whole are
settled by their hash alone, and buckets with one member are unique. What is left, the
segments where copies begin, end or differ, is a few hundredths of the input.

Sorting bucket by bucket. The texts of those segments are dealt out by bucket. A task
takes some whole buckets at a time into one buffer, ranks the suffixes that start at the positions of a
difference cover (by their first bytes, then by pairs of ranks one period on, two, four and so on until none are equal), and
puts the suffixes of the buckets in order: by as many bytes as the period has, then ties by the
ranks of the two cover samples at the offset that the residues of the two suffixes share.
Suffixes that follow each other and agree in ``length`` bytes are copies; all but
the first of the input go. Memory is that of one buffer.

Hot buckets. Of buckets with more than ``HOT`` members the different segments are counted. Up to ``SORTED`` times as many
are sorted like others; of more, the windows are dealt out one by one, by a hash of all their bytes (at most
``length - ANCHOR + 1`` rows for a segment, whatever the size of the bucket). Those that hold more than one in ``SHARE`` of a task's segments are
known from a first pass over the texts, and their segments are dealt out by
content from the start, so that no task gets a bucket whole. Whether a bucket counts as hot changes no result.

Null texts are empty and lose nothing; empty tables give empty results; ids may be null
or repeat (see :func:`llm.keys.with_key`); further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import textscan as ts
from llm.keys import checkpoint, with_key

ANCHOR = 24
PERIOD = 32
HOT = 512
SHARE = 4000
#: A bucket of up to so many times ``HOT`` different segments is sorted: 0.7 MB of text, beside the task's buffer.
SORTED = 8
#: Bytes of bucket text that a task sorts at a time.
BUFFER = 2 << 20
_PLACE = np.uint64(30)
#: Marks of buckets: segments of one content, windows of one content, and windows known to be copies.
_CONTENT, _WINDOW, _KNOWN = 1 << 50, 1 << 51, 1 << 52


def difference_cover(period: int) -> np.ndarray:
    """Residues such that every difference modulo ``period`` is one between two of them; greedy."""
    cover = [0, 1]
    have = {0, 1, period - 1}
    while len(have) < period:
        gain = {x: {(x - y) % period for y in cover} | {(y - x) % period for y in cover} for x in range(period)}
        best = max(range(period), key=lambda x: (len(gain[x] - have), -x))
        cover.append(best)
        have |= gain[best]
    return np.array(sorted(cover))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    m = len(x) - w + 1
    blocks = np.concatenate([x, np.full(-len(x) % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:m], before[w - 1 : w - 1 + m])


def _anchors(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple]:
    """(keys, row, offsets, span sums, bucket, anchor, first window, last window, text) of all segments of each piece."""
    width = length - ANCHOR + 1
    for batch in batches:
        keys = batch.column(0).to_numpy()
        for row, data, off in ts.pieces(batch.column(1)):
            n = len(data)
            if n < length:
                continue
            sums = ts.prefix_hashes(data)
            grams = ts.span_hashes(sums, np.arange(n - ANCHOR + 1), np.arange(ANCHOR, n + 1))
            anchor = (_sliding_min((grams >> _PLACE << _PLACE) | np.arange(len(grams), dtype=np.uint64), width) & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64)
            doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
            windows = n - length + 1
            inside = doc[:windows] == doc[length - 1 :]
            new = np.ones(windows + 1, bool)
            new[1:-1] = (anchor[1:] != anchor[:-1]) | ~inside[:-1] | ~inside[1:]
            first = np.flatnonzero(new[:-1] & inside)
            last = np.flatnonzero(new[1:] & inside)
            if len(first):
                at = anchor[first]
                yield keys, row + doc[first], first - off[doc[first]], sums, (grams[at] >> np.uint64(16)).astype(np.int64), at, first, last


def _frequent(batches: Iterator[pa.RecordBatch], length: int, hot: int, share: int) -> Iterator[pa.RecordBatch]:
    """(bucket, n) of the buckets with more than one in ``share`` of a task's segments, at most ``share`` of them."""
    known, sums, total = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for *_, bucket, _, first, _ in _anchors(batches, length):
        total += len(first)
        new, n = np.unique(bucket, return_counts=True)
        known, back = np.unique(np.concatenate([known, new]), return_inverse=True)
        sums = np.bincount(back, weights=np.concatenate([sums, n])).astype(np.int64)
        if len(known) > 1 << 20:  # the rare ones of what has been seen go
            keep = sums > max(1, total // (8 * share))
            known, sums = known[keep], sums[keep]
    keep = sums > max(hot, total // share)
    yield pa.record_batch([pa.array(known[keep]), pa.array(sums[keep])], names=["bucket", "n"])


def hot_buckets(texts: DataFrame, length: int, hot: int = HOT, share: int = SHARE) -> np.ndarray:
    """At most ``share`` buckets, sorted: the largest of those that are frequent in some task."""
    found = texts.mapInArrow(partial(_frequent, length=length, hot=hot, share=share), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return np.sort(found.orderBy(F.desc("n"), "bucket").limit(share).toArrow().column("bucket").to_numpy())


def _segments(batches: Iterator[pa.RecordBatch], length: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(bucket, whole, key, place): place holds the first window, their number, and the anchor's offset.

    A segment found earlier in the same piece goes out as settled: place is negative and
    the bucket a hash of its place.
    """
    for keys, row, start, sums, bucket, at, first, last in _anchors(batches, length):
        whole = ts.mix(ts.span_hashes(sums, first, last + length) ^ ((at - first) * 128 + last - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        if len(hot):
            often = hot[np.minimum(np.searchsorted(hot, bucket), len(hot) - 1)] == bucket
            bucket = np.where(often, (ts.mix(bucket.astype(np.uint64) ^ whole) >> np.uint64(16)).astype(np.int64) | _CONTENT, bucket)
        key = keys[row]
        place = (start << 14) | ((last - first + 1) << 7) | (at - first)
        order = np.lexsort((place, key, whole))
        again = np.zeros(len(first), bool)
        again[order[1:]] = whole[order[1:]] == whole[order[:-1]]
        bucket = np.where(again, (ts.mix(key.astype(np.uint64) ^ (place.astype(np.uint64) << np.uint64(20))) >> np.uint64(16)).astype(np.int64), bucket)
        yield pa.record_batch([pa.array(bucket), pa.array(whole.view(np.int64)), pa.array(key), pa.array(np.where(again, -place - 1, place))], names=["bucket", "whole", "key", "place"])


def _settle(batches: Iterator[pa.RecordBatch], most: int = HOT) -> Iterator[pa.RecordBatch]:
    """From segments sorted by (bucket, whole, key, place): (key, place, bucket, open).

    open 0: all windows of the segment are repeats; 1: its bucket has other segments, 2: many.
    A bucket is held back until it ends or has more than ``most`` rows; then all its segments
    are open, as others may follow.
    """
    held = np.zeros((0, 4), np.int64)
    hot, seen = None, None  # the bucket that has been flushed as hot, and its last segment

    def out(rows: np.ndarray, repeat: np.ndarray, kind: np.ndarray, known: np.ndarray) -> pa.RecordBatch | None:
        keep = repeat | known | (kind > 0)
        rows, repeat, kind, known = rows[keep], repeat[keep], kind[keep], known[keep]
        place = np.where(known, -rows[:, 3] - 1, rows[:, 3])
        return pa.record_batch([pa.array(rows[:, 2]), pa.array(place), pa.array(rows[:, 0]), pa.array(np.where(repeat | known, 0, kind).astype(np.int32))], names=["key", "place", "bucket", "open"])

    def judge(rows: np.ndarray, early: bool = False) -> pa.RecordBatch:
        known = rows[:, 3] < 0
        same = np.zeros(len(rows), bool)
        same[1:] = (rows[1:, 0] == rows[:-1, 0]) & (rows[1:, 1] == rows[:-1, 1])
        if hot is not None and len(rows) and rows[0, 0] == hot and rows[0, 1] == seen:
            same[0] = True
        begins = np.ones(len(rows), bool)
        begins[1:] = rows[1:, 0] != rows[:-1, 0]
        group = np.cumsum(begins) - 1
        kinds = np.bincount(group, weights=~same)[group]
        size = np.bincount(group)[group]
        kind = np.where(kinds > 1, np.where(size > most, 2, 1), 0)
        if hot is not None:
            kind = np.where(rows[:, 0] == hot, 2, kind)
        kind = np.where(rows[:, 0] & _CONTENT > 0, 2, kind)
        if early:  # the last bucket goes on
            kind = np.where(rows[:, 0] == rows[-1, 0], 2, kind)
        return out(rows, same & ~known, kind, known)

    for batch in batches:
        rows = np.column_stack([c.to_numpy() for c in batch.columns]).astype(np.int64)
        rows = np.concatenate([held, rows])
        if not len(rows):
            continue
        tail = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
        flush = len(rows) - tail > most or rows[-1, 0] == hot
        done = rows if flush else rows[:tail]
        if len(done):
            yield judge(done, flush)
        held = rows[:0] if flush else rows[tail:].copy()
        if flush:
            hot, seen = rows[-1, 0], rows[-1, 1]
        elif hot is not None and len(done):
            hot, seen = None, None
    if len(held):
        yield judge(held)


def counted_buckets(settled: DataFrame, most: int) -> DataFrame:
    """The open segments; those of buckets with many members are open like others (1) where the bucket has up to ``most`` different segments."""
    many = settled.where("open = 2")
    # segments dealt out by content stand alone in their buckets, so those say nothing of their number
    few = many.where(F.col("bucket").bitwiseAND(_CONTENT) == 0).groupBy("bucket").count().where(F.col("count") <= most).select("bucket", F.lit(1).alias("few"))
    return settled.where("open = 1").unionByName(many.join(few, "bucket", "left").select("key", "place", "bucket", F.coalesce("few", "open").alias("open")))


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """From (key, text, open segments): (bucket, key, start, n, bytes) of their texts; of hot ones each window, without its bytes."""
    names = ["bucket", "key", "start", "n", "bytes"]
    for batch in batches:
        keys, lists = batch.column(0).to_numpy(), batch.column(2)
        for row, data, off in ts.pieces(batch.column(1)):
            part = lists.slice(row, len(off) - 1)
            flat = part.flatten()
            if not len(flat):
                continue
            doc = np.repeat(np.arange(len(off) - 1), np.diff(part.offsets.to_numpy()))
            place, bucket, kind = (flat.field(k).to_numpy() for k in range(3))
            start, n, hot = place >> 14, (place >> 7) & 127, kind > 1
            if hot.any():
                i = np.repeat(np.flatnonzero(hot), n[hot])
                at = start[i] + np.arange(len(i)) - np.repeat(np.cumsum(n[hot]) - n[hot], n[hot])
                key, begin = keys[row + doc[i]], off[doc[i]] + at
                h = ts.span_hashes(ts.prefix_hashes(data), begin, begin + length)
                order = np.lexsort((at, key, h))
                key, at, h = key[order], at[order], h[order]
                first = np.ones(len(h), bool)
                first[1:] = h[1:] != h[:-1]
                deal = np.where(first, (h >> np.uint64(16)).astype(np.int64) | _WINDOW, (ts.mix(h ^ key.astype(np.uint64) ^ at.astype(np.uint64) << np.uint64(32)) >> np.uint64(16)).astype(np.int64) | _KNOWN)
                yield pa.record_batch([pa.array(deal), pa.array(key), pa.array(at), pa.array(np.ones(len(h), np.int32)), pa.nulls(len(h), pa.binary())], names=names)
                doc, start, n, bucket = doc[~hot], start[~hot], n[~hot], bucket[~hot]
            if not len(doc):
                continue
            begin = off[doc] + start
            size = n + length - 1
            out_off = np.zeros(len(size) + 1, np.int64)
            np.cumsum(size, out=out_off[1:])
            take = np.repeat(begin - out_off[:-1], size) + np.arange(out_off[-1])
            body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(out_off), pa.py_buffer(data[take])])
            yield pa.record_batch([pa.array(bucket), pa.array(keys[row + doc]), pa.array(start), pa.array(n.astype(np.int32)), body.cast(pa.binary())], names=names)


def _refine(classes: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Ranks of the pairs (class, more)."""
    _, second = np.unique(more, return_inverse=True)
    _, both = np.unique(classes * np.int64(len(more) + 1) + second, return_inverse=True)
    return both


class SuffixOrder:
    """Order of the suffixes of a buffer of bytes by the ranks of a difference cover."""

    def __init__(self, buffer: np.ndarray, period: int = PERIOD) -> None:
        self.period = period
        cover = difference_cover(period)
        n = len(buffer)
        padded = np.zeros(n + 6 * period, np.uint8)
        padded[:n] = buffer
        self.words = np.zeros(len(padded) - 7, np.uint64)  # eight bytes from each position, most significant first
        for k in range(8):
            self.words = (self.words << np.uint64(8)) | padded[k : len(padded) - 7 + k]
        # samples up to a period after the last byte, where suffixes are empty and so come first
        samples = (np.arange(0, n + period, period)[:, None] + cover[None, :]).ravel()
        rank = np.zeros(len(samples), np.int64)
        for k in range(0, period, 8):
            rank = _refine(rank, self.words[samples + k])
        self.rank = np.full(n + 6 * period, -1, np.int64)
        self.rank[samples] = rank
        ahead = period
        while ahead <= n + period and rank.max() + 1 < len(samples):
            rank = _refine(rank, self.rank[np.minimum(samples + ahead, len(self.rank) - 1)])
            self.rank[samples] = rank
            ahead *= 2
        inside = np.zeros(period, bool)
        inside[cover] = True
        r, d = np.arange(period), np.arange(period)
        both = inside[(r[:, None, None] + d) % period] & inside[(r[None, :, None] + d) % period]
        #: For two residues the offset that takes both to the cover.
        self.shared = both.argmax(axis=2)

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffix a comes before suffix b, which agrees with it in one period of bytes."""
        d = self.shared[a % self.period, b % self.period]
        return self.rank[a + d] < self.rank[b + d]

    def sort(self, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, tie): suffixes by group, then by their bytes; those of one tie agree in a period of bytes."""
        tie = group
        for k in range(0, self.period, 8):
            tie = _refine(tie, self.words[at + k])
        residue = at % self.period
        own = self.rank[at + self.shared[residue, residue]]
        order = np.lexsort((own, residue, tie))
        # the suffixes of one tie and residue are in order: a run; neighbouring runs of a tie are merged until there is one
        t, r = tie[order], residue[order]
        new = np.ones(len(order), bool)
        new[1:] = (t[1:] != t[:-1]) | (r[1:] != r[:-1])
        while True:
            begin = np.flatnonzero(new)
            first = np.ones(len(begin), bool)  # of its tie
            first[1:] = t[begin[1:]] != t[begin[:-1]]
            number = np.arange(len(begin)) - np.maximum.accumulate(np.where(first, np.arange(len(begin)), 0))
            right = np.flatnonzero(number % 2)
            if not len(right):
                return order, tie
            stop = np.append(begin[1:], len(order))
            size = stop - begin
            both = np.concatenate([right, right - 1])
            other = np.concatenate([right - 1, right])
            x = np.repeat(begin[both] - (np.cumsum(size[both]) - size[both]), size[both]) + np.arange(size[both].sum())
            lo, hi = np.repeat(begin[other], size[both]), np.repeat(stop[other], size[both])
            from_right = np.repeat(np.arange(len(both)) < len(right), size[both])
            base = lo.copy()
            live = np.arange(len(x))
            while len(live):
                mid = (lo[live] + hi[live]) >> 1
                a, b = at[order[mid]], at[order[x[live]]]
                # equal ones of the left run stay before those of the right
                before = np.where(from_right[live], ~self.less(b, a), self.less(a, b))
                lo[live] = np.where(before, mid + 1, lo[live])
                hi[live] = np.where(before, hi[live], mid)
                live = live[lo[live] < hi[live]]
            left_begin = np.repeat(begin[np.minimum(both, other)], size[both])
            target = left_begin + (x - np.repeat(begin[both], size[both])) + (lo - base)
            moved = order.copy()
            moved[target] = order[x]
            order = moved
            new[begin[right]] = False


def repeated_windows(text: np.ndarray, length: int, key: np.ndarray, start: np.ndarray, n: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece, window) of all windows that are equal to an earlier one of their bucket, by (key, start).

    ``text`` holds one piece after the other; piece i has ``n[i]`` windows.
    """
    sizes = n + length - 1
    begin = np.cumsum(sizes) - sizes
    suffixes = SuffixOrder(text)
    piece = np.repeat(np.arange(len(n)), n)
    window = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    at = begin[piece] + window
    _, group = np.unique(bucket, return_inverse=True)
    order, tie = suffixes.sort(at, group[piece])
    p, tie = at[order], tie[order]
    same = tie[1:] == tie[:-1]
    for k in [*range(PERIOD, length - 8, 8), length - 8]:
        where = np.flatnonzero(same)
        same[where] = suffixes.words[p[where] + k] == suffixes.words[p[where + 1] + k]
    copies = np.concatenate([[0], np.cumsum(~same)])
    place, key = (start[piece] + window)[order], key[piece[order]]
    first = np.lexsort((place, key, copies))
    later = np.zeros(len(first), bool)
    later[1:] = copies[first[1:]] == copies[first[:-1]]
    hit = order[first[later]]
    return piece[hit], window[hit]


def _sort_buckets(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, key and start: (key, start, n) for the runs of repeated windows."""
    held: pa.Table | None = None
    last = -1  # bucket of the window before

    def judge(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if t.num_rows < 2:
            return
        bucket, key, start, n = (t.column(k).to_numpy().astype(np.int64) for k in range(4))
        body = t.column(4).cast(pa.large_binary()).combine_chunks()
        raw = np.frombuffer(body.buffers()[2], np.uint8)
        off = np.frombuffer(body.buffers()[1], np.int64)[body.offset : body.offset + len(body) + 1]
        piece, window = repeated_windows(raw[off[0] : off[-1]], length, key, start, n, bucket)
        if not len(piece):
            return
        order = np.lexsort((window, piece))
        piece, window = piece[order], window[order]
        new = np.ones(len(piece) + 1, bool)
        new[1:-1] = (piece[1:] != piece[:-1]) | (window[1:] != window[:-1] + 1)
        first, stop = np.flatnonzero(new[:-1]), np.flatnonzero(new[1:])
        yield pa.record_batch([pa.array(key[piece[first]]), pa.array(start[piece[first]] + window[first]), pa.array(window[stop] - window[first] + 1)], names=["key", "start", "n"])

    for batch in batches:
        bucket = batch.column(0).to_numpy()
        cut = int(np.searchsorted(bucket, _WINDOW))
        if cut < batch.num_rows:  # windows come last, those of one content by their place
            own = bucket[cut:]
            again = own >= _KNOWN
            again[1:] |= own[1:] == own[:-1]
            again[0] |= own[0] == last
            last = int(own[-1])
            yield pa.record_batch([batch.column(1).slice(cut).filter(pa.array(again)), batch.column(2).slice(cut).filter(pa.array(again)), pa.array(np.ones(int(again.sum()), np.int64))], names=["key", "start", "n"])
        batch = batch.slice(0, cut)
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if held.nbytes < BUFFER:
            continue
        bucket = held.column(0).to_numpy()
        tail = int(np.searchsorted(bucket, bucket[-1]))
        if tail:
            yield from judge(held.slice(0, tail))
            held = held.slice(tail)
    if held is not None:
        yield from judge(held)


def _remove(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """From (id, text, runs of repeated windows): (id, n_bytes, spans, kept)."""
    for batch in batches:
        for row, data, off in ts.pieces(batch.column(1)):
            rows, n = len(off) - 1, len(data)
            part = batch.column(2).slice(row, rows)
            flat = part.flatten()
            doc = np.repeat(np.arange(rows), np.diff(part.offsets.to_numpy()) if len(part) else 0)
            delta = np.zeros(n + 1, np.int32)
            if len(flat):
                begin = off[doc] + flat.field(0).to_numpy()
                np.add.at(delta, begin, 1)
                np.add.at(delta, begin + flat.field(1).to_numpy() + length - 1, -1)
            gone = np.zeros(n + 2, bool)
            gone[1:-1] = np.cumsum(delta[:n]) > 0
            cut = np.zeros(n + 2, bool)
            cut[off] = True
            start = np.flatnonzero(gone[1:] & (~gone[:-1] | cut[: n + 1]))
            stop = np.flatnonzero(gone[:-1] & (~gone[1:] | cut[: n + 1]))
            of = np.searchsorted(off, start, "right") - 1
            spans = pa.ListArray.from_arrays(
                pa.array(ts.list_offsets(of, rows)), pa.StructArray.from_arrays([pa.array(start - off[of]), pa.array(stop - off[of])], names=["start", "stop"])
            )
            stays = ~gone[1:-1]
            kept_off = np.concatenate([[0], np.cumsum(stays)])[off].astype(np.int32)
            kept = pa.BinaryArray.from_buffers(pa.binary(), rows, [None, pa.py_buffer(kept_off), pa.py_buffer(data[stays])])
            yield pa.record_batch([batch.column(0).slice(row, rows), pa.array(np.diff(off)), spans, kept], names=["id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, *, hot: int = HOT, share: int = SHARE) -> DataFrame:
    """(id, n_bytes, spans of removed bytes, kept bytes) for each row of ``docs``."""
    keyed, unique = with_key(docs, id_col, text_col)
    kind = dict(keyed.dtypes)["id"]
    once = keyed if unique else keyed.dropDuplicates(["key"])
    texts = once.select("key", "text")
    segments = texts.mapInArrow(partial(_segments, length=length, hot=hot_buckets(texts, length, hot, share)), "bucket long, whole long, key long, place long")
    settled = checkpoint(segments.repartition("bucket").sortWithinPartitions("bucket", "whole", "key", "place").mapInArrow(partial(_settle, most=hot), "key long, place long, bucket long, open int"))
    still = counted_buckets(settled, SORTED * hot).groupBy("key").agg(F.collect_list(F.struct("place", "bucket", "open")).alias("open"))
    # both joins read the same columns, so that the texts are shuffled once
    cut = (
        once.join(still, "key")
        .select("key", "text", "open", "id")
        .mapInArrow(partial(_cut, length=length), "bucket long, key long, start long, n int, bytes binary")
        .repartition("bucket")
        .sortWithinPartitions("bucket", "key", "start")
        .mapInArrow(partial(_sort_buckets, length=length), "key long, start long, n long")
    )
    known = settled.where("open = 0").select("key", F.expr("place >> 14").alias("start"), F.expr("(place >> 7) & 127").alias("n"))
    runs = known.unionByName(cut).groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    return (
        keyed.join(runs, "key", "left")
        .select("id", "text", F.coalesce("runs", F.expr("array()").cast("array<struct<start:bigint,n:bigint>>")).alias("runs"))
        .mapInArrow(partial(_remove, length=length), f"id {kind}, n_bytes long, spans array<struct<start:bigint,stop:bigint>>, kept binary")
    )


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = remove_repeats(docs)
    return found.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
