"""SentencePiece encoding and decoding by a streaming Viterbi search (operator 10).

The lattice of a text has its byte positions as nodes and its pieces as arcs; characters
without a piece are arcs spelled in byte pieces. A unigram model maximises the sum of the
scores. A byte-pair model has no sums to maximise: its encoding is the one path whose
neighbouring pieces all stand next to each other in the merge order (merging the text of
the two gives the two again), so arcs that fail this against the best path into their start
are cut. Either way each node keeps one backpointer, and a window as long as the longest
piece holds all nodes that an arc can still reach. Once all surviving paths run through one
boundary, everything before it is final and is given out.

Where two bytes meet that are neighbours in no piece, all paths converge. Texts are cut
at those boundaries first; equal stretches of a batch are searched once, many at a time, and
long stretches go through the streaming encoder, which holds no more than its window.

Spaces are kept as they are and a text gets one in front, as the model's normalizer has it.
Empty texts give no ids, null texts null; a text with U+2581 decodes with a space for it; ids may be
null or repeat; empty tables give empty results; further columns are kept, and one that
has the result's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import textscan as ts
from llm.keys import small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Stretches longer than this are encoded one by one, in a window.
LONG = 200
#: Stretches that a worker remembers: in two halves, the older of which goes when the newer is full.
REMEMBERED = 160_000
_START, _NONE, _UNKNOWN = -3, -2, -1
_SPACE = "▁"
_CACHE = 1 << 20


def _span_mix(length: int) -> np.uint64:
    return np.uint64((length * 0x9E3779B97F4A7C15) & (2**64 - 1))


class _Table:
    """Values by 64-bit key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.bits = np.zeros(1 << 21, bool)
        self.bits[keys & np.uint64((1 << 21) - 1)] = True

    def get(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        maybe = np.flatnonzero(self.bits[keys & np.uint64((1 << 21) - 1)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
            ok = self.keys[at] == keys[maybe]
            out[maybe[ok]] = self.values[at[ok]]
        return out


def _hash(piece: bytes) -> np.uint64:
    data = np.frombuffer(piece, np.uint8)
    return ts.span_hashes(ts.prefix_hashes(data), np.array([0]), np.array([len(data)]))[0] ^ _span_mix(len(data))


class PieceModel:
    """The pieces of a SentencePiece model file; ``unigram`` tells how paths are scored."""

    def __init__(self, proto: bytes, *, unigram: bool = False) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.unigram = unigram
        self.text: dict[int, bytes] = {}
        self.byte_id = np.zeros(256, np.int64)
        unknown = model.unk_id()
        self.out_bytes: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:-1], 16)] = i
                self.out_bytes.append(bytes([int(piece[3:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.out_bytes.append(b"")
            else:
                self.text[i] = piece.replace(_SPACE, " ").encode()
                self.out_bytes.append(self.text[i])
        self.bytes_known = bool(self.byte_id.any())
        if not self.bytes_known:
            self.byte_id[:] = unknown
        self.id_of = {v: k for k, v in self.text.items()}
        self.score = np.array([model.get_score(i) for i in range(model.get_piece_size())])
        #: Merge order: a smaller rank merges first; equal scores have equal ranks.
        self.rank = np.unique(-self.score, return_inverse=True)[1].astype(np.int64)
        self.longest = max(map(len, self.id_of))
        self.inside = np.zeros((256, 256), bool)
        prefixes: set[bytes] = set()
        merges: dict[int, int] = {}
        for piece, i in self.id_of.items():
            for a, b in pairwise(piece):
                self.inside[a, b] = True
            for k in range(1, len(piece)):
                prefixes.add(piece[:k])
                left, right = self.id_of.get(piece[:k]), self.id_of.get(piece[k:])
                if left is not None and right is not None:
                    merges[left << 20 | right] = i
        # for each piece and beginning of a piece: twice the id + 1 (0 for none), and whether it goes on
        spans = {p: 2 * (self.id_of.get(p, -1) + 1) + (p in prefixes) for p in prefixes | set(self.id_of)}
        self.spans = _Table(np.array([_hash(p) for p in spans], np.uint64), np.array(list(spans.values())))
        self.merges = _Table(ts.mix(np.array(list(merges), np.uint64)), np.array(list(merges.values())))
        width = max(len(p.decode()) for p in self.id_of)
        self.chars = np.full((model.get_piece_size(), width), -1, np.int32)
        for piece, i in self.id_of.items():
            for k, c in enumerate(piece.decode()):
                self.chars[i, k] = self.id_of.get(c.encode(), -1)
        self.n_chars = (self.chars >= 0).sum(axis=1)
        self._pairs = np.full(_CACHE, -1, np.int64)
        self._fits = np.zeros(_CACHE, bool)
        self.known: dict[int, tuple[int, ...]] = {}
        self.older: dict[int, tuple[int, ...]] = {}
        self.out_len = np.array([len(b) for b in self.out_bytes], np.int64)
        self.out_off = np.concatenate([[0], np.cumsum(self.out_len)])
        self.out_data = np.frombuffer(b"".join(self.out_bytes), np.uint8)

    # Transitions

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that two pieces merge into, or -1."""
        return np.where((a >= 0) & (b >= 0), self.merges.get(ts.mix((np.maximum(a, 0) << 20 | np.maximum(b, 0)).astype(np.uint64))), -1)

    def _stand(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of a and b, best rank first and from the left, gives a and b."""
        na, nb = self.n_chars[a], self.n_chars[b]
        width = int((na + nb).max())
        n = len(a)
        col = np.arange(width)
        syms = np.where(col < na[:, None], self.chars[a][:, np.minimum(col, self.chars.shape[1] - 1)], -1).astype(np.int64)
        right = np.clip(col - na[:, None], 0, self.chars.shape[1] - 1)
        syms = np.where((col >= na[:, None]) & (col < (na + nb)[:, None]), self.chars[b[:, None], right], syms)
        length = na + nb
        border = na.copy()  # symbols left of the border
        ok = np.ones(n, bool)
        live = np.arange(n)
        big = np.int64(2**40)
        while len(live):
            s = syms[live]
            joined = self.merge(s[:, :-1].ravel(), s[:, 1:].ravel()).reshape(len(live), -1)
            rank = np.where(joined >= 0, self.rank[joined], big)
            best = rank.argmin(axis=1)
            line = np.arange(len(live))
            going = rank[line, best] < big
            crossing = going & (best + 1 == border[live])
            ok[live[crossing]] = False
            going &= ~crossing
            live, best, s, joined = live[going], best[going], s[going], joined[going]
            if not len(live):
                break
            line = np.arange(len(live))
            new = joined[line, best]
            cols = np.arange(width)[None, :]
            shifted = np.concatenate([s[:, 1:], np.full((len(live), 1), -1)], axis=1)
            s = np.where(cols > best[:, None], shifted, s)
            s[line, best] = new
            syms[live] = s
            border[live] -= best < border[live] - 1
            length[live] -= 1
        return ok & (length == 2) & (syms[:, 0] == a) & (border == 1)

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece ``b`` may follow ``a``; unknown characters and starts go with everything."""
        out = np.ones(len(a), bool)
        if self.unigram:
            return out
        both = np.flatnonzero((a >= 0) & (b >= 0))
        if not len(both):
            return out
        key = a[both] << 20 | b[both]
        slot = (ts.mix(key.astype(np.uint64)) & np.uint64(_CACHE - 1)).astype(np.int64)
        hit = self._pairs[slot] == key
        result = self._fits[slot]
        if not hit.all():
            new, back = np.unique(key[~hit], return_inverse=True)
            stand = np.concatenate([self._stand(k >> 20, k & 0xFFFFF) for k in np.array_split(new, len(new) // 20_000 + 1)])
            result[~hit] = stand[back]
            at = slot[~hit]
            self._pairs[at], self._fits[at] = key[~hit], stand[back]
        out[both] = result
        return out

    # Search

    def lattice(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, ...]]:
        """The ids of many short stretches at once."""
        n = len(off) - 1
        word = np.repeat(np.arange(n), np.diff(off))
        sums = ts.prefix_hashes(data)
        begins = np.flatnonzero((data & 0xC0) != 0x80)
        char_len = np.diff(np.append(begins, len(data)))
        arcs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        single = np.full(len(data), -1, np.int64)
        alive = begins
        end_of = off[1:][word]
        for length in range(1, self.longest + 1):
            alive = alive[alive + length <= end_of[alive]]
            if not len(alive):
                break
            h = ts.span_hashes(sums, alive, alive + length) ^ _span_mix(length)
            span = self.spans.get(h)
            found = (span >> 1) - 1
            hit = (span >= 0) & (found >= 0)
            arcs.append((alive[hit], np.full(hit.sum(), length), found[hit]))
            single[alive[hit]] = np.where(single[alive[hit]] < 0, length, single[alive[hit]])
            alive = alive[(span >= 0) & (span & 1 > 0)]
        bare = single[begins] != char_len
        arcs.append((begins[bare], char_len[bare], np.full(bare.sum(), _UNKNOWN)))
        start, length, piece = (np.concatenate(x) for x in zip(*arcs, strict=True))
        node = start + word[start]  # a stretch has one node more than bytes
        end = node + length
        depth = start + length - off[word[start]]
        order = np.argsort(depth, kind="stable")
        start, end, piece, depth, node = start[order], end[order], piece[order], depth[order], node[order]
        last = np.full(len(data) + n, _NONE, np.int64)
        back = np.zeros(len(data) + n, np.int64)
        score = np.zeros(len(data) + n)
        last[off[:-1] + np.arange(n)] = _START
        steps = np.searchsorted(depth, np.arange(1, int(depth[-1]) + 2)) if len(depth) else np.zeros(1, int)
        floor = self.score.min() - 10.0
        for lo, hi in pairwise(steps):
            if lo == hi:
                continue
            a, e, p = node[lo:hi], end[lo:hi], piece[lo:hi]
            prev = last[a]
            ok = prev != _NONE
            a, e, p, prev = a[ok], e[ok], p[ok], prev[ok]
            ok = self.fits(prev, p)
            a, e, p = a[ok], e[ok], p[ok]
            if self.unigram:
                value = score[a] + np.where(p >= 0, self.score[p], floor)
                order = np.lexsort((value, e))
                a, e, p, value = a[order], e[order], p[order], value[order]
                score[e] = value
            last[e], back[e] = p, a
        at = off[1:] + np.arange(n)
        base = off[:-1] + np.arange(n)
        ids: list[list[int]] = [[] for _ in range(n)]
        spans: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        going = np.flatnonzero(at > base)
        while len(going):
            here = at[going]
            spans.append((going, last[here], np.stack([back[here] - going, here - going])))
            at[going] = back[here]
            going = going[at[going] > base[going]]
        for who, piece, where in reversed(spans):
            for w, p, a, b in zip(who.tolist(), piece.tolist(), where[0].tolist(), where[1].tolist(), strict=True):
                if p >= 0:
                    ids[w].append(p)
                else:
                    ids[w].extend(self.byte_id[data[a:b]].tolist())
        return [tuple(x) for x in ids]

    def encode_batch(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts that already have their leading space."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        cut = np.ones(n, bool)
        cut[1:] = ~self.inside[data[:-1], data[1:]] & ((data[1:] & 0xC0) != 0x80)
        cut[off[:-1][off[:-1] < n]] = True
        start = np.flatnonzero(cut)
        stop = np.append(start[1:], n)
        sums = ts.prefix_hashes(data)
        h = ts.span_hashes(sums, start, stop) ^ ts.mix((stop - start).astype(np.uint64))
        distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED // 2:
            self.known, self.older = {}, self.known
        keys = distinct.tolist()
        known, older, got = self.known, self.older, []
        for k in keys:
            ids = known.get(k)
            if ids is None and (ids := older.get(k)) is not None:
                known[k] = ids
            got.append(ids)
        missing = [i for i, x in enumerate(got) if x is None]
        size = stop - start
        short = np.array([i for i in missing if size[first[i]] <= LONG], np.int64)
        for lo in range(0, len(short), 20_000):
            part = short[lo : lo + 20_000]
            lengths = size[first[part]]
            w_off = np.concatenate([[0], np.cumsum(lengths)])
            take = np.repeat(start[first[part]] - w_off[:-1], lengths) + np.arange(w_off[-1])
            for i, ids in zip(part.tolist(), self.lattice(data[take], w_off), strict=True):
                got[i] = self.known[keys[i]] = ids
        for i in missing:
            if got[i] is None:
                stream = StreamingEncoder(self)
                text = data[start[first[i]] : stop[first[i]]].tobytes()
                got[i] = (*stream.feed(text), *stream.finish())
        counts = np.array([len(x) for x in got], np.int64)
        pool = np.fromiter((x for ids in got for x in ids), np.int32, int(counts.sum()))
        pool_off = np.cumsum(counts) - counts
        each = counts[back]
        ends = np.cumsum(each)
        take = np.repeat(pool_off[back] - (ends - each), each) + np.arange(int(ends[-1]))
        return pool[take], np.concatenate([[0], ends])[np.searchsorted(start, off)]

    def decode_batch(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets), without the leading space."""
        size = self.out_len[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(self.out_off[ids] - ends[:-1], size) + np.arange(ends[-1])
        data = self.out_data[take]
        b_off = ends[off]
        lead = b_off[:-1][(b_off[:-1] < b_off[1:])]
        lead = lead[data[lead] == 32]
        keep = np.ones(len(data), bool)
        keep[lead] = False
        return data[keep], np.concatenate([[0], np.cumsum(keep)])[b_off]


class StreamingEncoder:
    """Encodes a text that comes in parts; holds a window of two longest pieces at most."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self.window = b""
        self.base = 0  # position of the window in the text
        self.nodes: dict[int, tuple[int, int, float]] = {0: (_START, 0, 0.0)}  # position: last piece, start, score
        self.done = 0  # ids up to here have been given out
        self.at = 0

    def _step(self, end: int) -> None:
        m = self.model
        options = []
        lo = max(self.done, end - m.longest)
        for a in range(lo, end):
            if a in self.nodes and (p := m.id_of.get(self.window[a - self.base : end - self.base])) is not None:
                options.append((a, p))
        char = end - 1
        while (self.window[char - self.base] & 0xC0) == 0x80:
            char -= 1
        if char in self.nodes and self.window[char - self.base : end - self.base] not in m.id_of:
            options.append((char, _UNKNOWN))
        if not options:
            return
        a, p = (np.array(x) for x in zip(*options, strict=True))
        ok = m.fits(np.array([self.nodes[x][0] for x in a.tolist()]), p)
        best = None
        for x, y in zip(a[ok].tolist(), p[ok].tolist(), strict=True):
            value = self.nodes[x][2] + (float(m.score[y]) if y >= 0 else float(m.score.min()) - 10.0)
            if best is None or (m.unigram and value > best[2]):
                best = (y, x, value)
        if best:
            self.nodes[end] = best

    def _give(self, upto: int) -> Iterator[int]:
        path = []
        while upto > self.done:
            piece, start, _ = self.nodes[upto]
            path.append((piece, start, upto))
            upto = start
        for piece, start, end in reversed(path):
            if piece >= 0:
                yield piece
            else:
                yield from self.model.byte_id[np.frombuffer(self.window[start - self.base : end - self.base], np.uint8)].tolist()

    def _settled(self) -> int:
        """The last boundary that the paths to all nodes in reach share."""
        paths = {x for x in self.nodes if x > self.at - self.model.longest and x >= self.done}
        while len(paths) > 1:
            last = max(paths)
            paths.discard(last)
            paths.add(self.nodes[last][1])
        return paths.pop()

    def feed(self, part: bytes) -> list[int]:
        """The ids that are final after this part; parts end between characters."""
        out: list[int] = []
        self.window += part
        total = self.base + len(self.window)
        while self.at < total:
            end = self.at + 1
            while end < total and (self.window[end - self.base] & 0xC0) == 0x80:
                end += 1
            self._step(end)
            self.at = end
            if self.at - self.done >= 2 * self.model.longest:
                upto = self._settled()
                if upto > self.done:
                    out.extend(self._give(upto))
                    self.done = upto
                    self.nodes = {k: v for k, v in self.nodes.items() if k >= upto}
                    cut = max(0, min(upto, self.at - self.model.longest) - self.base)
                    self.window, self.base = self.window[cut:], self.base + cut
        return out

    def finish(self) -> list[int]:
        out = list(self._give(self.at))
        self.done = self.at
        return out


@lru_cache(maxsize=2)
def _model(proto: bytes, unigram: bool) -> PieceModel:
    return PieceModel(proto, unigram=unigram)


def encode_texts(texts: pa.Array, model: PieceModel) -> pa.Array:
    """List array of ids; null for null."""
    column = pc.replace_substring(texts.cast(pa.large_string()), _SPACE, " ")
    parts = []
    for _, data, off in ts.pieces(column):
        lead = off[:-1][off[:-1] < off[1:]]
        spaced = np.insert(data, lead, np.uint8(32))
        moved = off + np.concatenate([[0], np.cumsum(off[:-1] < off[1:])])
        parts.append(model.encode_batch(spaced, moved))
    counts = np.concatenate([np.diff(o) for _, o in parts]) if parts else np.zeros(0, np.int64)
    off = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    ids = pa.array(np.concatenate([i for i, _ in parts]) if parts else np.zeros(0, np.int32), pa.int32())
    mask = pa.array(np.asarray(texts.is_null())) if texts.null_count else None
    return pa.ListArray.from_arrays(pa.array(off), ids, mask=mask)


def decode_ids(lists: pa.ListArray, model: PieceModel) -> pa.Array:
    off = np.asarray(lists.offsets)
    ids = np.asarray(lists.values)[off[0] : off[-1]]
    data, b_off = model.decode_batch(ids, (off - off[0]).astype(np.int64))
    mask = None
    if lists.null_count:
        mask = pa.py_buffer(np.packbits(~np.asarray(lists.is_null()), bitorder="little"))
    return pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(b_off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)), mask).cast(pa.string())


def _mapped(docs: DataFrame, column: str, out: dict[str, str], model_path: str, unigram: bool, f) -> DataFrame:
    """``docs`` with the columns ``out`` (name: type) that ``f`` makes of ``column``."""
    small_batches(docs.sparkSession)
    docs = docs.drop(*out)
    at = docs.columns.index(column)
    with open(model_path, "rb") as file:  # the driver reads the vocabulary and sends it along
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                made = f(part.column(at), _model(shared.value, unigram))
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*batch.schema.names, *out])

    schema = docs
    for name, kind in out.items():
        schema = schema.withColumn(name, F.lit(None).cast(kind))
    return docs.mapInArrow(run, schema.schema)


def encode(docs: DataFrame, text_col: str = "text", out_col: str = "ids", *, check_col: str | None = None, model_path: str = MODEL, unigram: bool = False) -> DataFrame:
    """``docs`` with the piece ids of each whole text; ``unigram`` for models trained as such.

    ``check_col``, if given, tells whether the ids decode to the text again.
    """

    def run(texts: pa.Array, model: PieceModel) -> list[pa.Array]:
        ids = encode_texts(texts, model)
        return [ids, pc.fill_null(pc.equal(decode_ids(ids, model), texts), True)] if check_col else [ids]

    return _mapped(docs, text_col, {out_col: "array<int>"} | ({check_col: "boolean"} if check_col else {}), model_path, unigram, run)


def decode(docs: DataFrame, ids_col: str = "ids", out_col: str = "decoded", *, model_path: str = MODEL) -> DataFrame:
    """``docs`` with the text of each list of ids."""
    return _mapped(docs, ids_col, {out_col: "string"}, model_path, False, lambda ids, model: [decode_ids(ids, model)])


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, check_col="round_trip").select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), "round_trip")
