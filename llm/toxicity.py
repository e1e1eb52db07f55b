"""Toxicity by nearest labelled examples (operator 2).

Texts become TF-IDF vectors over words and word beginnings (so inflected forms share a
feature); the vocabulary is the ``FEATURES`` features that tell the labels apart best by
the log-likelihood ratio test, with document frequencies over all documents. The examples are a bounded sample of the labelled rows,
``EXAMPLES`` of either label, the first by hash of their id. They are kept in an inverted
index with a block maximum per feature and block of ``BLOCK`` examples. A query visits the
blocks by falling upper bound of the cosine and stops at the first that cannot beat its
``NEIGHBOURS``-th best, which gives the exact nearest examples. These vote with their
cosine as weight, and the vote is turned into a probability by isotonic regression on
leave-one-out votes of the examples, weighted to the labels' true shares. The neighbours
are given out as evidence.

Scores depend on the text alone. Texts with no feature, empty and null ones too, have no
neighbours and get the rate of such texts; without examples of both labels every score is
the rate of label 1 (0 without labels). Ids may be null (never held out, never examples)
or repeat (each row is scored); repeated labels count once, 1 wins; empty tables give
empty results; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import textscan as ts
from llm.keys import checkpoint, small_batches

FEATURES = 4096
EXAMPLES = 4000
NEIGHBOURS = 16
BLOCK = 64
BEGINNINGS = (4, 5, 6)
#: Features need this ratio of shares and number of examples, and one of these test values, the one with the least leave-one-out error.
LEAST_RATIO, LEAST_COUNT = 3.0, 2
LEAST_TESTS = (15.0, 8.0, 4.0)
_BITS = 20


def features(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, row) of words, then of beginnings of longer words, one length at a time."""
    low = ts.LOWER[data]
    words = ts.Words(low, off, separators=ts.NON_WORD, lower=False)
    yield words.hash, words.row
    sums = ts.prefix_hashes(low)
    size = words.stop - words.start
    for k in BEGINNINGS:
        at = np.flatnonzero(size > k)
        yield ts.span_hashes(sums, words.start[at], words.start[at] + k) ^ np.uint64(k * 0x9E3779B97F4A7C15 & (2**64 - 1)), words.row[at]


class Vectors:
    """Sparse TF-IDF rows over a vocabulary of sorted hashes."""

    def __init__(self, vocabulary: np.ndarray, idf: np.ndarray) -> None:
        order = np.argsort(vocabulary)
        self.vocabulary, self.idf = vocabulary[order], idf[order]
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[self.vocabulary & np.uint64((1 << _BITS) - 1)] = True

    def counts(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row * number of features + feature, count) of the features in a piece."""
        found = []
        for h, row in features(data, off):
            maybe = np.flatnonzero(self.bits[h & np.uint64((1 << _BITS) - 1)])
            at = np.minimum(np.searchsorted(self.vocabulary, h[maybe]), max(len(self.vocabulary) - 1, 0))
            ok = self.vocabulary[at] == h[maybe] if len(self.vocabulary) else np.zeros(0, bool)
            found.append(row[maybe[ok]] * len(self.idf) + at[ok] if len(self.vocabulary) else np.zeros(0, np.int64))
        return np.unique(np.concatenate(found), return_counts=True)

    def of(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """(features, unit weights) of each text."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for _, data, off in ts.pieces(texts):
            n = len(off) - 1
            key, tf = self.counts(data, off)
            row, feature = (key // len(self.idf), key % len(self.idf)) if len(self.idf) else (key, key)
            weight = (1 + np.log(tf)) * self.idf[feature] if len(self.idf) else np.zeros(0)
            norm = np.sqrt(np.bincount(row, weights=weight**2, minlength=n))
            weight = weight / norm[row]
            cut = np.searchsorted(row, np.arange(n + 1))
            out.extend((feature[a:b], weight[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True))
        return out


class BlockMaxIndex:
    """Inverted lists of the examples with the largest weight of each feature in each block."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, labels: np.ndarray, n_features: int) -> None:
        some = [i for i, (f, _) in enumerate(vectors) if len(f)]
        # examples with the same strongest feature lie together, so block maxima are tight
        some.sort(key=lambda i: (int(vectors[i][0][vectors[i][1].argmax()]), -float(vectors[i][1].max()), int(ids[i])))
        self.ids, self.labels = ids[some], labels[some]
        size = np.array([len(vectors[i][0]) for i in some], np.int64)
        example = np.repeat(np.arange(len(some)), size)
        feature = np.concatenate([vectors[i][0] for i in some]) if some else np.zeros(0, np.int64)
        weight = np.concatenate([vectors[i][1] for i in some]) if some else np.zeros(0)
        self.blocks = max(1, -(-len(some) // BLOCK))
        self.maxima = np.zeros((n_features, self.blocks))
        np.maximum.at(self.maxima, (feature, example // BLOCK), weight)
        order = np.lexsort((example, feature, example // BLOCK))
        self.example, self.weight = example[order], weight[order]
        self.lists = (example // BLOCK)[order] * n_features + feature[order]
        self.n_features = n_features

    def nearest(self, feature: np.ndarray, weight: np.ndarray, *, leave: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the nearest examples with a positive cosine; ``leave`` is an id to leave out."""
        none = np.zeros(0, np.int64), np.zeros(0)
        if not len(feature) or not len(self.ids):
            return none
        bound = weight @ self.maxima[feature]
        best, cosine = none
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or (len(best) >= NEIGHBOURS and bound[b] < cosine[-1] - 1e-12):
                break
            key = b * self.n_features + feature
            lo, hi = np.searchsorted(self.lists, key), np.searchsorted(self.lists, key, "right")
            size = hi - lo
            at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
            total = np.bincount(self.example[at] - b * BLOCK, weights=self.weight[at] * np.repeat(weight, size), minlength=BLOCK)
            hit = np.flatnonzero(total > 0) + b * BLOCK
            if leave is not None:
                hit = hit[self.ids[hit] != leave]
            best, cosine = np.concatenate([best, hit]), np.concatenate([cosine, total[hit - b * BLOCK]])
            order = np.lexsort((self.ids[best], -np.round(cosine, 12)))[:NEIGHBOURS]
            best, cosine = best[order], cosine[order]
        return best, cosine

    def vote(self, best: np.ndarray, cosine: np.ndarray) -> float:
        """-1 without neighbours, else the share of label 1, by cosine."""
        return float((cosine * self.labels[best]).sum() / cosine.sum()) if len(best) else -1.0


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (smallest x of each pool, its mean)."""
    xs, inverse = np.unique(x, return_inverse=True)
    w = np.bincount(inverse, weights=weight)
    m = np.bincount(inverse, weights=weight * y) / w
    pools: list[list[float]] = []
    for a, mean, mass in zip(xs, m, w, strict=True):
        pools.append([a, mean, mass])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            _, m2, w2 = pools.pop()
            a1, m1, w1 = pools.pop()
            pools.append([a1, (m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2])
    return np.array([p[0] for p in pools]), np.array([p[1] for p in pools])


def held_out(id_col: str, of: int = 4, remainder: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(of)) == remainder, F.lit(False))


def _pick(batches: Iterable[pa.RecordBatch], ids: np.ndarray, labels: np.ndarray) -> Iterator[pa.RecordBatch]:
    from llm.importance import _labels_of

    for batch in batches:
        label = _labels_of(batch.column(0), ids, labels)
        hit = pa.array(label >= 0)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(hit), batch.column(1).filter(hit), pa.array(label[label >= 0])], names=["id", "text", "label"])


def _terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label = batch.column(2).to_numpy()
        for row, data, off in ts.pieces(batch.column(1)):
            h, r = ts.distinct_by_row(*map(np.concatenate, zip(*features(data, off), strict=True)))
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(label[row + r])], names=["term", "label"])


def document_frequencies(docs: DataFrame, vectors: Vectors) -> tuple[int, np.ndarray]:
    """(number of texts, texts with each feature) over the column ``text`` of all of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, size = shared.value, len(shared.value.vocabulary)
        seen = np.zeros(size + 1, np.int64)  # the last one is the number of texts
        for batch in batches:
            for _, data, off in ts.pieces(batch.column(0)):
                seen[:size] += np.bincount(vectors.counts(data, off)[0] % max(1, size), minlength=size)[:size]
            seen[size] += batch.num_rows
        some = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(some), pa.array(seen[some])], names=["feature", "n"])

    out = np.zeros(len(vectors.vocabulary) + 1, np.int64)
    # one row for each feature
    for r in docs.select("text").mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        out[r.feature] = r.n
    return int(out[-1]), out[:-1]


class Model:
    def __init__(self, vectors: Vectors, index: BlockMaxIndex, steps: tuple[np.ndarray, np.ndarray]) -> None:
        self.vectors, self.index, self.steps = vectors, index, steps

    def score(self, vote: float) -> float:
        x, y = self.steps
        return float(y[max(0, int(np.searchsorted(x, vote, "right")) - 1)])


def _left_out(picked: DataFrame, vectors: Vectors) -> tuple[BlockMaxIndex, np.ndarray, np.ndarray]:
    """The index of all examples, and each example's leave-one-out vote and label."""
    spark = picked.sparkSession
    first = spark.sparkContext.broadcast(vectors)

    def vectorise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = first.value.of(batch.column(1))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array([f for f, _ in got], pa.list_(pa.int64())), pa.array([w for _, w in got], pa.list_(pa.float64()))], names=["id", "label", "f", "w"])

    # bounded by the number of examples
    rows = sorted(picked.mapInArrow(vectorise, "id long, label long, f array<long>, w array<double>").collect())
    sparse = [(np.array(r.f, np.int64), np.array(r.w)) for r in rows]
    index = BlockMaxIndex(sparse, np.array([r.id for r in rows], np.int64), np.array([r.label for r in rows], np.int64), len(vectors.idf))
    shared = spark.sparkContext.broadcast((vectors, index))

    def left_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, index = shared.value
        for batch in batches:
            votes = [index.vote(*index.nearest(*v, leave=i)) for v, i in zip(vectors.of(batch.column(1)), batch.column(0).to_pylist(), strict=True)]
            yield pa.record_batch([pa.array(votes, pa.float64()), batch.column(2)], names=["vote", "label"])

    votes = np.array([tuple(r) for r in picked.mapInArrow(left_out, "vote double, label long").collect()])
    return index, votes[:, 0], votes[:, 1]


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", examples: int = EXAMPLES) -> Model:
    """Fits on a sample of ``labels``: at most ``examples`` rows of each label."""
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("id"))
        .agg(F.max(F.col(label_col).cast("long")).alias("label"))
    )
    shares = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = [r for y in (0, 1) for r in known.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(examples).collect()]
    chosen.sort()
    ids, y = np.array([r.id for r in chosen], np.int64), np.array([r.label for r in chosen], np.int64)
    rate = shares.get(1, 0) / max(1, shares.get(0, 0) + shares.get(1, 0))
    flat = Model(Vectors(np.zeros(0, np.uint64), np.zeros(0)), BlockMaxIndex([], ids, y, 0), (np.array([-1.0]), np.array([rate])))
    if not (shares.get(0) and shares.get(1)):
        return flat
    picked = checkpoint(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(partial(_pick, ids=ids, labels=y), "id long, text string, label long"))
    seen = {r.label: r.n for r in picked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not (seen.get(0) and seen.get(1)):
        return flat
    n0, n1 = float(seen[0]), float(seen[1])
    terms = picked.mapInArrow(_terms, "term long, label long").groupBy("term").agg(F.sum("label").cast("double").alias("a"), F.sum(1 - F.col("label")).cast("double").alias("b"))
    part = lambda k, n, e: k * F.log((k + 1e-9) / (n * e))
    e = (F.col("a") + F.col("b")) / (n0 + n1)
    test = 2 * (part(F.col("a"), n1, e) + part(F.col("b"), n0, e) + part(n1 - F.col("a"), n1, 1 - e + 1e-12) + part(n0 - F.col("b"), n0, 1 - e + 1e-12))
    ratio = F.abs(F.log((F.col("a") + 0.5) / n1) - F.log((F.col("b") + 0.5) / n0))
    top = terms.where((F.col("a") + F.col("b")) >= LEAST_COUNT).withColumn("test", test).where((F.col("test") >= min(LEAST_TESTS)) & (ratio >= float(np.log(LEAST_RATIO)))).orderBy(F.desc("test"), "term").limit(FEATURES).collect()
    terms_only = Vectors(np.array([r.term for r in top], np.int64).view(np.uint64), np.ones(len(top)))
    n, df = document_frequencies(docs.select(F.col(text_col).alias("text")), terms_only)
    idf = np.log(max(1, n) / np.maximum(df, 1)) + 1
    test_of = {r.term: r.test for r in top}
    test = np.array([test_of[h] for h in terms_only.vocabulary.view(np.int64).tolist()])
    best: tuple[float, Model] | None = None
    for least in LEAST_TESTS:
        vectors = Vectors(terms_only.vocabulary[test >= least], idf[test >= least])
        index, vote, label = _left_out(picked, vectors)
        weight = np.where(label == 1, shares[1] / n1, shares[0] / n0)
        model = Model(vectors, index, isotonic(vote, label, weight))
        error = float((weight * (np.array([model.score(v) for v in vote]) - label) ** 2).sum())
        if best is None or error < best[0] - 1e-9:
            best = error, model
    return best[1]


def score(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` with score and evidence, the nearest examples as (id, label, cosine)."""
    small_batches(docs.sparkSession)
    docs = docs.drop("score", "evidence")
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = "array<struct<id:bigint,label:bigint,cosine:double>>"
    arrow = pa.list_(pa.struct([("id", pa.int64()), ("label", pa.int64()), ("cosine", pa.float64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        index = model.index
        for batch in batches:
            scores, evidence = [], []
            for v in model.vectors.of(batch.column(at)):
                best, cosine = index.nearest(*v)
                scores.append(model.score(index.vote(best, cosine)))
                evidence.append([{"id": i, "label": y, "cosine": c} for i, y, c in zip(index.ids[best].tolist(), index.labels[best].tolist(), cosine.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(evidence, arrow)], names=[*batch.schema.names, "score", "evidence"])

    return docs.mapInArrow(run, docs.withColumn("score", F.lit(0.0)).withColumn("evidence", F.lit(None).cast(kind)).schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id"))
    model = fit(docs, labels)
    found = score(docs, model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence")
