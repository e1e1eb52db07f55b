"""Quality classifier by importance resampling (operator 9).

Words and pairs of neighbouring words are hashed into ``BUCKETS``; the target texts (a
bounded sample of the documents labelled good, half of ``TARGET``) and all raw documents give one
generative model each. A document's log importance weight is the sum of the log ratios
of its n-grams. Weights grow with length, so the draw goes by the tempered ratio, weight to the power of
``slope`` over the number of n-grams (and ``PRIOR``), times a constant: they are read as odds on a scale that
is fitted on the other half of the bounded labelled sample, the half that the target model has
not seen: a logistic curve over the weight per n-gram, with ``PRIOR`` n-grams of no evidence
added. ``k``, the expected number of good documents, is the sum of
those probabilities over all documents, and Gumbel top-k draws ``k`` documents without
replacement in proportion to their odds. The noise of a document is a hash of its id and
text, so the draw is the same on each run and independent of partitions; the k-th
largest key is found exactly by counting digits, without a global sort.

Null and empty texts have no evidence and the prior's odds; ids may be null or repeat (equal
rows share their fate); without labels of both kinds every document is kept; empty tables
give empty results; further columns are kept, and those that have a result's name are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import textscan as ts
from llm.keys import checkpoint, small_batches

BUCKETS = 10_000
TARGET = 20_000
PRIOR = 10


def ngrams(words: ts.Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of all words and pairs of words."""
    h = words.hash
    pair = ts.mix(h[:-1] * ts._BASE + h[1:])
    ok = words.row[1:] == words.row[:-1]
    return np.concatenate([h, pair[ok]]) % np.uint64(buckets), np.concatenate([words.row, words.row[:-1][ok]])


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, labels) of at most ``most`` labelled documents, the first by hash; sorted by id."""
    rows = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(label_col).cast("long").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(most)
        .collect()
    )
    rows = sorted((r.id, r.label) for r in rows)
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def _labels_of(ids: pa.Array, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The label of each id, or -1."""
    out = np.full(len(ids), -1, np.int64)
    if len(known):
        x = ids.cast(pa.int64()).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
        hit = known[at] == x
        out[hit] = values[at[hit]]
    return out


def fit_weights(docs: DataFrame, sample: tuple[np.ndarray, np.ndarray], buckets: int = BUCKETS) -> np.ndarray:
    """Log ratio of each bucket; ``docs`` has (id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(sample)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            good = _labels_of(batch.column(0), *shared.value) == 1
            for row, data, off in ts.pieces(batch.column(1)):
                g, r = ngrams(ts.Words(data, off), buckets)
                raw += np.bincount(g.astype(np.int64), minlength=buckets)
                target += np.bincount(g[good[row + r]].astype(np.int64), minlength=buckets)
        used = np.flatnonzero(raw)
        yield pa.record_batch([pa.array(used), pa.array(raw[used]), pa.array(target[used])], names=["bucket", "raw", "target"])

    rows = docs.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    counts = np.zeros((2, buckets))
    for bucket, raw, target in rows:
        counts[:, bucket] = raw, target
    if not counts[1].sum():
        return np.zeros(buckets)
    p = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * buckets)
    return np.log(p[1]) - np.log(p[0])


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of ``y`` on ``x`` by Newton steps with a small ridge: (slope, intercept)."""
    scale = x.std() or 1.0
    z = np.column_stack([(x - x.mean()) / scale, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2) * len(x) ** 0.5, z.T @ (y - p) - 1e-3 * len(x) ** 0.5 * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1] - w[0] * x.mean() / scale)


def _kth_largest(keys: DataFrame, k: int) -> int:
    """The k-th largest of the long column ``key``: 16 bits at a time, from the counts of each digit."""
    prefix, left = 0, k
    for level in range(4):
        shift = 48 - 16 * level
        digit = F.shiftright("key", shift).bitwiseAND(0xFFFF)
        rows = keys if not level else keys.where(F.shiftright("key", shift + 16) == F.lit(prefix))
        counts = {r.d: r.n for r in rows.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect()}
        for d in sorted(counts, key=lambda d: d if level else (d - 0x10000 if d >= 0x8000 else d), reverse=True):
            if counts[d] >= left:
                break
            left -= counts[d]
        prefix = (prefix << 16 | d) if level else (d - 0x10000 if d >= 0x8000 else d)
    return prefix


def resample(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: int = 0, buckets: int = BUCKETS, target: int = TARGET) -> DataFrame:
    """``docs`` with log_weight (of the whole text), probability (of being good) and selected."""
    small_batches(docs.sparkSession)
    docs = docs.drop("log_weight", "probability", "selected")
    sample = labelled_sample(labels, id_col, label_col, target)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    half = (ts.mix(sample[0].view(np.uint64)) & np.uint64(1)).astype(bool)
    weights = fit_weights(plain, (sample[0][half], sample[1][half]), buckets)
    shared = docs.sparkSession.sparkContext.broadcast(((sample[0][~half], sample[1][~half]), weights))

    def score(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        total, size = [], []
        for _, data, off in ts.pieces(texts):
            g, r = ngrams(ts.Words(data, off), buckets)
            n = len(off) - 1
            total.append(np.bincount(r, weights=shared.value[1][g.astype(np.int64)], minlength=n))
            size.append(np.bincount(r, minlength=n))
        return (np.concatenate(total), np.concatenate(size)) if total else (np.zeros(0), np.zeros(0))

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = _labels_of(batch.column(0), *shared.value[0])
            batch, label = batch.filter(pa.array(label >= 0)), label[label >= 0]
            if batch.num_rows:
                total, size = score(batch.column(1))
                yield pa.record_batch([pa.array(total / (size + PRIOR)), pa.array(label)], names=["x", "y"])

    # one row for each document of the bounded sample
    seen = np.array([tuple(r) for r in plain.mapInArrow(learn, "x double, y long").collect()] or np.zeros((0, 2)))
    slope, intercept = (0.0, 40.0) if len(np.unique(seen[:, 1])) < 2 else fit_curve(seen[:, 0], seen[:, 1])
    at = docs.columns.index(text_col)

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, size = score(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total), pa.array(size)], names=[*batch.schema.names, "log_weight", "size"])

    schema = docs.withColumn("log_weight", F.lit(0.0)).withColumn("size", F.lit(0).cast("long")).schema
    scored = docs.mapInArrow(judge, schema)
    odds = F.lit(slope) * F.col("log_weight") / (F.col("size") + PRIOR) + F.lit(intercept)
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), 11) + F.lit(0.5)) * F.lit(2.0**-53)
    # the k-th largest is sought among whole numbers: odds and noise, in units of 2^-40
    key = F.floor((F.greatest(F.least(odds, F.lit(1e6)), F.lit(-1e6)) - F.log(-F.log(uniform))) * F.lit(2.0**40)).cast("long")
    keyed = scored.withColumn("probability", 1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(700.0)), F.lit(-700.0))))).withColumn("_key", key)
    keys = checkpoint(keyed.select(F.col("_key").alias("key"), "probability"))
    n, expected = keys.agg(F.count("*"), F.sum("probability")).first()
    k = min(n, round(expected or 0))
    cut = _kth_largest(keys.select("key"), k) if 0 < k < n else (-(2**63) if k else 2**63 - 1)
    return keyed.withColumn("selected", F.col("_key") >= F.lit(cut)).drop("_key", "size")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "log_weight", "probability", F.col("selected").alias("kept"))
