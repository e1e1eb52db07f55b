"""Target-distribution importance resampling (operator 11).

Features are runs of up to ``longest`` words of a text, lower-cased and joined by one space; a feature's bucket is
the CRC-32 of its bytes modulo ``buckets``. The features of a batch are made different first, grouped by length into
two-dimensional byte arrays, and the CRCs of a group go on together column by column (``llm.distinct``). Counts of the
buckets in the corpus and in the target texts give each bucket a gain in thousandths of a natural logarithm; a document's
weight is the floored mean gain of its features. Gumbel noise from a digest of seed and id makes the
draw of the highest scores one without replacement in proportion to the exponential of the weights.

Null texts have no words, and a document without features has weight 0; a null id counts as the empty text in the digest
and comes last among ties; repeated ids share their noise, and equal rows are drawn one by one. Empty tables give
empty results; without target texts the gains are those of the smoothing alone. Only id and text are
read, so further columns never clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import textscan as ts
from llm.distinct import crc32, distinct, parts
from llm.keys import small_batches
from llm.order import Scratch, numbered

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10


def _joined(data: np.ndarray, words: ts.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, stop) of the words, lower-cased, with one space after each."""
    length = words.stop - words.start
    stop = np.cumsum(length + 1) - 1
    start = stop - length
    out = np.full(int(stop[-1]) + 1 if len(stop) else 0, 32, np.uint8)
    inside = np.arange(int(length.sum())) + np.repeat(start - np.cumsum(length) + length, length)
    source = np.arange(int(length.sum())) + np.repeat(words.start - np.cumsum(length) + length, length)
    out[inside] = ts.LOWER[data[source]]
    return out, start, stop


def features(texts: pa.Array, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, row) of all features and the row of each word, for some rows or part of a long one at a time."""
    for first, data, off, own in parts(texts, ts.NON_WORD, longest - 1):
        words = ts.Words(data, off, separators=ts.NON_WORD)
        mine = words.start < own
        if longest == 1:
            data = ts.LOWER[data]
            hashes, start, stop, row = words.hash, words.start, words.stop, words.row
        else:
            data, begin, end = _joined(data, words)
            sums = ts.prefix_hashes(data)
            runs = []
            for k in range(1, longest + 1):
                i = np.flatnonzero(mine[: len(mine) - k + 1] & (words.row[: len(mine) - k + 1] == words.row[k - 1 :]))
                runs.append((i, i + k - 1))
            i, j = (np.concatenate(x) for x in zip(*runs))
            start, stop, row = begin[i], end[j], words.row[i]
            hashes = ts.span_hashes(sums, start, stop)
        one, kind = distinct(data, hashes, start, stop)
        bucket = crc32(data, start[one], stop[one]).astype(np.int64) % buckets
        yield bucket[kind], first + row, first + words.row[mine]


def count_buckets(texts: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Number of features in each bucket over the one text column of ``texts``."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for bucket, _, _ in features(batch.column(0), longest, buckets):
                n += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(n)
        yield pa.record_batch([pa.array(used), pa.array(n[used])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandfold logarithm of the smoothed ratio of shares, in doubles."""
    all_s, all_t = float(corpus.sum()), float(target.sum())
    b = len(corpus)
    ratio = (target + 1.0) * (all_s + b) / ((corpus + 1.0) * (all_t + b))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, longest: int = 1) -> DataFrame:
    """(id, n_words, n_features, weight) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    plain = docs.select(F.col(id_col), F.col(text_col))
    schema = plain.select(id_col).withColumns({c: F.lit(0).cast("long") for c in ("n_words", "n_features", "weight")}).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for bucket, row, word_row in features(batch.column(1), longest, len(gain)):
                n_words += np.bincount(word_row, minlength=batch.num_rows)
                n_features += np.bincount(row, minlength=batch.num_rows)
                total += np.bincount(row, weights=shared.value[bucket], minlength=batch.num_rows).astype(np.int64)
            weight = total // np.maximum(n_features, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, n_features, weight))], names=schema.names)

    return plain.mapInArrow(run, schema)


def resample(
    docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", seed: int = SEED, longest: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT
) -> DataFrame:
    """One row for each document: id, n_words, n_features, weight, score, rank (from 1; null where not drawn)."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    gain = gains(count_buckets(docs.select(text_col), longest, buckets), count_buckets(target.select(target_col), longest, buckets))
    weighed = weigh(docs, gain, id_col, text_col, longest)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    scored = scratch.write("scores", weighed.withColumn("score", F.col("weight") + noise).withColumn("_can", F.col("n_words") >= least_words))
    n = scored.where("_can").count()
    placed = numbered(scratch, scored, [F.desc("_can"), F.desc("score"), F.asc_nulls_last(id_col)], "_place")
    rank = F.when(F.col("_can") & (F.col("_place") < percent * n // 100), F.col("_place") + 1)
    return placed.select(id_col, "n_words", "n_features", "weight", "score", rank.alias("rank"))


def op11_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
