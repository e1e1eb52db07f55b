"""Quality rules with an n-gram log-likelihood ratio (operator 4), in DataFrame functions only.

Words and pairs of neighbouring words are hashed into ``buckets``. Their counts over the
trusted texts and over the whole corpus are two multinomials; a document's score is the sum
of its n-grams' log-likelihood ratios over their number plus ``PRIOR``, which draws short
texts to 0. A document fails if its score is below the threshold. All documents are counted,
scored and judged, and all texts labelled good are trusted. Half of them (by a hash of their id) make the
trusted counts; the threshold is the ``QUANTILE`` of the scores of the other half, which like any
other text are not in those counts: the score of that rank, found by counting digits, down to 2^-40.

Beside the score stand plain figures of each text: words and their characters, symbols,
lines equal to an earlier line, and words in 8-word windows that occur more than once.

Null and empty texts have no words and fail the base rules; very long texts are treated
whole; ids may be null (never trusted) or repeat (each row counts and is judged on its
own); repeated labels count once; without trusted texts all scores are 0 and pass; empty
tables give empty results; further columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.importance import _kth_largest
from llm.keys import checkpoint, written

BUCKETS = 10_000
PRIOR = 10
QUANTILE = 0.005
WINDOW = 8
_WHITE = " \t\n\x0b\x0c\r"


def word_array(text: Column) -> Column:
    """Runs of characters other than ASCII white space; an empty array for none."""
    trimmed = F.btrim(text, F.lit(_WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def with_ngrams(docs: DataFrame) -> DataFrame:
    """Adds ``words``, their hashes ``w1``, and the hashes ``w2`` of each word with the next (the last alone)."""
    return (
        docs.withColumn("words", word_array(F.col("text")))
        .withColumn("w1", F.transform("words", lambda w: F.xxhash64(w)))
        .withColumn("w2", F.zip_with("w1", F.slice("w1", 2, F.greatest(F.size("w1"), F.lit(1))), lambda a, b: F.xxhash64(a, b)))
    )


def grams() -> Column:
    return F.concat("w1", F.slice("w2", 1, F.greatest(F.size("w2") - 1, F.lit(0))))


def repeated_words(docs: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words`` to the rows of :func:`with_ngrams`."""
    tail = lambda c, k: F.slice(c, k + 1, F.greatest(F.size(c), F.lit(1)))
    docs = docs.withColumn("w4", F.zip_with("w2", tail("w2", 2), lambda a, b: F.xxhash64(a, b)))
    docs = docs.withColumn("w8", F.slice(F.zip_with("w4", tail("w4", 4), lambda a, b: F.xxhash64(a, b)), 1, F.greatest(F.size("w4") - (WINDOW - 1), F.lit(0))))
    docs = docs.withColumn("twice", F.size(F.array_distinct("w8")) < F.size("w8"))
    none = F.array()
    sort = F.sort_array(F.transform("w8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    docs = docs.withColumn("runs", F.when(F.col("twice"), sort).otherwise(none.cast("array<struct<h:bigint,i:int>>")))
    docs = docs.withColumn("next", F.zip_with("runs", tail("runs", 1), lambda a, b: F.coalesce(a.h == b.h, F.lit(False))))
    docs = docs.withColumn("prev", F.concat(F.array(F.lit(False)), F.col("next")))
    marked = F.zip_with(F.zip_with("runs", "next", lambda a, e: F.struct(a.i.alias("i"), e.alias("e"))), F.slice("prev", 1, F.size("runs")), lambda a, p: F.when(a.e | p, a.i))
    docs = docs.withColumn("at", F.sort_array(F.filter(marked, lambda i: i.isNotNull())))
    steps = F.zip_with("at", tail("at", 1), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    return docs.withColumn("n_repeat_words", F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The ids of all trusted texts."""
    return labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()


def _half() -> Column:
    """The half that a trusted id belongs to."""
    return F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2))


def fit_ratio(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """The log-likelihood ratio of each bucket, from all documents (doc_id, text) and those of half 0 that are trusted."""
    docs = docs.withColumn("_half", _half())
    # texts of the other half need not meet the ids; a hash join by shuffle sends no ids to all tasks and sorts no texts
    met = docs.where("_half = 0").join(trusted.withColumn("trusted", F.lit(1)).hint("shuffle_hash"), "doc_id", "left")
    marked = met.unionByName(docs.where("_half = 1").withColumn("trusted", F.lit(0)))
    counted = (
        with_ngrams(marked)
        .select(F.coalesce("trusted", F.lit(0)).alias("trusted"), F.explode(grams()).alias("g"))
        .groupBy(F.pmod("g", F.lit(buckets)).alias("bucket"))
        .agg(F.sum("trusted").alias("trusted"), F.count("*").alias("raw"))
    )
    counted = checkpoint(counted)  # read twice, one row for each bucket
    all_buckets = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(counted, "bucket", "left").fillna(0)
    total = counted.agg(F.coalesce(F.sum("trusted"), F.lit(0)).alias("t"), F.coalesce(F.sum("raw"), F.lit(0)).alias("r")).first()
    if not total.t:
        return [0.0] * buckets
    ratio = F.log((F.col("trusted") + 0.5) / F.lit(total.t + 0.5 * buckets)) - F.log((F.col("raw") + 0.5) / F.lit(total.r + 0.5 * buckets))
    return [r[0] for r in all_buckets.select("bucket", ratio.alias("ratio")).orderBy("bucket").select("ratio").collect()]


def ratio_score(ratio: list[float]) -> Column:
    """The score of rows of :func:`with_ngrams`."""
    table = F.from_json(F.lit(json.dumps(ratio)), "array<double>")
    buckets = len(ratio)
    total = F.aggregate("grams", F.lit(0.0), lambda acc, g: acc + F.get(table, F.pmod(g, F.lit(buckets)).cast("int")))
    return total / (F.size("grams") + F.lit(PRIOR))


def _quantile(scores: DataFrame, q: float) -> float | None:
    """The value of ``score`` at the rank of the quantile, in units of 2^-40."""
    keys = checkpoint(scores.select(F.floor(F.col("score") * F.lit(2.0**40)).cast("long").alias("key")))
    n = keys.count()
    return _kth_largest(keys, n - int(q * (n - 1))) * 2.0**-40 if n else None


def quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, figures, score, threshold, base_failed, kept) for each row of ``docs``."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    trusted = checkpoint(trusted_ids(labels).select(F.col("doc_id").cast(docs.schema["doc_id"].dataType)))
    ratio = fit_ratio(docs, trusted.where(_half() == 0), buckets)
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_WHITE)) != "")
    scored = with_ngrams(docs).withColumn("grams", grams()).withColumn("score", ratio_score(ratio))
    out = repeated_words(scored).withColumn("lines", lines)
    out = out.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.translate("text", _WHITE, "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        "score",
    )
    out = written(out)  # figures alone, for the threshold and the result
    threshold = _quantile(out.where(_half() == 1).join(trusted.hint("shuffle_hash"), "doc_id", "left_semi"), QUANTILE)
    threshold = min(0.0, threshold) if threshold is not None else 0.0
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
