"""The corpus pipeline: five operators in a row over ``documents``.

Quality classifier, near-duplicates, benchmark decontamination, personal data, piece ids.
Each stage works on all that its predecessor kept and returns the columns of
``documents``; the last adds ``ids``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.decontaminate import find_leaks, leaked
from llm.importance import resample
from llm.keys import add_key, written
from llm.pieces import encode
from llm.superminhash import near_duplicates
from llm.surrogates import replace_personal_data


#: Documents with a smaller fitted probability of being good are dropped.
LEAST_PROBABILITY = 0.5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are at least as likely good as bad; the draw of operator 9 plays no part."""
    found = resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.where(F.col("probability") >= LEAST_PROBABILITY).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies (five words, similarity of 0.8)."""
    keyed, unique = add_key(docs, "doc_id", "text", "_key")
    groups = near_duplicates(keyed, "_key", "text")
    kept = keyed.join(groups.where("kept").select(F.col("id").alias("_key")), "_key", "left_semi")
    return (kept if unique else kept.dropDuplicates(["_key"])).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(~leaked()).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts surrogates in place of personal data; ``n_chars``, if there, counts the new text."""
    out = replace_personal_data(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_replaced") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the piece ids of each text, as checked by decoding them."""
    return encode(docs, check_col="round_trip")


#: (name, function) of each stage; a function takes (spark, docs, sf_dir).
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("sentencepiece", sentencepiece),
]

#: The fitted weights, signatures and keyed surrogates can't be stated in SQL; tests hold each stage against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is cut off from its lineage before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
