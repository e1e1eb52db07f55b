"""Sharding by rendezvous hashing of stable record keys over weighted shards (operator 12).

Every shard draws a number for a record's key, ``-ln(u) / weight`` with ``u`` from a digest of seed, key and shard, and the
smallest draw takes the record (the smaller shard on a tie). A record's draws at the other shards don't depend on a
further one, so one more shard takes records only into itself, and shards hold records in proportion to their
weights. The law is ``key``: key and shards alone decide, whatever the text; equal texts under different keys may lie in
different shards and are found by ``text_crc32`` and ``size``. Slots number a shard's records in the order of their winning draws, which mixes the
records of a shard, then by key.

A null key counts as the empty text; records with one key share a shard and have neighbouring slots; a null text has size 1
and the CRC of the empty text. Empty tables give empty results. Columns of ``keep`` are carried along, except those that
have a result's name. Everything is made of DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.order import Scratch, numbered

SHARDS = 16
SEED = "rendezvous"
RESULTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def draws(key: Column, weights: Sequence[float], seed: str = SEED) -> Column:
    """An array of (draw, shard), one for each shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("shards need positive weights")

    def draw(weight: Column, shard: Column) -> Column:
        digest = F.md5(F.concat(F.lit(f"{seed}:"), key, F.lit(":"), shard.cast("string")))
        u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)
        return F.struct((-F.log(u) / weight).alias("draw"), shard.alias("shard"))

    return F.transform(F.array(*(F.lit(float(w)) for w in weights)), draw)


def assign(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", weights: Sequence[float] = (1.0,) * SHARDS, grown: float = 1.0, seed: str = SEED, keep: Sequence[str] = ()) -> DataFrame:
    """One row for each record: id, size, text_crc32, law, shard, slot, grown_shard (with one more shard of weight ``grown``)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    carried = [c for c in keep if c != id_col and c not in RESULTS]
    drawn = docs.select(id_col, *carried, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), draws(key, [*weights, grown], seed).alias("_draws"))
    best = F.array_min(F.slice("_draws", 1, len(weights)))
    placed = drawn.withColumn("_best", best).select(
        id_col, *carried, "size", "text_crc32", F.lit("key").alias("law"), F.col("_best.shard").alias("shard"), F.array_min("_draws").shard.alias("grown_shard"), F.col("_best.draw").alias("_draw")
    )
    order = [F.col("_draw"), F.asc_nulls_first(id_col), F.col("text_crc32"), F.col("size")]
    return numbered(Scratch(docs.sparkSession), placed, order, "slot", by="shard").select(id_col, *carried, *RESULTS)


def manifest(assigned: DataFrame) -> DataFrame:
    """Of each shard: rows, bytes, first and last slot, and a sum of the texts' CRCs that a reader can check."""
    return assigned.groupBy("shard").agg(
        F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.bit_xor("text_crc32").alias("crc_xor")
    )


def write_shards(assigned: DataFrame, path: str) -> None:
    """Parquet folders ``shard=N``, each file holding a run of slots in order."""
    assigned.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
