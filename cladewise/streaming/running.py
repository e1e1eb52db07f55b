"""Structured Streaming over traces and clades that are still being written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def stream(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_summary(trace: DataFrame) -> DataFrame:
    """Count, mean and deviation of each chain so far; for outputMode('complete' or 'update')."""
    return trace.groupBy("chain").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def running_clade_counts(clades: DataFrame) -> DataFrame:
    return clades.groupBy("clade").agg(F.count("*").alias("tree_count"))


def windowed_summary(trace: DataFrame, time: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Mean of each chain in tumbling windows; rows later than the watermark are left out."""
    return trace.withWatermark(time, late).groupBy(F.window(time, length), "chain").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
