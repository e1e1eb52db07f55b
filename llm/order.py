"""Positions in a global order, and tables of one run, without a task that holds all rows."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.keys import checkpoint


#: Spark's setting that removes the shuffle files of an execution at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Parquet tables of one run under spark.checkpoint.dir; those no longer needed are dropped by name.

    With ``lean`` the shuffle files behind a table go as soon as it is written; what is written must not be run again.
    """

    def __init__(self, spark: SparkSession, lean: bool = False) -> None:
        self.lean = lean
        sc = spark.sparkContext
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            checkpoint(spark.range(0))
        self.spark, self.root = spark, f"{sc._jsc.sc().getCheckpointDir().get()}/run-{uuid.uuid4().hex}"

    def write(self, name: str, df: DataFrame, mode: str = "error") -> DataFrame:
        before = self.spark.conf.get(_CLEANUP, "false")
        if self.lean:
            self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.mode(mode).option("compression", "zstd").parquet(f"{self.root}/{name}")
        finally:
            if self.lean:
                self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Removes tables; collecting garbage lets Spark's cleaner remove the shuffle files behind them, too."""
        sc = self.spark.sparkContext
        for name in names:
            path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        sc._jvm.System.gc()


def numbered(scratch: Scratch, df: DataFrame, order: list, name: str, by: str | None = None) -> DataFrame:
    """``df`` with the position from 0 in ``order`` (within each value of ``by``) as ``name``.

    Rows are dealt out by ranges of the order, sorted within them and written with their place; how many rows of a
    value earlier ranges hold is a table of one row for each range and value in it (at most ranges plus values), which goes
    to all rows.
    """
    keys = [by] if by else []
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    place = F.monotonically_increasing_id().bitwiseAND(2**33 - 1)
    dealt = scratch.write(f"order-{name}", dealt.withColumns({"_range": F.spark_partition_id(), "_place": place}))
    runs = dealt.groupBy("_range", *keys).agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    on = F.col("r._range") == F.col("s._range")
    if by:
        on &= F.col(f"r.{by}") == F.col(f"s.{by}")
    at = F.col("_place") - F.col("_first") + F.col("_before")
    return dealt.alias("r").join(F.broadcast(starts.alias("s")), on).select(*(F.col(f"r.{c}") for c in df.columns), at.alias(name))
