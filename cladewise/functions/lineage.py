"""Cutting lineage in iterative plans, and ranks over whole tables without one big task."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only in local mode."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    _folder(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Parquet tables of one run in the shared folder."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root = spark, f"{_folder(spark)}/run-{uuid.uuid4().hex}"

    def write(self, name: str, df: DataFrame, *by: str) -> DataFrame:
        df.write.partitionBy(*by).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")


def ranked(df: DataFrame, order: list, name: str, running: dict[str, str] | None = None) -> DataFrame:
    """``df`` with its rank by ``order`` from 1, and running sums (new column: column) in that order.

    Rows are dealt out by ranges of the order and numbered within them; the ranges' counts and
    sums, one row for each range, give the offsets.
    """
    running = running or {}
    dealt = checkpoint(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    within = Window.partitionBy("_range").orderBy(*order)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("_range").agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_s_{k}") for k, c in running.items()))
    offsets = ranges.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), *(F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_s_{k}") for k in running))
    rows = dealt.join(F.broadcast(offsets), "_range")
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    sums = {k: F.col(f"_s_{k}") + F.sum(c).over(upto) for k, c in running.items()}
    return rows.withColumns({name: (F.row_number().over(within) + F.col("_n")).cast("int")} | sums).drop("_range", "_n", *(f"_s_{k}" for k in running))
