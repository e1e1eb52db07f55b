"""One 64-bit order key for each document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_KEY = -(2**63)
#: Rows that go to a Python worker at a time; with texts of some kilobytes Spark's usual number takes tens of megabytes.
BATCH_ROWS = 2048


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches, unless the session has its own bound."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def add_key(docs: DataFrame, id_col: str, text_col: str, key_col: str = "key") -> tuple[DataFrame, bool]:
    """``docs`` with a long ``key_col`` before its columns, and whether the ids are unique.

    The key orders documents as their ids do (null first). It is the id itself where ids
    are unique; where some repeat, different texts under one id get neighbouring keys in
    the order of a text hash, and equal texts under one id share a key.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(key_col)
    plain = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_KEY))
    twice = docs.groupBy(id_col).count().where("count > 1").limit(1).count()
    if not twice:
        return docs.select(plain.alias(key_col), "*"), True
    tie = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    tagged = docs.withColumn("_plain", plain).withColumn("_tie", tie)
    order = tagged.select("_plain", "_tie").distinct().sort("_plain", "_tie")
    numbered = docs.sparkSession.createDataFrame(
        order.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1])), f"_plain long, _tie long, {key_col} long"
    )
    return tagged.join(numbered, ["_plain", "_tie"]).select(key_col, *docs.columns), False


def with_key(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(key, id, text) of :func:`add_key`, null text as empty."""
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return add_key(plain, "id", "text")


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder of spark.checkpoint.dir; a temporary one only in local mode."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As :func:`checkpoint`, through Parquet files in the same folder (smaller, and read by column)."""
    import uuid

    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        checkpoint(df.sparkSession.range(0))
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys with more than one in so many of the rows are hot, and so at most so many are.
SHARE = 2000


def spread_join(rows: DataFrame, stats: DataFrame, on: list[str], n: str, least: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with ``stats``, one checkpointed row for each key, ``n`` being the key's number of rows.

    The rows of a hot key (more than ``least``, and one in ``SHARE``) stay where they are, and what belongs to it goes
    to all of them: at most ``SHARE`` rows are broadcast. The others meet by their key.
    """
    total, most = stats.agg(F.sum(n), F.max(n)).first()
    cut = max(least, (total or 0) // SHARE)
    if (most or 0) <= cut:
        return rows.join(stats, on)
    hot, rest = stats.where(F.col(n) > cut), stats.where(F.col(n) <= cut)
    own = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on)
    return rows.join(F.broadcast(hot), on).unionByName(own)
