"""Whole tree files (file, text) and their format; trees are read by ``tokens``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def tree_format(text: Column) -> Column:
    """nexus, phyloxml or newick by the first characters; unknown for others."""
    head = F.substring(F.ltrim(text), 1, 200)
    return F.when(head.rlike("(?i)^#nexus"), "nexus").when(head.rlike("(?i)<phyloxml|^<"), "phyloxml").when(head.rlike(r"^[(]|^[\w']+;"), "newick").otherwise("unknown")
