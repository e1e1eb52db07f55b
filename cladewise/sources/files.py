"""Readers of alignments, tables, traces and partitions, and their writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(aln_id, ord, taxon, seq): one alignment per file; ragged and empty records are kept."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("aln_id"), F.posexplode(F.split("value", r"(?m)^>")).alias("ord", "record"))
    rows = files.where("ord > 0")
    head = F.regexp_extract("record", r"^([^\r\n]*)", 1)
    return rows.select("aln_id", "ord", F.regexp_extract(head, r"^\s*(\S*)", 1).alias("taxon"), F.regexp_replace(F.regexp_replace("record", r"^[^\r\n]*", ""), r"\s+", "").alias("seq"))


def fasta_problems(records: DataFrame) -> DataFrame:
    """(aln_id, problem, taxon): repeated names, empty records, lengths other than the most common."""
    w = Window.partitionBy("aln_id")
    repeated = records.groupBy("aln_id", "taxon").agg(F.count("*").alias("n")).where("n > 1").select("aln_id", F.lit("repeated").alias("problem"), "taxon")
    empty = records.where("seq = ''").select("aln_id", F.lit("empty").alias("problem"), "taxon")
    lengths = records.withColumn("len", F.length("seq")).withColumn("usual", F.mode("len").over(w))
    ragged = lengths.where("len <> usual and len > 0").select("aln_id", F.lit("length").alias("problem"), "taxon")
    return repeated.unionByName(empty).unionByName(ragged)


def write_fasta(records: DataFrame, path: str) -> None:
    records.select(F.concat(F.lit(">"), "taxon", F.lit("\n"), "seq")).write.text(path)


def read_taxon_table(spark: SparkSession, path: str, taxon_column: str | None = None) -> DataFrame:
    """Delimited table, all strings and trimmed, the key column first as ``taxon``; missing cells are ''."""
    sep = "\t" if path.rstrip("/").endswith((".tsv", ".txt")) else ","
    raw = spark.read.csv(path, header=True, sep=sep, inferSchema=False)
    names = raw.columns
    key = taxon_column or next((c for c in ("taxon", "taxa", "tip", "name", "species", "label", "id") if c in [n.lower() for n in names]), names[0])
    key = next(n for n in names if n.lower() == key.lower())
    return raw.select(F.trim(F.coalesce(F.col(f"`{key}`"), F.lit(""))).alias("taxon"), *[F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in names if c != key])


def write_taxon_table(rows: DataFrame, path: str, sep: str = "\t") -> None:
    text = [F.when(F.col(c).isNull(), "").otherwise(F.lower(F.col(c).cast("string")) if t == "boolean" else F.col(c).cast("string")).alias(c) for c, t in rows.dtypes]
    rows.select(*text).write.csv(path, header=True, sep=sep)


def read_distances(spark: SparkSession, path: str) -> DataFrame:
    """(aln_id, left, right, distance) of a long distance table."""
    raw = read_taxon_table(spark, path, "left_identifier")
    return raw.select(F.lit(0).cast("long").alias("aln_id"), F.least("taxon", "right_identifier").alias("left"), F.greatest("taxon", "right_identifier").alias("right"), F.expr("try_cast(distance AS DOUBLE)").alias("distance"))


def read_beast_log(spark: SparkSession, path: str) -> DataFrame:
    """(chain, iteration, parameter, value) of a tab-separated log with '#' comments."""
    wide = spark.read.csv(path, sep="\t", header=True, comment="#", inferSchema=True)
    first, *rest = wide.columns
    long = wide.select(F.col(f"`{first}`").cast("long").alias("iteration"), *[F.col(f"`{c}`").cast("double").alias(c) for c in rest])
    return long.unpivot(["iteration"], [F.col(f"`{c}`") for c in rest], "parameter", "value").withColumn("chain", F.lit(0).cast("long"))


def read_mrbayes_trace(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read_beast_log`, with a first line '[ID: ...]'."""
    wide = spark.read.csv(path, sep="\t", header=True, comment="[", inferSchema=True)
    first, *rest = wide.columns
    long = wide.select(F.col(f"`{first}`").cast("long").alias("iteration"), *[F.col(f"`{c}`").cast("double").alias(c) for c in rest])
    return long.unpivot(["iteration"], [F.col(f"`{c}`") for c in rest], "parameter", "value").withColumn("chain", F.lit(0).cast("long"))


def read_partitions(spark: SparkSession, path: str) -> DataFrame:
    """(type, locus, start, stop, step) of lines such as 'DNA, gene = 1-300\\3, 400-500'."""
    lines = spark.read.text(path).where("trim(value) <> '' and not value like '#%'")
    head = r"^\s*(?:charset\s+)?(?:([A-Za-z]+)\s*,)?\s*([\w.-]+)\s*=\s*(.*?);?\s*$"
    rows = lines.select(F.upper(F.regexp_extract("value", head, 1)).alias("type"), F.regexp_extract("value", head, 2).alias("locus"), F.explode(F.split(F.regexp_extract("value", head, 3), r"\s*,\s*|\s+(?=\d)")).alias("part"))
    part = r"^(\d+)(?:\s*-\s*(\d+))?(?:\\(\d+))?$"
    number = lambda i: F.expr(f"try_cast(regexp_extract(part, r'{part}', {i}) AS INT)")
    return rows.select("type", "locus", number(1).alias("start"), F.coalesce(number(2), number(1)).alias("stop"), F.coalesce(number(3), F.lit(1)).alias("step"))


def partition_overlaps(partitions: DataFrame) -> DataFrame:
    """Pairs of loci that share a site, and how many."""
    sites = partitions.select("locus", F.explode(F.sequence("start", "stop", "step")).alias("site")).distinct()
    a, b = sites.select(F.col("locus").alias("left"), "site"), sites.select(F.col("locus").alias("right"), "site")
    return a.join(b, "site").where("left < right").groupBy("left", "right").agg(F.count("*").alias("sites"))


def parse_support(label: str) -> tuple:
    """(first, second) support of a label such as '95.1/98', each as a fraction."""
    a = F.expr(f"try_cast(split({label}, '/')[0] AS DOUBLE)")
    b = F.expr(f"try_cast(try_element_at(split({label}, '/'), 2) AS DOUBLE)")
    scale = lambda x: F.when(x > 1, x / 100).otherwise(x)
    return scale(a), scale(b)
