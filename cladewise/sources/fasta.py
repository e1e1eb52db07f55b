"""FASTA records of any lengths from files of any size, their problems, and their repair.

Lines are read in splits; records are numbered by running counts within the splits, so no task holds a file
that can be split. A sequence is one value. Rows are (file, record, identifier, sequence), records numbered from 1 in each file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladewise.functions.lineage import Scratch

NUCLEOTIDES = "ACGNRYSWKMBDHV"
#: Letters of each kind of sequence; gaps and '?' fit all.
LETTERS = {"dna": NUCLEOTIDES + "T", "rna": NUCLEOTIDES + "U", "protein": "ABCDEFGHIKLMNPQRSTVWXYZ*"}
_SUPPORTED = "ABCDEFGHIKLMNPQRSTUVWXYZ*"
#: Records of a file among which names are numbered in one task.
_RUN = 65536


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, text): lines that aren't blank, without white space at their ends; ``at`` grows along a file."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().bitwiseAND(2**33 - 1).alias("_row"), "value")
    text = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    return rows.select("file", F.struct("_block", "_row").alias("at"), text.alias("text")).where("text <> ''")


def _numbered(lines: DataFrame) -> DataFrame:
    """Lines with ``record``, the number of headers of the file up to them (0 before the first).

    Headers are counted within each split of a file, and the splits' counts, one row for each, give the offsets.
    """
    rows = lines.withColumns({"_block": F.col("at._block"), "_head": F.col("text").startswith(">").cast("long")})
    earlier = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("file", "_block").agg(F.sum("_head").alias("_n")).select("file", "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    upto = Window.partitionBy("file", "_block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("_heads", F.sum("_head").over(upto)).join(splits.hint("merge"), ["file", "_block"])
    return run.select("file", "at", "text", (F.col("_heads") + F.col("_before")).alias("record"))


def records(lines: DataFrame) -> DataFrame:
    """(file, record, identifier, sequence) of :func:`read_lines`.

    Repeated identifiers and empty sequences stay. The identifier is the whole header. Lines before the first header
    belong to no record: see :func:`file_problems`.
    """
    rows = _numbered(lines).where("record > 0")
    head = F.col("text").startswith(">")
    parts = F.sort_array(F.collect_list(F.when(~head, F.struct("at", "text"))))
    of = rows.groupBy("file", "record").agg(F.max(F.when(head, F.expr("substring(text, 2)"))).alias("_head"), parts.alias("_parts"))
    return of.select("file", "record", F.regexp_replace("_head", r"(?U)^\s+", "").alias("identifier"), F.array_join(F.transform("_parts", lambda p: p.text), "").alias("sequence"))


def file_problems(spark: SparkSession, path: str) -> DataFrame:
    """(file, problem): 'no records', or 'sequence before any header'; files without problem are left out.

    Readers skip files of no bytes, so the names come from the list of files that the driver makes for a read anyway.
    """
    heads = F.col("text").startswith(">")
    plain = F.regexp_replace("file", "^file:/+", "file:///")
    first = read_lines(spark, path).withColumn("file", plain).groupBy("file").agg(F.min_by("text", "at").startswith(">").alias("_ok"), F.bool_or(heads).alias("_any"))
    files = spark.createDataFrame([(f,) for f in spark.read.text(path).inputFiles()], "file string").withColumn("file", plain)
    problem = F.when(~F.coalesce("_ok", F.lit(True)), "sequence before any header").when(~F.coalesce("_any", F.lit(False)), "no records")
    return files.join(first, "file", "left").select("file", problem.alias("problem")).where("problem is not null")


def _observed(sequence: Column) -> Column:
    return F.upper(F.regexp_replace(sequence, r"[-?]", ""))


def _within(letters: str) -> Column:
    return _observed(F.col("sequence")).rlike(f"^[{letters}]*$")


def file_kinds(rows: DataFrame) -> DataFrame:
    """(file, kind): 'dna', 'rna' or 'protein', what all records may be; 'mixed' without such a kind, 'invalid' with a letter of none.

    Letters that only proteins have make it protein, U without T rna; otherwise the first of dna, rna, protein that fits.
    """
    seen = _observed(F.col("sequence"))
    fits = {k: _within(v) for k, v in LETTERS.items()}
    bad = ~(fits["dna"] | fits["rna"] | fits["protein"])
    of = rows.groupBy("file").agg(
        F.bool_or(bad).alias("bad"), *(F.bool_and(c).alias(k) for k, c in fits.items()), F.bool_or(seen.contains("T")).alias("t"), F.bool_or(seen.contains("U")).alias("u"), F.bool_or(seen.rlike("[EFILPQXZ*]")).alias("signal")
    )
    fitting = F.coalesce(*(F.when(F.col(k), k) for k in LETTERS))
    kind = F.when(F.col("bad"), "invalid").when(fitting.isNull(), "mixed").when(F.col("signal"), "protein").when(F.col("u") & ~F.col("t"), "rna").otherwise(fitting)
    return of.select("file", kind.alias("kind"))


def _illegal(kind: Column) -> Column:
    """Residues that ``kind`` does not allow; of another kind's name, those that none does."""
    allowed = F.lit(f"[-?{_SUPPORTED}{_SUPPORTED.lower()}]")
    for k, letters in LETTERS.items():
        allowed = F.when(kind == k, F.lit(f"[-?{letters}{letters.lower()}]")).otherwise(allowed)
    return F.regexp_replace(F.col("sequence"), allowed, F.lit(""))


def illegal_characters(rows: DataFrame, kind: str | None = None) -> DataFrame:
    """(file, record, identifier, position, character) of residues that the kind, given or found, does not allow."""
    if kind is None:
        rows = Scratch(rows.sparkSession).write("records", rows)  # read twice, made once
    named = rows.join(file_kinds(rows).hint("merge"), "file") if kind is None else rows.withColumn("kind", F.lit(kind))
    bad = named.where(_illegal(F.col("kind")) != "")
    cells = bad.select("file", "record", "identifier", "kind", F.posexplode(F.split("sequence", "")).alias("position", "character")).withColumn("sequence", F.col("character"))
    return cells.where(_illegal(F.col("kind")) != "").select("file", "record", "identifier", (F.col("position") + 1).alias("position"), "character")


def normal_identifier(identifier: str = "identifier") -> Column:
    """Letters, digits, '.', '_' and '-' stay, runs of others become one '_', ends lose '.', '_' and '-'; 'sequence' if nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(identifier, r"[^\p{L}\p{N}._-]", "_"), "_{2,}", "_")
    text = F.regexp_replace(clean, r"^[._-]+|[._-]+$", "")
    return F.when(text == "", "sequence").otherwise(text)


def repair(rows: DataFrame, kind: str | None = None, *, normalize: bool = True, remove: bool = False) -> DataFrame:
    """(file, record, identifier, repaired, reason, note, sequence): every record, kept or with the reason of its removal.

    ``remove`` takes out empty records, those with characters that the kind (given, or that of the file) does not allow, and those
    whose letters fit another kind than the given one. ``normalize`` mends identifiers (:func:`normal_identifier`); the k-th record
    of one mended identifier in the file, k > 1, gets '_k' behind it, counted among kept records in file order. Without a given kind the
    records of a file of mixed kinds are all removed as 'conflicting-types'.
    """
    if kind is not None and kind not in LETTERS:
        raise ValueError(f"no such kind of sequence: {kind}")
    scratch = Scratch(rows.sparkSession)
    if kind is None:
        rows = scratch.write("records", rows)
    named = rows.join(file_kinds(rows).hint("merge"), "file") if kind is None else rows.withColumn("kind", F.lit(kind))
    fits = [_within(v) for v in LETTERS.values()]
    reasons = []
    if remove:
        reasons = [F.when(F.col("sequence") == "", "empty-sequence"), F.when(_illegal(F.col("kind")) != "", "illegal-characters")]
        if kind is not None:
            reasons.append(F.when((fits[0] | fits[1] | fits[2]) & ~_within(LETTERS[kind]), "sequence-type-mismatch"))
    joined = F.concat_ws("+", *reasons) if reasons else F.lit("")
    reason = F.when(F.col("kind") == "mixed", "conflicting-types").otherwise(F.nullif(joined, F.lit("")))
    marked = named.withColumn("reason", reason).withColumn("_name", normal_identifier() if normalize else F.col("identifier")).drop("kind")
    if normalize:
        group = ["file", "_name", "_run"]
        marked = scratch.write("marked", marked).withColumns({"_run": F.floor(F.col("record") / _RUN), "_one": F.col("reason").isNull().cast("long")})
        earlier = Window.partitionBy("file", "_name").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
        runs = marked.groupBy(*group).agg(F.sum("_one").alias("_n")).select(*group, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
        upto = Window.partitionBy(*group).orderBy("record").rowsBetween(Window.unboundedPreceding, 0)
        marked = marked.withColumn("_upto", F.sum("_one").over(upto)).join(runs.hint("merge"), group).withColumn("_k", F.col("_upto") + F.col("_before"))
    else:
        marked = marked.withColumn("_k", F.lit(1).cast("long"))
    repaired = F.when(F.col("reason").isNull(), F.concat("_name", F.when(F.col("_k") > 1, F.concat(F.lit("_"), F.col("_k").cast("string"))).otherwise("")))
    note = F.when(F.col("_k") > 1, "normalized identifier and resolved duplicate collision").otherwise("normalized identifier")
    out = marked.withColumn("repaired", repaired)
    return out.select("file", "record", "identifier", "repaired", "reason", F.when(F.col("repaired") != F.col("identifier"), note).alias("note"), "sequence")


def alignment_problems(rows: DataFrame) -> DataFrame:
    """(file, problem, detail): repeated identifiers, and unequal lengths with the least and the greatest; a file without rows is an alignment."""
    names = rows.groupBy("file", "identifier").agg(F.count("*").alias("n"), F.min(F.length("sequence")).alias("lo"), F.max(F.length("sequence")).alias("hi"))
    names = Scratch(rows.sparkSession).write("names", names)  # read twice, made once
    repeated = names.where("n > 1").select("file", F.lit("duplicate identifier").alias("problem"), F.col("identifier").alias("detail"))
    spans = names.groupBy("file").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi")
    return repeated.unionByName(spans.select("file", F.lit("unequal lengths").alias("problem"), F.concat_ws("-", F.col("lo").cast("string"), F.col("hi").cast("string")).alias("detail")))
