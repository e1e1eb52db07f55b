"""Taxon-keyed tables: predicates, joins and audits. All cells are strings; '' and null are missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladewise.functions.lineage import ranked


def taxon_key(raw: str | Column) -> Column:
    """Runs of anything but letters, digits, '.', '_' and '-' become '_'; '_' at the ends goes."""
    return F.btrim(F.regexp_replace(raw, r"[^0-9A-Za-z._-]+", "_"), F.lit("_"))


def namespace(label: str | Column) -> Column:
    """accession_id, species_name, isolate_id, sample_id or user_defined_label by a label's form, in this order."""
    c = F.trim(F.col(label) if isinstance(label, str) else label)
    return (
        F.when(c.rlike(r"^[A-Z]{1,4}_?\d{4,}(?:\.\d+)?$|^[A-Z]{2}\d{6,}(?:\.\d+)?$"), "accession_id").when(c.rlike(r"^[A-Z][a-z]+(?:[ _][a-z][a-z-]+){1,2}$"), "species_name").when(F.lower(c).rlike("isolate|strain|clone|cultivar|lineage"), "isolate_id")
        .when(F.lower(c).rlike("sample|specimen|individual|indiv|voucher") | c.rlike(r"^[A-Za-z]+[-_]\d{2,}$"), "sample_id").otherwise("user_defined_label")
    )


def namespaces(labels: DataFrame, column: str) -> DataFrame:
    return labels.groupBy(namespace(column).alias("namespace")).agg(F.count("*").alias("n"), F.countDistinct(column).alias("labels"))


def key_collisions(labels: DataFrame, column: str) -> DataFrame:
    """Different labels with one key."""
    k = labels.select(F.col(column).alias("label")).distinct().groupBy(taxon_key("label").alias("key")).agg(F.count("*").alias("labels"), F.min("label").alias("first_label"))
    return k.where("labels > 1")


def name_check(left: DataFrame, right: DataFrame) -> DataFrame:
    """Taxa on one side only (taxon, side); exact names."""
    a, b = left.select("taxon").distinct(), right.select("taxon").distinct()
    return a.join(b, "taxon", "left_anti").withColumn("side", F.lit("left_only")).unionByName(b.join(a, "taxon", "left_anti").withColumn("side", F.lit("right_only")))


def link(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full join on taxon with a status: matched, left_only, right_only."""
    a = left.select("taxon").distinct().withColumn("l", F.lit(True))
    b = right.select("taxon").distinct().withColumn("r", F.lit(True))
    return a.join(b, "taxon", "full").select("taxon", F.when(F.col("l") & F.col("r"), "matched").when(F.col("l"), "left_only").otherwise("right_only").alias("status"))


def join_to_taxa(taxa: DataFrame, rows: DataFrame) -> DataFrame:
    """Every taxon, with its row where there is one."""
    return taxa.join(rows, "taxon", "left")


def prune_to(rows: DataFrame, taxa: DataFrame) -> DataFrame:
    return rows.join(taxa.select("taxon").distinct(), "taxon", "left_semi")


def drop_taxa(rows: DataFrame, taxa: DataFrame) -> DataFrame:
    return rows.join(taxa.select("taxon").distinct(), "taxon", "left_anti")


def crosswalk(surfaces: dict[str, DataFrame]) -> DataFrame:
    """taxon x surface presence, and the number of surfaces; one aggregation instead of a chain of full joins."""
    tagged = reduce(DataFrame.unionByName, (d.select("taxon").withColumn("surface", F.lit(k)) for k, d in surfaces.items()))
    has = [F.bool_or(F.col("surface") == k).alias(f"in_{k}") for k in surfaces]
    return tagged.where("taxon is not null").groupBy("taxon").agg(*has, F.countDistinct("surface").alias("surfaces"))


def mismatches(surfaces: dict[str, DataFrame]) -> DataFrame:
    """Missing surfaces of each taxon that lacks some."""
    rows = crosswalk(surfaces)
    lacking = F.filter(F.array(*[F.when(~F.col(f"in_{k}"), F.lit(k)) for k in surfaces]), lambda x: x.isNotNull())
    return rows.select("taxon", F.array_join(lacking, "|").alias("missing")).where("missing <> ''")


def first_loss(stages: dict[str, DataFrame]) -> DataFrame:
    """The first stage (in the given order) at which a taxon of the first one is gone."""
    rows = crosswalk(stages)
    names = list(stages)
    gone = F.coalesce(*[F.when(~F.col(f"in_{k}"), F.lit(k)) for k in names[1:]], F.lit("kept"))
    return rows.where(f"in_{names[0]}").groupBy(gone.alias("lost_at")).agg(F.count("*").alias("taxa"))


def trait_kinds(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Kind of each column: empty, numeric (also 0/1), text (with a space), or categorical."""
    cells = rows.select("taxon", F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("")))])).alias("trait", "value"))
    filled = F.col("value") != ""
    of = cells.groupBy("trait").agg(
        F.sum(filled.cast("long")).alias("filled"),
        F.sum((~filled).cast("long")).alias("missing"),
        F.countDistinct(F.when(filled, F.col("value"))).alias("distinct_values"),
        F.bool_and(F.when(filled, F.expr("try_cast(value AS DOUBLE) IS NOT NULL"))).alias("numeric"),
        F.bool_or(F.when(filled, F.col("value").contains(" "))).alias("spaced"),
    )
    kind = F.when(F.col("filled") == 0, "empty").when(F.col("numeric"), "numeric").when(F.col("spaced"), "text").otherwise("categorical")
    return of.select("trait", "filled", "missing", "distinct_values", kind.alias("kind"))


def completeness(rows: DataFrame, columns: list[str]) -> DataFrame:
    k = trait_kinds(rows, columns)
    return k.select("trait", F.round(F.col("filled") / (F.col("filled") + F.col("missing")), 9).alias("completeness"))


def missing_cells(rows: DataFrame, columns: list[str]) -> DataFrame:
    cells = rows.select("taxon", F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("")))])).alias("trait", "value"))
    return cells.where("value = ''").select("taxon", "trait")


def key_audit(rows: DataFrame) -> DataFrame:
    """Repeated and empty keys."""
    return rows.groupBy("taxon").agg(F.count("*").alias("n")).where("n > 1 or taxon is null or taxon = ''")


def resolve_synonyms(labels: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(label, accepted, status): accepted names through (raw, accepted); several accepted names are ambiguous."""
    of = synonyms.groupBy("raw").agg(F.countDistinct("accepted").alias("k"), F.min("accepted").alias("accepted"))
    rows = labels.select("label").distinct().join(of, F.col("label") == F.col("raw"), "left")
    status = F.when(F.col("k").isNull(), "unlisted").when(F.col("k") > 1, "ambiguous").when(F.col("accepted") == F.col("label"), "accepted").otherwise("renamed")
    return rows.select("label", F.when(status == "ambiguous", F.col("label")).otherwise(F.coalesce("accepted", "label")).alias("accepted"), status.alias("status"))


def ordering_drift(canonical: DataFrame, other: DataFrame) -> DataFrame:
    """Taxa whose rank among the shared ones differs: (taxon, rank, other_rank), from (taxon, position)."""
    both = canonical.join(other.select("taxon", F.col("position").alias("other_position")), "taxon")
    rows = ranked(ranked(both, [F.col("position")], "rank"), [F.col("other_position")], "other_rank")
    return rows.where("rank <> other_rank").select("taxon", "rank", "other_rank")
