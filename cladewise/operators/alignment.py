"""Alignment operators over ``sites`` (aln_id, taxon, site, residue).

'-' is a gap, '?' is missing, other letters than A, C, G, T (and U) are ambiguous.
All aggregate per alignment with map-side combination; none collects a sequence unless
its result is one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BASES = ("A", "C", "G", "T")


def is_gap(c: str = "residue") -> Column:
    return F.col(c) == "-"


def is_missing(c: str = "residue") -> Column:
    return F.col(c) == "?"


def is_known(c: str = "residue") -> Column:
    return F.upper(c).isin(*BASES, "U")


def is_ambiguous(c: str = "residue") -> Column:
    return ~is_gap(c) & ~is_missing(c) & ~is_known(c)


def is_missing_like(c: str = "residue") -> Column:
    """Missing or ambiguous; gaps are not."""
    return is_missing(c) | is_ambiguous(c)


def _n(condition: Column) -> Column:
    return F.sum(condition.cast("long"))


def melt(records: DataFrame) -> DataFrame:
    """(aln_id, taxon, seq) to sites."""
    return records.select("aln_id", "taxon", F.posexplode(F.split("seq", "")).alias("site", "residue")).where("residue <> ''").withColumn("site", F.col("site") + 1)


def sequences(sites: DataFrame) -> DataFrame:
    """Sites to (aln_id, taxon, seq)."""
    pairs = F.sort_array(F.collect_list(F.struct("site", "residue")))
    return sites.groupBy("aln_id", "taxon").agg(F.array_join(F.transform(pairs, lambda p: p.residue), "").alias("seq"))


def base_frequency(sites: DataFrame) -> DataFrame:
    """Share of each base among the known residues, for each taxon and (taxon null) the whole alignment."""
    counts = sites.where(is_known()).rollup("aln_id", "taxon").agg(*[_n(F.col("residue") == b).alias(b) for b in BASES], F.count("*").alias("known"))
    counts = counts.where(F.col("aln_id").isNotNull())
    return counts.select("aln_id", "taxon", "known", *[F.round(F.col(b) / F.col("known"), 9).alias(f"freq_{b.lower()}") for b in BASES])


def gc_content(sites: DataFrame) -> DataFrame:
    known = F.sum(is_known().cast("long"))
    gc = _n(F.upper("residue").isin("G", "C"))
    return sites.groupBy("aln_id", "taxon").agg(F.round(gc / F.nullif(known, F.lit(0)), 9).alias("gc"), known.alias("known"))


def state_counts(sites: DataFrame) -> DataFrame:
    return sites.where(is_known()).groupBy("aln_id", "site", F.upper("residue").alias("state")).agg(F.count("*").alias("n"))


def site_classes(sites: DataFrame) -> DataFrame:
    """Each site with its known states and whether it is constant, variable or parsimony-informative."""
    states = state_counts(sites).groupBy("aln_id", "site").agg(F.count("*").alias("states"), _n(F.col("n") >= 2).alias("often"))
    all_sites = sites.groupBy("aln_id", "site").agg(_n(is_gap()).alias("gaps"), _n(is_missing()).alias("missing"), _n(is_ambiguous()).alias("ambiguous"))
    joined = all_sites.join(states, ["aln_id", "site"], "left").fillna(0, ["states", "often"])
    return joined.select("aln_id", "site", "states", "gaps", "missing", "ambiguous", (F.col("states") == 1).alias("constant"), (F.col("states") > 1).alias("variable"), (F.col("often") >= 2).alias("informative"))


def summary(sites: DataFrame) -> DataFrame:
    """One row per alignment: sites by class and cells by kind."""
    c = site_classes(sites).groupBy("aln_id").agg(
        F.count("*").alias("sites"), _n(F.col("constant")).alias("constant"), _n(F.col("variable")).alias("variable"), _n(F.col("informative")).alias("informative")
    )
    cells = sites.groupBy("aln_id").agg(F.countDistinct("taxon").alias("taxa"), _n(is_gap()).alias("gaps"), _n(is_missing()).alias("missing"), _n(is_ambiguous()).alias("ambiguous"))
    return c.join(cells, "aln_id")


def windows(sites: DataFrame, size: int = 10, step: int = 5) -> DataFrame:
    """Sliding windows; the last is clipped and the sweep stops once a window reaches the end."""
    length = sites.groupBy("aln_id").agg(F.max("site").alias("length"))
    last = F.greatest(F.ceil((F.col("length") - size) / step), F.lit(0)).cast("int")
    starts = length.select("aln_id", "length", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    spans = starts.select("aln_id", (F.col("k") * step + 1).alias("start"), F.least(F.col("k") * step + size, F.col("length")).alias("stop"))
    # a site lies in few windows: explode the windows to their sites, then an equi-join
    inside = spans.select("aln_id", "start", "stop", F.explode(F.sequence("start", "stop")).alias("site"))
    per_site = site_classes(sites).select("aln_id", "site", "variable", "gaps", "missing", "ambiguous")
    taxa = sites.groupBy("aln_id").agg(F.countDistinct("taxon").alias("taxa"))
    return (
        inside.join(per_site, ["aln_id", "site"])
        .groupBy("aln_id", "start", "stop")
        .agg(F.count("*").alias("sites"), _n(F.col("variable")).alias("variable"), F.sum("gaps").alias("gaps"), F.sum(F.col("missing") + F.col("ambiguous")).alias("uncertain"))
        .join(taxa, "aln_id")
        .select("aln_id", "start", "stop", F.round(F.col("variable") / F.col("sites"), 9).alias("variable_fraction"), F.round(F.col("gaps") / (F.col("sites") * F.col("taxa")), 9).alias("gap_fraction"), F.round(F.col("uncertain") / (F.col("sites") * F.col("taxa")), 9).alias("missing_fraction"))
    )


def site_patterns(sites: DataFrame) -> DataFrame:
    """Identical columns as one pattern: its states in taxon order, weight and first site."""
    column = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("taxon", "residue"))), lambda p: p.residue), "")
    columns = sites.groupBy("aln_id", "site").agg(column.alias("pattern"))
    return columns.groupBy("aln_id", "pattern").agg(F.count("*").alias("weight"), F.min("site").alias("first_site"))


def duplicates(sites: DataFrame) -> DataFrame:
    """Groups of taxa with equal sequences."""
    groups = sequences(sites).groupBy("aln_id", "seq").agg(F.array_join(F.sort_array(F.collect_list("taxon")), "|").alias("taxa"), F.count("*").alias("n"))
    return groups.where("n > 1").select("aln_id", "taxa", "n")


def pairs(sites: DataFrame, *, diagonal: bool = False) -> DataFrame:
    """All pairs of taxa of one alignment at each site: (aln_id, left, right, site, l, r)."""
    a = sites.select("aln_id", "site", F.col("taxon").alias("left"), F.upper("residue").alias("l"))
    b = sites.select("aln_id", "site", F.col("taxon").alias("right"), F.upper("residue").alias("r"))
    return a.join(b, ["aln_id", "site"]).where(F.col("left") <= F.col("right") if diagonal else F.col("left") < F.col("right"))


def identity(sites: DataFrame) -> DataFrame:
    """Pairwise identity over sites where neither is a gap or missing; 0 without any."""
    ok = ~is_gap("l") & ~is_missing("l") & ~is_gap("r") & ~is_missing("r")
    return (
        pairs(sites).groupBy("aln_id", "left", "right").agg(_n(ok).alias("comparable_sites"), _n(ok & (F.col("l") == F.col("r"))).alias("same"))
        .select("aln_id", "left", "right", "comparable_sites", F.round(F.coalesce(F.try_divide("same", "comparable_sites"), F.lit(0.0)), 9).alias("identity"))
    )


def near_duplicates(sites: DataFrame, threshold: float = 0.4) -> DataFrame:
    return identity(sites).where(F.col("identity") >= threshold)


def missing_by_taxon(sites: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Missing-like fraction of each taxon, and whether it is above the threshold."""
    out = sites.groupBy("aln_id", "taxon").agg(F.round(F.avg(is_missing_like().cast("double")), 9).alias("missing_fraction"))
    return out.withColumn("excessive", F.col("missing_fraction") > threshold)


def missing_by_site(sites: DataFrame, threshold: float = 0.3) -> DataFrame:
    out = sites.groupBy("aln_id", "site").agg(F.round(F.avg(is_missing_like().cast("double")), 9).alias("missing_fraction"))
    return out.withColumn("excessive", F.col("missing_fraction") > threshold)


def remove_sequences_above_missingness(sites: DataFrame, threshold: float) -> DataFrame:
    drop = missing_by_taxon(sites, threshold).where("excessive").select("aln_id", "taxon")
    return sites.join(drop, ["aln_id", "taxon"], "left_anti")


def trim_columns_above_missingness(sites: DataFrame, threshold: float) -> DataFrame:
    drop = missing_by_site(sites, threshold).where("excessive").select("aln_id", "site")
    return renumber(sites.join(drop, ["aln_id", "site"], "left_anti"))


def remove_all_gap_columns(sites: DataFrame) -> DataFrame:
    keep = sites.groupBy("aln_id", "site").agg(F.bool_and(is_gap()).alias("all_gap")).where("not all_gap").select("aln_id", "site")
    return renumber(sites.join(keep, ["aln_id", "site"]))


def remove_all_missing_columns(sites: DataFrame) -> DataFrame:
    keep = sites.groupBy("aln_id", "site").agg(F.bool_and(is_missing_like()).alias("all_missing")).where("not all_missing").select("aln_id", "site")
    return renumber(sites.join(keep, ["aln_id", "site"]))


def renumber(sites: DataFrame) -> DataFrame:
    """Sites numbered from 1 without holes."""
    order = sites.select("aln_id", "site").distinct().withColumn("new", F.row_number().over(Window.partitionBy("aln_id").orderBy("site")))
    return sites.join(order, ["aln_id", "site"]).select("aln_id", "taxon", F.col("new").alias("site"), "residue")


#: (site cut-off, sequence cut-off) of the named profiles.
PROFILES = {"conservative": (0.8, 0.6), "moderate": (0.5, 0.4), "aggressive": (0.3, 0.25), "coding-safe": (0.5, 0.35), "phylogenomics-scale": (0.7, 0.7)}


def clean(sites: DataFrame, profile: str) -> DataFrame:
    site_cut, sequence_cut = PROFILES[profile]
    return remove_sequences_above_missingness(trim_columns_above_missingness(sites, site_cut), sequence_cut)


def composition_outliers(sites: DataFrame) -> DataFrame:
    """|GC - median| > 0.25 or |robust z| >= 3.5, with z = 0.67449 (x - median) / MAD, null for MAD 0."""
    gc = gc_content(sites).where("gc is not null")
    mid = gc.groupBy("aln_id").agg(F.median("gc").alias("mid"))
    off = gc.join(mid, "aln_id").withColumn("off", F.abs(F.col("gc") - F.col("mid")))
    mad = off.groupBy("aln_id").agg(F.median("off").alias("mad"))
    z = 0.67449 * (F.col("gc") - F.col("mid")) / F.nullif(F.col("mad"), F.lit(0.0))
    out = off.join(mad, "aln_id").withColumn("robust_z", F.round(z, 6))
    return out.select("aln_id", "taxon", "gc", "robust_z", ((F.col("off") > 0.25) | F.coalesce(F.abs("robust_z") >= 3.5, F.lit(False))).alias("outlier"))


def taxon_occupancy(sites: DataFrame, locus_size: int = 10) -> DataFrame:
    """Share of cells with a residue for each taxon and locus of ``locus_size`` sites."""
    locus = F.floor((F.col("site") - 1) / locus_size).cast("int")
    return sites.groupBy("aln_id", "taxon", locus.alias("locus")).agg(F.round(F.avg((~is_gap() & ~is_missing()).cast("double")), 9).alias("occupancy"))


CODONS = {}
for _i, _c in enumerate(a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"):
    CODONS[_c] = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"[_i]  # the standard code in TCAG order


def translate(sites: DataFrame) -> DataFrame:
    """Codons to amino acids: gap codons '-', other incomplete ones 'X'; a trailing part codon is dropped."""
    codon = F.floor((F.col("site") - 1) / 3).cast("int") + 1
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("site", F.upper("residue").alias("residue")))), lambda p: p.residue), "")
    codons = sites.groupBy("aln_id", "taxon", codon.alias("codon")).agg(F.replace(text, F.lit("U"), F.lit("T")).alias("triplet"))
    table = F.create_map(*[F.lit(x) for kv in CODONS.items() for x in kv])
    amino = F.when(F.col("triplet") == "---", "-").otherwise(F.coalesce(F.try_element_at(table, F.col("triplet")), F.lit("X")))
    return codons.where(F.length("triplet") == 3).select("aln_id", "taxon", "codon", "triplet", amino.alias("amino_acid"))


def stop_codons(sites: DataFrame) -> DataFrame:
    """Stops, internal or terminal."""
    last = Window.partitionBy("aln_id", "taxon")
    aa = translate(sites).withColumn("last", F.max("codon").over(last))
    return aa.where("amino_acid = '*'").select("aln_id", "taxon", "codon", F.when(F.col("codon") == F.col("last"), "terminal").otherwise("internal").alias("kind"))


def quality_ranking(sites: DataFrame) -> DataFrame:
    """Taxa of each alignment by share of known residues, then name."""
    share = sites.groupBy("aln_id", "taxon").agg(F.round(F.avg(is_known().cast("double")), 9).alias("quality"))
    return share.withColumn("rank", F.row_number().over(Window.partitionBy("aln_id").orderBy(F.desc("quality"), "taxon")))
