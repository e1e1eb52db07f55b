"""Reviews of alignments, trees, tree sets and tables: audits, comparisons and summaries as plain plans.

Frames are those of the other modules: sites (aln_id, taxon, site, residue), nodes (tree_id, name,
parent, branch_length, level, is_tip, pre, post, root_dist), clades (tree_id, clade, size),
traces (chain, iteration, value) and taxon tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladewise.operators import alignment as al
from cladewise.operators import trees as tree
from cladewise.operators import treesets as se


def _share(a: Column, b: Column) -> Column:
    return F.round(F.try_divide(a.cast("double"), b), 9)


# Alignments


def alphabet(sites: DataFrame) -> DataFrame:
    """dna, rna, protein or unknown by the residues of each alignment; U rules out dna, T rules out rna."""
    plain = F.bool_and(F.col("residue").isin(*"ACGTUN-?"))
    amino = F.bool_and(F.col("residue").isin(*"ACDEFGHIKLMNPQRSTVWYBXZ*-?"))
    u, t = F.bool_or(F.col("residue") == "U"), F.bool_or(F.col("residue") == "T")
    kind = F.when(plain & ~u, "dna").when(plain & ~t, "rna").when(amino, "protein").otherwise("unknown")
    return sites.groupBy("aln_id").agg(kind.alias("alphabet"))


def invalid_characters(sites: DataFrame, alphabet: str = "ACGT-") -> DataFrame:
    return sites.where(~F.col("residue").isin(*alphabet)).select("aln_id", "taxon", "site", "residue")


def amino_acid_composition(proteins: DataFrame) -> DataFrame:
    """Shares of the canonical amino acids of (aln_id, taxon, amino_acid)."""
    counted = proteins.where(F.col("amino_acid").isin(*"ACDEFGHIKLMNPQRSTVWY")).groupBy("aln_id", "amino_acid").agg(F.count("*").alias("n"))
    total = counted.groupBy("aln_id").agg(F.sum("n").alias("total"))
    return counted.join(total, "aln_id").select("aln_id", "amino_acid", "n", _share(F.col("n"), F.col("total")).alias("share"))


def raw_lengths(sites: DataFrame) -> DataFrame:
    """Residues of each sequence that are no gaps."""
    return sites.groupBy("aln_id", "taxon").agg(F.sum((F.col("residue") != "-").cast("long")).alias("raw_length"), F.count("*").alias("length"))


def classify(sites: DataFrame) -> DataFrame:
    """aligned: one length, with gaps; equal: one length without gaps; unaligned: several lengths."""
    of = raw_lengths(sites).groupBy("aln_id").agg(F.min("length").alias("least"), F.max("length").alias("most"), F.bool_or(F.col("raw_length") < F.col("length")).alias("gapped"))
    kind = F.when(F.col("least") < F.col("most"), "unaligned").when(F.col("gapped"), "aligned").otherwise("equal")
    return of.select("aln_id", "least", "most", "gapped", kind.alias("kind"))


def length_outliers(sites: DataFrame, limit: float = 3.5, relative: float = 0.2) -> DataFrame:
    """Raw lengths that lie a fifth of the median or more from it, or at a robust z of ``limit`` or more.

    z is 0.6744897501960817 * (length - median) / median absolute deviation, null if that is 0. Alignments of fewer
    than three records, or with a median of 0, have no outliers.
    """
    lengths = raw_lengths(sites)
    mid = lengths.groupBy("aln_id").agg(F.percentile("raw_length", F.lit(0.5)).alias("mid"), F.count("*").alias("records"))
    off = lengths.join(mid, "aln_id").withColumn("off", F.abs(F.col("raw_length") - F.col("mid")))
    mad = off.groupBy("aln_id").agg(F.percentile("off", F.lit(0.5)).alias("mad"))
    z = F.round(F.try_divide(0.6744897501960817 * (F.col("raw_length") - F.col("mid")), F.col("mad")), 6)
    rows = off.join(mad, "aln_id").withColumn("robust_z", z)
    out = (F.col("records") >= 3) & (F.col("mid") > 0) & ((F.col("off") >= relative * F.col("mid")) | F.coalesce(F.abs("robust_z") >= limit, F.lit(False)))
    note = F.when(out, F.when(F.col("raw_length") > F.col("mid"), "longer than baseline").otherwise("shorter than baseline"))
    return rows.select("aln_id", "taxon", "raw_length", F.col("mid").alias("median_length"), "robust_z", out.alias("outlier"), note.alias("note"))


def over_aligned(windows: DataFrame) -> DataFrame:
    """Windows with much uncertainty that hardly vary."""
    unsure = F.round(F.col("gap_fraction") + F.col("missing_fraction"), 9)
    return windows.withColumn("uncertainty", unsure).where((F.col("uncertainty") >= 0.4) & (F.col("variable_fraction") <= 0.2)).select("aln_id", "start", "stop", "uncertainty", "variable_fraction")


def site_disagreement(sites: DataFrame) -> DataFrame:
    """1 - the share of the most frequent state among the known residues of each column."""
    n = sites.where(al.is_known()).groupBy("aln_id", "site", "residue").agg(F.count("*").alias("n"))
    return n.groupBy("aln_id", "site").agg(F.round(1 - F.max("n") / F.sum("n"), 9).alias("disagreement"))


def low_information(summary: DataFrame, sites: int = 1, fraction: float = 0.0) -> DataFrame:
    """Alignments without a variable column whose informative columns are fewer than ``sites``, or a smaller share than ``fraction``."""
    share = _share(F.col("informative"), F.col("sites"))
    few, small = (F.col("variable") == 0) & (F.col("informative") < sites), (F.col("variable") == 0) & (share < fraction)
    return summary.select("aln_id", "sites", "variable", "informative", share.alias("informative_fraction"), (few | small).alias("low_information"), (few.cast("int") + small.cast("int")).alias("reasons"))


def missing_concentration(sites: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Columns of which ``threshold`` or more is missing: their number and share, the longest run of neighbours (the first of equals), and the worst columns."""
    by_site = sites.groupBy("aln_id", "site").agg(F.avg(al.is_missing_like().cast("double")).alias("share"))
    whole = by_site.groupBy("aln_id").agg(F.count("*").alias("sites"), F.max("share").alias("most"), F.count_if(F.col("share") >= threshold).alias("concentrated"))
    worst = by_site.join(whole.select("aln_id", "most"), "aln_id").where(F.col("share") == F.col("most")).groupBy("aln_id").agg(F.count("*").alias("worst_columns"), F.min("site").alias("first_worst"))
    marked = by_site.where(F.col("share") >= threshold)
    island = marked.withColumn("_i", F.col("site") - F.row_number().over(Window.partitionBy("aln_id").orderBy("site")))
    runs = island.groupBy("aln_id", "_i").agg(F.count("*").alias("n"), F.min("site").alias("a"), F.max("site").alias("b"))
    longest = runs.groupBy("aln_id").agg(F.max(F.struct("n", (-F.col("a")).alias("a"), "b")).alias("_r"))
    rows = whole.join(worst, "aln_id").join(longest, "aln_id", "left")
    return rows.select("aln_id", "concentrated", _share(F.col("concentrated"), F.col("sites")).alias("concentrated_fraction"), F.coalesce("_r.n", F.lit(0)).cast("long").alias("longest_run"), (-F.col("_r.a")).alias("run_start"), F.col("_r.b").alias("run_end"), F.round("most", 9).alias("most"), "worst_columns", "first_worst")


def frameshifts(sites: DataFrame) -> DataFrame:
    """Sequences whose comparable length is not a multiple of three."""
    n = sites.groupBy("aln_id", "taxon").agg(F.sum((~F.col("residue").isin("-", "?")).cast("long")).alias("comparable"))
    return n.withColumn("excess", (F.col("comparable") % 3).cast("int")).where("excess <> 0")


def coding_behaviour(sites: DataFrame) -> DataFrame:
    """coding: length in threes without internal stop; ambiguous: one of the two; noncoding: neither."""
    n = sites.groupBy("aln_id", "taxon").agg((F.sum((~F.col("residue").isin("-", "?")).cast("long")) % 3 == 0).alias("framed"))
    stops = al.stop_codons(sites).where("kind = 'internal'").groupBy("aln_id", "taxon").agg(F.count("*").alias("stops"))
    of = n.join(stops, ["aln_id", "taxon"], "left").withColumn("stops", F.coalesce("stops", F.lit(0).cast("long")))
    kind = F.when(F.col("framed") & (F.col("stops") == 0), "coding").when(F.col("framed") | (F.col("stops") == 0), "ambiguous").otherwise("noncoding")
    return of.select("aln_id", "taxon", "framed", "stops", kind.alias("behaviour"))


def concatenate(loci: DataFrame) -> DataFrame:
    """Supermatrix (matrix, taxon, site, residue) of loci (matrix, locus, taxon, site, residue); taxa without a locus get gaps."""
    length = loci.groupBy("matrix", "locus").agg(F.max("site").alias("length"))
    before = F.sum("length").over(Window.partitionBy("matrix").orderBy("locus").rowsBetween(Window.unboundedPreceding, -1))
    offset = length.withColumn("offset", F.coalesce(before, F.lit(0)))
    taxa = loci.select("matrix", "taxon").distinct()
    cells = offset.join(taxa, "matrix").withColumn("site", F.explode(F.sequence(F.lit(1), F.col("length"))))
    full = cells.join(loci, ["matrix", "locus", "taxon", "site"], "left")
    return full.select("matrix", "taxon", (F.col("offset") + F.col("site")).cast("long").alias("site"), F.coalesce("residue", F.lit("-")).alias("residue"))


def partition_summary(loci: DataFrame) -> DataFrame:
    """Place of each locus in its matrix, and its known cells."""
    of = loci.groupBy("matrix", "locus").agg(F.max("site").cast("long").alias("length"), F.countDistinct("taxon").alias("taxa"), F.sum((~F.col("residue").isin("-", "?")).cast("long")).alias("filled"))
    w = Window.partitionBy("matrix").orderBy("locus").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum("length").over(w)
    return of.withColumn("stop", stop).select("matrix", "locus", (F.col("stop") - F.col("length") + 1).alias("start"), "stop", "taxa", _share(F.col("filled"), F.col("length") * F.col("taxa")).alias("completeness"))


def partition_slices(sites: DataFrame, size: int = 10) -> DataFrame:
    """The sequence of each taxon in each partition of ``size`` columns."""
    part = F.floor((F.col("site") - 1) / size).cast("int")
    return al.sequences(sites.withColumn("taxon", F.concat_ws("/", "taxon", part.cast("string")))).select("aln_id", F.substring_index("taxon", "/", 1).alias("taxon"), F.substring_index("taxon", "/", -1).cast("int").alias("part"), "seq")


def compare_versions(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns of two versions of each alignment: cells in both, on one side only, and changed."""
    a, b = left.select("aln_id", "taxon", "site", F.col("residue").alias("l")), right.select("aln_id", "taxon", "site", F.col("residue").alias("r"))
    n = lambda c: F.sum(c.cast("long"))
    both = a.join(b, ["aln_id", "taxon", "site"], "full")
    l, r = F.col("l"), F.col("r")
    return both.groupBy("aln_id").agg(n(l.isNotNull() & r.isNotNull()).alias("shared"), n(r.isNull()).alias("left_only"), n(l.isNull()).alias("right_only"), n(F.coalesce(l != r, F.lit(False))).alias("changed"))


def expand_patterns(sites: DataFrame) -> DataFrame:
    """Each column's pattern, in the alignment's order, with the first column that has it."""
    columns = sites.groupBy("aln_id", "site").agg(F.sort_array(F.collect_list(F.struct("taxon", "residue"))).alias("p"))
    columns = columns.select("aln_id", "site", F.array_join(F.transform("p", lambda x: x.residue), "").alias("pattern"))
    return columns.withColumn("first_site", F.min("site").over(Window.partitionBy("aln_id", "pattern")))


def under_aligned(sites: DataFrame, size: int = 10, step: int = 5) -> DataFrame:
    """Windows that vary much and whose columns mostly disagree."""
    off = site_disagreement(sites).select("aln_id", "site", "disagreement")
    windows = al.windows(sites).select("aln_id", "start", "stop", "variable_fraction")
    mean = windows.join(off, "aln_id").where("site between start and stop").groupBy("aln_id", "start", "stop", "variable_fraction").agg(F.round(F.avg("disagreement"), 6).alias("disagreement"))
    return mean.where("variable_fraction >= 0.7 and disagreement >= 0.35")


def sequence_types(sites: DataFrame) -> DataFrame:
    """invalid, mixed, protein, rna or dna: what all records of an alignment may be, and how sure that is.

    A record may be each type whose letters hold all of its residues (gaps and '?' aside). A record that may be
    nothing makes the input invalid; records without a common type make it mixed. Letters that only proteins have make it protein, U without T
    rna; dna is of medium certainty with a T, low without.
    """
    nucleotide, acids = "ACGNRYSWKMBDHV", "ABCDEFGHIKLMNPQRSTVWXYZ*"
    seen = sites.where(~F.col("residue").isin("-", "?", ".")).withColumn("r", F.upper("residue"))
    r = F.col("r")
    records = seen.groupBy("aln_id", "taxon").agg(
        F.bool_and(r.isin(*nucleotide, "T")).alias("dna"), F.bool_and(r.isin(*nucleotide, "U")).alias("rna"), F.bool_and(r.isin(*acids)).alias("protein"), F.bool_or(~r.isin(*nucleotide, *acids, "T", "U")).alias("odd"),
        F.bool_or(r == "T").alias("t"), F.bool_or(r == "U").alias("u"), F.bool_or(r.isin(*acids) & ~r.isin(*nucleotide, "T", "U")).alias("signal"),
    )
    n = lambda c: F.count_if(c)
    bad = F.col("odd") | ~(F.col("dna") | F.col("rna") | F.col("protein"))
    of = records.groupBy("aln_id").agg(n(bad).alias("invalid_records"), *(F.bool_and(F.col(c) | bad).alias(c) for c in ("dna", "rna", "protein")), n(F.col("t")).alias("thymine"), n(F.col("u")).alias("uracil"), n(F.col("signal")).alias("signals"))
    blocked = F.when(F.col("invalid_records") > 0, "invalid").when(~(F.col("dna") | F.col("rna") | F.col("protein")), "mixed")
    kind = F.coalesce(blocked, F.when(F.col("signals") > 0, "protein").when((F.col("uracil") > 0) & (F.col("thymine") == 0), "rna").when(F.col("dna"), "dna").when(F.col("rna"), "rna").otherwise("protein"))
    sure = F.when(blocked.isNotNull(), "blocked").when((F.col("signals") > 0) | ((F.col("uracil") > 0) & (F.col("thymine") == 0)), "high").when(F.col("dna"), F.when(F.col("thymine") > 0, "medium").otherwise("low")).otherwise("low")
    return of.select("aln_id", kind.alias("kind"), sure.alias("confidence"), "invalid_records", "thymine", "uracil", "signals")


def quality_score(summary: DataFrame, outliers: DataFrame, duplicates: DataFrame) -> DataFrame:
    """A hundred times the mean of five shares: cells not missing, cells that are no gaps, taxa less composition outliers, taxa less groups of duplicates, and informative columns over a fifth (at most 1)."""
    odd = outliers.where("outlier").groupBy("aln_id").agg(F.count("*").alias("_o"))
    twice = duplicates.groupBy("aln_id").agg(F.count("*").alias("_d"))
    rows = summary.join(odd, "aln_id", "left").join(twice, "aln_id", "left").fillna(0, ["_o", "_d"])
    cells, taxa = F.col("sites") * F.col("taxa"), F.greatest("taxa", F.lit(1))
    left = lambda part: F.round(1 - F.least(part, F.lit(1.0)), 9)
    parts = {
        "missingness": left((F.col("missing") + F.col("ambiguous")) / cells), "gap_burden": left(F.col("gaps") / cells), "composition": left(F.col("_o") / taxa), "duplicates": left(F.col("_d") / taxa),
        "density": F.round(F.least(F.col("informative") / F.col("sites") / 0.2, F.lit(1.0)), 9),
    }
    return rows.select("aln_id", *(c.alias(k) for k, c in parts.items())).withColumn("score", F.round(sum((F.col(k) for k in parts), F.lit(0.0)) / 5 * 100, 3))


def compare_summaries(left: DataFrame, right: DataFrame) -> DataFrame:
    """What a change of each alignment did to its figures."""
    names = ["sites", "taxa", "gaps", "informative"]
    both = left.select("aln_id", *(F.col(c).alias(f"l_{c}") for c in names)).join(right.select("aln_id", *names), "aln_id", "full").fillna(0)
    return both.select("aln_id", *((F.col(c) - F.col(f"l_{c}")).alias(f"{c}_delta") for c in names))


# Distances


def complete_deletion(sites: DataFrame) -> DataFrame:
    """Sites whose columns are known in all taxa."""
    whole = sites.groupBy("aln_id", "site").agg(F.bool_and(F.col("residue").isin(*"ACGT")).alias("whole")).where("whole").select("aln_id", "site")
    return sites.join(whole, ["aln_id", "site"], "left_semi")


def compare_gap_policies(pairwise: DataFrame, complete: DataFrame) -> DataFrame:
    """Distances under the two policies; a pair without a complete column has none."""
    key = ["aln_id", "left", "right"]
    a, b = pairwise.where("left < right").select(*key, F.col("distance").alias("pairwise")), complete.select(*key, F.col("distance").alias("complete"))
    return a.join(b, key, "left").withColumn("delta", F.round(F.col("complete") - F.col("pairwise"), 9))


def impute_distances(distances: DataFrame) -> DataFrame:
    """Missing distances by the mean of the alignment's known ones."""
    pairs = distances.where("left < right")
    mean = pairs.groupBy("aln_id").agg(F.round(F.avg("distance"), 6).alias("mean"))
    return pairs.join(mean, "aln_id").select("aln_id", "left", "right", F.round(F.coalesce("distance", "mean"), 6).alias("distance"), F.col("distance").isNull().alias("imputed"))


def validate_distances(distances: DataFrame) -> DataFrame:
    """Problems of a matrix of both directions: negative, unlike the other direction, or other than 0 on the diagonal."""
    other = distances.select("aln_id", F.col("left").alias("right"), F.col("right").alias("left"), F.col("distance").alias("back"))
    both = distances.join(other, ["aln_id", "left", "right"], "left")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    d = F.col("distance")
    return both.groupBy("aln_id").agg(F.count("*").alias("cells"), n(d < 0).alias("negative"), n((F.col("left") == F.col("right")) & (d != 0)).alias("diagonal"), n((F.col("left") != F.col("right")) & (F.col("back").isNull() | (F.abs(d - F.col("back")) > 1e-9))).alias("one_sided"))


# Trees


def clade_ids(nodes: DataFrame) -> DataFrame:
    """Inner nodes by the sorted tips below them, joined by '|'."""
    up = tree.ancestors(nodes)
    return up.groupBy("tree_id", F.col("ancestor").alias("name")).agg(F.array_join(F.sort_array(F.collect_list("tip")), "|").alias("clade"), F.count("*").alias("tips"))


def rooting(nodes: DataFrame) -> DataFrame:
    """Polytomies, and whether the root has two children."""
    kids = nodes.where("parent is not null").groupBy("tree_id", F.col("parent").alias("name")).agg(F.count("*").alias("children"))
    return kids.groupBy("tree_id").agg(F.bool_or(F.col("children") > 2).alias("polytomy"), F.coalesce(F.max(F.when(F.col("name") == "root", F.col("children"))) == 2, F.lit(False)).alias("rooted"))


def branch_length_distribution(nodes: DataFrame, long: float = 2.0) -> DataFrame:
    """Quantiles of each tree's branch lengths, with the numbers of zero, negative and long ones (over ``long`` medians)."""
    b = nodes.where("parent is not null").select("tree_id", F.col("branch_length").alias("b"))
    of = b.groupBy("tree_id").agg(F.count("*").alias("branches"), F.percentile("b", F.lit(0.5)).alias("median"), F.round(F.percentile("b", F.lit(0.95)), 6).alias("p95"), F.sum((F.col("b") == 0).cast("long")).alias("zero"), F.sum((F.col("b") < 0).cast("long")).alias("negative"))
    far = b.join(of.select("tree_id", "median"), "tree_id").where(F.col("b") > long * F.col("median")).groupBy("tree_id").agg(F.count("*").alias("far"))
    return of.join(far, "tree_id", "left").withColumn("far", F.coalesce("far", F.lit(0).cast("long")))


def shape_distribution(shapes: DataFrame) -> DataFrame:
    """Sackin index and cherries over a set of trees, by the number of tips."""
    return shapes.groupBy("tips").agg(F.count("*").alias("trees"), F.round(F.avg("sackin"), 6).alias("mean_sackin"), F.min("sackin").alias("least_sackin"), F.max("sackin").alias("most_sackin"), F.round(F.avg("cherries"), 6).alias("mean_cherries"))


def tip_distances(nodes: DataFrame) -> DataFrame:
    """Patristic distances of all pairs of tips of a tree: both depths less twice that of their last common ancestor."""
    up = tree.ancestors(nodes)
    a = up.select("tree_id", "ancestor", F.col("tip").alias("left"), F.col("tip_dist").alias("l"), "ancestor_dist")
    b = up.select("tree_id", "ancestor", F.col("tip").alias("right"), F.col("tip_dist").alias("r"))
    both = a.join(b, ["tree_id", "ancestor"]).where("left < right").groupBy("tree_id", "left", "right").agg(F.max("l").alias("l"), F.max("r").alias("r"), F.max("ancestor_dist").alias("c"))
    return both.select("tree_id", "left", "right", F.round(F.col("l") + F.col("r") - 2 * F.col("c"), 6).alias("distance"))


def extract_clades(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """The subtrees of the nodes in ``roots`` (tree_id, name), with depths from their roots."""
    top = nodes.join(roots, ["tree_id", "name"], "left_semi").select("tree_id", F.col("name").alias("clade_root"), F.col("pre").alias("lo"), F.col("post").alias("hi"), F.col("root_dist").alias("base"))
    below = nodes.join(top, "tree_id").where("pre between lo and hi")
    return below.select("tree_id", "clade_root", "name", F.when(F.col("pre") != F.col("lo"), F.col("parent")).alias("parent"), F.round(F.col("root_dist") - F.col("base"), 9).alias("depth"))


def clades_of_taxa(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """Nodes whose tips are just those of a group (tree_id, group, tip)."""
    wanted = groups.groupBy("tree_id", "group").agg(F.array_join(F.sort_array(F.collect_set("tip")), "|").alias("clade"))
    return clade_ids(nodes).join(wanted, ["tree_id", "clade"]).select("tree_id", "group", "name", "tips")


def clade_ages(nodes: DataFrame) -> DataFrame:
    return clade_ids(nodes).join(tree.branching_times(nodes), ["tree_id", "name"]).select("tree_id", "clade", "age")


def time_tree(nodes: DataFrame) -> DataFrame:
    """What a tree needs for diversification rates: positive lengths, a resolved root, tips at one depth."""
    positive = nodes.where("parent is not null").groupBy("tree_id").agg(F.bool_and(F.col("branch_length") > 0).alias("positive"))
    of = rooting(nodes).join(positive, "tree_id").join(tree.ultrametricity(nodes).select("tree_id", "ultrametric"), "tree_id")
    return of.withColumn("usable", F.col("rooted") & ~F.col("polytomy") & F.col("positive") & F.col("ultrametric"))


def diversification_outliers(nodes: DataFrame, least_tips: int = 2) -> DataFrame:
    """Clades by the z of their rate (log of tips over crown age) among their tree's: high from 1, low to -1, else baseline; 0 without spread."""
    sizes = tree.tip_counts(nodes).where("not is_tip").select("tree_id", "name", "tips").join(tree.branching_times(nodes), ["tree_id", "name"]).where((F.col("age") > 0) & (F.col("tips") >= least_tips))
    rate = sizes.withColumn("rate", F.log(F.col("tips")) / F.col("age"))
    of = rate.groupBy("tree_id").agg(F.avg("rate").alias("_m"), F.stddev_pop("rate").alias("_s"))
    z = F.round(F.when(F.col("_s") > 1e-12, (F.col("rate") - F.col("_m")) / F.col("_s")).otherwise(0.0), 6)
    rows = rate.join(of, "tree_id").withColumn("z", z)
    return rows.select("tree_id", "name", "tips", "age", F.round("rate", 6).alias("rate"), "z", F.when(F.col("z") >= 1, "high").when(F.col("z") <= -1, "low").otherwise("baseline").alias("kind"))


# Tree sets and pairs of trees


def clade_lengths(tips: DataFrame) -> DataFrame:
    """Clades of two-level trees with a length: the mean count of their tips, over ten."""
    of = lambda *by: tips.groupBy("tree_id", *by).agg(F.array_join(F.sort_array(F.collect_list("tip")), "|").alias("clade"), F.count("*").alias("size"), F.round(F.avg("n") / 10, 6).alias("length"))
    both = of("a").select("tree_id", "clade", "size", "length").unionByName(of("a", "b").select("tree_id", "clade", "size", "length")).distinct()
    taxa = tips.groupBy("tree_id").agg(F.count("*").alias("taxa"))
    return both.join(taxa, "tree_id").where("size > 1 and size < taxa").select("tree_id", "clade", "size", "length")


def with_next(clades: DataFrame) -> DataFrame:
    """(pair, clade, left, right): the lengths of each tree's clades and of the tree's with the next id."""
    a = clades.select(F.col("tree_id").alias("pair"), "clade", F.col("length").alias("left"))
    b = clades.select((F.col("tree_id") - 1).alias("pair"), "clade", F.col("length").alias("right"))
    return a.join(b, ["pair", "clade"], "full")


def clade_changes(pairs: DataFrame) -> DataFrame:
    status = F.when(F.col("right").isNull(), "lost").when(F.col("left").isNull(), "gained")
    return pairs.where("left is null or right is null").select("pair", "clade", status.alias("status"))


def clade_sets(pairs: DataFrame) -> DataFrame:
    n = lambda c: F.sum(c.cast("long"))
    l, r = F.col("left").isNotNull(), F.col("right").isNotNull()
    of = pairs.groupBy("pair").agg(n(l & r).alias("shared"), n(l & ~r).alias("left_only"), n(~l & r).alias("right_only"))
    return of.withColumn("jaccard", _share(F.col("shared"), F.col("shared") + F.col("left_only") + F.col("right_only")))


def compare_branch_lengths(pairs: DataFrame) -> DataFrame:
    both = pairs.where("left is not null and right is not null")
    return both.select("pair", "clade", "left", "right", F.round(F.col("right") - F.col("left"), 6).alias("delta"), F.round(F.try_divide(F.col("right"), F.col("left")), 6).alias("ratio"))


def compare_support(pairs: DataFrame, strong: float = 0.2, weak: float = 0.1) -> DataFrame:
    """Strong support on one side for what is weak or absent on the other is a conflict."""
    l, r = F.coalesce("left", F.lit(0.0)), F.coalesce("right", F.lit(0.0))
    kind = F.when((l >= strong) & (r >= strong), "agreed").when(((l >= strong) & (r <= weak)) | ((r >= strong) & (l <= weak)), "conflict").otherwise("open")
    return pairs.select("pair", "clade", l.alias("left"), r.alias("right"), kind.alias("kind"))


def clade_overlap(clades: DataFrame, trees: DataFrame) -> DataFrame:
    """How many trees share a clade, and whether all do."""
    f = se.clade_frequencies(clades, trees)
    first = clades.groupBy("clade").agg(F.min("tree_id").alias("first_tree"))
    return f.join(first, "clade").select("clade", "tree_count", "first_tree", (F.col("frequency") == 1).alias("universal"))


def reference_support(reference: DataFrame, clades: DataFrame, trees: DataFrame) -> DataFrame:
    """Frequencies of the clades of reference trees (tree_id, clade); 0 where no tree has them."""
    f = se.clade_frequencies(clades, trees).select("clade", "frequency")
    return reference.select("tree_id", "clade").join(f, "clade", "left").select("tree_id", "clade", F.coalesce("frequency", F.lit(0.0)).alias("support"))


def unrooted_splits(clades: DataFrame, tips: DataFrame) -> DataFrame:
    """Splits with more than one tip on both sides, as their smaller side (the earlier of equal ones)."""
    every = tips.groupBy("tree_id").agg(F.sort_array(F.collect_set("tip")).alias("every"))
    own = clades.join(every, "tree_id").withColumn("own", F.split("clade", r"\|")).withColumn("rest", F.array_except("every", "own"))
    side = F.least(F.struct(F.size("own"), F.array_join("own", "|").alias("s")), F.struct(F.size("rest"), F.array_join("rest", "|").alias("s")))
    return own.where("size(every) >= 4 and size(rest) > 1").select("tree_id", side.s.alias("split")).distinct()


def length_summary(clades: DataFrame) -> DataFrame:
    return clades.groupBy("clade").agg(F.count("*").alias("trees"), F.round(F.avg("length"), 6).alias("mean"), F.round(F.percentile("length", F.lit(0.5)), 6).alias("median"), F.min("length").alias("least"), F.max("length").alias("most"))


def unstable_clades(clades: DataFrame, trees: DataFrame) -> DataFrame:
    """Clades that some trees lack, with the number of clades against them."""
    against = se.compatibility(clades, trees).where("not compatible")
    each = against.select(F.col("left").alias("clade")).unionByName(against.select(F.col("right").alias("clade"))).groupBy("clade").agg(F.count("*").alias("conflicts"))
    f = se.clade_frequencies(clades, trees).where("frequency < 1")
    return f.join(each, "clade", "left").select("clade", "frequency", F.coalesce("conflicts", F.lit(0).cast("long")).alias("conflicts"))


def support_classes(clades: DataFrame, trees: DataFrame, robust: float = 0.9) -> DataFrame:
    """Clades by frequency and number of clades that they conflict with: robust, intermediate-support (0.3 to 0.7), credibility-conflicted or weak-support."""
    pairs = se.conflicting_pairs(clades)
    both = pairs.select(F.col("left").alias("clade")).unionByName(pairs.select(F.col("right").alias("clade")))
    f = se.clade_frequencies(clades, trees).join(both.groupBy("clade").agg(F.count("*").alias("conflicts")), "clade", "left").fillna(0, ["conflicts"])
    kind = F.when((F.col("frequency") >= robust) & (F.col("conflicts") == 0), "robust").when(F.col("frequency").between(0.3, 0.7), "intermediate-support").when(F.col("conflicts") > 0, "credibility-conflicted").otherwise("weak-support")
    return f.select("clade", "frequency", "conflicts", kind.alias("support"))


def consensus_thresholds(clades: DataFrame, trees: DataFrame, thresholds: tuple[float, ...] = (0.05, 0.1, 0.2, 0.5)) -> DataFrame:
    """Clades that each threshold keeps; 0 where none."""
    cuts = F.explode(F.array(*map(F.lit, thresholds)))
    of = se.clade_frequencies(clades, trees).select("frequency", cuts.alias("threshold"))
    return of.groupBy("threshold").agg(F.sum((F.col("frequency") >= F.col("threshold")).cast("long")).alias("clades"), F.round(F.max("frequency"), 9).alias("most"))


def thinning(clades: DataFrame, trees: DataFrame, intervals: tuple[int, ...] = (2, 5)) -> DataFrame:
    """Clade frequencies in every k-th tree against those in all, trees being counted by their id."""
    full = se.clade_frequencies(clades, trees).select("clade", F.col("frequency").alias("all_trees"))
    out = None
    for k in intervals:
        some, kept = clades.where(F.col("tree_id") % k == 0), trees.where(F.col("tree_id") % k == 0)
        f = full.join(se.clade_frequencies(some, kept).select("clade", "frequency"), "clade", "left")
        f = f.select(F.lit(k).alias("every"), "clade", "all_trees", F.coalesce("frequency", F.lit(0.0)).alias("thinned"))
        out = f if out is None else out.unionByName(f)
    return out.withColumn("delta", F.round(F.col("thinned") - F.col("all_trees"), 9))


def compare_diversity(left: DataFrame, left_trees: DataFrame, right: DataFrame, right_trees: DataFrame) -> DataFrame:
    """Of two sets of trees: trees, topologies, share of the most frequent one, effective number (exponential of the entropy), mean distance of two trees.

    A clade that c of n trees have adds c (n - c) to the sum of the distances over all pairs, so no pairs are made.
    """

    def one(side: str, clades: DataFrame, trees: DataFrame) -> DataFrame:
        n = trees.select("tree_id").distinct().agg(F.count("*").alias("trees"))
        t = se.topologies(clades, trees).join(F.broadcast(n))
        p = F.col("tree_count") / F.col("trees")
        shape = t.agg(F.max("trees").alias("trees"), F.count("*").alias("topologies"), F.round(F.max(p), 9).alias("dominant"), F.round(F.exp(-F.sum(p * F.log(p))), 6).alias("effective"))
        c = F.col("tree_count").cast("double")
        far = se.clade_frequencies(clades, trees).join(F.broadcast(n)).agg(F.sum(c * (F.col("trees") - c)).alias("_d"))
        mean = F.round(F.coalesce(F.try_divide(F.col("_d"), F.col("trees") * (F.col("trees") - 1) / 2), F.lit(0.0)), 6)
        return shape.join(far).select(F.lit(side).alias("side"), "trees", "topologies", "dominant", "effective", mean.alias("mean_distance"))  # rows of one

    return one("left", left, left_trees).unionByName(one("right", right, right_trees))


def burnin_clade_shifts(clades: DataFrame, trees: DataFrame, cuts: tuple[int, ...]) -> DataFrame:
    """Clade frequencies after dropping the trees up to each cut of the id."""
    full = se.clade_frequencies(clades, trees).select("clade", F.col("frequency").alias("before"))
    out = None
    for cut in cuts:
        f = full.join(se.clade_frequencies(clades.where(F.col("tree_id") > cut), trees.where(F.col("tree_id") > cut)).select("clade", "frequency"), "clade", "left")
        f = f.select(F.lit(cut).alias("cut"), "clade", F.round(F.coalesce("frequency", F.lit(0.0)) - F.col("before"), 9).alias("shift"))
        out = f if out is None else out.unionByName(f)
    return out


def subsample(trees: DataFrame, most: int, seed: int) -> DataFrame:
    """At most ``most`` trees of each set (set_id, tree_id), the first by a digest of the seed and the id."""
    w = Window.partitionBy("set_id").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("tree_id").cast("string"))))
    return trees.select("set_id", "tree_id", F.row_number().over(w).alias("drawn")).where(F.col("drawn") <= most)


def disparity_through_time(nodes: DataFrame, traits: DataFrame) -> DataFrame:
    """At each branching time the mean disparity of the lineages that cross it, over that of the whole tree; ``traits`` has (tree_id, tip, value)."""
    up = tree.ancestors(nodes).join(traits, ["tree_id", "tip"])
    inner = up.groupBy("tree_id", F.col("ancestor").alias("name")).agg(F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("v"))
    whole = inner.where("name = 'root'").select("tree_id", F.col("v").alias("all_v")).where("all_v > 0")
    lineages = nodes.where("parent is not null").join(inner, ["tree_id", "name"], "left").join(whole, "tree_id")
    lineages = lineages.select("tree_id", (F.col("root_dist") - F.col("branch_length")).alias("since"), F.col("root_dist").alias("upto"), (F.coalesce("v", F.lit(0.0)) / F.col("all_v")).alias("relative"))
    times = nodes.where("not is_tip").select("tree_id", F.col("root_dist").alias("time")).distinct()
    return times.join(lineages, "tree_id").where("since <= time and time < upto").groupBy("tree_id", "time").agg(F.count("*").alias("lineages"), F.round(F.avg("relative"), 6).alias("disparity"))


# Traces


def burnin_diagnosis(trace: DataFrame, fraction: float = 0.1, shift: float = 0.5, least: int = 4) -> DataFrame:
    """After the burn-in: mean of the first and second half, their distance in standard deviations, and whether that passes."""
    n = F.count("*").over(Window.partitionBy("chain"))
    kept = trace.withColumn("n", n).where(F.col("iteration") > F.floor(F.col("n") * fraction)).withColumn("from", F.floor(F.col("n") * fraction))
    late = F.col("iteration") - F.col("from") > F.floor((F.col("n") - F.col("from")) / 2)
    of = kept.groupBy("chain").agg(F.count("*").alias("kept"), F.avg(F.when(~late, F.col("value"))).alias("a"), F.avg(F.when(late, F.col("value"))).alias("b"), F.stddev_samp("value").alias("sd"))
    by = F.round(F.try_divide(F.col("b") - F.col("a"), F.nullif(F.col("sd"), F.lit(0.0))), 6)
    return of.select("chain", "kept", by.alias("shift"), ((F.col("kept") >= least) & F.coalesce(F.abs(by) <= shift, F.lit(False))).alias("settled"))


def convergence(ess: DataFrame, shifts: DataFrame, least: float = 20.0, shift: float = 0.5) -> DataFrame:
    """Chains whose effective size and shift both pass."""
    of = ess.join(shifts, "chain")
    return of.select("chain", "ess", "shift", ((F.col("ess") >= least) & F.coalesce(F.abs("shift") <= shift, F.lit(False))).alias("converged"))


def model_averages(samples: DataFrame) -> DataFrame:
    """(family, model, value): each model's share of a family's samples, its mean, and the average over models."""
    of = samples.groupBy("family", "model").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    w = Window.partitionBy("family")
    return of.select("family", "model", "n", _share(F.col("n"), F.sum("n").over(w)).alias("share"), F.round(F.col("total") / F.col("n"), 6).alias("mean"), F.round(F.sum("total").over(w) / F.sum("n").over(w), 6).alias("average"))


# Taxa and tables


def rank_of(label: Column) -> Column:
    """accession, sample, species, genus, population or unknown by a label's form, in the order of the rules."""
    plain, low = F.trim(label), F.lower(F.trim(label))
    species = plain.rlike(r"^[A-Z][a-z]+(?:[ _][a-z][a-z-]+){1,2}$")
    isolate, sample = low.rlike("isolate|strain|clone|cultivar|lineage"), low.rlike("sample|specimen|individual|indiv|voucher") | plain.rlike(r"^[A-Za-z]+[-_]\d{2,}$")
    return (
        F.when(plain.rlike(r"^[A-Z]{1,4}_?\d{4,}(?:\.\d+)?$|^[A-Z]{2}\d{6,}(?:\.\d+)?$"), "accession").when(species, "species").when(isolate | sample, "sample").when(plain.rlike(r"^[A-Z][a-z-]+$"), "genus")
        .when(low.rlike("population|pop|subpopulation|lineage|clade"), "population").otherwise("unknown")
    )


def ranks(labels: DataFrame) -> DataFrame:
    return labels.select("source", "label", rank_of(F.col("label")).alias("rank"))


def rank_consistency(labels: DataFrame) -> DataFrame:
    """Labels of each rank in a source, and whether the source mixes ranks other than unknown."""
    of = ranks(labels).groupBy("source", "rank").agg(F.count("*").alias("n"))
    return of.withColumn("mixed", F.count(F.when(F.col("rank") != "unknown", 1)).over(Window.partitionBy("source")) > 1)


def identities(labels: DataFrame) -> DataFrame:
    """Different labels with one normal form (letters and digits, in lower case)."""
    key = F.lower(F.regexp_replace("label", "[^0-9A-Za-z]", ""))
    of = labels.select("label", key.alias("identity")).distinct().groupBy("identity").agg(F.count("*").alias("labels"), F.min("label").alias("first_label"), F.max("label").alias("last_label"))
    return of.where("labels > 1")


def synonym_audit(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("status").agg(F.count("*").alias("labels"), F.countDistinct("accepted").alias("names"))


def mapping_conflicts(resolved: DataFrame) -> DataFrame:
    """Accepted names that several labels lead to."""
    of = resolved.groupBy("accepted").agg(F.count("*").alias("labels"), F.min("label").alias("first_label"), F.sum((F.col("status") == "renamed").cast("long")).alias("renamed"))
    return of.where("labels > 1")


def stability(presence: DataFrame, runs: int) -> DataFrame:
    """(run, taxon): the share of runs that have a taxon."""
    n = presence.distinct().groupBy("taxon").agg(F.count("*").alias("runs"))
    return n.select("taxon", "runs", F.round(F.col("runs") / runs, 9).alias("share"), (F.col("runs") == runs).alias("stable"))


def align_to_order(order: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of ``table`` for the taxa of ``order`` (grp, taxon, place), with their rank among those found."""
    both = order.join(table, "taxon")
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy("place", "taxon")))


def column_report(table: DataFrame, columns: list[str]) -> DataFrame:
    """Filled cells and different values of each column, in one pass."""
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")
    filled = (F.col("value").isNotNull()) & (F.col("value") != "")
    return table.select(values).select("x.*").groupBy("field").agg(F.sum(filled.cast("long")).alias("filled"), F.count("*").alias("rows"), F.countDistinct(F.when(filled, F.col("value"))).alias("different"))


def trait_readiness(traits: DataFrame, least: int = 3) -> DataFrame:
    """(grp, taxon, value): usable values, and what stands in the way."""
    of = traits.groupBy("grp").agg(F.count("*").alias("taxa"), F.count("value").alias("values"), F.countDistinct("value").alias("different"))
    why = F.concat_ws("|", F.when(F.col("values") < F.col("taxa"), "missing"), F.when(F.col("values") < least, "few"), F.when(F.col("different") < 2, "constant"))
    return of.withColumn("problems", why).withColumn("ready", F.col("problems") == "")


def sampling_fractions(tips: DataFrame, declared: DataFrame) -> DataFrame:
    """Audit of the sampling fractions (grp, taxon, fraction as text) declared for the tips (grp, taxon) of a tree.

    A fraction is missing (empty), invalid (no number) or out of range (not over 0 and up to 1). ``fraction`` is the mean of
    the good ones; they differ if their first nine digits do.
    """
    given = declared.select("grp", "taxon", F.trim("fraction").alias("raw")).withColumn("_there", F.lit(True))
    rows = tips.select("grp", "taxon").distinct().join(given, ["grp", "taxon"], "left")
    there = F.coalesce("_there", F.lit(False))
    blank = there & (F.coalesce("raw", F.lit("")) == "")
    value = F.when(there & ~blank, F.col("raw").try_cast("double"))
    invalid = there & ~blank & value.isNull()
    good = F.when((value > 0) & (value <= 1), value)
    n = F.count_if
    of = rows.groupBy("grp").agg(n(there).alias("matched"), n(~there).alias("missing_taxa"), n(blank).alias("missing"), n(invalid).alias("invalid"), n(value.isNotNull() & good.isNull()).alias("out_of_range"), F.round(F.avg(good), 9).alias("fraction"), (F.countDistinct(F.round(good, 9)) > 1).alias("heterogeneous"))
    bad = F.col("missing") + F.col("invalid") + F.col("out_of_range")
    return of.withColumn("complete", (F.col("missing_taxa") == 0) & (bad == 0))


def readiness(crosswalk: DataFrame) -> DataFrame:
    """How many taxa each set of surfaces has."""
    return crosswalk.groupBy("surfaces").agg(F.count("*").alias("taxa"))


def model_matrix(rows: DataFrame, factor: str, numbers: list[str], key: str = "taxon") -> DataFrame:
    """Treatment coding in long form: the intercept, the numbers, and one 0/1 term for each level of the factor but the first."""
    levels = rows.select(F.col(factor).alias("level")).where("level is not null").distinct()
    first = levels.agg(F.min("level").alias("first"))
    own = F.array(F.struct(F.lit("(Intercept)").alias("term"), F.lit(1.0).alias("x")), *(F.struct(F.lit(c).alias("term"), F.col(c).cast("double").alias("x")) for c in numbers))
    usable = rows.where(" and ".join(f"{c} is not null" for c in [factor, *numbers]))
    plain = usable.select(key, F.explode(own).alias("t")).select(key, "t.*")
    # the matrix is sparse: a taxon has the one term of its level
    coded = usable.join(F.broadcast(first)).where(F.col(factor) != F.col("first")).select(key, F.concat(F.lit(f"{factor}="), F.col(factor)).alias("term"), F.lit(1.0).alias("x"))
    return plain.unionByName(coded)


# States along branches


def illegal_states(states: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    return states.where(F.col("state").isNull() | ~F.col("state").isin(*allowed)).groupBy("state").agg(F.count("*").alias("n"), F.min("taxon").alias("first_taxon"))


def state_coding(states: DataFrame, coding: DataFrame) -> DataFrame:
    """Raw states by their code; states without one are left out of a model."""
    of = states.groupBy("state").agg(F.count("*").alias("taxa"))
    return of.join(coding, "state", "left").select("state", "code", "taxa", F.col("code").isNotNull().alias("coded"))


def sure_of(p: Column) -> Column:
    return F.when(p >= 0.9, "strong").when(p >= 0.6, "moderate").otherwise("weak")


def migration_events(edges: DataFrame) -> DataFrame:
    """Branches (parent_state, child_state, support, age) whose states differ, by their support."""
    moved = edges.where("parent_state <> child_state")
    return moved.groupBy("parent_state", "child_state", sure_of(F.col("support")).alias("sure")).agg(F.count("*").alias("events"), F.min("age").alias("youngest"), F.max("age").alias("oldest"))


def certainty(parent: Column, child: Column) -> Column:
    """no_switch, certain_switch (one host on either side) or uncertain_switch (hosts in common, or several) of two sets of hosts."""
    return F.when(F.array_sort(parent) == F.array_sort(child), "no_switch").when(F.arrays_overlap(parent, child), "uncertain_switch").when((F.size(parent) == 1) & (F.size(child) == 1), "certain_switch").otherwise("uncertain_switch")


def switches(edges: DataFrame, allowed: DataFrame) -> DataFrame:
    """Switches between the best hosts of (parent_state, child_state, parent_set, child_set, support) by certainty, with whether a matrix (parent_state, child_state) allows them."""
    kind = F.when(F.col("parent_state") == F.col("child_state"), "no_switch").otherwise(certainty(F.col("parent_set"), F.col("child_set")))
    n = edges.withColumn("certainty", kind).where("certainty <> 'no_switch'").groupBy("parent_state", "child_state", "certainty").agg(F.count("*").alias("switches"), F.round(F.avg("support"), 6).alias("support"))
    return n.join(allowed.distinct().withColumn("allowed", F.lit(True)), ["parent_state", "child_state"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def retention(edges: DataFrame) -> DataFrame:
    """Of the branches that begin in a state, those that stay and those that leave."""
    stay = (F.col("parent_state") == F.col("child_state")).cast("long")
    of = edges.groupBy("parent_state").agg(F.count("*").alias("branches"), F.sum(stay).alias("stay"))
    return of.select(F.col("parent_state").alias("state"), "branches", "stay", _share(F.col("branches") - F.col("stay"), F.col("branches")).alias("leaving"))


def transitions_by_time(edges: DataFrame, bins: DataFrame) -> DataFrame:
    """Transitions in each bin (bin, from_age, to_age)."""
    moved = edges.where("parent_state <> child_state").join(F.broadcast(bins), F.expr("age >= from_age and age < to_age"))
    return moved.groupBy("bin", "parent_state", "child_state").agg(F.count("*").alias("n"))


def chronology(edges: DataFrame) -> DataFrame:
    """First, median and last age of each kind of transition."""
    moved = edges.where("parent_state <> child_state")
    return moved.groupBy("parent_state", "child_state").agg(F.count("*").alias("n"), F.max("age").alias("first"), F.round(F.percentile("age", F.lit(0.5)), 6).alias("median"), F.min("age").alias("last"))


def sampling_weights(tips: DataFrame) -> DataFrame:
    """Tips of each region (region, taxon), their share, and the weight that evens the regions out."""
    n = tips.groupBy("region").agg(F.count("*").alias("tips"))
    total = n.agg(F.sum("tips").alias("total"), F.count("*").alias("regions"))
    return n.join(F.broadcast(total)).select("region", "tips", _share(F.col("tips"), F.col("total")).alias("share"), _share(F.col("total"), F.col("regions") * F.col("tips")).alias("weight"))
