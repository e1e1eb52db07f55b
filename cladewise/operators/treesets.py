"""Reductions over sets of trees.

``clades`` frames have (tree_id, clade), the clade as its sorted tips joined by '|'; one row
for each informative clade of a tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladewise.functions.lineage import ranked


def clades_of_levels(tips: DataFrame) -> DataFrame:
    """Informative clades of two-level trees (tree_id, tip, a, b): tips that share a, and tips that share a and b."""
    sizes = tips.groupBy("tree_id").agg(F.count("*").alias("taxa"))
    one = tips.groupBy("tree_id", "a").agg(F.array_join(F.sort_array(F.collect_list("tip")), "|").alias("clade"), F.count("*").alias("size")).select("tree_id", "clade", "size")
    two = tips.groupBy("tree_id", "a", "b").agg(F.array_join(F.sort_array(F.collect_list("tip")), "|").alias("clade"), F.count("*").alias("size")).select("tree_id", "clade", "size")
    both = one.unionByName(two).distinct().join(sizes, "tree_id")
    return both.where("size > 1 and size < taxa").select("tree_id", "clade", "size")


def clade_frequencies(clades: DataFrame, trees: DataFrame) -> DataFrame:
    """Trees with each clade, and their share of all ``trees`` (tree_id)."""
    total = trees.select("tree_id").distinct().agg(F.count("*").alias("trees"))
    counts = clades.groupBy("clade").agg(F.count("*").alias("tree_count"))
    # the total is one row
    return counts.join(F.broadcast(total)).select("clade", "tree_count", F.round(F.col("tree_count") / F.col("trees"), 9).alias("frequency"))


def consensus(clades: DataFrame, trees: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Clades with a frequency of the threshold or more (at it too)."""
    return clade_frequencies(clades, trees).where(F.col("frequency") >= threshold)


def maximum_clade_credibility(clades: DataFrame, trees: DataFrame) -> DataFrame:
    """The tree with the largest sum of clade frequencies; the earliest of ties."""
    f = clade_frequencies(clades, trees)
    sums = clades.join(f, "clade").groupBy("tree_id").agg(F.round(F.sum("frequency"), 6).alias("score"))
    return sums.orderBy(F.desc("score"), "tree_id").limit(1)


def credible_set(clades: DataFrame, trees: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Clades by falling frequency until the running sum reaches the threshold."""
    f = clade_frequencies(clades, trees)
    run = ranked(f, [F.desc("frequency"), F.col("clade")], "rank", {"cumulative": "frequency"}).withColumn("cumulative", F.round("cumulative", 6))
    return run.where(F.col("cumulative") - F.col("frequency") < threshold).select("rank", "clade", "frequency", "cumulative")


def topologies(clades: DataFrame, trees: DataFrame) -> DataFrame:
    """Trees with the same set of clades: signature, count, first tree."""
    signature = trees.select("tree_id").distinct().join(clades, "tree_id", "left").groupBy("tree_id").agg(F.array_join(F.sort_array(F.collect_list("clade")), ";").alias("signature"))
    return signature.groupBy("signature").agg(F.count("*").alias("tree_count"), F.min("tree_id").alias("first_tree"))


def topology_diversity(clades: DataFrame, trees: DataFrame) -> DataFrame:
    """Distinct topologies and the exponential of their Shannon entropy."""
    t = topologies(clades, trees)
    total = t.agg(F.sum("tree_count").alias("n"))
    p = t.join(F.broadcast(total)).select((F.col("tree_count") / F.col("n")).alias("p"))
    return p.agg(F.count("*").alias("topologies"), F.round(F.exp(-F.sum(F.col("p") * F.log("p"))), 6).alias("effective"), F.round(F.max("p"), 9).alias("largest_share"))


def multimodality(clades: DataFrame, trees: DataFrame, share: float = 0.05) -> DataFrame:
    t = topologies(clades, trees)
    total = t.agg(F.sum("tree_count").alias("n"))
    return t.join(F.broadcast(total)).withColumn("share", F.round(F.col("tree_count") / F.col("n"), 9)).where(F.col("share") >= share).select("signature", "tree_count", "share")


def robinson_foulds_to(clades: DataFrame, trees: DataFrame, reference: DataFrame) -> DataFrame:
    """Distance of each tree to one set of clades (clade): left + right - 2 shared, over left + right (0 for none)."""
    size = reference.select("clade").distinct().agg(F.count("*").alias("right_size"))
    shared = clades.join(reference.select("clade").distinct(), "clade", "left_semi").groupBy("tree_id").agg(F.count("*").alias("shared"))
    left = clades.groupBy("tree_id").agg(F.count("*").alias("left_size"))
    rows = trees.select("tree_id").distinct().join(left, "tree_id", "left").join(shared, "tree_id", "left").fillna(0).join(F.broadcast(size))
    d = F.col("left_size") + F.col("right_size") - 2 * F.col("shared")
    return rows.select("tree_id", "shared", d.alias("distance"), F.round(F.coalesce(F.try_divide(d, F.col("left_size") + F.col("right_size")), F.lit(0.0)), 9).alias("normalised"))


def topology_distance_matrix(clades: DataFrame, trees: DataFrame) -> DataFrame:
    """Robinson-Foulds distance of all pairs of distinct topologies (trees of one topology are at 0)."""
    t = topologies(clades, trees).select(F.sha2("signature", 256).substr(1, 12).alias("topology"), "signature", "tree_count")
    sets = t.select("topology", F.filter(F.split("signature", ";"), lambda x: x != "").alias("clades"))
    a = sets.select(F.col("topology").alias("left"), F.col("clades").alias("l"))
    b = sets.select(F.col("topology").alias("right"), F.col("clades").alias("r"))
    # all pairs of topologies are the result, and their number is bounded by the taxa, not by the trees
    both = a.join(b, F.col("left") < F.col("right"))
    return both.select("left", "right", (F.size("l") + F.size("r") - 2 * F.size(F.array_intersect("l", "r"))).alias("distance"))


def compatibility(clades: DataFrame, trees: DataFrame) -> DataFrame:
    """All pairs of clades: compatible if disjoint or nested."""
    f = clade_frequencies(clades, trees)
    a = f.select(F.col("clade").alias("left"), F.split("clade", r"\|").alias("l"), F.col("frequency").alias("fl"))
    b = f.select(F.col("clade").alias("right"), F.split("clade", r"\|").alias("r"), F.col("frequency").alias("fr"))
    both = a.join(b, F.col("left") < F.col("right"))
    common = F.size(F.array_intersect("l", "r"))
    return both.select("left", "right", ((common == 0) | (common == F.size("l")) | (common == F.size("r"))).alias("compatible"), F.round(F.least("fl", "fr"), 9).alias("weaker"))


def conflicting_pairs(clades: DataFrame) -> DataFrame:
    """(left, right) of clades that overlap without one holding the other; they meet by the taxa they share."""
    members = clades.select("clade").distinct().select("clade", F.explode(F.split("clade", r"\|")).alias("taxon"), F.size(F.split("clade", r"\|")).alias("size"))
    a, b = members.toDF("left", "taxon", "l"), members.toDF("right", "taxon", "r")
    common = a.join(b, "taxon").where("left < right").groupBy("left", "right", "l", "r").agg(F.count("*").alias("n"))
    return common.where(F.col("n") < F.least("l", "r")).select("left", "right")


def conflicts(clades: DataFrame, trees: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Incompatible pairs that both reach the threshold."""
    often = clade_frequencies(clades, trees).where(F.col("frequency") >= threshold)
    f = often.select("clade", "frequency")
    pairs = conflicting_pairs(often.select("clade")).join(f.toDF("left", "fl"), "left").join(f.toDF("right", "fr"), "right")
    return pairs.select("left", "right", F.round(F.least("fl", "fr"), 9).alias("weaker"))


def cooccurrence(clades: DataFrame, trees: DataFrame) -> DataFrame:
    """Phi correlation of all pairs of clades that occur together in some tree."""
    total = trees.select("tree_id").distinct().agg(F.count("*").alias("n"))
    a, b = clades.select("tree_id", F.col("clade").alias("left")), clades.select("tree_id", F.col("clade").alias("right"))
    both = a.join(b, "tree_id").where("left < right").groupBy("left", "right").agg(F.count("*").alias("together"))
    c = clades.groupBy("clade").agg(F.count("*").alias("k"))
    rows = both.join(c.select(F.col("clade").alias("left"), F.col("k").alias("x")), "left").join(c.select(F.col("clade").alias("right"), F.col("k").alias("y")), "right").join(F.broadcast(total))
    var = F.sqrt(F.col("x").cast("double") * (F.col("n") - F.col("x")) * F.col("y") * (F.col("n") - F.col("y")))
    return rows.select("left", "right", "together", F.round((F.col("n") * F.col("together") - F.col("x") * F.col("y")) / F.nullif(var, F.lit(0.0)), 6).alias("phi"))


def unstable_taxa(tips: DataFrame) -> DataFrame:
    """1 - the share of each tip's most frequent company (the tips that share its clade)."""
    groups = tips.groupBy("tree_id", "a").agg(F.array_join(F.sort_array(F.collect_list("tip")), "|").alias("company"))
    placed = tips.join(groups, ["tree_id", "a"]).groupBy("tip", "company").agg(F.count("*").alias("n"))
    of = placed.groupBy("tip").agg(F.sum("n").alias("trees"), F.max("n").alias("dominant"), F.count("*").alias("placements"))
    return of.select("tip", "trees", "placements", F.round(1 - F.col("dominant") / F.col("trees"), 9).alias("instability"))


def compare_sets(left: DataFrame, left_trees: DataFrame, right: DataFrame, right_trees: DataFrame) -> DataFrame:
    """Clade frequencies of two sets of trees side by side."""
    a = clade_frequencies(left, left_trees).select("clade", F.col("frequency").alias("left_frequency"))
    b = clade_frequencies(right, right_trees).select("clade", F.col("frequency").alias("right_frequency"))
    both = a.join(b, "clade", "full").fillna(0.0)
    return both.withColumn("delta", F.round(F.col("right_frequency") - F.col("left_frequency"), 9))


def thin(trees: DataFrame, every: int) -> DataFrame:
    """Every k-th tree in order of its id."""
    return trees.withColumn("i", F.row_number().over(Window.partitionBy("set_id").orderBy("tree_id"))).where((F.col("i") - 1) % every == 0).drop("i")
