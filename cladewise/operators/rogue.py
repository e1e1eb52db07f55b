"""What a set of trees gains when one taxon is left out.

Leaving out a taxon changes a tree only at the clades that hold it: such a clade loses it, and goes where it
is then a single tip or a clade that the tree has already; the clade of all other tips goes too. So counts
of clades, the clades of a tree and the distances of trees are those of the whole set, moved by the changed
clades alone. Trees of one topology are one row with their number.

The mean distance over all pairs of trees needs no pairs: a pair has 1 - 2 * shared / (l + r), with l and r its
clades, and the shared ones are summed clade by clade over the numbers of trees that have the clade and l clades.
In trees that are resolved each taxon takes exactly one clade with it; where its parent has more than two
children it takes none, and only those trees are gone through once more for it.

All trees must have the same taxa, four at least; one with a clade of a taxon outside ``taxa`` is an error of the
caller. Null trees, taxa and clades are passed over, repeated rows count once, and a set without trees gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.functions.lineage import checkpoint, ranked


def _distinct_topologies(clades: DataFrame, trees: DataFrame) -> DataFrame:
    """(t, w, s, clades): topologies by number, with their trees and clades."""
    of = clades.where("clade is not null").select("tree_id", "clade").distinct()
    each = trees.where("tree_id is not null").select("tree_id").distinct().join(of, "tree_id", "left").groupBy("tree_id").agg(F.sort_array(F.collect_list("clade")).alias("clades"))
    sets = each.groupBy("clades").agg(F.count("*").alias("w"))
    return sets.select(F.sha2(F.array_join("clades", ";"), 256).alias("t"), "w", F.size("clades").alias("s"), "clades")


def _shared(vector: str, less: int) -> Column:
    """Sum of shared / (l + r) over the pairs of trees that have a clade; ``vector`` has (s, m): m trees with s clades, ``less`` of them gone."""
    both = lambda a, b: F.greatest(a.s + b.s - 2 * less, F.lit(1))
    later = lambda a: F.aggregate(F.filter(vector, lambda b: b.s > a.s), F.lit(0.0), lambda q, b: q + a.m * b.m / both(a, b))
    return F.aggregate(vector, F.lit(0.0), lambda q, a: q + later(a) + a.m * (a.m - 1) / 2 / both(a, a))


def _changes(topologies: DataFrame, taxa: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """((taxon, t, w, s, old, new) of all changed clades, one row for each taxon and topology without any)."""
    rows = topologies.select("t", "w", "s", F.explode("clades").alias("old")).withColumn("tips", F.split("old", r"\|"))
    holds = rows.select("t", "w", "s", "old", F.explode("tips").alias("taxon"), "tips")
    rest = F.array_remove("tips", F.col("taxon"))
    holds = holds.select("taxon", "t", "w", "s", "old", F.when(F.size("tips") > 2, F.array_join(rest, "|")).alias("new"))
    known = rows.select("t", F.col("old").alias("new"), F.lit(True).alias("known"))
    holds = holds.join(known, ["t", "new"], "left").withColumn("new", F.when(F.col("known").isNull(), F.col("new"))).drop("known")
    # all taxa in one row, bounded by the taxa of a tree
    whole = F.broadcast(taxa.agg(F.sort_array(F.collect_list("taxon")).alias("all")))
    others = rows.where(F.size("tips") == n - 1).join(whole).select(F.array_except("all", "tips")[0].alias("taxon"), "t", "w", "s", "old", F.lit(None).cast("string").alias("new"))
    none = topologies.join(whole).select(F.explode("all").alias("taxon"), "t", "w", "s", F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new"))
    return holds.unionByName(others), none


def drop_one_taxon(clades: DataFrame, trees: DataFrame, taxa: DataFrame, threshold: float = 0.5, lengths: DataFrame | None = None) -> DataFrame:
    """One row for each taxon: consensus resolution and mean support (percent), mean Robinson-Foulds distance (rooted, over all clades of
    both trees), different topologies and the share of the most frequent one, before and after the taxon is left out.

    ``clades`` (tree_id, clade), ``trees`` (tree_id), ``taxa`` (taxon), ``lengths`` (taxon, branch_length) of its tips. Rank 1 gains most: by
    resolution, support, distance, the distance that is left, name. Resolution is the clades at or above the threshold over taxa - 2.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    taxa = taxa.where("taxon is not null").select("taxon").distinct()
    n = taxa.count()
    if 0 < n < 4:
        raise ValueError("leaving out taxa needs four of them")
    topologies = checkpoint(_distinct_topologies(clades, trees))
    changes, none = _changes(topologies, taxa, n)
    changes = checkpoint(changes)

    # clades of each tree without the taxon: those that went, and the set by two hashes
    hashed = lambda c, seed: F.when(F.col(c).isNotNull(), F.xxhash64(c, F.lit(seed))).otherwise(0)
    bits = lambda seed: F.bit_xor(hashed("old", seed).bitwiseXOR(hashed("new", seed)))
    moved = changes.unionByName(none).groupBy("taxon", "t", "w", "s").agg((F.count("old") - F.count("new")).alias("loss"), bits(1).alias("d1"), bits(2).alias("d2"))
    folded = lambda seed: F.aggregate("clades", F.lit(0).cast("long"), lambda q, c: q.bitwiseXOR(F.xxhash64(c, F.lit(seed))))
    whole = topologies.select("t", folded(1).alias("h1"), folded(2).alias("h2"))
    moved = checkpoint(moved.join(whole, "t").select("taxon", "t", "w", "s", "loss", *(F.col(f"h{i}").bitwiseXOR(F.col(f"d{i}")).alias(f"h{i}") for i in (1, 2))))
    shapes = moved.groupBy("taxon", "h1", "h2").agg(F.sum("w").alias("w")).groupBy("taxon").agg(F.count("*").alias("pruned_topologies"), F.max("w").alias("most"))
    empty = moved.groupBy("taxon").agg(F.sum(F.when(F.col("s") == F.col("loss"), F.col("w")).otherwise(0)).alias("empty"))

    # numbers of trees by clade, and by clade and clades of the tree
    total = topologies.agg(F.sum("w").alias("n"), F.count("*").alias("baseline_topologies"), F.max("w").alias("base_most"), F.sum(F.when(F.col("s") == 0, F.col("w")).otherwise(0)).alias("base_empty"))
    by_size = topologies.select("w", "s", F.explode("clades").alias("clade")).groupBy("clade", "s").agg(F.sum("w").alias("m"))
    vector = F.collect_list(F.struct(F.col("s").cast("long").alias("s"), F.col("m").cast("double").alias("m"))).alias("v")
    counts = by_size.groupBy("clade").agg(F.sum("m").alias("count"), vector)
    support = lambda count: F.when(count / F.col("n") >= threshold, 100.0 * count / F.col("n"))
    counts = checkpoint(counts.join(F.broadcast(total.select("n"))).select("clade", "count", "n", "v", support(F.col("count")).alias("support"), _shared("v", 0).alias("shared"), _shared("v", 1).alias("less")))
    base = counts.agg(F.count("support").alias("k"), F.coalesce(F.sum("support"), F.lit(0.0)).alias("sum"), F.coalesce(F.sum("shared"), F.lit(0.0)).alias("shared"), F.coalesce(F.sum("less"), F.lit(0.0)).alias("less"))

    old = changes.where("old is not null").select("taxon", F.col("old").alias("clade")).distinct()
    gone = old.join(counts, "clade").select("taxon", F.when(F.col("support").isNotNull(), -1).otherwise(0).alias("k"), (-F.coalesce("support", F.lit(0.0))).alias("sum"), (-F.col("less")).alias("less"))
    # clades that more trees have now, or trees of more clades than the others
    came = changes.where("new is not null").join(moved.select("taxon", "t", "loss"), ["taxon", "t"]).select("taxon", F.col("new").alias("clade"), (F.col("s") + 1 - F.col("loss")).alias("s"), F.col("w").cast("double").alias("m"), F.col("w").alias("more"))
    kept = moved.where("loss = 0").select("taxon", "t").join(topologies, "t").select("taxon", "w", "s", F.explode("clades").alias("clade"))
    kept = kept.where(~F.array_contains(F.split("clade", r"\|"), F.col("taxon")))
    sign = lambda up: kept.select("taxon", "clade", (F.col("s") + up).cast("long").alias("s"), (F.col("w") * (2 * up - 1)).cast("double").alias("m"), F.lit(0).cast("long").alias("more"))
    steps = reduce(DataFrame.unionByName, (came, sign(0), sign(1)))
    steps = checkpoint(steps.groupBy("taxon", "clade", "s").agg(F.sum("m").alias("m"), F.sum("more").alias("more")))
    touched = steps.groupBy("taxon", "clade").agg(F.sum("more").alias("more"), F.collect_list(F.struct("s", "m")).alias("steps")).join(counts.drop("shared", "n"), "clade", "left").join(F.broadcast(total.select("n")))
    bins = F.concat(F.coalesce("v", F.array().cast("array<struct<s:bigint,m:double>>")), "steps")
    at = lambda s: F.aggregate(F.filter(F.col("bins"), lambda b: b.s == s), F.lit(0.0), lambda q, b: q + b.m)
    summed = F.transform(F.array_distinct(F.transform("bins", lambda b: b.s)), lambda s: F.struct(s.alias("s"), at(s).alias("m")))
    touched = touched.withColumn("bins", bins).withColumn("new_v", F.filter(summed, lambda b: b.m > 0))
    after = support(F.coalesce("count", F.lit(0)) + F.col("more"))
    risen = touched.select("taxon", (after.isNotNull().cast("int") - F.col("support").isNotNull().cast("int")).alias("k"), (F.coalesce(after, F.lit(0.0)) - F.coalesce("support", F.lit(0.0))).alias("sum"), (_shared("new_v", 1) - F.coalesce("less", F.lit(0.0))).alias("less"))
    delta = gone.unionByName(risen).groupBy("taxon").agg(F.sum("k").alias("dk"), F.sum("sum").alias("dsum"), F.sum("less").alias("dless"))

    rows = taxa.join(shapes, "taxon").join(empty, "taxon").join(delta, "taxon", "left").fillna(0, ["dk", "dsum", "dless"]).join(F.broadcast(total)).join(F.broadcast(base))
    pairs = F.col("n").cast("double") * (F.col("n") - 1) / 2
    far = lambda empty, shared: F.round(F.coalesce(F.try_divide(pairs - F.col(empty).cast("double") * (F.col(empty) - 1) / 2 - 2 * shared, pairs), F.lit(0.0)), 9)
    mean = lambda k, of: F.round(F.coalesce(F.try_divide(of, k), F.lit(0.0)), 9)
    rows = rows.select(
        "taxon",
        F.round(F.col("k") / (n - 2), 9).alias("baseline_resolution"), F.round((F.col("k") + F.col("dk")) / max(n - 3, 1), 9).alias("pruned_resolution"),
        mean(F.col("k"), F.col("sum")).alias("baseline_support"), mean(F.col("k") + F.col("dk"), F.col("sum") + F.col("dsum")).alias("pruned_support"),
        far("base_empty", F.col("shared")).alias("baseline_distance"), far("empty", F.col("less") + F.col("dless")).alias("pruned_distance"),
        "baseline_topologies", "pruned_topologies",
        F.round(F.col("base_most") / F.col("n"), 9).alias("baseline_dominant"), F.round(F.col("most") / F.col("n"), 9).alias("pruned_dominant"),
    )
    for name, better in (("resolution", 1), ("support", 1), ("distance", -1), ("topologies", -1), ("dominant", 1)):
        rows = rows.withColumn(f"{name}_gain", F.round(better * (F.col(f"pruned_{name}") - F.col(f"baseline_{name}")), 9))
    own = (lengths if lengths is not None else taxa.withColumn("branch_length", F.lit(None).cast("double"))).groupBy("taxon").agg(F.round(F.avg("branch_length"), 9).alias("mean_branch_length"))
    return ranked(rows.join(own, "taxon", "left"), [F.desc("resolution_gain"), F.desc("support_gain"), F.desc("distance_gain"), F.col("pruned_distance"), F.col("taxon")], "rank")
