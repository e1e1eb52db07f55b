"""Tree operators over ``nodes`` (tree_id, name, parent, branch_length, level, is_tip, pre, post, root_dist).

``pre`` is the preorder rank and ``post`` the last rank in a node's subtree, so descendants
are an interval and no query recurses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tips_of(nodes: DataFrame) -> DataFrame:
    return nodes.where("is_tip").select("tree_id", F.col("pre").alias("tip_pre"), F.col("name").alias("tip"), F.col("root_dist").alias("tip_dist"))


def tip_counts(nodes: DataFrame) -> DataFrame:
    """Number of tips below each node, from running tip counts in preorder (no join of intervals)."""
    w = Window.partitionBy("tree_id").orderBy("pre")
    run = nodes.withColumn("upto", F.sum(F.col("is_tip").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = run.select("tree_id", F.col("pre").alias("post"), F.col("upto").alias("end_upto"))
    return run.join(ends, ["tree_id", "post"]).withColumn("tips", F.col("end_upto") - F.col("upto") + F.col("is_tip").cast("long")).drop("upto", "end_upto")


def depths(nodes: DataFrame) -> DataFrame:
    return nodes.select("tree_id", "name", "level", F.col("root_dist").alias("depth"), "is_tip")


def inspect(nodes: DataFrame) -> DataFrame:
    """One row per tree: tips, internal nodes, total length, height, polytomies."""
    kids = nodes.where("parent is not null").groupBy("tree_id", F.col("parent").alias("name")).agg(F.count("*").alias("children"))
    poly = kids.groupBy("tree_id").agg(F.sum((F.col("children") > 2).cast("long")).alias("polytomies"), F.max("children").alias("most_children"))
    base = nodes.groupBy("tree_id").agg(
        F.sum(F.col("is_tip").cast("long")).alias("tips"), F.sum((~F.col("is_tip")).cast("long")).alias("internal"), F.round(F.sum("branch_length"), 6).alias("total_length"), F.round(F.max("root_dist"), 6).alias("height")
    )
    return base.join(poly, "tree_id")


def ultrametricity(nodes: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    t = nodes.where("is_tip").groupBy("tree_id").agg(F.min("root_dist").alias("least"), F.max("root_dist").alias("most"), F.round(F.avg("root_dist"), 6).alias("mean"))
    return t.withColumn("spread", F.round(F.col("most") - F.col("least"), 6)).withColumn("ultrametric", F.col("spread") <= tolerance)


def shape(nodes: DataFrame) -> DataFrame:
    """Sackin index, cherries, and Colless index (null unless every internal node has two children)."""
    counted = tip_counts(nodes)
    sackin = nodes.where("is_tip").groupBy("tree_id").agg(F.sum("level").cast("long").alias("sackin"), F.count("*").alias("tips"))
    kids = counted.where("parent is not null").groupBy("tree_id", "parent").agg(
        F.count("*").alias("children"), F.bool_and("is_tip").alias("all_tips"), (F.max("tips") - F.min("tips")).alias("imbalance")
    )
    of = kids.groupBy("tree_id").agg(
        F.sum(((F.col("children") == 2) & F.col("all_tips")).cast("long")).alias("cherries"), F.bool_and(F.col("children") == 2).alias("binary"), F.sum("imbalance").alias("imbalance")
    )
    return sackin.join(of, "tree_id").select("tree_id", "tips", "sackin", "cherries", F.when(F.col("binary"), F.col("imbalance")).alias("colless"))


def clades(nodes: DataFrame) -> DataFrame:
    """Internal nodes with their tips: count, mean depth below the node, and first and last tip by name."""
    inner = nodes.where("not is_tip").select("tree_id", "name", "level", "pre", "post", "root_dist")
    below = inner.join(tips_of(nodes), "tree_id").where((F.col("tip_pre") >= F.col("pre")) & (F.col("tip_pre") <= F.col("post")))
    return below.groupBy("tree_id", "name", "level").agg(
        F.count("*").alias("tips"), F.round(F.avg(F.col("tip_dist") - F.col("root_dist")), 6).alias("mean_depth"), F.min("tip").alias("first_tip"), F.max("tip").alias("last_tip")
    )


def ancestors(nodes: DataFrame) -> DataFrame:
    """(tree_id, tip, ancestor, ...) for all ancestors of each tip."""
    inner = nodes.where("not is_tip").select("tree_id", F.col("name").alias("ancestor"), F.col("level").alias("ancestor_level"), "pre", "post", F.col("root_dist").alias("ancestor_dist"))
    return tips_of(nodes).join(inner, "tree_id").where((F.col("tip_pre") >= F.col("pre")) & (F.col("tip_pre") <= F.col("post"))).drop("pre", "post")


def mrca(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """Most recent common ancestor of each group of tips (tree_id, group, tip): the deepest node over all."""
    span = groups.join(nodes.where("is_tip").select("tree_id", F.col("name").alias("tip"), "pre"), ["tree_id", "tip"]).groupBy("tree_id", "group").agg(F.min("pre").alias("lo"), F.max("pre").alias("hi"), F.count("*").alias("members"))
    inner = nodes.where("not is_tip").select("tree_id", "name", "level", "pre", "post", "root_dist")
    over = span.join(inner, "tree_id").where((F.col("pre") <= F.col("lo")) & (F.col("post") >= F.col("hi")))
    return over.groupBy("tree_id", "group").agg(F.max_by("name", "level").alias("mrca"), F.max("root_dist").alias("mrca_depth"), F.first("members").alias("members"))


def monophyly(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """Whether a group is all tips below its common ancestor."""
    of = mrca(nodes, groups)
    size = tip_counts(nodes).select("tree_id", F.col("name").alias("mrca"), "tips")
    return of.join(size, ["tree_id", "mrca"]).select("tree_id", "group", "mrca", "members", "tips", (F.col("members") == F.col("tips")).alias("monophyletic"))


def patristic_to_root_clades(nodes: DataFrame, level: int) -> DataFrame:
    """Mean patristic distance between the tips of two clades of one level, from sums (no pairs of tips)."""
    at = nodes.where(F.col("level") == level).select("tree_id", "name", "parent", "pre", "post", "root_dist")
    inside = at.join(tips_of(nodes), "tree_id").where((F.col("tip_pre") >= F.col("pre")) & (F.col("tip_pre") <= F.col("post")))
    mean = inside.groupBy("tree_id", "name", "parent", "root_dist").agg(F.avg("tip_dist").alias("mean_tip"))
    up = nodes.select("tree_id", F.col("name").alias("parent"), F.col("root_dist").alias("parent_dist"))
    mean = mean.join(up, ["tree_id", "parent"])
    a = mean.select("tree_id", F.col("name").alias("left"), F.col("parent").alias("pa"), F.col("mean_tip").alias("ma"), F.col("parent_dist").alias("shared"))
    b = mean.select("tree_id", F.col("name").alias("right"), F.col("parent").alias("pb"), F.col("mean_tip").alias("mb"))
    both = a.join(b, "tree_id").where("left < right")
    meet = F.when(F.col("pa") == F.col("pb"), F.col("shared")).otherwise(F.lit(0.0))
    return both.select("tree_id", "left", "right", F.round(F.col("ma") + F.col("mb") - 2 * meet, 6).alias("mean_distance"))


def branching_times(nodes: DataFrame) -> DataFrame:
    """Root height less the depth of each internal node."""
    height = nodes.groupBy("tree_id").agg(F.max("root_dist").alias("height"))
    return nodes.where("not is_tip").join(height, "tree_id").select("tree_id", "name", F.round(F.col("height") - F.col("root_dist"), 9).alias("age"))


def lineages_through_time(nodes: DataFrame) -> DataFrame:
    """Lineages after each branching, oldest first; a final row for the present."""
    kids = nodes.where("parent is not null").groupBy("tree_id", F.col("parent").alias("name")).agg(F.count("*").alias("children"))
    events = branching_times(nodes).join(kids, ["tree_id", "name"])
    w = Window.partitionBy("tree_id").orderBy(F.desc("age"), "name").rowsBetween(Window.unboundedPreceding, 0)
    return events.select("tree_id", "name", "age", (F.sum(F.col("children") - 1).over(w) + 1).alias("lineages"))


def gamma_statistic(times: DataFrame) -> DataFrame:
    """Pybus and Harvey's gamma from (tree_id, age) branching times of binary trees, oldest first."""
    w = Window.partitionBy("tree_id").orderBy(F.desc("age"))
    g = times.withColumn("k", F.row_number().over(w).cast("long") + 1).withColumn("gap", F.col("age") - F.coalesce(F.lead("age").over(w), F.lit(0.0)))
    run = g.withColumn("t", F.sum(F.col("k") * F.col("gap")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.max("k")
    of = run.groupBy("tree_id").agg(n.alias("n"), F.max("t").alias("total"), F.sum(F.when(F.col("gap").isNotNull(), F.col("t"))).alias("all_t"))
    inner = (F.col("all_t") - F.col("total")) / (F.col("n") - 2)
    return of.where("n > 2").select("tree_id", "n", F.round((inner - F.col("total") / 2) / (F.col("total") * F.sqrt(1 / (12.0 * (F.col("n") - 2)))), 6).alias("gamma"))


# Branch transforms, as columns over (branch_length, parent_dist, root_dist, is_tip)


def with_parent_depth(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("parent_dist", F.col("root_dist") - F.col("branch_length"))


def rescale(nodes: DataFrame, mode: str, value: float = 1.0) -> DataFrame:
    """Transformed branch lengths: lambda, kappa, delta, ou, early_burst, white or speciational."""
    rows = with_parent_depth(nodes)
    height = F.max("root_dist").over(Window.partitionBy("tree_id"))
    b, p, d = F.col("branch_length"), F.col("parent_dist"), F.col("root_dist")
    new: dict[str, Column] = {
        "lambda": F.when(F.col("is_tip"), b + (1 - value) * p).otherwise(b * value),
        "kappa": F.when(b > 0, F.pow(b, F.lit(value))).otherwise(0.0),
        "delta": height * (F.pow(d / height, F.lit(value)) - F.pow(p / height, F.lit(value))),
        "ou": (F.exp(-2 * value * (height - d)) * (1 - F.exp(-2 * value * d)) - F.exp(-2 * value * (height - p)) * (1 - F.exp(-2 * value * p))) / (2 * value),
        "early_burst": (F.exp(-value * p) - F.exp(-value * d)) / value if value else b,
        "white": F.when(F.col("is_tip"), F.lit(1.0)).otherwise(0.0),
        "speciational": F.when(b > 0, 1.0).otherwise(0.0),
    }
    return rows.withColumn("new_length", F.round(new[mode], 9)).select("tree_id", "name", "branch_length", "new_length")


def root_to_tip(tips: DataFrame) -> DataFrame:
    """Least squares of distance on date for (tree_id, date, distance): slope, intercept, r2 and date of distance 0."""
    of = tips.groupBy("tree_id").agg(F.count("*").alias("n"), F.regr_slope("distance", "date").alias("slope"), F.regr_intercept("distance", "date").alias("intercept"), F.regr_r2("distance", "date").alias("r2"))
    return of.select("tree_id", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), F.round("r2", 6).alias("r2"), F.round(-F.col("intercept") / F.nullif(F.col("slope"), F.lit(0.0)), 4).alias("origin"))


def prune(nodes: DataFrame, keep: DataFrame) -> DataFrame:
    """Tips that are in ``keep`` (tree_id, name), with all their ancestors that still branch; unary nodes merge."""
    tips = nodes.where("is_tip").join(keep, ["tree_id", "name"], "left_semi")
    inner = nodes.where("not is_tip")
    up = inner.select("tree_id", F.col("name").alias("anc"), F.col("pre").alias("apre"), F.col("post").alias("apost"), F.col("level").alias("alevel"), F.col("root_dist").alias("adist"))
    over = tips.select("tree_id", "name", "pre", "root_dist").join(up, "tree_id").where((F.col("pre") > F.col("apre")) & (F.col("pre") <= F.col("apost")))
    # an ancestor branches if its remaining tips lie below two or more of its children
    child = nodes.where("parent is not null").select("tree_id", F.col("parent").alias("anc"), F.col("pre").alias("cpre"), F.col("post").alias("cpost"))
    branches = tips.select("tree_id", "pre").join(child, "tree_id").where((F.col("pre") >= F.col("cpre")) & (F.col("pre") <= F.col("cpost"))).select("tree_id", "anc", "cpre").distinct().groupBy("tree_id", "anc").agg(F.count("*").alias("k")).where("k > 1").select("tree_id", "anc")
    kept = over.join(branches, ["tree_id", "anc"])
    nearest = kept.groupBy("tree_id", "name").agg(F.max_by("anc", "alevel").alias("new_parent"), F.max("adist").alias("pdist"), F.first("root_dist").alias("dist"))
    return nearest.select("tree_id", "name", "new_parent", F.round(F.col("dist") - F.col("pdist"), 9).alias("branch_length"))
