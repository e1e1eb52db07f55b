"""Transformations of trees and two-state parsimony as plans over ``nodes`` (see :mod:`cladewise.operators.trees`)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladewise.operators import reviews as rv
from cladewise.operators import trees as tree


def derived_below(nodes: DataFrame, states: DataFrame) -> DataFrame:
    """Nodes with ``tips`` below them and ``ones``, those in state '1', from running sums in preorder; ``states`` has (tree_id, name, state)."""
    own = nodes.join(states.where("state = '1'").select("tree_id", "name", F.lit(1).alias("one")), ["tree_id", "name"], "left").withColumn("one", F.coalesce("one", F.lit(0)).cast("long"))
    w = Window.partitionBy("tree_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    run = tree.tip_counts(own).withColumn("upto", F.sum("one").over(w))
    ends = run.select("tree_id", F.col("pre").alias("post"), F.col("upto").alias("end_upto"))
    return run.join(ends, ["tree_id", "post"]).withColumn("ones", F.col("end_upto") - F.col("upto") + F.col("one")).drop("upto", "end_upto", "one")


def _with_parent(rows: DataFrame) -> DataFrame:
    up = rows.select("tree_id", F.col("name").alias("parent"), F.col("tips").alias("parent_tips"), F.col("ones").alias("parent_ones"), F.col("pre").alias("parent_pre"))
    return rows.join(up, ["tree_id", "parent"], "left")


def camin_sokal(nodes: DataFrame, states: DataFrame) -> DataFrame:
    """Gains that nothing undoes: the largest clades with '1' in all their tips."""
    rows = _with_parent(derived_below(nodes, states))
    top = (F.col("ones") == F.col("tips")) & (F.col("parent_tips").isNull() | (F.col("parent_ones") < F.col("parent_tips")))
    return rows.groupBy("tree_id").agg(F.sum(top.cast("long")).alias("gains"))


def dollo(nodes: DataFrame, states: DataFrame) -> DataFrame:
    """One gain at the common ancestor of the tips in '1', and the largest clades below it without any as losses."""
    rows = _with_parent(derived_below(nodes, states))
    total = rows.where("parent is null").select("tree_id", F.col("ones").alias("total"))
    rows = rows.join(total, "tree_id")
    gain = rows.where("total > 0 and ones = total").groupBy("tree_id").agg(F.max_by("pre", "level").alias("lo"), F.max_by("post", "level").alias("hi"))
    lost = rows.join(gain, "tree_id").where("ones = 0 and parent_ones > 0 and parent_pre between lo and hi").groupBy("tree_id").agg(F.count("*").alias("losses"))
    zero = F.lit(0).cast("long")
    return total.join(lost, "tree_id", "left").select("tree_id", F.when(F.col("total") > 0, 1).otherwise(0).cast("long").alias("gains"), F.coalesce("losses", zero).alias("losses"))


def collapse(nodes: DataFrame, threshold: float) -> DataFrame:
    """Without inner branches shorter than the threshold; what hung on them hangs on the next ancestor, their length added."""
    short = (~F.col("is_tip")) & F.col("parent").isNotNull() & (F.col("branch_length") < threshold)
    kept = nodes.where(~short)
    up = kept.where("not is_tip").select("tree_id", F.col("name").alias("anc"), F.col("pre").alias("lo"), F.col("post").alias("hi"), F.col("level").alias("anc_level"), F.col("root_dist").alias("anc_dist"))
    over = kept.select("tree_id", "name", "pre", "root_dist").join(up, "tree_id").where("pre > lo and pre <= hi")
    near = over.groupBy("tree_id", "name").agg(F.max_by("anc", "anc_level").alias("new_parent"), F.max("anc_dist").alias("anc_dist"), F.first("root_dist").alias("dist"))
    return near.select("tree_id", "name", "new_parent", F.round(F.col("dist") - F.col("anc_dist"), 9).alias("new_length"))


def ladderize(nodes: DataFrame) -> DataFrame:
    """New preorder ranks with smaller clades first, ties by their first tip."""
    first = rv.clade_ids(nodes).select("tree_id", "name", F.substring_index("clade", "|", 1).alias("first_tip"))
    sized = tree.tip_counts(nodes).join(first, ["tree_id", "name"], "left").withColumn("first_tip", F.coalesce("first_tip", "name"))
    ranked = sized.withColumn("rank", F.lpad(F.row_number().over(Window.partitionBy("tree_id", "parent").orderBy("tips", "first_tip", "name")).cast("string"), 9, "0"))
    up = ranked.select("tree_id", F.col("pre").alias("lo"), F.col("post").alias("hi"), F.col("level").alias("above"), "rank")
    own = nodes.select("tree_id", "name", "pre").join(up, "tree_id").where("pre between lo and hi")
    path = own.groupBy("tree_id", "name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("above", "rank"))), lambda x: x.rank), "").alias("path"))
    return path.select("tree_id", "name", F.row_number().over(Window.partitionBy("tree_id").orderBy("path")).alias("new_pre"))


def midpoints(nodes: DataFrame) -> DataFrame:
    """Where the midpoint root falls: the two farthest tips, and the branch (by its lower node) in their middle.

    ``offset`` is the way from the branch's lower node up to it; the first pair by name wins ties.
    """
    far = rv.tip_distances(nodes).groupBy("tree_id").agg(F.min(F.struct((-F.col("distance")).alias("d"), "left", "right")).alias("m"))
    far = far.select("tree_id", (-F.col("m.d")).alias("distance"), F.col("m.left").alias("left"), F.col("m.right").alias("right"))
    tips = nodes.where("is_tip").select("tree_id", F.col("name").alias("tip"), F.col("pre").alias("tip_pre"), F.col("root_dist").alias("tip_dist"))
    ends = far.join(tips.select("tree_id", F.col("tip").alias("left"), F.col("tip_dist").alias("l")), ["tree_id", "left"]).join(tips.select("tree_id", F.col("tip").alias("right"), F.col("tip_dist").alias("r")), ["tree_id", "right"])
    deep = ends.withColumn("tip", F.when(F.col("l") >= F.col("r"), F.col("left")).otherwise(F.col("right"))).join(tips, ["tree_id", "tip"])
    up = nodes.where("parent is not null").select("tree_id", F.col("name").alias("branch"), F.col("pre").alias("lo"), F.col("post").alias("hi"), F.col("root_dist").alias("below"), (F.col("root_dist") - F.col("branch_length")).alias("above"))
    half = F.col("tip_dist") - F.col("distance") / 2
    on = deep.join(up, "tree_id").where("tip_pre between lo and hi").where((F.col("above") <= half) & (half < F.col("below")))
    return on.select("tree_id", "left", "right", "distance", "branch", F.round(F.col("below") - half, 6).alias("offset"))
