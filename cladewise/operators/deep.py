"""Trees of any shape and depth: node rows from plain edges, passes over levels, structural identity, date randomisation.

Edges are (tree_id, node, parent, branch_length), parent null at a root. Paths to the root are summed by pointer
doubling, in as many rounds as the depth has binary digits; no row holds a tree.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladewise.functions.lineage import Scratch, ranked

KEY = ["tree_id", "node"]


def edge_problems(edges: DataFrame) -> DataFrame:
    """(tree_id, node, problem): a node given twice, a parent that is no node, a negative length; loops are found by :func:`node_rows`."""
    twice = edges.groupBy(*KEY).count().where("count > 1").select(*KEY, F.lit("duplicate_node").alias("problem"))
    known = edges.select("tree_id", F.col("node").alias("parent")).distinct()
    lost = edges.where("parent is not null").join(known, ["tree_id", "parent"], "left_anti").select(*KEY, F.lit("unknown_parent").alias("problem"))
    short = edges.where("branch_length < 0").select(*KEY, F.lit("negative_length").alias("problem"))
    return twice.unionByName(lost).unionByName(short)


def _climb(rows: DataFrame, sums: list[str], sizes: bool = False) -> DataFrame:
    """``rows`` (tree_id, node, parent, ...) with the columns ``sums`` added up over the path to the root.

    ``_up`` is the ancestor 1, 2, 4, ... steps away and the sums cover the way there. With ``sizes``, ``size``
    counts the nodes below and at a node: those nearer than so many steps, and those that their ancestor of that distance adds.
    ``_lost`` marks nodes whose path ends at an unknown parent or never.
    """
    scratch = Scratch(rows.sparkSession)
    state = scratch.write("0", rows.withColumns({"_up": F.col("parent"), "_lost": F.lit(False)} | ({"size": F.lit(1).cast("long")} if sizes else {})))
    left = state.where("_up is not null").count()
    last = math.ceil(math.log2(max(left, 1))) + 2
    i = 0
    while left and i < last:
        i += 1
        there = state.select("tree_id", F.col("node").alias("_up"), F.col("_up").alias("_next"), F.lit(True).alias("_there"), F.col("_lost").alias("_gone"), *(F.col(c).alias(f"_{c}") for c in sums))
        new = state.join(there, ["tree_id", "_up"], "left")
        far = F.col("_up").isNotNull()
        columns = {c: F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0)) for c in sums}
        columns |= {"_lost": F.col("_lost") | F.coalesce(F.col("_gone"), far & F.col("_there").isNull())}
        new = new.withColumns(columns).withColumn("_up", F.col("_next")).select(state.columns)
        if sizes:
            more = state.where("_up is not null").groupBy("tree_id", F.col("_up").alias("node")).agg(F.sum("size").alias("_more"))
            new = new.join(more, KEY, "left").withColumn("size", F.col("size") + F.coalesce("_more", F.lit(0))).select(state.columns)
        state = scratch.write(str(i), new)
        scratch.drop(str(i - 1))
        left = state.where("_up is not null").count()
    return state.withColumn("_lost", F.col("_lost") | F.col("_up").isNotNull()).drop("_up")


def node_rows(edges: DataFrame) -> DataFrame:
    """(tree_id, node, parent, branch_length, is_tip, level, root_dist, size, pre, post) of edges.

    Siblings come in the order of ``node``; roots of one tree are numbered one after another. Nodes that no root
    reaches have null in all columns after ``is_tip``. Of a node that is given twice the smallest (parent, length)
    counts. A missing length counts as 0 on the way to the root.
    """
    once = edges.groupBy(*KEY).agg(F.min(F.struct("parent", "branch_length")).alias("e")).select(*KEY, "e.*")
    inner = once.where("parent is not null").select("tree_id", F.col("parent").alias("node")).distinct().withColumn("_inner", F.lit(True))
    own = F.col("parent").isNotNull()
    start = once.join(inner, KEY, "left").select(
        *KEY, "parent", "branch_length", F.col("_inner").isNull().alias("is_tip"), own.cast("int").alias("level"), F.when(own, F.coalesce(F.col("branch_length"), F.lit(0.0))).otherwise(0.0).alias("root_dist")
    )
    sized = _climb(start, ["level", "root_dist"], sizes=True)
    run = ranked(sized.where("not _lost"), ["tree_id", F.asc_nulls_first("parent"), "node"], "_rank", {"_upto": "size"})
    firsts = run.groupBy("tree_id", "parent").agg(F.min(F.col("_upto") - F.col("size")).alias("_base"))
    a, b = run.alias("a"), firsts.alias("b")
    step = a.join(b, (F.col("a.tree_id") == F.col("b.tree_id")) & F.col("a.parent").eqNullSafe(F.col("b.parent"))).select("a.tree_id", "a.node", "a.parent", (F.col("_upto") - F.col("size") - F.col("_base") + 1).alias("pre"))
    placed = _climb(step, ["pre"]).select(*KEY, "pre")
    clear = [F.when(~F.col("_lost"), F.col(c)).alias(c) for c in ("level", "root_dist", "size")]
    out = sized.select(*KEY, "parent", "branch_length", "is_tip", *clear).join(placed, KEY, "left")
    return out.withColumn("post", F.col("pre") + F.col("size") - 1)


def named(rows: DataFrame) -> DataFrame:
    """The nodes frame of the other operators (name instead of node)."""
    return rows.where("pre is not null").withColumnsRenamed({"node": "name"}).drop("size")


# Passes from the tips to the root, one level at a time


def sankoff(nodes: DataFrame, tip_states: DataFrame, costs: dict[str, dict[str, float]]) -> DataFrame:
    """Cost of each state at each inner node, and the states of least cost.

    ``nodes``: (tree_id, name, parent, level, is_tip); ``tip_states``: (tree_id, name, character, state) for tips, unknown
    states cost infinitely much everywhere; ``costs``: from a parent's state to a child's. A level reads its own rows
    only: tips lie in folders by level, and what a level sends up is summed by parent before the shuffle.
    """
    states = sorted(costs)
    far = F.lit(float("inf"))
    zero = [F.when(F.col("state") == s, 0.0).otherwise(far).alias(f"cost_{i}") for i, s in enumerate(states)]
    scratch = Scratch(nodes.sparkSession)
    tips = scratch.write("tips", nodes.where("is_tip").join(tip_states, ["tree_id", "name"]).select("tree_id", "parent", "level", "character", *zero), "level")
    inner = scratch.write("inner", nodes.where("not is_tip").select("tree_id", "name", "parent", "level"), "level")
    deepest = nodes.agg(F.max("level")).first()[0] or 0
    above = [F.sum(F.least(*(F.col(f"cost_{j}") + F.lit(float(costs[s][t])) for j, t in enumerate(states)))).alias(f"cost_{i}") for i, s in enumerate(states)]
    cost = [f"cost_{i}" for i in range(len(states))]
    done = None
    for level in range(deepest, 0, -1):
        rows = tips.where(F.col("level") == level).select("tree_id", "parent", "character", *cost)
        if done is not None:
            rows = rows.unionByName(done.select("tree_id", "parent", "character", *cost))
        sent = rows.groupBy("tree_id", F.col("parent").alias("name"), "character").agg(*above)
        up = inner.where(F.col("level") == level - 1).drop("level").join(sent, ["tree_id", "name"])
        done = scratch.write(f"costs/level={level - 1}", up)
    if done is None:
        return tips.select("tree_id", F.lit("").alias("name"), F.lit("").alias("character"), *cost, F.lit(0.0).alias("best"), F.lit("").alias("optimal_states"), F.lit(False).alias("tie")).where("false")
    all_rows = scratch.read("costs").select("tree_id", "name", "parent", "character", *cost)
    best = F.least(*(F.col(c) for c in cost))
    optimal = F.array_compact(F.array(*(F.when(F.col(c) == best, F.lit(s)) for c, s in zip(cost, states))))
    out = all_rows.withColumn("best", best).withColumn("_o", optimal)
    return out.select("tree_id", "name", "parent", "character", *cost, "best", F.array_join("_o", ",").alias("optimal_states"), (F.size("_o") > 1).alias("tie"))


def sankoff_scores(costs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(tree_id, character, cost, weighted_cost) at the roots; ``weights`` (character, weight), 1 where missing."""
    roots = costs.where("parent is null").select("tree_id", "character", F.col("best").alias("cost"))
    if weights is None:
        return roots.withColumn("weighted_cost", F.col("cost"))
    return roots.join(weights, "character", "left").select("tree_id", "character", "cost", (F.col("cost") * F.coalesce("weight", F.lit(1.0))).alias("weighted_cost"))


# Structural identity


def edge_keys(nodes: DataFrame, rooted: bool = True) -> DataFrame:
    """(tree_id, key, is_tip, branch_length, label): edges named by their tips, whatever the order of children.

    The key of a clade is the exclusive or of two hashes of its tips and their number, taken from running values in
    preorder; a split of an unrooted tree takes the smaller side. Of edges with one key the last in
    postorder counts. Tips of one label count as different ones.
    """
    again = F.when(F.col("is_tip"), F.row_number().over(Window.partitionBy("tree_id", "name", "is_tip").orderBy("pre")))
    code = [F.when(F.col("is_tip"), F.xxhash64(F.lit(seed), F.col("name"), F.col("_again"))).otherwise(F.lit(0).cast("long")) for seed in (1, 2)]
    upto = Window.partitionBy("tree_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    run = nodes.withColumn("_again", again).withColumns({"_x": code[0], "_y": code[1]})
    run = run.withColumns({"_rx": F.bit_xor("_x").over(upto), "_ry": F.bit_xor("_y").over(upto), "_rn": F.sum(F.col("is_tip").cast("long")).over(upto)})
    ends = run.select("tree_id", F.col("pre").alias("post"), F.col("_rx").alias("_ex"), F.col("_ry").alias("_ey"), F.col("_rn").alias("_en"))
    total = run.groupBy("tree_id").agg(F.bit_xor("_x").alias("_tx"), F.bit_xor("_y").alias("_ty"), F.sum(F.col("is_tip").cast("long")).alias("_tn"))
    both = run.join(ends, ["tree_id", "post"]).join(total, "tree_id")
    x, y = F.col("_ex").bitwiseXOR(F.col("_rx")).bitwiseXOR(F.col("_x")), F.col("_ey").bitwiseXOR(F.col("_ry")).bitwiseXOR(F.col("_y"))
    n = F.col("_en") - F.col("_rn") + F.col("is_tip").cast("long")
    side = F.struct(n.alias("n"), x.alias("x"), y.alias("y"))
    if not rooted:
        other = F.struct((F.col("_tn") - n).alias("n"), F.col("_tx").bitwiseXOR(x).alias("x"), F.col("_ty").bitwiseXOR(y).alias("y"))
        side = F.when(F.col("is_tip"), side).otherwise(F.least(side, other))
    edge = both.where("parent is not null").select("tree_id", "is_tip", side.alias("key"), "branch_length", "name", F.struct("post", -F.col("pre")).alias("_at"))
    last = edge.groupBy("tree_id", "is_tip", "key").agg(F.max(F.struct("_at", "branch_length", "name")).alias("e"))
    return last.select("tree_id", "key", "is_tip", F.col("e.branch_length").alias("branch_length"), F.coalesce("e.name", F.lit("")).alias("label"))


def signatures(nodes: DataFrame, rooted: bool = True, lengths: bool = False) -> DataFrame:
    """(tree_id, signature): equal for trees of one structure (and lengths), so equal trees meet by one key."""
    parts = ["is_tip", "key", *(["branch_length"] if lengths else [])]
    made = edge_keys(nodes, rooted).groupBy("tree_id").agg(F.count("*").alias("n"), *(F.bit_xor(F.xxhash64(F.lit(seed), *parts)).alias(f"h{seed}") for seed in (3, 4)))
    return made.select("tree_id", F.concat_ws("-", "n", F.hex("h3"), F.hex("h4")).alias("signature"))


def compare_structure(expected: DataFrame, observed: DataFrame, *, rooted: bool = True, tolerance: float = 0.0, labels: bool = True) -> DataFrame:
    """(tree_id, equivalent, reason, lengths, labels) of trees with one id: the first difference and how many edges differ.

    Reasons, in this order: a tree on one side only, other tips, other clades or splits, branch lengths, root label
    (rooted trees), internal labels.
    """
    e, o = (edge_keys(x, rooted).select("tree_id", "is_tip", "key", F.struct("branch_length", "label").alias(side)) for x, side in ((expected, "e"), (observed, "o")))
    pairs = e.join(o, ["tree_id", "is_tip", "key"], "full")
    a, b = F.col("e.branch_length"), F.col("o.branch_length")
    both = F.col("e").isNotNull() & F.col("o").isNotNull()
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    found = pairs.groupBy("tree_id").agg(
        count((~both) & F.col("is_tip")).alias("tips"), count((~both) & ~F.col("is_tip")).alias("clades"),
        count(both & (a.isNull() != b.isNull()) | F.coalesce(F.abs(a - b) > tolerance, F.lit(False))).alias("lengths"),
        count(both & ~F.col("is_tip") & (F.col("e.label") != F.col("o.label"))).alias("labels"),
    )
    root = lambda x, side: x.where("parent is null").groupBy("tree_id").agg(F.max(F.coalesce("name", F.lit(""))).alias(side))
    rows = root(expected, "_er").join(root(observed, "_or"), "tree_id", "full").join(found, "tree_id", "left")
    there = F.col("_er").isNotNull() & F.col("_or").isNotNull()
    reason = F.when(~there, "tree missing").when(F.col("tips") > 0, "tip labels differ").when(F.col("clades") > 0, "clades or splits differ").when(F.col("lengths") > 0, "branch lengths differ")
    if labels:
        reason = reason.when((F.col("_er") != F.col("_or")) & F.lit(rooted), "root label differs").when(F.col("labels") > 0, "internal labels differ")
    zero = [F.coalesce(F.when(there, F.col(c)), F.lit(0)).cast("long").alias(c) for c in ("lengths", "labels")]
    return rows.select("tree_id", reason.isNull().alias("equivalent"), reason.alias("reason"), *zero)


def compare_sets(expected: DataFrame, observed: DataFrame, **how) -> DataFrame:
    """One row: number of trees on either side, of equivalent pairs, and the first tree that differs."""
    found = compare_structure(expected, observed, **how)
    sizes = [x.agg(F.countDistinct("tree_id").alias(c)) for x, c in ((expected, "expected_trees"), (observed, "observed_trees"))]
    first = found.agg(F.count_if("equivalent").alias("equivalent_pairs"), F.min(F.when(~F.col("equivalent"), F.struct("tree_id", "reason"))).alias("_f"))
    one = sizes[0].join(sizes[1]).join(first)  # three tables of one row
    return one.select("expected_trees", "observed_trees", "equivalent_pairs", F.col("_f.tree_id").alias("first_different"), F.col("_f.reason").alias("reason"))


# Date randomisation


def date_randomization(tips: DataFrame, permutations: int = 99, seed: int = 17) -> DataFrame:
    """Root-to-tip r2 of (tree_id, tip, date, distance) against permuted dates.

    Replicate p gives the tip of rank i by name the date of the tip of rank i by a digest of seed, p and tip: the
    same on any partitioning. r2 is compared after rounding to 9 digits, so equal fits count as such. Trees without a fit are left out.
    """
    if permutations < 2:
        raise ValueError("at least two permutations")
    placed = tips.repartition(int(tips.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tree_id").select("tree_id", "tip", "date", "distance", F.row_number().over(Window.partitionBy("tree_id").orderBy("tip")).alias("j"))
    observed = placed.groupBy("tree_id").agg(F.count("*").alias("tips"), F.round(F.regr_r2("distance", "date"), 9).alias("r2"))
    runs = placed.select("*", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("p"))
    digest = F.md5(F.concat_ws(":", F.lit(seed), "p", "tip"))
    dealt = runs.withColumn("i", F.row_number().over(Window.partitionBy("tree_id", "p").orderBy(digest, "tip")))
    # a date goes to its rank by digest, a distance to that by name; they meet where the tree's tips are, without a shuffle or a table sent to all tasks
    none = F.lit(None).cast("double")
    cells = dealt.select("tree_id", "p", F.inline(F.array(F.struct("i", F.col("date").cast("double").alias("date"), none.alias("distance")), F.struct(F.col("j").alias("i"), none.alias("date"), F.col("distance").cast("double").alias("distance")))))
    pairs = cells.groupBy("tree_id", "p", "i").agg(F.max("date").alias("date"), F.max("distance").alias("distance"))
    null = pairs.groupBy("tree_id", "p").agg(F.round(F.regr_r2("distance", "date"), 9).alias("permuted"))
    of = null.join(observed.where("r2 is not null").hint("merge"), "tree_id").groupBy("tree_id", "tips", "r2")
    at = F.count_if(F.col("permuted") >= F.col("r2"))
    spread = [F.round(f("permuted"), 6).alias(n) for f, n in ((F.min, "null_least"), (F.avg, "null_mean"), (F.max, "null_most"))]
    return of.agg(at.alias("at_or_above"), *spread).withColumn("p_value", F.round((F.col("at_or_above") + 1) / F.lit(permutations + 1), 6)).withColumn("r2", F.round("r2", 6))

