"""Comparative statistics as aggregates, and rankings of fitted models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trait_summary(traits: DataFrame, by: list[str]) -> DataFrame:
    """n, mean, sample variance, least and most of (value) in each group."""
    return traits.groupBy(*by).agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.var_samp("value"), 4).alias("variance"), F.min("value").alias("least"), F.max("value").alias("most"))


def disparity(traits: DataFrame, by: list[str]) -> DataFrame:
    """Mean squared distance over all pairs of each group: twice the sample variance, so no pairs are made."""
    return traits.groupBy(*by).agg(F.count("value").alias("n"), F.round(2 * F.var_samp("value"), 4).alias("disparity"))


def relative_disparity(traits: DataFrame, by: list[str]) -> DataFrame:
    whole = traits.agg(F.var_samp("value").alias("whole"))
    of = traits.groupBy(*by).agg(F.count("value").alias("n"), F.var_samp("value").alias("v"))
    return of.join(F.broadcast(whole)).select(*by, "n", F.round(F.col("v") / F.nullif(F.col("whole"), F.lit(0.0)), 6).alias("relative_disparity"))


def sister_contrasts(pairs: DataFrame) -> DataFrame:
    """Signed standardised contrasts of (left_value, right_value, left_length, right_length)."""
    return pairs.withColumn("contrast", F.round((F.col("left_value") - F.col("right_value")) / F.sqrt(F.col("left_length") + F.col("right_length")), 9))


def regression_through_origin(contrasts: DataFrame, by: list[str]) -> DataFrame:
    return contrasts.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.sum(F.col("x") * F.col("y")) / F.nullif(F.sum(F.col("x") * F.col("x")), F.lit(0.0)), 6).alias("slope"))


def one_way_anova(traits: DataFrame, group: str) -> DataFrame:
    """F of the group means over the whole table."""
    of = traits.groupBy(group).agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    grand = traits.agg(F.avg("value").alias("grand"))
    s = of.join(F.broadcast(grand)).agg(F.count("*").alias("groups"), F.sum("n").alias("total"), F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), 2)).alias("between"), F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0))).alias("within"))
    f = (F.col("between") / (F.col("groups") - 1)) / (F.col("within") / (F.col("total") - F.col("groups")))
    return s.select("groups", "total", F.round(f, 6).alias("f"))


def rank_models(fits: DataFrame, by: list[str]) -> DataFrame:
    """AIC, AICc, rank by (aicc, aic, model), delta and Akaike weight of (model, lnl, k, n); models without a likelihood drop out."""
    aic = 2 * F.col("k") - 2 * F.col("lnl")
    room = F.col("n") - F.col("k") - 1
    rows = fits.where("lnl is not null").withColumn("aic", F.round(aic, 6)).withColumn("aicc", F.round(F.when(room > 0, aic + 2 * F.col("k") * (F.col("k") + 1) / room).otherwise(F.lit(float("inf"))), 6))
    w = Window.partitionBy(*by)
    rows = rows.withColumn("rank", F.row_number().over(w.orderBy("aicc", "aic", "model"))).withColumn("delta", F.round(F.col("aicc") - F.min("aicc").over(w), 6))
    e = F.exp(-F.col("delta") / 2)
    return rows.withColumn("weight", F.round(e / F.sum(e).over(w), 6))


def benjamini_hochberg(tests: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    """Adjusted p values of (p) within each family, with a running minimum from the largest."""
    w = Window.partitionBy(*by)
    rows = tests.withColumn("m", F.count("*").over(w)).withColumn("i", F.row_number().over(w.orderBy("p", "test")))
    q = rows.withColumn("q0", F.least(F.lit(1.0), F.col("p") * F.col("m") / F.col("i")))
    q = q.withColumn("q", F.round(F.min("q0").over(w.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)), 9))
    return q.drop("q0", "m").withColumn("significant", F.col("q") <= alpha)


def outliers(traits: DataFrame, by: list[str], threshold: float = 3.0) -> DataFrame:
    """Standard scores within the group, of those at or above the threshold."""
    w = Window.partitionBy(*by)
    z = F.round((F.col("value") - F.avg("value").over(w)) / F.nullif(F.stddev_samp("value").over(w), F.lit(0.0)), 6)
    return traits.withColumn("z", z).where(F.abs("z") >= threshold)


def state_imbalance(states: DataFrame, by: list[str], rare: float = 0.05) -> DataFrame:
    """Share of each state in its group; rare ones are flagged."""
    n = states.groupBy(*by, "state").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*by))
    return n.withColumn("share", F.round(share, 9)).withColumn("rare", F.col("share") < rare)


def consistency_bounds(states: DataFrame) -> DataFrame:
    """Least (states - 1) and greatest (taxa - largest state) steps of each character (character, taxon, state)."""
    n = states.groupBy("character", "state").agg(F.count("*").alias("n"))
    return n.groupBy("character").agg((F.count("*") - 1).alias("min_steps"), (F.sum("n") - F.max("n")).alias("max_steps"), F.sum("n").alias("taxa"))


def indices(steps: DataFrame, bounds: DataFrame) -> DataFrame:
    """CI = m / s and RI = (g - s) / (g - m); null for constant characters and for g = m."""
    rows = steps.join(bounds, "character")
    ci = F.when(F.col("min_steps") > 0, F.col("min_steps") / F.col("steps"))
    ri = F.when(F.col("max_steps") != F.col("min_steps"), (F.col("max_steps") - F.col("steps")) / (F.col("max_steps") - F.col("min_steps")))
    return rows.select("character", "steps", "min_steps", "max_steps", F.round(ci, 9).alias("ci"), F.round(ri, 9).alias("ri"))


def fitch_two_level(states: DataFrame) -> DataFrame:
    """Fitch steps on two-level trees in one plan: tips fold into their group, groups into the root.

    ``states`` has (tree_id, grp, grp_order, tip_order, state). A polytomy is folded from left
    to right, pairwise: the intersection if there is one, else the union and a step.
    """

    def fold(sets):
        start = F.struct(F.get(sets, 0).alias("s"), F.lit(0).cast("long").alias("steps"))
        return F.aggregate(
            F.slice(sets, 2, F.greatest(F.size(sets) - 1, F.lit(0))),
            start,
            lambda acc, x: F.when(F.arrays_overlap(acc.s, x), F.struct(F.array_intersect(acc.s, x).alias("s"), acc.steps.alias("steps"))).otherwise(F.struct(F.array_union(acc.s, x).alias("s"), (acc.steps + 1).alias("steps"))),
        )

    tip = F.transform(F.sort_array(F.collect_list(F.struct("tip_order", "state"))), lambda p: F.array(p.state))
    groups = states.groupBy("tree_id", "grp", "grp_order").agg(tip.alias("sets")).withColumn("f", fold(F.col("sets")))
    root = groups.groupBy("tree_id").agg(F.sum("f.steps").alias("below"), F.transform(F.sort_array(F.collect_list(F.struct("grp_order", F.col("f.s").alias("s")))), lambda p: p.s).alias("sets"))
    root = root.withColumn("f", fold(F.col("sets")))
    return root.select("tree_id", (F.col("below") + F.col("f.steps")).alias("steps"), F.array_join(F.array_sort("f.s"), "|").alias("root_states"))


def transitions(edges: DataFrame) -> DataFrame:
    """Edges whose two ends differ, counted by (parent_state, child_state)."""
    return edges.where("parent_state <> child_state").groupBy("parent_state", "child_state").agg(F.count("*").alias("n"))


def great_circle_km(lat1, lon1, lat2, lon2, radius: float = 6371.0088):
    """Haversine distance of columns in degrees."""
    rad = F.radians
    h = F.pow(F.sin((rad(lat2) - rad(lat1)) / 2), 2) + F.cos(rad(lat1)) * F.cos(rad(lat2)) * F.pow(F.sin((rad(lon2) - rad(lon1)) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(h, F.lit(1.0))))
