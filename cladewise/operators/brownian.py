"""Brownian motion on trees of any shape as weighted sums, one level at a time: ancestral values, rates through time, movements.

Nodes are (tree_id, name, parent, branch_length, level, is_tip, root_dist), values (tree_id, name, trait, value) of tips. What a level
sends up is summed by parent before the shuffle; no group holds a tree. Tips without a value, and nodes without a
tip that has one, take no part. Branches shorter than 1e-12 count as that long.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.functions.lineage import Scratch, ranked

KEY = ["tree_id", "trait"]
NODE = ["tree_id", "name", "trait"]
#: The normal quantile of a 95 % interval, the earth's radius in km, km in a degree.
NORMAL_95, EARTH_KM, DEGREE_KM = 1.959963984540054, 6371.0088, 111.32
_LEAST = 1e-12
_STATE = ["tree_id", "name", "parent", "trait", "m", "w", "q", "n"]


def ancestral_values(nodes: DataFrame, values: DataFrame) -> DataFrame:
    """(tree_id, name, trait, is_tip, estimate, variance, conditional, conditional_variance, lower, upper, confidence, unstable).

    ``estimate`` of a node rests on the tips below it: its children's, each weighted by the reciprocal of its working
    length (branch plus what its own estimate adds); ``variance`` is the sum of these lengths, the contrast's variance at a node of two
    children. ``conditional`` rests on all tips, with the variance under the tree's own rate (null with one tip).
    ``confidence`` is 1 less the width of the 95 % interval over the range of the trait, 0 at least; a node is unstable over 0.6 of the range.
    A node with one child has the child's estimate. Null values count as missing; of a repeated value the smallest.
    """
    scratch = Scratch(nodes.sparkSession)
    known = values.where("value is not null").groupBy(*NODE).agg(F.min(F.col("value").cast("double")).alias("value"))
    tips = nodes.where("is_tip").join(known, ["tree_id", "name"]).select("tree_id", "name", "parent", "trait", "level", "value", _length().alias("w"))
    tips = scratch.write("tips", tips)
    spread = scratch.write("spread", tips.groupBy(*KEY).agg(F.avg("value").alias("_mean"), (F.max("value") - F.min("value")).alias("_range")))
    inner = scratch.write("inner", nodes.where("not is_tip").select("tree_id", "name", "parent", "level", _length().alias("b")), "level")
    start = tips.join(spread, KEY).select("tree_id", "name", "parent", "trait", (F.col("value") - F.col("_mean")).alias("m"), "w", F.lit(0.0).alias("q"), F.lit(1).cast("long").alias("n"), "level")
    start = scratch.write("start", start, "level")
    deepest = tips.agg(F.max("level")).first()[0] or 0

    one = lambda c: F.sum(c / F.col("w"))
    done = None
    for level in range(deepest, 0, -1):
        rows = start.where(F.col("level") == level).select(_STATE)
        if done is not None:
            rows = rows.unionByName(done.select(_STATE))
        sums = [one(F.lit(1.0)).alias("u"), one(F.col("m")).alias("_s"), one(F.col("m") ** 2).alias("_ss"), F.sum("w").alias("v"), F.sum("q").alias("_q"), F.sum("n").alias("n")]
        sent = rows.groupBy("tree_id", F.col("parent").alias("name"), "trait").agg(*sums)
        here = inner.where(F.col("level") == level - 1).join(sent, ["tree_id", "name"])
        squares = F.col("_q") + F.greatest(F.col("_ss") - F.col("_s") ** 2 / F.col("u"), F.lit(0.0))
        made = here.select("tree_id", "name", "parent", "trait", (F.col("_s") / F.col("u")).alias("m"), (F.col("b") + 1 / F.col("u")).alias("w"), squares.alias("q"), "n", "u", "v", "b")
        done = scratch.write(f"up/level={level - 1}", made)

    value = F.col("value")
    leaves = tips.select(*NODE, F.lit(True).alias("is_tip"), value.alias("estimate"), F.lit(0.0).alias("variance"), value.alias("conditional"), F.lit(0.0).alias("conditional_variance"))
    if done is None:
        return _judged(leaves, spread)
    up = scratch.read("up")
    full = scratch.write("full/level=0", up.where("level = 0").select(*NODE, "m", "v", F.col("u").alias("p"), F.col("m").alias("all")))
    for level in range(1, deepest):
        above = full.select("tree_id", F.col("name").alias("parent"), "trait", F.col("p").alias("_p"), F.col("all").alias("_all"))
        both = up.where(F.col("level") == level).join(above, ["tree_id", "parent", "trait"])
        rest = F.col("_p") - 1 / F.col("w")
        alone = rest <= _LEAST * F.col("_p")
        weight = F.when(alone, 0.0).otherwise(1 / (1 / rest + F.col("b")))
        far = F.when(alone, 0.0).otherwise((F.col("_p") * F.col("_all") - F.col("m") / F.col("w")) / rest)
        p = F.col("u") + weight
        full = scratch.write(f"full/level={level}", both.select(*NODE, "m", "v", p.alias("p"), ((F.col("u") * F.col("m") + weight * far) / p).alias("all")))
    rate = up.where("level = 0").groupBy(*KEY).agg(F.sum("q").alias("_q"), F.sum("n").alias("_n")).join(spread.select(*KEY, "_mean"), KEY)
    found = scratch.read("full").join(rate, KEY).select(
        *NODE, F.lit(False).alias("is_tip"), (F.col("m") + F.col("_mean")).alias("estimate"), F.col("v").alias("variance"), (F.col("all") + F.col("_mean")).alias("conditional"),
        F.when(F.col("_n") > 1, F.col("_q") / (F.col("_n") - 1) / F.col("p")).alias("conditional_variance"),
    )
    return _judged(leaves.unionByName(found), spread)


def _length() -> Column:
    return F.greatest(F.coalesce("branch_length", F.lit(0.0)), F.lit(_LEAST))


def _judged(rows: DataFrame, spread: DataFrame) -> DataFrame:
    half = NORMAL_95 * F.sqrt("variance")
    relative = 2 * half / F.greatest("_range", F.lit(_LEAST))
    of = rows.join(spread, KEY).withColumns({"lower": F.col("estimate") - half, "upper": F.col("estimate") + half, "confidence": 1 - F.least(relative, F.lit(1.0)), "unstable": relative > 0.6})
    return of.drop("_range", "_mean")


def _branches(nodes: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
    """Branches with the columns of both ends, those of the upper one with a '_' in front."""
    keys = ["tree_id", "name", *(["trait"] if "trait" in found.columns else [])]
    low = nodes.where("parent is not null").join(found.select(*keys, *columns), ["tree_id", "name"])
    high = found.select(*(F.col(k).alias("parent") if k == "name" else k for k in keys), *(F.col(c).alias(f"_{c}") for c in columns))
    return low.join(high, ["parent" if k == "name" else k for k in keys])


# Rates through time


def rate_intervals(nodes: DataFrame, found: DataFrame, intervals: int = 5) -> DataFrame:
    """Squared change along branches by equal intervals of depth, from the ``estimate`` of :func:`ancestral_values`.

    (tree_id, trait, interval, start, stop, branches, length, change, rate, share): a branch gives an interval the share of its squared
    change that lies there. Intervals without branches have a null rate; the depth is that of the deepest tip with a value.
    Branches without length have no part; values and overlaps that differ by rounding only (1e-12) count as none.
    """
    if intervals < 2:
        raise ValueError("at least two intervals")
    tips = found.where("is_tip").select("tree_id", "name", "trait")
    depth = nodes.select("tree_id", "name", "root_dist").join(tips, ["tree_id", "name"]).groupBy(*KEY).agg(F.max("root_dist").alias("_depth")).where("_depth > 0")
    edges = _branches(nodes, found, "estimate").where("branch_length > 0").join(depth, KEY)
    width = F.col("_depth") / intervals
    begin, end = F.col("root_dist") - F.col("branch_length"), F.col("root_dist")
    lo, hi = F.floor(begin / width) - 1, F.ceil(end / width)
    at = F.explode(F.sequence(F.greatest(lo, F.lit(0)).cast("int"), F.greatest(F.least(hi, F.lit(intervals - 1)), F.lit(0)).cast("int")))
    i = F.col("_i")
    stop = F.when(i == intervals - 1, F.col("_depth")).otherwise((i + 1) * width)
    parts = edges.withColumn("_i", at).withColumn("_overlap", F.least(end, stop) - F.greatest(begin, i * width)).where(F.col("_overlap") > _LEAST * F.col("_depth"))
    apart = F.abs(F.col("estimate") - F.col("_estimate"))
    apart = F.when(apart > _LEAST * F.greatest(F.abs("estimate"), F.abs("_estimate")), apart).otherwise(0.0)
    change = apart**2 * F.col("_overlap") / F.col("branch_length")
    sums = parts.groupBy(*KEY, "_i").agg(F.count("*").alias("branches"), F.sum("_overlap").alias("length"), F.sum(change).alias("change"))
    total = sums.groupBy(*KEY).agg(F.sum("change").alias("_total"))
    grid = depth.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(intervals - 1))))
    rows = grid.join(sums, [*KEY, "_i"], "left").join(total, KEY, "left").fillna(0, ["branches", "length", "change"])
    share = F.when(F.col("_total") > 0, F.col("change") / F.col("_total"))
    return rows.select(*KEY, (i + 1).alias("interval"), (i * width).alias("start"), stop.alias("stop"), "branches", "length", "change", F.when(F.col("length") > 0, F.col("change") / F.col("length")).alias("rate"), share.alias("share"))


def rate_trend(rows: DataFrame) -> DataFrame:
    """One row per tree and trait of :func:`rate_intervals`: first, last, peak and trough, slope of the rate and the trend.

    The slope is weighted by length and normalised by depth over mean rate. slowdown: at most -0.2 with a ratio of last to first
    of at most 0.85; acceleration: at least 0.2 and 1.15; otherwise stable; insufficient_data without two rates above 0 at the ends.
    Of rates equal to 6 digits the first is the peak or trough.
    """
    x, y, w = (F.col("start") + F.col("stop")) / 2, F.col("rate"), F.col("length")
    used = rows.withColumns({"_x": x, "_full": y.isNotNull()})
    x, even = F.col("_x"), F.round("rate", 6).alias("rate")
    keep = lambda c: F.when(F.col("_full"), c)
    of = used.groupBy(*KEY).agg(
        F.count_if("_full").alias("nonempty"), F.max("stop").alias("depth"), F.min_by("rate", keep(F.col("interval"))).alias("earliest"), F.max_by("rate", keep(F.col("interval"))).alias("latest"),
        F.max(keep(F.struct(even, (-F.col("interval")).alias("interval")))).getField("interval").alias("_peak"), F.min(keep(F.struct(even, "interval"))).getField("interval").alias("trough"),
        *(F.sum(keep(c)).alias(n) for n, c in {"_w": w, "_wx": w * x, "_wy": w * y, "_wxx": w * x * x, "_wxy": w * x * y}.items()),
    )
    spread = F.col("_wxx") - F.col("_wx") ** 2 / F.col("_w")
    slope = F.when(F.col("nonempty") > 1, F.when(spread <= 1e-12, 0.0).otherwise((F.col("_wxy") - F.col("_wx") * F.col("_wy") / F.col("_w")) / spread))
    mean = F.col("_wy") / F.col("_w")
    of = of.withColumns({"slope": slope, "ratio": F.when(F.col("earliest") > 0, F.col("latest") / F.col("earliest")), "peak": -F.col("_peak")})
    of = of.withColumn("normalised_slope", F.when(mean > 0, F.col("slope") * F.col("depth") / mean))
    n, r = F.col("normalised_slope"), F.col("ratio")
    enough = (F.col("nonempty") > 1) & n.isNotNull() & r.isNotNull() & (F.col("latest") > 0)
    trend = F.when(~enough, "insufficient_data").when((n <= -0.2) & (r <= 0.85), "slowdown").when((n >= 0.2) & (r >= 1.15), "acceleration").otherwise("stable")
    return of.select(*KEY, "nonempty", "depth", "earliest", "latest", "ratio", "slope", "normalised_slope", "peak", "trough", trend.alias("trend"))


# Movements


def coordinates(found: DataFrame, latitude: str = "latitude", longitude: str = "longitude") -> DataFrame:
    """(tree_id, name, is_tip, latitude, longitude, confidence, radial_error_km) of nodes that have both."""
    pick = lambda t, c: F.max(F.when(F.col("trait") == t, F.col(c)))
    both = found.groupBy("tree_id", "name", "is_tip").agg(
        pick(latitude, "estimate").alias("latitude"), pick(longitude, "estimate").alias("longitude"), pick(latitude, "variance").alias("_a"), pick(longitude, "variance").alias("_b"), F.min("confidence").alias("confidence")
    )
    error = DEGREE_KM * F.sqrt(F.col("_a") + F.cos(F.radians("latitude")) ** 2 * F.col("_b"))
    return both.where("latitude is not null and longitude is not null").withColumn("radial_error_km", error).drop("_a", "_b")


def group_median(rows: DataFrame, value: str, name: str) -> DataFrame:
    """(tree_id, name): the median of each tree by ranks over ranges of the order, so no task holds a tree."""
    run = ranked(rows.where(F.col(value).isNotNull()).select("tree_id", value).withColumn("_one", F.lit(1).cast("long")), ["tree_id", value], "_rank", {"_at": "_one"})
    size = run.groupBy("tree_id").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    place = F.col("_at") - F.col("_first")
    middle = run.join(size, "tree_id").where((place == F.floor((F.col("_n") - 1) / 2)) | (place == F.floor(F.col("_n") / 2)))
    return middle.groupBy("tree_id").agg(F.avg(value).alias(name))


def movements(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """Branches with the great-circle distance between their ends' :func:`coordinates`, and what is odd about it.

    (tree_id, name, parent, branch_length, km, km_per_unit, support, flags): zero_length_jump over 1 km without length;
    distance_outlier and rate_outlier beyond the tree's median plus three deviations (1.4826 times the median one, 1 at least). Distances and rates are
    rounded to 6 digits first.
    """
    edges = _branches(nodes.select("tree_id", "name", "parent", "branch_length"), places, "latitude", "longitude", "confidence")
    half = lambda a, b: F.sin(F.radians(F.col(a) - F.col(b)) / 2) ** 2
    a = half("latitude", "_latitude") + F.cos(F.radians("latitude")) * F.cos(F.radians("_latitude")) * half("longitude", "_longitude")
    km = 2 * EARTH_KM * F.asin(F.least(F.sqrt(a), F.lit(1.0)))
    rows = edges.select("tree_id", "name", "parent", "branch_length", km.alias("km"), F.least("confidence", "_confidence").alias("support"))
    rows = rows.withColumns({"km_per_unit": F.when(F.col("branch_length") > 0, F.round(F.col("km") / F.col("branch_length"), 6)), "km": F.round("km", 6)})
    rows = Scratch(nodes.sparkSession).write("branches", rows)
    flags = [F.when((F.coalesce("branch_length", F.lit(math.inf)) <= 0) & (F.col("km") > 1), "zero_length_jump")]
    out = rows
    for column, flag in (("km", "distance_outlier"), ("km_per_unit", "rate_outlier")):
        middle = group_median(rows, column, "_m")
        apart = rows.join(middle, "tree_id").withColumn("_d", F.abs(F.col(column) - F.col("_m")))
        edge = middle.join(group_median(apart, "_d", "_mad"), "tree_id").select("tree_id", (F.col("_m") + 3 * F.greatest(1.4826 * F.col("_mad"), F.lit(1.0))).alias(f"_{column}"))
        out = out.join(edge, "tree_id", "left")
        flags.append(F.when(F.col(column) > F.col(f"_{column}"), flag))
    return out.select("tree_id", "name", "parent", "branch_length", "km", "km_per_unit", "support", F.concat_ws(",", *flags).alias("flags"))
