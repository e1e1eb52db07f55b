"""Pairwise genetic distances and tests on distance tables.

``distances`` frames have (aln_id, left, right, distance) with left <= right; the diagonal is
included by the builders. Distances are null at and beyond a model's limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladewise.operators import alignment as al


def pair_counts(sites: DataFrame) -> DataFrame:
    """Comparable sites, mismatches, transitions and transversions of each pair of taxa (pairwise deletion)."""
    ok = al.is_known("l") & al.is_known("r")
    purine = lambda c: F.col(c).isin("A", "G")
    differ = ok & (F.col("l") != F.col("r"))
    n = lambda c: F.sum(c.cast("long"))
    return al.pairs(sites, diagonal=True).groupBy("aln_id", "left", "right").agg(
        n(ok).alias("n"),
        n(differ).alias("mismatches"),
        n(differ & (purine("l") == purine("r"))).alias("transitions"),
        n(differ & (purine("l") != purine("r"))).alias("transversions"),
        n(differ & purine("l") & purine("r")).alias("ag"),
        n(differ & ~purine("l") & ~purine("r")).alias("ct"),
    )


def frequencies(sites: DataFrame) -> DataFrame:
    """Base shares over a whole alignment, known residues only."""
    counts = sites.where(al.is_known()).groupBy("aln_id").agg(*[F.sum((F.upper("residue") == b).cast("long")).alias(f"n{b}") for b in al.BASES], F.count("*").alias("known"))
    return counts.select("aln_id", *[(F.col(f"n{b}") / F.col("known")).alias(f"pi_{b}") for b in al.BASES])


def _log(x: Column) -> Column:
    """ln, null at 0 and below."""
    return F.when(x > 0, F.log(x))


def _p() -> tuple[Column, Column, Column]:
    n = F.nullif(F.col("n"), F.lit(0))
    return F.col("mismatches") / n, F.col("transitions") / n, F.col("transversions") / n


def distances(sites: DataFrame, model: str = "p") -> DataFrame:
    """(aln_id, left, right, comparable_sites, distance) under p, JC69, K80, F81 or TN93."""
    counts = pair_counts(sites)
    p, ts, tv = _p()
    if model == "p":
        d = p
    elif model == "jc69":
        d = -0.75 * _log(1 - p * 4 / 3)
    elif model == "k80":
        d = -0.5 * _log(1 - 2 * ts - tv) - 0.25 * _log(1 - 2 * tv)
    elif model == "f81":
        counts = counts.join(frequencies(sites), "aln_id")
        b = 1 - sum(F.col(f"pi_{x}") * F.col(f"pi_{x}") for x in al.BASES)
        d = -b * _log(1 - p / b)
    elif model == "tn93":
        counts = counts.join(frequencies(sites), "aln_id")
        a, c, g, t = (F.col(f"pi_{x}") for x in al.BASES)
        r, y = a + g, c + t
        n = F.nullif(F.col("n"), F.lit(0))
        k1, k2, k3 = 2 * a * g / r, 2 * c * t / y, 2 * (r * y - a * g * y / r - c * t * r / y)
        d = -k1 * _log(1 - F.col("ag") / n / k1 - tv / (2 * r)) - k2 * _log(1 - F.col("ct") / n / k2 - tv / (2 * y)) - k3 * _log(1 - tv / (2 * r * y))
    else:
        raise ValueError(f"unknown model {model}")
    if model in ("jc69", "f81", "tn93"):
        d = F.when(F.col("mismatches") == 0, F.when(F.col("n") > 0, 0.0)).otherwise(d)
    return counts.select("aln_id", "left", "right", F.col("n").alias("comparable_sites"), F.round(d, 9).alias("distance"))


def saturation(sites: DataFrame, model: str = "jc69") -> DataFrame:
    """Pairs at or beyond the model's limit."""
    return distances(sites, model).groupBy("aln_id").agg(F.sum((F.col("distance").isNull() & (F.col("comparable_sites") > 0)).cast("long")).alias("saturated"), F.count("*").alias("pairs"))


def _both_ways(d: DataFrame) -> DataFrame:
    d = d.where("left <> right").select("aln_id", "left", "right", "distance")
    return d.unionByName(d.select("aln_id", F.col("right").alias("left"), F.col("left").alias("right"), "distance"))


def ultrametricity(d: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Three-point condition over all triples of each table: triples, undefined and violations."""
    e = d.where("left < right").select("aln_id", "left", "right", "distance")
    ab = e.select("aln_id", F.col("left").alias("a"), F.col("right").alias("b"), F.col("distance").alias("ab"))
    ac = e.select("aln_id", F.col("left").alias("a"), F.col("right").alias("c"), F.col("distance").alias("ac"))
    bc = e.select("aln_id", F.col("left").alias("b"), F.col("right").alias("c"), F.col("distance").alias("bc"))
    triples = ab.join(ac, ["aln_id", "a"]).where("b < c").join(bc, ["aln_id", "b", "c"])
    ordered = F.sort_array(F.array("ab", "ac", "bc"))
    known = F.col("ab").isNotNull() & F.col("ac").isNotNull() & F.col("bc").isNotNull()
    return triples.groupBy("aln_id").agg(
        F.count("*").alias("triples"), F.sum((~known).cast("long")).alias("undefined"), F.sum((known & (F.get(ordered, 2) - F.get(ordered, 1) > tolerance)).cast("long")).alias("violations")
    )


def additivity(d: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Four-point condition over all quartets of each table."""
    e = d.where("left < right").select("aln_id", "left", "right", "distance")
    taxa = e.select("aln_id", F.col("left").alias("t")).union(e.select("aln_id", F.col("right").alias("t"))).groupBy("aln_id").agg(F.sort_array(F.collect_set("t")).alias("taxa"))
    table = e.groupBy("aln_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "left", "right"), F.coalesce("distance", F.lit(float("nan")))))).alias("m"))
    rows = taxa.join(table, "aln_id")
    for k in "abcd":
        rows = rows.select("*", F.explode("taxa").alias(k))
        if k != "a":
            rows = rows.where(F.col(chr(ord(k) - 1)) < F.col(k))
    get = lambda x, y: F.try_element_at("m", F.concat_ws("|", x, y))
    s = F.sort_array(F.array(get("a", "b") + get("c", "d"), get("a", "c") + get("b", "d"), get("a", "d") + get("b", "c")))
    known = ~F.isnan(F.get(s, 2))
    return rows.groupBy("aln_id").agg(F.count("*").alias("quartets"), F.sum((~known).cast("long")).alias("undefined"), F.sum((known & (F.get(s, 2) - F.get(s, 1) > tolerance)).cast("long")).alias("violations"))


def quality(d: DataFrame) -> DataFrame:
    """Of each table: undefined pairs, triangle violations, smallest and largest distance."""
    w = _both_ways(d)
    ab = w.select("aln_id", F.col("left").alias("a"), F.col("right").alias("b"), F.col("distance").alias("ab"))
    bc = w.select("aln_id", F.col("left").alias("b"), F.col("right").alias("c"), F.col("distance").alias("bc"))
    ac = w.select("aln_id", F.col("left").alias("a"), F.col("right").alias("c"), F.col("distance").alias("ac"))
    broken = ab.join(bc, ["aln_id", "b"]).where("a < c").join(ac, ["aln_id", "a", "c"]).where(F.col("ac") > F.col("ab") + F.col("bc") + 1e-9)
    base = d.where("left < right").groupBy("aln_id").agg(F.count("*").alias("pairs"), F.sum(F.col("distance").isNull().cast("long")).alias("undefined"), F.min("distance").alias("least"), F.max("distance").alias("most"))
    return base.join(broken.groupBy("aln_id").agg(F.count("*").alias("triangle_violations")), "aln_id", "left").fillna(0, ["triangle_violations"])


def compare_models(sites: DataFrame, left: str = "p", right: str = "jc69") -> DataFrame:
    """Mean difference of two models over the pairs both define."""
    a = distances(sites, left).select("aln_id", "left", "right", F.col("distance").alias("x"))
    b = distances(sites, right).select("aln_id", "left", "right", F.col("distance").alias("y"))
    both = a.join(b, ["aln_id", "left", "right"]).where("left < right")
    return both.groupBy("aln_id").agg(F.count("*").alias("pairs"), F.sum((F.col("x").isNotNull() & F.col("y").isNotNull()).cast("long")).alias("defined"), F.round(F.avg(F.col("y") - F.col("x")), 6).alias("mean_difference"))


def nearest(d: DataFrame) -> DataFrame:
    """The nearest other taxon of each taxon, ties by name."""
    w = Window.partitionBy("aln_id", "left").orderBy("distance", "right")
    return _both_ways(d).where("distance is not null").withColumn("i", F.row_number().over(w)).where("i = 1").select("aln_id", F.col("left").alias("taxon"), F.col("right").alias("nearest"), "distance")
