"""Statistics of Markov chain traces (chain, iteration, value), iterations from 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladewise.functions.lineage import checkpoint


def _moments(trace: DataFrame) -> DataFrame:
    w = Window.partitionBy("chain")
    return trace.withColumn("n", F.count("*").over(w)).withColumn("mean", F.avg("value").over(w)).withColumn("d", F.col("value") - F.col("mean"))


def autocorrelation(trace: DataFrame, max_lag: int = 10) -> DataFrame:
    """Biased autocorrelation at lags 0 to ``max_lag`` (below the chain's length); null for constant chains."""
    d = _moments(trace)
    w = Window.partitionBy("chain").orderBy("iteration")
    for k in range(max_lag + 1):
        d = d.withColumn(f"x{k}", F.col("d") * (F.lag("d", k).over(w) if k else F.col("d")))
    sums = d.groupBy("chain").agg(F.first("n").alias("n"), *[F.sum(f"x{k}").alias(f"s{k}") for k in range(max_lag + 1)])
    each = sums.select("chain", "n", "s0", F.posexplode(F.array(*[f"s{k}" for k in range(max_lag + 1)])).alias("lag", "s"))
    return each.where("lag < n").select("chain", "lag", F.round(F.col("s") / F.nullif(F.col("s0"), F.lit(0.0)), 6).alias("rho"))


def effective_sample_size(trace: DataFrame, block: int = 20) -> DataFrame:
    """n / (1 + 2 sum of rho up to the first rho <= 0 or the end of the chain).

    Lags are tried ``block`` at a time; each further round (of twice as many) only takes the chains that go on.
    """
    mean = Window.partitionBy("chain")
    d = trace.select("chain", "iteration", (F.col("value") - F.avg("value").over(mean)).alias("d"))
    of = d.groupBy("chain").agg(F.count("*").alias("n"), F.sum(F.col("d") * F.col("d")).alias("s0"))
    going, low, parts = of, 1, []
    while True:
        high = low + block - 1
        lags = going.where(F.col("n") > low).withColumn("lag", F.explode(F.sequence(F.lit(low), F.least(F.col("n") - 1, F.lit(high)).cast("int"))))
        a = lags.join(d, "chain").select("chain", "lag", "s0", (F.col("iteration") - F.col("lag")).alias("iteration"), F.col("d").alias("x"))
        s = a.join(d, ["chain", "iteration"]).groupBy("chain", "lag", "s0").agg(F.sum(F.col("x") * F.col("d")).alias("s"))
        rho = s.select("chain", "lag", F.round(F.col("s") / F.nullif(F.col("s0"), F.lit(0.0)), 6).alias("rho"))
        first = rho.groupBy("chain").agg(F.min(F.when(F.coalesce(F.col("rho") <= 0, F.lit(False)), F.col("lag"))).alias("end"))
        head = rho.join(first, "chain").groupBy("chain", "end").agg(F.sum(F.when(F.col("end").isNull() | (F.col("lag") < F.col("end")), F.col("rho"))).alias("rho"))
        head = checkpoint(head)
        parts.append(head.select("chain", "rho"))
        going = checkpoint(going.where(F.col("n") > high + 1).join(head.where("end is null").select("chain"), "chain"))
        if going.isEmpty():
            break
        low, block = high + 1, 2 * block
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    tau = rows.groupBy("chain").agg((1 + 2 * F.coalesce(F.sum("rho"), F.lit(0.0))).alias("tau"))
    return of.join(tau, "chain", "left").select("chain", "n", F.round(F.coalesce("tau", F.lit(1.0)), 6).alias("tau"), F.round(F.col("n") / F.coalesce("tau", F.lit(1.0)), 4).alias("ess"))


def highest_density_interval(trace: DataFrame, mass: float = 0.95) -> DataFrame:
    """The shortest run of ceil(mass * n) sorted values; the first of ties."""
    w = Window.partitionBy("chain").orderBy("value", "iteration")
    s = trace.withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("chain")))
    s = s.withColumn("k", F.ceil(F.col("n") * mass).cast("int"))
    ends = s.select("chain", (F.col("i") - F.col("k") + 1).alias("i"), F.col("value").alias("upper")).where("i >= 1")
    spans = s.select("chain", "i", F.col("value").alias("lower")).join(ends, ["chain", "i"]).withColumn("width", F.round(F.col("upper") - F.col("lower"), 9))
    return spans.groupBy("chain").agg(F.min(F.struct("width", "i", "lower", "upper")).alias("s")).select("chain", F.col("s.lower").alias("lower"), F.col("s.upper").alias("upper"), F.col("s.width").alias("width"))


def equal_tail_interval(trace: DataFrame, mass: float = 0.95) -> DataFrame:
    a = (1 - mass) / 2
    return trace.groupBy("chain").agg(F.round(F.percentile("value", F.lit(a)), 6).alias("lower"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"), F.round(F.percentile("value", F.lit(1 - a)), 6).alias("upper"))


def summary(trace: DataFrame) -> DataFrame:
    return trace.groupBy("chain").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"), F.min("value").alias("least"), F.max("value").alias("most"))


def discard_burnin(trace: DataFrame, fraction: float) -> DataFrame:
    """Without the first floor(fraction * n) iterations of each chain."""
    n = F.count("*").over(Window.partitionBy("chain"))
    return trace.withColumn("n", n).where(F.col("iteration") > F.floor(F.col("n") * fraction)).drop("n")


def burnin_shifts(trace: DataFrame, fractions: tuple[float, ...] = (0.1, 0.25, 0.5)) -> DataFrame:
    """Mean of each chain after each burn-in, and its shift from the whole chain's."""
    n = F.count("*").over(Window.partitionBy("chain"))
    rows = trace.withColumn("n", n)
    means = [F.avg(F.when(F.col("iteration") > F.floor(F.col("n") * f), F.col("value"))).alias(f"m{i}") for i, f in enumerate(fractions)]
    of = rows.groupBy("chain").agg(F.avg("value").alias("whole"), *means)
    each = of.select("chain", "whole", F.explode(F.array(*[F.struct(F.lit(f).alias("burnin"), F.col(f"m{i}").alias("mean")) for i, f in enumerate(fractions)])).alias("x"))
    return each.select("chain", F.col("x.burnin").alias("burnin"), F.round("x.mean", 6).alias("mean"), F.round(F.col("x.mean") - F.col("whole"), 6).alias("shift"))


def standardised_mean_shift(trace: DataFrame) -> DataFrame:
    """Difference of the halves' means over the standard deviation of the chain."""
    n = F.count("*").over(Window.partitionBy("chain"))
    late = F.col("iteration") > F.floor(F.col("n") / 2)
    of = trace.withColumn("n", n).groupBy("chain").agg(F.avg(F.when(late, F.col("value"))).alias("b"), F.avg(F.when(~late, F.col("value"))).alias("a"), F.stddev_samp("value").alias("sd"))
    return of.select("chain", F.round((F.col("b") - F.col("a")) / F.nullif(F.col("sd"), F.lit(0.0)), 6).alias("shift"))


def gelman_rubin(trace: DataFrame) -> DataFrame:
    """Potential scale reduction over all chains, from each chain's first m iterations, m the shortest chain's length."""
    size = trace.groupBy("chain").agg(F.count("*").alias("k")).agg(F.min("k").alias("m"))
    cut = trace.join(F.broadcast(size)).where("iteration <= m")
    of = cut.groupBy("chain", "m").agg(F.avg("value").alias("mean"), F.var_samp("value").alias("v"))
    r = of.groupBy("m").agg(F.count("*").alias("chains"), F.avg("v").alias("w"), F.var_samp("mean").alias("b"))
    return r.select("chains", "m", F.round(F.sqrt(((F.col("m") - 1) / F.col("m") * F.col("w") + F.col("b")) / F.nullif(F.col("w"), F.lit(0.0))), 6).alias("r_hat"))


def running_mean(trace: DataFrame) -> DataFrame:
    w = Window.partitionBy("chain").orderBy("iteration").rowsBetween(Window.unboundedPreceding, 0)
    return trace.select("chain", "iteration", F.round(F.avg("value").over(w), 8).alias("running_mean"))


def predictive_p_values(trace: DataFrame, observed: DataFrame) -> DataFrame:
    """Share of each chain's values at or above the observed one (chain, observed)."""
    return trace.join(observed, "chain").groupBy("chain").agg(F.round(F.avg((F.col("value") >= F.col("observed")).cast("double")), 9).alias("p_upper"), F.round(F.avg((F.col("value") <= F.col("observed")).cast("double")), 9).alias("p_lower"))
