"""Bid rates (amount / estimation): weighted profiles, shrinkage to segments, market effect, robust spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from adjudica.functions.measures import recency
from adjudica.operators.components import stored

LOWEST, HIGHEST, FLOOR = 0.4, 1.6, 0.01


def weight(score: Column, age_days: Column, same_buyer: Column, half_life: float = 45.0, gain: float = 3.0) -> Column:
    return F.pow(score / 100, F.lit(0.5)) * recency(age_days, half_life) * (1 + F.when(same_buyer, F.lit(gain)).otherwise(0.0))


def weighted_moments(rows: DataFrame, keys: list[str], value: str, w: str) -> DataFrame:
    """(n_eff, mean, variance): sums of w, w v, w v v and w w, added up in one pass."""
    s = rows.groupBy(*keys).agg(F.sum(w).alias("_w"), F.sum(F.col(w) * F.col(value)).alias("_wv"), F.sum(F.col(w) * F.col(value) * F.col(value)).alias("_wvv"), F.sum(F.col(w) * F.col(w)).alias("_ww"))
    mean = F.col("_wv") / F.col("_w")
    return s.select(*keys, (F.col("_w") * F.col("_w") / F.col("_ww")).alias("n_eff"), mean.alias("mean"), F.greatest(F.lit(0.0), F.col("_wvv") / F.col("_w") - mean * mean).alias("variance"))


def shrink(own: DataFrame, segment_mean: Column, segment_variance: Column, k_mean: float = 3.0, k_variance: float = 1.0, narrow: float = 0.8) -> DataFrame:
    """mu and sigma between a company's own moments and its segment's, by effective numbers."""
    n = F.coalesce("n_eff", F.lit(0.0))
    mu = (n * F.coalesce("mean", F.lit(0.0)) + k_mean * segment_mean) / (n + k_mean)
    var = (n * F.coalesce("variance", F.lit(0.0)) + k_variance * segment_variance) / (n + k_variance)
    return own.withColumns({"mu": mu, "sigma": F.greatest(F.lit(FLOOR), narrow * F.sqrt(var))})


def shrink_to(value: Column, n: Column, wide: Column, k: float) -> Column:
    """Between a company's own value, seen n times, and its segment's, which weighs as k times."""
    return (n * value + F.lit(float(k)) * wide) / (n + F.lit(float(k)))


def widest_first(rows: DataFrame, levels: list[list[str]], value: str, least: int = 40, quantiles: int = 41) -> DataFrame:
    """Aggregates of every level of keys (narrow to wide) in one grouping sets pass: level, keys, n, mean, variance, quantiles."""
    keys = list(dict.fromkeys(k for level in levels for k in level))
    q = F.percentile(value, F.array(*[F.lit(i / (quantiles - 1)) for i in range(quantiles)]))
    sets = rows.groupingSets([[F.col(k) for k in level] for level in levels], *keys).agg(
        *[F.grouping(k).alias(f"_no_{k}") for k in keys], F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance"), q.alias("quantiles")
    )
    out = None
    for i, level in enumerate(levels):
        hit = F.lit(True)
        for k in keys:
            hit = hit & (F.col(f"_no_{k}") == (0 if k in level else 1))
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return sets.withColumn("level", out).drop(*[f"_no_{k}" for k in keys]).where((F.col("n") >= least) | (F.col("level") == len(levels) - 1))


def segment_of(targets: DataFrame, segments: DataFrame, levels: list[list[str]], target_id: str) -> DataFrame:
    """The narrowest level of each target that has enough rows."""
    found = None
    for i, level in enumerate(levels):
        at = segments.where(F.col("level") == i).select(*level, "level", "n", "mean", "variance", "quantiles")
        part = (targets.join(at, level) if level else targets.join(F.broadcast(at))).select(target_id, "level", "n", "mean", "variance", "quantiles")  # a wide level is one row
        found = part if found is None else found.unionByName(part)
    return found.groupBy(target_id).agg(F.min_by(F.struct("level", "n", "mean", "variance", "quantiles"), "level").alias("x")).select(target_id, "x.*")


def market_effect(bids: DataFrame, unit: str, rate: str) -> DataFrame:
    """One row: slope and intercept of a unit's mean rate on the log of its number of bids, and the variance between units
    beyond what noise within them explains."""
    u = bids.groupBy(unit).agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v"), F.count(F.lit(1)).alias("n")).withColumn("ln_n", F.ln("n"))
    fit = u.agg(F.regr_slope("m", "ln_n").alias("slope"), F.regr_intercept("m", "ln_n").alias("intercept"), F.count(F.lit(1)).alias("units"), F.avg(F.col("v") / F.col("n")).alias("_noise"))
    gap = F.col("m") - (F.col("intercept") + F.col("slope") * F.col("ln_n"))
    spread = u.join(F.broadcast(fit)).agg(F.var_samp(gap).alias("_all"))  # one row
    return fit.join(F.broadcast(spread)).select("slope", "intercept", "units", F.greatest(F.lit(0.0), F.col("_all") - F.coalesce("_noise", F.lit(0.0))).alias("between"))


def medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median and number of rows."""
    return rows.groupBy(*keys).agg(F.median(value).alias("median"), F.count(F.lit(1)).alias("n"))


def wide_median(rows: DataFrame, value: str, bins: int = 1 << 12) -> DataFrame:
    """(median): one row, the exact median of all (finite) values, null without any. Values are counted in bins, and the middle one's bin
    in narrower bins, until it holds one value; a round hands on counts by bin, where a plain median takes all values to one task."""
    part = stored(rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v")), "median-values")
    n, low, high = part.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    first, second = (n - 1) // 2, n // 2  # ranks of the middle ones, among those of ``part``
    ends = (low, high)
    while n and low < high:
        at = F.least(F.floor((F.col("v") - F.lit(low)) * F.lit(bins / (high - low))), F.lit(bins - 1))
        told = sorted(tuple(r) for r in part.groupBy(at.alias("at")).agg(F.count(F.lit(1)), F.min("v"), F.max("v")).collect())  # ``bins`` rows at most
        below, held = 0, []
        for _, k, least, most in told:
            if below <= second and below + k > first:
                held.append((below, least, most))
            below += k
        if len(held) > 1:  # the last of one bin and the first of the next
            ends = (held[0][2], held[1][1])
            break
        before, low, high = held[0]
        first, second, part, ends = first - before, second - before, part.where(F.col("v").between(low, high)), (low, high)
    middle = None if not n else 0.5 * ends[0] + 0.5 * ends[1] if ends[0] < ends[1] else ends[0]
    return rows.sparkSession.range(1).select(F.lit(middle).cast("double").alias("median"))


def robust(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median, and the median distance from it."""
    med = medians(rows, keys, value)
    far = rows.join(med, keys).groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    return med.join(far, keys)


def in_range(rate: Column) -> Column:
    return rate.between(LOWEST, HIGHEST)


def gaps_to_choice(ranked: DataFrame, unit: list[str]) -> DataFrame:
    best = F.min(F.when(F.col("rank") == 1, F.col("amount"))).over(W.partitionBy(*unit))
    return ranked.withColumn("gap", (F.col("amount") - best) / best * 100)
