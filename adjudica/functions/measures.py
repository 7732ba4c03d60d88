"""Numeric expressions of the tender rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from adjudica.functions.text import sane_amount


def bid_amount(checked: Column, deed: Column) -> Column:
    return F.coalesce(sane_amount(checked), sane_amount(deed))


def gap_percent(value: Column, estimation: Column) -> Column:
    """Percent over the estimation, 2 decimals; null where the value is out of scale (an eighth to eight times)."""
    return F.when(value.between(estimation / 8, estimation * 8), F.bround((value - estimation) / estimation * 100, 2))


def off_scale(value: Column, estimation: Column, factor: float = 8.0) -> Column:
    return F.coalesce((value < estimation / factor) | (value > estimation * factor), F.lit(False))


def recency(age_days: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), age_days / F.lit(float(half_life)))


def amount_proximity(ratio: Column, low: float = 0.3, high: float = 3.0) -> Column:
    """1 at equal amounts, 0 at the ends of the eligible range, linear in the logarithm."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(F.ln(ratio)) / F.ln(F.lit(max(high, 1 / low))))


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def logistic(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def logit(p: Column, edge: float = 1e-6) -> Column:
    q = clip(p, edge, 1 - edge)
    return F.ln(q / (F.lit(1.0) - q))


def interpolate(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Piecewise linear through (x, y) knots in order; constant outside."""
    out = F.when(x <= knots[0][0], F.lit(float(knots[0][1])))
    for (a, u), (b, v) in zip(knots, knots[1:]):
        out = out.when(x <= b, F.lit(float(u)) + (x - F.lit(float(a))) * F.lit((v - u) / (b - a) if b > a else 0.0))
    return out.otherwise(F.lit(float(knots[-1][1])))


def poisson_tail(mean: Column, count: Column) -> Column:
    """P(N >= count): the complement of the terms below, each from the one before. Terms are of doubles, so that tails
    below about 1e-15 are 0; ``count`` is small here (markets that two companies share)."""
    term = lambda s, k: F.struct((s["t"] * mean / k).alias("t"), (s["sum"] + s["t"] * mean / k).alias("sum"))
    first = F.struct(F.exp(-mean).alias("t"), F.exp(-mean).alias("sum"))
    steps = F.when(count > 1, F.transform(F.sequence(F.lit(1), count.cast("int") - 1), lambda k: k.cast("double"))).otherwise(F.array().cast("array<double>"))
    return F.when(count <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - F.aggregate(steps, first, term, lambda s: s["sum"])))


def offers_bracket(n: Column) -> Column:
    return F.when(n <= 2, "1-2").when(n <= 4, "3-4").when(n <= 7, "5-7").otherwise("8+")


def amount_bracket(c: Column, edges: tuple[float, ...] = (1e6, 5e6, 20e6)) -> Column:
    out = None
    for k, e in enumerate(edges):
        out = F.when(c < e, k) if out is None else out.when(c < e, k)
    return out.otherwise(F.when(c.isNotNull(), len(edges)))


def days_left(closing: Column, now: Column) -> Column:
    return F.datediff(F.to_date(closing), F.to_date(now))


def smoothed_rate(events: Column, trials: Column, prior: Column, weight: float) -> Column:
    return (events + F.lit(float(weight)) * prior) / (trials + F.lit(float(weight)))


def tier(expected: Column, low: float, high: float) -> Column:
    """0, 1 or 2: an expected number below both bounds, between them, or from the upper one on; 0 where it is unknown."""
    return F.when(expected.isNull() | (expected < low), 0).when(expected < high, 1).otherwise(2)
