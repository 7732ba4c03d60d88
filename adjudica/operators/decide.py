"""Price evaluation on a chance curve, and the GO / A_ETUDIER / NO_GO rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Thresholds of the rule.
RULE = {"floor": 0.82, "ceiling": 1.20, "warn": 0.85, "gain_go": 0.015, "gain_no": 0.003, "chance_go": 0.10, "chance_no": 0.05, "smooth": 10, "zone": 0.9, "days": 3, "buyer": 3, "identified": 0.5, "group": 0.5, "unsuccessful": 0.25}
EDGE = 1e-9


def moving_mean(keys: list[str], at: str, value: str | Column, reach: int) -> Column:
    """Mean over ``reach`` points each side, over fewer at the ends."""
    return F.avg(value).over(W.partitionBy(*keys).orderBy(at).rowsBetween(-reach, reach))


def islands(rows: DataFrame, keys: list[str], at: str, inside: Column) -> DataFrame:
    """``rows`` with ``island``: a number common to neighbouring rows that are inside; null outside."""
    order = W.partitionBy(*keys).orderBy(at)
    rows = rows.withColumn("_in", F.coalesce(inside, F.lit(False)))
    starts = (F.col("_in") & ~F.coalesce(F.lag("_in").over(order), F.lit(False))).cast("int")
    return rows.withColumn("_s", starts).withColumn("island", F.when(F.col("_in"), F.sum("_s").over(order))).drop("_in", "_s")


def evaluate(curve: DataFrame, costs: DataFrame, keys: list[str]) -> DataFrame:
    """``curve``: keys, j, x, chance. ``costs``: keys, cost (share of the estimation), margin (least). One row of each key of ``costs``: low, high (the range of
    prices), empty, x, gain, chance at the recommended price (best smoothed gain in range; ties: the lowest price), best_gain,
    zone_low, zone_high (the run around it of at least 0.9 of its gain)."""
    low = F.greatest(F.lit(RULE["floor"]), F.col("cost") * (1 + F.col("margin")))
    costs = costs.withColumns({"low": low, "high": F.lit(RULE["ceiling"])})
    rows = curve.join(costs, keys).withColumn("gain", (F.col("x") - F.col("cost")) * F.col("chance"))
    rows = rows.withColumn("smooth", moving_mean(keys, "j", "gain", int(RULE["smooth"])))
    rows = rows.where((F.col("x") >= F.col("low") - EDGE) & (F.col("x") <= F.col("high") + EDGE))
    peak = F.max_by("j", F.struct("smooth", -F.col("j"))).over(W.partitionBy(*keys))
    rows = rows.withColumns({"_peak": peak, "_top": F.max("smooth").over(W.partitionBy(*keys))})
    rows = islands(rows, keys, "j", F.col("smooth") >= F.col("_top") * RULE["zone"])
    rows = rows.withColumn("_own", F.max(F.when(F.col("j") == F.col("_peak"), F.col("island"))).over(W.partitionBy(*keys)))
    at_peak, zone = F.col("j") == F.col("_peak"), F.col("island") == F.col("_own")
    pick = lambda c: F.max(F.when(at_peak, F.col(c)))
    found = rows.groupBy(*keys).agg(
        pick("x").alias("x"), pick("gain").alias("gain"), pick("chance").alias("chance"), F.max("gain").alias("best_gain"),
        F.min(F.when(zone, F.col("x"))).alias("zone_low"), F.max(F.when(zone, F.col("x"))).alias("zone_high"), F.max("chance").alias("best_chance"),
    )
    return costs.join(found, keys, "left").withColumn("empty", F.col("x").isNull())


def decide(rows: DataFrame) -> DataFrame:
    """Adds decision and reasons (array of code, severity) to evaluated rows. Signals, each may be null: days, eligibility, buyer_n, identified, group_p,
    unsuccessful_rate, in_progress, plan_max. The worst severity decides: 2 NO_GO, 1 A_ETUDIER, 0 GO."""
    r = RULE
    say = lambda hit, code, severity: F.when(hit, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))
    priced = ~F.col("empty") & (F.col("gain") >= r["gain_no"])
    reasons = F.array_compact(F.array(
        say(F.col("days") < 0, "delai_depasse", 2), say(F.col("days").between(0, r["days"] - 1), "delai_court", 1),
        say(F.col("eligibility") == "non_eligible", "non_eligible", 2), say(F.col("eligibility") == "a_etudier", "eligibilite_incertaine", 1),
        say(F.col("empty"), "plage_vide", 2), say(~F.col("empty") & (F.col("gain") < r["gain_no"]), "aucun_gain", 2),
        say(priced & (F.col("chance") < r["chance_no"]), "chance_faible", 2), say(priced & (F.col("chance") >= r["chance_no"]) & (F.col("chance") < r["chance_go"]), "chance_moyenne", 1),
        say(priced & (F.col("chance") >= r["chance_go"]), "chance_ok", 0), say(priced & (F.col("gain") < r["gain_go"]), "gain_moyen", 1),
        say(priced & (F.col("gain") >= r["gain_go"]), "gain_ok", 0), say(F.col("buyer_n") < r["buyer"], "confiance_acheteur_peu", 1),
        say(F.col("identified") < r["identified"], "confiance_identifies_peu", 1), say(F.col("group_p") >= r["group"], "groupe_fort", 1),
        say(F.col("unsuccessful_rate") > r["unsuccessful"], "infructueux", 1), say(F.col("in_progress") >= F.col("plan_max"), "plan_plein", 1),
    ))
    worst = F.aggregate("reasons", F.lit(0), lambda m, x: F.greatest(m, x["severity"]))
    return rows.withColumn("reasons", reasons).withColumn("decision", F.when(worst == 2, "NO_GO").when(worst == 1, "A_ETUDIER").otherwise("GO"))


def simple_rule(rows: DataFrame, grid: list[float], tier: list[str]) -> DataFrame:
    """(tier, rate, share): the share of the estimations that each fixed rate would have won. ``rows``: tier, estimation, rate, wins."""
    won = F.sum(F.when(F.col("wins"), F.col("estimation")).otherwise(0.0)) / F.sum("estimation")
    return rows.where(F.col("rate").isin(*[float(g) for g in grid])).groupBy(*tier, "rate").agg(won.alias("share"))


def best_rate(shares: DataFrame, tier: list[str], cost: float) -> DataFrame:
    """The fixed rate of the best expected gain of each tier (ties: the lowest)."""
    gain = (F.col("rate") - cost) * F.col("share")
    return shares.groupBy(*tier).agg(F.max_by(F.struct("rate", "share"), F.struct(gain, -F.col("rate"))).alias("x")).select(*tier, "x.*")


def profit(decisions: DataFrame, by: list[str]) -> DataFrame:
    """What a rule would have earned: (x - cost) * estimation of the bids it made and won."""
    earned = F.when(F.col("bids") & F.col("wins"), (F.col("x") - F.col("cost")) * F.col("estimation")).otherwise(0.0)
    return decisions.groupBy(*by).agg(F.sum(earned).alias("profit"), F.count_if("bids").alias("bids"), F.count_if(F.col("bids") & F.col("wins")).alias("won"))
