"""The commission's rule: usable bids, reference price, ranking, replay with a fictitious bid.

``bids`` have the unit columns (``unit``), seq, amount and admitted; ``tenders`` the unit columns and estimation.
The bids of one unit are a bounded list, so that a unit is judged in one row; units are never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from adjudica.functions.measures import bid_amount, offers_bracket
from adjudica.schema import ADMITTED

SCALE = 8.0
RATIO = 4.0


def candidate_bids(bids: DataFrame, unit: list[str]) -> DataFrame:
    """Admitted bids with an amount; where a unit has none, all its bids with an amount."""
    some = F.max(F.col("admitted").cast("int")).over(W.partitionBy(*unit)) == 1
    return bids.where("amount IS NOT NULL").withColumn("_some", some).where("admitted OR NOT _some").drop("_some")


def within_band(bids: DataFrame, tenders: DataFrame, unit: list[str], band: float) -> DataFrame:
    """Bids within ``band`` (a share) of the estimation; all bids of a unit that has none such, or no estimation."""
    rows = bids.join(tenders.select(*unit, F.col("estimation").alias("_e")), unit, "left")
    rows = rows.withColumn("_in", F.coalesce(F.col("amount").between(F.col("_e") * (1 - band), F.col("_e") * (1 + band)), F.lit(False)))
    return rows.withColumn("_some", F.bool_or("_in").over(W.partitionBy(*unit))).where("_in OR NOT _some").drop("_e", "_in", "_some")


def _scaled(sorted_amounts: Column, reference: Column) -> Column:
    return F.filter(sorted_amounts, lambda a: (a >= reference / SCALE) & (a <= reference * SCALE))


def reference_prices(bids: DataFrame, tenders: DataFrame, unit: list[str], digits: int | None = 2) -> DataFrame:
    """Per unit of ``bids``: estimation, n_bids, n_used, mean, reference, estimation_discarded.

    Usable bids lie within an eighth to eight times of the estimation, or else of the upper median, where
    at least two do; all are used where neither holds. The reference is half of mean and estimation, and
    none where the mean is over four times, or under a quarter of, the estimation. ``digits``: rounding of both.
    """
    rounded = (lambda c: F.bround(c, digits)) if digits is not None else (lambda c: c)
    sets = bids.groupBy(*unit).agg(F.sort_array(F.collect_list("amount")).alias("_all")).join(tenders.select(*unit, "estimation"), unit, "left")
    sets = sets.withColumn("_mid", F.element_at("_all", F.floor(F.size("_all") / 2).cast("int") + 1))
    sets = sets.withColumn("_near", _scaled(F.col("_all"), F.coalesce("estimation", "_mid"))).withColumn("_alike", _scaled(F.col("_all"), F.col("_mid")))
    used = F.when(F.size("_all") < 2, F.col("_all")).when(F.size("_near") >= 2, F.col("_near")).when(F.size("_alike") >= 2, F.col("_alike")).otherwise(F.col("_all"))
    sets = sets.withColumn("_used", used)
    total = F.aggregate("_used", F.lit(0.0), lambda s, a: s + a)
    sets = sets.withColumn("mean", rounded(total / F.size("_used")))
    odd = (F.col("mean") / F.col("estimation") > RATIO) | (F.col("mean") / F.col("estimation") < 1 / RATIO)
    known = F.col("estimation").isNotNull() & (F.col("estimation") > 0)
    return sets.select(
        *unit, "estimation", F.size("_all").cast("long").alias("n_bids"), F.size("_used").cast("long").alias("n_used"), "mean",
        F.when(known & ~odd, rounded((F.col("mean") + F.col("estimation")) / 2)).alias("reference"), F.coalesce(known & odd, F.lit(False)).alias("estimation_discarded"),
    )


def commission_order(amount: str = "amount", reference: str = "reference", seq: str = "seq") -> list[Column]:
    """Bids at or below the reference, highest first; then those above, lowest first; ties by deposit."""
    a, below = F.col(amount), F.col(amount) <= F.col(reference)
    return [F.when(below, 0).otherwise(1), F.when(below, -a).otherwise(a), F.col(seq)]


def commission_rank(bids: DataFrame, prices: DataFrame, unit: list[str]) -> DataFrame:
    """``bids`` of units with a reference, with reference and rank (1 is the commission's choice)."""
    priced = bids.join(prices.where("reference IS NOT NULL").select(*unit, "reference"), unit)
    return priced.withColumn("rank", F.row_number().over(W.partitionBy(*unit).orderBy(*commission_order())))


def ranked_bids(bids: DataFrame, tenders: DataFrame, unit: list[str], digits: int | None = 2) -> DataFrame:
    """All ``bids`` with the reference of their unit and their rank, null for those that are no candidates: what ``candidate_bids``,
    ``reference_prices`` and ``commission_rank`` give, beside the other bids and over one shuffle by unit."""
    some = F.max(F.when(F.col("amount").isNotNull(), F.col("admitted").cast("int"))).over(W.partitionBy(*unit)) == 1
    rows = bids.withColumn("_some", some).withColumn("_in", F.coalesce(F.col("amount").isNotNull() & (F.col("admitted") | ~F.col("_some")), F.lit(False))).drop("_some")
    prices = reference_prices(rows.where("_in"), tenders, unit, digits).select(*unit, "reference")
    rows = rows.join(prices, unit, "left").withColumn("_in", F.col("_in") & F.col("reference").isNotNull())
    rank = F.row_number().over(W.partitionBy(*unit).orderBy(~F.col("_in"), *commission_order()))
    return rows.withColumn("rank", F.when(F.col("_in"), rank)).drop("_in")


def replay_with_bid(bids: DataFrame, tenders: DataFrame, unit: list[str], rates: list[float], digits: int | None = 2) -> DataFrame:
    """Each unit judged anew with a fictitious last bid of rate x estimation, for every rate: (unit, rate, reference, rank of
    the fictitious bid). Units without estimation are left out, and rates that leave no reference. A bid equal to an earlier one
    ranks after it. A unit stays one row, in which the rates are an array; its bids are shuffled once."""
    rounded = (lambda c: F.bround(c, digits)) if digits is not None else (lambda c: c)
    known = tenders.where("estimation > 0").select(*unit, "estimation")
    rows = bids.groupBy(*unit).agg(F.collect_list("amount").alias("_own")).join(known, unit)
    est = F.col("estimation")
    steps = F.transform(F.array(*[F.lit(float(r)) for r in rates]), lambda r: F.struct(r.alias("rate"), (r * est).alias("own"), F.sort_array(F.concat("_own", F.array(r * est))).alias("all")))
    rows = rows.withColumn("_g", steps)
    near = lambda x: F.struct(x["rate"], x["own"], x["all"], _scaled(x["all"], est).alias("near"), _scaled(x["all"], F.get(x["all"], F.floor(F.size(x["all"]) / 2).cast("int"))).alias("alike"))
    used = lambda x: F.struct(x["rate"], x["own"], F.when(F.size(x["all"]) < 2, x["all"]).when(F.size(x["near"]) >= 2, x["near"]).when(F.size(x["alike"]) >= 2, x["alike"]).otherwise(x["all"]).alias("used"))
    mean = lambda x: F.struct(x["rate"], x["own"], rounded(F.aggregate(x["used"], F.lit(0.0), lambda s, a: s + a) / F.size(x["used"])).alias("mean"))
    priced = lambda x: F.struct(x["rate"], x["own"], F.when((x["mean"] / est <= RATIO) & (x["mean"] / est >= 1 / RATIO), rounded((x["mean"] + est) / 2)).alias("reference"))
    for step in (near, used, mean, priced):
        rows = rows.withColumn("_g", F.transform("_g", step))
    first = lambda x: F.when(x["own"] <= x["reference"], F.filter("_own", lambda a: (a >= x["own"]) & (a <= x["reference"]))).otherwise(F.filter("_own", lambda a: (a <= x["reference"]) | (a <= x["own"])))
    ranked = F.transform("_g", lambda x: F.struct(x["rate"].alias("rate"), x["reference"].alias("reference"), (F.size(first(x)) + 1).alias("rank")))
    return rows.select(*unit, F.inline(ranked)).where("reference IS NOT NULL")


def bids_of_units(bids: DataFrame) -> DataFrame:
    """Canonical bids with seq, amount and admitted."""
    return bids.withColumns({"seq": F.col("id"), "amount": bid_amount(F.col("amount_checked"), F.col("amount_deed")), "admitted": F.col("status").isin(*ADMITTED)})


def load_units(tenders: DataFrame, lots: DataFrame, bids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units, unit bids): one unit for each kept tender without lots, one for each lot of the others. A lot's bids are those
    that name it; unit is ref or ref#lot."""
    kept = tenders.where("main")
    simple = kept.where("coalesce(n_lots, 0) = 0").select(F.col("ref").alias("unit"), "ref", F.lit(None).cast("string").alias("lot"), "buyer", "sort_date", "doubtful", "estimation", "title", "unsuccessful")
    multi = kept.where("n_lots > 0").select("ref", "buyer", "sort_date", "doubtful", F.col("title").alias("_title"), "unsuccessful").join(lots.select("ref", "lot", "estimation", "title"), "ref")
    by_lot = multi.select(F.concat_ws("#", "ref", "lot").alias("unit"), "ref", "lot", "buyer", "sort_date", "doubtful", "estimation", F.coalesce("title", "_title").alias("title"), "unsuccessful")
    own = bids_of_units(bids)
    of_simple = own.join(simple.select("ref", "unit"), "ref")
    named = own.withColumn("lot", F.explode(F.split(F.coalesce("lots", F.lit("")), ","))).withColumn("lot", F.trim("lot"))
    of_lots = named.join(by_lot.select("ref", "lot", "unit"), ["ref", "lot"]).drop("lot")
    return simple.unionByName(by_lot), of_simple.unionByName(of_lots)


def concordance(ranked: DataFrame, winners: DataFrame, unit: list[str], by: list[Column]) -> DataFrame:
    """How often the commission's choice is the actual winner, by any brackets. ``winners``: unit, bidder."""
    first = ranked.where("rank = 1").select(*unit, F.col("bidder").alias("_designated"))
    both = first.join(winners.select(*unit, F.col("bidder").alias("_winner"), *by), unit)
    names = [c for c in both.columns if c not in (*unit, "_designated", "_winner")]
    return both.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_designated") == F.col("_winner")).alias("agreed"))


def concordance_report(units: DataFrame, designated: DataFrame) -> DataFrame:
    """(scope, value, units, not_awarded, no_reference, comparable, agreed, reference_differs, rate): how often the replayed rule finds the actual
    winner, over all units, by year and by bracket of offers (of comparable units), with the units that cannot be compared by reason.

    ``units``: unit, year (null: doubtful), winner, stored_reference; ``designated``: unit, reference, bidder, offers. One pass: each
    unit goes to its three scopes before it is summed.
    """
    rows = units.join(designated.select("unit", "reference", F.col("bidder").alias("_chosen"), "offers"), "unit", "left")
    awarded, priced = F.col("winner").isNotNull(), F.col("reference").isNotNull()
    differs = F.col("stored_reference").isNull() | (F.abs(F.col("reference") - F.col("stored_reference")) > 0.01)
    scopes = F.array(
        F.struct(F.lit("all").alias("scope"), F.lit("").alias("value")), F.struct(F.lit("year").alias("scope"), F.coalesce(F.col("year").cast("string"), F.lit("date douteuse")).alias("value")),
        F.when(awarded & priced, F.struct(F.lit("offers").alias("scope"), offers_bracket(F.col("offers")).alias("value"))),
    )
    rows = rows.withColumn("s", F.explode(F.array_compact(scopes))).groupBy("s.scope", "s.value").agg(
        F.count(F.lit(1)).alias("units"), F.count_if(~awarded).alias("not_awarded"), F.count_if(awarded & ~priced).alias("no_reference"), F.count_if(awarded & priced).alias("comparable"),
        F.count_if(awarded & priced & F.coalesce(F.col("_chosen") == F.col("winner"), F.lit(False))).alias("agreed"), F.count_if(awarded & priced & differs).alias("reference_differs"),
    )
    return rows.withColumn("rate", F.when(F.col("comparable") > 0, F.col("agreed") / F.col("comparable")))
