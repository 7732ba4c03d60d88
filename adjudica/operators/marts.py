"""Aggregates of companies, buyers and years: one pass each, with the yearly and the global rows from grouping sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def most_frequent(groups: DataFrame, keys: list[str], value: str, into: str) -> DataFrame:
    """The most frequent ``value`` of each key (ties: the shortest, then the first by text); counted before it is chosen."""
    counted = groups.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*keys).agg(F.min(F.struct(-F.col("_n"), F.length(value), F.col(value).alias("v")))["v"].alias(into))


def company_totals(bids: DataFrame, tenders: DataFrame) -> DataFrame:
    """(bidder_key, name, bids, wins, won, buyers) over kept tenders."""
    kept = bids.join(tenders.where("main").select("ref", "buyer", "winner_key", "reference_price"), "ref")
    won = F.col("winner_key") == F.col("bidder_key")
    totals = kept.groupBy("bidder_key").agg(
        F.count(F.lit(1)).alias("bids"), F.count_if(won).alias("wins"), F.sum(F.when(won, F.coalesce("amount_checked", "amount_deed"))).alias("won"), F.count_distinct("buyer").alias("buyers")
    )
    return totals.join(most_frequent(kept, ["bidder_key"], "bidder", "name"), "bidder_key", "left")


def year_of(sort_date: Column, doubtful: Column) -> Column:
    """The year's text, '' where the date is unreliable or missing."""
    return F.when(F.coalesce(doubtful, F.lit(False)) | F.coalesce(sort_date, F.lit("")).isin(""), "").otherwise(F.substring(sort_date, 1, 4))


def by_key_and_year(rows: DataFrame, key: str, year: str, measures: list[Column]) -> DataFrame:
    """Global rows (null year) and yearly rows of one scan."""
    return rows.groupingSets([[key], [key, year]], key, year).agg(F.grouping(year).alias("is_total"), *measures)


def buyer_medians(units: DataFrame, bids: DataFrame) -> DataFrame:
    """(buyer, tenders, median_gap, share_below, median_bidders) with the unit a simple tender or a lot: ``units`` have unit, ref, buyer,
    estimation and best (the best bid); the gap is percent below the estimation."""
    n = bids.groupBy("unit").agg(F.count(F.lit(1)).alias("bidders"))
    rows = units.join(n, "unit", "left").withColumn("gap", F.when(F.col("estimation") > 0, (F.col("estimation") - F.col("best")) / F.col("estimation") * 100))
    return rows.groupBy("buyer").agg(
        F.count_distinct("ref").alias("tenders"), F.median("gap").alias("median_gap"), (100 * F.avg((F.col("gap") > 0).cast("double"))).alias("share_below"), F.median("bidders").alias("median_bidders")
    )


def year_menu(rows: DataFrame, year: str, current: int, least_share: float = 0.01) -> DataFrame:
    """(year, n, kept): years of four digits up to now that hold ``least_share`` of the rows, or are now; the others form the
    uncertain bucket (kept false)."""
    counted = rows.groupBy(F.coalesce(year, F.lit("")).alias("year")).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1)))
    sound = F.col("year").rlike("^[0-9]{4}$") & (F.col("year") <= str(current))
    return counted.withColumn("kept", sound & ((share >= least_share) | (F.col("year") == str(current))))


def year_options(rows: DataFrame, year: str, current: int, least_share: float = 0.01) -> DataFrame:
    """(year, n): the kept years, and 'incertaine' for all other rows where there are any."""
    menu = year_menu(rows, year, current, least_share)
    return menu.groupBy(F.when(F.col("kept"), F.col("year")).otherwise("incertaine").alias("year")).agg(F.sum("n").alias("n"))


def regrouped_years(rows: DataFrame, key: str, year: str, kept: list[str], distinct: str) -> DataFrame:
    """(key, year, bids, buyers) with the rows of years that are not kept in one bucket; what is distinct is counted from the rows, as counts
    of years don't add up."""
    bucket = F.when(F.col(year).isin(*kept), F.col(year)).otherwise("incertaine")
    return rows.groupBy(key, bucket.alias("year")).agg(F.count(F.lit(1)).alias("bids"), F.count_distinct(distinct).alias("buyers"))


def reconcile(total: DataFrame, parts: DataFrame, keys: list[str], measure: str, tolerance: float = 0.0) -> DataFrame:
    """Keys whose parts do not add up to their total."""
    summed = parts.groupBy(*keys).agg(F.sum(measure).alias("_parts"))
    gap = F.abs(F.coalesce(measure, F.lit(0)) - F.coalesce("_parts", F.lit(0)))
    return total.join(summed, keys, "full").where(gap > tolerance).select(*keys, measure, "_parts")


def dashboard(tenders: DataFrame, bids: DataFrame) -> DataFrame:
    """One row of totals."""
    a = tenders.where("main").agg(
        F.count(F.lit(1)).alias("tenders"), F.count_if(F.expr("winner_key IS NOT NULL")).alias("awarded"), F.count_if("unsuccessful").alias("unsuccessful"), F.count_distinct("buyer").alias("buyers"), F.avg("estimation").alias("mean_estimation")
    )
    b = bids.join(tenders.where("main").select("ref"), "ref", "left_semi").agg(F.count(F.lit(1)).alias("bids"), F.count_distinct("bidder_key").alias("companies"))
    return a.join(F.broadcast(b))  # one row each


def top_per_key(counts: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    return counts.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def last_decisive(labels: DataFrame, keys: list[str], answer: str = "answer", order: tuple[str, ...] = ("created", "id"), undecided: str = "nsp") -> DataFrame:
    """The last answer that decides, of each key; undecided ones never override."""
    return labels.where(F.col(answer) != undecided).groupBy(*keys).agg(F.max_by(answer, F.struct(*order)).alias(answer))


def label_status(labels: DataFrame, keys: list[str], answer: str = "answer") -> DataFrame:
    """conteste if any answer is no, confirme if any is yes."""
    status = F.when(F.bool_or(F.col(answer) == "non"), "conteste").when(F.bool_or(F.col(answer) == "oui"), "confirme")
    return labels.groupBy(*keys).agg(status.alias("status"))


def stability(before: DataFrame, after: DataFrame, keys: list[str], level: str = "level") -> DataFrame:
    """By level of the first period: pairs, and how many of them the second has too."""
    found = before.join(after.select(*keys, F.lit(True).alias("_again")), keys, "left")
    return found.groupBy(level).agg(F.count(F.lit(1)).alias("pairs"), F.count_if("_again").alias("again"))


def wins_with_merges(simple: DataFrame, lots: DataFrame, merges: DataFrame) -> DataFrame:
    """(company, simple, lots, wins) of the won tenders without lots and the won lots (both: winner), a merged company (``merges``: company, into) under the
    one that it was merged into. Merges are of one step; sums are made before they are joined."""
    won = simple.select(F.col("winner").alias("company"), F.lit(1).alias("s"), F.lit(0).alias("l")).unionByName(lots.select(F.col("winner").alias("company"), F.lit(0).alias("s"), F.lit(1).alias("l")))
    summed = won.where(F.col("company").isNotNull()).groupBy("company").agg(F.sum("s").alias("s"), F.sum("l").alias("l"))
    under = summed.join(merges.select("company", "into"), "company", "left").select(F.coalesce("into", "company").alias("company"), "s", "l")
    return under.groupBy("company").agg(F.sum("s").alias("simple"), F.sum("l").alias("lots"), F.sum(F.col("s") + F.col("l")).alias("wins"))


def profile_top(rows: DataFrame, company: str, columns: list[str], most: int = 40) -> DataFrame:
    """The ``most`` most frequent combinations of ``columns`` of each company, with their count (ties in order of the columns)."""
    counted = rows.groupBy(company, *columns).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("place", F.row_number().over(W.partitionBy(company).orderBy(F.col("n").desc(), *columns))).where(F.col("place") <= most)
