"""Frozen predictions held against outcomes, error statistics, backtests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from adjudica.functions.measures import offers_bracket


def freeze(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions to append: a key (tender, lot, day) that is frozen already keeps its first copy."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def listing(frozen: DataFrame, keys: list[str], day: str) -> DataFrame:
    return frozen.groupBy(*keys).agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count(F.lit(1)).alias("copies"))


def errors(rows: DataFrame, predicted: str, actual: str, by: list[str], near: float = 2.0) -> DataFrame:
    """Mean and median absolute error, and the share within ``near``."""
    gap = F.abs(F.col(predicted) - F.col(actual))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(gap).alias("mae"), F.median(gap).alias("median"), F.avg((gap <= near).cast("double")).alias("within"))


def duel(rows: DataFrame, a: str, b: str, actual: str, by: list[str]) -> DataFrame:
    """How often ``a`` is nearer than ``b``."""
    x, y = F.abs(F.col(a) - F.col(actual)), F.abs(F.col(b) - F.col(actual))
    return rows.groupBy(*by).agg(F.count_if(x < y).alias("wins"), F.count_if(x == y).alias("ties"), F.count_if(x > y).alias("losses"))


def bootstrap(rows: DataFrame, unit: str, value: str, repeats: int = 200) -> DataFrame:
    """95 % interval of a mean: each repeat weighs a unit by a Poisson(1) count drawn from a hash of unit and repeat, so that
    no sample is gathered. A unit's rows are added up first, and one row a unit is weighed for all repeats. The draw is the first 52 bits of
    the hash; its hexadecimal digits order as the number does, so that they are held against the digits of the law's steps and nothing is parsed."""
    # Poisson(1) by inversion: the cumulated law's steps
    steps, term, total = [], 0.36787944117144233, 0.0
    for k in range(1, 9):
        total += term
        steps.append(total)
        term /= k
    # the digits after the first 13 are less than "g": a hash is over this where its 52 bits are over the step
    beyond = [f"{int(s * (1 << 52)):013x}g" for s in steps]
    times = F.when(F.col("h") < beyond[0], 0)
    for k, step in enumerate(beyond[1:], 1):
        times = times.when(F.col("h") < step, k)
    summed = rows.groupBy(unit).agg(F.sum(value).alias("_s"), F.count(value).alias("_n")).withColumn("_u", F.when(F.col(unit).isNull(), "").otherwise(F.concat(F.col(unit).cast("string"), F.lit("|"))))
    drawn = summed.select("_s", "_n", "_u", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat")).select("repeat", "_s", "_n", F.md5(F.concat("_u", F.col("repeat").cast("string"))).alias("h"))
    drawn = drawn.select("repeat", "_s", "_n", times.otherwise(len(beyond)).alias("w"))
    means = drawn.groupBy("repeat").agg((F.sum(F.col("w") * F.col("_s")) / F.sum(F.col("w") * F.col("_n"))).alias("m"))
    q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    return means.agg(q.alias("q")).select(F.get("q", 0).alias("low"), F.get("q", 1).alias("high"))


def confusion(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    return rows.groupBy(predicted.alias("predicted"), actual.alias("actual")).agg(F.count(F.lit(1)).alias("n"))


def agreement_by_bracket(rows: DataFrame, n_offers: str, agreed: Column) -> DataFrame:
    return rows.groupBy(offers_bracket(F.col(n_offers)).alias("bracket")).agg(F.count(F.lit(1)).alias("n"), F.count_if(agreed).alias("agreed"))


def diverse_sample(rows: DataFrame, id_col: str, buyer: str, month: str, stratum: str, per_stratum: int, seed: str = "") -> DataFrame:
    """A sample that is the feature: one row a buyer (by hash order), then of each stratum the rows of its least used months first."""
    from pyspark.sql import Window as W

    order = F.sha2(F.concat(F.col(id_col).cast("string"), F.lit(seed)), 256)
    one = rows.withColumn("_o", order).withColumn("_n", F.row_number().over(W.partitionBy(buyer).orderBy("_o"))).where("_n = 1")
    turn = one.withColumn("_turn", F.row_number().over(W.partitionBy(stratum, month).orderBy("_o")))
    return turn.withColumn("_k", F.row_number().over(W.partitionBy(stratum).orderBy("_turn", "_o"))).where(F.col("_k") <= per_stratum).drop("_o", "_n", "_turn", "_k")
