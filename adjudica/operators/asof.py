"""Point in time: the only place where rows are cut by day. Nothing here lets a later row reach an earlier one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def cut(rows: DataFrame, day: str, limit: str | Column, inclusive: bool, doubtful: str | None = None) -> DataFrame:
    """Rows dated up to ``limit`` (inclusive), or strictly before it. Rows without a day, or of a doubtful one, are invisible."""
    end = F.to_date(F.lit(limit)) if isinstance(limit, str) else limit
    kept = rows.where(F.col(day) <= end if inclusive else F.col(day) < end)
    return kept.where(~F.coalesce(F.col(doubtful), F.lit(False))) if doubtful else kept


def days(column: str | Column) -> Column:
    return F.unix_date(F.col(column) if isinstance(column, str) else column)


def before(keys: list[str], day: str) -> W:
    """All rows of the keys on strictly earlier days (``day`` is a day number)."""
    return W.partitionBy(*keys).orderBy(day).rangeBetween(W.unboundedPreceding, -1)


def window_before(keys: list[str], day: str, length: int) -> W:
    """Rows of the keys in [day - length, day)."""
    return W.partitionBy(*keys).orderBy(day).rangeBetween(-length, -1)


def first_seen(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def range_join(events: DataFrame, targets: DataFrame, keys: list[str], day: str, target_day: str, length: int) -> DataFrame:
    """Pairs of a target and the events of its keys in [target day - length, target day). Both sides are shuffled on
    the keys and a bucket of ``length`` days, so that a target meets two buckets and not a key's whole history."""
    e = events.withColumn("_bucket", F.floor(F.col(day) / length))
    t = targets.withColumn("_bucket", F.explode(F.sequence(F.floor((F.col(target_day) - length) / length), F.floor((F.col(target_day) - 1) / length))))
    return t.join(e, [*keys, "_bucket"]).where((F.col(day) >= F.col(target_day) - length) & (F.col(day) < F.col(target_day))).drop("_bucket")


def latest_copy(predictions: DataFrame, outcomes: DataFrame, key: list[str], made: str, opened: str) -> DataFrame:
    """Each outcome with the last prediction made by its opening day, or the first where all are later."""
    both = outcomes.join(predictions, key, "left")
    names = [c for c in predictions.columns if c not in key]
    copy = F.struct(*names)
    early = F.max_by(F.when(F.col(made) <= F.col(opened), copy), F.when(F.col(made) <= F.col(opened), F.col(made)))
    picked = both.groupBy(*outcomes.columns).agg(F.coalesce(early, F.min_by(copy, made)).alias("_copy"))
    return picked.select(*outcomes.columns, "_copy.*")


def corpus(units: DataFrame, day: str, estimation: str, reference: str) -> tuple[DataFrame, DataFrame]:
    """(kept, exclusions): units that are dated, estimated and have a reference; and one row of counts of those that are not, by
    the first reason that holds."""
    reason = F.when(F.col(day).isNull(), "undated").when(~F.coalesce(F.col(estimation) > 0, F.lit(False)), "no_estimation").when(F.col(reference).isNull(), "no_reference")
    marked = units.withColumn("_reason", reason)
    return marked.where("_reason IS NULL").drop("_reason"), marked.where("_reason IS NOT NULL").groupBy(F.col("_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def due_today(rows: DataFrame, ref: str, attempts: str, today: int, cycle: int, most: int) -> DataFrame:
    """Rows to try again: each ref has its day of the cycle, by its md5, until ``most`` attempts."""
    turn = F.pmod(F.conv(F.substring(F.md5(F.col(ref).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(cycle))
    return rows.where((turn == today % cycle) & (F.col(attempts) < most))
