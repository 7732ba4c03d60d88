"""Request limits, sessions and the notice feed, in batch and as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def sliding_count(events: DataFrame, key: str, second: str, length: int) -> DataFrame:
    """``events`` with the number of the key's events up to ``length`` seconds old at each (one exactly that old counts still)."""
    w = W.partitionBy(key).orderBy(second).rangeBetween(-length, 0)
    return events.withColumn("recent", F.count(F.lit(1)).over(w))


def refused(events: DataFrame, key: str, second: str, limits: dict[int, int]) -> DataFrame:
    """``events`` with over: whether any window of the given lengths holds more than its limit."""
    over = F.lit(False)
    for k, (length, most) in enumerate(limits.items()):
        events = sliding_count(events, key, second, length).withColumnRenamed("recent", f"_r{k}")
        over = over | (F.col(f"_r{k}") > most)
    return events.withColumn("over", over).drop(*[f"_r{k}" for k in range(len(limits))])


def tumbling(events: DataFrame, key: str, ts: str, length: str, watermark: str | None = None) -> DataFrame:
    """(start, key, n): counts by window, of a batch or (with a watermark) of a stream."""
    rows = events.withWatermark(ts, watermark) if watermark else events
    return rows.groupBy(F.window(ts, length).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sliding_windows(events: DataFrame, key: str, ts: str, length: str, slide: str, watermark: str | None = None) -> DataFrame:
    rows = events.withWatermark(ts, watermark) if watermark else events
    return rows.groupBy(F.window(ts, length, slide).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sessions(events: DataFrame, key: str, ts: str, gap: str, watermark: str | None = None) -> DataFrame:
    """(key, start, stop, n): events with less than ``gap`` between."""
    rows = events.withWatermark(ts, watermark) if watermark else events
    return rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def lockouts(attempts: DataFrame, key: str, second: str, failed: Column, most: int = 8, length: int = 600) -> DataFrame:
    """Attempts that come when the key has ``most`` failures in the ``length`` seconds before."""
    w = W.partitionBy(key).orderBy(second).rangeBetween(-length, -1)
    return attempts.withColumn("locked", F.coalesce(F.sum(failed.cast("int")).over(w), F.lit(0)) >= most)


def feed(stream: DataFrame, apply, checkpoint: str, once: bool = True):
    """Runs ``apply(batch, id)`` on each micro-batch of a stream. A batch that is run again must change nothing: see ``sinks.upsert``."""
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def distinct_feed(stream: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """Each key once within the watermark, however often it is pushed."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def supersede(events: DataFrame, key: str, arrival: str, value: str) -> DataFrame:
    """The value that arrived last, of each key."""
    return events.groupBy(key).agg(F.max_by(value, arrival).alias(value), F.max(arrival).alias(arrival))
