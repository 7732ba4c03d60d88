"""Counts over sliding windows of a stream, with state: what the batch windows of ``limits`` give, once the watermark has passed.

Each key keeps the events that the watermark has not passed yet, and counts by second of those that a later event may still look
back on. A timer on the oldest event held wakes the key; counts that no window reaches any more are deleted then, and a key
without either keeps nothing. State lives in the checkpoint, so that a restart goes on where the stream was.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def stateful(spark: SparkSession):
    """Streams that are started inside keep their state in RocksDB, which timers and lists of state need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class WindowCounter(StatefulProcessor):
    """Events with ``out``: the sum of their key's weights from ``back`` to ``ahead`` seconds after each (both negative or 0)."""

    def __init__(self, columns: list[str], held: str, out: str, back: int, ahead: int):
        self.columns, self.schema, self.out, self.back, self.ahead = columns, held, out, back, ahead

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.schema)
        self.sums = handle.getMapState("sums", "second long", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [row for frame in rows if len(frame) for row in frame[self.columns].itertuples(index=False, name=None)]
        if new:
            self.held.appendList(new)
            self.handle.registerTimer((min(row[0] for row in new) + 1) * 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() // 1000  # seconds before are over
        held = list(self.held.get())
        now = sorted((row for row in held if row[0] < passed), key=lambda row: row[0])
        later = [row for row in held if row[0] >= passed]
        sums = {k[0]: v[0] for k, v in self.sums.iterator()} if self.sums.exists() else {}
        known, changed = set(sums), {row[0] for row in now}
        for row in now:
            sums[row[0]] = sums.get(row[0], 0) + row[1]
        seconds = sorted(sums)
        first = last = total = 0
        counts = []
        for row in now:  # two ends that move forward only
            while last < len(seconds) and seconds[last] <= row[0] + self.ahead:
                total, last = total + sums[seconds[last]], last + 1
            while first < last and seconds[first] < row[0] + self.back:
                total, first = total - sums[seconds[first]], first + 1
            counts.append(total)
        oldest = min((row[0] for row in later), default=passed) + self.back
        for s in seconds:
            if s < oldest and s in known:
                self.sums.removeKey((s,))
            elif s >= oldest and s in changed:
                self.sums.updateValue((s,), (sums[s],))
        if now:
            self.held.put(later) if later else self.held.clear()
        wake = min((row[0] for row in later), default=seconds[-1] - self.back if seconds and seconds[-1] >= oldest else None)
        if wake is not None:
            self.handle.registerTimer((wake + 1) * 1000)
        if now:
            frame = pd.DataFrame(now, columns=self.columns).assign(**{self.out: counts})
            yield frame.drop(columns=self.columns[1]).rename(columns={self.columns[0]: "second"}).assign(key_=key[0])

    def close(self) -> None:
        pass


def window_counts(events: DataFrame, key: str, ts: str, delay: str, back: int, ahead: int = 0, weight: Column | None = None, keep: tuple[str, ...] = (), out: str = "recent") -> DataFrame:
    """A stream of (key, second, *keep, out), an event each: the sum of ``weight`` (1) over the key's events from ``back`` to ``ahead``
    seconds after it. An event comes out when the watermark, ``delay`` behind the latest, has passed its second; later than that it is dropped.
    Null keys or times are no events. Start it inside ``stateful``, in append mode."""
    names = [f"k{i}_" for i in range(len(keep))]
    rows = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, delay)
    rows = rows.select(F.col(key).alias("key_"), F.col(ts), F.unix_seconds(ts).alias("s_"), (F.lit(1) if weight is None else F.coalesce(weight, F.lit(0))).cast("long").alias("w_"), *[F.col(c).alias(n) for c, n in zip(keep, names)])
    held = StructType([rows.schema[c] for c in ("s_", "w_", *names)])
    told = StructType([f if f.name != "s_" else type(f)("second", LongType()) for f in held if f.name != "w_"]).add(out, LongType()).add(rows.schema["key_"])
    done = rows.groupBy("key_").transformWithStateInPandas(WindowCounter(["s_", "w_", *names], held, out, back, ahead), told, "Append", "EventTime")
    return done.select(F.col("key_").alias(key), "second", *[F.col(n).alias(c) for c, n in zip(keep, names)], out)


def rate_limited(events: DataFrame, key: str, ts: str, delay: str, limit: int = 90, length: int = 60, keep: tuple[str, ...] = ()) -> DataFrame:
    """``over``: whether the key has more than ``limit`` events up to ``length`` seconds old at an event."""
    return window_counts(events, key, ts, delay, -length, 0, keep=keep).withColumn("over", F.col("recent") > limit)


def locked_out(attempts: DataFrame, key: str, ts: str, delay: str, failed: Column, most: int = 8, length: int = 600, keep: tuple[str, ...] = ()) -> DataFrame:
    """``locked``: whether the key has ``most`` failures or more in the ``length`` seconds before an attempt."""
    return window_counts(attempts, key, ts, delay, -length, -1, failed.cast("int"), keep, "failures").withColumn("locked", F.col("failures") >= most)


def drained(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Takes what the stream has now, and appends it to the Parquet files under ``path``."""
    with stateful(stream.sparkSession):
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
