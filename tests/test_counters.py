"""Counts of a stream with state are those of the batch windows, across micro-batches and a restart."""

import collections
import random

from pyspark.sql import functions as F

from adjudica.streaming import counters, limits


def _files(spark, rows, folder, parts, offset):
    """One file a part, in order of the parts; parts are of ascending time, shuffled inside."""
    for k, part in enumerate(parts):
        spark.createDataFrame(part, "id long, user string, s long, bad boolean").withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(f"{folder}/{offset + k:03d}")


def test_stream_counts_are_the_batch_counts(spark, tmp_path):
    rng = random.Random(3)
    times = sorted(rng.choice([rng.randint(0, 4000), rng.randint(0, 300)]) for _ in range(600))
    rows = [(k, rng.choice(["a", "b", "c", "hot", "hot"]), 1_700_000_000 + t, rng.random() < 0.6) for k, t in enumerate(times)]
    rows += [(600 + k, None, 1_700_000_000 + k, True) for k in range(3)]
    batch = spark.createDataFrame([r for r in rows if r[1] is not None], "id long, user string, s long, bad boolean")
    rate = {r.id: r.recent for r in limits.sliding_count(batch, "user", "s", 60).collect()}
    lock = {r.id: r.locked for r in limits.lockouts(batch, "user", "s", F.col("bad"), 4, 300).collect()}
    rows = sorted(rows, key=lambda r: r[2])
    parts = [rows[k : k + 101] for k in range(0, len(rows), 101)]
    for part in parts:
        rng.shuffle(part)
    closing = [[(-1, "end", 1_700_100_000, False)], [(-2, "end", 1_700_200_000, False)]]
    _files(spark, rows, str(tmp_path / "in"), parts[:3], 0)
    stream = spark.readStream.schema("id long, user string, s long, bad boolean, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    made = {
        "rate": counters.rate_limited(stream, "user", "ts", "10 seconds", 5, 60, ("id",)),
        "lock": counters.locked_out(stream, "user", "ts", "10 seconds", F.col("bad"), 4, 300, ("id",)),
    }
    for name, out in made.items():  # the first half of the files, stopped, and then the others from the checkpoint
        counters.drained(out, str(tmp_path / name), str(tmp_path / f"cp-{name}"))
    early = spark.read.parquet(str(tmp_path / "rate")).count()
    assert 0 < early < 3 * 101
    _files(spark, rows, str(tmp_path / "in"), [*parts[3:], *closing], 3)
    for name, out in made.items():
        counters.drained(out, str(tmp_path / name), str(tmp_path / f"cp-{name}"))
    got = spark.read.parquet(str(tmp_path / "rate")).where("id >= 0").collect()
    assert len(got) == len(rate) and {r.id: r.recent for r in got} == rate and all(r.over == (r.recent > 5) for r in got)
    got = spark.read.parquet(str(tmp_path / "lock")).where("id >= 0").collect()
    assert len(got) == len(lock) and {r.id: r.locked for r in got} == lock and collections.Counter(lock.values())[True] > 20
