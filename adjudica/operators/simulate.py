"""Seeded Monte-Carlo of an opening: who comes, at what rates, and where our bid would win.

Draws are counter-based (mulberry32 of seed and draw number), so that a scenario gives the same numbers
wherever it is computed, and scenarios are rows: a tender's thousands of scenarios spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from adjudica.operators.commission import RATIO, SCALE, reference_prices, commission_rank

#: Candidates times scenarios that are drawn at once, about.
CELLS = 1 << 18
#: Amounts times rates that are replayed at once, about.
GRID_CELLS = 1 << 16
# The grid of our bid's rate is (FIRST + j) / DENOMINATOR, j below POINTS.
FIRST, DENOMINATOR, POINTS = 1600, 2000, 801


def uniforms(seed: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Draw number ``draw`` (from 1) of the mulberry32 stream of each seed, in [0, 1)."""
    mask = np.uint64(0xFFFFFFFF)
    t = (seed.astype(np.uint64) + draw.astype(np.uint64) * np.uint64(0x6D2B79F5)) & mask
    t = ((t ^ (t >> np.uint64(15))) * (t | np.uint64(1))) & mask
    t ^= (t + (((t ^ (t >> np.uint64(7))) * (t | np.uint64(61))) & mask)) & mask
    return ((t ^ (t >> np.uint64(14))) & mask).astype(float) / 4294967296.0


def normals(seed: np.ndarray, draw: np.ndarray) -> np.ndarray:
    return np.sqrt(-2 * np.log(1 - uniforms(seed, draw))) * np.cos(2 * np.pi * uniforms(seed, draw + np.uint64(1)))


def grid() -> np.ndarray:
    return (FIRST + np.arange(POINTS)) / DENOMINATOR


def winning_intervals(offers: list[float]) -> list[tuple[float, float]]:
    """(low, high] of the rates of a last bid that win against ``offers``.

    The reference is a line in our rate x, ``at + slope * x``, which x meets at ``even``. Up to there we win in a gap between two
    offers while the gap's upper one lies beyond the reference; past it only below all offers.
    """
    slope = 1 / (2 * (len(offers) + 1))
    at = slope * sum(offers) + 0.5
    even = at / (1 - slope)
    lows, highs = [-np.inf, *sorted(offers)], [*sorted(offers), np.inf]
    gaps = [(low, min(np.nextafter((high - at) / slope, -np.inf), np.nextafter(high, -np.inf), even)) for low, high in zip(lows, highs)]
    return [g for g in gaps if g[0] < g[1]] + ([(even, np.nextafter(highs[0], -np.inf))] if even < highs[0] else [])


def count_wins(scenarios_: list[list[float]], xs: np.ndarray) -> np.ndarray:
    """In how many of the scenarios (their offers) each rate of the ascending ``xs`` wins: the ends of the intervals, summed up."""
    ends = np.array([e for offers in scenarios_ for e in winning_intervals(offers)]).reshape(-1, 2)
    change = np.zeros(len(xs) + 1, np.int64)
    for column, step in ((0, 1), (1, -1)):
        np.add.at(change, np.searchsorted(xs, ends[:, column], side="right"), step)
    return np.cumsum(change[:-1])


def seed_of(unit: Column) -> Column:
    return F.crc32(unit.cast("string").cast("binary"))


def drawn(p: np.ndarray, mu: np.ndarray, sigma: np.ndarray, seed: int, first: int, last: int) -> Iterator[list[list[float]]]:
    """The offers of scenarios ``first`` to ``last``, some at a time: about ``CELLS`` candidates are drawn at once, and rates only of those who come."""
    step = max(1, CELLS // max(1, len(p)))
    for start in range(first, last, step):
        ids = np.arange(start, min(last, start + step))
        draw = (ids[:, None] * len(p) + np.arange(len(p))[None, :]) * 4 + 1
        comes = uniforms(np.full(draw.shape, seed), draw) < p
        row, k = np.nonzero(comes)
        rate = mu[k] + sigma[k] * normals(np.full(len(k), seed), draw[row, k] + 1)
        yield [x.tolist() for x in np.split(rate, np.searchsorted(row, np.arange(1, len(ids))))]


def scenarios(candidates: DataFrame, n: int = 4000, per_task: int = 250) -> DataFrame:
    """(unit, block, wins): per unit and block of scenarios, how often each grid rate wins. ``candidates``: unit, p (chance to come), mu, sigma
    of the rate; a unit's candidates are one list, of 24 bytes each. Each candidate has four draws a scenario, in order of its place."""
    own = candidates.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("p", "mu", "sigma"))).alias("c"))
    blocks = own.select("unit", "c", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // per_task))).alias("block"), seed_of(F.col("unit")).alias("seed"))
    kind = candidates.schema["unit"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs = grid()
        for batch in batches:
            blocks_, seeds, wins, sizes = batch.column("block").to_pylist(), batch.column("seed").to_pylist(), [], []
            for k, (block, seed) in enumerate(zip(blocks_, seeds)):
                c = batch.column("c")[k].values
                p, mu, sigma = (pc.cast(c.field(j), pa.float64()).to_numpy(zero_copy_only=False) for j in range(3))
                first, last = block * per_task, min(n, (block + 1) * per_task)
                wins.append(sum(count_wins(offers, xs) for offers in drawn(p, mu, sigma, seed, first, last)))
                sizes.append(last - first)
            yield pa.RecordBatch.from_arrays([batch.column("unit"), pa.array(blocks_, pa.int32()), pa.array(sizes, pa.int64()), pa.array(wins, pa.list_(pa.int64()))], names=["unit", "block", "n", "wins"])

    parts = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(parts, "unit", "block").mapInArrow(run, f"unit {kind}, block int, n long, wins array<long>")


def chance_curve(candidates: DataFrame, n: int = 4000) -> DataFrame:
    """(unit, j, x, chance) on the grid."""
    rows = scenarios(candidates, n).select("unit", "n", F.posexplode("wins").alias("j", "w"))
    return rows.groupBy("unit", "j").agg((F.sum("w") / F.sum("n")).alias("chance")).withColumn("x", (F.col("j") + FIRST) / F.lit(float(DENOMINATOR)))


def winning_rates(offers: DataFrame, rates: list[float]) -> DataFrame:
    """The official rule on real bids for a grid of our rates: (unit, rate, wins), by replaying the commission with our bid last.
    ``offers``: unit, seq, amount as a rate of the estimation."""
    key = ["unit", "rate"]
    each = F.explode(F.array(*[F.lit(float(r)) for r in rates]))
    own = offers.select("unit").distinct().select("unit", each.alias("rate"))
    ours = own.select(*key, F.lit(1 << 60).alias("seq"), F.col("rate").alias("amount"))
    both = offers.select("unit", F.col("seq").cast("long").alias("seq"), "amount", each.alias("rate")).select(*key, "seq", "amount").unionByName(ours)
    ranked = commission_rank(both, reference_prices(both, own.withColumn("estimation", F.lit(1.0)), key, None), key)
    return ranked.where(F.col("seq") == F.lit(1 << 60)).select(*key, (F.col("rank") == 1).alias("wins"))


def replay_on_grid(amounts: np.ndarray, estimation: float, xs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(judged, wins) of each rate: what ``commission.replay_with_bid`` (unrounded) says of one unit, with a fictitious
    last bid of rate x ``estimation`` beside the real ``amounts``. Sums go in the same order, so that ties are the same."""
    own = xs * estimation
    all_ = np.sort(np.column_stack([np.broadcast_to(amounts, (len(xs), len(amounts))), own]), axis=1)
    mid = all_[:, all_.shape[1] // 2, None]
    near, alike = ((all_ >= m / SCALE) & (all_ <= m * SCALE) for m in (estimation, mid))
    used = np.where((near.sum(1) >= 2)[:, None], near, np.where((alike.sum(1) >= 2)[:, None], alike, True))
    total = np.zeros(len(xs))
    for k in range(all_.shape[1]):
        total = np.where(used[:, k], total + all_[:, k], total)
    mean = total / used.sum(1)
    judged = (mean / estimation <= RATIO) & (mean / estimation >= 1 / RATIO)
    reference = (mean + estimation) / 2
    others, lowest = np.asarray(amounts)[None, :], np.min(amounts)
    beaten = ((others >= own[:, None]) & (others <= reference[:, None])).any(1)
    return judged, judged & np.where(own <= reference, ~beaten, lowest > own)


def replay_units(amounts: np.ndarray, estimations: np.ndarray, xs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``replay_on_grid`` of many units of equally many real amounts (a row a unit, none of them NaN): (judged, wins) of each unit and rate.
    Sorted lists that hold one more are made by limits, place by place, and not sorted again."""
    sorted_, est = np.sort(amounts, axis=1), estimations[:, None]
    own, n = xs[None, :] * est, sorted_.shape[1]
    at = [sorted_[:, k, None] for k in range(n)]
    all_ = [np.minimum(own, at[0]), *[np.minimum(np.maximum(own, low), high) for low, high in zip(at, at[1:])], np.maximum(own, at[-1])]
    within = lambda m: [(a >= m / SCALE) & (a <= m * SCALE) for a in all_]
    near, alike = within(est), within(all_[len(all_) // 2])
    by_near = sum(u.astype(np.int8) for u in near) >= 2
    rest = ~by_near & ~(sum(u.astype(np.int8) for u in alike) >= 2)
    total, count = np.zeros(own.shape), np.zeros(own.shape, np.int16)
    for a, u, v in zip(all_, near, alike):
        used = np.where(by_near, u, v) | rest
        np.add(total, a, out=total, where=used)
        count += used
    mean = total / count
    judged = (mean / est <= RATIO) & (mean / est >= 1 / RATIO)
    reference = (mean + est) / 2
    beaten = np.zeros(own.shape, bool)
    for a in at:
        beaten |= (a >= own) & (a <= reference)
    return judged, judged & np.where(own <= reference, ~beaten, at[0] > own)


def fixed_rate_curve(bids: DataFrame, tenders: DataFrame, unit: list[str], by: str) -> DataFrame:
    """(by, j, x, chance): the share of the judged units of each ``by`` (a column of ``tenders``) that each rate of the grid
    wins. A unit is one row, whose bids are a bounded list; tasks hand on sums over the grid, not copies of bids."""
    own = tenders.where("estimation > 0").select(*unit, "estimation", by)
    rows = bids.groupBy(*unit).agg(F.collect_list("amount").alias("amounts")).join(own, unit).select(by, "estimation", "amounts")
    kind = tenders.schema[by].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        xs = grid()
        for frame in frames:
            sums: dict = {}
            sizes = frame.amounts.map(len)
            for (key, size), part in frame.groupby([frame[by], sizes], dropna=False, sort=False):
                key = None if pd.isna(key) else key
                w, n = sums.setdefault(key, (np.zeros(len(xs), np.int64), np.zeros(len(xs), np.int64)))
                step = max(1, GRID_CELLS // (len(xs) * (size + 1)))
                for k in range(0, len(part), step):
                    amounts, own = np.array(part.amounts.iloc[k : k + step].tolist(), float), part.estimation.to_numpy(float)[k : k + step]
                    plain = ~np.isnan(amounts).any(axis=1)
                    for judged, wins in [replay_units(amounts[plain], own[plain], xs), *[replay_on_grid(a, e, xs) for a, e in zip(amounts[~plain], own[~plain])]]:
                        w += wins.reshape(-1, len(xs)).sum(0)
                        n += judged.reshape(-1, len(xs)).sum(0)
            yield pd.DataFrame([(k, w.tolist(), n.tolist()) for k, (w, n) in sums.items()], columns=[by, "w", "n"])

    sums = rows.mapInPandas(run, f"`{by}` {kind}, w array<long>, n array<long>").select(by, F.posexplode(F.arrays_zip("w", "n")).alias("j", "s"))
    told = sums.groupBy(by, "j").agg(F.sum("s.w").alias("w"), F.sum("s.n").alias("n")).where("n > 0")
    return told.select(by, "j", ((F.col("j") + FIRST) / F.lit(float(DENOMINATOR))).alias("x"), (F.col("w") / F.col("n")).alias("chance"))


def histogram(rows: DataFrame, value: str, start: float = 0.7, width: float = 0.005) -> DataFrame:
    return rows.groupBy(F.floor((F.col(value) - start) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
