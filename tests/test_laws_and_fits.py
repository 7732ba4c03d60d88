"""Laws of long lists, shifts to a target and grouped regressions against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from adjudica.operators import bidder_laws, bidders, grouped_fit


def plain_law(ps):
    d = [1.0]
    for p in ps:
        d = [(d[k] if k < len(d) else 0) * (1 - p) + (d[k - 1] * p if k else 0) for k in range(len(d) + 1)]
    return d


def test_law_of_long_and_short_lists(spark, monkeypatch):
    monkeypatch.setattr(bidder_laws, "CHUNK", 16)
    rng = random.Random(4)
    lists = {"long": [rng.random() for _ in range(3000)], "short": [0.2, 0.7], "sure": [1.0, 1.0, 0.0], "one": [0.3], "same": [0.5] * 40}
    rows = [(u, k, p) for u, ps in lists.items() for k, p in enumerate(ps)] + [("none", 0, None), ("short", 9, None)]
    got = {r.unit: r for r in bidder_laws.count_laws(spark.createDataFrame(rows, "unit string, k long, p double"), ["unit"], "p", ["k"]).collect()}
    assert set(got) == set(lists)
    for u, ps in lists.items():
        assert got[u].n == len(ps) and got[u].law == pytest.approx(plain_law(ps), abs=1e-14)
    big = np.full(1 << 15, 1e-5)
    assert bidder_laws._product(big, big)[:5] == pytest.approx(np.arange(1, 6) * 1e-10, abs=1e-12)


def test_mixed_law_and_shift(spark):
    rng = random.Random(9)
    sets = {f"u{k}": ([rng.uniform(0.01, 0.9) for _ in range(rng.randint(1, 40))], rng.choice([0.0, 1.5]), rng.choice([0.0, 0.6]), rng.choice([0.0, -0.4])) for k in range(12)}
    sets["empty"] = ([], 2.0, 0.5, 0.0)
    rows = spark.createDataFrame([(u, k, p) for u, (ps, *_) in sets.items() for k, p in enumerate(ps)], "unit string, k long, p double")
    settings = spark.createDataFrame([(u, lam, s, d) for u, (_, lam, s, d) in sets.items()], "unit string, unannounced double, spread double, shift double")
    got = {r.unit: r.law for r in bidder_laws.mixed_laws(rows, ["unit"], "p", ["k"], settings).collect()}
    arrays = spark.createDataFrame([(u, ps, lam, s, d) for u, (ps, lam, s, d) in sets.items()], "unit string, ps array<double>, lam double, s double, d double")
    want = {r.unit: r.law for r in arrays.select("unit", bidders.mixed_count_law("ps", "lam", "s", "d").alias("law")).collect()}
    for u in sets:
        size = max(len(got[u]), len(want[u]))
        assert got[u] + [0.0] * (size - len(got[u])) == pytest.approx(want[u] + [0.0] * (size - len(want[u])), abs=3e-9)
    logits = F.transform("ps", lambda p: F.ln(p / (1 - p)))
    at = arrays.where("size(ps) > 0").withColumn("target", F.col("lam") + F.size("ps") * (0.1 + 0.8 * F.pmod(F.hash("unit"), F.lit(7)) / 7))
    at = at.withColumn("shift", bidder_laws.shift_to(logits, F.col("lam"), F.col("s"), F.col("target")))
    at = at.withColumn("mean", bidder_laws.shifted_mean(logits, F.col("lam"), F.col("s"), F.col("shift"))).collect()
    inside = [r for r in at if abs(r.shift) < 5.9]
    assert len(inside) >= 8 and all(r.mean == pytest.approx(r.target, abs=1e-6) for r in inside)
    for r in at:  # the mean without the law is the law's mean
        slow = sum(w * (sum(1 / (1 + math.exp(-(math.log(p / (1 - p)) + u))) for p in r.ps) + r.lam * math.exp(u)) for x, w in bidder_laws.QUADRATURE for u in [r.shift + r.s * x - r.s * r.s / 2])
        assert r.mean == pytest.approx(slow, rel=1e-12)


def test_recalibration_and_quantiles(spark):
    table = {"log_mean": [0.0, 1.0, 2.0], "added": [-0.2, 0.0, 0.4], "factor": [1.5, 1.0, 0.5]}
    rows = spark.createDataFrame([(math.exp(v), 0.1, 0.8) for v in (-3.0, 0.5, 1.5, 9.0)] + [(0.0, 0.1, 0.8)], "m double, d double, s double")
    got = [tuple(r.x) for r in rows.select(bidder_laws.recalibrated(F.col("m"), F.col("d"), F.col("s"), table).alias("x")).collect()]
    assert got == [pytest.approx(v) for v in [(-0.1, 1.2), (0.0, 1.0), (0.3, 0.6), (0.5, 0.4), (-0.1, 1.2)]]
    laws = spark.createDataFrame([([0.1, 0.2, 0.3, 0.4],), ([1.0],), ([0.5, 0.4],)], "law array<double>")
    assert [r.q for r in laws.select(bidder_laws.quantile_of(F.col("law"), 0.95).alias("q")).collect()] == [3, 0, 1]


def plain_fit(x, y, ridge):
    x = np.column_stack([np.ones(len(x)), x])
    beta, free = np.zeros(x.shape[1]), np.r_[0.0, np.full(x.shape[1] - 1, ridge)]
    for _ in range(200):  # gradient steps of a safe length, then Newton
        p = 1 / (1 + np.exp(-x @ beta))
        h = (x.T * (p * (1 - p))) @ x + np.diag(free) + 1e-12 * np.eye(len(beta))
        beta = beta + 0.5 * np.linalg.solve(h, x.T @ (y - p) - free * beta)
    return beta


def test_regressions_of_all_segments(spark):
    rng = np.random.RandomState(2)
    rows, own = [], {}
    for s, (n, true) in {"big": (3000, [-1.0, 2.0, 0.0]), "small": (60, [0.5, -1.0, 1.0]), "rare": (400, [-3.0, 0.5, 0.5])}.items():
        x = rng.normal(size=(n, 2)) * [1.0, 3.0]
        y = (rng.random_sample(n) < 1 / (1 + np.exp(-(true[0] + x @ true[1:])))).astype(float)
        own[s] = (x, y)
        rows += [(s, float(a), float(b), bool(v)) for (a, b), v in zip(x, y)]
    x, y = own["small"]
    own["small"] = (np.vstack([x, [[0.0, 1.0]]]), np.r_[y, 1.0])
    rows += [("small", None, 1.0, True), (None, 1.0, 1.0, True), ("big", 1.0, 1.0, None)]
    frame = spark.createDataFrame(rows, "segment string, a double, b double, came boolean")
    got = {r.segment: r for r in grouped_fit.fit_logistic_by(frame, "segment", ["a", "b"], "came", 0.1).collect()}
    assert set(got) == set(own)
    for s, (x, y) in own.items():
        assert [got[s].intercept, *got[s].coefficients] == pytest.approx(plain_fit(x, y, 0.1).tolist(), abs=1e-6) and got[s].n == len(y)
    steep = spark.createDataFrame([("s", float(k), k > 20) for k in range(-30, 60)], "segment string, a double, came boolean")  # separable: the penalty bounds it
    one = grouped_fit.fit_logistic_by(steep, "segment", ["a"], "came", 0.01).first()
    want = plain_fit(np.array([[float(k)] for k in range(-30, 60)]), np.array([float(k > 20) for k in range(-30, 60)]), 0.01)
    assert [one.intercept, *one.coefficients] == pytest.approx(want.tolist(), rel=1e-5)


def test_scenarios_are_drawn_some_at_a_time(monkeypatch):
    import numpy as np

    from adjudica.operators import simulate

    rng, sizes = np.random.default_rng(3), []
    p, mu, sigma = rng.random(40) * 0.2, rng.random(40), rng.random(40) * 0.1
    draw = (np.arange(30)[:, None] * 40 + np.arange(40)[None, :]) * 4 + 1
    seeds = np.full(draw.shape, 77)
    comes, rate = simulate.uniforms(seeds, draw) < p, mu + sigma * simulate.normals(seeds, draw + 1)
    want = [rate[k][comes[k]].tolist() for k in range(10, 30)]
    plain = simulate.uniforms
    monkeypatch.setattr(simulate, "uniforms", lambda s, d: sizes.append(d.size) or plain(s, d))
    monkeypatch.setattr(simulate, "CELLS", 100)
    assert [x for some in simulate.drawn(p, mu, sigma, 77, 10, 30) for x in some] == want
    assert max(sizes) <= 100 and max(map(len, want)) > 2


def test_shifts_are_halved_for_a_batch_at_once(spark):
    rows = [(0, [0.5, -1.0, 2.0], 1.2), (1, [], 0.2), (2, None, 1.0), (3, [0.5, None], 1.0), (4, [0.5], None), (5, [0.0] * 300, 30.0)]
    frame = spark.createDataFrame(rows, "id long, z array<double>, target double")
    told = frame.select("id", bidder_laws.shift_to(F.col("z"), F.lit(0.3), F.lit(0.0), F.col("target")).alias("shift"))
    assert "ArrowEvalPython" in told._jdf.queryExecution().executedPlan().toString()
    got = {r.id: r.shift for r in told.collect()}
    mean = lambda z, s: sum(1 / (1 + math.exp(-(x + s))) for x in z) + 0.3 * math.exp(s)
    assert all(abs(mean(rows[k][1], got[k]) - rows[k][2]) < 1e-9 for k in (0, 1, 5))
    assert all(abs(got[k] + 6.0) < 1e-9 for k in (2, 3, 4))


def test_median_of_all_values_by_bins(spark):
    import statistics

    from adjudica.operators import rates

    rng = random.Random(2)
    for values in ([rng.gauss(1, 0.1) for _ in range(501)], [rng.gauss(1, 0.1) for _ in range(500)], [1.0] * 7 + [2.0] * 7, [3.0, None], [1.0, 1.0, 1e9], []):
        frame = spark.createDataFrame([(v,) for v in values], "v double")
        got, known = rates.wide_median(frame, "v", 4).first()[0], [v for v in values if v is not None]
        assert got == (frame.agg(F.median("v")).first()[0] if known else None) and (not known or abs(got - statistics.median(known)) < 1e-12)
