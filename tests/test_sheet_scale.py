"""Steps whose work must not grow beside the input: draws, requirements, replays and sheets, each held against a plain version."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from adjudica.operators import commission, eligibility, sheets, simulate, tracking


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_draws_are_told_by_digits(spark):
    values = {k: [float(k % 7), float(k % 3)] for k in range(60)}
    rows = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [(None, 2.0)], "u long, v double")
    values[None] = [2.0]
    steps = [sum(math.exp(-1) / math.factorial(i) for i in range(k)) for k in range(1, 9)]
    means = []
    for repeat in range(1, 41):
        s = n = 0
        for k, vs in values.items():
            u = int(hashlib.md5("|".join(str(x) for x in (k, repeat) if x is not None).encode()).hexdigest()[:13], 16) / (1 << 52)
            w = sum(u > t for t in steps)
            s, n = s + w * sum(vs), n + w * len(vs)
        means.append(s / n)
    told = tracking.bootstrap(rows, "u", "v", 40)
    assert "conv(" not in plan_of(told)
    r = told.first()
    assert (r.low, r.high) == (pytest.approx(np.quantile(means, 0.025)), pytest.approx(np.quantile(means, 0.975)))


def test_requirements_are_not_shuffled_for_partners(spark):
    need = spark.createDataFrame([("t1", "B.4 - x", "1"), ("t1", "B.3 - x", "1"), ("t2", "B.4 - x", "3"), ("t2", "B.3 ou B.4", "2"), ("t3", "B.1", "5"), ("t3", None, "5"), (None, "B.4", "2")], "tender string, label string, class string")
    ours = spark.createDataFrame([("B.1", "4"), ("B.3", "2")], "code string, class string")
    partners = spark.createDataFrame([("q", "B.4", "2"), ("p", "B.4", "2"), ("o", "B.4", "S"), ("n", "B.3", "1"), ("m", "B.4", None)], "name string, code string, class string")
    checked = eligibility.check(eligibility.requirements(need), ours, partners)
    assert "SortMergeJoin" not in plan_of(checked)
    got = {(r.tender, r.code, r["rank"]): (r.state, r.covered_by) for r in checked.collect()}
    want = {("t1", "B.4", 1): ("absent", "o"), ("t1", "B.3", 1): ("classe", "n"), ("t2", "B.4", 3): ("absent", "o"), ("t2", "B.3", 2): ("ok", None), ("t2", "B.4", 2): ("absent", "o")}
    assert got == want | {("t3", "B.1", 5): ("ok", None), ("t3", None, 5): ("inconnu", None), (None, "B.4", 2): ("absent", "o")}


def test_units_are_replayed_together(spark):
    rng, xs = np.random.default_rng(3), simulate.grid()
    for n in (1, 2, 3, 6):
        amounts = np.round(rng.uniform(1, 90, (40, n)) * np.where(rng.random((40, n)) < 0.3, rng.uniform(0.02, 15, (40, n)), 1))
        own = np.round(rng.uniform(1, 90, 40))
        amounts[::5] = own[::5, None] * rng.choice(xs, (8, n))  # ties with our bid
        judged, wins = simulate.replay_units(amounts, own, xs)
        for k in range(40):
            j, w = simulate.replay_on_grid(amounts[k], own[k], xs)
            assert (j == judged[k]).all() and (w == wins[k]).all()


def test_curve_of_mixed_units(spark, monkeypatch):
    monkeypatch.setattr(simulate, "GRID_CELLS", 1 << 13)
    rng, xs = np.random.default_rng(5), simulate.grid()
    units = {k: (rng.choice(["a", "b", None]), float(rng.integers(20, 40)), rng.integers(10, 60, rng.integers(1, 5)).astype(float)) for k in range(50)}
    units[50] = ("a", 30.0, np.array([30.0, np.nan]))
    bids = spark.createDataFrame([(k, float(a)) for k, (_, _, v) in units.items() for a in v], "unit long, amount double")
    told = spark.createDataFrame([(k, p, e) for k, (p, e, _) in units.items()], "unit long, priority string, estimation double")
    want: dict = {}
    for p, e, v in units.values():
        j, w = simulate.replay_on_grid(v, e, xs)
        s = want.setdefault(p, [0, 0])
        want[p] = [s[0] + w.astype(int), s[1] + j]
    got = {(r.priority, r.j): r.chance for r in simulate.fixed_rate_curve(bids, told, ["unit"], "priority").collect()}
    assert got == {(p, j): w[j] / n[j] for p, (w, n) in want.items() for j in range(len(xs)) if n[j]}


def test_curve_is_made_once(spark):
    from adjudica.plans import tender_queries

    assert "MapInPandas" not in plan_of(tender_queries.decision_reasons(spark, "/root/testdata/sf0.001"))


def test_sheet_makes_each_pair_once(spark):
    offers = {1: {1: 10.0, 2: 12.0, 3: 9.0}, 2: {1: 20.0, 2: 30.0}, 3: {2: 8.0, 3: 4.0}, 4: {1: 5.0}, 5: {1: 40.0, 2: 44.0}}
    won = {1: 1, 2: 2, 3: 3, 5: 1}
    o = spark.createDataFrame([(u, c, a) for u, m in offers.items() for c, a in m.items()], "unit long, company long, amount double")
    w = spark.createDataFrame(list(won.items()), "unit long, company long")
    pairs = spark.createDataFrame([(1, 2, "fort"), (2, 3, None)], "a long, b long, level string")
    sheet = sheets.company_sheet(o, w, pairs)
    assert "REPARTITION_BY_NUM" in plan_of(sheet) and plan_of(sheet).count("Generate inline") == 1
    got = {(r.x, r.y): r for r in sheet.collect()}
    assert got.keys() == {(1, 2), (2, 1), (1, 3), (3, 1), (2, 3), (3, 2)}
    for (x, y), r in got.items():
        both = [u for u, m in offers.items() if x in m and y in m]
        gaps = lambda p, q: [offers[u][q] / offers[u][p] - 1 for u in both if won.get(u) == p]
        middle = lambda v: pytest.approx(float(np.median(v))) if v else None
        assert (r.together, r.x_wins, r.y_wins) == (len(both), len(gaps(x, y)), len(gaps(y, x)))
        assert (r.when_x_wins, r.when_y_wins) == (middle(gaps(x, y)), middle(gaps(y, x)))
        n = lambda c: sum(c in m for m in offers.values())
        assert (r.share_x, r.share_y, r.level) == (len(both) / n(x), len(both) / n(y), "fort" if {x, y} == {1, 2} else None)


def test_ranks_beside_all_bids(spark):
    rng = np.random.default_rng(8)
    rows = [(u, k, None if rng.random() < 0.1 else float(rng.integers(5, 60)), [True, False, None][rng.choice(3, p=[0.4, 0.4, 0.2])]) for u in range(60) for k in range(1, rng.integers(2, 7))]
    bids = spark.createDataFrame(rows, "unit long, seq long, amount double, admitted boolean")
    tenders = spark.createDataFrame([(u, None if u % 9 == 0 else float(rng.integers(5, 60))) for u in range(55)], "unit long, estimation double")
    own = commission.candidate_bids(bids, ["unit"])
    want = {(r.unit, r.seq): (r["rank"], r.reference) for r in commission.commission_rank(own, commission.reference_prices(own, tenders, ["unit"], None), ["unit"]).collect()}
    told = commission.ranked_bids(bids, tenders, ["unit"], None)
    got = {(r.unit, r.seq): (r["rank"], r.reference) for r in told.collect()}
    assert got.keys() == {(u, k) for u, k, _, _ in rows} and {k: v for k, v in got.items() if v[0] is not None} == want and len(want) > 60


def test_group_sheets_cut_their_lists_before_groups_meet(spark):
    o = spark.createDataFrame([(u, c, float(10 * c + u), c if c < 4 else None) for u in range(40) for c in (1, 2, 3, 4) if (u + c) % 3], "unit long, company long, amount double, rank long")
    w = o.where("rank IS NOT NULL").groupBy("unit").agg(F.min("rank").alias("company"))
    members = spark.createDataFrame([("g", 2), ("g", 3), ("h", 1), ("h", 4), ("i", 9)], "group string, company long")
    days = o.select("unit", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("unit") % 5).cast("int")).alias("day")).distinct()
    outcomes = sheets.group_outcomes(o, w, members, spark.createDataFrame([], "unit long, reference double"))
    pairs = spark.createDataFrame([(2, 3, 7, "fort"), (1, 2, 3, None)], "a long, b long, together long, level string")
    made = sheets.group_sheets(members, o, outcomes, pairs, days, 3)
    assert plan_of(made).count("WindowGroupLimit") >= 4
    rows, days_ = [tuple(r) for r in outcomes.select("group", "unit", "won").collect()], dict(tuple(r) for r in days.collect())
    sheet = {r.group: r for r in made.collect()}
    assert sheet.keys() == {"g", "h"} and [tuple(p) for p in sheet["g"].pairs] == [(2, 3, 7, "fort")] and sheet["h"].pairs == []
    for g, r in sheet.items():
        lost = sorted((u for k, u, won in rows if k == g and not won), key=lambda u: (days_[u], u), reverse=True)
        assert (r.won, r.lost) == (sum(won for k, _, won in rows if k == g), len(lost)) and [(x.place, x.unit) for x in r.losses] == list(enumerate(lost[:3], 1))
        assert r.common == sum(1 for u in range(40) if sum((u + c) % 3 > 0 for c in ((2, 3) if g == "g" else (1, 4))) > 1) and len(r.latest) == min(3, r.common)


def test_lines_of_open_tenders_are_dealt_by_their_number(spark, monkeypatch):
    from adjudica.plans import adapter, tender_queries

    monkeypatch.setattr(adapter, "TASK_ROWS", 500)
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    open_ = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").where("o_orderstatus = 'P'")
    told = tender_queries._parts_of_open_tenders(spark, "/root/testdata/sf0.001")
    assert "REPARTITION_BY_NUM" in plan_of(told) and f", {-(-lines.count() // 500)})" in plan_of(told)
    want = lines.join(open_, lines.l_orderkey == open_.o_orderkey).select("l_orderkey", "l_partkey")
    assert sorted(map(tuple, told.select("unit", "part").collect())) == sorted(map(tuple, want.collect()))
