"""Pairs of companies: made behind the shuffle, in tasks of bounded size, with the same numbers by every way."""

import collections
import random

import pytest

from adjudica.operators import copresence


def made(spark, seed=4, units=120, companies=25):
    rng = random.Random(seed)
    rows = [(u, c, rng.choice("PQRS")) for u in range(units) for c in rng.sample(range(companies), rng.randint(1, 6))]
    buyer = {u: b for u, _, b in rows}
    rows = [(u, c, buyer[u]) for u, c, _ in rows]
    return rows, spark.createDataFrame([*rows, (None, 1, "P"), (None, 2, "P")], "unit long, company long, buyer string")


def plain(rows):
    units, at, of = collections.defaultdict(set), collections.Counter(), collections.defaultdict(set)
    for u, c, b in rows:
        units[u].add(c)
        at[b, c] += 1
        of[b].add(u)
    together = collections.Counter((a, b) for m in units.values() for a in m for b in m if a < b)
    return {(a, b): (n, sum(at[q, a] * at[q, b] / len(of[q]) for q in of)) for (a, b), n in together.items()}


@pytest.mark.parametrize("listed", [1 << 8, 24, 0])
def test_numbers_by_every_way(spark, monkeypatch, listed):
    monkeypatch.setattr(copresence, "LISTED", listed)
    rows, frame = made(spark)
    want = plain(rows)
    got = {(r.a, r.b): (r.together, r.expected) for r in copresence.met_and_expected(frame.where("unit IS NOT NULL")).collect()}
    assert got.keys() == want.keys() and len(got) > 200
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)
    few = {(r.a, r.b) for r in copresence.met_and_expected(frame.where("unit IS NOT NULL"), 3).collect()}
    assert few == {k for k, (n, _) in want.items() if n >= 3}
    assert {(r.a, r.b): r.together for r in copresence.shared_units(frame).collect()} == {k: n for k, (n, _) in want.items()}


def test_pairs_are_not_shuffled_and_tasks_grow_with_them(spark, monkeypatch):
    monkeypatch.setattr(copresence, "TASK_PAIRS", 50)
    rows, frame = made(spark)
    frame = frame.where("unit IS NOT NULL")
    least = sum(n for n, _ in plain(rows).values()) // 50
    wins = frame.groupBy("unit").agg({"company": "min"}).withColumnRenamed("min(company)", "company")
    for df in (copresence.shared_units(frame), copresence.met_and_expected(frame)):
        assert df.rdd.getNumPartitions() >= least
    for df in (copresence.shared_units(frame), copresence.met_and_expected(frame), copresence.around(frame, wins)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and not any("hashpartitioning(a#" in line and ", b#" in line for line in plan.splitlines() if "Exchange" in line)


def test_around_some_companies(spark):
    rows, frame = made(spark)
    rng = random.Random(9)
    members = collections.defaultdict(list)
    for u, c, _ in rows:
        members[u].append(c)
    won = {u: rng.choice(m) for u, m in members.items() if u % 3}
    wins = spark.createDataFrame(list(won.items()), "unit long, company long")
    want = collections.Counter()
    for u, m in members.items():
        for x in m:
            for y in m:
                if x != y:
                    want[x, y, "n"] += 1
                    want[x, y, "x"] += won.get(u) == x
                    want[x, y, "y"] += won.get(u) == y
    some = spark.createDataFrame([(3,), (7,)], "company long")
    for companies, asked in ((None, set(range(25))), (some, {3, 7})):
        got = {(r.x, r.y): (r.together, r.x_wins_with, r.y_wins_with) for r in copresence.around(frame, wins, companies).collect()}
        assert got == {(x, y): (want[x, y, "n"], want[x, y, "x"], want[x, y, "y"]) for x, y, k in want if k == "n" and x in asked}


@pytest.mark.parametrize("listed", [1 << 8, 3, 0])
def test_only_companies_of_a_pair_meet_at_buyers(spark, monkeypatch, listed):
    monkeypatch.setattr(copresence, "LISTED", listed)
    kept, stored = {}, copresence.stored
    monkeypatch.setattr(copresence, "stored", lambda df, label: kept.setdefault(label, stored(df, label)))
    rows, frame = made(spark, units=170, companies=60)
    want = {k: v for k, v in plain(rows).items() if v[0] >= 4}
    got = {(r.a, r.b): (r.together, r.expected) for r in copresence.met_and_expected(frame.where("unit IS NOT NULL"), 4).collect()}
    assert got.keys() == want.keys() and got
    assert all(got[k] == (want[k][0], pytest.approx(want[k][1])) for k in want)
    companies = {r.company for r in kept["met-buyer-companies"].collect()}
    assert companies == {c for k in want for c in k} and len(companies) < 60


def test_what_surrounds_a_company_is_joined_before_the_pairs(spark):
    rows, frame = made(spark)
    wins = frame.groupBy("unit").agg({"company": "min"}).withColumnRenamed("min(company)", "company")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where companies are too many to be sent to all
    try:
        found = copresence.around(frame.where("unit IS NOT NULL"), wins.where("unit IS NOT NULL"))
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
        got = found.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    units, won = collections.Counter(c for _, c, _ in rows), collections.Counter(r.company for r in wins.where("unit IS NOT NULL").collect())
    assert len(got) > 200
    for r in got:
        assert (r.x_units, r.y_units, r.x_wins or 0, r.y_wins or 0) == (units[r.x], units[r.y], won[r.x], won[r.y])
