"""Hand-counted cases of the tender rules."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from adjudica.functions import measures, text
from adjudica.operators import asof, bidders, commission, copresence, decide, eligibility, groups, marts, rates, similarity, simulate, tracking
from adjudica.operators.components import connected_components
from adjudica.plans import tender_queries


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


def bids_of(spark, rows):
    return spark.createDataFrame(rows, "unit string, seq long, bidder string, amount double, admitted boolean")


CASES = [
    ("m1", 100.0, [(1, "a", 90.0, True), (2, "b", 100.0, True), (3, "c", 110.0, True)]),
    ("m2", 100.0, [(1, "a", 150.0, True), (2, "b", 160.0, True), (3, "c", 170.0, True)]),
    ("m3", 100.0, [(1, "a", 50.0, False), (2, "b", 100.0, True), (3, "c", 110.0, True)]),
    ("off", 100.0, [(1, "a", 90.0, True), (2, "b", 100.0, True), (3, "c", 9000.0, True)]),
    ("far", 10.0, [(1, "a", 70.0, True), (2, "b", 75.0, True)]),
    ("alone", None, [(1, "a", 70.0, True)]),
    ("none_admitted", 100.0, [(1, "a", 90.0, False), (2, "b", 100.0, False)]),
]


def units(spark):
    bids = bids_of(spark, [(u, s, b, a, ok) for u, _, rows in CASES for s, b, a, ok in rows])
    return commission.candidate_bids(bids, ["unit"]), spark.createDataFrame([(u, e) for u, e, _ in CASES], "unit string, estimation double")


def test_reference_prices(spark):
    bids, tenders = units(spark)
    got = {r.unit: r for r in commission.reference_prices(bids, tenders, ["unit"]).collect()}
    assert (got["m1"].mean, got["m1"].reference, got["m1"].n_bids) == (100, 100, 3)
    assert got["m2"].reference == 130
    assert (got["m3"].mean, got["m3"].n_bids) == (105, 2)
    assert (got["off"].n_used, got["off"].mean) == (2, 95)
    assert got["far"].reference is None and got["far"].estimation_discarded
    assert got["alone"].reference is None and not got["alone"].estimation_discarded
    assert got["none_admitted"].n_bids == 2


def test_commission_rank_and_ties(spark):
    bids, tenders = units(spark)
    ranked = commission.commission_rank(bids, commission.reference_prices(bids, tenders, ["unit"]), ["unit"])
    order = {u: [r.bidder for r in sorted(ranked.where(F.col("unit") == u).collect(), key=lambda r: r.rank)] for u in ("m1", "m2", "m3")}
    assert order == {"m1": ["b", "a", "c"], "m2": ["a", "b", "c"], "m3": ["b", "c"]}
    replay = {(r.unit, r.rate): r["rank"] for r in commission.replay_with_bid(bids, tenders, ["unit"], [0.95, 1.0]).collect()}
    assert replay[("m1", 0.95)] == 1  # the reference falls below 100
    assert replay[("m1", 1.0)] == 2  # a tie: the earlier bid keeps its rank


def test_units_of_tenders_and_lots(spark):
    from adjudica import schema

    tenders = spark.createDataFrame([("t1", "A", "20260105", False, 100.0, None, None, 0, True, False, "x", None, None), ("t2", "A", "20260105", False, None, None, None, 2, True, False, "y", None, None), ("t3", "A", "20260105", False, 1.0, None, None, 0, False, False, "z", None, None)], schema.TENDERS)
    lots = spark.createDataFrame([("t2", "1", 10.0, None, None, None, None, None), ("t2", "2", 20.0, None, None, "lot two", None, None)], schema.LOTS)
    bids = spark.createDataFrame([(1, "t1", "a", "a", None, 90.0, "admis", None), (2, "t2", "b", "b", 9.0, None, "admis", "1,2"), (3, "t2", "c", "c", 6e9, 19.0, "depose", "2"), (4, "t3", "d", "d", 1.0, 1.0, "admis", None)], schema.BIDS)
    us, bs = commission.load_units(tenders, lots, bids)
    assert {(r.unit, r.estimation) for r in us.collect()} == {("t1", 100.0), ("t2#1", 10.0), ("t2#2", 20.0)}
    assert {(r.unit, r.bidder, r.amount, r.admitted) for r in bs.collect()} == {("t1", "a", 90.0, True), ("t2#1", "b", 9.0, True), ("t2#2", "b", 9.0, True), ("t2#2", "c", 19.0, False)}


@pytest.mark.parametrize("value,want", [("Travaux d'aménagement de l'École", "travaux d amenagement de l ecole"), ("  ", ""), (None, "")])
def test_flat(spark, value, want):
    assert one(spark, text.flat(F.col("x")), value) == want


def test_keys(spark):
    assert one(spark, text.company_key(F.col("x")), "Sté Éclair SARL") == "eclair"
    assert one(spark, text.company_key(F.col("x")), "SARL") == "sarl"
    assert one(spark, text.flat_key(F.col("x")), "École 2") == "cole2"
    assert one(spark, text.buyer_key(F.col("x")), "C/ABC - PROVINCE D'ESSAI") == "provincedessai"
    assert one(spark, text.buyer_type(F.col("x")), "COMMUNE DE TAZA") == "commune"
    assert one(spark, text.buyer_core(F.col("x")), "DIRECTEUR PROVINCIAL DE L'EQUIPEMENT TAZA") == "equipement taza"
    assert one(spark, text.buyer_variant(F.col("x")), "Commune rurale X") == "rurale"


@pytest.mark.parametrize("value,want", [("1 234 567,89 DH", 1234567.89), ("1.234.567,89", 1234567.89), ("12.5", 12.5), ("", None), ("abc", None)])
def test_amounts(spark, value, want):
    assert one(spark, text.parse_amount(F.col("x")), value) == want


@pytest.mark.parametrize("value,want", [("2026-11-05", "2026-11-05 23:59:59"), ("05/11/2026 10:30", "2026-11-05 10:30:00"), ("2026-11-05T10:30:15Z", "2026-11-05 10:30:15"), ("31/09/2026", None), ("", None)])
def test_closing(spark, value, want):
    assert one(spark, F.date_format(text.parse_closing(F.col("x")), "yyyy-MM-dd HH:mm:ss"), value) == want


def test_sort_day(spark):
    rows = spark.createDataFrame([("05/01/2026", "04/01/2026"), ("10/01/2026", "04/01/2026"), ("31/09/2026", "04/01/2026"), (None, "04/01/2026"), (None, None)], "o string, p string")
    day, doubtful = text.sort_day(F.col("o"), F.col("p"))
    assert [tuple(r) for r in rows.select(day, doubtful).collect()] == [("20260105", False), ("20260104", True), ("20260104", True), ("20260104", False), (None, False)]


def test_qualifications(spark):
    got = [one(spark, text.qualification_code(F.col("x")), v) for v in ("B.1- Travaux", "b1", "B", "4.1 x")]
    assert got == ["B.1", "B.1", "B", None]
    assert one(spark, text.requirement_codes(F.col("x")), "B.1 ou B-3") == ["B.1", "B.3"]
    assert [one(spark, text.class_rank(F.col("x")), v) for v in ("S", "Classe 3", "7", None)] == [0, 3, None, None]
    assert one(spark, text.class_proximity(F.lit(3), F.lit(5))) == 0.3


def test_classifiers(spark):
    families = [("water", ["eau potable", "assain*"]), ("road", ["route", "piste"])]
    assert [one(spark, text.classify(F.col("x"), families, "other"), v) for v in ("Réseau d'assainissement", "pistes rurales", "eau", "Routes et eau potable")] == ["water", "road", "other", "water"]
    assert one(spark, text.earliest(F.col("x"), families), "Routes et eau potable") == "road"
    regions = {"R1": ["SALE"], "R2": ["SIDI SLIMANE", "SIDI"]}
    assert one(spark, text.region_of(F.col("x"), regions), "commune de Sidi Slimane, Salé") == "R2"


def test_similar_names(spark):
    assert one(spark, text.same_company(F.col("x"), F.lit("OLEA INGENERIE")), "OLEA INGENIERIE")
    assert not one(spark, text.same_company(F.col("x"), F.lit("SETARYA INGENIERIE")), "OLEA INGENIERIE")
    assert one(spark, text.indel_ratio(F.col("x"), F.lit("abd")), "abc") == pytest.approx(200 * 2 / 6)


def test_gap_and_brackets(spark):
    assert one(spark, measures.gap_percent(F.lit(110.0), F.lit(100.0))) == 10
    assert one(spark, measures.gap_percent(F.lit(900.0), F.lit(100.0))) is None
    assert [one(spark, measures.offers_bracket(F.lit(n))) for n in (2, 4, 7, 8)] == ["1-2", "3-4", "5-7", "8+"]
    assert one(spark, measures.interpolate(F.lit(0.25), [(0.0, 0.0), (0.5, 1.0), (1.0, 2.0)])) == 0.5


@pytest.mark.parametrize("mean,count", [(1.5, 2), (0.3, 6), (4.0, 0), (2.0, 1)])
def test_poisson_tail(spark, mean, count):
    want = 1 - sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(count))
    assert one(spark, measures.poisson_tail(F.lit(mean), F.lit(count))) == pytest.approx(want, abs=1e-12)


def test_pairs_and_levels(spark):
    rows = [("u1", "a", "K1"), ("u1", "b", "K1"), ("u2", "a", "K1"), ("u3", "a", "K2"), ("u3", "b", "K2")]
    p = spark.createDataFrame(rows, "unit string, company string, buyer string")
    r = copresence.pairs(p).first()
    assert (r.together, r.expected) == (2, 2 * 1 / 2 + 1 * 1 / 1)
    assert r.tail == pytest.approx(1 - math.exp(-2) * 3)
    levels = spark.createDataFrame([(6, 5.0, 1e-5, 0.1), (6, 4.9, 1e-5, 0.1), (4, 3.0, 1e-5, 0.1), (3, 2.0, 1e-5, 0.1), (3, 1.9, 1e-5, 0.1), (20, 1.0, 1e-5, 0.1), (20, 1.0, 1e-5, 0.5)], "t int, e double, p double, s double")
    got = [r.level for r in levels.select(copresence.level(F.col("t"), F.col("e"), F.col("p"), F.col("s"), F.col("s")).alias("level")).collect()]
    assert got == ["fort", "moyen", "moyen", "faible", None, None, "moyen"]


def test_around(spark):
    met = [(f"u{k}", c) for k in range(5) for c in (("x", "y") if k < 4 else ("x", "z"))] + [(f"v{k}", "y") for k in range(4)]
    p = spark.createDataFrame([(u, c, "K") for u, c in met], "unit string, company string, buyer string")
    wins = spark.createDataFrame([("u0", "x"), ("u1", "x"), ("u2", "y"), ("v0", "y"), ("v1", "y")], "unit string, company string")
    r = copresence.around(p, wins).where("x = 'x' AND y = 'y'").first()
    assert (r.a, r.b, r.c, r.ratio, r.part, r.reading) == (1.0, 0.8, 0.5, 1.25, pytest.approx(1 / 3), "neutre")


def test_cliques_and_families(spark):
    edges = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("e", "f")]
    frame = spark.createDataFrame(edges, "a string, b string")
    found = groups.maximal_cliques(frame)
    assert sorted(tuple(r.members) for r in found.collect()) == [("a", "b", "c"), ("c", "d"), ("e", "f")]
    fam = {tuple(r.core): tuple(r.occasional) for r in groups.families(found).collect()}
    assert fam == {("c",): ("a", "b", "d"), ("e", "f"): ()}


def test_random_cliques_are_maximal(spark):
    rng = random.Random(3)
    nodes = list(range(12))
    edges = [(a, b) for a, b in itertools.combinations(nodes, 2) if rng.random() < 0.4]
    near = {n: {b if a == n else a for a, b in edges if n in (a, b)} for n in nodes}
    want = set()
    for size in range(2, 13):
        for c in itertools.combinations(nodes, size):
            if all(b in near[a] for a, b in itertools.combinations(c, 2)) and not any(set(c) <= near[n] for n in nodes if n not in c):
                want.add(c)
    got = {tuple(r.members) for r in groups.maximal_cliques(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == want


def test_cliques_of_a_large_component(spark):
    n = 200_500  # links in one component: a star whose first leaves make a ring of triangles
    star = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    ring = spark.range(1, 1001).select(F.col("id").alias("a"), (F.col("id") % 1000 + 1).alias("b"))
    found = groups.maximal_cliques(star.unionByName(ring)).groupBy(F.size("members").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("clique").alias("ids"), F.max("clique").alias("last")).collect()
    assert {r["size"]: (r.n, r.ids) for r in found} == {3: (1000, 1000), 2: (n - 1000, n - 1000)}
    assert max(r["last"] for r in found) == n - 1


def test_communities_settle(spark):
    chain = [(k, k + 1, 100 - k) for k in range(8)]
    two = [(a, b, 3) for s in (100, 200) for a, b in itertools.combinations(range(s, s + 4), 2)] + [(100, 200, 1), (300, 301, 1)]
    pair = [(400 + a, 410 + b, 1) for a in range(3) for b in range(3)]  # two sides: moving all at once would never end
    edges = chain + two + pair
    got = {r.node: r.community for r in groups.communities(spark.createDataFrame(edges, "a long, b long, weight long")).collect()}
    near = {}
    for a, b, w in edges:
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = w
    assert set(got) == set(near)
    for node, others in near.items():
        pull = {}
        for other, w in others.items():
            pull[got[other]] = pull.get(got[other], 0) + w
        assert pull.get(got[node], 0) == max(pull.values())
    assert len({got[k] for k in range(100, 104)}) == 1 and got[100] != got[200] and got[300] == got[301]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert {got[k] for k in range(61)} == {0} and got[101] == 100


def test_count_law_is_an_enumeration(spark):
    ps = [0.1, 0.5, 0.7, 0.2]
    want = [0.0] * 5
    for outcome in itertools.product((0, 1), repeat=4):
        want[sum(outcome)] += math.prod(p if o else 1 - p for p, o in zip(ps, outcome))
    frame = spark.createDataFrame([(ps,)], "p array<double>").withColumn("law", bidders.count_law(F.col("p")))
    assert frame.first().law == pytest.approx(want)
    r = frame.select(bidders.interval(F.col("law")).alias("i")).first().i
    reached = [sum(want[: k + 1]) for k in range(5)]
    assert (r.low, r.high) == (next(k for k, v in enumerate(reached) if v >= 0.1), next(k for k, v in enumerate(reached) if v >= 0.9))
    mixed = spark.createDataFrame([(ps, 0.0, 0.0, 0.0), (ps, 0.5, 0.0, 0.0), (ps, 0.5, 0.8, 0.0)], "p array<double>, lam double, s double, u double").select(bidders.mixed_count_law("p", "lam", "s", "u").alias("law")).collect()
    assert mixed[0].law == pytest.approx(want)
    assert sum(k * v for k, v in enumerate(mixed[1].law)) == pytest.approx(sum(ps) + 0.5, abs=1e-6)
    assert sum(mixed[2].law) == pytest.approx(1, abs=1e-6)


def test_no_leak_of_later_rows(spark):
    rows = [("u1", "a", "K", "f", 10), ("u2", "a", "K", "f", 20), ("u3", "a", "K", "f", 20), ("u4", "a", "K", "f", 400)]
    schema = "unit string, company string, buyer string, family string, day long"
    then = {r.unit: r for r in bidders.presence_features(spark.createDataFrame(rows[:3], schema)).collect()}
    now = {r.unit: r for r in bidders.presence_features(spark.createDataFrame(rows, schema)).collect()}
    assert all(then[u] == now[u] for u in then)
    assert now["u3"].active_365 == 1 and now["u4"].regular and now["u4"].idle_days == 380


def test_cuts_agree(spark):
    rows = spark.createDataFrame([("2025-12-31", False), ("2026-01-01", False), (None, False), ("2025-01-01", True)], "d string, q boolean").withColumn("d", F.to_date("d"))
    a = asof.cut(rows, "d", "2025-12-31", True, "q").collect()
    assert a == asof.cut(rows, "d", "2026-01-01", False, "q").collect() and len(a) == 1


def test_fast_rule_is_the_official_rule(spark):
    rng = np.random.RandomState(5)
    sets = {f"u{k}": np.round(rng.uniform(0.7, 1.15, rng.randint(1, 9)), 3) for k in range(60)}
    xs = [0.8, 0.85, 0.9, 0.95, 1.0, 1.05]
    offers = spark.createDataFrame([(u, k, float(v)) for u, vs in sets.items() for k, v in enumerate(vs)], "unit string, seq long, amount double")
    slow = {(r.unit, r.rate): r.wins for r in simulate.winning_rates(offers, xs).collect()}
    for u, vs in sets.items():
        for x, w in zip(xs, simulate.count_wins([vs.tolist()], np.array(xs))):
            assert slow[(u, x)] == bool(w), (u, x, vs)
    assert simulate.count_wins([[0.95], []], np.array([0.95, 0.96])).tolist() == [1, 2]


def test_curve_of_fixed_rates_is_the_replay(spark):
    rng = np.random.RandomState(7)
    sets = {f"u{k}": (float(rng.randint(50, 150)), [float(v) for v in rng.randint(40, 160, rng.randint(1, 8))]) for k in range(30)}
    sets |= {"far": (100.0, [3.0, 2000.0, 95.0]), "odd": (10.0, [900.0, 950.0, 1000.0]), "even": (100.0, [100.0, 100.0]), "one": (100.0, [90.0])}
    rows = spark.createDataFrame([(u, k, v) for u, (_, vs) in sets.items() for k, v in enumerate(vs)], "unit string, seq long, amount double")
    own = spark.createDataFrame([(u, e, "ab"[len(u) % 2]) for u, (e, _) in sets.items()] + [("none", None, "a")], "unit string, estimation double, priority string")
    curve = {(r.priority, r.j): (r.x, r.chance) for r in simulate.fixed_rate_curve(rows, own, ["unit"], "priority").collect()}
    assert len(curve) == 2 * 801
    at = list(range(0, 801, 40))
    xs = simulate.grid()
    slow = commission.replay_with_bid(rows, own, ["unit"], [float(xs[j]) for j in at], None).join(own.select("unit", "priority"), "unit").collect()
    for key in "ab":
        for j in at:
            found = [r["rank"] == 1 for r in slow if r.priority == key and r.rate == xs[j]]
            assert curve[(key, j)] == (xs[j], pytest.approx(sum(found) / len(found), abs=1e-15))


def test_decisions_use_the_whole_grid_and_the_tables(spark):
    d = "/root/testdata/sf0.001"
    rows = tender_queries.decision_reasons(spark, d).collect()
    assert len({r.priority for r in rows}) == 5 and len(rows) > 5
    assert any(abs(r.x * 50 - round(r.x * 50)) > 1e-6 for r in rows)  # not on a grid of 0.02
    assert len({r.codes for r in rows}) > 1 and any("delai_depasse" in r.codes for r in rows) and any("delai_depasse" not in r.codes for r in rows)


def test_simulation_is_seeded(spark):
    c = spark.createDataFrame([("t", 0.9, 0.95, 0.05), ("t", 0.5, 1.0, 0.05)], "unit string, p double, mu double, sigma double")
    a, b = ([(r.j, r.chance) for r in simulate.chance_curve(c, 300).orderBy("j").collect()] for _ in range(2))
    assert a == b and len(a) == 801 and 0 < max(v for _, v in a) <= 1
    assert simulate.uniforms(np.array([1]), np.array([1]))[0] == pytest.approx(0.6270739405881613)


def _curve(spark, m, s, top):
    xs = simulate.grid()
    return spark.createDataFrame([("t", j, float(x), float(top / (1 + math.exp((x - m) / s)))) for j, x in enumerate(xs)], "unit string, j int, x double, chance double")


@pytest.mark.parametrize("m,s,top,cost,want", [(0.98, 0.04, 0.7, 0.85, "GO"), (0.84, 0.02, 0.04, 0.95, "NO_GO"), (1.0, 0.05, 0.55, 1.3, "NO_GO"), (1.02, 0.05, 0.09, 0.85, "A_ETUDIER")])
def test_decision(spark, m, s, top, cost, want):
    costs = spark.createDataFrame([("t", cost, 0.05)], "unit string, cost double, margin double")
    rows = decide.evaluate(_curve(spark, m, s, top), costs, ["unit"])
    signals = {k: F.lit(None).cast("double") for k in ("days", "buyer_n", "identified", "group_p", "unsuccessful_rate", "in_progress", "plan_max")} | {"eligibility": F.lit(None).cast("string")}
    r = decide.decide(rows.withColumns(signals)).first()
    assert r.decision == want
    late = decide.decide(rows.withColumns(signals | {"days": F.lit(-1.0)})).first()
    assert late.decision == "NO_GO" and late.reasons[0].code == "delai_depasse"


def test_eligibility(spark):
    need = eligibility.requirements(spark.createDataFrame([("t1", "B.1- Travaux", "3"), ("t2", "B.1 ou B.3", "3"), ("t3", "A.2", "1"), ("t4", "texte", "2")], "tender string, label string, class string"))
    ours = spark.createDataFrame([("B.1", "2")], "code string, class string")
    partners = spark.createDataFrame([("P", "A.2", "S")], "name string, code string, class string")
    got = {r.tender: r.eligibility for r in eligibility.verdict(eligibility.check(need, ours)).collect()}
    assert got == {"t1": "eligible", "t2": "a_etudier", "t3": "non_eligible", "t4": "a_etudier"}
    with_partner = {r.tender: r.eligibility for r in eligibility.verdict(eligibility.check(need, ours, partners)).collect()}
    assert with_partner["t3"] == "eligible"


def test_tfidf_against_brute_force(spark):
    docs = {1: "pose de bordures", 2: "pose bordure", 3: "eau potable", 4: "eau potable rurale"}
    frame = spark.createDataFrame(list(docs.items()), "id int, title string")
    weights = similarity.tfidf(similarity.term_counts(frame, "id", similarity.title_grams("title")), "id")
    got = {(r.target, r.base): r.cosine for r in similarity.cosine(weights, weights, "id", "id").collect()}
    terms = {}
    for k, t in docs.items():
        terms[k] = {}
        for w in t.split():
            p = f" {w} "
            for n in (3, 4):
                for i in range(max(len(p) - n + 1, 1)):
                    terms[k][p[i : i + n]] = terms[k].get(p[i : i + n], 0) + 1
    df = {}
    for t in terms.values():
        for g in t:
            df[g] = df.get(g, 0) + 1
    vec = {k: {g: (1 + math.log(n)) * (math.log(5 / (1 + df[g])) + 1) for g, n in t.items() if df[g] >= 2} for k, t in terms.items()}
    for a, b in itertools.product(docs, docs):
        dot = sum(v * vec[b].get(g, 0) for g, v in vec[a].items())
        want = dot / math.sqrt(sum(v * v for v in vec[a].values()) * sum(v * v for v in vec[b].values()))
        assert got.get((a, b), 0) == pytest.approx(want)


def test_versions(spark):
    rows = spark.createDataFrame([("r1", "12/2025", "K", "Travaux de route", 1), ("r2", "12/2025", "K", "Travaux de la route", 3), ("r3", "12/2025", "K", "Achat de mobilier scolaire", 2), ("r4", None, "K", "x", 1)], "ref string, reference string, buyer string, title string, rich int")
    got = {r.ref: (r.main, r.versions) for r in similarity.version_groups(rows, [F.col("rich")]).collect()}
    assert got == {"r1": (False, 2), "r2": (True, 2), "r3": (True, 1), "r4": (True, 1)}


def test_buyer_medians(spark):
    units = spark.createDataFrame([("u1", "r1", "B", 100.0, 96.0), ("u2", "r2", "B", 100.0, 94.0), ("u3", "r3", "B", 100.0, 108.0), ("u4", "r4", "B", 100.0, 90.0)], "unit string, ref string, buyer string, estimation double, best double")
    bids = spark.createDataFrame([(f"u{k}",) for k in (1, 2, 3, 4) for _ in range(k + 1)], "unit string")
    r = marts.buyer_medians(units, bids).first()
    assert (r.tenders, r.median_gap, r.share_below, r.median_bidders) == (4, 5.0, 75.0, 3.5)


def test_labels(spark):
    rows = spark.createDataFrame([("p", "oui", 1, 1), ("p", "nsp", 2, 2), ("q", "non", 1, 3), ("q", "oui", 2, 4)], "k string, answer string, created int, id int")
    assert {r.k: r.answer for r in marts.last_decisive(rows, ["k"]).collect()} == {"p": "oui", "q": "oui"}
    assert {r.k: r.status for r in marts.label_status(rows, ["k"]).collect()} == {"p": "confirme", "q": "conteste"}


def test_rates(spark):
    rows = spark.createDataFrame([("a", 0.9, 1.0), ("a", 1.0, 3.0)], "c string, rate double, w double")
    r = rates.weighted_moments(rows, ["c"], "rate", "w").first()
    assert (r.n_eff, r.mean) == (pytest.approx(1.6), pytest.approx(0.975))
    s = rates.shrink(rates.weighted_moments(rows, ["c"], "rate", "w"), F.lit(0.95), F.lit(0.01)).first()
    assert s.mu == pytest.approx((1.6 * 0.975 + 3 * 0.95) / 4.6)


def test_tracking(spark):
    old = spark.createDataFrame([("r", 1)], "ref string, day int")
    assert tracking.freeze(old, spark.createDataFrame([("r", 1), ("r", 2), ("r", 2)], "ref string, day int"), ["ref", "day"]).count() == 1
    rows = spark.createDataFrame([(k, float(k % 5)) for k in range(200)], "u int, v double")
    r = tracking.bootstrap(rows, "u", "v").first()
    assert r.low < 2.0 < r.high and r.high - r.low < 1


def test_models(spark):
    rng = random.Random(1)
    rows = [(x := rng.uniform(-2, 2), 1 if rng.random() < 1 / (1 + math.exp(-(0.5 + 2 * x))) else 0) for _ in range(3000)]
    frame = spark.createDataFrame(rows, "x double, y int")
    b0, b = bidders.fit_logistic(frame, ["x"], "y")
    assert abs(b["x"] - 2) < 0.3 and abs(b0 - 0.5) < 0.3
    knots = bidders.fit_isotonic(frame.withColumn("p", (F.col("x") + 2) / 4), "p", "y")
    assert all(u[1] <= v[1] for u, v in zip(knots, knots[1:]))
