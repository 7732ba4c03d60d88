"""Every registered tender query against its DuckDB SQL, over the smallest tables; those without SQL against a plain version."""

import collections
import difflib
import math

import duckdb
import pytest

from adjudica.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def ratio(a, b):
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def plain_alike(got, duck):
    names = duck.execute("SELECT min(p_partkey), p_name FROM part GROUP BY 2 ORDER BY 1").fetchall()
    met = set(duck.execute("WITH i AS (SELECT p_name, min(p_partkey) AS id FROM part GROUP BY 1), s AS (SELECT DISTINCT l_orderkey AS u, id FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'P' JOIN part ON p_partkey = l_partkey JOIN i USING (p_name)) SELECT DISTINCT a.id, b.id FROM s a JOIN s b ON a.u = b.u AND a.id < b.id").fetchall())
    want = {(i, j): ratio(a, b) for i, a in names for j, b in names if i < j and ratio(a, b) >= 70 and (i, j) not in met}
    assert {(r["id"], r["id2"]): r["ratio"] for r in got} == pytest.approx(want) and want


def plain_versions(got, duck):
    rows = duck.execute("SELECT CAST(o_orderkey AS VARCHAR), o_orderpriority, CAST(o_custkey AS VARCHAR), p_name, o_totalprice FROM orders JOIN (SELECT l_orderkey AS k, min(l_partkey) AS p FROM lineitem GROUP BY 1) ON k = o_orderkey JOIN part ON p_partkey = p").fetchall()
    groups = {}
    for ref, reference, buyer, title, price in sorted(rows, key=lambda r: (-r[4], r[0])):
        groups.setdefault((reference, buyer), []).append((ref, title))
    want = {}
    for (reference, buyer), held in groups.items():
        same = [r for r, t in held if t == held[0][1] or difflib.SequenceMatcher(None, t.lower(), held[0][1].lower()).ratio() > 0.7]
        for r, _ in held:
            want[r] = (f"{reference}|{buyer}", r == same[0], len(same)) if r in same else (f"{reference}|{buyer}#{r}", True, 1)
    assert {r["ref"]: (r["version_group"], r["main"], r["versions"]) for r in got} == want


def strongest(duck):
    """Pairs and their shared units, of those whose shared units exceed what chance gives, as the two graph queries take them."""
    from adjudica.plans import tender_queries

    sql = registry.oracle_sql()["expected_pairs"]
    expected = {(a, b): e for a, b, e in duck.execute(sql).fetchall()}
    together = {(a, b): n for a, b, n in duck.execute(registry.oracle_sql()["copresence_pairs"]).fetchall()}
    assert tender_queries
    return {p: n for p, n in together.items() if n >= 6 and n >= 1.2 * expected[p]}


def plain_cliques(got, duck):
    """Every member of a family is linked to all of some clique: cores and occasional members are of maximal cliques; all linked companies are in one."""
    near = collections.defaultdict(set)
    for a, b in strongest(duck):
        near[a].add(b)
        near[b].add(a)
    assert set(near) == {c for r in got for c in (*r["core"], *r["occasional"])}
    for r in got:
        core = set(r["core"])
        assert all(core - {c} <= near[c] for c in core) and all(near[c] & core or not core for c in r["occasional"])
        assert len(core) + len(r["occasional"]) <= max(12, len(core))


def plain_communities(got, duck):
    """Nobody wants to move: no other community of its neighbours weighs more than its own."""
    weight, label = strongest(duck), {r["node"]: r["community"] for r in got}
    assert set(label) == {c for p in weight for c in p}
    for node in label:
        pull = collections.Counter()
        for (a, b), w in weight.items():
            if node in (a, b):
                pull[label[b if node == a else a]] += w
        assert pull[label[node]] >= max(pull.values()) or not pull[label[node]] and label[node] == node


def plain_decisions(got, duck):
    """The worst reason decides, one decision an open tender, and the price lies in its zone."""
    n = duck.execute("SELECT count(*) FROM (SELECT DISTINCT o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' AND o_totalprice > 0)").fetchone()[0]
    stop, doubt = {"delai_depasse", "plage_vide", "aucun_gain", "chance_faible", "non_eligible"}, {"delai_court", "chance_moyenne", "gain_moyen", "confiance_acheteur_peu", "confiance_identifies_peu", "groupe_fort", "infructueux"}
    assert len(got) == n == len({r["unit"] for r in got})
    for r in got:
        codes = set(r["codes"].split(","))
        assert r["decision"] == ("NO_GO" if codes & stop else "A_ETUDIER" if codes & doubt else "GO")
        assert r["x"] is None or r["zone_low"] <= r["x"] <= r["zone_high"]


def plain_curve(got, duck):
    """Chances of every class at every rate of the grid."""
    assert len(got) == 5 * 801 and all(0 <= r["chance"] <= 1 for r in got) and max(r["chance"] for r in got) > 0.02


def plain_cosine(got, duck):
    """Tested on its own table in test_rules; here, ranks and scores in order."""
    by = collections.defaultdict(list)
    for r in got:
        by[r["target"]].append((r["rank"], r["score"]))
    for ranked in by.values():
        scores = [s for _, s in sorted(ranked)]
        assert scores == sorted(scores, reverse=True) and len(scores) <= 20 and all(0 < s <= 1 + 1e-9 for s in scores)


def resolved(duck):
    syllables = ["ta", "ri", "mou", "ben", "zem", "la", "khe", "ou"]
    place = lambda k: "".join(syllables[k // 8**i % 8] for i in (3, 2, 1, 0))
    ids = [k for (k,) in duck.execute("SELECT c_custkey FROM customer").fetchall()]
    known = {"communede" + place(k): place(k) for k in ids if k % 3 < 2}
    out = {}
    for k in ids:
        p = place(k)
        core, key = (p[:3] + "x" + p[3:], "communeruralede" + p[:3] + "x" + p[3:]) if k % 10 == 0 else (p, "communede" + p)
        if key in known:
            out[k] = ("direct", key)
            continue
        found = sorted(((-round(ratio(core, c), 1), other) for other, c in known.items() if ratio(core, c) >= 80))
        sure = found and -found[0][0] >= 95 and (len(found) == 1 or found[1][0] - found[0][0] >= 3)
        out[k] = ("correspondance", found[0][1]) if sure else ("aucun", None)
    return out


def plain_resolution(got, duck):
    want = resolved(duck)
    assert {r["id"]: (r["status"], r["key"]) for r in got} == want and len({s for s, _ in want.values()}) >= 2


def plain_coverage(got, duck):
    assert {r["status"]: r["n"] for r in got} == collections.Counter(s for s, _ in resolved(duck).values())


def plain_ladder(got, duck):
    """At each resolution the last level is as good as the sequential rule, within two hundredths, and each level is better than the one before."""
    from tests.test_louvain import plain_louvain, quality

    edges = {p: float(n) for p, n in strongest(duck).items()}
    assert {r["resolution"] for r in got} == ({1.0, 3.0, 8.0} if edges else set())
    for resolution in {r["resolution"] for r in got}:
        levels = sorted((r["level"], r["modularity"]) for r in got if r["resolution"] == resolution)
        plain = quality(edges, plain_louvain(edges, resolution), resolution)
        assert levels[-1][1] >= plain - 0.02 * abs(plain) - 1e-9 and [m for _, m in levels] == sorted(m for _, m in levels)


def plain_fits(got, duck):
    import numpy as np

    from tests.test_laws_and_fits import plain_fit

    rows = duck.execute("SELECT o_orderpriority, l_quantity / 50, l_discount * 10, ln(l_extendedprice), l_returnflag = 'A' FROM lineitem JOIN orders ON o_orderkey = l_orderkey").fetchall()
    assert {r["segment"] for r in got} == {r[0] for r in rows}
    for r in got:
        own = np.array([[float(v) for v in x[1:]] for x in rows if x[0] == r["segment"]])
        assert r["n"] == len(own) and [r["intercept"], r["quantity"], r["discount"], r["price"]] == pytest.approx(plain_fit(own[:, :3], own[:, 3], 1.0).tolist(), abs=1e-6)


def plain_perturbations(got, duck):
    """Names without their small words, and with titles exchanged, are found first; names with two faults mostly among the first five."""
    by = {r["kind"]: r for r in got}
    assert set(by) == {"echange", "sans_mots_outils", "deux_fautes"}
    for r in got:
        assert 0 < r["n"] and r["auto_right"] <= r["auto"] <= r["n"] and r["top1"] <= r["top5"] <= r["n"]
    assert by["sans_mots_outils"]["top1"] >= 0.9 * by["sans_mots_outils"]["n"] and by["deux_fautes"]["top5"] > 0


#: What the queries without SQL are held against.
PLAIN = {
    "alike_names": plain_alike, "version_dedup": plain_versions, "cliques_and_families": plain_cliques, "communities": plain_communities, "decision_reasons": plain_decisions,
    "simulate_curve": plain_curve, "tfidf_ngram_cosine": plain_cosine, "buyer_resolution": plain_resolution, "buyer_resolution_coverage": plain_coverage,
    "community_ladder": plain_ladder, "segment_fits": plain_fits, "buyer_perturbations": plain_perturbations,
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    frame = registry.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=str)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert name in PLAIN, "a query without SQL needs a plain version"
        PLAIN[name]([dict(zip(columns, r)) for r in got], duck)
        return
    result = duck.execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-12)) for x, y in zip(a, b)), (a, b)
