"""Groups of companies: link graph, maximal cliques, families, communities, scores.

Components come of Spark (``connected_components``). Cliques are found at each company among its neighbours, so that a
task holds one neighbourhood, however large the component; communities are rounds of joins. Families pack the cliques of
one component in order, which is done in one task a component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from adjudica.functions.measures import clip
from adjudica.operators.components import connected_components, stored

# Weights of the score's parts.
SCORE_WEIGHTS = {"strength": 20.0, "volume": 15.0, "chance": 30.0, "contexts": 15.0, "off_profile": 5.0, "gains": 0.0}


def link_graph(pairs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) of level fort or moyen, and those that a label says yes to; never those it says no to. ``labels``: a, b, answer."""
    edges = pairs.where(F.col("level").isin("fort", "moyen")).select("a", "b")
    if labels is None:
        return edges
    told = labels.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "answer")
    edges = edges.unionByName(told.where("answer = 'oui'").select("a", "b")).distinct()
    return edges.join(told.where("answer = 'non'").select("a", "b"), ["a", "b"], "left_anti")


def _maximal_cliques(near: dict, first, open_: set, done: set) -> Iterator[tuple]:
    """Sets of ``first`` and nodes of ``open_``, all linked to each other, to which no node of ``open_`` or ``done`` can be added; by
    expansion around a pivot. ``near``: the neighbours of both among each other, those between two of ``done`` left out."""
    stack = [((first,), open_, done)]
    while stack:
        clique, open_, done = stack.pop()
        if not open_ and not done:
            yield tuple(sorted(clique))
            continue
        pivot = max(open_ | done, key=lambda n: (len(near[n] & open_), n))
        for node in sorted(open_ - near[pivot]):
            stack.append(((*clique, node), open_ & near[node], done & near[node]))
            open_ = open_ - {node}
            done = done | {node}


def _numbered(cliques: DataFrame) -> DataFrame:
    """``clique``: the place of the members' list in its component, without gathering a component: places inside ranges of the sorted
    lists, and the counts of the ranges before."""
    parts = int(cliques.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(cliques.repartitionByRange(parts, "component", "members").withColumn("_range", F.spark_partition_id()), "cliques")
    counts = rows.groupBy("component", "_range").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("component", "_range", (F.sum("n").over(W.partitionBy("component").orderBy("_range")) - F.col("n")).alias("_before"))
    place = F.row_number().over(W.partitionBy("component", "_range").orderBy("members")) - 1
    placed = rows.withColumn("_place", place).join(before, ["component", "_range"])
    return placed.select("component", (F.col("_place") + F.col("_before")).cast("int").alias("clique"), "members")


def maximal_cliques(edges: DataFrame) -> DataFrame:
    """(component, clique, members): members sorted; every edge is in a clique.

    Nodes are ordered by degree, then by name. A clique is found at its first node, among the later neighbours; the
    earlier ones tell whether it is maximal. Links between neighbours are the triangles of the graph.
    """
    kind = edges.schema["a"].dataType.simpleString()
    links = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    place = lambda end: degree.select(F.col("node").alias(end), F.struct("degree", "node").alias(f"_{end}"))
    placed = links.join(place("a"), "a").join(place("b"), "b")
    forth = stored(placed.select(F.least("_a", "_b").alias("u"), F.greatest("_a", "_b").alias("v")), "clique-edges")
    wedges = forth.join(forth.select("u", F.col("v").alias("w")), "u").where("v < w")
    triangles = stored(wedges.join(forth.select(F.col("u").alias("v"), F.col("v").alias("w")), ["v", "w"], "left_semi").select(F.col("u.node").alias("u"), F.col("v.node").alias("v"), F.col("w.node").alias("w")), "triangles")
    inside = triangles.select(F.explode(F.array(F.struct("u", "v"), F.struct("u", F.col("w").alias("v")), F.struct(F.col("v").alias("u"), F.col("w").alias("v")))).alias("x")).select("x.*").distinct()
    bare = forth.select(F.col("u.node").alias("u"), F.col("v.node").alias("v")).join(inside, ["u", "v"], "left_anti")  # links in no triangle
    at = triangles.select(F.col("u").alias("first"), F.col("v").alias("later"), F.col("w").alias("other"), F.lit(False).alias("before")).unionByName(
        triangles.select(F.col("v").alias("first"), F.col("w").alias("later"), F.col("u").alias("other"), F.lit(True).alias("before"))
    )

    def of(frame: pd.DataFrame) -> pd.DataFrame:
        first, open_, done = frame["first"].iloc[0], set(frame.later.tolist()), set()
        near: dict = {n: set() for n in open_}
        for a, b, before in zip(frame.later.tolist(), frame.other.tolist(), frame.before.tolist()):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
            (done if before else open_).add(b)
        found = [(first, list(c)) for c in _maximal_cliques(near, first, open_, done)]
        return pd.DataFrame(found, columns=["first", "members"], dtype=object).astype({"first": frame["first"].dtype})

    found = at.groupBy("first").applyInPandas(of, f"first {kind}, members array<{kind}>").unionByName(bare.select(F.col("u").alias("first"), F.sort_array(F.array("u", "v")).alias("members")))
    return _numbered(found.join(connected_components(links), F.col("first") == F.col("node")).select("component", "members"))


def kept_cliques(cliques: DataFrame, presences: DataFrame, least_units: int = 5, present: int = 3) -> DataFrame:
    """Cliques of three or more with ``least_units`` units where at least three members were; pairs stay as they are."""
    member = cliques.select("component", "clique", F.size("members").alias("size"), F.explode("members").alias("company"))
    met = member.join(presences.select("unit", "company"), "company").groupBy("component", "clique", "size", "unit").agg(F.count(F.lit(1)).alias("n"))
    units = met.where(F.col("n") >= F.least(F.lit(present), F.col("size"))).groupBy("component", "clique").agg(F.count(F.lit(1)).alias("units"))
    rows = cliques.join(units, ["component", "clique"], "left").withColumn("units", F.coalesce("units", F.lit(0)))
    return rows.where((F.size("members") < 3) | (F.col("units") >= least_units))


def families(cliques: DataFrame, largest: int = 12) -> DataFrame:
    """(component, family, core, occasional, key): cliques of a component that share members are packed together, larger first,
    while a common core remains and no more than ``largest`` companies are in (a larger clique is a family of its own).
    core are the members of all its cliques; key is the core's fingerprint."""
    kind = cliques.schema["component"].dataType.simpleString()

    def of(frame: pd.DataFrame) -> pd.DataFrame:
        packs: list[list[set]] = []  # core, all
        for members in sorted((set(m) for m in frame.members), key=lambda m: (-len(m), sorted(m))):
            best = max((p for p in packs if p[0] & members and len(p[1] | members) <= largest), key=lambda p: (len(p[0] & members), len(p[1] & members)), default=None)
            if best is None:
                packs.append([set(members), set(members)])
            else:
                best[0], best[1] = best[0] & members, best[1] | members
        rows = []
        for k, (core, all_) in enumerate(packs):
            key = hashlib.sha256("\n".join(sorted(map(str, core))).encode()).hexdigest()[:8]
            rows.append((frame.component.iloc[0], k, sorted(core), sorted(all_ - core), key))
        return pd.DataFrame(rows, columns=["component", "family", "core", "occasional", "key"])

    return cliques.groupBy("component").applyInPandas(of, f"component {kind}, family int, core array<{kind}>, occasional array<{kind}>, key string")


def communities(edges: DataFrame) -> DataFrame:
    """(node, community): weighted label propagation, a deterministic stand-in for modularity communities. ``edges``: a, b, weight.

    A node wants the label of most weight among its neighbours (ties: the smallest) where that is more than its own label's.
    In each round those move that come first, in the round's order, among the neighbours that want to move: never two that
    are linked, so that every round adds weight inside communities, and the rounds end, when no node wants to move.
    """
    own = edges.select("a", "b", "weight").where("a IS NOT NULL AND b IS NOT NULL")
    both = stored(own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")).distinct(), "community-edges")
    labels = stored(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), "community-labels")
    turn = 0
    while True:
        pull = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node"), "label").agg(F.sum("weight").alias("w"))
        mine = pull.join(labels.select("node", F.col("label").alias("old")), "node")
        best = mine.groupBy("node", "old").agg(F.max("w").alias("most"), F.max(F.when(F.col("label") == F.col("old"), F.col("w"))).alias("held"))
        new = mine.join(best.select("node", "most", "held"), "node").where("w = most").groupBy("node").agg(F.min("label").alias("new"), F.any_value("most").alias("most"), F.any_value("held").alias("held"))
        wish = stored(new.where("most > coalesce(held, 0)").select("node", "new", F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node").alias("at")), "community-wishes")
        if not wish.limit(1).count():
            return labels.select("node", F.col("label").alias("community"))
        rival = both.select(F.col("a").alias("node"), "b").join(wish.select(F.col("node").alias("b"), F.col("at").alias("other")), "b").groupBy("node").agg(F.min("other").alias("other"))
        moves = wish.join(rival, "node", "left").where("other IS NULL OR at <= other").select("node", "new")
        labels = stored(labels.join(moves, "node", "left").select("node", F.coalesce("new", "label").alias("label")), "community-labels")
        turn += 1


def group_score(strength: Column, volume: Column, ratio: Column, tail: Column, buyers: Column, regions: Column, domains: Column, off_profile: Column, gains: Column) -> Column:
    """0 to 100: weighted parts, each clipped to 0..1, over the sum of the weights."""
    chance = clip(F.ln(F.greatest(ratio, F.lit(1.0))) / F.ln(F.lit(10.0)))
    parts = {
        "strength": clip((strength - 0.3) / 0.7), "volume": clip(F.log1p(volume) / F.log1p(F.lit(50.0))), "chance": F.when(tail > 0.05, chance / 2).otherwise(chance),
        "contexts": 0.5 * clip((buyers - 1) / 4.0) + 0.25 * clip((regions - 1) / 2.0) + 0.25 * clip((domains - 1) / 2.0),
        "off_profile": clip(off_profile / 0.20), "gains": clip(gains / 0.60),
    }
    return F.round(100 * sum((F.lit(w) * parts[k] for k, w in SCORE_WEIGHTS.items()), F.lit(0.0)) / sum(SCORE_WEIGHTS.values()))


def structure(wins: Column, leader_share: Column) -> Column:
    return F.when(wins < 3, "peu de victoires").when(leader_share >= 0.6, "chef de file").otherwise("rotation")


def habitual_domains(rows: DataFrame, company: str, domain: str, share: float = 0.1, least: int = 5) -> DataFrame:
    """Domains that make a tenth of a company's units, of companies with five units or more."""
    n = rows.groupBy(company, domain).agg(F.count(F.lit(1)).alias("n"))
    total = rows.groupBy(company).agg(F.count(F.lit(1)).alias("total"))
    return n.join(total, company).where((F.col("total") >= least) & (F.col("n") >= share * F.col("total"))).select(company, domain)


def overlap_family(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_key, new_key, jaccard): the present family that shares most with each old one, met through their members.
    Both: key, member."""
    sizes = lambda f, name: f.groupBy("key").agg(F.count(F.lit(1)).alias(name))
    both = old.select(F.col("key").alias("old_key"), "member").join(new.select(F.col("key").alias("new_key"), "member"), "member")
    shared = both.groupBy("old_key", "new_key").agg(F.count(F.lit(1)).alias("n"))
    shared = shared.join(sizes(old, "a").withColumnRenamed("key", "old_key"), "old_key").join(sizes(new, "b").withColumnRenamed("key", "new_key"), "new_key")
    score = shared.withColumn("jaccard", F.col("n") / (F.col("a") + F.col("b") - F.col("n")))
    return score.groupBy("old_key").agg(F.max_by(F.struct("new_key", "jaccard"), F.struct("jaccard", "new_key")).alias("x")).select("old_key", "x.*")
