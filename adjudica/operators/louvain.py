"""Communities by modularity (Louvain) over a ladder of resolutions, as rounds of joins.

All resolutions go through the same rounds side by side, as a column. A level moves nodes between communities until no
move gains, and then contracts each community to a node of a weighted graph for the next level; the ladder ends where a level moves
nothing. Moves of a round are chosen so that all of them together gain:

* A coin of community and round says whether a community takes nodes or lets nodes go in that round.
* A node wishes for the community of most gain. With others moving into the same community, or out of its own, its gain
  falls by at most ``resolution * k * K / 2m``, K being the weight of these others. A wish is granted if it gains even then, or if it is
  the best one of both communities.

So modularity rises in every round, and rounds need sums by community only, never a community in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from adjudica.operators.components import stored

#: The ladder's resolutions.
RESOLUTIONS = (1.0, 1.5, 2.0, 3.0, 5.0, 8.0, 13.0, 21.0)
LEAST_GAIN = 1e-10


def _moved(links: DataFrame, nodes: DataFrame, totals: DataFrame) -> DataFrame:
    """(r, node, label, k) after all rounds of one level. ``links``: r, a, b, w in both directions; ``nodes``: r, node, k; ``totals``: r, m2."""
    labels, turn = stored(nodes.withColumn("label", F.col("node")), "louvain-labels"), 0
    while True:
        mass = labels.groupBy("r", "label").agg(F.sum("k").alias("mass"))
        near = links.join(labels.select("r", F.col("node").alias("b"), "label"), ["r", "b"]).groupBy("r", F.col("a").alias("node"), "label").agg(F.sum("w").alias("w"))
        own = labels.join(near, ["r", "node", "label"], "left").select("r", "node", "k", F.col("label").alias("old"), F.coalesce("w", F.lit(0.0)).alias("w_old"))
        own = own.join(mass.select("r", F.col("label").alias("old"), F.col("mass").alias("mass_old")), ["r", "old"])
        other = near.join(own, ["r", "node"]).where("label <> old").join(mass, ["r", "label"]).join(F.broadcast(totals), "r")  # a row a resolution
        pull = F.col("r") * F.col("k") / F.col("m2")
        gain = F.col("w") - F.col("w_old") - pull * (F.col("mass") - F.col("mass_old") + F.col("k"))
        wish = other.withColumn("gain", gain).where(F.col("gain") > LEAST_GAIN * F.col("m2"))
        wish = wish.groupBy("r", "node").agg(F.max(F.struct("gain", -F.xxhash64("label"), "label", "old", "k", "m2")).alias("x")).select("r", "node", "x.label", "x.old", "x.k", "x.m2", "x.gain")
        wish = stored(wish, "louvain-wishes")
        if not wish.limit(1).count():
            return labels
        coin = lambda c: F.pmod(F.xxhash64("r", c, F.lit(turn)), F.lit(2))
        live = wish.where((coin("label") == 1) & (coin("old") == 0)).withColumn("at", F.struct("gain", "node"))
        joins = live.groupBy("r", "label").agg(F.sum("k").alias("k_in"), F.max("at").alias("best_in"))
        leaves = live.groupBy("r", "old").agg(F.sum("k").alias("k_out"), F.max("at").alias("best_out"))
        both = live.join(joins, ["r", "label"]).join(leaves, ["r", "old"])
        sure = F.col("gain") - F.col("r") * F.col("k") * (F.col("k_in") + F.col("k_out") - 2 * F.col("k")) / F.col("m2") > LEAST_GAIN * F.col("m2")
        first = (F.col("at") == F.col("best_in")) & (F.col("at") == F.col("best_out"))
        moves = both.where(sure | first).select("r", "node", F.col("label").alias("to"))
        labels = stored(labels.join(moves, ["r", "node"], "left").select("r", "node", "k", F.coalesce("to", "label").alias("label")), "louvain-labels")
        turn += 1


def ladder(edges: DataFrame, resolutions: tuple[float, ...] = RESOLUTIONS) -> DataFrame:
    """(resolution, level, node, community) of ``edges`` (a, b, weight): level 1 is the finest; community is its smallest node.

    Edges in either direction, and repeated ones, are summed; loops count for their node. Edges with a null end or a weight that is null or
    not positive are none. A resolution whose nodes stop moving has no further level.
    """
    rates = F.explode(F.array(*[F.lit(float(r)) for r in resolutions]))
    one = edges.where("a IS NOT NULL AND b IS NOT NULL AND weight > 0").select("a", "b", F.col("weight").cast("double").alias("w"))
    both = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    summed = both.groupBy("a", "b").agg(F.sum("w").alias("w"))
    links = stored(summed.withColumn("r", rates).select("r", "a", "b", "w"), "louvain-links")
    member = stored(links.select("r", F.col("a").alias("node")).distinct().withColumn("top", F.col("node")), "louvain-members")
    out, level = [], 0
    while True:
        level += 1
        nodes = links.groupBy("r", F.col("a").alias("node")).agg(F.sum("w").alias("k"))
        totals = nodes.groupBy("r").agg(F.sum("k").alias("m2"))
        placed = _moved(links.where("a <> b"), nodes, totals)
        moved = placed.where("node <> label").select("r").distinct()
        label = placed.select("r", F.col("node").alias("top"), "label")
        member = stored(member.join(label, ["r", "top"]).join(F.broadcast(moved), "r", "left_semi").select("r", "node", F.col("label").alias("top")), "louvain-members")
        if not member.limit(1).count():
            break
        name = member.groupBy("r", "top").agg(F.min("node").alias("community"))
        out.append(member.join(name, ["r", "top"]).select(F.col("r").alias("resolution"), F.lit(level).alias("level"), "node", "community"))
        ends = placed.select("r", "node", "label")
        links = links.join(F.broadcast(moved), "r", "left_semi").join(ends.select("r", F.col("node").alias("a"), F.col("label").alias("x")), ["r", "a"]).join(ends.select("r", F.col("node").alias("b"), F.col("label").alias("y")), ["r", "b"])
        links = stored(links.groupBy("r", F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("w").alias("w")), "louvain-links")
    if not out:
        return member.select(F.col("r").alias("resolution"), F.lit(1).alias("level"), "node", F.col("top").alias("community"))
    done = out[0]
    for rows in out[1:]:
        done = done.unionByName(rows)
    return done


def modularity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(resolution, level, communities, largest, modularity) of ``ladder``'s rows."""
    one = edges.where("a IS NOT NULL AND b IS NOT NULL AND weight > 0").select("a", "b", F.col("weight").cast("double").alias("w"))
    key, of = ["resolution", "level"], lambda end: members.select("resolution", "level", F.col("node").alias(end), F.col("community").alias(f"c{end}"))
    ends = one.join(of("a"), "a").join(of("b"), [*key, "b"])
    degree = ends.select(*key, F.explode(F.array("ca", "cb")).alias("community"), "w").groupBy(*key, "community").agg(F.sum("w").alias("k"))
    inside = ends.where("ca = cb").groupBy(*key, F.col("ca").alias("community")).agg(F.sum("w").alias("w"))
    sizes = members.groupBy(*key, "community").agg(F.count(F.lit(1)).alias("n"))
    total = degree.groupBy(*key).agg(F.sum("k").alias("m2"))
    rows = sizes.join(degree, [*key, "community"], "left").join(inside, [*key, "community"], "left").join(total, key)
    term = 2 * F.coalesce("w", F.lit(0.0)) / F.col("m2") - F.col("resolution") * F.pow(F.col("k") / F.col("m2"), 2)
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("communities"), F.max("n").alias("largest"), F.sum(term).alias("modularity"))
