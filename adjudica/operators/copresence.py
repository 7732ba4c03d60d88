"""Companies that bid together: pairs, chance, levels, and what surrounds one company.

``presences``: unit, company, buyer (one row a company and unit). Pairs come of a unit's sorted list of bidders, each made once,
in the task of its first company; a unit's bidders are few, so that its pairs are too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from adjudica.functions.measures import poisson_tail
from adjudica.operators.components import stored

# Thresholds of the levels, strongest first: shared units, excess over chance, Poisson tail.
LEVELS = (("fort", 6, 5.0, 1e-4), ("moyen", 4, 3.0, 1e-3), ("faible", 3, 2.0, 1e-2))
MUTUAL_UNITS, MUTUAL_SHARE = 5, 0.5
#: Pairs that a task makes, about; companies of a buyer up to which they are gathered.
TASK_PAIRS, LISTED = 1 << 21, 1 << 8


def _tasks(rows: DataFrame, pairs: Column) -> int:
    """Among how many tasks ``pairs``, summed over ``rows``, are dealt."""
    n = rows.agg(F.sum(pairs).alias("n")).first()["n"] or 0
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-int(n) // TASK_PAIRS))


def _size(members: Column) -> Column:
    return F.size(members).cast("long")


def _unit_lists(presences: DataFrame) -> DataFrame:
    """(members): the companies of each unit of two or more, sorted."""
    lists = presences.where("unit IS NOT NULL").groupBy("unit").agg(F.sort_array(F.collect_list("company")).alias("members"))
    return stored(lists.where(F.size("members") > 1), "unit-lists")


def _later(lists: DataFrame, *kept: str) -> DataFrame:
    """(a, bs): each member with those behind it in its list. A list is so shuffled by ``a`` as a row a member, and its pairs are only made
    behind the shuffle."""
    at = lists.select("members", *kept, F.posexplode(F.expr("slice(members, 1, size(members) - 1)")).alias("_at", "a"))
    return at.select("a", F.expr("slice(members, _at + 2, size(members))").alias("bs"), *kept, "_at")


def shared_units(presences: DataFrame, least: int = 1) -> DataFrame:
    """(a, b, together) for a < b."""
    lists = _unit_lists(presences)
    rows = _later(lists).select("a", "bs").repartition(_tasks(lists, _size(F.col("members")) * (_size(F.col("members")) - 1) / 2), "a")
    pairs = rows.select("a", F.explode("bs").alias("b")).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("together")).where(F.col("together") >= least)


def _buyer_companies(presences: DataFrame) -> DataFrame:
    """(buyer, company, n, units, k): units of a company at a buyer, the buyer's units and companies."""
    n = presences.where("buyer IS NOT NULL AND company IS NOT NULL").groupBy("buyer", "company").agg(F.count(F.lit(1)).alias("n"))
    units = presences.groupBy("buyer").agg(F.count_distinct("unit").alias("units"))
    k = n.groupBy("buyer").agg(F.count(F.lit(1)).alias("k"))
    return stored(n.join(units.join(k, "buyer"), "buyer"), "buyer-companies")


def _followed(large: DataFrame, met: DataFrame) -> DataFrame:
    """(a, b, term) of the buyers of very many companies: those that cost less by following the pairs that met make no pairs of their own."""
    degree = met.groupBy(F.col("a").alias("company")).agg(F.count(F.lit(1)).alias("met"))
    ways = large.join(degree, "company", "left").groupBy("buyer").agg(F.any_value("k").alias("k"), F.sum("met").alias("met"))
    by_pairs = large.join(ways.select("buyer", (F.col("k") * (F.col("k") - 1) / 2 <= F.coalesce("met", F.lit(0))).alias("_by_pairs")), "buyer")
    side = lambda rows, end: rows.select("buyer", F.col("company").alias(end), F.col("n").alias(f"n{end}"), *(["units"] if end == "a" else []))
    few, many = by_pairs.where("_by_pairs"), by_pairs.where("NOT _by_pairs")
    term = (F.col("na") * F.col("nb") / F.col("units")).alias("term")
    made = side(few, "a").join(side(few, "b"), "buyer").where("a < b").select("a", "b", term)
    return made.unionByName(met.select("a", "b").join(side(many, "a"), "a").join(side(many, "b"), ["b", "buyer"]).select("a", "b", term))


def _bought(small: DataFrame, tasks: int) -> DataFrame:
    """(a, bs, na, units, ns): each company of a buyer with those behind it in the buyer's list. Lists are made in ``tasks`` tasks too, as what a task sends is
    some ten times what it reads, and would be spilled."""
    both = F.sort_array(F.collect_list(F.struct("company", F.col("n").cast("int").alias("n"))))
    lists = small.repartition(tasks, "buyer").groupBy("buyer", "units").agg(both.alias("both")).select("units", F.col("both.company").alias("members"), F.col("both.n").alias("ns"))
    return _later(lists, "units", "ns").select("a", "bs", F.get("ns", F.col("_at")).alias("na"), "units", F.expr("slice(ns, _at + 2, size(ns))").alias("ns"))


def _of_met(presences: DataFrame, met: DataFrame) -> DataFrame:
    """``met`` (a, b, together) with expected: only companies that are in a pair are sent to their buyers' lists, and buyers without two such send none."""
    of = met.select(F.explode(F.array("a", "b")).alias("company")).distinct()
    n = _buyer_companies(presences).join(of, "company", "left_semi")
    k = n.groupBy("buyer").agg(F.count(F.lit(1)).alias("k"))
    n = stored(n.drop("k").join(k.where("k > 1"), "buyer"), "met-buyer-companies")
    small, large = n.where(F.col("k") <= LISTED), n.where(F.col("k") > LISTED)
    tasks = _tasks(small.groupBy("buyer").agg(F.max("k").alias("k")), F.col("k") * (F.col("k") - 1) / 2)
    # met pairs come as lists of one, so that a pair and its terms are summed behind one shuffle by ``a``
    known = met.select("a", F.array("b").alias("bs"), F.lit(None).cast("int").alias("na"), F.col("together").alias("units"), F.lit(None).cast("array<int>").alias("ns"))
    rows = _bought(small, tasks).unionByName(known).repartition(tasks, "a").select("a", "na", "units", "ns", F.posexplode("bs").alias("_i", "b")).where("a < b")
    term = F.col("na").cast("long") * F.get("ns", F.col("_i")).cast("long") / F.col("units")
    summed = rows.groupBy("a", "b").agg(F.max(F.when(F.col("na").isNull(), F.col("units"))).alias("together"), F.sum(term).alias("expected")).where("together IS NOT NULL")
    if large.limit(1).count():
        more = _followed(large, met).select("a", "b", F.lit(None).cast("long").alias("together"), F.col("term").alias("expected"))
        summed = summed.unionByName(more).groupBy("a", "b").agg(F.max("together").alias("together"), F.sum("expected").alias("expected")).where("together IS NOT NULL")
    return summed.where("expected IS NOT NULL")


def met_and_expected(presences: DataFrame, least: int = 1) -> DataFrame:
    """(a, b, together, expected) of the pairs with ``least`` shared units: expected is the sum over buyers of nA * nB / N, what independent
    choices of each buyer's units would give.

    Units and buyers send each company once, with the companies behind it in their list, to the task that makes and sums its pairs;
    pairs themselves are not shuffled, and a task makes about ``TASK_PAIRS`` of them however many there are. Buyers of more than
    ``LISTED`` companies are not gathered; each goes the cheaper of two ways (``_followed``).
    """
    if least > 1:
        return _of_met(presences, stored(shared_units(presences, least), "met"))
    units, n = _unit_lists(presences), _buyer_companies(presences)
    large = n.where(F.col("k") > LISTED)
    count = units.select(_size(F.col("members")).alias("k")).unionByName(n.where(F.col("k") <= LISTED).groupBy("buyer").agg(F.max("k").alias("k")).select("k"))
    tasks = _tasks(count, F.col("k") * (F.col("k") - 1) / 2)
    bought = _bought(n.where(F.col("k") <= LISTED), tasks)
    shared = _later(units).select("a", "bs", F.lit(None).cast("int").alias("na"), F.lit(None).cast("long").alias("units"), F.lit(None).cast("array<int>").alias("ns"))
    rows = bought.unionByName(shared).repartition(tasks, "a").select("a", "na", "units", "ns", F.posexplode("bs").alias("_i", "b")).where("a < b")
    term = F.col("na").cast("long") * F.get("ns", F.col("_i")).cast("long") / F.col("units")
    summed = rows.groupBy("a", "b").agg(F.count_if(F.col("na").isNull()).alias("together"), F.sum(term).alias("expected")).where(F.col("together") >= least)
    if large.limit(1).count():
        summed = stored(summed, "shared-units")
        more = _followed(large, summed).groupBy("a", "b").agg(F.sum("term").alias("_more"))
        summed = summed.join(more, ["a", "b"], "left").select("a", "b", "together", F.when(F.coalesce("expected", "_more").isNotNull(), F.coalesce("expected", F.lit(0.0)) + F.coalesce("_more", F.lit(0.0))).alias("expected"))
    return summed.where("expected IS NOT NULL")


def level(together: Column, excess: Column, tail: Column, share_a: Column, share_b: Column) -> Column:
    """fort, moyen, faible or null; pairs that are half of each other's units are at least moyen."""
    out = None
    for name, n, e, p in LEVELS:
        hit = (together >= n) & (excess >= e) & (tail < p)
        if name == "faible":
            out = out.when((together >= MUTUAL_UNITS) & (share_a >= MUTUAL_SHARE) & (share_b >= MUTUAL_SHARE), "moyen")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def pairs(presences: DataFrame, least: int = 1) -> DataFrame:
    """(a, b, together, expected, excess, tail, share_a, share_b, level)."""
    units = presences.groupBy("company").agg(F.count(F.lit(1)).alias("units"))
    of = lambda side: units.select(F.col("company").alias(side), F.col("units").alias(f"units_{side}"))
    rows = met_and_expected(presences, least).join(of("a"), "a").join(of("b"), "b")
    rows = rows.withColumns({"excess": F.col("together") / F.greatest("expected", F.lit(1e-9)), "tail": poisson_tail(F.col("expected"), F.col("together")), "share_a": F.col("together") / F.col("units_a"), "share_b": F.col("together") / F.col("units_b")})
    return rows.withColumn("level", level(F.col("together"), F.col("excess"), F.col("tail"), F.col("share_a"), F.col("share_b"))).drop("units_a", "units_b")


def around(presences: DataFrame, wins: DataFrame, companies: DataFrame | None = None) -> DataFrame:
    """For each company x (of ``companies``, or all) and each other y that shares a unit with it: together, x_wins_with, y_wins_with,
    a = x's wins with y / x's wins, b = together / x's units, c = together / y's units, ratio = a / b, part, reading.
    ``wins``: unit, company."""
    wins, own = stored(wins.select("unit", "company"), "wins"), stored(presences.select("unit", "company"), "presences")
    # what a company is told with goes along in the lists, so that no pair is joined
    won = wins.groupBy("company").agg(F.count(F.lit(1)).alias("won"))
    of = stored(own.groupBy("company").agg(F.count(F.lit(1)).alias("n")).join(won, "company", "left"), "company-counts")
    if companies is not None:
        own = own.join(own.join(companies.select("company"), "company", "left_semi").select("unit").distinct(), "unit", "left_semi")
    winners = wins.groupBy("unit").agg(F.collect_list("company").alias("winners"))
    both = F.sort_array(F.collect_list(F.struct("company", "n", "won"))).alias("both")
    met = own.where("unit IS NOT NULL").join(of, "company").groupBy("unit").agg(both).where("size(both) > 1").join(winners, "unit", "left")
    winners = F.coalesce("winners", F.array().cast(winners.schema["winners"].dataType)).alias("winners")
    lists = stored(met.select(F.col("both.company").alias("members"), F.col("both.n").alias("ns"), F.col("both.won").alias("wons"), winners), "unit-lists")
    tasks = _tasks(lists, _size(F.col("members")) * (_size(F.col("members")) - 1) / 2)
    behind = lambda c: F.expr(f"slice({c}, _at + 2, size({c}))").alias(c)
    rows = _later(lists, "winners", "ns", "wons").select("a", "bs", "winners", F.get("ns", F.col("_at")).alias("na"), F.get("wons", F.col("_at")).alias("ka"), behind("ns"), behind("wons"))
    rows = rows.repartition(tasks, "a").select("a", F.posexplode("bs").alias("_i", "b"), "winners", "na", "ka", "ns", "wons").where("a < b")
    rows = rows.select("a", "b", "winners", "na", "ka", F.get("ns", F.col("_i")).alias("nb"), F.get("wons", F.col("_i")).alias("kb"))
    won = lambda end: F.sum(_size(F.filter("winners", lambda w: w == F.col(end)))).alias(f"w{end}")
    met = rows.groupBy("a", "b").agg(F.sum(F.greatest(_size(F.col("winners")), F.lit(1))).alias("together"), won("a"), won("b"), *[F.max(c).alias(c) for c in ("na", "nb", "ka", "kb")])
    told = lambda x, y: [F.col(f"w{x}").alias("x_wins_with"), F.col(f"w{y}").alias("y_wins_with"), F.col(f"n{x}").alias("x_units"), F.col(f"n{y}").alias("y_units"), F.col(f"k{x}").alias("x_wins"), F.col(f"k{y}").alias("y_wins")]
    both = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), "together", *told(x, y))
    rows = met.select(F.explode(F.array(both("a", "b"), both("b", "a"))).alias("_r")).select("_r.*")
    if companies is not None:
        rows = rows.join(companies.select(F.col("company").alias("x")), "x", "left_semi")
    rows = rows.withColumns({"a": F.coalesce(F.col("x_wins_with") / F.col("x_wins"), F.lit(0.0)), "b": F.col("together") / F.col("x_units"), "c": F.col("together") / F.col("y_units"), "part": F.when(F.coalesce("y_wins", F.lit(0)) > 0, F.least(F.lit(1.0), F.col("y_wins_with") / F.col("y_wins")))})
    rows = rows.withColumn("ratio", F.when(F.col("b") > 0, F.col("a") / F.col("b")))
    reading = (
        F.when((F.col("x_wins_with") >= 3) & (F.col("ratio") >= 1.3) & (F.col("part") >= 0.5), "noyau")
        .when((F.col("x_wins_with") >= 3) & ((F.col("ratio") >= 1.3) | (F.col("c") >= 0.6)), "accompagnatrice")
        .when((F.col("y_wins_with") >= 3) & (F.coalesce("ratio", F.lit(0.0)) < 1), "concurrent").otherwise("neutre")
    )
    return rows.withColumn("reading", reading)


def lost_gaps(ranked: DataFrame, unit: list[str]) -> DataFrame:
    """(bidder, lost, median_gap): percent by which a company's losing bids lie from the commission's choice."""
    first = ranked.where("rank = 1").select(*unit, F.col("amount").alias("_best"))
    lost = ranked.where("rank > 1").join(first, unit)
    return lost.groupBy("bidder").agg(F.count(F.lit(1)).alias("lost"), F.median((F.col("amount") - F.col("_best")) / F.col("_best") * 100).alias("median_gap"))


def entropy(wins: DataFrame, group: str, member: str) -> DataFrame:
    """(group, entropy): evenness of wins among members, 0 to 1."""
    n = wins.groupBy(group, member).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(group).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    share = F.col("n") / F.col("total")
    return n.join(total, group).groupBy(group).agg((F.sum(-share * F.ln(share)) / F.greatest(F.ln(F.max("k")), F.lit(1e-12))).alias("entropy"))
