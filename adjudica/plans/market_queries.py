"""More tender queries over the star schema: sheets, groups, models, lookups, orders, texts; each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from adjudica.functions import measures
from adjudica.operators import commission, copresence, groups, marts, search, sheets
from adjudica.operators.components import stored
from adjudica.plans.adapter import BIDS_SQL, FULL_SQL, PRESENCES_SQL, TENDERS_SQL, bids, presences, table, tenders
from adjudica.plans.tender_queries import _prices, _ranked
from adjudica.plans.tender_queries import CATALOGUE as _BEFORE

CATALOGUE: dict = {}


def query(sql: str | None = None):
    def register(fn):
        assert fn.__name__ not in _BEFORE
        CATALOGUE[fn.__name__] = (fn, sql)
        return fn

    return register


def six(c, name: str):
    """Six decimals, for values whose last bits depend on the order of sums."""
    return (F.floor(c * 1e6 + 0.5) / F.lit(1e6)).alias(name)


SIX = "floor(({}) * 1e6 + 0.5) / 1e6"


def _offers(spark, d):
    """unit, company, amount (its first offer), rank of that among the commission's (null where it was not admitted), the unit's reference."""
    rows = commission.ranked_bids(bids(spark, d), tenders(spark, d), ["unit"], None)
    told = rows.groupBy("unit", F.col("bidder").alias("company")).agg(F.min_by("amount", "seq").alias("amount"), F.min("rank").cast("long").alias("rank"), F.max("reference").alias("reference"))
    return told.withColumn("rank", F.when(F.col("company").isNotNull(), F.col("rank")))


def _winners(offers):
    return offers.where("rank = 1").select("unit", "company")


def _members(spark, d):
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("group"), F.col("s_suppkey").alias("company"))


OFFERS_SQL = f"""{FULL_SQL}, {PRESENCES_SQL}, best AS (SELECT unit, bidder AS company, min(rank) AS rank FROM ranked GROUP BY 1, 2),
 offers AS (SELECT f.unit, f.company, f.amount, best.rank FROM (SELECT unit, bidder AS company, arg_min(amount, seq) AS amount FROM bids GROUP BY 1, 2) f LEFT JOIN best USING (unit, company)),
 winners AS (SELECT unit, bidder AS company FROM ranked WHERE rank = 1), members AS (SELECT s_nationkey AS grp, s_suppkey AS company FROM supplier)"""
_SHEET = """n AS (SELECT company, count(*) AS n FROM offers GROUP BY 1), met AS (SELECT p.company AS x, q.company AS y, count(*) AS together, count(*) FILTER (w.company = p.company) AS x_wins, count(*) FILTER (w.company = q.company) AS y_wins,
 median(CASE WHEN w.company = p.company THEN q.amount / p.amount - 1 END) AS when_x_wins, median(CASE WHEN w.company = q.company THEN p.amount / q.amount - 1 END) AS when_y_wins
 FROM offers p JOIN offers q ON p.unit = q.unit AND p.company <> q.company LEFT JOIN winners w ON w.unit = p.unit GROUP BY 1, 2),
 lv AS (SELECT a.company AS a, b.company AS b, CASE WHEN count(*) >= 8 THEN 'fort' WHEN count(*) >= 6 THEN 'moyen' WHEN count(*) >= 5 THEN 'faible' END AS level FROM presences a JOIN presences b ON a.unit = b.unit AND a.company < b.company GROUP BY 1, 2),
 sheet AS (SELECT x, y, together, x_wins, y_wins, when_x_wins, when_y_wins, together / nx.n AS share_x, together / ny.n AS share_y, level, CASE WHEN x_wins >= 3 AND 2 * y_wins <= x_wins THEN 'accompagne' WHEN y_wins >= 3 AND 2 * x_wins <= y_wins THEN 'concurrent' ELSE 'mixte' END AS profile
 FROM met JOIN n nx ON nx.company = x JOIN n ny ON ny.company = y LEFT JOIN lv ON a = least(x, y) AND b = greatest(x, y))"""


def _levels(spark, d):
    n = F.col("together")
    return copresence.shared_units(presences(spark, d)).withColumn("level", F.when(n >= 8, "fort").when(n >= 6, "moyen").when(n >= 5, "faible"))


def _sheet_of(spark, d):
    offers = stored(_offers(spark, d).drop("reference"), "offers")  # read for the winners too
    return sheets.company_sheet(offers, _winners(offers), _levels(spark, d))


# companies and groups


@query(f"{OFFERS_SQL}, {_SHEET} SELECT * FROM sheet")
def company_sheet(spark, d):
    return _sheet_of(spark, d)


@query(f"{OFFERS_SQL}, {_SHEET} SELECT x, section, count(*) AS companies, CAST(sum(together) AS BIGINT) AS together FROM (SELECT x, together, unnest(list_filter([CASE WHEN level IS NOT NULL THEN 'partenaires' END, CASE WHEN x_wins >= 3 THEN 'suivis' END, CASE WHEN y_wins >= 3 THEN 'meneurs' END, CASE WHEN profile = 'concurrent' THEN 'concurrents' END], lambda s: s IS NOT NULL)) AS section FROM sheet) GROUP BY 1, 2")
def company_sheet_sections(spark, d):
    rows = sheets.sections(_sheet_of(spark, d))
    return rows.groupBy("x", "section").agg(F.count(F.lit(1)).alias("companies"), F.sum("together").alias("together"))


_OUTCOMES = """own AS (SELECT grp, unit, arg_min(company, (rank, company)) FILTER (rank IS NOT NULL) AS bc, arg_min(amount, (rank, company)) FILTER (rank IS NOT NULL) AS ba FROM offers JOIN members USING (company) GROUP BY 1, 2),
 won AS (SELECT w.unit, w.company AS winner, o.amount FROM winners w JOIN offers o ON o.unit = w.unit AND o.company = w.company),
 outcomes AS (SELECT own.grp, own.unit, m.company IS NOT NULL AS won, winner, CASE WHEN m.company IS NULL THEN bc END AS best_member, CASE WHEN m.company IS NULL THEN won.amount - ba END AS gap_best, CASE WHEN m.company IS NULL THEN won.amount - p.reference END AS gap_reference
 FROM own JOIN won USING (unit) LEFT JOIN members m ON m.grp = own.grp AND m.company = winner LEFT JOIN prices p ON p.unit = own.unit)"""


def _group_outcomes(spark, d, offers=None):
    """``offers``: of ``_offers``, where they are stored already."""
    offers = offers if offers is not None else stored(_offers(spark, d), "offers")
    return sheets.group_outcomes(offers, _winners(offers), _members(spark, d), offers.where("rank = 1").select("unit", "reference"))


@query(f'{OFFERS_SQL}, {_OUTCOMES} SELECT grp AS "group", unit, won, winner, best_member, gap_best, gap_reference FROM outcomes')
def group_outcomes(spark, d):
    return _group_outcomes(spark, d)


@query(f'{OFFERS_SQL}, {_OUTCOMES} SELECT grp AS "group", count(*) AS units, count(*) FILTER (won) AS won, count(*) FILTER (NOT won) AS lost, count(*) FILTER (NOT won AND best_member IS NULL) AS lost_excluded, median(gap_best) AS gap_best, median(gap_reference) AS gap_reference FROM outcomes GROUP BY 1')
def group_summary(spark, d):
    return sheets.group_summary(_group_outcomes(spark, d))


@query(f"""{OFFERS_SQL}, {_OUTCOMES}, n AS (SELECT grp, company, count(*) AS units FROM offers JOIN members USING (company) GROUP BY 1, 2), w AS (SELECT grp, winner, count(*) AS wins FROM outcomes WHERE won GROUP BY 1, 2), c AS (SELECT grp, arg_min(winner, (-wins, winner)) AS chief FROM w GROUP BY 1)
 SELECT n.grp AS "group", n.company, units, coalesce(wins, 0) AS wins, CASE WHEN n.company = chief THEN 'chef' WHEN wins > 0 THEN 'gagnant' ELSE 'accompagnant' END AS role FROM n LEFT JOIN w ON w.grp = n.grp AND winner = n.company LEFT JOIN c ON c.grp = n.grp""")
def group_roles(spark, d):
    offers = stored(_offers(spark, d), "offers")
    return sheets.member_roles(offers, _group_outcomes(spark, d, offers), _members(spark, d))


@query(f"{OFFERS_SQL}, {_SHEET}, b AS (SELECT company, max(CASE level WHEN 'fort' THEN 3 WHEN 'moyen' THEN 2 ELSE 1 END) AS l FROM (SELECT unnest([a, b]) AS company, level FROM lv WHERE level IS NOT NULL) GROUP BY 1) SELECT count(*) AS companies, count(*) FILTER (n >= 5) AS active, count(*) FILTER (n >= 5 AND l >= 1) AS with_partner, count(*) FILTER (n >= 5 AND l >= 2) AS with_middle, count(*) FILTER (n >= 5 AND l >= 3) AS with_strong FROM n LEFT JOIN b USING (company)")
def group_header(spark, d):
    return sheets.header(_offers(spark, d).groupBy("company").agg(F.count(F.lit(1)).alias("units")), _levels(spark, d))


@query(f"WITH {PRESENCES_SQL} SELECT unit FROM presences WHERE company = 1 INTERSECT SELECT unit FROM presences WHERE company = 2")
def common_units(spark, d):
    return sheets.common_units(presences(spark, d), 1, 2)


@query('SELECT s_nationkey AS "group" FROM supplier GROUP BY 1 HAVING bool_or(s_suppkey = 1) AND bool_or(s_nationkey = (SELECT s_nationkey FROM supplier WHERE s_suppkey = 1))')
def groups_of_both(spark, d):
    members = _members(spark, d)
    with_own = members.unionByName(members.select("group", (-F.col("group")).cast("long").alias("company")))
    one = members.where("company = 1").select(F.col("group").alias("g"))
    return sheets.groups_of_both(with_own.join(F.broadcast(one), F.col("group") == F.col("g")).select("group", F.when(F.col("company") == 1, 1).otherwise(2).alias("company")), 1, 2)


@query(f"{OFFERS_SQL}, {_SHEET}, lab AS (SELECT a, b, CASE (a + b) % 7 WHEN 0 THEN 'non' WHEN 1 THEN 'oui' END AS answer FROM lv WHERE (a + b) % 7 < 2) SELECT a, b FROM (SELECT a, b FROM lv WHERE level IN ('fort', 'moyen') UNION SELECT a, b FROM lab WHERE answer = 'oui') EXCEPT SELECT a, b FROM lab WHERE answer = 'non'")
def link_graph(spark, d):
    pairs = _levels(spark, d)
    k = (F.col("a") + F.col("b")) % 7
    labels = pairs.where(k < 2).select(F.col("b").alias("a"), F.col("a").alias("b"), F.when(k == 0, "non").otherwise("oui").alias("answer"))
    return groups.link_graph(pairs, labels)


@query(f"""WITH {PRESENCES_SQL}, m AS (SELECT s_nationkey AS component, CAST(s_suppkey % 2 AS INT) AS clique, s_suppkey AS company FROM supplier), sz AS (SELECT component, clique, count(*) AS size FROM m GROUP BY 1, 2),
 u AS (SELECT component, clique, count(*) AS units FROM (SELECT component, clique, unit, count(*) AS k FROM m JOIN presences USING (company) GROUP BY 1, 2, 3) x JOIN sz USING (component, clique) WHERE k >= least(3, size) GROUP BY 1, 2)
 SELECT component, clique, size, coalesce(units, 0) AS units FROM sz LEFT JOIN u USING (component, clique) WHERE size < 3 OR coalesce(units, 0) >= 5""")
def kept_cliques(spark, d):
    made = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("component"), (F.col("s_suppkey") % 2).cast("int").alias("clique")).agg(F.sort_array(F.collect_list("s_suppkey")).alias("members"))
    return groups.kept_cliques(made, presences(spark, d)).select("component", "clique", F.size("members").cast("long").alias("size"), "units")


@query(f"WITH {PRESENCES_SQL}, r AS (SELECT company, o_orderpriority AS domain FROM presences JOIN orders ON o_orderkey = unit), n AS (SELECT company, domain, count(*) AS n FROM r GROUP BY 1, 2), t AS (SELECT company, sum(n) AS total FROM n GROUP BY 1) SELECT company, domain FROM n JOIN t USING (company) WHERE total >= 5 AND n >= 0.2 * total")
def habitual_domains(spark, d):
    rows = presences(spark, d).join(tenders(spark, d).select("unit", F.col("priority").alias("domain")), "unit")
    return groups.habitual_domains(rows, "company", "domain", share=0.2)


@query("""WITH o AS (SELECT 'o' || s_nationkey AS k, s_suppkey AS m FROM supplier), n AS (SELECT 'n' || s_suppkey % 7 AS k, s_suppkey AS m FROM supplier), s AS (SELECT o.k AS a, n.k AS b, count(*) AS c FROM o JOIN n USING (m) GROUP BY 1, 2),
 j AS (SELECT a, b, c / ((SELECT count(*) FROM o WHERE k = a) + (SELECT count(*) FROM n WHERE k = b) - c) AS jaccard FROM s) SELECT a AS old_key, arg_max(b, (jaccard, b)) AS new_key, max(jaccard) AS jaccard FROM j GROUP BY 1""")
def overlap_family(spark, d):
    s = table(spark, d, "supplier")
    old, new = s.select(F.concat(F.lit("o"), "s_nationkey").alias("key"), F.col("s_suppkey").alias("member")), s.select(F.concat(F.lit("n"), F.col("s_suppkey") % 7).alias("key"), F.col("s_suppkey").alias("member"))
    return groups.overlap_family(old, new)


_PARTS = {"strength": "greatest(0.0, least(1.0, (f - 0.3) / 0.7))", "volume": "greatest(0.0, least(1.0, ln(1 + v) / ln(51.0)))", "chance": "greatest(0.0, least(1.0, ln(greatest(r, 1.0)) / ln(10.0))) * CASE WHEN t > 0.05 THEN 0.5 ELSE 1 END", "contexts": "0.5 * greatest(0.0, least(1.0, (bu - 1) / 4.0)) + 0.25 * greatest(0.0, least(1.0, (re - 1) / 2.0)) + 0.25 * greatest(0.0, least(1.0, (dm - 1) / 2.0))", "off_profile": "greatest(0.0, least(1.0, o / 0.2))"}
_SCORED = "g AS (SELECT c_custkey AS k, (c_custkey % 11) / 10.0::DOUBLE AS f, c_custkey % 60 AS v, (c_custkey % 13) / 2.0::DOUBLE AS r, (c_custkey % 9) / 100.0::DOUBLE AS t, c_custkey % 6 AS bu, c_custkey % 4 AS re, c_custkey % 5 AS dm, (c_custkey % 7) / 20.0::DOUBLE AS o FROM customer)"


def _scored(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("k"), (k % 11 / F.lit(10.0)).alias("f"), (k % 60).alias("v"), (k % 13 / F.lit(2.0)).alias("r"), (k % 9 / F.lit(100.0)).alias("t"), (k % 6).alias("bu"), (k % 4).alias("re"), (k % 5).alias("dm"), (k % 7 / F.lit(20.0)).alias("o"))


@query(f"WITH {_SCORED} SELECT k, round(100 * (20 * ({_PARTS['strength']}) + 15 * ({_PARTS['volume']}) + 30 * ({_PARTS['chance']}) + 15 * ({_PARTS['contexts']}) + 5 * ({_PARTS['off_profile']})) / 85) AS score FROM g")
def group_score(spark, d):
    c = F.col
    return _scored(spark, d).select("k", groups.group_score(c("f"), c("v"), c("r"), c("t"), c("bu"), c("re"), c("dm"), c("o"), F.lit(0.0)).alias("score"))


@query(f"WITH {_SCORED} SELECT k, criterion, {SIX.format('points')} AS points FROM (SELECT k, unnest(['strength', 'contexts', 'off_profile']) AS criterion, unnest([({_PARTS['strength']}) * 50, ({_PARTS['contexts']}) * 37.5, ({_PARTS['off_profile']}) * 12.5]) AS points FROM g)")
def score_points(spark, d):
    c = F.col
    parts = {"strength": (20.0, measures.clip((c("f") - 0.3) / 0.7)), "contexts": (15.0, 0.5 * measures.clip((c("bu") - 1) / 4.0) + 0.25 * measures.clip((c("re") - 1) / 2.0) + 0.25 * measures.clip((c("dm") - 1) / 2.0)), "off_profile": (5.0, measures.clip(c("o") / 0.2))}
    return sheets.score_points(_scored(spark, d), parts).select("k", F.inline("points")).select("k", "criterion", six(c("points"), "points"))


@query(f"WITH {PRESENCES_SQL}, m AS (SELECT company, count(*) AS n FROM presences GROUP BY 1) SELECT company, n, row_number() OVER (ORDER BY n DESC, company) AS place FROM m WHERE n >= 5 QUALIFY place BETWEEN 11 AND 20")
def family_list(spark, d):
    """One page of a list of ten a page: filtered, sorted by size, numbered."""
    n = presences(spark, d).groupBy("company").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
    shown = search.page(n, [F.col("n").desc(), F.col("company")], 2, 10)
    return shown.withColumn("place", (F.row_number().over(W.orderBy(F.col("n").desc(), "company")) + 10).cast("long"))  # ten rows


@query("SELECT user_id AS author, CAST(ts AS DATE) AS created, event_type AS answer, \"group\", count(DISTINCT (a, b)) AS pairs, k >= 3 AND count(DISTINCT (a, b)) = k * (k - 1) / 2 AS whole FROM (SELECT *, '1|2|3' AS \"group\", 3 AS k, event_id % 2 AS a, 2 + event_id % 3 AS b FROM events) GROUP BY 1, 2, 3, 4, k")
def regroup_labels(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("author"), F.to_date("ts").alias("created"), F.col("event_type").alias("answer"), F.lit("1|2|3").alias("group"), (F.col("event_id") % 2).alias("a"), (2 + F.col("event_id") % 3).alias("b"))
    return sheets.regroup(e)


@query("SELECT user_id, CASE WHEN bool_or(event_type = 'error') THEN 'conteste' WHEN bool_or(event_type = 'purchase') THEN 'confirme' END AS status FROM events GROUP BY 1")
def label_status(spark, d):
    answer = F.when(F.col("event_type") == "error", "non").when(F.col("event_type") == "purchase", "oui").otherwise("nsp")
    return marts.label_status(table(spark, d, "events").select("user_id", answer.alias("answer")), ["user_id"])


# submissions


def _submissions(spark, d):
    price = F.floor(F.col("o_totalprice") * 100 + 0.5)
    return table(spark, d, "orders").select(price.alias("price"), F.floor(price * 0.8).alias("cost"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus") == "F").alias("won"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("closing"))


_SUBMISSIONS = "s AS (SELECT p AS price, CAST(floor(p * 0.8::DOUBLE) AS BIGINT) AS cost, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus = 'F' END AS won, o_orderdate AS closing FROM (SELECT *, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS p FROM orders))"


@query(f"WITH {_SUBMISSIONS} SELECT count(*) AS submissions, count(*) FILTER (won IS NULL) AS waiting, count(won) AS judged, count(*) FILTER (won) AS won, avg(CAST(won AS INT)) AS win_rate, {SIX.format('avg((price - cost) / cost) FILTER (won)')} AS margin, CAST(sum(price - cost) FILTER (won) AS BIGINT) AS gain FROM s")
def submissions_balance(spark, d):
    return sheets.balance(_submissions(spark, d)).withColumn("margin", F.floor(F.col("margin") * 1e6 + 0.5) / F.lit(1e6))


@query(f"WITH {_SUBMISSIONS} SELECT count(*) FILTER (CAST(closing AS DATE) >= DATE '1998-06-01') AS in_progress FROM s")
def submissions_in_progress(spark, d):
    return sheets.in_progress(_submissions(spark, d), "1998-06-01")


@query(f"WITH {BIDS_SQL} SELECT unit, bidder AS company, CASE WHEN bool_or(status = 'R') THEN 'attributaire' WHEN bool_or(status = 'A') THEN 'admis' ELSE 'ecarte' END AS best FROM bids GROUP BY 1, 2")
def presence_by_status(spark, d):
    return sheets.presence_by_status(bids(spark, d).withColumnRenamed("bidder", "company"), ("A",), "R")


# years, orders and lookups


@query("""WITH y AS (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE strftime(o_orderdate, '%Y') END AS year, count(*) AS n FROM orders GROUP BY 1), k AS (SELECT *, year <> '' AND n >= 0.1 * (SELECT sum(n) FROM y) AS kept FROM y)
 SELECT CASE WHEN kept THEN year ELSE 'incertaine' END AS year, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY 1""")
def year_remainder(spark, d):
    """The menu of years with the remainder, here of years below a tenth of the tenders."""
    rows = tenders(spark, d).withColumn("year", marts.year_of(F.date_format("day", "yyyyMMdd"), F.col("priority") == "5-LOW"))
    return marts.year_options(rows, "year", 2000, 0.1)


@query("""WITH r AS (SELECT l_suppkey AS company, o_custkey AS buyer, CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE strftime(o_orderdate, '%Y') END AS year FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
 y AS (SELECT company, CASE WHEN year IN ('1996', '1997', '1998') THEN year ELSE 'incertaine' END AS year, buyer FROM r) SELECT company, year, count(*) AS bids, count(DISTINCT buyer) AS buyers FROM y GROUP BY 1, 2""")
def yearly_reaggregation(spark, d):
    """Sums of yearly tables; the distinct buyers of the mixed bucket are counted from the rows."""
    rows = bids(spark, d).select("unit", F.col("bidder").alias("company")).join(tenders(spark, d).select("unit", "buyer", marts.year_of(F.date_format("day", "yyyyMMdd"), F.col("priority") == "5-LOW").alias("year")), "unit")
    return marts.regrouped_years(rows, "company", "year", ["1996", "1997", "1998"], "buyer")


@query(f"{FULL_SQL}, g AS (SELECT buyer, status, CASE WHEN reference BETWEEN t.estimation / 8 AND t.estimation * 8 THEN round_even((reference - t.estimation) / t.estimation * 100, 2) END AS gap FROM prices JOIN tenders t USING (unit)) SELECT buyer, count(*) AS tenders, count(*) FILTER (status = 'F') AS closed, {SIX.format('avg(gap)')} AS mean_gap FROM g GROUP BY 1")
def mean_gap_and_status(spark, d):
    rows = _prices(spark, d).select("unit", "reference").join(tenders(spark, d), "unit").withColumn("gap", measures.gap_percent(F.col("reference"), F.col("estimation")))
    return rows.groupBy("buyer").agg(F.count(F.lit(1)).alias("tenders"), F.count_if(F.col("status") == "F").alias("closed"), six(F.avg("gap"), "mean_gap"))


@query("SELECT min(d) AS first, max(d) AS last, count(*) AS safe FROM (SELECT strftime(o_orderdate, '%Y%m%d') AS d FROM orders WHERE o_orderpriority <> '5-LOW')")
def safe_date_bounds(spark, d):
    rows = tenders(spark, d).where("priority <> '5-LOW'").select(F.date_format("day", "yyyyMMdd").alias("d"))
    return rows.agg(F.min("d").alias("first"), F.max("d").alias("last"), F.count(F.lit(1)).alias("safe"))


@query("SELECT o_custkey AS buyer, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, buyer LIMIT 10")
def top_buyers(spark, d):
    return tenders(spark, d).groupBy("buyer").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "buyer").limit(10)


@query("SELECT o_orderstatus AS source, o_orderpriority AS quality, count(*) AS n, count(DISTINCT o_custkey) AS buyers FROM orders GROUP BY 1, 2")
def source_breakdown(spark, d):
    return tenders(spark, d).groupBy(F.col("status").alias("source"), F.col("priority").alias("quality")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("buyer").alias("buyers"))


@query(f"{OFFERS_SQL} SELECT unit, company, row_number() OVER (PARTITION BY unit ORDER BY rank NULLS LAST, amount NULLS LAST, company) AS place FROM offers")
def commission_display_order(spark, d):
    place = F.row_number().over(W.partitionBy("unit").orderBy(F.col("rank").asc_nulls_last(), F.col("amount").asc_nulls_last(), "company"))
    return _offers(spark, d).select("unit", "company", place.cast("long").alias("place"))


_LOTS = "(SELECT p_brand, p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'lot ' || p_partkey % 7 ELSE CAST(p_partkey % 30 AS VARCHAR) END AS lot FROM part)"


def _lots(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_brand", k, F.when(k % 5 == 0, F.concat(F.lit("lot "), k % 7)).otherwise((k % 30).cast("string")).alias("lot"))


@query(f"SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY coalesce(try_cast(lot AS INT), 0), p_partkey) AS by_number, row_number() OVER (PARTITION BY p_brand ORDER BY length(lot), lot, p_partkey) AS by_length FROM {_LOTS}")
def lot_orders(spark, d):
    """Lots by their number (a text counts 0), and by length and text."""
    place = lambda *by: F.row_number().over(W.partitionBy("p_brand").orderBy(*by, "p_partkey")).cast("long")
    return _lots(spark, d).select("p_brand", "p_partkey", place(search.lot_number("lot")).alias("by_number"), place(F.length("lot"), F.col("lot")).alias("by_length"))


@query("SELECT o_orderkey AS unit, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END ASC NULLS FIRST, o_orderkey) AS place FROM orders QUALIFY place <= 40")
def plain_sort(spark, d):
    """The first forty by a column in which missing values are the smallest."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("unit"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")).alias("p"))
    order = [F.col("p").asc_nulls_first(), F.col("unit")]
    return rows.orderBy(*order).limit(40).select("unit", F.row_number().over(W.orderBy(*order)).cast("long").alias("place"))  # forty rows


@query("""WITH e AS (SELECT o_orderkey AS ref, o_custkey AS buyer, o_orderpriority AS reference, o_totalprice AS estimation FROM orders WHERE o_orderkey % 2 = 0), f AS (SELECT buyer, reference, arg_min(estimation, ref) AS estimation FROM e GROUP BY 1, 2)
 SELECT o_orderkey AS ref, coalesce(e.estimation, f.estimation) AS estimation FROM orders LEFT JOIN e ON e.ref = o_orderkey LEFT JOIN f ON f.buyer = o_custkey AND f.reference = o_orderpriority""")
def two_key_lookup(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("ref"), F.col("o_custkey").alias("buyer"), F.col("o_orderpriority").alias("reference"), F.col("o_totalprice").alias("estimation"))
    return search.lookup_with_fallback(o.drop("estimation"), o.where("ref % 2 = 0"), ["ref"], ["buyer", "reference"], "estimation", "ref").select("ref", "estimation")


@query("SELECT p_partkey AS part FROM part WHERE contains(replace(upper(p_brand), ' ', ''), 'BRAND#2')")
def reference_like(spark, d):
    return table(spark, d, "part").where(search.reference_contains(F.col("p_brand"), " brand #2")).select(F.col("p_partkey").alias("part"))


@query("SELECT c_custkey AS buyer, n, total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, CAST(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS BIGINT) AS total FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey")
def buyer_aggregate_lookup(spark, d):
    """Aggregates of each buyer, null where there is no history."""
    agg = table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("buyer")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("o_totalprice") * 100 + 0.5)).alias("total"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("buyer")).join(agg, "buyer", "left")


@query(f"WITH {TENDERS_SQL} SELECT unit, estimation FROM tenders WHERE estimation IS NOT NULL AND status = 'F' AND estimation BETWEEN 1e6 AND 2e7")
def conjunctive_filters(spark, d):
    c = F.col("estimation")
    return search.where_all(tenders(spark, d), [c.isNotNull(), F.col("status") == "F", c >= 1e6, c <= 2e7]).select("unit", "estimation")


@query("SELECT p_partkey AS part, CASE WHEN lower(p_name) = 'small widget' THEN 0 WHEN starts_with(lower(p_name), 'small') AND FALSE THEN 1 WHEN contains(lower(p_name), 'small widget') THEN 2 END AS rank FROM part")
def match_ranks(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("part"), search.match_rank(F.col("p_name"), "Small  Widget").alias("rank"))


@query("SELECT p_partkey AS part, p_name FROM part WHERE contains(lower(p_name), 'idge') AND contains(lower(p_name), 'mal')")
def search_fallback(spark, d):
    """No word begins like this, so that substrings are looked for."""
    return search.search_with_fallback(table(spark, d, "part").select(F.col("p_partkey").alias("part"), "p_name"), "p_name", "idge mal")


@query("SELECT p_brand AS brand, arg_min(p_name, (-n, length(p_name), p_name)) AS name FROM (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY 1, 2) GROUP BY 1")
def most_frequent_name(spark, d):
    return marts.most_frequent(table(spark, d, "part").withColumnRenamed("p_brand", "brand"), ["brand"], "p_name", "name")
