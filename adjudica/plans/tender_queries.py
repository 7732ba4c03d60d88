"""Tender queries over the driver's star schema; each value is (callable, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from adjudica.functions import measures, text
from adjudica.operators import asof, commission, copresence, decide, groups, marts, names, rates, search, similarity, simulate, tracking
from adjudica.operators.components import stored
from adjudica.operators.bidders import calibration_bins, count_law
from adjudica.plans.adapter import BIDS_SQL, CANDIDATES_SQL, FULL_SQL, PRESENCES_SQL, TENDERS_SQL, bids, events, presences, prices_sql, ranked_sql, row_tasks, table, tenders
from adjudica.sources import readers, sinks
from adjudica.streaming import limits

CATALOGUE: dict = {}


def query(sql: str | None = None):
    def register(fn):
        CATALOGUE[fn.__name__] = (fn, sql)
        return fn

    return register


def _candidates(spark: SparkSession, d: str, unit: tuple[str, ...] = ("unit",)) -> DataFrame:
    return commission.candidate_bids(bids(spark, d), list(unit))


def _prices(spark: SparkSession, d: str) -> DataFrame:
    return commission.reference_prices(_candidates(spark, d), tenders(spark, d), ["unit"], None)


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return commission.commission_rank(_candidates(spark, d), _prices(spark, d), ["unit"])


# commission


@query(f"{FULL_SQL} SELECT unit, seq, bidder, amount, reference, rank FROM ranked")
def commission_rank(spark, d):
    return _ranked(spark, d).select("unit", "seq", "bidder", "amount", "reference", F.col("rank").cast("long").alias("rank"))


@query(f"{FULL_SQL} SELECT * FROM prices")
def reference_price(spark, d):
    return _prices(spark, d)


@query(f"WITH {BIDS_SQL}, lt AS (SELECT unit, lot, floor(sum(amount) / count(*) + 0.5) AS estimation FROM bids GROUP BY ALL), {CANDIDATES_SQL.replace('PARTITION BY unit', 'PARTITION BY unit, lot')}, {prices_sql('unit, lot', 'cand', 'lt').replace('a.unit = t.unit', 'a.unit = t.unit AND a.lot = t.lot')} SELECT * FROM prices")
def lot_reference_price(spark, d):
    lots = bids(spark, d).groupBy("unit", "lot").agg(F.floor(F.sum("amount") / F.count(F.lit(1)) + 0.5).cast("double").alias("estimation"))
    return commission.reference_prices(_candidates(spark, d, ("unit", "lot")), lots, ["unit", "lot"], None)


@query(f"{FULL_SQL}, low AS (SELECT unit, arg_min(bidder, (amount, seq)) AS lowest FROM ranked GROUP BY 1), c AS (SELECT unit, bidder FROM ranked WHERE rank = 1) SELECT count(*) AS units, count(*) FILTER (lowest = bidder) AS same FROM low JOIN c USING (unit)")
def lowest_price_vs_rule(spark, d):
    ranked = _ranked(spark, d)
    per = ranked.groupBy("unit").agg(F.min_by("bidder", F.struct("amount", "seq")).alias("lowest"), F.max(F.when(F.col("rank") == 1, F.col("bidder"))).alias("chosen"))
    return per.agg(F.count(F.lit(1)).alias("units"), F.count_if(F.col("lowest") == F.col("chosen")).alias("same"))


_BRACKET = "CASE WHEN {0} <= 2 THEN '1-2' WHEN {0} <= 4 THEN '3-4' WHEN {0} <= 7 THEN '5-7' ELSE '8+' END"


@query(f"{FULL_SQL}, w AS (SELECT unit, min(bidder) AS winner, count(*) AS k FROM bids WHERE status = 'A' GROUP BY 1) SELECT {_BRACKET.format('k')} AS bracket, count(*) AS n, count(*) FILTER (bidder = winner) AS agreed FROM ranked JOIN w USING (unit) WHERE rank = 1 GROUP BY 1")
def rule_concordance_by_bracket(spark, d):
    winners = bids(spark, d).where("status = 'A'").groupBy("unit").agg(F.min("bidder").alias("bidder"), F.count(F.lit(1)).alias("k"))
    return commission.concordance(_ranked(spark, d), winners, ["unit"], [measures.offers_bracket(F.col("k")).alias("bracket")])


_RATES = [0.85, 0.9, 0.95, 1.0]


@query(
    f"WITH {BIDS_SQL}, {TENDERS_SQL}, {CANDIDATES_SQL}, g AS (SELECT unnest([0.85, 0.9, 0.95, 1.0]::DOUBLE[]) AS rate), own AS (SELECT t.unit, rate, estimation FROM tenders t, g WHERE estimation > 0 AND unit IN (SELECT unit FROM cand)), "
    f"allb AS (SELECT c.unit, rate, seq, amount FROM cand c JOIN own o ON o.unit = c.unit UNION ALL SELECT unit, rate, 1152921504606846976, rate * estimation FROM own), {prices_sql('unit, rate', 'allb', 'own').replace('a.unit = t.unit', 'a.unit = t.unit AND a.rate = t.rate')}, {ranked_sql('unit, rate', 'allb')} "
    "SELECT unit, rate, rank FROM ranked WHERE seq = 1152921504606846976"
)
def fictitious_bid_grid(spark, d):
    return commission.replay_with_bid(_candidates(spark, d), tenders(spark, d), ["unit"], _RATES, None).select("unit", "rate", F.col("rank").cast("long").alias("rank"))


@query(f"{FULL_SQL}, e AS (SELECT unit, amount, seq, estimation FROM cand JOIN tenders USING (unit) WHERE estimation > 0) SELECT CAST(CASE WHEN amount < estimation / 8 OR amount > estimation * 8 THEN 1 ELSE 0 END AS INT) AS off, count(*) AS n FROM e GROUP BY 1")
def off_scale_bids(spark, d):
    rows = _candidates(spark, d).join(tenders(spark, d).where("estimation > 0").select("unit", "estimation"), "unit")
    return rows.groupBy(measures.off_scale(F.col("amount"), F.col("estimation")).cast("int").alias("off")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{FULL_SQL}, b AS (SELECT unit, amount AS best FROM ranked WHERE rank = 1), l AS (SELECT bidder, (amount - best) / best * 100 AS gap FROM ranked JOIN b USING (unit) WHERE rank > 1) SELECT bidder, count(*) AS lost, median(gap) AS median_gap FROM l GROUP BY 1")
def lost_units_gaps(spark, d):
    return copresence.lost_gaps(_ranked(spark, d), ["unit"])


# aggregates


def _year(c):
    return F.date_format(c, "yyyy")


@query(f"{FULL_SQL} SELECT bidder, count(*) AS bids, count(*) FILTER (rank = 1) AS wins, CAST(coalesce(sum(amount) FILTER (rank = 1), 0) AS DOUBLE) AS won, count(DISTINCT buyer) AS buyers FROM ranked JOIN tenders USING (unit) GROUP BY 1")
def company_totals(spark, d):
    rows = _ranked(spark, d).join(tenders(spark, d).select("unit", "buyer"), "unit")
    return rows.groupBy("bidder").agg(F.count(F.lit(1)).alias("bids"), F.count_if(F.col("rank") == 1).alias("wins"), F.sum(F.when(F.col("rank") == 1, F.col("amount")).otherwise(0.0)).alias("won"), F.count_distinct("buyer").alias("buyers"))


@query(f"WITH {BIDS_SQL} SELECT bidder, CASE WHEN grouping(y) = 1 THEN 'all' ELSE y END AS year, count(*) AS bids, count(DISTINCT unit) AS units FROM (SELECT bidder, unit, strftime(shipped, '%Y') AS y FROM bids) GROUP BY GROUPING SETS ((bidder), (bidder, y))")
def company_year_grouping_sets(spark, d):
    rows = bids(spark, d).select("bidder", "unit", _year("shipped").alias("y"))
    out = marts.by_key_and_year(rows, "bidder", "y", [F.count(F.lit(1)).alias("bids"), F.count_distinct("unit").alias("units")])
    return out.select("bidder", F.when(F.col("is_total") == 1, "all").otherwise(F.col("y")).alias("year"), "bids", "units")


@query("SELECT o_custkey AS buyer, count(*) AS tenders, count(*) FILTER (o_orderstatus = 'F') AS awarded, count(*) FILTER (o_orderstatus = 'P') AS unsuccessful, CAST(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY 1")
def buyer_totals(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("buyer")).agg(F.count(F.lit(1)).alias("tenders"), F.count_if(F.expr("o_orderstatus = 'F'")).alias("awarded"), F.count_if(F.expr("o_orderstatus = 'P'")).alias("unsuccessful"), F.sum(F.floor(F.col("o_totalprice") * 100 + 0.5)).alias("cents"))


@query(
    f"WITH {BIDS_SQL}, {TENDERS_SQL}, b AS (SELECT unit, min(amount) AS best, count(*) AS k FROM bids GROUP BY 1), u AS (SELECT t.unit, buyer, k, CASE WHEN estimation > 0 THEN (estimation - best) / estimation * 100 END AS gap FROM tenders t LEFT JOIN b USING (unit)) "
    "SELECT buyer, count(DISTINCT unit) AS tenders, median(gap) AS median_gap, 100 * avg(CASE WHEN gap > 0 THEN 1.0::DOUBLE WHEN gap IS NOT NULL THEN 0.0 END) AS share_below, median(k) AS median_bidders FROM u GROUP BY 1"
)
def buyer_medians(spark, d):
    best = bids(spark, d).groupBy("unit").agg(F.min("amount").alias("best"))
    units = tenders(spark, d).select("unit", F.col("unit").alias("ref"), "buyer", "estimation").join(best, "unit", "left")
    return marts.buyer_medians(units, bids(spark, d).select("unit"))


@query("SELECT (SELECT count(*) FROM orders) AS tenders, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS awarded, (SELECT count(DISTINCT o_custkey) FROM orders) AS buyers, (SELECT count(*) FROM lineitem) AS bids, (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS companies")
def dashboard_stats(spark, d):
    a = table(spark, d, "orders").agg(F.count(F.lit(1)).alias("tenders"), F.count_if(F.expr("o_orderstatus = 'F'")).alias("awarded"), F.count_distinct("o_custkey").alias("buyers"))
    b = table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("bids"), F.count_distinct("l_suppkey").alias("companies"))
    return a.join(F.broadcast(b))  # one row each


@query("WITH y AS (SELECT strftime(o_orderdate, '%Y') AS year, count(*) AS n FROM orders GROUP BY 1) SELECT year, n, year <= '2000' AND (n / (SELECT sum(n) FROM y) >= 0.01 OR year = '2000') AS kept FROM y")
def year_buckets(spark, d):
    return marts.year_menu(table(spark, d, "orders").withColumn("year", _year("o_orderdate")), "year", 2000)


@query("SELECT o_orderkey AS unit, strftime(o_orderdate, '%Y%m%d') AS sort_date FROM orders WHERE strftime(o_orderdate, '%Y%m%d') BETWEEN '19970101' AND '19971231' AND o_orderpriority <> '5-LOW'")
def year_filter_range(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("unit"), F.date_format("o_orderdate", "yyyyMMdd").alias("sort_date"), (F.col("o_orderpriority") == "5-LOW").alias("doubtful"))
    return search.year_filter(rows, "1997", ["1997"]).drop("doubtful")


@query("SELECT o_orderkey AS unit FROM orders WHERE NOT (strftime(o_orderdate, '%Y') IN ('1996', '1997', '1998') AND o_orderpriority <> '5-LOW')")
def year_filter_uncertain(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("unit"), F.date_format("o_orderdate", "yyyyMMdd").alias("sort_date"), (F.col("o_orderpriority") == "5-LOW").alias("doubtful"))
    return search.year_filter(rows, "incertaine", ["1996", "1997", "1998"]).select("unit")


@query(f"{FULL_SQL}, w AS (SELECT unit, min(bidder) AS winner FROM bids WHERE status = 'A' GROUP BY 1) SELECT unit, bidder AS designated, winner FROM ranked JOIN w USING (unit) WHERE rank = 1 AND bidder <> winner")
def anomaly_filter(spark, d):
    winners = bids(spark, d).where("status = 'A'").groupBy("unit").agg(F.min("bidder").alias("winner"))
    return _ranked(spark, d).where("rank = 1").join(winners, "unit").where("bidder <> winner").select("unit", F.col("bidder").alias("designated"), "winner")


@query("SELECT DISTINCT l_orderkey AS unit FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type = 'SMALL' AND l_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#4')")
def semi_qualification(spark, d):
    quals = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("ref"), "p_type", "p_brand")
    return search.having_qualification(quals.select("ref").distinct(), quals, p_type="SMALL", p_brand="Brand#4").select(F.col("ref").alias("unit"))


@query("SELECT c_custkey AS buyer FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def exists_client(spark, d):
    p = table(spark, d, "orders").where("o_orderstatus = 'P'")
    return table(spark, d, "customer").join(p, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.col("c_custkey").alias("buyer"))


@query("SELECT o_orderkey AS unit FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def anti_unmatched(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select(F.col("o_orderkey").alias("unit"))


@query("SELECT o_orderkey AS unit, (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_orderkey = o_orderkey) AS companies FROM orders")
def scalar_count_distinct(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("unit")).agg(F.count_distinct("l_suppkey").alias("companies"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("unit")).join(n, "unit", "left").na.fill(0, ["companies"])


@query(f"{FULL_SQL}, w AS (SELECT buyer, bidder, count(*) AS wins FROM ranked JOIN tenders USING (unit) WHERE rank = 1 GROUP BY ALL) SELECT buyer, bidder, wins, row_number() OVER (PARTITION BY buyer ORDER BY wins DESC, bidder) AS rank FROM w QUALIFY rank <= 8")
def top_winners_per_buyer(spark, d):
    wins = _ranked(spark, d).where("rank = 1").join(tenders(spark, d).select("unit", "buyer"), "unit").groupBy("buyer", "bidder").agg(F.count(F.lit(1)).alias("wins"))
    return marts.top_per_key(wins, "buyer", [F.col("wins").desc(), F.col("bidder")], 8).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT l_suppkey AS company, p_type, p_brand, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL")
def qualification_profile(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("l_suppkey").alias("company"), "p_type", "p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_brand, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def facets(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return search.facet(rows, "p_brand", "l_orderkey")


@query("SELECT o_orderkey AS unit, o_totalprice AS total FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25 OFFSET 50")
def paged_sorted(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("unit"), F.col("o_totalprice").alias("total"))
    return search.page(rows, [search.nulls_last("total", True, ("total", "unit")), F.col("unit")], 3, 25)


@query("SELECT p_partkey AS part, p_name FROM part WHERE list_bool_or([starts_with(t, 'sma') FOR t IN string_split(lower(p_name), ' ')]) AND list_bool_or([starts_with(t, 'wid') FOR t IN string_split(lower(p_name), ' ')])")
def token_search(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("part"), "p_name")
    return search.search_with_fallback(rows, "p_name", "sma wid")


@query("SELECT p_partkey AS part, p_name FROM part WHERE contains(lower(p_name), 'ing') AND contains(lower(p_name), 'ed')")
def substring_all_words(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("part"), "p_name").where(search.all_words(F.col("p_name"), "ing ED"))


@query("SELECT user_id, event_type, count(*) AS n, min(CAST(ts AS DATE)) AS first_day, max(CAST(ts AS DATE)) AS last_day FROM events GROUP BY ALL")
def log_report(spark, d):
    day = F.to_date("ts")
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS visitors FROM events GROUP BY 1")
def log_per_day(spark, d):
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("visitors"))


@query("WITH g AS (SELECT o_custkey AS k, sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS s FROM orders GROUP BY 1), y AS (SELECT o_custkey AS k, sum(s) AS p FROM (SELECT o_custkey, year(o_orderdate), sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS s FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1, 2) GROUP BY 1) SELECT k AS buyer, CAST(s AS BIGINT) AS cents, CAST(p AS BIGINT) AS parts FROM g FULL JOIN y USING (k) WHERE coalesce(s, 0) <> coalesce(p, 0)")
def year_reconciliation(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("buyer"), F.year("o_orderdate").alias("y"), F.floor(F.col("o_totalprice") * 100 + 0.5).alias("cents"), "o_orderpriority")
    total, parts = o.groupBy("buyer").agg(F.sum("cents").alias("cents")), o.where("o_orderpriority <> '5-LOW'").groupBy("buyer", "y").agg(F.sum("cents").alias("cents"))
    return marts.reconcile(total, parts, ["buyer"], "cents").withColumnRenamed("_parts", "parts")


# ingest and sinks


@query("SELECT o_custkey AS buyer, o_orderpriority AS priority, max_by(o_orderkey, (o_totalprice, -o_orderkey)) AS main, count(*) AS versions FROM orders GROUP BY ALL")
def version_pick(spark, d):
    o = table(spark, d, "orders")
    best = sinks.last_per_key(o, ["o_custkey", "o_orderpriority"], [F.col("o_totalprice").desc(), F.col("o_orderkey")])
    n = o.groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("versions"))
    return best.join(n, ["o_custkey", "o_orderpriority"]).select(F.col("o_custkey").alias("buyer"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("main"), "versions")


_HALF = "1998-01-01"


@query(f"WITH a AS (SELECT user_id, arg_max(event_type, event_id) AS kind, arg_max(value, event_id) AS value FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id, arg_max(event_type, event_id) AS kind, arg_max(CASE WHEN value >= 10 THEN value END, event_id) FILTER (value >= 10) AS value FROM events WHERE event_id % 2 = 1 GROUP BY 1) SELECT user_id, coalesce(b.value, a.value) AS value, CASE WHEN b.user_id IS NOT NULL THEN b.kind ELSE a.kind END AS kind FROM a FULL JOIN b USING (user_id)")
def upsert_coalesce(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("kind"), "value")
    old, new = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1").withColumn("value", F.when(F.col("value") >= 10, F.col("value")))
    fold = lambda rows: sinks.fold_batch(rows, "user_id", "event_id", ["value"], ["kind"])
    return sinks.upsert(fold(old), fold(new), "user_id", ["value"], ["kind"])


@query("SELECT DISTINCT user_id, event_type FROM events")
def set_merge_children(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return sinks.merge_set(e.where("event_id % 3 = 0").select("user_id", "event_type").distinct(), e.where("event_id % 3 > 0").select("user_id", "event_type"), ["user_id", "event_type"])


@query("WITH n AS (SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_returnflag = 'A') SELECT * FROM n UNION ALL SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM n)")
def replace_children(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    return sinks.replace_children(rows.drop("l_returnflag"), rows.where("l_returnflag = 'A'").drop("l_returnflag"), "l_orderkey")


@query("WITH a AS (SELECT o_custkey AS k, min(o_orderkey) AS first, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, min(o_orderkey) AS first, CAST(NULL AS BIGINT) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT k, coalesce(b.first, a.first) AS first, coalesce(b.n, a.n) AS n, b.k IS NOT NULL AS from_portal FROM a FULL JOIN b USING (k)")
def full_outer_precedence(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    ocr = o.where("o_orderstatus = 'F'").groupBy("k").agg(F.min("o_orderkey").alias("first"), F.count(F.lit(1)).alias("n"))
    portal = o.where("o_orderstatus = 'P'").groupBy("k").agg(F.min("o_orderkey").alias("first")).withColumn("n", F.lit(None).cast("long"))
    return readers.portal_wins(ocr, portal, "k", ["first", "n"])


@query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'ajout' WHEN b.k IS NULL THEN 'retrait' ELSE 'changement' END AS kind FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate < DATE '1998-01-01' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate >= DATE '1998-01-01' GROUP BY 1) b ON a.k = b.k WHERE a.n IS DISTINCT FROM b.n")
def change_feed(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderdate")
    side = lambda c: o.where(c).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return sinks.changes(side(F.col("o_orderdate") < F.lit(_HALF).cast("date")), side(F.col("o_orderdate") >= F.lit(_HALF).cast("date")), ["k"], ["n"]).select("k", "kind")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS unit, o_custkey AS buyer, 0 AS lots FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT DISTINCT o_orderkey || '#' || l_linestatus, o_custkey, 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'")
def units_union_lots(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    simple = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").cast("string").alias("unit"), F.col("o_custkey").alias("buyer"), F.lit(0).alias("lots"))
    multi = o.where("o_orderstatus = 'P'").join(li, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat_ws("#", F.col("o_orderkey").cast("string"), "l_linestatus").alias("unit"), F.col("o_custkey").alias("buyer"), F.lit(1).alias("lots")).distinct()
    return simple.unionByName(multi)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""SELECT DISTINCT page_id AS id, regexp_extract(a, 'href="([^"]*)"', 1) AS href, trim(regexp_extract(a, '>([^<]*)</a>', 1)) AS text FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS a FROM pages)""")
def html_links(spark, d):
    return readers.page_links(table(spark, d, "pages"), "page_id", "html")


@query("SELECT page_id, contains(html, '<article') AS has_article, contains(html, 'class=\"ad\"') AS has_ad, regexp_matches(html, '<b>[^<]*<br>') AS has_open_bold FROM pages")
def page_features(spark, d):
    return readers.feature_flags(table(spark, d, "pages"), "html", {"has_article": "<article", "has_ad": 'class="ad"', "has_open_bold": "<b>[^<]*<br>"}).select("page_id", "has_article", "has_ad", "has_open_bold")


# text


@query("SELECT doc_id, strip_accents(lower(text)) AS folded FROM documents WHERE lang = 'fr'")
def accent_fold(spark, d):
    return table(spark, d, "documents").where("lang = 'fr'").select("doc_id", text.fold_accents(F.col("text")).alias("folded"))


@query("SELECT r_regionkey AS region, CASE WHEN contains(r_name, 'AFRICA') THEN 'Sud' WHEN contains(r_name, 'MIDDLE EAST') THEN 'Est' WHEN contains(r_name, 'EUROPE') THEN 'Nord' END AS zone FROM region")
def region_from_name(spark, d):
    return table(spark, d, "region").select(F.col("r_regionkey").alias("region"), text.region_of(F.col("r_name"), {"Sud": ["AFRICA"], "Est": ["MIDDLE EAST", "EAST"], "Nord": ["EUROPE"]}).alias("zone"))


@query("SELECT p_partkey AS part, CASE WHEN regexp_matches(p_name, '(^| )(rings?|bolts?)($| )') THEN 'fixation' WHEN regexp_matches(p_name, '(^| )widg[a-z]*($| )') THEN 'divers' ELSE 'autre' END AS family FROM part")
def family_classify(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("part"), text.classify(F.col("p_name"), [("fixation", ["ring", "bolt"]), ("divers", ["widg*"])], "autre").alias("family"))


@query("SELECT o_orderkey AS unit, o_totalprice AS amount FROM orders")
def amount_parse(spark, d):
    written = F.concat(F.replace(F.format_number("o_totalprice", 2), F.lit(","), F.lit(" ")), F.lit(" DH"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("unit"), text.parse_amount(F.translate(written, ".", ",")).alias("amount"))


@query("WITH o AS (SELECT o_orderkey AS unit, CAST(o_orderdate AS DATE) AS opened, CAST(o_orderdate AS DATE) - CAST(o_orderkey % 3 AS INT) AS published FROM orders) SELECT unit, strftime(CASE WHEN opened > published + 1 THEN published ELSE opened END, '%Y%m%d') AS sort_date, opened > published + 1 AS doubtful FROM o")
def date_parse_doubtful(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("unit"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("opened"), F.date_format(F.date_sub(F.to_date("o_orderdate"), (F.col("o_orderkey") % 3).cast("int")), "dd/MM/yyyy").alias("published"))
    day, doubtful = text.sort_day(F.col("opened"), F.col("published"))
    return o.select("unit", day.alias("sort_date"), doubtful.alias("doubtful"))


@query("SELECT s_suppkey AS company, regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS key FROM supplier")
def company_keys(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("company"), text.company_key(F.concat(F.lit("Ste "), F.col("s_name"), F.lit(" SARL"))).alias("key"))


# point in time


@query(f"WITH {PRESENCES_SQL} SELECT unit, company, count(*) OVER (PARTITION BY company ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS before FROM presences")
def asof_prefix_counts(spark, d):
    rows = presences(spark, d).withColumn("n", asof.days("day"))
    return rows.select("unit", "company", F.count(F.lit(1)).over(asof.before(["company"], "n")).alias("before"))


@query(f"WITH {PRESENCES_SQL} SELECT unit, company, count(*) OVER (PARTITION BY company ORDER BY day RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS recent FROM presences")
def sliding_365d(spark, d):
    rows = presences(spark, d).withColumn("n", asof.days("day"))
    return rows.select("unit", "company", F.count(F.lit(1)).over(asof.window_before(["company"], "n", 365)).alias("recent"))


@query(f"WITH {PRESENCES_SQL}, c AS (SELECT unit, company, buyer, count(*) OVER (PARTITION BY company, buyer ORDER BY day RANGE BETWEEN INTERVAL 730 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS n FROM presences) SELECT unit, company, buyer, n FROM c WHERE n >= 2")
def regulars_24m(spark, d):
    rows = presences(spark, d).withColumn("day_n", asof.days("day"))
    return rows.withColumn("n", F.count(F.lit(1)).over(asof.window_before(["company", "buyer"], "day_n", 730))).where("n >= 2").select("unit", "company", "buyer", "n")


@query(f"WITH {BIDS_SQL} SELECT unit, bidder, seq, amount FROM bids QUALIFY row_number() OVER (PARTITION BY unit, bidder ORDER BY seq) = 1")
def first_seen_dedup(spark, d):
    return asof.first_seen(bids(spark, d), ["unit", "bidder"], [F.col("seq")]).select("unit", "bidder", "seq", "amount")


@query(f"WITH {PRESENCES_SQL}, t AS (SELECT o_orderkey AS target, o_custkey AS buyer, CAST(o_orderdate AS DATE) AS at FROM orders WHERE o_orderstatus = 'P') SELECT target, count(*) AS n, count(DISTINCT company) AS companies FROM t JOIN presences p ON p.buyer = t.buyer AND p.day < t.at AND p.day >= t.at - 365 GROUP BY 1")
def asof_range_join(spark, d):
    e = presences(spark, d).select("buyer", "company", asof.days("day").alias("day"))
    t = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("target"), F.col("o_custkey").alias("buyer"), asof.days(F.to_date("o_orderdate")).alias("at"))
    return asof.range_join(e, t, ["buyer"], "day", "at", 365).groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("company").alias("companies"))


@query("WITH f AS (SELECT user_id, CAST(ts AS DATE) AS made, max(event_id) AS copy FROM events WHERE event_type = 'view' GROUP BY ALL), o AS (SELECT user_id, CAST(max(ts) AS DATE) - 10 AS opened FROM events GROUP BY 1) SELECT user_id, opened, coalesce(arg_max(copy, made) FILTER (made <= opened), arg_min(copy, made)) AS copy FROM o LEFT JOIN f USING (user_id) GROUP BY ALL")
def frozen_asof_compare(spark, d):
    e = table(spark, d, "events").withColumn("made", F.to_date("ts"))
    frozen = e.where("event_type = 'view'").groupBy("user_id", "made").agg(F.max("event_id").alias("copy"))
    outcome = e.groupBy("user_id").agg(F.date_sub(F.max("made"), 10).alias("opened"))
    return asof.latest_copy(frozen, outcome, ["user_id"], "made", "opened").select("user_id", "opened", "copy")


# co-presence


@query(f"WITH {PRESENCES_SQL} SELECT a.company AS a, b.company AS b, count(*) AS together FROM presences a JOIN presences b ON a.unit = b.unit AND a.company < b.company GROUP BY 1, 2")
def copresence_pairs(spark, d):
    return copresence.shared_units(presences(spark, d))


_EXPECTED = "n AS (SELECT buyer, company, count(*) AS n FROM presences GROUP BY 1, 2), u AS (SELECT buyer, count(DISTINCT unit) AS units FROM presences GROUP BY 1), ex AS (SELECT a.company AS a, b.company AS b, sum(a.n * b.n * 1.0::DOUBLE / units) AS expected FROM n a JOIN n b ON a.buyer = b.buyer AND a.company < b.company JOIN u ON u.buyer = a.buyer GROUP BY 1, 2)"


@query(f"WITH {PRESENCES_SQL}, {_EXPECTED}, tg AS (SELECT DISTINCT a.company AS a, b.company AS b FROM presences a JOIN presences b ON a.unit = b.unit AND a.company < b.company) SELECT a, b, floor(expected * 1000 + 0.5) / 1000 AS expected FROM ex JOIN tg USING (a, b)")
def expected_pairs(spark, d):
    """Pairs that met at least once; the others have no excess to tell."""
    return copresence.met_and_expected(presences(spark, d)).select("a", "b", (F.floor(F.col("expected") * 1000 + 0.5) / F.lit(1000.0)).alias("expected"))


@query(
    f"WITH {PRESENCES_SQL}, {_EXPECTED}, tg AS (SELECT a.company AS a, b.company AS b, count(*) AS c FROM presences a JOIN presences b ON a.unit = b.unit AND a.company < b.company GROUP BY 1, 2), k AS (SELECT company, count(*) AS m FROM presences GROUP BY 1), "
    "x AS (SELECT tg.a, tg.b, c, expected AS e, c / greatest(expected, 1e-9) AS r, c / ka.m AS sa, c / kb.m AS sb, 1 - list_sum([exp(-expected + i * ln(expected) - lgamma(i + 1)) FOR i IN range(0, c)]) AS p FROM tg JOIN ex ON ex.a = tg.a AND ex.b = tg.b JOIN k ka ON ka.company = tg.a JOIN k kb ON kb.company = tg.b) "
    "SELECT a, b, c AS together, CASE WHEN c >= 6 AND r >= 5 AND p < 1e-4 THEN 'fort' WHEN c >= 4 AND r >= 3 AND p < 1e-3 THEN 'moyen' WHEN c >= 5 AND sa >= 0.5 AND sb >= 0.5 THEN 'moyen' WHEN c >= 3 AND r >= 2 AND p < 1e-2 THEN 'faible' END AS level FROM x"
)
def poisson_levels(spark, d):
    return copresence.pairs(presences(spark, d)).select("a", "b", "together", "level")


@query(
    f"{FULL_SQL}, {PRESENCES_SQL}, w AS (SELECT unit, bidder AS winner FROM ranked WHERE rank = 1), wn AS (SELECT winner, count(*) AS k FROM w GROUP BY 1), un AS (SELECT company, count(*) AS k FROM presences GROUP BY 1), "
    "m AS (SELECT p.company AS x, q.company AS y, count(*) AS together, count(*) FILTER (winner = p.company) AS x_wins_with, count(*) FILTER (winner = q.company) AS y_wins_with FROM presences p JOIN presences q ON p.unit = q.unit AND p.company <> q.company LEFT JOIN w ON w.unit = p.unit GROUP BY 1, 2) "
    "SELECT x, y, together, x_wins_with, y_wins_with, coalesce(x_wins_with / wx.k, 0) AS a, together / ux.k AS b, together / uy.k AS c, least(1.0, y_wins_with / wy.k) AS part, CASE WHEN x_wins_with >= 3 AND a / b >= 1.3 AND part >= 0.5 THEN 'noyau' WHEN x_wins_with >= 3 AND (a / b >= 1.3 OR c >= 0.6) THEN 'accompagnatrice' WHEN y_wins_with >= 3 AND a / b < 1 THEN 'concurrent' ELSE 'neutre' END AS reading FROM m LEFT JOIN un ux ON ux.company = x LEFT JOIN un uy ON uy.company = y LEFT JOIN wn wx ON wx.winner = x LEFT JOIN wn wy ON wy.winner = y"
)
def around_company(spark, d):
    wins = _ranked(spark, d).where("rank = 1").select("unit", F.col("bidder").alias("company"))
    return copresence.around(presences(spark, d), wins).select("x", "y", "together", "x_wins_with", "y_wins_with", "a", "b", "c", "part", "reading")


@query(f"WITH {PRESENCES_SQL}, a AS (SELECT p.company AS a, q.company AS b, count(*) AS n FROM presences p JOIN presences q ON p.unit = q.unit AND p.company < q.company WHERE p.day < DATE '1998-01-01' GROUP BY 1, 2), b AS (SELECT DISTINCT p.company AS a, q.company AS b FROM presences p JOIN presences q ON p.unit = q.unit AND p.company < q.company WHERE p.day >= DATE '1998-01-01') SELECT CASE WHEN n >= 6 THEN 'fort' WHEN n >= 3 THEN 'moyen' ELSE 'faible' END AS level, count(*) AS pairs, count(b.a) AS again FROM a LEFT JOIN b ON a.a = b.a AND a.b = b.b GROUP BY 1")
def stability_two_periods(spark, d):
    p = presences(spark, d)
    before = copresence.shared_units(p.where(F.col("day") < F.lit(_HALF).cast("date"))).withColumn("level", F.when(F.col("together") >= 6, "fort").when(F.col("together") >= 3, "moyen").otherwise("faible"))
    return marts.stability(before, copresence.shared_units(p.where(F.col("day") >= F.lit(_HALF).cast("date"))), ["a", "b"])


@query()
def cliques_and_families(spark, d):
    """Maximal cliques of the strongest links and their families; no SQL (tested on hand-made graphs)."""
    pairs_ = copresence.pairs(presences(spark, d), 6)
    edges = pairs_.where("excess >= 1.2 AND together >= 6").select("a", "b")
    return groups.families(groups.maximal_cliques(edges))


@query()
def communities(spark, d):
    edges = copresence.pairs(presences(spark, d), 6).where("excess >= 1.2 AND together >= 6").select("a", "b", F.col("together").alias("weight"))
    return groups.communities(edges)


# similarity


@query()
def tfidf_ngram_cosine(spark, d):
    """The 20 most similar part names of each name that a part whose key divides by 20 bears, by exact n-gram TF-IDF (tested against a brute-force version)."""
    parts = table(spark, d, "part")
    names = parts.groupBy(F.col("p_name").alias("title")).agg(F.min("p_partkey").alias("id"), F.bool_or(F.col("p_partkey") % 20 == 0).alias("asked"))
    weights = similarity.tfidf(similarity.term_counts(names, "id", similarity.title_grams("title")), "id")
    targets = weights.join(names.where("asked").select("id"), "id", "left_semi")
    pairs_ = similarity.cosine(targets, weights, "id", "id").where("target <> base").withColumnRenamed("cosine", "score").withColumn("day", F.lit(0))
    return similarity.best(pairs_, "target", 20, "day", "base").select("target", "base", "score", "rank")


# rates


def _rates(spark, d):
    rows = bids(spark, d).join(tenders(spark, d).where("estimation > 0"), "unit").withColumn("rate", F.col("amount") / F.col("estimation"))
    return rows.where(rates.in_range(F.col("rate")))


_RATES_SQL = f"WITH {BIDS_SQL}, {TENDERS_SQL}, r AS (SELECT b.unit, seq, bidder, buyer, day, priority, amount / estimation AS rate FROM bids b JOIN tenders t USING (unit) WHERE estimation > 0 AND amount / estimation BETWEEN 0.4 AND 1.6)"


@query(f"{_RATES_SQL} SELECT bidder, count(*) AS n, median(rate) AS median FROM r GROUP BY 1")
def rate_medians(spark, d):
    return rates.robust(_rates(spark, d), ["bidder"], "rate").select("bidder", "n", "median")


@query(f"{_RATES_SQL}, m AS (SELECT bidder, median(rate) AS med FROM r GROUP BY 1) SELECT bidder, median(abs(rate - med)) AS mad FROM r JOIN m USING (bidder) GROUP BY 1")
def mad_shrinkage(spark, d):
    return rates.robust(_rates(spark, d), ["bidder"], "rate").select("bidder", "mad")


@query(f"{_RATES_SQL}, w AS (SELECT bidder, rate, pow(0.5, (DATE '2001-08-02' - day) / 365.0::DOUBLE) AS w FROM r), s AS (SELECT bidder, sum(w) AS sw, sum(w * rate) AS sv, sum(w * w) AS ww FROM w GROUP BY 1) SELECT bidder, floor(sw * sw / ww * 1000 + 0.5) / 1000 AS n_eff, floor(sv / sw * 1e6 + 0.5) / 1e6 AS mean FROM s")
def recency_weighted_rate(spark, d):
    rows = _rates(spark, d).withColumn("w", measures.recency(F.datediff(F.lit("2001-08-02").cast("date"), "day"), 365))
    m = rates.weighted_moments(rows, ["bidder"], "rate", "w")
    return m.select("bidder", (F.floor(F.col("n_eff") * 1000 + 0.5) / F.lit(1000.0)).alias("n_eff"), (F.floor(F.col("mean") * 1e6 + 0.5) / F.lit(1e6)).alias("mean"))


_LEVELS = [["bidder", "priority"], ["bidder"], []]


@query(f"{_RATES_SQL}, a AS (SELECT bidder, priority, count(*) AS n FROM r GROUP BY ALL HAVING count(*) >= 100), b AS (SELECT bidder, count(*) AS n FROM r GROUP BY 1 HAVING count(*) >= 100), t AS (SELECT DISTINCT bidder, priority FROM r) SELECT t.bidder, t.priority, CASE WHEN a.n IS NOT NULL THEN 0 WHEN b.n IS NOT NULL THEN 1 ELSE 2 END AS level, coalesce(a.n, b.n, (SELECT count(*) FROM r)) AS n FROM t LEFT JOIN a ON a.bidder = t.bidder AND a.priority = t.priority LEFT JOIN b ON b.bidder = t.bidder")
def segment_fallback(spark, d):
    rows = _rates(spark, d).select("bidder", "priority", "rate")
    segments = rates.widest_first(rows, _LEVELS, "rate", least=100, quantiles=5)
    targets = rows.select("bidder", "priority").distinct().withColumn("id", F.concat_ws("|", "bidder", "priority"))
    found = rates.segment_of(targets, segments, _LEVELS, "id")
    return targets.join(found, "id").select("bidder", "priority", "level", "n")


@query(f"{_RATES_SQL}, u AS (SELECT unit, avg(rate) AS m, ln(count(*)) AS x FROM r GROUP BY 1) SELECT count(*) AS units, floor(regr_slope(m, x) * 1e6 + 0.5) / 1e6 AS slope, floor(regr_intercept(m, x) * 1e6 + 0.5) / 1e6 AS intercept FROM u")
def market_effect_ols(spark, d):
    m = rates.market_effect(_rates(spark, d), "unit", "rate")
    six = lambda c: (F.floor(F.col(c) * 1e6 + 0.5) / F.lit(1e6)).alias(c)
    return m.select("units", six("slope"), six("intercept"))


# models and decision


@query("SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, avg(y) AS observed FROM (SELECT (doc_id % 100) / 100.0::DOUBLE AS p, CAST(quality AS DOUBLE) AS y FROM labels) GROUP BY 1")
def calibration_table(spark, d):
    rows = table(spark, d, "labels").select(((F.col("doc_id") % 100) / F.lit(100.0)).alias("p"), (F.col("quality") == 1).alias("y"))
    return calibration_bins(rows, "p", "y").select("bin", "n", "observed")


@query("SELECT CAST(quality AS INT) AS predicted, CAST(toxic AS INT) AS actual, count(*) AS n FROM labels GROUP BY ALL")
def confusion_labels(spark, d):
    return tracking.confusion(table(spark, d, "labels"), F.col("quality").cast("int"), F.col("toxic").cast("int"))


@query("SELECT user_id, arg_max(event_type, event_id) AS answer FROM events WHERE event_type <> 'view' GROUP BY 1")
def last_decisive_label(spark, d):
    rows = table(spark, d, "events").select("user_id", F.col("event_type").alias("answer"), F.col("event_id").alias("created"), F.col("event_id").alias("id"))
    return marts.last_decisive(rows, ["user_id"], undecided="view")


@query(
    f"WITH {PRESENCES_SQL}, k AS (SELECT buyer, company, count(*) AS n FROM presences GROUP BY ALL), u AS (SELECT buyer, count(DISTINCT unit) AS m FROM presences GROUP BY 1) SELECT buyer, floor(sum(n * 1.0::DOUBLE / m) * 1e6 + 0.5) / 1e6 AS expected FROM k JOIN u USING (buyer) GROUP BY 1"
)
def poisson_binomial(spark, d):
    """Expected number of bidders from the law of their count; its mean is what the check adds up."""
    p = presences(spark, d)
    n, m = p.groupBy("buyer", "company").agg(F.count(F.lit(1)).alias("n")), p.groupBy("buyer").agg(F.count_distinct("unit").alias("m"))
    laws = n.join(m, "buyer").groupBy("buyer").agg(F.sort_array(F.collect_list(F.col("n") / F.col("m"))).alias("p")).withColumn("law", count_law(F.col("p")))
    mean = F.aggregate(F.transform("law", lambda v, k: v * k), F.lit(0.0), lambda s, v: s + v)
    return laws.select("buyer", (F.floor(mean * 1e6 + 0.5) / F.lit(1e6)).alias("expected"))


def _curve(spark, d):
    """Share of the units that each fixed rate of the grid wins, by priority class."""
    return simulate.fixed_rate_curve(_candidates(spark, d), tenders(spark, d), ["unit"], "priority")


def _signals(spark, d):
    """(unit, priority, and the signals of the decision) of each open tender with an estimation. Today is the last day of the tenders, a tender's
    deadline its last line's day; the history is that of the tenders that are not open. An unsuccessful tender admits no bid; companies
    seen twice at a buyer are identified; a group's chance is that of its likeliest company with a strong link. The tables
    hold nothing of our own (qualifications, bids in progress), so that these signals are null."""
    all_, p = tenders(spark, d), presences(spark, d)
    today = all_.agg(F.max("day").alias("today"))  # one row
    ends = bids(spark, d).groupBy("unit").agg(F.max("shipped").alias("deadline"), F.bool_or("admitted").alias("admitted"))
    past = all_.where("status <> 'O'").join(ends, "unit", "left")
    buyers = past.groupBy("buyer").agg(F.count(F.lit(1)).alias("buyer_n"), (F.count_if(~F.coalesce("admitted", F.lit(False))) / F.count(F.lit(1))).alias("unsuccessful_rate"))
    before = p.join(past.select("unit"), "unit", "left_semi")
    strong = copresence.pairs(before, 3).where("level = 'fort'").select(F.explode(F.array("a", "b")).alias("company")).distinct().withColumn("strong", F.lit(True))
    met = before.groupBy("buyer", "company").agg(F.count(F.lit(1)).alias("n")).join(strong, "company", "left").join(buyers.select("buyer", "buyer_n"), "buyer")
    known = met.groupBy("buyer").agg((F.sum(F.when(F.col("n") >= 2, F.col("n")).otherwise(0)) / F.sum("n")).alias("identified"), F.max(F.when(F.col("strong"), F.col("n") / F.col("buyer_n"))).alias("group_p"))
    now = all_.where("status = 'O' AND estimation > 0").join(ends.select("unit", "deadline"), "unit").join(F.broadcast(today))
    rows = now.join(buyers, "buyer", "left").join(known, "buyer", "left")
    none = {"eligibility": F.lit(None).cast("string"), "in_progress": F.lit(None).cast("long"), "plan_max": F.lit(None).cast("long")}
    return rows.select("unit", "priority", F.datediff("deadline", "today").alias("days"), F.coalesce("buyer_n", F.lit(0)).alias("buyer_n"), "identified", "group_p", "unsuccessful_rate").withColumns(none)


@query()
def decision_reasons(spark, d):
    """The recommended price of each priority class, on the curve of fixed rates, and the decision on each open tender of the class (tested on
    hand-made curves, and the curve against the commission's replay)."""
    curve = stored(_curve(spark, d), "curve")  # 801 rows a class, read for the costs too
    costs = curve.select("priority").distinct().withColumns({"cost": F.lit(0.7), "margin": F.lit(0.05)})
    told = decide.evaluate(curve, costs, ["priority"])
    done = decide.decide(_signals(spark, d).join(F.broadcast(told), "priority"))  # one row a class
    return done.select("unit", "priority", "x", "gain", "chance", "zone_low", "zone_high", "decision", F.array_join(F.transform("reasons", lambda r: r["code"]), ",").alias("codes"))


@query()
def simulate_curve(spark, d):
    """Chance of winning by rate for each priority class, with the most frequent companies as candidates (seeded; tested)."""
    rows = _rates(spark, d)
    own = rows.groupBy("priority", "bidder").agg(F.count_distinct("unit").alias("n"), F.avg("rate").alias("mu"), F.stddev_samp("rate").alias("sigma"))
    units = tenders(spark, d).groupBy("priority").agg(F.count(F.lit(1)).alias("units"))
    c = own.join(units, "priority").select(F.col("priority").alias("unit"), (F.col("n") / F.col("units")).alias("p"), "mu", F.coalesce("sigma", F.lit(0.05)).alias("sigma"))
    return simulate.chance_curve(c)


@query("WITH e AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), m AS (SELECT day, n, sum(n) OVER w / count(*) OVER w AS smooth FROM e WINDOW w AS (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) SELECT day, n, CAST(smooth AS DOUBLE) AS smooth FROM m")
def moving_average_zone(spark, d):
    e = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return e.withColumn("smooth", decide.moving_mean([], "day", "n", 3))


@query("WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT *, CASE WHEN n >= 2 AND NOT coalesce(lag(n) OVER w >= 2, false) THEN 1 ELSE 0 END AS st FROM e WINDOW w AS (PARTITION BY user_id ORDER BY day)), i AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY day) AS island FROM s) SELECT user_id, CAST(island AS BIGINT) AS island, min(day) AS first, max(day) AS last, count(*) AS days FROM i WHERE n >= 2 GROUP BY ALL")
def gaps_islands_zone(spark, d):
    e = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    marked = decide.islands(e, ["user_id"], "day", F.col("n") >= 2).where("island IS NOT NULL")
    return marked.groupBy("user_id", F.col("island").cast("long").alias("island")).agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count(F.lit(1)).alias("days"))


# limits


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS recent FROM (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)")
def rate_limit_60s(spark, d):
    return limits.sliding_count(events(spark, d), "user_id", "second", 60).select("event_id", "user_id", "recent")


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 3")
def daily_limit(spark, d):
    return limits.tumbling(events(spark, d), "user_id", "ts", "1 day").where("n > 3").select("user_id", F.to_date("start").alias("day"), "n")


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS st FROM events), s AS (SELECT user_id, ts, sum(st) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def session_12h(spark, d):
    return limits.sessions(events(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "12 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("WITH e AS (SELECT user_id, event_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events) SELECT event_id, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING), 0) >= 2 AS locked FROM e")
def lockout(spark, d):
    return limits.lockouts(events(spark, d), "user_id", "second", F.col("event_type") == "error", 2, 86400).select("event_id", "locked")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def supersede(spark, d):
    return limits.supersede(table(spark, d, "events"), "user_id", "event_id", "event_type")


# more of the same areas


@query(f"{FULL_SQL}, w AS (SELECT c.*, coalesce(amount BETWEEN estimation * (1 - 0.2) AND estimation * (1 + 0.2), false) AS i FROM cand c LEFT JOIN tenders t ON t.unit = c.unit) SELECT unit, seq, bidder FROM (SELECT *, bool_or(i) OVER (PARTITION BY unit) AS o FROM w) WHERE i OR NOT o")
def within_band(spark, d):
    return commission.within_band(_candidates(spark, d), tenders(spark, d), ["unit"], 0.2).select("unit", "seq", "bidder")


@query(f"{FULL_SQL}, u AS (SELECT unit, CASE WHEN priority <> '5-LOW' THEN day END AS day, t.estimation, reference FROM tenders t LEFT JOIN prices USING (unit)) SELECT CASE WHEN day IS NULL THEN 'undated' WHEN NOT coalesce(estimation > 0, false) THEN 'no_estimation' ELSE 'no_reference' END AS reason, count(*) AS n FROM u WHERE day IS NULL OR NOT coalesce(estimation > 0, false) OR reference IS NULL GROUP BY 1")
def corpus_exclusions(spark, d):
    u = tenders(spark, d).withColumn("day", F.when(F.col("priority") != "5-LOW", F.col("day"))).join(_prices(spark, d).select("unit", "reference"), "unit", "left")
    return asof.corpus(u, "day", "estimation", "reference")[1]


@query("SELECT o_orderkey AS unit FROM orders WHERE CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS UBIGINT) % 7 = 3 AND o_custkey % 5 < 3")
def retry_schedule(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("unit"), (F.col("o_custkey") % 5).alias("attempts"))
    return asof.due_today(rows, "unit", "attempts", 10, 7, 3).select("unit")


@query("SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def year_by_status(spark, d):
    counts = {k: F.count_if(F.col("o_orderstatus") == k.upper()).alias(k) for k in "fop"}
    return table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(*counts.values())


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def month_facet(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'O'").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderdate >= TIMESTAMP '1998-08-01 00:00:00' AS active, count(*) AS n FROM orders GROUP BY 1")
def active_expired(spark, d):
    return table(spark, d, "orders").groupBy((F.col("o_orderdate") >= F.lit("1998-08-01").cast("timestamp_ntz")).alias("active")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events QUALIFY rank <= 8")
def last_proofs(spark, d):
    ranked = marts.top_per_key(table(spark, d, "events"), "user_id", [F.col("ts").desc(), F.col("event_id").desc()], 8)
    return ranked.select("user_id", "event_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT o_custkey AS buyer, string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1")
def nested_children(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("buyer"), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    nested = search.with_children(o.select("buyer").distinct(), o, "buyer", "c")
    return nested.select("buyer", F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["k"].cast("string"), x["s"])), ",").alias("orders"))


@query(
    f"{CATALOGUE['fictitious_bid_grid'][1].replace('SELECT unit, rate, rank FROM ranked WHERE seq = 1152921504606846976', '')}, s AS (SELECT priority, rate, count(*) FILTER (rank = 1) AS w, count(*) AS n FROM ranked r JOIN tenders USING (unit) WHERE seq = 1152921504606846976 GROUP BY ALL), "
    "gn AS (SELECT priority, rate, (rate - 0.8) * (w / n) AS gain FROM s) SELECT priority, arg_max(rate, (gain, -rate)) AS rate FROM gn GROUP BY 1"
)
def best_fixed_rate(spark, d):
    won = commission.replay_with_bid(_candidates(spark, d), tenders(spark, d), ["unit"], _RATES, None).join(tenders(spark, d).select("unit", "priority"), "unit")
    shares = won.groupBy("priority", "rate").agg((F.count_if(F.col("rank") == 1) / F.count(F.lit(1))).alias("share"))
    return decide.best_rate(shares, ["priority"], 0.8).select("priority", "rate")


@query(f"{_RATES_SQL} SELECT CAST(floor((rate - 0.7) / 0.005) AS BIGINT) AS bin, count(*) AS n FROM r GROUP BY 1")
def rate_histogram(spark, d):
    return simulate.histogram(_rates(spark, d), "rate")


@query("SELECT user_id, min(CAST(ts AS DATE)) AS first, max(CAST(ts AS DATE)) AS last, count(*) AS copies FROM events WHERE event_type = 'view' GROUP BY 1")
def frozen_listing(spark, d):
    return tracking.listing(table(spark, d, "events").where("event_type = 'view'").withColumn("day", F.to_date("ts")), ["user_id"], "day")


@query(f"{FULL_SQL}, a AS (SELECT unit, priority, estimation, reference, min(amount) AS lowest FROM prices JOIN bids USING (unit) JOIN (SELECT unit, priority FROM tenders) USING (unit) WHERE reference IS NOT NULL GROUP BY ALL) SELECT priority, count(*) FILTER (abs(estimation - lowest) < abs(reference - lowest)) AS wins, count(*) FILTER (abs(estimation - lowest) = abs(reference - lowest)) AS ties, count(*) FILTER (abs(estimation - lowest) > abs(reference - lowest)) AS losses FROM a GROUP BY 1")
def predictor_duel(spark, d):
    low = bids(spark, d).groupBy("unit").agg(F.min("amount").alias("lowest"))
    rows = _prices(spark, d).where("reference IS NOT NULL").join(low, "unit").join(tenders(spark, d).select("unit", "priority"), "unit")
    return tracking.duel(rows, "estimation", "reference", "lowest", ["priority"])


@query("SELECT l_orderkey AS unit, max(p_size) AS class, count(DISTINCT p_brand) AS codes FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def best_class(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("l_orderkey").alias("unit")).agg(F.max("p_size").alias("class"), F.count_distinct("p_brand").alias("codes"))


@query(f"{FULL_SQL}, w AS (SELECT priority, bidder, count(*) AS n FROM ranked JOIN tenders USING (unit) WHERE rank = 1 GROUP BY ALL), t AS (SELECT priority, sum(n) AS total, count(*) AS k FROM w GROUP BY 1) SELECT priority, floor(sum(-(n / total) * ln(n / total)) / greatest(ln(max(k)), 1e-12) * 1e6 + 0.5) / 1e6 AS entropy FROM w JOIN t USING (priority) GROUP BY 1")
def win_entropy(spark, d):
    wins = _ranked(spark, d).where("rank = 1").join(tenders(spark, d).select("unit", "priority"), "unit")
    return copresence.entropy(wins, "priority", "bidder").select("priority", (F.floor(F.col("entropy") * 1e6 + 0.5) / F.lit(1e6)).alias("entropy"))


@query("SELECT c_mktsegment AS segment, c_custkey AS buyer FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY turn, o) AS k FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY o) AS turn FROM (SELECT *, sha256(CAST(c_custkey AS VARCHAR)) AS o FROM customer))) WHERE k <= 12")
def diverse_sample(spark, d):
    """Twelve buyers of each segment, the nations taken in turn: a sample is the feature."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("buyer"), F.col("c_mktsegment").alias("segment"), "c_nationkey")
    return tracking.diverse_sample(rows, "buyer", "buyer", "c_nationkey", "segment", 12).select("segment", "buyer")


def _parts_of_open_tenders(spark, d):
    """(unit, part) of the tenders of status P; lines are dealt in tasks of a bounded number."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_partkey").alias("part"))
    small = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("unit"))
    return lines.repartition(row_tasks(lines), "unit").join(small, "unit")


@query()
def alike_names(spark, d):
    """Part names that are alike and were never in one open tender (tested against all pairs)."""
    parts = table(spark, d, "part")
    ids = parts.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    part_of = parts.join(ids, F.col("p_name") == F.col("name")).select(F.col("p_partkey").alias("part"), "id")
    seen = _parts_of_open_tenders(spark, d).join(part_of, "part").select("unit", F.col("id").alias("company"))
    return names.near_duplicates(ids, 70.0, copresence.shared_units(seen.distinct()))


@query()
def version_dedup(spark, d):
    """Republished tenders: orders of one buyer and priority whose titles (the first part's name) are alike; the dearest is kept."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("p"))
    o = table(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, d, "part").select("p_partkey", "p_name"), F.col("p") == F.col("p_partkey"))
    rows = o.select(F.col("o_orderkey").cast("string").alias("ref"), F.col("o_orderpriority").alias("reference"), F.col("o_custkey").cast("string").alias("buyer"), F.col("p_name").alias("title"), "o_totalprice")
    return similarity.version_groups(rows, [F.col("o_totalprice")]).select("ref", "version_group", "main", F.col("versions").cast("long").alias("versions"))


@query("SELECT regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS buyer_key, arg_max(c_name, (n, c_name)) AS buyer, CAST(sum(n) AS BIGINT) AS tenders FROM (SELECT c_name, count(*) AS n FROM customer GROUP BY 1) GROUP BY 1")
def buyer_dimension(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_name").alias("buyer"))
    return readers.buyer_dimension(rows)
