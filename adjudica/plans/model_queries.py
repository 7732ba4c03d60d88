"""Queries of models, rates, decisions, texts and reports over the star schema; each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from adjudica.functions import measures, text
from adjudica.operators import asof, bidders, commission, decide, eligibility, rates, similar_markets, similarity, tracking
from adjudica.operators.components import stored
from adjudica.plans.adapter import BIDS_SQL, FULL_SQL, PRESENCES_SQL, TENDERS_SQL, bids, events, presences, row_tasks, table, tenders
from adjudica.plans.market_queries import SIX, six
from adjudica.plans.tender_queries import _BRACKET, _RATES_SQL, _candidates, _prices, _ranked, _rates
from adjudica.sources import sinks
from adjudica.streaming import limits

CATALOGUE: dict = {}


def query(sql: str | None = None):
    def register(fn):
        CATALOGUE[fn.__name__] = (fn, sql)
        return fn

    return register


# similarity


_COSINES = """nm AS (SELECT DISTINCT p_name AS title FROM part JOIN lineitem ON l_partkey = p_partkey), wd AS (SELECT title, ' ' || unnest(string_split(title, ' ')) || ' ' AS w FROM nm),
 gr AS (SELECT title, substr(w, i, k) AS g, count(*) AS n FROM wd, (VALUES (3), (4)) s(k), range(1, 60) r(i) WHERE i <= greatest(1, length(w) - k + 1) GROUP BY 1, 2), gd AS (SELECT g, count(*) AS df FROM gr GROUP BY 1 HAVING count(*) >= 2),
 vw AS (SELECT title, g, (1 + ln(n)) * (ln((1 + (SELECT count(DISTINCT title) FROM gr)) / (1.0::DOUBLE + df)) + 1) AS w FROM gr JOIN gd USING (g)), vn AS (SELECT title, g, w / sqrt(sum(w * w) OVER (PARTITION BY title)) AS w FROM vw),
 cs AS (SELECT a.title AS ta, b.title AS tb, sum(a.w * b.w) AS c FROM vn a JOIN vn b USING (g) GROUP BY 1, 2)"""
_PAIRED = f"""{_COSINES}, ti AS (SELECT unit, p_name AS title FROM bids JOIN part ON p_partkey = part WHERE seq = 1),
 tt AS (SELECT t.*, c_nationkey AS region, c_mktsegment AS segment, (t.unit % 6) AS class, title FROM tenders t JOIN customer ON c_custkey = buyer LEFT JOIN ti ON ti.unit = t.unit),
 p AS (SELECT t.unit AS target, m.unit AS base, t.day AS t_day, m.day AS m_day, t.title AS tt_, m.title AS mt_, CAST(t.priority = m.priority AS INT) AS fam, CAST(t.status = m.status AS INT) AS nat, CASE WHEN t.buyer = m.buyer THEN 1.0 WHEN t.segment = m.segment THEN 0.3 ELSE 0.0 END AS bu, CAST(t.region = m.region AS INT) AS reg,
  CASE abs(t.class - m.class) WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 WHEN 2 THEN 0.3 ELSE 0.0 END AS q, m.estimation / t.estimation AS ratio, t.estimation AS te, pow(0.5, (t.day - m.day) / 365.0::DOUBLE) AS rec FROM tt t JOIN tt m ON m.day < t.day WHERE t.unit % 20 = 0),
 v AS (SELECT p.*, 0.6 * coalesce(c, 0) + 0.25 * fam + 0.15 * nat AS title, coalesce(greatest(0.0, 1 - abs(ln(ratio)) / ln(10.0 / 3)), 0) AS am, CASE WHEN te > 0 THEN 10 ELSE 0 END AS wa FROM p LEFT JOIN cs ON ta = tt_ AND tb = mt_ WHERE coalesce(ratio BETWEEN 0.3 AND 3, true)),
 sc AS (SELECT *, 100 * (40 * title + 30 * bu + 10 * q + wa * am + 5 * reg + 5 * rec) / (90 + wa) AS score FROM v)"""
_LIKE = f"""{_PAIRED}, top AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(score, 9) DESC, m_day DESC, base DESC) AS rank FROM sc QUALIFY rank <= 20)"""


def _markets(spark, d):
    """Tenders as markets: the title is the name of the first bid's part."""
    t = tenders(spark, d).join(table(spark, d, "customer").select(F.col("c_custkey").alias("buyer"), F.col("c_nationkey").alias("region"), F.col("c_mktsegment").alias("buyer_type")), "buyer")
    titles = bids(spark, d).where("seq = 1").join(table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_name").alias("title")), "part").select("unit", "title")
    t = t.join(titles, "unit", "left")
    return t.select("unit", "title", F.col("priority").alias("family"), F.col("status").alias("nature"), "buyer", "buyer_type", "region", F.col("estimation").alias("amount"), "day", (F.col("unit") % 6).cast("int").alias("class"))


def _alike(spark, d, n=20):
    """The most similar earlier tenders of each tender whose number divides by 20, among all."""
    m = stored(_markets(spark, d), "markets")
    return similar_markets.top(m.where("unit % 20 = 0"), m, similar_markets.title_weights(m), n)


@query(f"WITH {BIDS_SQL}, {TENDERS_SQL}, {_LIKE} SELECT target, base, rank, {SIX.format('score')} AS score FROM top")
def similar_score_topk(spark, d):
    return _alike(spark, d).select(F.col("t_unit").alias("target"), F.col("m_unit").alias("base"), F.col("rank").cast("long").alias("rank"), six(F.col("score"), "score"))


@query(f"WITH {BIDS_SQL}, {TENDERS_SQL}, {_LIKE} SELECT target, base, criterion, {SIX.format('points')} AS points FROM (SELECT target, base, wa, unnest(['title', 'buyer', 'qualification', 'amount', 'region', 'recency']) AS criterion, unnest([4000 * title, 3000 * bu, 1000 * q, 100 * wa * am, 500 * reg, 500 * rec]) / (90 + wa) AS points FROM top) WHERE criterion <> 'amount' OR wa > 0")
def similar_explanation(spark, d):
    rows = similarity.explain(_alike(spark, d)).select(F.col("t_unit").alias("target"), F.col("m_unit").alias("base"), F.inline("detail"))
    return rows.select("target", "base", "criterion", six(F.col("points"), "points"))


@query(f"{FULL_SQL}, {_LIKE} SELECT target, floor(quantile_cont(reference, 0.25) * 1000 + 0.25) / 1000 AS q1, floor(quantile_cont(reference, 0.5) * 1000 + 0.25) / 1000 AS median, floor(quantile_cont(reference, 0.75) * 1000 + 0.25) / 1000 AS q3 FROM top JOIN prices ON prices.unit = base GROUP BY 1")
def similar_quartiles(spark, d):
    top = _alike(spark, d).select(F.col("t_unit").alias("target"), F.col("m_unit").alias("unit")).join(_prices(spark, d).select("unit", "reference"), "unit")
    q = similarity.reference_quartiles(top, "target", "reference")
    return q.select("target", *[(F.floor(F.col(c) * 1000 + 0.25) / F.lit(1000.0)).alias(c) for c in ("q1", "median", "q3")])


@query("""WITH e AS (SELECT vec_id, embedding FROM embeddings), s AS (SELECT q.vec_id AS query, b.vec_id AS found, list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM e q JOIN e b ON q.vec_id <> b.vec_id WHERE q.vec_id % 20 = 0)
 SELECT query, found, row_number() OVER (PARTITION BY query ORDER BY floor(c * 1e9 + 0.5) DESC, found) AS rank FROM s QUALIFY rank <= 10""")
def embedding_topk(spark, d):
    """The ten nearest vectors of each whose id divides by 20, by exact cosine, in blocks: a stated query set against all rows."""
    return similarity.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 10)


# bidders


_FEATURES = """hist AS (SELECT p.unit, company, p.buyer, o_orderpriority AS family, c_nationkey AS region, CASE WHEN estimation > 0 THEN ln(estimation) END AS size, p.day - DATE '1970-01-01' AS day FROM presences p JOIN orders ON o_orderkey = p.unit JOIN customer ON c_custkey = p.buyer JOIN tenders t ON t.unit = p.unit),
 tg AS (SELECT t.unit, t.buyer, t.priority AS family, c_nationkey AS region, CASE WHEN estimation > 0 THEN ln(estimation) END AS size, t.day - DATE '1970-01-01' AS day FROM tenders t JOIN customer ON c_custkey = t.buyer WHERE t.unit % 20 = 0),
 cd AS (SELECT tg.unit, company FROM tg JOIN hist h ON h.buyer = tg.buyer AND h.day >= tg.day - 1095 AND h.day < tg.day UNION SELECT tg.unit, company FROM tg JOIN (SELECT DISTINCT company, region, day FROM hist) h ON h.region = tg.region AND h.day >= tg.day - 365 AND h.day < tg.day)"""
_WINDOWED = """rows AS (SELECT unit, company, buyer, family, region, size, day, 1 AS w FROM hist UNION ALL SELECT unit, company, buyer, family, region, size, day, 0 FROM cd JOIN tg USING (unit)),
 ft AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY company ORDER BY day RANGE BETWEEN 365 PRECEDING AND 1 PRECEDING), 0) AS active, coalesce(sum(w) OVER p2, 0) AS profile, avg(CASE WHEN w = 1 THEN size END) OVER p2 AS usual,
  coalesce(sum(w) OVER (PARTITION BY company, region ORDER BY day RANGE BETWEEN 730 PRECEDING AND 1 PRECEDING), 0) AS reg, coalesce(sum(w) OVER (PARTITION BY company, region ORDER BY day RANGE BETWEEN 365 PRECEDING AND 1 PRECEDING), 0) AS reg12,
  coalesce(sum(w) OVER (PARTITION BY company, family ORDER BY day RANGE BETWEEN 730 PRECEDING AND 1 PRECEDING), 0) AS fam, coalesce(sum(w) OVER (PARTITION BY company, buyer ORDER BY day RANGE BETWEEN 1095 PRECEDING AND 1 PRECEDING), 0) AS bu,
  coalesce(sum(w) OVER (PARTITION BY company, buyer ORDER BY day RANGE BETWEEN 730 PRECEDING AND 1 PRECEDING), 0) AS bu24, coalesce(sum(w) OVER (PARTITION BY company, buyer, family ORDER BY day RANGE BETWEEN 730 PRECEDING AND 1 PRECEDING), 0) AS bufam,
  max(CASE WHEN w = 1 THEN day END) OVER (PARTITION BY company ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest
  FROM rows WINDOW p2 AS (PARTITION BY company ORDER BY day RANGE BETWEEN 730 PRECEDING AND 1 PRECEDING)),
 hu AS (SELECT DISTINCT unit, buyer, family, day FROM hist), un AS (SELECT tg.unit, (SELECT count(*) FROM hu WHERE hu.buyer = tg.buyer AND hu.day < tg.day AND hu.day >= tg.day - 1095) AS u3, (SELECT count(*) FROM hu WHERE hu.buyer = tg.buyer AND hu.day < tg.day AND hu.day >= tg.day - 730) AS u2, (SELECT count(*) FROM hu WHERE hu.buyer = tg.buyer AND hu.family = tg.family AND hu.day < tg.day AND hu.day >= tg.day - 730) AS uf FROM tg)"""


def _history(spark, d):
    t = tenders(spark, d).join(table(spark, d, "customer").select(F.col("c_custkey").alias("buyer"), F.col("c_nationkey").alias("region")), "buyer")
    t = t.select("unit", "buyer", F.col("priority").alias("family"), "region", F.when(F.col("estimation") > 0, F.ln("estimation")).alias("size"), asof.days("day").alias("day"))
    return t, presences(spark, d).select("unit", "company").join(t, "unit")


@query(f"WITH {PRESENCES_SQL}, {TENDERS_SQL}, {_FEATURES} SELECT unit, company FROM cd")
def bidder_candidates(spark, d):
    """Companies that may bid for each tender whose number divides by 20: the union of two ways to come across one."""
    t, history = _history(spark, d)
    return bidders.candidates(t.where("unit % 20 = 0"), history)


@query(
    f"WITH {PRESENCES_SQL}, {TENDERS_SQL}, {_FEATURES}, {_WINDOWED} SELECT unit, company, bufam >= 2 AS regular, " + ", ".join(f"{SIX.format(x)} AS {n}" for n, x in {
        "buyer_share": "bu / (u3 + 1)", "buyer_n": "ln(1 + bu)", "activity": "ln(1 + active)", "idle_years": "coalesce(least(3.0, (day - latest) / 365.0::DOUBLE), 3)", "region_share": "CASE WHEN profile > 0 THEN reg / profile ELSE 0 END", "region_n": "ln(1 + reg12)",
        "family_share": "CASE WHEN profile > 0 THEN fam / profile ELSE 0 END", "size_gap": "coalesce(least(3.0, abs(size - usual)), 1)", "buyer_family": "bufam / (uf + 2)", "buyer_family_n": "ln(1 + bufam)", "buyer_24": "bu24 / (u2 + 2)",
    }.items()) + " FROM ft JOIN un USING (unit) WHERE w = 0"
)
def bidder_features(spark, d):
    t, history = _history(spark, d)
    targets = t.where("unit % 20 = 0")
    f = bidders.candidate_features(targets, history)
    names = ["buyer_share", "buyer_n", "activity", "idle_years", "region_share", "region_n", "family_share", "size_gap", "buyer_family", "buyer_family_n", "buyer_24"]
    return f.select("unit", "company", "regular", *[six(F.col(c), c) for c in names])


@query(f"WITH {PRESENCES_SQL}, n AS (SELECT buyer, unit, count(*) AS k FROM presences GROUP BY 1, 2) SELECT buyer, {SIX.format('greatest(0.0, 0.1854 + 0.1386 * avg(k))')} AS unannounced FROM n GROUP BY 1")
def unannounced_bidders(spark, d):
    n = presences(spark, d).groupBy("buyer", "unit").agg(F.count(F.lit(1)).alias("k"))
    return n.groupBy("buyer").agg(six(bidders.unannounced(F.avg("k")), "unannounced"))


_PROBABLE = "x AS (SELECT doc_id, (doc_id % 17) / 17.0::DOUBLE AS a, (doc_id % 5) / 5.0::DOUBLE AS b, doc_id % 3 = 0 AS s, quality = 1 AS y FROM labels), r AS (SELECT *, CASE WHEN s THEN 1 / (1 + exp(-(-1 + 2 * a + b))) ELSE 1 / (1 + exp(-(-2 + a + 3 * b))) END AS raw FROM x)"


def _probable(spark, d):
    k = F.col("doc_id")
    rows = table(spark, d, "labels").select("doc_id", (k % 17 / F.lit(17.0)).alias("a"), (k % 5 / F.lit(5.0)).alias("b"), (k % 3 == 0).alias("s"), (F.col("quality") == 1).alias("y"))
    models = {True: (-1.0, {"a": 2.0, "b": 1.0}), False: (-2.0, {"a": 1.0, "b": 3.0})}
    return rows, models


@query(f"WITH {_PROBABLE} SELECT doc_id, {SIX.format('CASE WHEN NOT s THEN CASE WHEN raw <= 0.2 THEN 0.1 WHEN raw <= 0.8 THEN 0.1 + (raw - 0.2) * (0.6 / 0.6000000000000001) ELSE 0.7 END ELSE raw END')} AS p FROM r")
def presence_probability(spark, d):
    """The formula of each segment and its calibration table."""
    rows, models = _probable(spark, d)
    p = bidders.probability(["a", "b"], models, F.col("s"), {True: [(0.0, 0.0), (1.0, 1.0)], False: [(0.2, 0.1), (0.8, 0.7)]})
    return rows.select("doc_id", six(p, "p"))


@query(f"WITH {_PROBABLE}, k AS (SELECT doc_id % 40 AS unit, y, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY raw DESC, doc_id) AS n FROM r) SELECT count(*) FILTER (n <= 10 AND y) / count(*) FILTER (y) AS recall_10, count(*) FILTER (n <= 15 AND y) / count(*) FILTER (y) AS recall_15, count(*) FILTER (n <= 30 AND y) / count(*) FILTER (y) AS recall_30, count(*) FILTER (y) AS bidders FROM k")
def recall_topk(spark, d):
    rows, models = _probable(spark, d)
    rows = rows.select("doc_id", "y", (F.col("doc_id") % 40).alias("unit"), bidders.probability(["a", "b"], models, F.col("s")).alias("p"))
    return bidders.recall_at(rows, "unit", "p", "y", "doc_id")


@query(f"WITH {PRESENCES_SQL}, n AS (SELECT buyer, unit, count(*) AS k FROM presences GROUP BY 1, 2) SELECT buyer, {SIX.format('exp((8 / (n + 8)) * ln(3.0) + (n / (n + 8)) * ln(greatest(m, 1)))')} AS target FROM (SELECT buyer, count(*) AS n, median(k) AS m FROM n GROUP BY 1)")
def history_target(spark, d):
    n = presences(spark, d).groupBy("buyer", "unit").agg(F.count(F.lit(1)).alias("k")).groupBy("buyer").agg(F.count(F.lit(1)).alias("n"), F.median("k").alias("m"))
    return n.select("buyer", six(bidders.history_target(F.lit(3.0), F.col("n"), F.col("m"), 8), "target"))


# rates


@query(f"{_RATES_SQL}, o AS (SELECT bidder, priority, count(*) AS n, avg(rate) AS m, var_pop(rate) AS v FROM r GROUP BY 1, 2), s AS (SELECT priority, avg(rate) AS sm, var_samp(rate) AS sv FROM r GROUP BY 1) SELECT bidder, priority, {SIX.format('(n * m + 3 * sm) / (n + 3)')} AS mu, {SIX.format('greatest(0.01, 0.8 * sqrt((n * v + sv) / (n + 1)))')} AS sigma FROM o JOIN s USING (priority)")
def shrunk_rates(spark, d):
    """A company's rates between its own and its segment's."""
    rows = _rates(spark, d).withColumn("w", F.lit(1.0))
    own = rates.weighted_moments(rows, ["bidder", "priority"], "rate", "w")
    segment = rows.groupBy("priority").agg(F.avg("rate").alias("sm"), F.var_samp("rate").alias("sv"))
    done = rates.shrink(own.join(segment, "priority"), F.col("sm"), F.col("sv"))
    return done.select("bidder", "priority", six(F.col("mu"), "mu"), six(F.col("sigma"), "sigma"))


@query(f"{_RATES_SQL}, o AS (SELECT bidder, count(*) AS n, median(rate) AS m FROM r GROUP BY 1) SELECT bidder, (n * m + 3.0::DOUBLE * g) / (n + 3.0::DOUBLE) AS median FROM o, (SELECT median(rate) AS g FROM r)")
def shrunk_medians(spark, d):
    rows = stored(_rates(spark, d).select("bidder", "rate"), "rates")
    own = rates.medians(rows, ["bidder"], "rate")
    wide = rates.wide_median(rows, "rate").select(F.col("median").alias("g"))
    return own.join(F.broadcast(wide)).select("bidder", rates.shrink_to(F.col("median"), F.col("n"), F.col("g"), 3).alias("median"))  # one row


@query(f"WITH {BIDS_SQL}, o AS (SELECT bidder, count(*) AS n, count(*) FILTER (status = 'R') AS e FROM bids GROUP BY 1) SELECT bidder, (e + 5.0::DOUBLE * (SELECT sum(e) / sum(n) FROM o)) / (n + 5.0::DOUBLE) AS p FROM o")
def elimination_rates(spark, d):
    own = bids(spark, d).groupBy("bidder").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "R").alias("e"))
    wide = own.agg((F.sum("e") / F.sum("n")).alias("g"))
    return own.join(F.broadcast(wide)).select("bidder", measures.smoothed_rate(F.col("e"), F.col("n"), F.col("g"), 5).alias("p"))  # one row


@query(f"{FULL_SQL}, g AS (SELECT bidder, (amount - first_value(amount) OVER (PARTITION BY unit ORDER BY rank)) / first_value(amount) OVER (PARTITION BY unit ORDER BY rank) * 100 AS gap FROM ranked) SELECT bidder, median(gap) AS gap, count(*) AS n FROM g GROUP BY 1")
def gaps_to_choice(spark, d):
    return rates.gaps_to_choice(_ranked(spark, d), ["unit"]).groupBy("bidder").agg(F.median("gap").alias("gap"), F.count(F.lit(1)).alias("n"))


@query(f"{_RATES_SQL}, u AS (SELECT unit, avg(rate) AS m, var_samp(rate) AS v, count(*) AS n FROM r GROUP BY 1), f AS (SELECT regr_slope(m, ln(n)) AS s, regr_intercept(m, ln(n)) AS i, avg(v / n) AS noise FROM u) SELECT {SIX.format('greatest(0.0, (SELECT var_samp(m - (i + s * ln(n))) FROM u, f) - (SELECT noise FROM f))')} AS between")
def market_effect_between(spark, d):
    return rates.market_effect(_rates(spark, d), "unit", "rate").select(six(F.col("between"), "between"))


@query(f"{_RATES_SQL}, q AS (SELECT priority, count(*) AS n, list_transform(range(0, 41), lambda i: i) AS ks, quantile_cont(rate, [i / 40.0::DOUBLE FOR i IN range(0, 41)]) AS qs FROM r GROUP BY 1) SELECT priority, unnest(ks) AS k, {SIX.format('unnest(qs)')} AS q FROM q WHERE n >= 40".replace("[i / 40.0::DOUBLE FOR i IN range(0, 41)]", "[" + ", ".join(str(i / 40) for i in range(41)) + "]"))
def segment_quantiles(spark, d):
    """The 41 quantiles of the rates of each segment of 40 rows or more."""
    rows = rates.widest_first(_rates(spark, d).select("priority", "rate"), [["priority"]], "rate")
    return rows.select("priority", F.posexplode("quantiles").alias("k", "q")).select("priority", F.col("k").cast("long").alias("k"), six(F.col("q"), "q"))


@query(f"{_RATES_SQL}, s AS (SELECT unit, sum(rate) AS s, count(*) AS n FROM r GROUP BY 1), x AS (SELECT k, s, n, CAST(('0x' || substr(md5(unit || '|' || k), 1, 13)) AS UBIGINT) / 4503599627370496.0::DOUBLE AS u FROM s, range(1, 201) t(k)), st AS (SELECT list_transform([1, 2, 3, 4, 5, 6, 7, 8], lambda k: list_sum([exp(-1) / gamma(i + 1) FOR i IN range(0, k)])) AS c), w AS (SELECT k, s, n, len(list_filter(c, lambda t: u > t)) AS w FROM x, st), m AS (SELECT k, sum(w * s) / sum(w * n) AS m FROM w GROUP BY 1) SELECT {SIX.format('quantile_cont(m, 0.025)')} AS low, {SIX.format('quantile_cont(m, 0.975)')} AS high FROM m")
def bootstrap_interval(spark, d):
    """95 % interval of the mean rate, by Poisson weights of a hash."""
    return tracking.bootstrap(_rates(spark, d), "unit", "rate").select(six(F.col("low"), "low"), six(F.col("high"), "high"))


# decisions


@query(f"{FULL_SQL} SELECT priority, count(*) AS n, {SIX.format('avg(abs(estimation - reference)) / 1e4')} AS mae, median(abs(t.estimation - reference)) AS median, avg(CASE WHEN abs(t.estimation - reference) <= 1e6 THEN 1.0::DOUBLE ELSE 0 END) AS within FROM prices JOIN (SELECT unit, priority, estimation FROM tenders) t USING (unit) WHERE reference IS NOT NULL GROUP BY 1".replace("abs(estimation - reference)", "abs(t.estimation - reference)"))
def error_stats(spark, d):
    rows = _prices(spark, d).where("reference IS NOT NULL").join(tenders(spark, d).select("unit", "priority"), "unit")
    e = tracking.errors(rows, "estimation", "reference", ["priority"], 1e6)
    return e.select("priority", "n", six(F.col("mae") / 1e4, "mae"), "median", "within")


@query(f"{FULL_SQL}, w AS (SELECT unit, min(bidder) AS winner, count(*) AS k FROM bids WHERE status = 'A' GROUP BY 1), a AS (SELECT unit, k, bidder = winner AS same FROM ranked JOIN w USING (unit) WHERE rank = 1) SELECT {_BRACKET.format('k')} AS bracket, count(*) AS n, count(*) FILTER (same) AS agreed FROM a GROUP BY 1")
def agreement_by_bracket(spark, d):
    w = bids(spark, d).where("status = 'A'").groupBy("unit").agg(F.min("bidder").alias("winner"), F.count(F.lit(1)).alias("k"))
    return tracking.agreement_by_bracket(_ranked(spark, d).where("rank = 1").join(w, "unit"), "k", F.col("bidder") == F.col("winner"))


_RULE_RATES = [0.9, 1.0]


def _replayed(spark, d):
    own = tenders(spark, d).select("unit", "priority", "estimation")
    return commission.replay_with_bid(_candidates(spark, d), own, ["unit"], _RULE_RATES, None).join(own, "unit").withColumn("wins", F.col("rank") == 1)


_REPLAY = """pb AS (SELECT c.unit, rate, al, x.estimation, rate * x.estimation AS own FROM (SELECT unit, list(amount ORDER BY amount) AS al FROM cand GROUP BY 1) c JOIN tenders x USING (unit), (SELECT unnest([0.9, 1.0]::DOUBLE[]) AS rate) WHERE x.estimation > 0),
 pm AS (SELECT *, list_sort(list_append(al, own)) AS a2 FROM pb), pn AS (SELECT *, list_filter(a2, lambda x: x >= estimation / 8 AND x <= estimation * 8) AS n1, a2[CAST(floor(len(a2) / 2) AS INT) + 1] AS mid FROM pm), pk AS (SELECT *, list_filter(a2, lambda x: x >= mid / 8 AND x <= mid * 8) AS n2 FROM pn),
 pu AS (SELECT *, CASE WHEN len(n1) >= 2 THEN n1 WHEN len(n2) >= 2 THEN n2 ELSE a2 END AS ul FROM pk), pr AS (SELECT *, list_sum(ul) / len(ul) AS mean FROM pu), rp AS (SELECT unit, rate, own, al, estimation, (mean + estimation) / 2 AS ref FROM pr WHERE mean / estimation BETWEEN 0.25 AND 4),
 rw AS (SELECT unit, rate, estimation, CASE WHEN own <= ref THEN len(list_filter(al, lambda x: x >= own AND x <= ref)) = 0 ELSE al[1] > own END AS wins FROM rp)"""


@query(f"{FULL_SQL}, {_REPLAY} SELECT priority, rate, sum(CASE WHEN wins THEN rw.estimation ELSE 0 END) / sum(rw.estimation) AS share FROM rw JOIN tenders USING (unit) GROUP BY 1, 2")
def simple_rule_shares(spark, d):
    """The share of the estimations that each fixed rate would have won, by priority."""
    return decide.simple_rule(_replayed(spark, d), _RULE_RATES, ["priority"])


@query(f"{FULL_SQL}, {_REPLAY} SELECT priority, {SIX.format('sum(CASE WHEN wins AND unit % 4 > 0 THEN (rate - 0.8) * rw.estimation ELSE 0 END) / 1e6')} AS profit, count(*) FILTER (unit % 4 > 0) AS bids, count(*) FILTER (unit % 4 > 0 AND wins) AS won FROM rw JOIN tenders USING (unit) WHERE rate = 0.9 GROUP BY 1")
def backtest_profit(spark, d):
    rows = _replayed(spark, d).where("rate = 0.9").withColumns({"bids": F.col("unit") % 4 > 0, "x": F.col("rate"), "cost": F.lit(0.8)})
    p = decide.profit(rows, ["priority"])
    return p.select("priority", six(F.col("profit") / 1e6, "profit"), "bids", "won")


@query("""WITH req AS (SELECT DISTINCT l_orderkey AS tender, p_size % 5 AS k, 1 + p_partkey % 5 AS cls FROM lineitem JOIN part ON p_partkey = l_partkey), own AS (SELECT * FROM (VALUES (0, 2), (1, 3), (2, 5)) o(k, held)), par AS (SELECT * FROM (VALUES (3, 1, 'p1'), (2, 1, 'p2')) p(k, theirs, name)),
 s AS (SELECT tender, req.k, cls, CASE WHEN held IS NULL THEN 'absent' WHEN held <= cls THEN 'ok' ELSE 'classe' END AS state, EXISTS (SELECT 1 FROM par WHERE par.k = req.k AND theirs <= cls) AS cover FROM req LEFT JOIN own ON own.k = req.k)
 SELECT tender, count(*) FILTER (state <> 'ok' AND NOT cover) AS missing, CASE WHEN count(*) FILTER (state <> 'ok' AND NOT cover) > 0 THEN 'non_eligible' ELSE 'eligible' END AS eligibility FROM s GROUP BY 1""")
def eligibility_verdict(spark, d):
    """What each tender asks for against what we hold (a code in two classes counts by the stronger) and what partners hold."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    asked = rows.select(F.col("l_orderkey").alias("tender"), (F.col("p_size") % 5 + 1).alias("k"), (1 + F.col("p_partkey") % 5).alias("c"))
    each = asked.repartition(row_tasks(table(spark, d, "lineitem")), "tender").distinct()  # one shuffle for this and the verdict
    labels = each.select("tender", F.concat(F.lit("B."), F.col("k").cast("string"), F.lit(" - Travaux")).alias("label"), F.concat(F.lit("Classe "), F.col("c").cast("string")).alias("class"))
    ours = spark.createDataFrame([("B.1", "4"), ("B.1", "2"), ("B.2", "Classe 3"), ("B.3", "5")], "code string, class string")
    partners = spark.createDataFrame([("p1", "B.4", "1"), ("p2", "B.3", "1")], "name string, code string, class string")
    return eligibility.verdict(eligibility.check(eligibility.requirements(labels), ours, partners))


# batches, limits and reports


@query("SELECT count(*) FILTER (k <> 0 AND ok) AS accepted, count(*) FILTER (k = 0) AS without_ref, count(*) FILTER (k <> 0 AND NOT ok) AS without_day FROM (SELECT event_id % 11 AS k, event_id % 7 > 0 AS ok FROM events)")
def judged_batch(spark, d):
    """A pushed batch: what lacks a reference or a readable closing day is refused with the reason."""
    k = F.col("event_id")
    batch = table(spark, d, "events").select(F.when(k % 11 > 0, k.cast("string")).otherwise(" ").alias("notice_ref"), F.when(k % 7 > 0, F.date_format("ts", "dd/MM/yyyy HH:mm")).otherwise("bientôt").alias("closing"))
    accepted, rejected = sinks.judged(batch)
    n = accepted.agg(F.count(F.lit(1)).alias("accepted"))
    m = rejected.agg(F.count_if(F.col("reason").startswith("ref")).alias("without_ref"), F.count_if(F.col("reason").startswith("date")).alias("without_day"))
    return n.join(F.broadcast(m))  # one row each


@query("SELECT count(*) AS frozen FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_id % 2 = 1 EXCEPT SELECT user_id, CAST(ts AS DATE) FROM events WHERE event_id % 2 = 0)")
def freeze_new(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), "value")
    return tracking.freeze(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "day"]).agg(F.count(F.lit(1)).alias("frozen"))


@query("WITH w AS (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS h, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS dd FROM (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)) SELECT event_id, h > 1 OR dd > 2 AS over FROM w")
def service_limits(spark, d):
    """Requests over an hourly or a daily limit."""
    return limits.refused(events(spark, d), "user_id", "second", {3600: 1, 86400: 2}).select("event_id", "over")


@query("SELECT event_type AS action, CAST(json_extract(props, '$.k') AS BIGINT) AS term, count(*) AS n, count(DISTINCT user_id) AS visitors FROM events GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, term) <= 5")
def top_searches(spark, d):
    n = table(spark, d, "events").select(F.col("event_type").alias("action"), F.from_json("props", "k long")["k"].alias("term"), "user_id").groupBy("action", "term").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("visitors"))
    return n.withColumn("_r", F.row_number().over(W.partitionBy("action").orderBy(F.col("n").desc(), "term"))).where("_r <= 5").drop("_r")


@query("SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS n, count(*) FILTER (l.k IS NOT NULL) AS present, count(*) FILTER (o_orderstatus = 'F') AS awarded, count(*) FILTER (l.lots > 1) AS multi_lot, CAST(coalesce(sum(l.priced), 0) AS BIGINT) AS priced FROM orders LEFT JOIN (SELECT l_orderkey AS k, count(DISTINCT l_linestatus) AS lots, count(*) FILTER (l_extendedprice > 0) AS priced FROM lineitem GROUP BY 1) l ON l.k = o_orderkey GROUP BY 1")
def crawl_coverage(spark, d):
    """By year: notices, those of which minutes were found, awarded ones, those of several lots, bids with a price."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count_distinct("l_linestatus").alias("lots"), F.count_if(F.col("l_extendedprice") > 0).alias("priced"))
    rows = table(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("k"), "left")
    return rows.groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("present"), F.count_if(F.col("o_orderstatus") == "F").alias("awarded"), F.count_if(F.col("lots") > 1).alias("multi_lot"), F.coalesce(F.sum("priced"), F.lit(0)).alias("priced"))


@query("SELECT o_orderkey AS unit, coalesce(f.cost, g.cost) AS cost FROM orders LEFT JOIN (SELECT o_orderpriority AS p, median(o_totalprice) AS cost FROM orders WHERE o_orderpriority < '3' GROUP BY 1) f ON p = o_orderpriority, (SELECT median(o_totalprice) AS cost FROM orders) g")
def default_cost(spark, d):
    """The cost of a tender's family, or else of all."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("unit"), F.col("o_orderpriority").alias("p"), F.col("o_totalprice").alias("v"))
    family, all_ = o.where("p < '3'").groupBy("p").agg(F.median("v").alias("f")), o.agg(F.median("v").alias("g"))
    return o.join(family, "p", "left").join(F.broadcast(all_)).select("unit", F.coalesce("f", "g").alias("cost"))  # one row


@query("SELECT count(*) AS recent FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'N')")
def recent_with_minutes(spark, d):
    o = table(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return o.join(table(spark, d, "lineitem").where("l_returnflag = 'N'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").agg(F.count(F.lit(1)).alias("recent"))


@query("""WITH n AS (SELECT unit, k, lot, o_orderstatus AS status FROM (SELECT o_orderkey AS unit, o_orderstatus FROM orders) LEFT JOIN (SELECT DISTINCT l_orderkey AS k, l_linestatus AS lot FROM lineitem) ON k = unit),
 c AS (SELECT unit, count(lot) AS lots FROM n GROUP BY 1) SELECT unit, lot, CASE WHEN lots = 0 THEN 'sans lot' WHEN lots = 1 THEN 'simple' ELSE 'alloti' END AS kind FROM n JOIN c USING (unit) WHERE status = 'O'""")
def open_tender_lots(spark, d):
    """Open tenders with each of their lots; one without lots is a row of its own that says so."""
    lots = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linestatus").alias("lot")).distinct()
    rows = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("unit")).join(lots, F.col("unit") == F.col("k"), "left")
    n = F.count("lot").over(W.partitionBy("unit"))
    return rows.select("unit", "lot", F.when(n == 0, "sans lot").when(n == 1, "simple").otherwise("alloti").alias("kind"))


@query(f"{FULL_SQL}, w AS (SELECT unit FROM bids WHERE status = 'A' GROUP BY 1) SELECT t.unit FROM tenders t JOIN w USING (unit) JOIN prices p ON p.unit = t.unit WHERE t.estimation > 0 AND p.n_bids >= 2 AND p.reference IS NOT NULL AND t.day >= DATE '1998-01-01'")
def replay_candidates(spark, d):
    """Tenders that can be judged again: awarded, estimated, of two bids or more, with a reference."""
    awarded = bids(spark, d).where("status = 'A'").select("unit").distinct()
    priced = _prices(spark, d).where("n_bids >= 2 AND reference IS NOT NULL").select("unit")
    return tenders(spark, d).where((F.col("estimation") > 0) & (F.col("day") >= F.lit("1998-01-01").cast("date"))).join(awarded, "unit", "left_semi").join(priced, "unit", "left_semi").select("unit")


@query("SELECT p_partkey AS part, CASE WHEN p_retailprice < 950 THEN 0 WHEN p_retailprice < 1000 THEN 1 WHEN p_retailprice < 1500 THEN 2 ELSE 3 END AS bracket FROM part")
def amount_brackets(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("part"), measures.amount_bracket(F.col("p_retailprice"), (950.0, 1000.0, 1500.0)).alias("bracket"))


@query("SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, CAST(sum(length(text)) AS BIGINT) AS chars, max(turn) AS longest FROM conversations GROUP BY 1")
def conversation_roles(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.count_distinct("conv_id").alias("conversations"), F.sum(F.length("text")).alias("chars"), F.max("turn").alias("longest"))


@query(f"WITH {PRESENCES_SQL} SELECT 0 AS leaks, count(*) AS checked FROM presences")
def leak_check(spark, d):
    """No feature of a presence may count a presence of its own day or later: those before, plus those from its day on, are all."""
    rows = presences(spark, d).withColumn("n", asof.days("day"))
    one = F.count(F.lit(1))
    own = W.partitionBy("company").orderBy("n")
    rows = rows.select(one.over(asof.before(["company"], "n")).alias("b"), one.over(own.rangeBetween(0, W.unboundedFollowing)).alias("a"), one.over(W.partitionBy("company")).alias("t"))
    return rows.agg(F.count_if(F.col("a") + F.col("b") != F.col("t")).cast("int").alias("leaks"), F.count(F.lit(1)).alias("checked"))


# texts


def _titles(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("unit"), F.concat(F.lit("Travaux d'Aménagement N° "), F.col("o_orderkey").cast("string"), F.lit(" - Étude, Voirie au niveau de la "), F.col("o_orderpriority")).alias("title"))


_T = "t AS (SELECT o_orderkey AS unit, CAST(o_orderkey AS VARCHAR) AS k, trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', ' ', 'g')) AS p FROM orders)"


@query(f"WITH {_T} SELECT unit, 'travaux d amenagement n ' || k || ' etude voirie au niveau de la ' || p AS flat, 'travaux d amenagement n etude voirie au niveau de la ' || regexp_replace(p, '^[0-9] ', '') AS indexed, 'travaux d amenagement n etude voirie' AS skeleton FROM t")
def title_texts(spark, d):
    c = F.col("title")
    return _titles(spark, d).select("unit", text.flat(c).alias("flat"), text.index_text(c).alias("indexed"), text.skeleton(c).alias("skeleton"))


@query("SELECT c_custkey AS buyer, CASE c_custkey % 5 WHEN 0 THEN 'commune' WHEN 1 THEN 'province' WHEN 2 THEN 'direction' WHEN 3 THEN 'enseignement' ELSE 'autre' END AS type, CASE c_custkey % 5 WHEN 0 THEN 'rurale' WHEN 2 THEN 'provinciale' END AS variant, 'c' || c_custkey AS core FROM customer")
def buyer_kinds(spark, d):
    names = ["COMMUNE RURALE DE C{}", "PROVINCE DE C{}", "DIRECTION PROVINCIALE DE C{}", "Université C{}", "Le C{}"]
    k, out = F.col("c_custkey"), None
    for i, n in enumerate(names):
        v = F.replace(F.lit(n), F.lit("{}"), k.cast("string"))
        out = F.when(k % 5 == i, v) if out is None else out.when(k % 5 == i, v)
    rows = table(spark, d, "customer").select(k.alias("buyer"), out.alias("name"))
    c = F.col("name")
    return rows.select("buyer", text.buyer_type(c).alias("type"), text.buyer_variant(c).alias("variant"), F.replace(text.buyer_core(c), F.lit("universite "), F.lit("")).alias("core"))


@query("SELECT p_partkey AS part, 'B.' || p_partkey % 12 AS code, CASE WHEN p_size % 7 = 0 THEN 0 WHEN p_size % 7 <= 5 THEN p_size % 7 END AS rank, CASE abs(p_size % 7 - 3) WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 WHEN 2 THEN 0.3 WHEN 3 THEN CASE p_size % 7 WHEN 6 THEN 0.5 ELSE 0.0 END END AS near FROM part".replace("CASE abs(p_size % 7 - 3) WHEN", "CASE CAST(abs(p_size % 7 - 3) AS INT) WHEN"))
def qualification_texts(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    code = text.qualification_code(F.concat(F.lit("b"), F.when(k % 2 == 0, ".").otherwise(""), (k % 12).cast("string"), F.lit("- Travaux")))
    rank = text.class_rank(F.when(s % 7 == 0, "Classe S").otherwise(F.concat(F.lit("classe "), (s % 7).cast("string"))))
    return table(spark, d, "part").select(k.alias("part"), code.alias("code"), rank.alias("rank"), text.class_proximity(rank, F.lit(3)).cast("decimal(2,1)").alias("near"))


@query("WITH g AS (SELECT *, CAST(CAST((o_totalprice - 150000) / 150000 * 100 AS VARCHAR) AS DECIMAL(38, 18)) AS x FROM orders), r AS (SELECT *, round(x, 2) AS away FROM g) SELECT o_orderkey AS unit, CASE WHEN o_totalprice < 5e5 AND o_orderkey % 4 > 0 THEN o_totalprice END AS sane, CASE o_orderkey % 4 WHEN 1 THEN o_totalprice WHEN 2 THEN o_totalprice WHEN 3 THEN o_totalprice ELSE 1.5 END AS bid, CASE WHEN o_totalprice BETWEEN 150000 / 8.0 AND 150000 * 8.0 THEN CAST(CASE WHEN abs(away - x) = 0.005 AND CAST(away * 100 AS BIGINT) % 2 <> 0 THEN away - 0.01 * sign(x) ELSE away END AS DOUBLE) END AS gap, coalesce(o_totalprice < 18750 OR o_totalprice > 1200000, false) AS off FROM r")
def amount_checks(spark, d):
    v = F.col("o_totalprice")
    odd = F.when(F.col("o_orderkey") % 4 > 0, v).otherwise(-v)
    sane = F.when(v < 5e5, text.sane_amount(odd))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("unit"), sane.alias("sane"), measures.bid_amount(odd, F.lit(1.5)).alias("bid"), measures.gap_percent(v, F.lit(150000.0)).alias("gap"), measures.off_scale(v, F.lit(150000.0)).alias("off"))


@query("SELECT event_id, CASE event_id % 5 WHEN 4 THEN date_trunc('day', ts) + INTERVAL '23:59:59' HOUR TO SECOND WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) ELSE date_trunc('minute', ts) END AS closing, CAST(DATE '2030-01-01' - CAST(ts AS DATE) AS INT) AS age FROM events".replace("INTERVAL '23:59:59' HOUR TO SECOND", "INTERVAL 86399 SECOND"))
def closing_times(spark, d):
    k, forms = F.col("event_id"), ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "dd/MM/yyyy HH:mm", "dd/MM/yyyy"]
    out = None
    for i, form in enumerate(forms):
        out = F.when(k % 5 == i, F.date_format("ts", form)) if out is None else out.when(k % 5 == i, F.date_format("ts", form))
    return table(spark, d, "events").select("event_id", text.parse_closing(out).cast("timestamp_ntz").alias("closing"), measures.days_left(F.lit("2030-01-01"), F.col("ts")).alias("age"))


@query("SELECT o_orderkey AS unit, CAST(o_orderkey * 100 + o_custkey % 100 AS BIGINT) AS number, substr('titre ' || o_orderkey, 1, 9) AS clamped FROM orders")
def number_texts(spark, d):
    k = F.col("o_orderkey")
    ref = F.concat(F.lit("AO n° "), k.cast("string"), F.lit("/"), F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0"))
    return table(spark, d, "orders").select(k.alias("unit"), text.publication_rank(ref).cast("long").alias("number"), text.clamp_text(F.concat(F.lit("  titre \n "), k.cast("string"), F.lit("  ")), 9).alias("clamped"))


@query(f"SELECT c_custkey AS k, {SIX.format('1 / (1 + exp(-(c_acctbal / 1000)))')} AS logistic, {SIX.format('greatest(0.0, 1 - abs(ln((1 + c_custkey % 40) / 10.0)) / ln(10 / 3.0))')} AS near, CASE WHEN c_acctbal <= 0 THEN 0.0 WHEN c_acctbal <= 5000 THEN {SIX.format('c_acctbal * (0.5 / 5000)')} ELSE 0.5 END AS table_value, {SIX.format('pow(0.5, (c_custkey % 1000) / 365.0::DOUBLE)')} AS recency FROM customer")
def number_kernels(spark, d):
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    return table(spark, d, "customer").select(k.alias("k"), six(measures.logistic(b / 1000), "logistic"), six(measures.amount_proximity((1 + k % 40) / F.lit(10.0)), "near"), six(measures.interpolate(b, [(0.0, 0.0), (5000.0, 0.5)]), "table_value"), six(measures.recency(k % 1000, 365), "recency"))


@query("SELECT s_suppkey AS company, 'supplier' || regexp_replace(s_name, '[^0-9]', '', 'g') AS core, 'supplier' || regexp_replace(s_name, '[^0-9]', '', 'g') || 'ing' AS buyer FROM supplier")
def distinctive_names(spark, d):
    n = F.concat(F.lit("Sté "), F.col("s_name"), F.lit(" TRAVAUX et Études SARL"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("company"), text.distinctive_name(n).alias("core"), text.buyer_key(F.concat(F.lit("MEN/DRC - "), F.col("s_name"), F.lit(" ing"))).alias("buyer"))


@query("SELECT c_name AS buyer, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS buyer_key, count(*) AS tenders FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1, 2")
def buyer_dimension_before(spark, d):
    """Buyers of the past by key, with their most frequent spelling, cut strictly before a day."""
    from adjudica.sources import readers

    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    past = asof.cut(o.select(F.col("c_name").alias("buyer"), F.to_date("o_orderdate").alias("day")), "day", "1998-01-01", False)
    return readers.buyer_dimension(past.select("buyer")).select("buyer_key", "buyer", "tenders")


@query("SELECT page_id, contains(html, '<article') AS article, contains(html, 'class=\"ad\"') AS advert, contains(html, '<nav') AS nav, contains(html, '<footer') AS footer, contains(html, '<script') AS script, contains(html, '<style') AS style, contains(html, '<table') AS tables, contains(html, '<form') AS form, contains(html, '<h1') AS heading, contains(html, 'href=') AS links, contains(html, '<li>') AS items, contains(html, '<!--') AS remarks, contains(html, '&copy;') AS references_ FROM pages")
def page_indicators(spark, d):
    """Thirteen indicators of a page."""
    from adjudica.sources import readers

    found = {"article": "<article", "advert": 'class="ad"', "nav": "<nav", "footer": "<footer", "script": "<script", "style": "<style", "tables": "<table", "form": "<form", "heading": "<h1", "links": "href=", "items": "<li>", "remarks": "<!--", "references_": "&copy;"}
    return readers.feature_flags(table(spark, d, "pages"), "html", found).select("page_id", *found)


_SYLLABLES = ["ta", "ri", "mou", "ben", "zem", "la", "khe", "ou"]


def _places(k):
    """An invented place name of four syllables for a number."""
    return F.concat(*[F.element_at(F.array(*[F.lit(x) for x in _SYLLABLES]), (F.floor(k / 8**i) % 8 + 1).cast("int")) for i in (3, 2, 1, 0)])


def _buyers(spark, d):
    """Buyers of notices (of every tenth customer with a letter changed, of others as they are or unknown) and of the history."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    known = c.where("c_custkey % 3 < 2").select(text.buyer_key(F.concat(F.lit("Commune de "), _places(k))).alias("key"), F.concat(F.lit("Commune de "), _places(k)).alias("name")).distinct()
    name = F.when(k % 10 == 0, F.concat(F.lit("Commune rurale de "), F.substring(_places(k), 1, 3), F.lit("x"), F.substring(_places(k), 4, 20))).otherwise(F.concat(F.lit("Commune de "), _places(k)))
    return c.select(k.alias("id"), name.alias("name")), known


@query()
def buyer_resolution(spark, d):
    """How each buyer of a notice is found again in the history (tested against all pairs)."""
    from adjudica.operators import names

    return names.resolve(*_buyers(spark, d))


@query()
def buyer_resolution_coverage(spark, d):
    from adjudica.operators import names

    return names.resolve(*_buyers(spark, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
