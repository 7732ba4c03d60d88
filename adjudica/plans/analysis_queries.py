"""Queries of the streaming counters, communities, the title index, laws, regressions and matching; each with its DuckDB SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from adjudica.functions import measures, text
from adjudica.functions.measures import logistic
from adjudica.operators import bidder_laws, bidders, commission, copresence, grouped_fit, louvain, marts, search, sheets, similar_markets, similarity, title_index
from adjudica.operators.components import scratch_path, stored
from adjudica.plans.adapter import BIDS_SQL, FULL_SQL, PRESENCES_SQL, TENDERS_SQL, bids, events, presences, table, tenders
from adjudica.plans.market_queries import _OUTCOMES, _SHEET, OFFERS_SQL, SIX, _group_outcomes, _levels, _members, _offers, six
from adjudica.plans.model_queries import _FEATURES, _PAIRED, _WINDOWED, _alike, _history, _places
from adjudica.plans.tender_queries import _candidates, _prices, _ranked
from adjudica.sources import readers
from adjudica.streaming import counters

CATALOGUE: dict = {}


def query(sql: str | None = None):
    def register(fn):
        CATALOGUE[fn.__name__] = (fn, sql)
        return fn

    return register


def _stream(spark, d):
    """The events as a stream, and after them one event of nobody two days later, at which the watermark passes all others. The path is a
    pattern, as a stream takes no path of a single file."""
    batch = table(spark, d, "events")
    path, closing = f"{d}/events.par[q]uet", scratch_path(spark, "closing")
    batch.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), (F.col("ts") + F.expr("INTERVAL 2 DAY")).alias("ts")).write.parquet(closing)
    columns = ["event_id", "user_id", "event_type", "ts"]
    read = lambda where, kind: spark.readStream.schema(kind).parquet(where).select(F.col("event_id").cast("long"), F.col("user_id").cast("long"), "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return read(path, batch.schema).unionByName(read(closing, spark.read.parquet(closing).schema)).select(*columns)


def _drained(spark, out, name):
    path = scratch_path(spark, name)
    counters.drained(out, path, scratch_path(spark, f"{name}-checkpoint"))
    return spark.read.schema(out.schema).parquet(path).where("event_id >= 0")


@query("SELECT event_id, user_id, count(*) OVER w AS recent, count(*) OVER w > 2 AS over FROM (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)")
def stream_rate_limit(spark, d):
    """The limit as a stream with state; every event once the watermark has passed it."""
    out = counters.rate_limited(_stream(spark, d), "user_id", "ts", "0 seconds", 2, 3600, ("event_id",))
    return _drained(spark, out, "stream-rate").select("event_id", "user_id", "recent", "over")


@query("WITH e AS (SELECT user_id, event_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events) SELECT event_id, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING), 0) >= 2 AS locked FROM e")
def stream_lockout(spark, d):
    out = counters.locked_out(_stream(spark, d), "user_id", "ts", "0 seconds", F.col("event_type") == "error", 2, 86400, ("event_id",))
    return _drained(spark, out, "stream-lockout").select("event_id", "locked")


@query()
def community_ladder(spark, d):
    """Communities by modularity at three resolutions, a row a level (held against a sequential version)."""
    edges = stored(copresence.pairs(presences(spark, d), 3).where("excess >= 1.2 AND together >= 6").select("a", "b", F.col("together").alias("weight")), "edges")
    return louvain.modularity(edges, louvain.ladder(edges, (1.0, 3.0, 8.0)))


_GRAMS = """w AS (SELECT doc_id AS id, ' ' || unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) || ' ' AS w FROM documents WHERE text IS NOT NULL),
 g AS (SELECT id, g, count(*) AS n FROM (SELECT id, unnest([substr(w, CAST(i AS BIGINT), k) FOR i IN range(1, greatest(1, length(w) - k + 1) + 1)]) AS g FROM w, (VALUES (3), (4)) s(k)) GROUP BY 1, 2), f AS (SELECT g, count(*) AS df FROM g GROUP BY 1 HAVING count(*) >= 2),
 v AS (SELECT id, g, (1 + ln(n)) * (ln((1 + (SELECT count(DISTINCT id) FROM g)) / (1.0::DOUBLE + df)) + 1) AS x FROM g JOIN f USING (g)), u AS (SELECT id, g, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM v),
 c AS (SELECT a.id AS target, b.id AS base, sum(a.x * b.x) AS s FROM u a JOIN u b ON a.g = b.g AND b.id < a.id WHERE a.id % 20 = 0 GROUP BY 1, 2)"""


@query(f"WITH {_GRAMS} SELECT target, base, row_number() OVER (PARTITION BY target ORDER BY round(s, 9) DESC, base DESC) AS rank FROM c QUALIFY rank <= 20")
def title_index_topk(spark, d):
    """The 20 texts most like each whose number divides by 20, among those before it, from an index that is written and read again."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title"), F.col("doc_id").alias("day"))
    folder, grams = scratch_path(spark, "title-index"), similarity.word_ngrams(F.col("title"))
    title_index.open_index(docs, folder, grams)
    return title_index.top(title_index.open_index(docs, folder, grams), F.col("id") % 20 == 0, 20).select("target", "base", F.col("rank").cast("long").alias("rank"))


_SHARES = f"{PRESENCES_SQL}, k AS (SELECT buyer, company, count(*) AS n FROM presences GROUP BY ALL), m AS (SELECT buyer, count(DISTINCT unit) AS m FROM presences GROUP BY 1), s AS (SELECT buyer, company, n / (m + 1.0::DOUBLE) AS p, m FROM k JOIN m USING (buyer))"


def _shares(spark, d):
    p = presences(spark, d)
    n, m = p.groupBy("buyer", "company").agg(F.count(F.lit(1)).alias("n")), p.groupBy("buyer").agg(F.count_distinct("unit").alias("m"))
    return n.join(m, "buyer").select("buyer", "company", (F.col("n") / (F.col("m") + 1.0)).alias("p"), "m")


@query(
    f"WITH {_SHARES}, l AS (SELECT buyer, list_reduce(list_prepend([1.0::DOUBLE], list([p] ORDER BY company)), lambda a, x: [coalesce(a[CAST(i AS INT)], 0) * (1 - x[1]) + coalesce(a[CAST(i - 1 AS INT)], 0) * x[1] FOR i IN range(1, len(a) + 2)]) AS law FROM s GROUP BY 1) "
    "SELECT buyer, CAST(generate_subscripts(law, 1) - 1 AS BIGINT) AS k, floor(unnest(law) * 1e9 + 0.5) / 1e9 AS chance FROM l"
)
def bidder_law(spark, d):
    """The whole law of the number of a buyer's bidders."""
    laws = bidder_laws.count_laws(_shares(spark, d), ["buyer"], "p", ["company"])
    return laws.select("buyer", F.posexplode("law").alias("k", "c")).select("buyer", F.col("k").cast("long").alias("k"), (F.floor(F.col("c") * 1e9 + 0.5) / F.lit(1e9)).alias("chance"))


_TARGET = "exp((6 / (m + 6.0::DOUBLE)) * ln(mean) + (m / (m + 6.0::DOUBLE)) * ln(greatest(1.0, m / 2.0::DOUBLE)))"


@query(
    f"WITH {_SHARES}, z AS (SELECT buyer, any_value(m) AS m, sum(p) + 0.3 AS mean, list(ln(p / (1 - p)) ORDER BY company) AS zs FROM s GROUP BY 1), t AS (SELECT *, {_TARGET} AS target FROM z), "
    "r AS (SELECT buyer, target, list_reduce(list_prepend([-6.0::DOUBLE, 6.0, target], [zs FOR i IN range(50)]), lambda e, x: CASE WHEN list_sum([1 / (1 + exp(-(y + (e[1] + e[2]) / 2))) FOR y IN x]) + 0.3 * exp((e[1] + e[2]) / 2) < e[3] THEN [(e[1] + e[2]) / 2, e[2], e[3]] ELSE [e[1], (e[1] + e[2]) / 2, e[3]] END) AS e FROM t) "
    f"SELECT buyer, {SIX.format('target')} AS target, {SIX.format('(e[1] + e[2]) / 2')} AS shift FROM r"
)
def recalibration_shift(spark, d):
    """The shift at which a buyer's expected number of bidders is the blend of the model's and its own history's."""
    own = _shares(spark, d).groupBy("buyer").agg(F.max("m").alias("m"), (F.sum("p") + 0.3).alias("mean"), F.sort_array(F.collect_list(F.struct("company", F.ln(F.col("p") / (1 - F.col("p"))).alias("z")))).getField("z").alias("zs"))
    target = bidders.history_target(F.col("mean"), F.col("m"), F.col("m") / 2.0, 6.0)
    shift = bidder_laws.shift_to(F.col("zs"), F.lit(0.3), F.lit(0.0), F.col("target"))
    return own.withColumn("target", target).withColumn("shift", shift).select("buyer", six(F.col("target"), "target"), six(F.col("shift"), "shift"))


@query()
def segment_fits(spark, d):
    """A logistic regression of each priority class, all at once (held against plain Newton steps)."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("segment")), "l_orderkey")
    rows = rows.select("segment", (F.col("l_quantity") / 50).alias("quantity"), (F.col("l_discount") * 10).alias("discount"), F.ln("l_extendedprice").alias("price"), (F.col("l_returnflag") == "A").alias("came"))
    fits = grouped_fit.fit_logistic_by(rows, "segment", ["quantity", "discount", "price"], "came", 1.0)
    return fits.select("segment", "n", "intercept", *[F.element_at("coefficients", k + 1).alias(c) for k, c in enumerate(("quantity", "discount", "price"))])


_MATCHES = f"""{BIDS_SQL}, ti AS (SELECT unit, p_name AS title FROM bids JOIN part ON p_partkey = part WHERE seq = 1), o AS (SELECT o_orderkey AS k, o_orderpriority AS org, year(o_orderdate) AS y, title FROM orders LEFT JOIN ti ON unit = o_orderkey),
 mi AS (SELECT k, org, (k % 700) || '/' || y AS reference, regexp_extract_all(upper('works ' || coalesce(title, '')), '[A-ZÀ-ÿ]{{5,}}') AS w FROM o WHERE k % 11 = 0), no AS (SELECT k, org, regexp_replace(upper(concat_ws(' ', k || '/' || y, title)), '[^A-Z0-9/]', '', 'g') AS line, regexp_extract_all(upper(concat_ws(' ', k || '/' || y, title)), '[A-ZÀ-ÿ]{{5,}}') AS v FROM o WHERE k % 7 = 0),
 pa AS (SELECT mi.k, no.k AS nk, CAST(len(list_distinct(list_intersect(w, v))) AS INT) AS common FROM mi JOIN no ON mi.org = no.org AND contains(line, reference)),
 be AS (SELECT *, count(*) OVER (PARTITION BY k) AS candidates, row_number() OVER (PARTITION BY k ORDER BY common DESC, CAST(nk AS VARCHAR)) AS r, count(*) OVER (PARTITION BY k, common) AS level FROM pa),
 ma AS (SELECT CAST(mi.k AS VARCHAR) AS ref, CAST(nk AS VARCHAR) AS notice_ref, common, coalesce(candidates, 0) AS candidates, CASE WHEN nk IS NULL THEN 'sans' WHEN candidates = 1 THEN 'reference' WHEN common >= 3 AND level = 1 THEN 'objet' ELSE 'a_verifier' END AS confidence FROM mi LEFT JOIN be ON be.k = mi.k AND r = 1)"""


def _matches(spark, d):
    titles = bids(spark, d).where("seq = 1").join(table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_name").alias("title")), "part").select(F.col("unit").alias("o_orderkey"), "title")
    o = table(spark, d, "orders").join(titles, "o_orderkey", "left").withColumns({"ref": F.col("o_orderkey").cast("string"), "y": F.year("o_orderdate").cast("string")})
    minutes = o.where("o_orderkey % 11 = 0").select("ref", F.col("o_orderpriority").alias("org"), F.concat((F.col("o_orderkey") % 700).cast("string"), F.lit("/"), "y").alias("reference"), F.concat(F.lit("works "), F.coalesce("title", F.lit(""))).alias("title"))
    notices = o.where("o_orderkey % 7 = 0").select("ref", F.col("o_orderpriority").alias("org"), F.concat("ref", F.lit("/"), "y").alias("reference"), F.col("title").alias("text"))
    return readers.match_notices(minutes, notices)


@query(f"WITH {_MATCHES} SELECT * FROM ma")
def reference_matches(spark, d):
    """Minutes found again among notices of the same organisation by a reference that is inside theirs."""
    return _matches(spark, d)


@query(f"WITH {_MATCHES} SELECT confidence, count(*) AS n, 100.0 * count(*) / (SELECT count(*) FROM ma)::DOUBLE AS percent FROM ma GROUP BY 1")
def matching_quality(spark, d):
    return readers.matching_quality(_matches(spark, d))


@query("SELECT year(o_orderdate) AS year, count(*) AS notices, count(*) FILTER (o_orderstatus = 'F') AS awarded, count(*) FILTER (o_orderstatus = 'O') AS open, count(DISTINCT o_custkey) AS buyers FROM orders GROUP BY 1")
def notice_census(spark, d):
    """Notices of each year, by status, with their buyers."""
    return table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(
        F.count(F.lit(1)).alias("notices"), F.count_if(F.col("o_orderstatus") == "F").alias("awarded"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_distinct("o_custkey").alias("buyers")
    )


# the analysis of a tender, end to end


_NEAR = f"""{_PAIRED}, t300 AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(score, 9) DESC, m_day DESC, base DESC) AS rank FROM sc QUALIFY rank <= 300),
 wt AS (SELECT *, CASE WHEN rank <= 50 THEN score / 100 * rec ELSE 0 END AS wgt FROM t300), wa_ AS (SELECT target, sum(wgt) AS alls FROM wt GROUP BY 1),
 cs_ AS (SELECT wt.target, company, sum(wgt) / any_value(alls) AS sim, count(*) FILTER (rank <= 50) AS n_similar, count(*) AS n_near FROM wt JOIN wa_ USING (target) JOIN presences ON presences.unit = base GROUP BY 1, 2)"""
def _told(spark, d):
    """(features, found): the fifteen features of the candidates of all three ways, with what the similar markets and the class say of them."""
    t, history = _history(spark, d)
    found = stored(_alike(spark, d, 300), "similar-300")
    told = similar_markets.company_similarity(found, presences(spark, d))
    classes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("company"), (F.col("s_nationkey") % 6).cast("int").alias("class"))
    targets = t.where("unit % 20 = 0").withColumn("class", (F.col("unit") % 6).cast("int"))
    return bidders.candidate_features(targets, history, told, classes), found


_FIFTEEN = {
    "similar": "coalesce(sim, 0)", "similar_n": "ln(1 + coalesce(n_similar, 0))", "near_n": "ln(1 + coalesce(n_near, 0))", "buyer_share": "bu / (u3 + 1)", "buyer_n": "ln(1 + bu)", "qualification": "q", "activity": "ln(1 + active)",
    "idle_years": "coalesce(least(3.0, (day - latest) / 365.0::DOUBLE), 3)", "region_share": "CASE WHEN profile > 0 THEN reg / profile ELSE 0 END", "region_n": "ln(1 + reg12)", "family_share": "CASE WHEN profile > 0 THEN fam / profile ELSE 0 END",
    "size_gap": "coalesce(least(3.0, abs(size - usual)), 1)", "buyer_family": "bufam / (uf + 2)", "buyer_family_n": "ln(1 + bufam)", "buyer_24": "bu24 / (u2 + 2)",
}
_FT = f"""{BIDS_SQL}, {PRESENCES_SQL}, {TENDERS_SQL}, {_FEATURES}, {_NEAR}, cd3 AS (SELECT unit, company FROM cd UNION SELECT target, company FROM cs_), {_WINDOWED.replace("FROM cd JOIN", "FROM cd3 JOIN")},
 qq AS (SELECT s_suppkey AS company, s_nationkey % 6 AS cl FROM supplier), fq AS (SELECT ft.*, u3, u2, uf, sim, n_similar, n_near, CASE abs(ft.unit % 6 - cl) WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 WHEN 2 THEN 0.3 ELSE 0.0 END AS q FROM ft JOIN un USING (unit) JOIN qq USING (company) LEFT JOIN cs_ ON cs_.target = ft.unit AND cs_.company = ft.company WHERE w = 0),
 x15 AS (SELECT unit, company, bufam >= 2 AS regular, {", ".join(f"{x} AS f_{n}" for n, x in _FIFTEEN.items())} FROM fq WHERE coalesce(n_similar, 0) > 0 OR q > 0)"""


@query(f"WITH {_FT} SELECT unit, company, regular, " + ", ".join(f"{SIX.format(f'f_{n}')} AS \"{n}\"" for n in _FIFTEEN) + " FROM x15")
def bidder_features_all(spark, d):
    """The fifteen features of all candidates, of the three ways to come across one, pruned where no similar market and no qualification speaks for one."""
    told, _ = _told(spark, d)
    return told.select("unit", "company", "regular", *[six(F.col(c), c) for c in _FIFTEEN])


# The formula that holds until one is fitted, and what nothing announces.
FORMULA = (-5.0, {"similar": 1.5, "similar_n": 1.0, "near_n": 0.3, "buyer_share": 3.5, "buyer_n": 0.4, "qualification": 1.5, "activity": 0.0, "idle_years": -3.5, "region_share": 1.0, "region_n": 0.3, "family_share": 0.5, "size_gap": -0.5})
OTHERS = (0.2, 0.3)
_LOGIT = " + ".join([str(FORMULA[0]), *[f"{w} * f_{n}" for n, w in FORMULA[1].items()]])


@query(
    f"WITH {_FT}, pr AS (SELECT unit, company, 1 / (1 + exp(-({_LOGIT}))) AS p FROM x15), of AS (SELECT target AS unit, avg(k) AS offers FROM t300 JOIN (SELECT unit AS base, count(*) AS k FROM presences GROUP BY 1) USING (base) WHERE rank <= 50 GROUP BY 1), "
    f"lw AS (SELECT unit, count(*) AS candidates, sum(p) AS mean, coalesce(any_value(greatest(0.0, {OTHERS[0]} + {OTHERS[1]} * offers)), {OTHERS[0]}) AS lam, list_reduce(list_prepend([1.0::DOUBLE], list([p] ORDER BY company)), lambda a, x: [coalesce(a[CAST(i AS INT)], 0) * (1 - x[1]) + coalesce(a[CAST(i - 1 AS INT)], 0) * x[1] FOR i IN range(1, len(a) + 2)]) AS law FROM pr LEFT JOIN of USING (unit) GROUP BY 1), "
    "po AS (SELECT *, [exp(-lam + j * ln(lam) - lgamma(j + 1)) FOR j IN range(0, 60)] AS po FROM lw), "
    "cv AS (SELECT unit, candidates, mean + lam AS expected, lam, unnest(range(0, CAST(len(law) + 59 AS BIGINT))) AS k, law, po FROM po), "
    "ma AS (SELECT unit, candidates, expected, lam, k, list_sum([coalesce(law[CAST(k - j + 1 AS INT)], 0) * po[CAST(j + 1 AS INT)] FOR j IN range(greatest(0, k - len(law) + 1), least(k, 59) + 1)]) AS c FROM cv), "
    "cu AS (SELECT *, sum(c) OVER (PARTITION BY unit ORDER BY k) AS s FROM ma) "
    f"SELECT unit, candidates, {SIX.format('any_value(expected)')} AS expected, {SIX.format('any_value(lam)')} AS unannounced, CAST(min(k) FILTER (s >= 0.1 - 1e-12) AS INT) AS low, CAST(min(k) FILTER (s >= 0.9 - 1e-12) AS INT) AS high FROM cu GROUP BY unit, candidates"
)
def tender_analysis(spark, d):
    """Of each tender whose number divides by 20: candidates, expected bidders, those that nothing announces, and the 80 % interval of their number."""
    told, found = _told(spark, d)
    chances = stored(told.select("unit", "company", logistic(bidders.linear(list(FORMULA[1]), FORMULA[1], FORMULA[0])).alias("p")), "chances")
    offers = presences(spark, d).groupBy(F.col("unit").alias("m_unit")).agg(F.count(F.lit(1)).alias("k"))
    mean = found.where("rank <= 50").join(offers, "m_unit").groupBy(F.col("t_unit").alias("unit")).agg(F.avg("k").alias("offers"))
    settings = chances.groupBy("unit").agg(F.count(F.lit(1)).alias("candidates"), F.sum("p").alias("mean")).join(mean, "unit", "left")
    settings = settings.withColumns({"unannounced": F.coalesce(bidders.unannounced(F.col("offers"), *OTHERS), F.lit(OTHERS[0])), "spread": F.lit(0.0), "shift": F.lit(0.0)})
    laws = bidder_laws.mixed_laws(chances, ["unit"], "p", ["company"], settings.select("unit", "unannounced", "spread", "shift"))
    ends = [bidder_laws.quantile_of(F.col("law"), q).alias(c) for c, q in (("low", 0.1), ("high", 0.9))]
    return settings.join(laws, "unit").select("unit", "candidates", six(F.col("mean") + F.col("unannounced"), "expected"), six(F.col("unannounced"), "unannounced"), *ends)


# reports and lists


_WINNERS = "wi AS (SELECT unit, min(bidder) AS winner FROM bids WHERE status = 'A' GROUP BY 1), nb AS (SELECT unit, count(*) AS offers FROM cand GROUP BY 1)"


@query(
    f"{FULL_SQL}, {_WINNERS}, u AS (SELECT t.unit, CASE WHEN t.unit % 50 > 0 THEN CAST(year(day) AS VARCHAR) ELSE 'date douteuse' END AS year, winner, p.reference, bidder, offers, CASE WHEN t.unit % 7 = 0 THEN p.reference + 1 WHEN t.unit % 11 > 0 THEN p.reference END AS stored FROM tenders t LEFT JOIN wi ON wi.unit = t.unit LEFT JOIN prices p ON p.unit = t.unit LEFT JOIN (SELECT unit, bidder FROM ranked WHERE rank = 1) r ON r.unit = t.unit LEFT JOIN nb ON nb.unit = t.unit), "
    f"s AS (SELECT 'all' AS scope, '' AS value, * FROM u UNION ALL SELECT 'year', year, * FROM u UNION ALL SELECT 'offers', CASE WHEN offers <= 2 THEN '1-2' WHEN offers <= 4 THEN '3-4' WHEN offers <= 7 THEN '5-7' ELSE '8+' END, * FROM u WHERE winner IS NOT NULL AND reference IS NOT NULL) "
    "SELECT scope, value, count(*) AS units, count(*) FILTER (winner IS NULL) AS not_awarded, count(*) FILTER (winner IS NOT NULL AND reference IS NULL) AS no_reference, count(*) FILTER (winner IS NOT NULL AND reference IS NOT NULL) AS comparable, count(*) FILTER (winner IS NOT NULL AND reference IS NOT NULL AND bidder = winner) AS agreed, "
    "count(*) FILTER (winner IS NOT NULL AND reference IS NOT NULL AND (stored IS NULL OR abs(reference - stored) > 0.01)) AS reference_differs, agreed / nullif(comparable, 0) AS rate FROM s GROUP BY 1, 2"
)
def concordance_report(spark, d):
    """The rule against the actual winners, by year and bracket, with what cannot be compared by reason."""
    prices, b = _prices(spark, d), bids(spark, d)
    first = _ranked(spark, d).where("rank = 1").select("unit", "bidder")
    offers = _candidates(spark, d).groupBy("unit").agg(F.count(F.lit(1)).alias("offers"))
    designated = prices.select("unit", "reference").join(first, "unit", "left").join(offers, "unit", "left")
    k, ref = F.col("unit"), F.col("reference")
    stored_ = prices.select("unit", F.when(k % 7 == 0, ref + 1).when(k % 11 > 0, ref).alias("stored_reference"))
    winners = b.where("status = 'A'").groupBy("unit").agg(F.min("bidder").alias("winner"))
    units = tenders(spark, d).select("unit", F.when(k % 50 > 0, F.year("day")).alias("year")).join(winners, "unit", "left").join(stored_, "unit", "left")
    return commission.concordance_report(units, designated)


@query(
    f"{FULL_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY unit, lot ORDER BY amount, seq) AS r FROM cand), w AS (SELECT bidder, 1 AS s, 0 AS l FROM ranked WHERE rank = 1 AND unit % 2 = 0 UNION ALL SELECT bidder, 0, 1 FROM f WHERE r = 1 AND unit % 2 = 1) "
    "SELECT CASE WHEN bidder % 10 = 0 THEN bidder - 1 ELSE bidder END AS company, CAST(sum(s) AS BIGINT) AS simple, CAST(sum(l) AS BIGINT) AS lots, CAST(count(*) AS BIGINT) AS wins FROM w GROUP BY 1"
)
def wins_with_merges(spark, d):
    """Wins of tenders and of lots (the lowest bid of each), every tenth company merged into the one before."""
    simple = _ranked(spark, d).where("rank = 1 AND unit % 2 = 0").select(F.col("bidder").alias("winner"))
    lots = _candidates(spark, d).where("unit % 2 = 1").groupBy("unit", "lot").agg(F.min_by("bidder", F.struct("amount", "seq")).alias("winner"))
    k = F.col("s_suppkey")
    return marts.wins_with_merges(simple, lots, table(spark, d, "supplier").where(k % 10 == 0).select(k.alias("company"), (k - 1).alias("into")))


@query(f"WITH {BIDS_SQL}, {TENDERS_SQL} SELECT buyer, count(DISTINCT unit) AS tenders, count(DISTINCT bidder) AS bidders FROM tenders LEFT JOIN bids USING (unit) GROUP BY 1")
def buyer_bidders(spark, d):
    """The different companies that each buyer has seen."""
    rows = tenders(spark, d).select("unit", "buyer").join(bids(spark, d).select("unit", "bidder"), "unit", "left")
    return rows.groupBy("buyer").agg(F.count_distinct("unit").alias("tenders"), F.count_distinct("bidder").alias("bidders"))


@query("WITH g AS (SELECT l_suppkey AS company, p_type, p_brand, p_size % 5 AS class, l_returnflag AS status, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY company ORDER BY n DESC, p_type, p_brand, class, status) AS place FROM g QUALIFY place <= 40")
def qualification_profile_top(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("company"), "p_type", "p_brand", (F.col("p_size") % 5).alias("class"), F.col("l_returnflag").alias("status"))
    return marts.profile_top(rows, "company", ["p_type", "p_brand", "class", "status"]).withColumn("place", F.col("place").cast("long"))


@query(f"WITH {_SHARES} SELECT buyer, CASE WHEN sum(p) < 10 THEN 0 WHEN sum(p) < 20 THEN 1 ELSE 2 END AS tier FROM s GROUP BY 1")
def predicted_tiers(spark, d):
    return _shares(spark, d).groupBy("buyer").agg(F.sum("p").alias("m")).select("buyer", measures.tier(F.col("m"), 10.0, 20.0).alias("tier"))


_FAMILIES = f"""{PRESENCES_SQL}, fa AS (SELECT company AS number, count(*) % 17 AS score, count(DISTINCT buyer) AS size, count(*) AS units, max(day) AS latest, list_filter(['fort', 'moyen', 'faible'], lambda x: CASE x WHEN 'fort' THEN company % 4 = 0 WHEN 'moyen' THEN company % 3 = 0 ELSE company % 5 < 3 END) AS levels,
 ['Entreprise ' || company, 'Société Générale ' || (company % 7)] AS names FROM presences GROUP BY company)"""


def _families(spark, d):
    k = F.col("number")
    rows = presences(spark, d).groupBy(F.col("company").alias("number")).agg((F.count(F.lit(1)) % 17).alias("score"), F.count_distinct("buyer").alias("size"), F.count(F.lit(1)).alias("units"), F.max("day").alias("latest"))
    levels = F.array_compact(F.array(F.when(k % 4 == 0, "fort"), F.when(k % 3 == 0, "moyen"), F.when(k % 5 < 3, "faible")))
    return rows.withColumns({"levels": levels, "names": F.array(F.concat(F.lit("Entreprise "), k.cast("string")), F.concat(F.lit("Société Générale "), (k % 7).cast("string")))})


_FOUND = "list_has_any(levels, ['fort', 'moyen']) AND len(list_filter(names, lambda x: contains(lower(strip_accents(x)), 'generale') AND contains(x, '3'))) > 0"


@query(
    f"WITH {_FAMILIES}, p AS (SELECT sort, number, row_number() OVER (PARTITION BY sort ORDER BY a DESC, b DESC, number) AS place FROM (SELECT 'score' AS sort, number, score AS a, units AS b FROM fa WHERE {_FOUND} UNION ALL SELECT 'taille', number, size, score FROM fa WHERE {_FOUND} UNION ALL SELECT 'marches', number, units, score FROM fa WHERE {_FOUND} UNION ALL SELECT 'recent', number, epoch(latest), score FROM fa WHERE {_FOUND})) SELECT sort, number FROM p WHERE place <= 10"
)
def family_sorts(spark, d):
    """The first ten of the list in each of its four orders, for two levels and two words."""
    out = None
    for sort in ("score", "taille", "marches", "recent"):
        one = search.family_page(_families(spark, d), ["fort", "moyen"], sort, "generale 3", 1, 10).select(F.lit(sort).alias("sort"), "number")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {_FAMILIES} SELECT level, count(*) AS n FROM (SELECT unnest(levels) AS level FROM fa WHERE len(list_filter(names, lambda x: contains(lower(strip_accents(x)), 'generale') AND contains(x, '3'))) > 0) GROUP BY 1")
def family_facets(spark, d):
    return search.family_facets(_families(spark, d), "generale 3")


@query()
def buyer_perturbations(spark, d):
    """How many buyers are found again under a name that is written otherwise, by kind of change (held against properties)."""
    from adjudica.operators import names

    k = F.col("c_custkey")
    name = F.concat(F.when(k % 3 == 0, "Directeur provincial de ").otherwise("Commune de la "), _places(k))
    known = table(spark, d, "customer").select(name.alias("name")).distinct().select(text.buyer_key(F.col("name")).alias("key"), "name")
    return names.perturbation_recall(known)


@query(f"{OFFERS_SQL}, m AS (SELECT p.company AS x, q.company AS y, p.unit, day FROM offers p JOIN offers q ON p.unit = q.unit AND p.company <> q.company JOIN tenders t ON t.unit = p.unit) SELECT x, y, row_number() OVER (PARTITION BY x, y ORDER BY day DESC, unit DESC) AS place, unit, day FROM m QUALIFY place <= 8")
def company_proofs(spark, d):
    """The proofs of each company's sheet: the latest units of each pair."""
    return sheets.proofs(_offers(spark, d), tenders(spark, d)).withColumn("place", F.col("place").cast("long"))


@query(
    f"""{OFFERS_SQL}, {_SHEET}, {_OUTCOMES}, pr AS (SELECT o.unit, grp, count(*) AS present FROM offers o JOIN members USING (company) GROUP BY 1, 2), td AS (SELECT pr.*, day, won, best_member, winner, gap_best FROM pr JOIN tenders t ON t.unit = pr.unit LEFT JOIN outcomes oc ON oc.grp = pr.grp AND oc.unit = pr.unit),
 lt AS (SELECT grp, count(*) AS common, string_agg(CAST(unit AS VARCHAR), ',' ORDER BY n) FILTER (n <= 10) AS latest FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY day DESC, unit DESC) AS n FROM td WHERE present >= 2) GROUP BY 1),
 ls AS (SELECT grp, count(*) AS lost, string_agg(unit || ':' || winner, ',' ORDER BY n) FILTER (n <= 10) AS losses FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY day DESC, unit DESC) AS n FROM td WHERE NOT won) GROUP BY 1), wn AS (SELECT grp, count(*) AS won FROM td WHERE won GROUP BY 1),
 pa AS (SELECT x.grp, count(*) AS pairs, CAST(sum(together) AS BIGINT) AS together FROM sheet JOIN members x ON x.company = sheet.x JOIN members y ON y.company = sheet.y AND y.grp = x.grp WHERE sheet.x < sheet.y GROUP BY 1),
 me AS (SELECT grp, string_agg(CAST(company AS VARCHAR), ',' ORDER BY company) AS members FROM (SELECT DISTINCT grp, company FROM members JOIN offers USING (company)) GROUP BY 1)
 SELECT me.grp AS "group", members, coalesce(common, 0) AS common, coalesce(won, 0) AS won, coalesce(lost, 0) AS lost, coalesce(pairs, 0) AS pairs, together, coalesce(latest, '') AS latest, coalesce(losses, '') AS losses FROM me LEFT JOIN lt USING (grp) LEFT JOIN ls USING (grp) LEFT JOIN wn USING (grp) LEFT JOIN pa USING (grp)"""
)
def group_sheet(spark, d):
    """Every group's sheet, its lists written out."""
    offers = stored(_offers(spark, d), "offers")
    outcomes = stored(_group_outcomes(spark, d, offers), "outcomes")  # read for the roles and for the units
    days = table(spark, d, "orders").select(F.col("o_orderkey").alias("unit"), F.to_date("o_orderdate").alias("day"))
    rows = sheets.group_sheets(_members(spark, d), offers, outcomes, _levels(spark, d), days)
    text_of = lambda c, f: F.array_join(F.transform(c, f), ",")
    return rows.select(
        "group", text_of("members", lambda m: m["company"].cast("string")).alias("members"), "common", "won", "lost", F.size("pairs").cast("long").alias("pairs"), F.when(F.size("pairs") > 0, F.aggregate("pairs", F.lit(0).cast("long"), lambda n, p: n + p["together"])).alias("together"),
        text_of("latest", lambda u: u["unit"].cast("string")).alias("latest"), text_of("losses", lambda u: F.concat(u["unit"].cast("string"), F.lit(":"), u["winner"].cast("string"))).alias("losses"),
    )
