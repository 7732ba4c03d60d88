"""Queries of units, descriptors, changes and coverage over the star schema; each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from adjudica.functions import text
from adjudica.operators import commission, similarity
from adjudica.plans.adapter import table, tenders
from adjudica.sources import sinks

CATALOGUE: dict = {}


def query(sql: str | None = None):
    def register(fn):
        CATALOGUE[fn.__name__] = (fn, sql)
        return fn

    return register


_FAMILIES = [("fixation", ["ring", "bolt"]), ("divers", ["widg*"])]
_FAMILY = "CASE WHEN regexp_matches(p_name, '(^| )(rings?|bolts?)($| )') THEN 'fixation' WHEN regexp_matches(p_name, '(^| )widg[a-z]*($| )') THEN 'divers' END"


@query(f"SELECT count(*) AS titles, count({_FAMILY}) AS classified, count(*) - count({_FAMILY}) AS unclassified FROM part")
def family_coverage(spark, d):
    family = text.classify(F.col("p_name"), _FAMILIES)
    return table(spark, d, "part").select(family.alias("f")).agg(F.count(F.lit(1)).alias("titles"), F.count("f").alias("classified"), F.count_if(F.col("f").isNull()).alias("unclassified"))


@query(f"SELECT p_name AS skeleton, count(*) AS n FROM part WHERE {_FAMILY} IS NULL GROUP BY 1 ORDER BY n DESC, skeleton LIMIT 15")
def unclassified_skeletons(spark, d):
    """The most frequent titles that no family knows, by what they say is done; numbers and places go."""
    rows = table(spark, d, "part").where(text.classify(F.col("p_name"), _FAMILIES).isNull())
    title = F.concat("p_name", F.lit(" 12 au niveau de la ville"))
    return rows.groupBy(text.skeleton(title).alias("skeleton")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "skeleton").limit(15)


_SIDES = "a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1)"


def _sides(spark, d):
    o, half = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderdate"), F.lit("1998-01-01").cast("timestamp_ntz")
    side = lambda c: o.where(c).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return side(F.col("o_orderdate") < half), side(F.col("o_orderdate") >= half)


@query(f"WITH {_SIDES} SELECT b.k, b.n, a.n IS DISTINCT FROM b.n AS changed FROM b LEFT JOIN a USING (k)")
def diff_apply(spark, d):
    """The table after the changes: only rows that differ were written."""
    return sinks.apply_changes(*_sides(spark, d), ["k"], ["n"])[0]


@query(f"WITH {_SIDES} SELECT CASE WHEN a.k IS NULL THEN 'ajout' WHEN b.k IS NULL THEN 'retrait' ELSE 'changement' END AS kind, count(*) AS n FROM a FULL JOIN b ON a.k = b.k WHERE a.n IS DISTINCT FROM b.n GROUP BY 1")
def diff_audit(spark, d):
    return sinks.apply_changes(*_sides(spark, d), ["k"], ["n"])[1]


_LINES = "SELECT l_orderkey AS unit, min(l_partkey) AS p, string_agg(DISTINCT p_brand || ':' || p_size, ',' ORDER BY p_brand || ':' || p_size) AS qualifications FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1"


@query(f"SELECT o_orderkey AS unit, p_name AS text, qualifications FROM orders LEFT JOIN ({_LINES}) q ON q.unit = o_orderkey LEFT JOIN part ON p_partkey = q.p")
def unit_descriptors(spark, d):
    """The text of each unit and what qualifications it asks for, null where neither is known."""
    part = table(spark, d, "part")
    rows = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("unit"), F.col("p_partkey").alias("p"), F.concat_ws(":", "p_brand", F.col("p_size").cast("string")).alias("q"))
    own = rows.groupBy("unit").agg(F.min("p").alias("p"), F.array_join(F.sort_array(F.collect_set("q")), ",").alias("qualifications")).join(part.select(F.col("p_partkey").alias("p"), text.index_text(F.col("p_name")).alias("text")), "p", "left")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("unit")).join(own.drop("p"), "unit", "left")


_CODES = "c AS (SELECT l_orderkey AS unit, list_distinct(list(p_brand)) AS codes, list_distinct(list(p_type)) AS domains FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1), t AS (SELECT o_orderkey AS unit, o_custkey AS buyer, o_totalprice AS v, codes, domains FROM orders LEFT JOIN c ON c.unit = o_orderkey)"


@query(f"WITH {_CODES}, p AS (SELECT a.unit AS target, b.unit AS base, b.v / a.v BETWEEN 0.3 AND 3 AS amount, a.codes AS ac, b.codes AS bc, a.domains AS ad, b.domains AS bd FROM t a JOIN t b ON a.buyer = b.buyer AND a.unit <> b.unit) SELECT target, base, amount AND coalesce(list_has_any(ac, bc), true) AS by_code, amount AND coalesce(list_has_any(ad, bd), true) AS by_domain, amount AS by_none FROM p")
def eligibility_mask(spark, d):
    """Which tenders of one buyer may be compared: by amount, and by a common code or domain where both are known."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    codes = rows.groupBy(F.col("l_orderkey").alias("unit")).agg(F.collect_set("p_brand").alias("codes"), F.collect_set("p_type").alias("domains"))
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("unit"), F.col("o_custkey").alias("buyer"), F.col("o_totalprice").alias("v")).join(codes, "unit", "left")
    side = lambda p: t.select("buyer", *[F.col(c).alias(f"{p}_{c}") for c in ("unit", "v", "codes", "domains")])
    both = side("t").join(side("m"), "buyer").where("t_unit <> m_unit")
    amount = similarity.eligible(F.col("m_v") / F.col("t_v"))
    mode = lambda c: amount & similarity.eligible_qualification(F.col(f"t_{c}"), F.col(f"m_{c}"))
    return both.select(F.col("t_unit").alias("target"), F.col("m_unit").alias("base"), mode("codes").alias("by_code"), mode("domains").alias("by_domain"), amount.alias("by_none"))


@query("""WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS ref, o_orderpriority = '1-URGENT' AS lots FROM orders WHERE o_orderstatus <> 'P'), l AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS ref, l_linestatus AS lot FROM lineitem),
 n AS (SELECT ref, count(*) AS k FROM l GROUP BY 1), u AS (SELECT o.ref AS unit, o.ref, CAST(NULL AS VARCHAR) AS lot FROM o LEFT JOIN n USING (ref) WHERE NOT lots OR k IS NULL UNION ALL SELECT o.ref || '#' || lot, o.ref, lot FROM o JOIN l USING (ref) WHERE lots),
 b AS (SELECT CAST(l_orderkey AS VARCHAR) AS ref, l_linestatus AS lot, l_returnflag = 'A' AS admitted FROM lineitem)
 SELECT unit, count(b.ref) AS bids, count(*) FILTER (admitted) AS admitted FROM u LEFT JOIN b ON b.ref = u.ref AND (u.lot IS NULL OR u.lot = b.lot) GROUP BY 1""")
def units_of_lots(spark, d):
    """Bids of each unit: of a simple tender all, of a lot those that name it. A tender of several lots has no unit of its own."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    ref = F.col("l_orderkey").cast("string").alias("ref")
    lots = li.select(ref, F.col("l_linestatus").alias("lot")).distinct().withColumns({"estimation": F.lit(None).cast("double"), "title": F.lit(None).cast("string")})
    n = lots.groupBy("ref").agg(F.count(F.lit(1)).cast("int").alias("n"))
    canonical = o.select(F.col("o_orderkey").cast("string").alias("ref"), (F.col("o_orderstatus") != "P").alias("main"), (F.col("o_orderpriority") == "1-URGENT").alias("_l")).join(n, "ref", "left")
    nothing = {c: F.lit(None).cast(t) for c, t in (("buyer", "string"), ("sort_date", "string"), ("doubtful", "boolean"), ("estimation", "double"), ("title", "string"), ("unsuccessful", "boolean"))}
    canonical = canonical.withColumns(nothing).withColumn("n_lots", F.when(F.col("_l"), F.col("n")))
    offers = li.select(ref, F.col("l_linenumber").cast("long").alias("id"), F.col("l_extendedprice").alias("amount_deed"), F.lit(None).cast("double").alias("amount_checked"), F.when(F.col("l_returnflag") == "A", "admis").otherwise("depose").alias("status"), F.col("l_linestatus").alias("lots"))
    units, own = commission.load_units(canonical, lots, offers)
    counted = own.groupBy("unit").agg(F.count(F.lit(1)).alias("bids"), F.count_if("admitted").alias("admitted"))
    return units.select("unit").join(counted, "unit", "left").na.fill(0, ["bids", "admitted"])


@query("SELECT o_orderpriority AS priority, count(*) AS n, min(CAST(o_orderdate AS DATE)) AS first FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '1997-06-01' AND o_orderstatus <> 'P' GROUP BY 1")
def as_of_cut(spark, d):
    """What was known strictly before a day, without doubtful dates."""
    from adjudica.operators import asof

    rows = asof.cut(tenders(spark, d).withColumn("odd", F.col("status") == "P"), "day", "1997-06-01", False, "odd")
    return rows.groupBy("priority").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("first"))
