"""The driver's star schema seen as tenders: an order is a tender, its lines are bids, suppliers are companies,
customers are buyers. Amounts are whole cents (as doubles), so that sums are exact in any engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F


#: Lines that a task makes presences of, about.
TASK_ROWS = 1 << 20


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def bids(spark: SparkSession, d: str) -> DataFrame:
    """unit, seq, bidder, amount, status, admitted, lot, shipped."""
    amount = F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100 + 0.5).cast("double")
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("unit"), F.row_number().over(order).cast("long").alias("seq"), F.col("l_suppkey").alias("bidder"), amount.alias("amount"), F.col("l_returnflag").alias("status"),
        (F.col("l_returnflag") == "A").alias("admitted"), F.col("l_linestatus").alias("lot"), F.to_date("l_shipdate").alias("shipped"), F.col("l_partkey").alias("part"),
    )


def tenders(spark: SparkSession, d: str) -> DataFrame:
    """unit, buyer, day, status, estimation (the order's total over its number of lines; null without lines)."""
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("unit")).agg(F.count(F.lit(1)).alias("n"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("unit"), F.col("o_custkey").alias("buyer"), F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("status"), "o_totalprice", F.col("o_orderpriority").alias("priority"))
    return o.join(n, "unit", "left").select("unit", "buyer", "day", "status", "priority", F.floor(F.col("o_totalprice") * 100 / F.col("n") + 0.5).cast("double").alias("estimation"))


def row_tasks(rows: DataFrame) -> int:
    """Among how many tasks ``rows`` are dealt."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))


def presences(spark: SparkSession, d: str) -> DataFrame:
    """unit, company, buyer, day: one row a company and unit."""
    lines = table(spark, d, "lineitem")
    one = lines.select(F.col("l_orderkey").alias("unit"), F.col("l_suppkey").alias("company")).repartition(row_tasks(lines), "unit").distinct()  # one shuffle for this, the join and what groups by unit
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("unit"), F.col("o_custkey").alias("buyer"), F.to_date("o_orderdate").alias("day"))
    return one.join(o, "unit")


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("second", F.unix_seconds(F.col("ts").cast("timestamp")))


#: The same views for the check.
BIDS_SQL = """bids AS (SELECT l_orderkey AS unit, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq, l_suppkey AS bidder,
 floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) AS amount, l_returnflag AS status, l_returnflag = 'A' AS admitted, l_linestatus AS lot, CAST(l_shipdate AS DATE) AS shipped, l_partkey AS part FROM lineitem)"""
TENDERS_SQL = """tenders AS (SELECT o_orderkey AS unit, o_custkey AS buyer, CAST(o_orderdate AS DATE) AS day, o_orderstatus AS status, o_orderpriority AS priority, floor(o_totalprice * 100 / n + 0.5) AS estimation
 FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) c ON l_orderkey = o_orderkey)"""
CANDIDATES_SQL = "cand AS (SELECT * FROM (SELECT *, bool_or(admitted) OVER (PARTITION BY unit) AS anyone FROM bids) WHERE admitted OR NOT anyone)"
PRESENCES_SQL = "presences AS (SELECT DISTINCT l_orderkey AS unit, l_suppkey AS company, o_custkey AS buyer, CAST(o_orderdate AS DATE) AS day FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


def prices_sql(unit: str, source: str = "cand", tenders_name: str = "tenders") -> str:
    """CTEs up to ``prices``, by unit columns."""
    on = " AND ".join(f"a.{u} = t.{u}" for u in unit.split(", ")[:1])
    return f"""lists AS (SELECT {unit}, list(amount ORDER BY amount) AS al, count(*) AS n FROM {source} GROUP BY {unit}),
 mids AS (SELECT a.*, t.estimation, al[CAST(floor(n / 2) AS INT) + 1] AS mid FROM lists a LEFT JOIN {tenders_name} t ON {on}),
 near AS (SELECT *, list_filter(al, lambda x: x >= coalesce(estimation, mid) / 8 AND x <= coalesce(estimation, mid) * 8) AS u1, list_filter(al, lambda x: x >= mid / 8 AND x <= mid * 8) AS u2 FROM mids),
 used AS (SELECT *, CASE WHEN n < 2 THEN al WHEN len(u1) >= 2 THEN u1 WHEN len(u2) >= 2 THEN u2 ELSE al END AS ul FROM near),
 means AS (SELECT *, list_sum(ul) / len(ul) AS mean FROM used),
 prices AS (SELECT {unit}, estimation, n AS n_bids, CAST(len(ul) AS BIGINT) AS n_used, mean,
  CASE WHEN estimation > 0 AND NOT (mean / estimation > 4 OR mean / estimation < 0.25) THEN (mean + estimation) / 2 END AS reference,
  coalesce(estimation > 0 AND (mean / estimation > 4 OR mean / estimation < 0.25), false) AS estimation_discarded FROM means)"""


def ranked_sql(unit: str, source: str = "cand") -> str:
    on = " AND ".join(f"b.{u} = p.{u}" for u in unit.split(", "))
    keys = ", ".join(f"b.{u}" for u in unit.split(", "))
    return f"""ranked AS (SELECT b.*, p.reference, row_number() OVER (PARTITION BY {keys} ORDER BY CASE WHEN amount <= reference THEN 0 ELSE 1 END, CASE WHEN amount <= reference THEN -amount ELSE amount END, seq) AS rank
 FROM {source} b JOIN prices p ON {on} WHERE p.reference IS NOT NULL)"""


FULL_SQL = f"WITH {BIDS_SQL}, {TENDERS_SQL}, {CANDIDATES_SQL}, {prices_sql('unit')}, {ranked_sql('unit')}"
