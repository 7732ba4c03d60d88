"""Writers: rebuild, upsert, replace children, snapshots, guarded publication. Tables are Parquet; a change is a new version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from adjudica.functions.text import buyer_key, parse_amount, parse_closing


def last_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of each primary key the last row by order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def fold_batch(batch: DataFrame, key: str, seq: str, keep: list[str], always: list[str]) -> DataFrame:
    """One row a key: the last value that is not null of the ``keep`` columns, the last value of the ``always`` columns."""
    last = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c)
    return batch.groupBy(key).agg(*[last(c) for c in keep], *[F.max_by(c, seq).alias(c) for c in always])


def upsert(old: DataFrame, new: DataFrame, key: str, keep: list[str], always: list[str]) -> DataFrame:
    """Old and new rows by key: ``keep`` columns take the new value where there is one, ``always`` columns take it wherever the key is
    in the batch. Applying a batch twice changes nothing."""
    o, n = old.alias("o"), new.withColumn("_in", F.lit(True)).alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    value = [F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in keep]
    value += [F.when(F.col("n._in"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in always]
    return both.select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), *value)


def merge_set(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the rows whose keys are not there yet."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def replace_children(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Children of the keys in the batch are the batch's; the others stay."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def judged(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason) of pushed notices: both a reference and a closing day are needed."""
    reason = F.when(F.trim(F.coalesce("notice_ref", F.lit(""))) == "", "ref_annonce manquante").when(parse_closing(F.col("closing")).isNull(), "date_limite manquante ou illisible")
    marked = batch.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


#: Known fields of a pushed notice; whatever else it has stays in ``raw``.
NOTICE = "ref_annonce string, org_acronyme string, reference string, objet string, acheteur string, publie_le string, date_limite string, estimation string, caution_provisoire string, lieu string, url string, source string, clients array<string>, lots array<struct<lot:string,intitule:string,estimation:string,caution_provisoire:string>>, qualifications array<struct<libelle:string,classe:string>>"


def parse_push(bodies: DataFrame, body: str = "body") -> dict[str, DataFrame]:
    """Tables of pushed batches (JSON text with clients and appels_ouverts): notices, clients, lots, qualifications; rows keep their place (seq)."""
    each = bodies.select(F.from_json(body, "clients array<string>, appels_ouverts array<string>").alias("b")).select(F.col("b.clients").alias("batch_clients"), F.posexplode("b.appels_ouverts").alias("seq", "raw"))
    rows = each.select("seq", "raw", "batch_clients", F.from_json("raw", NOTICE).alias("x")).select("seq", "raw", "batch_clients", "x.*").withColumnRenamed("ref_annonce", "notice_ref")
    notices = rows.select(
        "seq", "notice_ref", F.col("org_acronyme").alias("org"), "reference", F.col("objet").alias("title"), F.col("acheteur").alias("buyer"), buyer_key(F.col("acheteur")).alias("buyer_key"), F.col("publie_le").alias("published"),
        F.col("date_limite").alias("closing"), parse_amount(F.col("estimation")).alias("estimation"), parse_amount(F.col("caution_provisoire")).alias("deposit"), F.col("lieu").alias("place"), "url", "source", "raw",
    )
    clients = rows.select("notice_ref", F.explode(F.array_union(F.coalesce("clients", F.array().cast("array<string>")), F.coalesce("batch_clients", F.array().cast("array<string>")))).alias("client"))
    lots = rows.select("notice_ref", F.explode("lots").alias("x")).select("notice_ref", "x.lot", F.col("x.intitule").alias("title"), parse_amount(F.col("x.estimation")).alias("estimation"), parse_amount(F.col("x.caution_provisoire")).alias("deposit"))
    quals = rows.select("notice_ref", F.explode("qualifications").alias("x")).select("notice_ref", F.col("x.libelle").alias("label"), F.col("x.classe").alias("class"))
    return {"notices": notices, "clients": clients, "lots": lots, "qualifications": quals}


def changes(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """What a replacement would change: ajout, changement or retrait of each key that differs, with both values as structs."""
    o, n = old.select(*keys, F.struct(*values).alias("before")), new.select(*keys, F.struct(*values).alias("after"))
    both = o.join(n, keys, "full")
    kind = F.when(F.col("before").isNull(), "ajout").when(F.col("after").isNull(), "retrait").when(~F.col("before").eqNullSafe(F.col("after")), "changement")
    return both.withColumn("kind", kind).where("kind IS NOT NULL")


def apply_changes(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> tuple[DataFrame, DataFrame]:
    """(table, audit): the table after a replacement, each row with ``changed`` (whether it had to be written), and one row of the audit for each
    kind of change with its count. Keys that are gone are in the audit only."""
    told = changes(old, new, keys, values)
    kept = new.select(*keys, *values).join(told.where("kind <> 'retrait'").select(*keys, F.lit(True).alias("changed")), keys, "left")
    return kept.withColumn("changed", F.coalesce("changed", F.lit(False))), told.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def write_snapshot(rows: DataFrame, path: str, calculation: str) -> None:
    """Replaces the partition of one calculation and leaves the others."""
    rows.withColumn("calculation", F.lit(calculation)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("calculation").parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Semicolon files with a byte order mark before the header; cells that a spreadsheet would run are quoted by an apostrophe."""
    text = lambda c: F.col(c).cast("string")
    safe = [F.when(text(c).rlike(r"^[=+@\-]"), F.concat(F.lit("'"), text(c))).otherwise(text(c)).alias(("\ufeff" if not k else "") + c) for k, c in enumerate(rows.columns)]
    rows.select(*safe).write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def publish(spark: SparkSession, rows: DataFrame, path: str, version: str, shrink: float = 0.02) -> str:
    """Writes a version beside the others, and refuses one that lost over ``shrink`` of the rows of the last. Readers take the version they are told,
    so that a failed build leaves the old one in place."""
    target = f"{path}/version={version}"
    rows.write.mode("errorifexists").parquet(target)
    written = spark.read.parquet(target).count()
    versions = spark.read.parquet(path).where(F.col("version").cast("string") != version).groupBy("version").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("version").desc()).limit(1).collect()
    if versions and written < versions[0].n * (1 - shrink):
        raise ValueError(f"version {version} has {written} rows, the one before {versions[0].n}")
    return target


def write_bucketed(rows: DataFrame, table: str, key: str, buckets: int) -> None:
    """Bids and tenders bucketed alike on ref join without a shuffle."""
    rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)
