"""What a tender requires against what we hold, with partners' cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from adjudica.functions.text import class_rank, requirement_codes


def requirements(labels: DataFrame) -> DataFrame:
    """(tender, label, code, rank, alternative) of (tender, label, class): one row for each code of a label, one of null code where it has none."""
    rows = labels.withColumn("_codes", requirement_codes(F.coalesce("label", F.lit(""))))
    choice = (F.size("_codes") > 1) & F.lower(F.coalesce("label", F.lit(""))).rlike(r"(?<![a-zà-ÿ])ou(?![a-zà-ÿ])")
    return rows.select("tender", "label", choice.alias("alternative"), class_rank(F.col("class")).alias("rank"), F.explode_outer("_codes").alias("code"))


def check(required: DataFrame, ours: DataFrame, partners: DataFrame | None = None) -> DataFrame:
    """``required`` with held (our rank), covered_by and state: ok, classe (ours is too low), absent, inconnu, alternative. ``ours``: code, class; ``partners``:
    name, code, class of those in a joint bid. Both are told to all tasks, a row a code; requirements are not shuffled for them."""
    own = ours.groupBy("code").agg(F.min(class_rank(F.col("class"))).alias("held"), F.lit(True).alias("_have"))  # of two classes, the strongest
    rows = required.join(F.broadcast(own), "code", "left")
    state = F.when(F.col("code").isNull() | F.col("rank").isNull(), "inconnu").when(F.col("_have").isNull(), "absent").when(F.col("held") <= F.col("rank"), "ok").otherwise("classe")
    rows = rows.withColumn("state", state).drop("_have")
    if partners is None:
        rows = rows.withColumn("covered_by", F.lit(None).cast("string"))
    else:
        each = partners.select("code", "name", class_rank(F.col("class")).alias("rank")).groupBy("code", "rank").agg(F.min("name").alias("name"))
        cover = each.groupBy("code").agg(F.collect_list(F.struct("rank", "name")).alias("_theirs"))  # one entry a class
        found = F.array_min(F.transform(F.filter("_theirs", lambda t: t["rank"] <= F.col("rank")), lambda t: t["name"]))
        rows = rows.join(F.broadcast(cover), "code", "left").withColumn("covered_by", F.when(F.col("state").isin("absent", "classe"), found)).drop("_theirs")
    open_ = F.col("state").isin("absent", "classe") & F.col("covered_by").isNull()
    return rows.withColumn("state", F.when(F.col("alternative") & open_, "alternative").otherwise(F.col("state")))


def verdict(checked: DataFrame) -> DataFrame:
    """(tender, missing, eligibility)."""
    missing = F.count_if(F.col("state").isin("absent", "classe") & F.col("covered_by").isNull())
    unsure = F.bool_or(F.col("alternative") | (F.col("state") == "inconnu"))
    return checked.groupBy("tender").agg(missing.alias("missing"), unsure.alias("_u")).withColumn("eligibility", F.when(F.col("missing") > 0, "non_eligible").when(F.col("_u"), "a_etudier").otherwise("eligible")).drop("_u")
