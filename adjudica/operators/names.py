"""Names that are alike: near-duplicate companies that never meet, and buyers of notices found again in the history.

Two texts are compared by the share of their letters that a common subsequence keeps (``indel_ratio``, 0 to 100). Pairs
are found by an exact prefix filter: texts of a ratio of r or more share a known number of letters, so that if each puts
its rarest letters first, they share one among the first few. Nothing that reaches the ratio is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from adjudica.functions.text import buyer_core, buyer_key, buyer_type, buyer_variant, flat, indel_ratio
from adjudica.operators.components import stored

# Least ratio of a proposal, of words that are each other's, the ceiling of one with a word that has none, of one that is sure, and
# how far the next one must be.
PROPOSED, SAME_WORD, CEILING, SURE, APART = 80.0, 80.0, 85.0, 95.0, 3.0


def _letters(rows: DataFrame, text: str) -> DataFrame:
    """(id, text, at, token): each letter of a text with its number among the same letters of the text, numbered by rarity."""
    each = rows.select("id", text, F.posexplode(F.split(text, "")).alias("k", "c")).where("c <> ''")
    told = each.withColumn("token", F.concat("c", F.row_number().over(W.partitionBy("id", "c").orderBy("k")).cast("string"))).select("id", text, "token")
    df = told.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return told.join(df, "token").withColumn("at", F.row_number().over(W.partitionBy("id").orderBy("df", "token")))


def alike_pairs(left: DataFrame, right: DataFrame, text: str, least: float) -> DataFrame:
    """(id, id2, ratio) of the rows of both sides (id, text) whose texts have a ratio of ``least`` or more. Empty texts are like nothing."""
    both = _letters(left.select("id", text).withColumn("_s", F.lit(0)).unionByName(right.select("id", text).withColumn("_s", F.lit(1))).select(F.struct("_s", "id").alias("id"), text), text)
    n, r = F.length(text), least / 100.0
    # a partner has between n r / (2 - r) and n (2 - r) / r letters; it shares r / 2 of both's letters at least
    need = F.ceil(F.lit(r / 2) * (n + F.ceil(n * F.lit(r / (2 - r)) - 1e-9)) - 1e-9)
    first = both.where(F.col("at") <= n - need + 1).select("id", text, "token")
    a = first.where("id._s = 0").select(F.col("id.id").alias("id"), F.col(text).alias("_a"), "token")
    b = first.where("id._s = 1").select(F.col("id.id").alias("id2"), F.col(text).alias("_b"), "token")
    x, y = F.length("_a"), F.length("_b")
    met = a.join(b, "token").where((F.least(x, y) * 2.0 / (x + y) >= r - 1e-9)).select("id", "id2", "_a", "_b").distinct()
    return met.withColumn("ratio", indel_ratio(F.col("_a"), F.col("_b"))).where(F.col("ratio") >= least).select("id", "id2", "ratio")


def near_duplicates(names: DataFrame, least: float, met: DataFrame | None = None) -> DataFrame:
    """(id, id2, ratio), each pair once, of ``names`` (id, name) that are alike and never met (``met``: a, b): two spellings of one company do not
    bid against each other."""
    found = alike_pairs(names, names, "name", least).where("id < id2")
    if met is None:
        return found
    seen = met.select(F.least("a", "b").alias("id"), F.greatest("a", "b").alias("id2"))
    return found.join(seen, ["id", "id2"], "left_anti")


def _unmatched(a: Column, b: Column) -> Column:
    """Words of ``a`` that are not in ``b`` as they are."""
    return F.array_except(F.split(a, " "), F.split(b, " "))


def proposals(asked: DataFrame, known: DataFrame, n: int = 5) -> DataFrame:
    """(id, key, name, score, rank): the known buyers (key, name) nearest to each asked one (id, name), by what is left of their names. Types and
    variants that contradict each other never meet; a word without a like one on the other side keeps the score at the ceiling."""
    told = lambda rows: rows.select("*", buyer_core(F.col("name")).alias("core"), buyer_type(F.col("name")).alias("type"), buyer_variant(F.col("name")).alias("variant"))
    q, k = told(asked), told(known)
    cores = lambda rows: rows.select(F.col("core").alias("id"), F.col("core").alias("text")).distinct()
    near = alike_pairs(cores(q), cores(k), "text", PROPOSED).select(F.col("id").alias("core"), F.col("id2").alias("core2"), F.col("ratio").alias("score"))
    # words of the one without a like word on the other side
    sides = near.select("core", "core2", F.explode(F.array(F.struct(_unmatched(F.col("core"), F.col("core2")).alias("ws"), F.split("core2", " ").alias("vs"), F.lit(0).alias("side")), F.struct(_unmatched(F.col("core2"), F.col("core")).alias("ws"), F.split("core", " ").alias("vs"), F.lit(1).alias("side")))).alias("x"))
    words = sides.select("core", "core2", "x.side", F.explode("x.ws").alias("w"), F.col("x.vs").alias("vs")).select("core", "core2", "side", "w", F.explode("vs").alias("v"))
    alone = words.groupBy("core", "core2", "side", "w").agg(F.max(indel_ratio(F.col("w"), F.col("v"))).alias("r")).where(F.col("r") < SAME_WORD).select("core", "core2").distinct().withColumn("alone", F.lit(True))
    near = near.join(alone, ["core", "core2"], "left").withColumn("score", F.when(F.col("alone"), F.least("score", F.lit(CEILING))).otherwise(F.col("score"))).drop("alone")
    other = k.select("key", F.col("name").alias("known"), F.col("core").alias("core2"), F.col("type").alias("type2"), F.col("variant").alias("variant2"))
    met = q.join(near, "core").join(other, "core2").where((F.col("type") == "autre") | (F.col("type2") == "autre") | (F.col("type") == F.col("type2")))
    met = met.where(F.col("variant").isNull() | F.col("variant2").isNull() | (F.col("variant") == F.col("variant2"))).where(buyer_key(F.col("name")) != F.col("key"))
    ranked = met.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.col("score").desc(), "key")))
    return ranked.where(F.col("rank") <= n).select("id", "key", F.col("known").alias("name"), F.round("score", 1).alias("score"), "rank")


def resolve(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(id, status, key): direct where the history has the key itself, correspondance where the best proposal is sure and alone at its level, or
    aucun."""
    keyed = asked.select("id", buyer_key(F.col("name")).alias("own"))
    direct = keyed.join(known.select(F.col("key").alias("own")).distinct(), "own", "left_semi").select("id", F.col("own").alias("_direct"))
    found = proposals(asked, known, 2)
    best = found.groupBy("id").agg(F.max(F.when(F.col("rank") == 1, F.struct("score", "key"))).alias("b"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s"))
    sure = best.where((F.col("b.score") >= SURE) & (F.col("s").isNull() | (F.col("b.score") - F.col("s") >= APART))).select("id", F.col("b.key").alias("_found"))
    rows = asked.select("id").join(direct, "id", "left").join(sure, "id", "left")
    return rows.select("id", F.when(F.col("_direct").isNotNull(), "direct").when(F.col("_found").isNotNull(), "correspondance").otherwise("aucun").alias("status"), F.coalesce("_direct", "_found").alias("key"))


# Words that say nothing, titles that stand for each other, and letters of faults.
TOOL_WORDS = ("de", "du", "des", "la", "le", "l", "d")
TITLES = (("directeur provincial", "direction provinciale"), ("directeur regional", "direction regionale"))
FAULTS = "abcdefghilmnorstu"


def perturbed(known: DataFrame, seed: int = 5) -> DataFrame:
    """(kind, key, name) of the known buyers (key, name) written otherwise: titles exchanged, without small words, with two letters replaced (which and by
    what is drawn by hash, so that it is the same wherever it is computed). Names that a kind doesn't change, or whose key stays, are left out."""
    plain = flat(F.col("name"))
    exchanged = plain
    for a, b in TITLES:
        exchanged = F.replace(exchanged, F.lit(a), F.lit(b))
    words = F.filter(F.split(plain, " "), lambda w: ~w.isin(*TOOL_WORDS))
    faulty = plain
    for k in (0, 1):
        place = F.pmod(F.xxhash64("key", F.lit(seed), F.lit(2 * k)), F.length(plain)).cast("int") + 1
        letter = F.substr(F.lit(FAULTS), F.pmod(F.xxhash64("key", F.lit(seed), F.lit(2 * k + 1)), F.lit(len(FAULTS))).cast("int") + 1, F.lit(1))
        faulty = F.overlay(faulty, letter, place, 1)
    kinds = [("echange", exchanged), ("sans_mots_outils", F.when(F.size(words) > 1, F.array_join(words, " "))), ("deux_fautes", F.when(F.length(plain) >= 8, faulty))]
    each = known.select("key", plain.alias("_plain"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("name")) for k, v in kinds])).alias("x")).select("x.kind", "key", "x.name", "_plain")
    return each.where(F.col("name").isNotNull() & (F.col("name") != F.col("_plain")) & (buyer_key(F.col("name")) != F.col("key"))).drop("_plain")


def perturbation_recall(known: DataFrame, seed: int = 5) -> DataFrame:
    """(kind, n, top1, top5, auto, auto_right): how many of the names that are written otherwise find their buyer first, among five, without a check, and
    rightly so."""
    made = stored(perturbed(known, seed).withColumn("id", F.concat_ws("|", "kind", "key")), "perturbed")
    asked = made.select("id", "name")
    found = proposals(asked, known, 5).select("id", F.col("key").alias("_found"), "rank")
    hits = made.join(found, "id", "left").groupBy("kind", "id").agg(F.max(((F.col("_found") == F.col("key")) & (F.col("rank") == 1)).cast("int")).alias("t1"), F.max((F.col("_found") == F.col("key")).cast("int")).alias("t5"))
    sure = resolve(asked, known).where("status = 'correspondance'").select("id", F.col("key").alias("_sure"))
    rows = hits.join(made.select("id", "key"), "id").join(sure, "id", "left")
    return rows.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("t1", F.lit(0))).alias("top1"), F.sum(F.coalesce("t5", F.lit(0))).alias("top5"), F.count("_sure").alias("auto"), F.count_if(F.col("_sure") == F.col("key")).alias("auto_right")
    )
