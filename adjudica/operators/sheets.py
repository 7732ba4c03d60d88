"""Sheets of companies, groups and submissions: what a reader asks about one of them, computed for all at once.

``offers``: unit, company, amount (one row a company and unit); ``winners``: unit, company (one row a unit).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from adjudica.operators.components import stored
from adjudica.operators.copresence import _later, _size, _tasks

# Victories from which a profile is told.
LEAST_WINS = 3


def profile(x_wins: Column, y_wins: Column) -> Column:
    """accompagne where y is there when x wins and hardly wins itself, concurrent the other way round, else mixte."""
    return F.when((x_wins >= LEAST_WINS) & (2 * y_wins <= x_wins), "accompagne").when((y_wins >= LEAST_WINS) & (2 * x_wins <= y_wins), "concurrent").otherwise("mixte")


def company_sheet(offers: DataFrame, winners: DataFrame, pairs: DataFrame) -> DataFrame:
    """(x, y, ...): for each company x and each other y that it met: together, x_wins, y_wins, where the one's offer lies of the other's when
    that wins (medians, null where none won), the shares of their units, the pair's level, the profile. ``pairs``: a, b, level.

    A pair is made once, behind the shuffle of its first company with the offers behind it in a unit's list, and then told to both sides."""
    own = offers.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("company", "amount"))).alias("_o"))
    told = own.join(winners.select("unit", F.col("company").alias("_w")), "unit", "left")
    every = stored(told.select("unit", F.col("_o.company").alias("members"), F.col("_o.amount").alias("_amounts"), "_w"), "unit-offers")
    lists = every.where("unit IS NOT NULL AND size(members) > 1")
    each = _later(lists, "_amounts", "_w").select("a", "bs", F.get("_amounts", F.col("_at")).alias("_p"), F.expr("slice(_amounts, _at + 2, size(_amounts))").alias("_qs"), "_w")
    each = each.repartition(_tasks(lists, _size(F.col("members")) * (_size(F.col("members")) - 1) / 2), "a")
    met = each.select("a", "_p", "_qs", "_w", F.posexplode("bs").alias("_i", "b")).where("a < b").select("a", "b", "_p", F.get("_qs", F.col("_i")).alias("_q"), "_w")
    a_won, b_won = F.col("_w") == F.col("a"), F.col("_w") == F.col("b")
    rows = met.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("together"), F.count_if(a_won).alias("_wa"), F.count_if(b_won).alias("_wb"),
        F.median(F.when(a_won, F.col("_q") / F.col("_p") - 1)).alias("_ma"), F.median(F.when(b_won, F.col("_p") / F.col("_q") - 1)).alias("_mb"),
    )
    n = every.select(F.explode("members").alias("company")).groupBy("company").agg(F.count(F.lit(1)).alias("n"))
    for side in ("a", "b"):
        rows = rows.join(n.select(F.col("company").alias(side), F.col("n").alias(f"_n{side}")), side)
    rows = rows.join(pairs.where("level IS NOT NULL").select("a", "b", "level"), ["a", "b"], "left")
    told_to = lambda x, y: F.struct(
        F.col(x).alias("x"), F.col(y).alias("y"), "together", F.col(f"_w{x}").alias("x_wins"), F.col(f"_w{y}").alias("y_wins"), F.col(f"_m{x}").alias("when_x_wins"), F.col(f"_m{y}").alias("when_y_wins"),
        (F.col("together") / F.col(f"_n{x}")).alias("share_x"), (F.col("together") / F.col(f"_n{y}")).alias("share_y"), "level",
    )
    return rows.select(F.inline(F.array(told_to("a", "b"), told_to("b", "a")))).withColumn("profile", profile(F.col("x_wins"), F.col("y_wins")))


def sections(sheet: DataFrame) -> DataFrame:
    """The four sections of a sheet, a row of a section and a company: partenaires (a level), meneurs (won by y with x there), suivis (won by x),
    concurrents. A company may be in several."""
    parts = {"partenaires": F.col("level").isNotNull(), "suivis": F.col("x_wins") >= LEAST_WINS, "meneurs": F.col("y_wins") >= LEAST_WINS, "concurrents": F.col("profile") == "concurrent"}
    named = F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in parts.items()]))
    return sheet.select("x", F.explode(named).alias("section"), "y", "together")


def group_outcomes(offers: DataFrame, winners: DataFrame, members: DataFrame, references: DataFrame) -> DataFrame:
    """(group, unit, won, winner, best_member, gap_best, gap_reference): each unit with a winner in which a member made an offer. A lost unit
    tells how the winner's amount lies to the best admitted member's and to the reference. ``offers`` have rank too (null: not admitted)
    and ``members``: group, company; ``references``: unit, reference."""
    own = offers.join(members, "company").groupBy("group", "unit").agg(F.min_by(F.struct("company", "amount"), F.struct("rank", "company")).alias("_any"), F.min_by(F.when(F.col("rank").isNotNull(), F.struct("company", "amount")), F.when(F.col("rank").isNotNull(), F.struct("rank", "company"))).alias("_best"))
    won = winners.join(offers.select("unit", "company", "amount"), ["unit", "company"]).select("unit", F.col("company").alias("winner"), F.col("amount").alias("_amount"))
    rows = own.join(won, "unit").join(members.select("group", F.col("company").alias("winner"), F.lit(True).alias("_in")), ["group", "winner"], "left").join(references, "unit", "left")
    lost = F.col("_in").isNull()
    return rows.select(
        "group", "unit", (~lost).alias("won"), "winner", F.when(lost, F.col("_best.company")).alias("best_member"),
        F.when(lost, F.col("_amount") - F.col("_best.amount")).alias("gap_best"), F.when(lost, F.col("_amount") - F.col("reference")).alias("gap_reference"),
    )


def group_summary(outcomes: DataFrame) -> DataFrame:
    """(group, units, won, lost, lost_excluded, gap_best, gap_reference): counts, and medians of the lost units' gaps."""
    lost = ~F.col("won")
    return outcomes.groupBy("group").agg(
        F.count(F.lit(1)).alias("units"), F.count_if("won").alias("won"), F.count_if(lost).alias("lost"), F.count_if(lost & F.col("best_member").isNull()).alias("lost_excluded"),
        F.median("gap_best").alias("gap_best"), F.median("gap_reference").alias("gap_reference"),
    )


def member_roles(offers: DataFrame, outcomes: DataFrame, members: DataFrame) -> DataFrame:
    """(group, company, units, wins, role): chef is the member of most wins (ties: the smallest), gagnant another that won, or else accompagnant."""
    n = offers.join(members, "company").groupBy("group", "company").agg(F.count(F.lit(1)).alias("units"))
    wins = outcomes.where("won").groupBy("group", F.col("winner").alias("company")).agg(F.count(F.lit(1)).alias("wins"))
    chief = wins.groupBy("group").agg(F.min(F.struct(-F.col("wins"), F.col("company").alias("c")))["c"].alias("_chief"))
    rows = n.join(wins, ["group", "company"], "left").join(chief, "group", "left").withColumn("wins", F.coalesce("wins", F.lit(0)))
    return rows.select("group", "company", "units", "wins", F.when(F.col("company") == F.col("_chief"), "chef").when(F.col("wins") > 0, "gagnant").otherwise("accompagnant").alias("role"))


def header(companies: DataFrame, pairs: DataFrame, active: int = 5) -> DataFrame:
    """One row: companies, those of ``active`` units or more, and of these those with a partner of a level, of a middle or strong one, of a strong one.
    ``companies``: company, units; ``pairs``: a, b, level."""
    best = pairs.where("level IS NOT NULL").select(F.explode(F.array("a", "b")).alias("company"), F.when(F.col("level") == "fort", 3).when(F.col("level") == "moyen", 2).otherwise(1).alias("l")).groupBy("company").agg(F.max("l").alias("l"))
    on, l = F.col("units") >= active, F.coalesce("l", F.lit(0))
    count = lambda k: F.count_if(on & (l >= k))
    return companies.join(best, "company", "left").agg(F.count(F.lit(1)).alias("companies"), F.count_if(on).alias("active"), count(1).alias("with_partner"), count(2).alias("with_middle"), count(3).alias("with_strong"))


def common_units(offers: DataFrame, a: int | str, b: int | str) -> DataFrame:
    """Units in which both companies made an offer."""
    return offers.where(F.col("company") == a).select("unit").intersect(offers.where(F.col("company") == b).select("unit"))


def groups_of_both(members: DataFrame, a: int | str, b: int | str) -> DataFrame:
    """Groups that hold both companies."""
    return members.groupBy("group").agg(F.bool_or(F.col("company") == a).alias("_a"), F.bool_or(F.col("company") == b).alias("_b")).where("_a AND _b").select("group")


def regroup(labels: DataFrame) -> DataFrame:
    """Answers that were given for a whole group are written once a pair; they are one answer where they cover all its pairs: (author, created,
    answer, group, pairs, whole). ``labels``: author, created, answer, group (members joined by |, or null), a, b."""
    rows = labels.groupBy("author", "created", "answer", "group").agg(F.count_distinct("a", "b").alias("pairs"))
    k = F.size(F.array_distinct(F.split(F.coalesce("group", F.lit("")), r"\|")))
    return rows.withColumn("whole", (k >= 3) & (F.col("pairs") == k * (k - 1) / 2))


def balance(submissions: DataFrame) -> DataFrame:
    """One row: submissions, waiting, judged, won, win_rate, margin (mean share over the cost of those won), gain. ``submissions``: price, cost, won (null:
    not judged yet)."""
    won = F.coalesce("won", F.lit(False))
    over = F.col("price") - F.col("cost")
    return submissions.agg(
        F.count(F.lit(1)).alias("submissions"), F.count_if(F.col("won").isNull()).alias("waiting"), F.count("won").alias("judged"), F.count_if(won).alias("won"),
        F.avg(F.when(F.col("won").isNotNull(), won.cast("int"))).alias("win_rate"), F.avg(F.when(won, over / F.col("cost"))).alias("margin"), F.sum(F.when(won, over)).alias("gain"),
    )


def in_progress(submissions: DataFrame, today: str) -> DataFrame:
    """One row: how many submissions close today or later. ``submissions``: closing."""
    return submissions.agg(F.count_if(F.to_date("closing") >= F.lit(today).cast("date")).alias("in_progress"))


def presence_by_status(bids: DataFrame, admitted: tuple[str, ...], chosen: str) -> DataFrame:
    """(unit, company, best): attributaire, admis or ecarte, the best of a company's statuses in a unit."""
    best = F.when(F.bool_or(F.col("status") == chosen), "attributaire").when(F.bool_or(F.col("status").isin(*admitted)), "admis").otherwise("ecarte")
    return bids.groupBy("unit", "company").agg(best.alias("best"))


def score_points(scored: DataFrame, parts: dict[str, tuple[float, Column]]) -> DataFrame:
    """``scored`` with ``points``: an array of (criterion, value, points), of parts of weight and value 0 to 1; points add up to 100 at most."""
    total = sum(w for w, _ in parts.values())
    each = [F.struct(F.lit(name).alias("criterion"), v.alias("value"), (v * (100.0 * w / total)).alias("points")) for name, (w, v) in parts.items()]
    return scored.withColumn("points", F.array(*each))


def proofs(offers: DataFrame, days: DataFrame, most: int = 8) -> DataFrame:
    """(x, y, place, unit, day): for each company and each other that it met, the latest units where both made an offer. ``days``: unit, day."""
    p = offers.select("unit", F.col("company").alias("x")).join(days.select("unit", "day"), "unit")
    met = p.join(offers.select("unit", F.col("company").alias("y")), "unit").where("x <> y")
    ranked = met.withColumn("place", F.row_number().over(W.partitionBy("x", "y").orderBy(F.col("day").desc(), F.col("unit").desc())))
    return ranked.where(F.col("place") <= most).select("x", "y", "place", "unit", "day")


def group_sheets(members: DataFrame, offers: DataFrame, outcomes: DataFrame, pairs: DataFrame, days: DataFrame, most: int = 10) -> DataFrame:
    """One nested row a group: members with their roles, its pairs with what they share, how many units two members or more were at and the latest of these,
    wins and losses, and the latest losses with their gaps. ``outcomes``: of ``group_outcomes``; ``pairs``: a, b, together, level; ``days``: unit, day.
    Lists are of a group's members and pairs, or of ``most`` units."""
    roles = member_roles(offers, outcomes, members).groupBy("group").agg(F.sort_array(F.collect_list(F.struct("company", "units", "wins", "role"))).alias("members"))
    inside = members.select("group", F.col("company").alias("a")).join(pairs.select("a", "b", "together", "level"), "a").join(members.select("group", F.col("company").alias("b")), ["group", "b"])
    links = inside.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("a", "b", "together", "level"))).alias("pairs"))
    present = offers.join(members, "company").groupBy("group", "unit").agg(F.count(F.lit(1)).alias("present"))
    told = present.join(days.select("unit", "day"), "unit").join(outcomes.select("group", "unit", "won", "winner", "best_member", "gap_best"), ["group", "unit"], "left")
    told = stored(told, "group-units")  # read for the counts and for both lists
    counts = told.groupBy("group").agg(F.count_if(F.col("present") >= 2).alias("common"), F.count_if(~F.col("won")).alias("lost"), F.count_if("won").alias("won"))
    recent = W.partitionBy("group").orderBy(F.col("day").desc(), F.col("unit").desc())

    def latest(rows: DataFrame, name: str, *columns: str) -> DataFrame:
        first = rows.withColumn("place", F.row_number().over(recent)).where(F.col("place") <= most)  # cut in each task before a group meets
        return first.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("place", *columns))).alias(name))

    shared = latest(told.where("present >= 2"), "latest", "unit", "day", "present", "won")
    lost = latest(told.where("NOT won"), "losses", "unit", "winner", "best_member", "gap_best")
    rows = roles
    for part in (links, counts, shared, lost):
        rows = rows.join(part, "group", "left")
    empty = {"pairs": links, "latest": shared, "losses": lost}
    return rows.select("group", "members", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("common", "won", "lost")], *[F.coalesce(c, F.array().cast(of.schema[c].dataType)).alias(c) for c, of in empty.items()])
