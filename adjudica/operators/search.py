"""Filters, facets, paging and text search over the published tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from adjudica.functions.text import flat, fold_accents


def where_all(df: DataFrame, conditions: list[Column]) -> DataFrame:
    return reduce(DataFrame.where, conditions, df)


def year_filter(df: DataFrame, year: str | None, kept_years: list[str], sort_date: str = "sort_date", doubtful: str = "doubtful") -> DataFrame:
    """A closed range of the sort date, which file statistics prune; 'incertaine' is the complement of the kept years."""
    sure = ~F.coalesce(F.col(doubtful), F.lit(False))
    within = lambda y: F.coalesce(F.col(sort_date).between(f"{y}0101", f"{y}1231"), F.lit(False)) & sure
    if year is None:
        return df
    if year == "incertaine":
        return df.where(~reduce(Column.__or__, [within(y) for y in kept_years], F.lit(False)))
    return df.where(within(year))


def having_qualification(df: DataFrame, qualifications: DataFrame, **wanted: str) -> DataFrame:
    """Tenders with a qualification for each wanted value, by semi join."""
    for name, value in wanted.items():
        df = df.join(qualifications.where(F.col(name) == value).select("ref"), "ref", "left_semi")
    return df


def all_words(text: Column, query: str) -> Column:
    """Every word of the query is somewhere in the text, in any order, without regard to marks and case."""
    folded = fold_accents(text)
    return reduce(Column.__and__, [folded.contains(fold_accents(F.lit(w))) for w in query.split()], F.lit(True))


def prefix_tokens(tokens: Column, query: str, limit: int = 6) -> Column:
    """Every word of two letters or more (of the first ``limit``) begins a token."""
    words = [w for w in query.lower().split() if len(w) >= 2][:limit]
    begins = lambda w: F.exists(tokens, lambda t: F.startswith(t, fold_accents(F.lit(w))))
    return reduce(Column.__and__, [begins(w) for w in words], F.lit(True))


def search_with_fallback(df: DataFrame, text: str, query: str) -> DataFrame:
    """Token prefixes; where no row has them all, substrings. Both are counted in the one plan."""
    tokens = F.split(flat(F.col(text)), " ")
    marked = df.withColumn("_exact", prefix_tokens(tokens, query)).withColumn("_loose", all_words(F.col(text), query))
    some = marked.agg(F.coalesce(F.bool_or("_exact"), F.lit(False)).alias("_some"))
    return marked.join(F.broadcast(some)).where(F.when(F.col("_some"), F.col("_exact")).otherwise(F.col("_loose"))).drop("_exact", "_loose", "_some")  # one row


def page(df: DataFrame, sort: list[Column], number: int = 1, size: int = 25) -> DataFrame:
    size, number = min(max(size, 10), 100), max(number, 1)
    return df.orderBy(*sort).offset((number - 1) * size).limit(size)


def nulls_last(column: str, descending: bool, allowed: tuple[str, ...]) -> Column:
    if column not in allowed:
        raise ValueError(f"cannot sort by {column}")
    return F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()


def lot_number(column: str) -> Column:
    """A lot's number for sorting; a text counts 0."""
    return F.coalesce(F.col(column).try_cast("int"), F.lit(0))


def lookup_with_fallback(rows: DataFrame, facts: DataFrame, key: list[str], other: list[str], value: str, order: str) -> DataFrame:
    """``rows`` with ``value`` of the fact of the same key, or else of the first fact (by ``order``) of the same ``other`` columns."""
    first = facts.groupBy(*other).agg(F.min_by(value, order).alias("_other"))
    own = facts.select(*key, F.col(value).alias("_own")).dropDuplicates(key)
    return rows.join(own, key, "left").join(first, other, "left").withColumn(value, F.coalesce("_own", "_other")).drop("_own", "_other")


def reference_contains(reference: Column, query: str) -> Column:
    """Whether a reference contains what is asked, without regard to spaces and case."""
    return F.replace(F.upper(reference), F.lit(" "), F.lit("")).contains(query.upper().replace(" ", ""))


def facet(df: DataFrame, column: str, distinct: str) -> DataFrame:
    return df.groupBy(column).agg(F.count_distinct(distinct).alias("n"))


def match_rank(name: Column, query: str) -> Column:
    """0 exact, 1 prefix, 2 contains, null otherwise."""
    text, q = flat(name), flat(F.lit(query))
    return F.when(text == q, 0).when(F.startswith(text, q), 1).when(text.contains(q), 2)


def with_children(parents: DataFrame, children: DataFrame, key: str, into: str) -> DataFrame:
    """Children of each parent as an array of structs in order; a parent's children are few."""
    fields = [c for c in children.columns if c != key]
    nested = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(into))
    return parents.join(nested, key, "left")


#: The orders of a list of families.
FAMILY_SORTS = {"score": ["-score", "-units", "number"], "taille": ["-size", "-score", "number"], "marches": ["-units", "-score", "number"], "recent": ["-latest", "-score", "number"]}


def found_families(families: DataFrame, query: str = "") -> DataFrame:
    """``families`` (number, score, size, units, latest, levels, names) of which a member's name has all words of the query."""
    return families.where(F.exists("names", lambda n: all_words(n, query))) if query.strip() else families


def family_facets(families: DataFrame, query: str = "") -> DataFrame:
    """(level, n): how many of the found families have each level, whichever levels the list shows."""
    return found_families(families, query).select("number", F.explode(F.array_distinct("levels")).alias("level")).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def family_page(families: DataFrame, levels: list[str], sort: str = "score", query: str = "", number: int = 1, size: int = 25) -> DataFrame:
    """One page of the found families that have one of the levels, in one of four orders; an unknown order is that by score."""
    shown = found_families(families, query).where(F.arrays_overlap("levels", F.array(*[F.lit(x) for x in levels])))
    order = [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c) for c in FAMILY_SORTS.get(sort, FAMILY_SORTS["score"])]
    return page(shown, order, number, size)
