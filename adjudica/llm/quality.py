"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule has a predicate (true: reject) on counts of a text. A bounded sample is counted once for each count and timed,
and tells which rules reject which of its rows. The first rule is the one of most rejections per second; each next one
is that of most rejections among the rows that those before it leave, per second of the counts that these have not made
yet. ``CASE WHEN`` leaves a row at the first rule that rejects it. The order decides what is computed, never which rows stay.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from adjudica.llm.common import stored

SPACE = r"[\x20\x09-\x0D]"
_BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 8


def words(text: Column) -> Column:
    """Runs of anything but space and \\x09-\\x0D."""
    bare = F.btrim(text, F.lit(_BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE + "+", -1))


def _pairs(hashes: Column, gap: int, n: Column) -> Column:
    """Hashes of runs twice as long: of the run at each place and the one ``gap`` further."""
    return F.zip_with(hashes, F.slice(hashes, gap + 1, F.greatest(n, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def _twice(at: str) -> Column:
    """Starts of the windows whose hash is a neighbour's in the sorted column ``at`` of (h, i)."""
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    twice = F.filter(at, lambda x, k: same(x, F.get(F.col(at), k - 1)) | same(x, F.get(F.col(at), k + 1)))
    return F.sort_array(F.transform(twice, lambda x: x["i"]))


def _covered(starts: str) -> Column:
    """Words in windows that begin at the sorted ``starts``."""
    steps = F.zip_with(starts, F.slice(starts, 2, F.size(starts)), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda n, s: n + s)


def _add_words(frame: DataFrame, text: Column) -> DataFrame:
    return frame.withColumn("_w", words(text)).withColumn("n_words", F.size("_w").cast("long"))


def _add_repeats(frame: DataFrame, text: Column) -> DataFrame:
    # each step is a column of its own: what a lambda refers to is computed once a row, not once an element
    frame = frame.withColumn("_one", F.when(text.isNotNull(), F.transform("_w", lambda w: F.xxhash64(w))))
    for new, old, gap in (("_two", "_one", 1), ("_four", "_two", 2), ("_eight", "_four", 4)):
        frame = frame.withColumn(new, _pairs(F.col(old), gap, F.size("_w")))
    frame = frame.withColumn("_eight", F.slice("_eight", 1, F.greatest(F.size("_w") - (WINDOW - 1), F.lit(0))))
    at = F.sort_array(F.transform("_eight", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    frame = frame.withColumn("_at", F.when(F.size(F.array_distinct("_eight")) < F.size("_eight"), at))
    frame = frame.withColumn("_starts", F.when(F.col("_at").isNotNull(), _twice("_at")))
    return frame.withColumn("n_repeat_words", F.when(F.col("_starts").isNull(), F.lit(0).cast("long")).otherwise(_covered("_starts")))


def _add_lines(frame: DataFrame, text: Column) -> DataFrame:
    frame = frame.withColumn("_lines", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return frame.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))


def _add(name: str, count: Callable[[Column], Column]) -> Callable[[DataFrame, Column], DataFrame]:
    return lambda frame, text: frame.withColumn(name, count(text).cast("long"))


#: How each count is added to a frame from a text column; a null text gives no count and takes no work.
#: n_repeat_words reads the words that n_words made.
COUNTS: dict[str, Callable[[DataFrame, Column], DataFrame]] = {
    "n_words": _add_words,
    "word_chars": _add("word_chars", lambda t: F.length(t) - F.regexp_count(t, F.lit(SPACE))),
    "n_symbols": _add("n_symbols", lambda t: F.regexp_count(t, F.lit(r"[#*$%&|<>]"))),
    "n_dup_lines": _add_lines,
    "n_repeat_words": _add_repeats,
    "n_upper": _add("n_upper", lambda t: F.regexp_count(t, F.lit(r"[A-Z]"))),
    "n_lower": _add("n_lower", lambda t: F.regexp_count(t, F.lit(r"[a-z]"))),
}
_OWN = ("_t", "_w", "_one", "_two", "_four", "_eight", "_lines", "_at", "_starts", "_v")


def _begin(df: DataFrame, text_col: str) -> tuple[DataFrame, list[str]]:
    kept = [c for c in df.columns if c not in (*_OWN, *COUNTS, "rejected_by")]
    return df.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_t")), kept


def _settled(frame: DataFrame, kept: list[str], made: list[str]) -> DataFrame:
    """The made columns as a generator's output, so that a later filter on them stays above the work: pushed below, it
    would do all of it again inside one expression."""
    return frame.select(*[F.col(f"`{c}`") for c in kept], F.inline(F.array(F.struct(*made))))


def with_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with all counts; null text counts as no words, columns of these names are replaced."""
    frame, kept = _begin(df, text_col)
    for add in COUNTS.values():
        frame = add(frame, F.col("_t"))
    return _settled(frame, kept, list(COUNTS))


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a predicate on ``counts``."""

    name: str
    counts: tuple[str, ...]
    rejects: Callable[[], Column]


BASE = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"

#: Production rules. Thresholds are whole-number comparisons, the same in any engine.
RULES = (
    Rule("few_words", ("n_words",), lambda: F.col("n_words") < 20),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda: 100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    Rule("symbols", ("n_words", "n_symbols"), lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    Rule("word_length", ("n_words", "word_chars"), lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 16 * F.col("n_words"))),
    Rule("repeated_lines", ("n_words", "n_dup_lines"), lambda: 2 * F.col("n_dup_lines") > F.col("n_words")),
    Rule("capitals", ("n_upper", "n_lower"), lambda: F.col("n_upper") > F.col("n_lower")),
)


def count_seconds(sample: DataFrame, runs: int = 2) -> dict[str, float]:
    """Seconds that each count takes over ``sample`` (text), beyond what reading it takes: the least of some runs, after one
    that compiles. What a count needs of another is not counted twice."""

    def seconds(names: tuple[str, ...]) -> float:
        frame, _ = _begin(sample, "text")
        for name in names:
            frame = COUNTS[name](frame, F.col("_t"))
        job, took = frame.agg(F.sum(names[-1] if names else F.length("_t"))), []
        for _ in range(runs + 1):
            began = time.perf_counter()
            job.collect()  # one row
            took.append(time.perf_counter() - began)
        return min(took[1:])

    read, words_ = seconds(()), seconds(("n_words",))
    found = {name: seconds((name,)) - read for name in COUNTS if name not in ("n_words", "n_repeat_words")}
    found |= {"n_words": words_ - read, "n_repeat_words": seconds(("n_words", "n_repeat_words")) - words_}
    return {name: max(t, 1e-4) for name, t in found.items()}


def order_by_gain(rules: tuple[Rule, ...], rejected: dict[tuple[bool, ...], int], seconds: dict[str, float]) -> list[Rule]:
    """``rejected``: how many sampled rows have each pattern of verdicts, one a rule. Ties go to the cheaper rule, then by name."""
    left, made, out, places = dict(rejected), set(), [], set(range(len(rules)))
    while places:
        price = {k: sum(seconds[c] for c in rules[k].counts if c not in made) for k in places}
        gain = {k: sum(n for hit, n in left.items() if hit[k]) / max(price[k], 1e-9) for k in places}
        best = min(places, key=lambda k: (-gain[k], price[k], rules[k].name))
        out.append(rules[best])
        places.remove(best)
        made.update(rules[best].counts)
        left = {hit: n for hit, n in left.items() if not hit[best]}
    return out


def cascade_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, seed: int = 7, text_col: str = "text") -> list[Rule]:
    """The rules in the order of the cascade. At most about ``sample_rows`` rows are looked at, chosen at random of the whole table; the
    numbers of sampled rows by verdicts come to the driver. An empty sample gives the cheapest first."""
    n = docs.count()
    text = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    sample = stored(text.sample(min(1.0, sample_rows / max(n, 1)), seed).repartition(1), "quality-sample")
    verdicts = [r.rejects().alias(f"r{k}") for k, r in enumerate(rules)]
    rows = with_counts(sample).select(*verdicts).groupBy(*[f"r{k}" for k in range(len(rules))]).count().collect()  # a row a pattern
    return order_by_gain(rules, {tuple(r)[:-1]: r["count"] for r in rows}, count_seconds(sample))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, text_col: str = "text", always: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with the counts and ``rejected_by``, the first rule of the cascade that rejects (null: kept).

    A row that a rule rejected goes no further: later rules see a null text for it, and their counts are null.
    Those in ``always`` are computed for every row all the same. Null and empty texts have no words and fail
    few_words; repeated rows are judged alike; an empty table gives no row. Texts of any length are counted whole; of rules that reject a
    row alike the first of the cascade is named; columns of ``docs`` that are named like added ones are replaced.
    """
    frame, kept = _begin(docs, text_col)
    frame, made = frame.withColumn("_v", F.lit(None).cast("string")), []
    for rule in cascade_order(docs, rules, sample_rows, text_col=text_col):
        for name in (c for c in rule.counts if c not in made):
            frame = COUNTS[name](frame, F.col("_t") if name in always else F.when(F.col("_v").isNull(), F.col("_t")))
            made.append(name)
        frame = frame.withColumn("_v", F.coalesce("_v", F.when(rule.rejects(), F.lit(rule.name))))
    return _settled(frame.withColumn("rejected_by", F.col("_v")), kept, [*made, "rejected_by"])


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their columns only."""
    return judge(docs, text_col=text_col).where("rejected_by IS NULL").select(*[F.col(f"`{c}`") for c in docs.columns])


#: Counts that the query gives of every row.
ALWAYS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def contract(docs: DataFrame) -> DataFrame:
    """doc_id, the five counts, base_failed and kept of every row; see ``judge`` for odd rows. What is not asked for of every row
    (capitals) is computed only where no rule before rejected."""
    judged = judge(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), always=ALWAYS)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.expr(BASE).alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))
