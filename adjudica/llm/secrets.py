"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Base kinds (``assign``, ``access``, ``hex``) are found by pattern. Besides, any long token that mixes digits
with capital and small letters is a *candidate*. Values are hashed, and each hash is counted over the
distinct repositories and owners that hold it: one that several owners hold, or many repositories of one, is a copied
example; one of a single owner and few repositories looks live. Live candidates outside the base spans are added as
kind ``live``; base spans stay, and are counted as live or shared.

Positions are code points. A regular expression gives matches and, by splitting, the pieces between
them; a match starts at the sum of the lengths before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from adjudica.llm.common import stored

#: Patterns of the kinds; fixed values. (ASCII letters in either case are spelled out.)
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # maximal runs: the same matches as AKIA[A-Z0-9]+ of 20 characters or more
HEX = r"[0-9a-f]{24,}"  # likewise
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "live")
SPAN = "array<struct<s:int,k:int,e:int,v:string>>"
_CHUNK = 256
#: Tasks over which the rows of one hash are spread when verdicts are joined to them.
_SALTS = 8


def _with_spans(rows: DataFrame, name: str, pattern: str, kind: int, group: int = 0) -> DataFrame:
    """Adds column ``name``, the spans of a pattern in ``_t``. Each step is a column of its own, so that what a lambda
    refers to is computed once a row; sums over lengths go by chunks, so that many matches stay cheap."""
    hit = F.col("_t").rlike(pattern)
    rows = rows.withColumn("_found", F.when(hit, F.regexp_extract_all("_t", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("_value", F.when(hit, F.regexp_extract_all("_t", F.lit(pattern), F.lit(group)))) if group else rows.withColumn("_value", F.col("_found"))
    rows = rows.withColumn("_between", F.when(F.size("_found") > 0, F.transform(F.split("_t", pattern, -1), lambda p: F.length(p))))
    rows = rows.withColumn("_step", F.zip_with("_found", "_between", lambda m, n: F.coalesce(F.length(m), F.lit(0)) + n))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + x)
    numbers = F.sequence(F.lit(0), F.floor(F.size("_found") / _CHUNK).cast("int"))
    rows = rows.withColumn("_sums", F.transform(numbers, lambda c: total(F.slice("_step", c * _CHUNK + 1, F.lit(_CHUNK)))))
    rows = rows.withColumn("_before", F.transform(numbers, lambda c: total(F.slice("_sums", F.lit(1), c))))
    chunk = lambda i: F.floor(i / _CHUNK).cast("int")
    start = lambda m, i: F.get("_before", chunk(i)) + total(F.slice("_step", chunk(i) * _CHUNK + 1, (i % _CHUNK).cast("int"))) + F.get("_between", i)
    rows = rows.withColumn("_start", F.transform("_found", start))
    spans = F.transform("_found", lambda m, i: F.struct(F.get("_start", i).alias("s"), F.lit(kind).alias("k"), (F.get("_start", i) + F.length(m)).alias("e"), F.get("_value", i).alias("v")))
    return rows.withColumn(name, F.when(F.size("_found") > 0, spans).otherwise(F.array().cast(SPAN))).drop("_found", "_value", "_between", "_step", "_sums", "_before", "_start")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """(row, doc_id, owner, repo, base, candidates) of every row: arrays of (s, k, e, v), v the value. Null texts are empty,
    a null owner or repository is one of its own name ''. ``row`` numbers the rows once they are stored."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), name(owner_col).alias("owner"), name(repo_col).alias("repo"), text.alias("_t"))
    for kind, (pattern, group) in enumerate(((ASSIGN, 2), (ACCESS, 0), (HEX, 0), (CANDIDATE, 0))):
        rows = _with_spans(rows, f"_{KINDS[kind]}", pattern, kind, group)
    assign = F.filter("_assign", lambda x: F.length(x["v"]) >= 6)
    rows = rows.withColumn("base", F.sort_array(F.concat(assign, "_access", "_hex")))
    rows = rows.withColumn("candidates", F.filter("_live", lambda x: x["v"].rlike("[0-9]") & x["v"].rlike("[A-Z]") & x["v"].rlike("[a-z]")))
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repo", "base", "candidates")


def each_span(rows: DataFrame) -> DataFrame:
    """(row, owner, repo, s, k, e, v, hash): base spans, and the candidates that meet none of them. Spans of a row are
    sorted and passed once each way, so that a text of very many secrets stays cheap."""
    spans = rows.select("row", "owner", "repo", F.explode(F.concat("base", "candidates")).alias("x")).select("row", "owner", "repo", "x.*")
    forth, back = W.partitionBy("row").orderBy("s", "k"), W.partitionBy("row").orderBy(F.col("s").desc(), "k")
    until = F.max(F.when(F.col("k") < 3, F.col("e"))).over(forth.rowsBetween(W.unboundedPreceding, 0))
    since = F.min(F.when(F.col("k") < 3, F.col("s"))).over(back.rowsBetween(W.unboundedPreceding, 0))
    spans = spans.withColumns({"until": until, "since": since})
    meets = (F.coalesce("until", F.lit(-1)) > F.col("s")) | (F.coalesce("since", F.col("e")) < F.col("e"))
    return spans.where((F.col("k") < 3) | ~meets).drop("until", "since").withColumn("hash", F.sha2("v", 256))


def ownership(values: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repos) of (hash, owner, repo) rows; repositories are counted within their owner.
    Rows are brought together step by step, so that a hash that a third of the rows hold is summed, not gathered."""
    repos = values.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    owners = repos.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return owners.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repos"))


def find_secrets(docs: DataFrame, max_owners: int = 1, max_repos: int = 8, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, ``base`` and ``spans`` (arrays of (s, k, e, v) in order), n_live and n_shared (spans whose
    value at most ``max_owners`` owners and ``max_repos`` repositories hold, and the others).

    Ties (one value at one place by two kinds) stay, in order of kind; repeated rows are judged alike, and
    rows that share a doc_id share the repository of that name; an empty table gives no row. Texts of any length are searched whole; only
    the four named columns are read, so that no other can clash.
    """
    rows = stored(scan(docs, id_col, text_col, owner_col, repo_col), "secrets")
    any_ = (F.size("base") > 0) | (F.size("candidates") > 0)
    spans = each_span(rows.where(any_))
    counts = ownership(spans.select("hash", "owner", "repo"))
    # the rows of a value that a third of the texts hold go to many tasks: verdicts, few, are repeated for each
    live = counts.where((F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)).select("hash", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"), F.lit(True).alias("live"))
    told = spans.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(_SALTS)).cast("int")).join(live, ["hash", "salt"], "left").withColumn("live", F.coalesce("live", F.lit(False)))
    of_row = told.groupBy("row").agg(F.sort_array(F.collect_list(F.when((F.col("k") < 3) | F.col("live"), F.struct("s", "k", "e", "v")))).alias("spans"), F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_shared"))
    judged = rows.where(any_).select("row", "doc_id", "base").join(of_row, "row").select("doc_id", "base", "spans", "n_live", "n_shared")
    zero = F.lit(0).cast("long")
    return judged.unionByName(rows.where(~any_).select("doc_id", "base", F.col("base").alias("spans"), zero.alias("n_live"), zero.alias("n_shared")))


def _names(spans: str) -> Column:
    kind = lambda x: F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["k"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x), x["s"].cast("string"), x["e"].cast("string"))), ",")


def contract(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_shared of every row; see ``find_secrets`` for odd rows."""
    found = find_secrets(docs)
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_names("base"), 256).alias("base_sha256"), _names("spans").alias("spans"), "n_live", "n_shared",
    )
