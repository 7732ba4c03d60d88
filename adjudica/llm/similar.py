"""N-gram Jaccard join: MinHash banding finds groups, full n-gram sets decide every pair.

1. Each text gives its set of hashed word five-grams (A-Z lower-cased, words of letters, digits and non-ASCII; a
   text of one to four words is one gram), the set's own 128-bit hash, and its band hashes. Rows of the
   same set are one *class*, so that exact copies are one row from here on. Its number is its smallest doc_id, or
   a free one where another set has that doc_id too, or no row of it has any.
2. Classes are shuffled on band hashes; those with a common band hash are a *star* around the smallest. Bands and
   rows are chosen for a target recall at the threshold.
3. Full sets decide. Classes that stars tie together, if they are few and short, are compared at once. Where chance
   hits tie many, each star is compared by itself, and a pair counts in the first band that it shares. Sets are dealt in
   blocks of a bounded number of classes and n-grams, each pair of blocks in a task of its own, and compared as
   products of 0/1 matrices: every link is counted, no pair is written. Each block pair gives a class its
   number of links and the smallest class it reaches there.
4. The latter are edges of which the connected components are the near-duplicate groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from adjudica.llm.common import WordHashes, base_rows, mix64, stored, word_bytes
from adjudica.operators.components import connected_components

#: What is compared at once, at most (or one class): classes, and n-grams of their sets together.
BLOCK_CLASSES = 256
BLOCK_GRAMS = 1 << 19
MAX_HASHES = 256


def choose_bands(threshold: float, recall: float, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest false candidates, that reach ``recall`` at ``threshold``
    with at most ``max_hashes`` hashes."""
    best = None
    for rows in range(1, max_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches this recall with so few hashes")
    return best


def gram_set(text: str, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams."""
    words = hashes.of(word_bytes(text))
    if not len(words):
        return words
    size = min(n, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out = mix64(out ^ words[k : len(words) - size + 1 + k]) + np.uint64(k + size)
    return np.unique(out)


def set_key(grams: np.ndarray) -> tuple[int, int]:
    h = xxhash.xxh3_128_digest(grams.tobytes())
    a, b = np.frombuffer(h, "<i8").tolist()
    return a, b


def _signatures(n: int, bands: int, rows: int):
    rng = np.random.RandomState(20_071)
    a = rng.randint(0, 1 << 62, bands * rows).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.randint(0, 1 << 62, bands * rows).astype(np.uint64)

    def signature(grams: np.ndarray) -> np.ndarray:
        least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
        for k in range(0, len(grams), 2048):
            least = np.minimum(least, (grams[k : k + 2048, None] * a + b).min(0))
        least = least.reshape(bands, rows)
        out = np.arange(bands).astype(np.uint64)
        for k in range(rows):
            out = mix64(out ^ least[:, k]) + np.uint64(k)
        return out.view(np.int64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for frame in frames:
            out = {"k1": [], "k2": [], "n_grams": [], "bands": []}
            for text in frame.text:
                grams = gram_set(text, n, hashes)
                k1, k2 = set_key(grams)
                for c, v in (("k1", k1), ("k2", k2), ("n_grams", len(grams)), ("bands", signature(grams) if len(grams) else None)):
                    out[c].append(v)
            yield pd.DataFrame({"doc_id": frame.doc_id, "text_id": frame.text_id, **out})

    return run


def _sets(n: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for frame in frames:
            sets = [gram_set(t, n, hashes) for t in frame.text]
            keys = [set_key(s) for s in sets]
            same = np.array([k == (a, b) for k, a, b in zip(keys, frame.k1, frame.k2)], bool)
            frame["grams"] = [s.tobytes() for s in sets]
            yield frame.loc[same, ["class_id", "bands", "deals", "grams"]]  # another text of the doc_id is of another class

    return run


def _linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix of the links between the sets ``left`` and ``right``."""
    sizes = np.array([len(s) for s in sets])
    values, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = counts[at] > 1  # a gram of one set meets no other
    column = (np.cumsum(counts > 1) - 1)[at[shared]]
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    place = np.full(len(sets), -1)
    meet = np.zeros((len(left), len(right)), np.float32)
    width, total = 2048, int(column[-1]) + 1 if len(column) else 0
    for k in range(0, total, width):
        a, b = np.searchsorted(column, [k, k + width])
        m = np.zeros((len(sets), min(width, total - k)), np.float32)
        m[owner[a:b], column[a:b] - k] = 1
        meet += m[left] @ m[right].T
    del place, values
    return meet >= threshold * (sizes[left][:, None] + sizes[right][None, :] - meet) - 1e-4


def _verify(threshold: float):
    def group(key: tuple, ids: np.ndarray, blocks: np.ndarray, bands: np.ndarray, raw: list[bytes]) -> pd.DataFrame | None:
        band, _, bi, bj = key
        order = np.argsort(ids, kind="stable")
        ids, blocks, bands = ids[order], blocks[order], bands[order]
        sets = [np.frombuffer(raw[k], np.uint64) for k in order.tolist()]
        left, right = np.flatnonzero(blocks == bi), np.flatnonzero(blocks == bj)
        if not len(left) or not len(right):
            return None
        links = _linked(sets, left, right, threshold)
        if bi == bj:
            np.fill_diagonal(links, False)
        own = links.copy()
        for b in range(band):  # pairs that an earlier band brings together are counted there
            own &= bands[left, b][:, None] != bands[right, b][None, :]
        n = np.zeros(len(ids), np.int64)
        n[left] += own.sum(1)
        if bi != bj:
            n[right] += own.sum(0)
        label = np.arange(len(ids))
        while True:  # smallest class that each reaches
            new = label.copy()
            new[left] = np.minimum(new[left], np.where(links, label[right][None, :], len(ids)).min(1))
            new[right] = np.minimum(new[right], np.where(links, label[left][:, None], len(ids)).min(0))
            new = np.minimum(new, new[new])
            if (new == label).all():
                break
            label = new
        some = np.flatnonzero((n > 0) | (label < np.arange(len(ids))))
        return pd.DataFrame({"class_id": ids[some], "hook": ids[label[some]], "n": n[some]}) if len(some) else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids, blocks, bands, raw = None, [], [], [], []

        def settle() -> pd.DataFrame | None:
            return group(key, np.array(ids), np.array(blocks), np.stack(bands), raw) if len(ids) > 1 else None

        for frame in frames:
            for *k, cid, block, own, grams in zip(frame.band, frame.group, frame.bi, frame.bj, frame.class_id, frame.block, frame.bands, frame.grams):
                if tuple(k) != key:
                    if (out := settle()) is not None:
                        yield out
                    key, ids, blocks, bands, raw = tuple(k), [], [], [], []
                ids.append(cid)
                blocks.append(block)
                bands.append(np.asarray(own, np.int64))
                raw.append(grams)
        if (out := settle()) is not None:
            yield out

    return run


def candidate_groups(classes: DataFrame) -> DataFrame:
    """(class_id, deals) of the classes that share a band hash with another. ``deals``: where to compare it, as (band, group,
    blocks): band -1 and its component where that is one block, or else the stars that it is in.

    A band is a star around its smallest class. A class that is in several stars ties their centres together,
    and groups of copies tie the same few centres: components are sought among the centres alone, and
    each class goes where its smallest centre is.
    """
    bands = classes.select("class_id", "n_grams", F.posexplode("bands").alias("at", "band"))
    blocks = lambda n, g: F.greatest(F.ceil(F.col(n) / BLOCK_CLASSES), F.ceil(F.col(g) / BLOCK_GRAMS)).cast("int")
    sums = [F.count(F.lit(1)).alias("n"), F.sum("n_grams").alias("g")]
    least = bands.groupBy("band").agg(F.min("class_id").alias("centre"), *sums).where("n > 1").select("band", "centre", blocks("n", "g").alias("blocks"))
    in_star = F.struct(F.col("at").cast("int").alias("band"), F.col("band").alias("group"), "blocks")
    own = bands.join(least, "band").groupBy("class_id").agg(F.min("centre").alias("centre"), F.collect_set("centre").alias("centres"), F.max("n_grams").alias("n_grams"), F.collect_list(in_star).alias("stars"))
    own = stored(own, "jaccard-stars")
    ties = own.select(F.col("centre").alias("a"), F.explode("centres").alias("b")).where("a <> b").distinct()
    found = connected_components(ties)
    placed = own.join(found, own.centre == found.node, "left").select("class_id", "n_grams", "stars", F.coalesce("component", "centre").alias("component"))
    sizes = placed.groupBy("component").agg(*sums).select("component", blocks("n", "g").alias("blocks"))
    whole = F.array(F.struct(F.lit(-1).alias("band"), F.col("component").alias("group"), "blocks"))
    return placed.join(sizes, "component").select("class_id", F.when(F.col("blocks") == 1, whole).otherwise(F.col("stars")).alias("deals"))


def _numbered_classes(worded: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, text_id, class_size, class_id) of each set: the smallest row of it, and its number, which no two share."""
    first = F.min(F.struct(F.isnull("doc_id").alias("nil"), "doc_id", "text_id")).alias("x")
    named = stored(worded.groupBy("k1", "k2").agg(first, F.count(F.lit(1)).alias("class_size")).select("k1", "k2", "x.doc_id", "x.text_id", "class_size"), "jaccard-sets")
    shared = named.groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("owner"), F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("same")).where("n > 1 OR doc_id IS NULL")
    low, high = named.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, high = low or 0, high or 0
    if high >= 1 << 62 and low <= -(1 << 62):
        raise ValueError("doc_ids leave no free numbers")
    free = F.lit(high + 1) + F.monotonically_increasing_id() if high < 1 << 62 else F.lit(low - 1) - F.monotonically_increasing_id()
    rows = named.join(shared.select(F.col("doc_id").alias("_shared"), "owner"), F.col("doc_id").eqNullSafe(F.col("_shared")), "left")
    owned = F.col("doc_id").isNotNull() & (F.col("owner").isNull() | (F.col("owner") == F.struct("k1", "k2")))
    return stored(rows.select("k1", "k2", "doc_id", "text_id", "class_size", F.when(owned, F.col("doc_id")).otherwise(free).alias("class_id")), "jaccard-classes")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return base_rows(docs, id_col, text_col).withColumn("text_id", F.unhex(F.sha2("text", 256)))


def grouped(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: what ``near_duplicates`` tells, with text_id (the SHA-256 of the text) and stays, which is true on the
    rows of the text that stands for its group."""
    bands, rows = choose_bands(threshold, recall)
    base = _rows(docs, id_col, text_col)
    schema = "doc_id long, text_id binary, k1 long, k2 long, n_grams int, bands array<long>"
    signed = stored(base.mapInPandas(_signatures(n, bands, rows), schema), "jaccard-signatures")
    worded = signed.where("n_grams > 0")
    named = _numbered_classes(worded)
    numbers = named.select(F.col("doc_id").alias("_doc"), F.col("text_id").alias("_text"), "class_id")
    own = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_id") == F.col("_text"))  # joined by row: copies of a text don't meet
    heads = worded.join(numbers, own)
    classes = stored(heads.select("class_id", "doc_id", "text_id", "k1", "k2", "n_grams", "bands").dropDuplicates(["class_id"]), "jaccard-heads")
    groups = stored(candidate_groups(classes), "jaccard-groups")
    wanted = groups.join(classes.select("class_id", F.col("doc_id").alias("_doc"), F.col("text_id").alias("_text"), "k1", "k2", "bands"), "class_id")
    texts = base.join(wanted, own).select("class_id", "k1", "k2", "bands", "deals", "text")
    deals = "deals array<struct<band:int,group:long,blocks:int>>"
    sets = texts.mapInPandas(_sets(n), f"class_id long, bands array<long>, {deals}, grams binary").dropDuplicates(["class_id"])
    dealt = sets.select("class_id", F.explode("deals").alias("d"), "bands", "grams").select("class_id", "d.*", "bands", "grams")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("class_id"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", "group", "blocks", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "class_id", "block", "bands", "grams")
    parts, key = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["band", "group", "bi", "bj"]
    # the pairs of a large group's blocks go to tasks in turn, so that no task has several before each has one
    place = F.pmod(F.xxhash64("band", "group") + F.col("bi").cast("long") * F.col("blocks") + F.col("bj"), F.lit(parts)).cast("int")
    dealt = dealt.repartitionById(parts, place).sortWithinPartitions(*key)
    found = stored(dealt.mapInPandas(_verify(threshold), "class_id long, hook long, n long"), "jaccard-links")
    links = found.groupBy("class_id").agg(F.sum("n").alias("n_links"))
    near = connected_components(found.where("class_id <> hook"), "class_id", "hook").select(F.col("node").alias("class_id"), "component")
    told = named.join(links, "class_id", "left").join(near, "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    first = told.groupBy("component").agg(F.min(F.struct(F.isnull("doc_id").alias("nil"), "doc_id", "class_id")).alias("x")).select("component", F.col("x.doc_id").alias("group_id"), F.col("x.class_id").alias("_first"))
    told = told.join(first, "component").select("k1", "k2", F.col("doc_id").alias("named"), F.col("text_id").alias("_text"), "class_size", "group_id", (F.col("class_id") == F.col("_first")).alias("_stands"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    stays = F.col("_stays") & F.col("doc_id").eqNullSafe(F.col("named")) & (F.col("text_id") == F.col("_text"))
    some = worded.select("doc_id", "text_id", "k1", "k2").join(told.withColumnRenamed("_stands", "_stays"), ["k1", "k2"])
    some = some.select("doc_id", "text_id", F.col("named").alias("class_id"), "class_size", "group_id", "n_links", stays.alias("stays"))
    none = signed.where("n_grams = 0").select("doc_id", "text_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.col("doc_id").alias("group_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("stays"))
    return some.unionByName(none)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size, group_id, n_links.

    class_id is the smallest doc_id of the rows with the same n-gram set, n_links the number of other classes
    whose Jaccard similarity is ``threshold`` or more, group_id the smallest class_id reached by links. Texts
    without words (null, empty) are like nothing: each is its own class. Rows of one doc_id with different texts are in the classes of their
    sets, which then show the same class_id without being one class. A null doc_id is larger than any other: a class or group has it
    where no row has another. Repeated rows are one class; of ties the smallest SHA-256 of the text stands for a class. Texts of any length are whole.
    Only the two named columns are read, so that no other can clash. An empty table gives no row.
    """
    return grouped(docs, threshold, n, recall, id_col, text_col).drop("text_id", "stays")


def keep_one(docs: DataFrame, threshold: float = 0.8, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate group: of the smallest doc_id in it (null last), and of its texts the one that
    stands for its class. Rows that repeat both become one. Rows without words stay, repeated ones too."""
    own, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    found = grouped(docs, threshold, n, id_col=id_col, text_col=text_col).where("stays")
    stays = found.select(F.coalesce("doc_id", F.lit(0)).alias("_stays"), F.isnull("doc_id").alias("_nil"), F.col("text_id").alias("_text")).distinct()
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(own, F.lit(0)).alias("_stays"), own.isNull().alias("_nil"), F.unhex(F.sha2(text, 256)).alias("_text"), text.rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]").alias("_worded"))
    kept = keyed.where("_worded").join(stays, ["_stays", "_nil", "_text"], "left_semi").dropDuplicates(["_stays", "_nil", "_text"])
    return kept.select("row.*").unionByName(keyed.where("NOT _worded").select("row.*"))
