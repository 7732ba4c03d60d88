"""Reversible line dedup: exact reference counts per line key, with sharded cuckoo filters before them.

A line's key is the line without the blanks at both ends, A-Z lower-cased. Keys of ``min_chars`` or more are
counted over the documents that hold them. The state of a corpus (``LineIndex``) is

* ``postings`` (doc_id, k1, k2): each document's keys, as 128-bit hashes, each once;
* ``counts`` (k1, k2, n_docs, keeper): exact references, keeper the largest doc_id; a table for each batch that was
  inserted, which are added up where they are read;
* ``filters`` (shard, buckets, size): one cuckoo filter per shard, of the keys that are in ``min_docs`` documents or
  more: 16-bit fingerprints in buckets of four. Keys are added as they become that common, and taken out when deletions
  make them rare again.

Lines are first held against the filter of their shard; the few that it may hold are looked up in the exact
table, which decides. Inserting appends to the tables and asks for the counts only of keys that a filter does not
hold; deleting documents rewrites the counts of their keys, so that what inserting and deleting leave is what the
remaining documents alone would have given. Shards are split when they grow.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from adjudica.llm.common import base_rows, mix64, stored

_BLANKS = " \t\n\x0b\x0c\r"
SHARD_KEYS = 1 << 17
#: Tasks over which the lines of one key or shard are spread at least.
SALTS = 16
NULL_ID = -(1 << 63)
FILTERS = "shard int, buckets binary, size int"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_BLANKS)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key_hash(key: Column) -> Column:
    """128 bits as two longs."""
    return F.struct(F.xxhash64(key).alias("k1"), F.xxhash64(F.lit("line"), key).alias("k2"))


class CuckooFilter:
    """16-bit fingerprints, four to a bucket; a key has two buckets, each known from the other and the fingerprint.
    Adding in bulk places what fits at once and moves others' fingerprints along for the rest."""

    SLOTS = 4

    def __init__(self, keys: int):
        buckets = 1 << max(3, int(np.ceil(np.log2(max(keys, 1) / self.SLOTS / 0.8))))
        self.table = np.zeros((buckets, self.SLOTS), np.uint16)

    @classmethod
    def load(cls, raw: bytes) -> CuckooFilter:
        own = cls.__new__(cls)
        own.table = np.frombuffer(raw, np.uint16).reshape(-1, cls.SLOTS).copy()
        return own

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix64(keys.astype(np.uint64))
        mark = ((h >> np.uint64(48)).astype(np.int64) % 65535 + 1).astype(np.uint16)
        first = (h & np.uint64(len(self.table) - 1)).astype(np.int64)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mix64(mark.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(keys)
        return (self.table[a] == mark[:, None]).any(1) | (self.table[b] == mark[:, None]).any(1)

    def _swap(self, bucket: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Puts each ``new`` in a slot of its bucket that has ``old``, different slots for different rows; whether there was one."""
        group = bucket * 65536 + old
        order = np.argsort(group, kind="stable")
        same = group[order]
        begin = np.concatenate(([True], same[1:] != same[:-1]))
        rank = np.empty(len(bucket), np.int64)
        rank[order] = np.arange(len(bucket)) - np.maximum.accumulate(np.where(begin, np.arange(len(bucket)), 0))
        fits = self.table[bucket] == old[:, None]
        found = rank < fits.sum(1)
        slot = np.argsort(~fits, axis=1, kind="stable")[np.flatnonzero(found), rank[found]]
        self.table[bucket[found], slot] = new[found]
        return found

    def add(self, keys: np.ndarray) -> bool:
        """False if the table is too full: the caller builds a larger one."""
        mark, a, b = self._places(keys)
        none = np.zeros(len(keys), np.uint16)
        for side in (0, 1):
            if len(mark):
                left = ~self._swap((a, b)[side], none[: len(mark)], mark)
                mark, a, b = mark[left], a[left], b[left]
        for m, bucket in zip(mark.tolist(), a.tolist()):
            slot = 0
            for k in range(500):
                slot = (slot + k) % self.SLOTS
                m, self.table[bucket, slot] = int(self.table[bucket, slot]), m
                bucket = int(self._other(np.array([bucket]), np.array([m], np.uint16))[0])
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = m
                    break
            else:
                return False
        return True

    def remove(self, keys: np.ndarray) -> None:
        mark, a, b = self._places(keys)
        none = np.zeros(len(keys), np.uint16)
        left = ~self._swap(a, mark, none) if len(mark) else np.zeros(0, bool)
        if left.any():
            self._swap(b[left], mark[left], none[left])


def build_filter(keys: np.ndarray) -> CuckooFilter:
    room = max(len(keys), 8)
    while True:
        made = CuckooFilter(room)
        if made.add(keys):
            return made
        room *= 2


def _long_lines(min_chars: int) -> Column:
    """(k1, k2, at) of each line whose key is long enough; a key is as long as its line without the blanks."""
    keys = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(line_key(x).alias("key"), i.alias("at")))
    long = F.filter(keys, lambda k: F.length(k["key"]) >= min_chars)
    return F.transform(long, lambda k: F.struct(F.xxhash64(k["key"]).alias("k1"), F.xxhash64(F.lit("line"), k["key"]).alias("k2"), k["at"].alias("at")))


def postings_of(docs: DataFrame, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k1, k2): each key of a row once."""
    keys = F.transform(F.split("text", "\n", -1), line_key)
    long = F.array_distinct(F.filter(keys, lambda k: F.length(k) >= min_chars))
    rows = base_rows(docs, id_col, text_col).select("doc_id", F.explode(F.transform(long, key_hash)).alias("k"))
    return rows.select("doc_id", "k.k1", "k.k2")


def count_references(postings: DataFrame) -> DataFrame:
    """(k1, k2, n_docs, keeper); summed before the shuffle, so that a line of every document is one row a task."""
    return postings.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))


def shard_of(shards: int) -> Column:
    return F.pmod(F.col("k2"), F.lit(shards)).cast("int").alias("shard")


def filters_of(keys: DataFrame, shards: int) -> DataFrame:
    """One cuckoo filter a shard of distinct (k1, k2) rows; a shard is about ``SHARD_KEYS`` keys by the caller's count."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        made = build_filter(frame.k1.to_numpy().view(np.uint64))
        return pd.DataFrame([(int(frame["shard"].iloc[0]), made.table.tobytes(), len(frame))], columns=["shard", "buckets", "size"])

    return keys.select("k1", "k2", shard_of(shards)).groupBy("shard").applyInPandas(build, FILTERS)


def probe(lines: DataFrame, filters: DataFrame, shards: int, spread: str) -> DataFrame:
    """``lines`` (k1, k2 and other whole numbers, none null) with ``maybe``: whether the filter of their shard may hold them. Filters and
    lines meet by shard and a salt (of column ``spread``), a filter before its lines, so that a task streams lines past one filter."""
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = max(SALTS, 2 * parts // shards)  # few shards are spread over all tasks
    kept, schema = lines.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema)
    some = lines.select("*", shard_of(shards), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int").alias("salt"), F.lit(None).cast("binary").alias("buckets"))
    own = filters.select("shard", "buckets", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), *[F.lit(0).cast(f.dataType).alias(f.name) for f in lines.schema])
    both = some.unionByName(own).withColumn("first", F.col("buckets").isNull())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, own = None, None
        for frame in frames:
            place = frame["shard"].to_numpy().astype(np.int64) * salts + frame["salt"].to_numpy()
            new = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            for a, b in zip(new.tolist(), [*new[1:].tolist(), len(place)]):
                if place[a] != at:
                    at, own = place[a], None
                if frame.buckets.iloc[a] is not None:
                    own, a = CuckooFilter.load(frame.buckets.iloc[a]), a + 1
                if a < b:
                    out = frame.iloc[a:b][kept].copy()
                    out["maybe"] = own.holds(out.k1.to_numpy().view(np.uint64)) if own is not None else False
                    yield out

    dealt = both.repartition(parts, "shard", "salt").sortWithinPartitions("shard", "salt", "first")
    return dealt.mapInPandas(run, schema + ", maybe boolean")


class LineIndex:
    """The state of a corpus; ``insert`` and ``delete`` give new states."""

    def __init__(self, postings: list[DataFrame], counts: list[DataFrame], filters: DataFrame, shards: int, min_docs: int, min_chars: int):
        self._postings, self._counts = postings, counts
        self.filters, self.shards, self.min_docs, self.min_chars = filters, shards, min_docs, min_chars

    @property
    def postings(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self._postings)

    @property
    def counts(self) -> DataFrame:
        if len(self._counts) == 1:
            return self._counts[0]
        return reduce(DataFrame.unionByName, self._counts).groupBy("k1", "k2").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))

    def repeated(self) -> DataFrame:
        """(k1, k2, keeper) of the keys whose lines go."""
        return self.counts.where(F.col("n_docs") >= self.min_docs).select("k1", "k2", "keeper")

    @classmethod
    def of(cls, docs: DataFrame, min_docs: int = 3, min_chars: int = 20, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text", keep_postings: bool = True) -> LineIndex:
        """Without ``keep_postings`` the state is for dropping lines only: it can't be changed."""
        postings = postings_of(docs, min_chars, id_col, text_col)
        postings = stored(postings, "line-postings") if keep_postings else postings
        counts = stored(count_references(postings), "line-counts") if keep_postings else stored(count_references(postings).where(F.col("n_docs") >= min_docs), "line-counts")
        own = cls([postings] if keep_postings else [], [counts], None, 1, min_docs, min_chars)
        return own._sharded(shards or own.repeated().count() // SHARD_KEYS)

    def _sharded(self, shards: int) -> LineIndex:
        self.shards = max(1, shards)
        self.filters = stored(filters_of(self.repeated(), self.shards), "line-filters")
        return self

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """Documents whose doc_id is there already change nothing, so that a batch may be inserted again."""
        there = self.postings.select("doc_id").distinct()
        new = postings_of(docs, self.min_chars, id_col, text_col).alias("n").join(there.alias("o"), F.col("n.doc_id").eqNullSafe(F.col("o.doc_id")), "left_anti")
        new = stored(new, "line-postings")
        batch = stored(count_references(new), "line-counts")
        # keys that a filter may hold are common already, or held for another's sake: only the others may become common
        told = stored(probe(batch.select("k1", "k2"), self.filters, self.shards, "k1"), "line-batch")
        before, after = self.counts, LineIndex([*self._postings, new], [*self._counts, batch], self.filters, self.shards, self.min_docs, self.min_chars)
        met = after.counts.join(told.select("k1", "k2", "maybe"), ["k1", "k2"]).where(F.col("n_docs") >= self.min_docs)
        risen = met.where("NOT maybe").select("k1", "k2")
        doubt = met.where("maybe").select("k1", "k2").join(before.where(F.col("n_docs") >= self.min_docs).select("k1", "k2"), ["k1", "k2"], "left_anti")
        after.filters = self._changed(risen.unionByName(doubt), True, after.repeated())
        size = after.filters.agg(F.sum("size")).first()[0] or 0
        return after._sharded(2 * self.shards) if size > 2 * SHARD_KEYS * self.shards else after

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """``doc_ids``: one column doc_id. Documents that were never inserted change nothing."""
        ids = doc_ids.select(F.col(doc_ids.columns[0]).cast("long").alias("doc_id")).distinct()
        gone = stored(self.postings.join(ids, "doc_id", "left_semi").select("k1", "k2").distinct(), "line-gone")
        postings = stored(self.postings.join(ids, "doc_id", "left_anti"), "line-postings")
        touched = count_references(postings.join(gone, ["k1", "k2"], "left_semi"))
        counts = stored(self.counts.join(gone, ["k1", "k2"], "left_anti").unionByName(touched), "line-counts")
        after = LineIndex([postings], [counts], self.filters, self.shards, self.min_docs, self.min_chars)
        fallen = self.repeated().select("k1", "k2").join(gone, ["k1", "k2"], "left_semi").join(after.repeated().select("k1", "k2"), ["k1", "k2"], "left_anti")
        after.filters = self._changed(fallen, False, after.repeated())
        return after

    def _changed(self, keys: DataFrame, added: bool, repeated: DataFrame) -> DataFrame:
        shards = self.shards

        def change(found: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            shard = int(found["shard"].iloc[0]) if len(found) else int(own["shard"].iloc[0])
            size = int(own["size"].iloc[0]) if len(own) else 0
            marks = found.k1.to_numpy().view(np.uint64) if len(found) else np.zeros(0, np.uint64)
            if not len(own):
                made = build_filter(marks)
            else:
                made = CuckooFilter.load(own.buckets.iloc[0])
                if not added:
                    made.remove(marks)
                elif size + len(marks) > 0.85 * made.table.size or not made.add(marks):
                    return pd.DataFrame([(shard, None, -1)], columns=["shard", "buckets", "size"])
            return pd.DataFrame([(shard, made.table.tobytes(), size + (len(marks) if added else -len(marks)))], columns=["shard", "buckets", "size"])

        # a group is the keys of one shard that change and its filter: shards are split before they grow large
        changed = stored(keys.select("k1", "k2", shard_of(shards)).groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(change, FILTERS), "line-filters")
        full = changed.where("size < 0").select("shard")
        again = filters_of(repeated.join(full, F.pmod("k2", F.lit(shards)).cast("int") == F.col("shard"), "left_semi"), shards)  # built anew from the exact table
        return stored(changed.where("size >= 0").unionByName(again), "line-filters")

    def drop(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``docs`` with ``_n_lines``, ``_n_dropped`` and ``_kept``: see ``drop_repeated_lines``."""
        own = {"_n_lines", "_n_dropped", "_kept", "_id", "_tie", "_gone", "_of", "_same", "_lines", "_ends"}
        names = [F.col(f"`{c}`") for c in docs.columns if c not in own]
        # a row is named by its doc_id and its text, so that rows that repeat a doc_id stay apart
        id_ = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(NULL_ID))
        lines = base_rows(docs, id_col, text_col).select(id_("doc_id").alias("doc"), F.xxhash64("text").alias("tie"), F.explode(_long_lines(self.min_chars)).alias("x")).select("doc", "tie", "x.*")
        maybe = probe(lines, self.filters, self.shards, "doc").where("maybe").drop("maybe")
        # the lines of a key that a third of the documents hold go to many tasks, those of copies of one text too
        exact = self.repeated().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        gone = maybe.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).join(exact, ["k1", "k2", "salt"]).where(F.col("doc") != id_("keeper"))
        of_row = gone.groupBy(F.col("doc").alias("_of"), F.col("tie").alias("_same")).agg(F.sort_array(F.collect_set("at")).alias("_gone"))
        text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
        rows = docs.select(*names, id_(f"`{id_col}`").alias("_id"), F.xxhash64(text).alias("_tie"))
        rows = rows.join(of_row, (F.col("_id") == F.col("_of")) & (F.col("_tie") == F.col("_same")), "left")
        rows = rows.withColumn("_lines", F.split(text, "\n", -1))
        # what stays are the runs of lines between those that go
        rows = rows.withColumn("_ends", F.concat("_gone", F.array(F.size("_lines"))))
        runs = F.transform("_ends", lambda b, i: F.slice("_lines", F.when(i > 0, F.get("_ends", i - 1) + 2).otherwise(1), b - F.when(i > 0, F.get("_ends", i - 1) + 1).otherwise(0)))
        rows = rows.withColumn("_kept", F.when(F.col("_gone").isNull(), F.col("_lines")).otherwise(F.flatten(runs)))
        n = F.size("_lines").cast("long")
        return rows.select(*names, n.alias("_n_lines"), (n - F.size("_kept")).alias("_n_dropped"), F.array_join("_kept", "\n").alias("_kept"))


def drop_repeated_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``_n_lines``, ``_n_dropped`` and ``_kept`` (the lines that stay, joined by \\n), through an index of ``docs`` itself.

    Lines whose key has ``min_chars`` code points or more and is in ``min_docs`` rows or more go, but for those of the
    largest doc_id that holds it. Null or empty text is one empty line. Rows of one doc_id are documents of
    their own that tie for the largest id, and all of them keep the line; a null doc_id is smaller than any
    other (a key that only such rows hold stays in all of them). An empty table gives no row. Texts and lines of any length are whole;
    columns of ``docs`` that are named like the three added ones are replaced.
    """
    return LineIndex.of(docs, min_docs, min_chars, id_col=id_col, text_col=text_col, keep_postings=False).drop(docs, id_col, text_col)


def contract(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row; see ``drop_repeated_lines`` for odd rows."""
    done = drop_repeated_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return done.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256"))
