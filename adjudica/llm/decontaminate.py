"""Benchmark decontamination with a generalised suffix automaton of normalised test items.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. The automaton accepts every run of
words of every item. A document's words are streamed through it; at each word it gives the longest
run ending there that some item has. Runs of ``window`` words or more hit all words they cover, and so do
whole items of fewer words. Then spans go, or the whole document where hits cover too much of it.

Items are cut into blocks of at most ``block_words`` words, one automaton each, so that what is sent to the
executors at once is bounded whatever the benchmark's size. The rows pass ``BLOCKS_AT_ONCE`` automata in a stage, and
are stored before the next ones.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from adjudica.llm.common import WORD_BYTES, stored, word_bytes

_RUNS = re.compile(rb"[^ ]+")
BLOCKS_AT_ONCE = 8


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers. ``link`` are suffix links, ``length`` the longest run of a state,
    ``items`` the items whose windows are a state's runs. Most states have one transition: ``word`` and ``after`` hold the
    first of each state as plain integers, ``more`` the others."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.names = window, [name for name, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        step: list[dict[int, int]] = [{}]
        self.step, self.link, self.length = step, array("i", [-1]), array("i", [0])
        own: list[set[int]] = [set()]
        short: dict[int, set[int]] = {}
        for k, (_, words) in enumerate(items):
            at = 0
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            for c in numbers:
                at = self._extend(at, c)
                while len(own) < len(self.length):
                    own.append(set())
                own[at].add(k)
            if 0 < len(numbers) < window:
                short.setdefault(at, set()).add(k)
        # items of a state: its own and those of the states whose runs end in its runs
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            own[self.link[s]] |= own[s] if self.length[self.link[s]] >= window else set()
        self.items = {s: tuple(sorted(x)) for s, (x, n) in enumerate(zip(own, self.length)) if n >= window}
        # the item of fewer words that ends at a state has that state's full length: windows of their own
        self.short = {s: (self.length[s], tuple(sorted(x))) for s, x in short.items()}
        self.shortest = min([window, *(n for n, _ in self.short.values())])
        self.word, self.after = (array("i", [next(iter(x), -1) for x in each]) for each in (step, (x.values() for x in step)))
        self.more = {s: x for s, x in enumerate(step) if len(x) > 1 or not s}
        del self.step

    def _extend(self, last: int, c: int) -> int:
        step, link, length = self.step, self.link, self.length
        if c in step[last]:
            q = step[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        new = len(length)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: int, q: int) -> int:
        step, link, length = self.step, self.link, self.length
        copy = len(length)
        step.append(dict(step[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = copy
            p = link[p]
        return copy

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word spans [a, b) inside occurrences of windows, in order and disjoint, and the items they are of."""
        numbers = list(map(self.vocabulary.get, words))
        spans: list[list[int]] = []
        found: set[int] = set()
        link, length, window = self.link, self.length, self.window
        word, after, more, root, none = self.word, self.after, self.more, self.more[0], {}
        s = n = 0
        for i, c in enumerate(numbers):
            if c is None:
                s = n = 0
                continue
            to = None
            while s and to is None:
                to = after[s] if word[s] == c else more.get(s, none).get(c)
                if to is None:
                    s = link[s]
                    n = length[s]
            if to is None:
                to = root.get(c)
                if to is None:
                    continue
            s, n = to, n + 1
            reach = 0
            if n >= window:
                t = s  # the state of the window that ends here
                while length[link[t]] >= window:
                    t = link[t]
                found.update(self.items.get(t, ()))
                reach = n
            elif self.short:
                # a whole short item ends here only if its state is on the path of suffix links
                t = s
                while t > 0:
                    if t in self.short and self.short[t][0] <= n:
                        reach = max(reach, self.short[t][0])
                        found.update(self.short[t][1])
                    t = link[t]
            if n >= window and self.short:
                t = s
                while t > 0:
                    if t in self.short and self.short[t][0] <= n:
                        found.update(self.short[t][1])
                    t = link[t]
            if reach:
                a = i + 1 - reach
                while spans and spans[-1][1] >= a:
                    a = min(a, spans.pop()[0])
                spans.append([a, i + 1])
        return [(a, b) for a, b in spans], found


def item_blocks(benchmark: DataFrame, window: int, block_words: int, id_col: str = "item_id", text_col: str = "text") -> Iterator[SuffixAutomaton]:
    """Automata of the items, in order of their ids, of at most ``block_words`` words each (or one item).
    The rows come to the driver one partition at a time; null texts have no words."""
    block, size = [], 0
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).orderBy("i", "t")
    for row in rows.toLocalIterator():
        words = word_bytes(row.t)
        if words:
            if block and size + len(words) > block_words:
                yield SuffixAutomaton(block, window)
                block, size = [], 0
            block.append((row.i, words))
            size += len(words)
    if block:
        yield SuffixAutomaton(block, window)


HITS = "array<struct<a:int,b:int>>"


def _scan(shared, columns: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = shared.value
        for frame in frames:
            counts, spans, items = [], [], []
            for text, old, names in zip(frame["_text"], frame["_spans"], frame["_items"]):
                words = word_bytes(text)
                hit, found = automaton.hits(words) if len(words) >= automaton.shortest else ([], set())
                counts.append(len(words))
                spans.append(_union([(r["a"], r["b"]) for r in old], hit))
                items.append(sorted({*names, *(automaton.names[k] for k in found)}))
            frame["_words"], frame["_spans"], frame["_items"] = counts, [[{"a": a, "b": b} for a, b in x] for x in spans], items
            yield frame[columns]

    return run


def _union(old: list[tuple[int, int]], new: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted([*old, *new]) if old else new:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 200_000, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_words`` (count), ``_spans`` (disjoint word spans [a, b) that hits cover) and ``_items`` (sorted
    ids of the items with occurring windows).

    Null texts have no words; an empty benchmark hits nothing; rows are taken one by one, so that null or
    repeated ids change nothing, and an empty table gives no row. Texts of any length are read whole; all items that share a window are named. Columns named like the three added ones are replaced.
    """
    added = {"_words", "_spans", "_items", "_text"}
    frame = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    frame = frame.withColumns({"_words": F.lit(0), "_spans": F.array().cast(HITS), "_items": F.array().cast("array<string>")})
    none = True
    for k, automaton in enumerate(item_blocks(benchmark, window, block_words)):
        none = False
        frame = stored(frame, "contamination") if k and k % BLOCKS_AT_ONCE == 0 else frame
        shared = docs.sparkSession.sparkContext.broadcast(automaton)
        frame = frame.mapInPandas(_scan(shared, frame.columns), _schema(frame))
    if none:
        shared = docs.sparkSession.sparkContext.broadcast(SuffixAutomaton([], window))
        frame = frame.mapInPandas(_scan(shared, frame.columns), _schema(frame))
    return frame.drop("_text")


def _schema(frame: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in frame.schema])


def _cut(text: str | None, spans: list) -> str | None:
    if text is None or not len(spans):
        return text
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _RUNS.finditer(raw.translate(WORD_BYTES))]
    kept, at = [], 0
    for r in spans:
        kept.append(raw[at : places[r["a"]][0]])
        at = places[r["b"] - 1][1]
    kept.append(raw[at:])
    return b"".join(kept).decode("utf-8", "surrogatepass")


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, text_col: str = "text", block_words: int = 200_000) -> DataFrame:
    """``docs`` without the spans that test items cover; documents of which hits cover over ``max_coverage`` of the
    words go altogether. Columns stay as they are; clean rows are untouched."""

    names = [f"c{k}" for k in range(len(docs.columns))]  # so that no column of docs has the name of an added one
    plain, text = docs.toDF(*names), names[docs.columns.index(text_col)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame[text] = [_cut(t, s) for t, s in zip(frame[text], frame["_spans"])]
            yield frame[names]

    hits = find_contamination(plain, benchmark, window, block_words, text)
    covered = F.aggregate("_spans", F.lit(0), lambda n, s: n + s["b"] - s["a"])
    kept = hits.where(covered <= F.lit(max_coverage) * F.col("_words")).drop("_words", "_items")
    return kept.mapInPandas(run, _schema(plain)).toDF(*docs.columns)


def contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hits = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    covered = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return hits.select("doc_id", F.col("_words").cast("long").alias("n_words"), covered.alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("_items"), ","), 256).alias("items_sha256"), (covered > 0).alias("contaminated"))


