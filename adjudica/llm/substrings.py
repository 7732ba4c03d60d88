"""Exact substring dedup over a corpus: every byte inside a string of ``length`` bytes that also starts earlier goes.

A suffix array of the whole corpus has no place in one task, so the windows of ``length`` bytes are first dealt out
such that equal windows always meet:

1. In each window the k-mer of least hash is its *anchor*; equal windows have equal anchors at equal places.
   Neighbouring windows of one anchor are one *context*. Only hashes are shuffled, one row a context
   (about one for 35 bytes), and copies of a context inside a batch of documents are one row.
2. Contexts of an anchor that are equal as a whole are copies: all but the earliest are repeats. Anchors that
   have one context go. What is left are anchors with several different contexts.
3. Their earliest contexts are fetched as bytes and cut by the ``length - STEP + 1`` bytes that a few windows share,
   and the pieces that share those bytes meet in a task, which builds the Burrows-Wheeler transform of the
   pieces and expands its intervals breadth-first: from the intervals of common prefixes of n bytes, one
   backward step gives those of n + 1, so that boundaries between suffixes come by increasing common
   prefix. It stops at ``length``: suffixes that no boundary parts share ``length`` bytes, and all but the
   earliest window of such a class are repeats.

Anchors that a sample shows in a good part of all documents (a common phrase with ever different
surroundings) are dealt by the hash of each whole window instead, and so are, in step 3, those that turn out to
have over ``MANY`` contexts, so that what meets in a task stays bounded. That changes where rows meet, not what
is found.

A document is named by its doc_id and a hash of its text, so that rows that repeat a doc_id stay apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from adjudica.llm.common import base_rows, mix64, stored

K = 32
STEP = 17
SLICE = 1 << 18
CHUNK = 1 << 18
#: Contexts that a task merges at once.
AT_ONCE = 1 << 18
#: Contexts of an anchor beyond which they are compared by their windows' hashes.
MANY = 2048
NULL_ID = -(1 << 63)
NAME = ["doc", "tie"]
CONTEXTS = "h long, ctx long, doc long, tie int, s int, e int, done boolean"
PIECES = "key long, other long, doc long, tie int, s int, e int, done boolean, raw binary"
RUNS = "doc long, tie int, s int, e int"

_RNG = np.random.RandomState(100_003)
_T1 = _RNG.randint(0, 1 << 62, 256).astype(np.uint64) * np.uint64(4) + _RNG.randint(0, 4, 256).astype(np.uint64)
_T2 = _RNG.randint(0, 1 << 62, 256).astype(np.uint64) * np.uint64(4) + _RNG.randint(0, 4, 256).astype(np.uint64)
_B = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of _B and of its inverse modulo 2**64."""
    if len(_POWERS.get("b", ())) < n:
        size = max(n, SLICE + 4096)
        for name, base in (("b", _B), ("i", pow(_B, -1, 1 << 64))):
            out = np.ones(size, np.uint64)
            out[1:] = np.uint64(base)
            _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["b"], _POWERS["i"]


def _kmers(data: np.ndarray) -> np.ndarray:
    """Hashes of the K-byte strings at each place, by doubling."""
    h, size = _T1[data], 1
    while size < K:
        h = mix_pair(h[:-size], h[size:]) if size == K // 2 else h[:-size] * np.uint64(0xD1342543DE82EF95 + 2 * size) + h[size:]
        size *= 2
    return h


def mix_pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(a * np.uint64(0xA24BAED4963EE407) + b)


def contexts(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, context hash, first window, last window) of the contexts in ``data``, texts that end at ``ends``;
    windows across ends are none."""
    n = len(data) - length + 1
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    if n <= 0:
        return none
    order = _kmers(data)
    span = length - K + 1
    least, at, size = order, np.arange(len(order), dtype=np.int32), 1
    while size * 2 <= span:
        least, at = _less(least, at, size)
        size *= 2
    if size < span:
        least, at = _less(least, at, span - size)
    at = at[:n]
    good = np.ones(n, bool)
    begins = np.concatenate(([0], ends[:-1]))
    for a, b in zip(np.maximum(ends - length + 1, begins).tolist(), ends.tolist()):
        good[a:b] = False
    new = np.ones(n, bool)
    new[1:] = (at[1:] != at[:-1]) | (good[1:] != good[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    keep = good[first]
    first, last = first[keep], last[keep]
    if not len(first):
        return none
    power, inverse = _powers(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_T2[data] * power[: len(data)], dtype=np.uint64)))
    p = at[first].astype(np.int64)
    raw = (sums[last + length] - sums[first]) * inverse[first]
    shape = ((p - first).astype(np.uint64) << np.uint64(32)) | (last - first).astype(np.uint64)
    return order[p], mix64(raw ^ mix64(shape)), first, last


def _less(least: np.ndarray, at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    right = least[step:] < least[:-step]
    return np.minimum(least[:-step], least[step:]), np.where(right, at[step:], at[:-step])


def _windows(data: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window hash, other window hash, window) of every window of the given contexts."""
    sizes = last - first + 1
    t = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
    power, inverse = _powers(len(data) + 1)
    out = []
    for table in (_T1, _T2):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(table[data] * power[: len(data)], dtype=np.uint64)))
        out.append(mix64((sums[t + length] - sums[t]) * inverse[t]))
    return out[0], out[1], t


def _slices(frame: pd.DataFrame, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends, row of each text, its start in the row's text) of a batch; texts beyond SLICE come in parts that
    overlap by ``length - 1`` bytes, so that each window is in one part."""
    parts, ids, froms, size = [], [], [], 0

    def out():
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), np.array(ids, np.int64), np.array(froms, np.int64)

    for row, text in enumerate(frame.text):
        raw = text.encode("utf-8", "surrogatepass")
        for k in range(0, max(1, len(raw) - length + 1), SLICE):
            part = raw[k : k + SLICE + length - 1]
            if len(part) >= length:
                if size and size + len(part) > SLICE:
                    yield out()
                    parts, ids, froms, size = [], [], [], 0
                parts.append(part)
                ids.append(row)
                froms.append(k)
                size += len(part)
    if parts:
        yield out()


def _anchored(length: int, hot):
    def rows_of(frame: pd.DataFrame) -> Iterator[tuple[np.ndarray, ...]]:
        common = hot.value
        for data, ends, ids, froms in _slices(frame, length):
            h, ctx, first, last = contexts(data, ends, length)
            if len(common) and len(h):
                is_hot = np.isin(h, common)
                if is_hot.any():
                    a, b, t = _windows(data, first[is_hot], last[is_hot], length)
                    h, ctx = np.concatenate((h[~is_hot], a)), np.concatenate((ctx[~is_hot], b))
                    first, last = np.concatenate((first[~is_hot], t)), np.concatenate((last[~is_hot], t))
            text = np.searchsorted(ends, first, "right")
            shift = froms[text] - np.concatenate(([0], ends[:-1]))[text]
            yield h, ctx, ids[text], first + shift, last + shift

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found, size = [], 0
            doc, tie = frame.doc.to_numpy(), frame.tie.to_numpy()

            def merged() -> pd.DataFrame:
                h, ctx, row, s, e = (np.concatenate(x) for x in zip(*found))
                found.clear()
                return _one_of_each(h, ctx, doc[row], tie[row], s, e)

            for part in rows_of(frame):
                found.append(part)
                size += len(part[0])
                if size >= AT_ONCE:
                    yield merged()
                    size = 0
            if found:
                yield merged()

    return run


def _one_of_each(h, ctx, doc, tie, s, e) -> pd.DataFrame:
    """Rows for the shuffle: contexts that the batch has once or first; its later copies are repeats already, and go
    as merged runs of windows (done)."""
    key = mix64(h) ^ ctx
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    many = np.zeros(len(key), bool)
    many[order[1:][same]] = many[order[:-1][same]] = True
    late = np.zeros(len(key), bool)
    rows = np.flatnonzero(many)
    if len(rows):
        rows = rows[np.lexsort((s[rows], tie[rows], doc[rows], ctx[rows], h[rows]))]
        new = np.ones(len(rows), bool)
        new[1:] = (h[rows][1:] != h[rows][:-1]) | (ctx[rows][1:] != ctx[rows][:-1])
        head = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
        late[rows] = (doc[rows] != doc[head]) | (tie[rows] != tie[head]) | (s[rows] != s[head])
    keep = ~late
    out = pd.DataFrame({"h": h[keep].view(np.int64), "ctx": ctx[keep].view(np.int64), "doc": doc[keep], "tie": tie[keep], "s": s[keep].astype(np.int32), "e": e[keep].astype(np.int32), "done": False})
    if late.any():
        runs = merge_runs(doc[late], tie[late], s[late], e[late])
        spread = mix64(runs.doc.to_numpy().astype(np.uint64) ^ mix64(runs.s.to_numpy().astype(np.uint64)))
        out = pd.concat([out, runs.assign(h=spread.view(np.int64), ctx=np.int64(0), done=True)[out.columns]], ignore_index=True)
    return out


def merge_runs(doc: np.ndarray, tie: np.ndarray, s: np.ndarray, e: np.ndarray) -> pd.DataFrame:
    """(doc, tie, s, e): disjoint runs of windows [s, e] of each document that touch no other."""
    order = np.lexsort((s, tie, doc))
    doc, tie, s, e = doc[order], tie[order], s[order], e[order]
    own = np.ones(len(doc), bool)
    own[1:] = (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])
    reach = e.copy()
    begins = np.flatnonzero(own)
    for first, last in zip(begins.tolist(), [*begins[1:].tolist(), len(doc)]):
        reach[first:last] = np.maximum.accumulate(e[first:last])
    new = own.copy()
    new[1:] |= s[1:] > reach[:-1] + 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return pd.DataFrame({"doc": doc[first], "tie": tie[first], "s": s[first].astype(np.int32), "e": reach[last].astype(np.int32)})


def _bounds(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return first, np.append(first[1:], len(values))


def suffix_order(data: np.ndarray, length: int) -> np.ndarray:
    """Places of ``data`` (and its end) sorted by their next ``length`` bytes or more, by doubling ranks."""
    n = len(data) + 1
    padded = np.zeros(n + 8, np.uint64)
    padded[: n - 1] = data.astype(np.uint64) + np.uint64(1)
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | padded[k : k + n]
    have = 7
    while True:
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate(([0], ranked[1:] != ranked[:-1]))).astype(np.uint64)
        if have >= length or rank.max() == n - 1:
            return order
        after = np.zeros(n, np.uint64)
        after[: n - have] = rank[have:] + np.uint64(1)
        key = (rank << np.uint64(32)) | after
        have *= 2


def expand_intervals(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in suffix order, class of each): two suffixes are of one class where they share ``length`` bytes.

    Backward extension on the Burrows-Wheeler transform, breadth-first: an interval of all suffixes that begin
    with w gives, for each symbol c before them, the interval of cw. Where it ends, suffixes stop
    sharing |cw| bytes; the first interval that ends there tells their longest common prefix. Intervals
    whose end is known already go no further.
    """
    order = suffix_order(data, length)
    n = len(order)
    before = np.where(order > 0, data[order - 1].astype(np.int64) + 1, 0) if len(data) else np.zeros(1, np.int64)
    keys = np.sort(before * (n + 1) + np.arange(n))  # so that a search gives the symbols below c and those c above a row
    known = np.zeros(n + 1, bool)
    known[n] = True
    lb, rb = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for depth in range(length):
        sizes = rb - lb
        rows = np.repeat(lb - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        pair = np.unique(np.repeat(np.arange(len(lb)), sizes) * 257 + before[rows])
        which, symbol = pair // 257, pair % 257
        low = np.searchsorted(keys, symbol * (n + 1) + lb[which])
        high = np.searchsorted(keys, symbol * (n + 1) + rb[which])
        new = ~known[high]
        if depth:
            new &= symbol > 0  # nothing stands before the text's begin
        lb, rb = low[new], high[new]
        known[high] = True
        if not len(lb):
            break
    return order, np.cumsum(np.concatenate(([0], known[1:n])))


def _pieces(length: int):
    columns = [c.split()[0] for c in PIECES.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out, parts, whole = [], [], []
            for doc, tie, text, marks in zip(frame.doc.tolist(), frame.tie.tolist(), frame.text, frame.marks):
                raw = text.encode("utf-8", "surrogatepass")
                for m in marks:
                    p, first, last = m["p"], m["s"], min(m["e"], len(raw) - length)
                    if m["many"]:
                        if first <= last:
                            parts.append(raw[first : last + length])
                            whole.append((doc, tie, first))
                        continue
                    # cut by place relative to the anchor, so that equal windows are in equal cuts
                    anchor, t = raw[p : p + K], first
                    while t <= last:
                        cut = (p - t) // STEP  # windows p - t of one cut share the bytes from the last to the first's end
                        low = max(first, p - cut * STEP - STEP + 1)
                        high = min(last, p - cut * STEP)
                        top, bottom = p - cut * STEP, p - cut * STEP - STEP + 1
                        shared = raw[top : bottom + length]
                        key = int(np.frombuffer(_digest(anchor + shared + bytes([cut])), "<i8")[0])
                        out.append((key, 0, doc, tie, low, high, False, raw[low : high + length]))
                        t = high + 1
            if out:
                yield pd.DataFrame(out, columns=columns)
            if parts:
                yield _by_window(parts, whole, length)[columns]

    return run


def _by_window(parts: list[bytes], whole: list[tuple[int, int, int]], length: int) -> pd.DataFrame:
    """Rows of single windows of the contexts ``parts`` that begin at ``whole``, as ``_one_of_each`` gives them."""
    sizes = np.array([len(x) for x in parts])
    first = np.cumsum(sizes) - sizes
    a, b, t = _windows(np.frombuffer(b"".join(parts), np.uint8), first, first + sizes - length, length)
    row = np.searchsorted(first, t, "right") - 1
    doc, tie, s = (np.array(x) for x in zip(*whole))
    at = s[row] + t - first[row]
    return _one_of_each(a, b, doc[row], tie[row].astype(np.int32), at, at).rename(columns={"h": "key", "ctx": "other"}).assign(raw=None)


def _digest(raw: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_64_digest(raw)


def _repeats(length: int):
    def judge(docs: list[int], ties: list[int], starts: list[int], raws: list[bytes]) -> pd.DataFrame | None:
        data = np.frombuffer(b"".join(raws), np.uint8)
        sizes = np.array([len(r) for r in raws])
        ends = np.cumsum(sizes)
        order, label = expand_intervals(data, length)
        piece = np.searchsorted(ends, order, "right")
        inside = piece < len(raws)
        inside[inside] = (ends[piece[inside]] - order[inside]) >= length
        order, label, piece = order[inside], label[inside], piece[inside]
        doc, tie = np.array(docs, np.int64)[piece], np.array(ties, np.int32)[piece]
        s = np.array(starts, np.int64)[piece] + order - (ends - sizes)[piece]
        by = np.lexsort((s, tie, doc, label))
        doc, tie, s, label = doc[by], tie[by], s[by], label[by]
        first, last = _bounds(label)
        head = np.repeat(first, last - first)
        late = (doc != doc[head]) | (tie != tie[head]) | (s != s[head])
        return merge_runs(doc[late], tie[late], s[late], s[late]) if late.any() else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, docs, ties, starts, raws, size, head = None, [], [], [], [], [], 0, None

        def settle():
            nonlocal size
            if len(held) > 1:  # a piece alone has no partner
                for doc, tie, s, raw in held:
                    docs.append(doc)
                    ties.append(tie)
                    starts.append(s)
                    raws.append(raw)
                    size += len(raw)
            held.clear()

        for frame in frames:
            single = frame.raw.isna().to_numpy()
            if single.any():  # windows by hash, in order of their places: all but the first of each are repeats
                some = frame[single]
                k, o, doc, tie, s, e, done = (some[c].to_numpy() for c in ("key", "other", "doc", "tie", "s", "e", "done"))
                new = np.ones(len(k), bool)
                new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
                new |= done
                at = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
                first = np.stack([doc[at], tie[at], s[at]], 1)
                if head is not None and not done[0] and head[0] == (k[0], o[0]):  # goes on from the batch before
                    first[at == 0] = head[1]
                late = done | (first != np.stack([doc, tie, s], 1)).any(1)
                head = ((k[-1], o[-1]), first[-1]) if not done[-1] else None
                if late.any():
                    yield merge_runs(doc[late], tie[late], s[late].astype(np.int64), e[late].astype(np.int64))
                frame = frame[~single]
            for k, doc, tie, s, raw in zip(frame.key.tolist(), frame.doc.tolist(), frame.tie.tolist(), frame.s.tolist(), frame.raw):
                if k != key:
                    settle()
                    key = k
                    if size >= CHUNK:
                        if (found := judge(docs, ties, starts, raws)) is not None:
                            yield found
                        docs, ties, starts, raws, size = [], [], [], [], 0
                held.append((doc, tie, s, raw))
        settle()
        if raws and (found := judge(docs, ties, starts, raws)) is not None:
            yield found

    return run


def _removed(length: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, text, marks in zip(frame.doc_id.astype("Int64").tolist(), frame.text, frame.marks):
                raw = text.encode("utf-8", "surrogatepass")
                spans, at, kept = [], 0, []
                for s, e in sorted((m["s"], m["e"]) for m in marks) if marks is not None else ():
                    a, b = s, min(e + length, len(raw))
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(b, spans[-1][1])
                    elif a < b:
                        spans.append([a, b])
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                out.append((None if doc is pd.NA else doc, len(raw), [{"a": a, "b": b} for a, b in spans], b"".join(kept)))
            done = pd.DataFrame(out, columns=["doc_id", "n_bytes", "spans", "kept"])
            done["doc_id"] = done.doc_id.astype("Int64")
            yield done

    return run


def common_anchors(docs: DataFrame, length: int, sample_rows: int = 2000, share: float = 0.02, seed: int = 11) -> np.ndarray:
    """Anchors with different contexts in ``share`` of a sample's documents or more: at most a few thousand."""
    n = docs.count()
    sample = docs.sample(min(1.0, sample_rows / max(n, 1)), seed)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for data, ends, _, _ in _slices(frame, length):
                h, ctx, first, _ = contexts(data, ends, length)
                yield pd.DataFrame({"h": h.view(np.int64), "ctx": ctx.view(np.int64), "text": np.searchsorted(ends, first, "right")}).drop_duplicates(["h", "ctx"])[["h", "ctx"]]

    found = sample.mapInPandas(run, "h long, ctx long").groupBy("h").agg(F.count_distinct("ctx").alias("n")).where(F.col("n") >= max(8, share * min(n, sample_rows)))
    return np.sort(np.array([r.h for r in found.select("h").collect()], np.int64).view(np.uint64))


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept): ``spans`` are the maximal runs of removed bytes [a, b), ``kept`` the bytes left.

    Texts are UTF-8 bytes (null: none); earlier means a smaller doc_id (null smallest), or the same document and
    an earlier start; overlaps count, and strings are judged on the input. Rows that repeat a doc_id with different
    texts are documents in order of a hash of their texts; rows that repeat a doc_id and its text are one document, and each
    of them loses what it loses. Texts shorter than ``length`` are kept whole, and longer ones are judged whole; only the two named columns are
    read, so that no other can clash; an empty table gives no row.
    """
    spark = docs.sparkSession
    rows = base_rows(docs, id_col, text_col)
    named = rows.select("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), F.hash("text").alias("tie"), "text")
    keyed = named.drop("doc_id")
    hot = spark.sparkContext.broadcast(common_anchors(keyed, length))
    found = keyed.mapInPandas(_anchored(length, hot), CONTEXTS)
    anchor, context = W.partitionBy("h", "done"), W.partitionBy("h", "done", "ctx").orderBy("doc", "tie", "s")
    found = found.withColumns({"rank": F.rank().over(context), "low": F.min("ctx").over(anchor), "high": F.max("ctx").over(anchor), "many": F.count(F.lit(1)).over(anchor) > MANY})
    found = found.withColumn("late", F.col("done") | (F.col("rank") > 1))
    marks = stored(found.where(F.col("late") | (F.col("low") != F.col("high"))).select(*NAME, "s", "e", "late", "many"), "substring-marks")
    # the anchor itself is found again from the first window of a context
    open_ = marks.where("NOT late").groupBy(*NAME).agg(F.collect_set(F.struct("s", "e", "many")).alias("marks"))
    texts = keyed.join(open_, NAME).mapInPandas(_with_anchors(length), "doc long, tie int, text string, marks array<struct<p:int,s:int,e:int,many:boolean>>")
    pieces = texts.mapInPandas(_pieces(length), PIECES)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartition(parts, "key").sortWithinPartitions("key", "other", *NAME, "s")
    partial = stored(dealt.mapInPandas(_repeats(length), RUNS), "substring-repeats")
    spans = marks.where("late").select(*NAME, "s", "e").unionByName(partial).groupBy(*NAME).agg(F.collect_list(F.struct("s", "e")).alias("marks"))
    joined = named.join(spans, NAME, "left").select("doc_id", "text", "marks")
    return joined.mapInPandas(_removed(length), "doc_id long, n_bytes long, spans array<struct<a:int,b:int>>, kept binary")


def _with_anchors(length: int):
    """Gives each context its anchor's place: the leftmost k-mer of least hash in its first window."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text, marks in zip(frame.text, frame.marks):
                raw = text.encode("utf-8", "surrogatepass")
                first = [m for m in marks if m["s"] + length <= len(raw)]
                if first:
                    data = np.frombuffer(b"".join(raw[m["s"] : m["s"] + length] for m in first), np.uint8)
                    order = _kmers(data)
                    span = length - K + 1
                    grid = np.lib.stride_tricks.sliding_window_view(order, span)[::length]
                    out.append([{"p": m["s"] + int(k), "s": m["s"], "e": m["e"], "many": m["many"]} for m, k in zip(first, grid.argmin(1))])
                else:
                    out.append([])
            frame["marks"] = out
            yield frame[["doc", "tie", "text", "marks"]]

    return run


def contract(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; see ``remove_repeats`` for odd rows."""
    done = remove_repeats(docs.select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
