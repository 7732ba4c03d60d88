"""Token-ID output: whole texts encoded, written as Simple-8b words, read back.

File format: Parquet rows, one per *segment* of consecutive documents of a shard. A segment holds
``doc_ids`` and ``lengths`` (ids of each document, end id included), ``first`` (ids of the shard before
it), ``words`` (little-endian 64-bit Simple-8b words), ``block_words`` (the word at which each block of
``BLOCK`` ids begins, for decoding from any block) and ``escapes`` (ids that need over 60 bits).

A word's top four bits are a selector: counts ``COUNTS[s]`` of ids of ``60 // COUNTS[s]`` bits each, lowest
bits first; selector 14 is an escape, whose low 60 bits name a slot of ``escapes``. Blocks never share a
word, and every word tells how many ids it holds, so that decoding is array work.

Shards are ranges of ascending doc_id (null first; repeated ids by text), dealt out by Spark with one
shuffle; a shard is written by one task, and Spark's committer drops what a lost executor left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from adjudica.llm.common import base_rows
from adjudica.llm.tokens import encoder

#: Ids per 60 payload bits, by selector; fixed values of the format.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
ESCAPE = 14
BLOCK = 1024
SEGMENT_IDS = 1 << 18
SHARD_BYTES = 128 << 20
#: Text of a table takes about so many times the bytes of its files. A plan that knows no size says one above UNKNOWN.
UNPACKED, UNKNOWN = 2, 1 << 50

SEGMENT = "shard int, seq int, first long, n_ids long, doc_ids array<long>, lengths array<int>, block_words array<int>, words binary, escapes binary"
DECODED = "doc_id long, start long, n_tokens long, ids binary"


def encode_words(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block, escapes) of unsigned ids."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    bits = np.maximum(np.frexp(ids.astype(float))[1], 1).astype(np.uint8)  # bit lengths; a double holds those of 53 bits exactly
    big = np.zeros(0, np.int64)
    if n and int(ids.max()) >> 53:
        high = ids >> np.uint64(32)
        bits = np.where(high > 0, 32 + np.frexp(high.astype(float))[1], bits).astype(np.uint8)
        big = np.flatnonzero(bits > 60)
    # the highest count that fits at each place: runs of ids of few bits, which no block's end cuts
    left = BLOCK - (np.arange(n) & (BLOCK - 1))
    left[n - n % BLOCK :] = np.arange(n % BLOCK, 0, -1)
    take, selector = np.ones(n, np.uint8), np.full(n, 13, np.uint8)
    for s in range(len(COUNTS) - 2, -1, -1):
        count = int(COUNTS[s])
        narrow = bits <= 60 // count
        if count <= 8 and n >= count:
            fits = narrow[: n - count + 1].copy()
            for j in range(1, count):
                fits &= narrow[j : n - count + 1 + j]
            fits &= left[: n - count + 1] >= count
            np.putmask(take[: n - count + 1], fits, count)
            np.putmask(selector[: n - count + 1], fits, s)
        elif count > 8 and len(few := np.flatnonzero(narrow)) >= count:
            begin = few[: len(few) - count + 1]
            begin = begin[few[count - 1 :] - begin == count - 1]
            begin = begin[left[begin] >= count]
            take[begin], selector[begin] = count, s
    selector[big] = ESCAPE
    # words begin where the one before ends; blocks go side by side
    at, ends = np.arange(0, n, BLOCK), np.minimum(np.arange(0, n, BLOCK) + BLOCK, n)
    begins = np.zeros(n, bool)
    while len(at):
        begins[at] = True
        at = at + take[at]
        more = at < ends
        at, ends = at[more], ends[more]
    at = np.flatnonzero(begins)
    chosen_s = selector[at]
    words = chosen_s.astype(np.uint64) << np.uint64(60)
    for s, count in enumerate(COUNTS.tolist()):
        rows = np.flatnonzero(chosen_s == s)
        for j in range(count if len(rows) else 0):
            words[rows] |= ids[at[rows] + j] << np.uint64(j * (60 // count))
    rows = np.flatnonzero(chosen_s == ESCAPE)
    words[rows] |= np.arange(len(rows)).astype(np.uint64)
    return words, np.searchsorted(at, np.arange(0, n, BLOCK)), ids[at[rows]]


def decode_words(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ids of any run of words (of whole blocks, say), without a loop over words."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    held = np.append(COUNTS, 1)[selector]
    begin = np.cumsum(held) - held
    out = np.empty(int(held.sum()), np.uint64)
    for s, count in enumerate(COUNTS.tolist()):
        rows = np.flatnonzero(selector == s)
        if len(rows):
            width, mask = 60 // count, np.uint64((1 << (60 // count)) - 1)
            for j in range(count):
                out[begin[rows] + j] = (words[rows] >> np.uint64(j * width)) & mask
    rows = np.flatnonzero(selector == ESCAPE)
    out[begin[rows]] = escapes[(words[rows] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out


def _segments(path: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, shard, first, seq = encoder(path), TaskContext.get().partitionId(), 0, 0
        docs, parts, size = [], [], 0

        def segment() -> pd.DataFrame:
            words, blocks, escapes = encode_words(np.frombuffer(b"".join(parts), "<u4"))
            row = (shard, seq, first, size, docs.copy(), [len(p) // 4 for p in parts], blocks.tolist(), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes())
            return pd.DataFrame([row], columns=[c.split()[0] for c in SEGMENT.split(", ")])

        for frame in frames:
            for doc, text in zip(frame.doc_id.astype("Int64").tolist(), frame.text):
                docs.append(None if doc is pd.NA else doc)
                parts.append(enc.ids_bytes(text) + end)
                size += len(parts[-1]) // 4
                if size >= SEGMENT_IDS:
                    yield segment()
                    first, seq, size = first + size, seq + 1, 0
                    docs.clear()
                    parts.clear()
        if docs:
            yield segment()

    return run


def _text_bytes(docs: DataFrame, rows: DataFrame) -> int:
    """About the bytes of all texts: by the sizes of the files that the plan reads, or counted where it reads none."""
    planned = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return UNPACKED * planned if planned < UNKNOWN else rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text (null: empty), appends ``end_id``, and writes the shards under ``path``.

    Shards are of about ``SHARD_BYTES`` of text at most, and at least as many as a shuffle's partitions.
    Rows that repeat a doc_id are written as documents of their own, in order of their texts; a null
    doc_id sorts first; an empty table gives a readable empty file. Texts of any length are whole, in one segment; only the two named
    columns are read, so that no other can clash.
    """
    spark, rows = docs.sparkSession, base_rows(docs, id_col, text_col)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), _text_bytes(docs, rows) // SHARD_BYTES)
    dealt = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInPandas(_segments(tokenizer, end_id), SEGMENT).write.parquet(path)


def _decoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for row in frame.itertuples():
            ids = decode_words(np.frombuffer(row.words, "<u8"), np.frombuffer(row.escapes, "<u8")).astype("<u4")
            lengths = np.asarray(row.lengths, np.int64)
            ends = np.cumsum(lengths)
            raw = ids.tobytes()
            yield pd.DataFrame({
                "doc_id": pd.array(list(row.doc_ids), "Int64"), "start": row.first + ends - lengths,
                "n_tokens": lengths, "ids": [raw[4 * (b - a) : 4 * b] for a, b in zip(lengths, ends)],
            })


def _with_before(files: DataFrame) -> DataFrame:
    """``files`` with ``before``: the ids of all shards before. Only the shards' totals, one row each, meet in one task."""
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = totals.select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return files.join(F.broadcast(before), "shard")  # one small row per written shard


def read_token_range(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """(start, ids) of the ids at places [start, stop) of the whole stream, one row a segment that holds some: only the blocks that
    hold them are decoded."""
    files = _with_before(spark.read.schema(SEGMENT).parquet(path)).withColumn("at", F.col("before") + F.col("first"))
    some = files.where((F.col("at") < stop) & (F.col("at") + F.col("n_ids") > start)).select("at", "n_ids", "block_words", "words", "escapes")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples():
                a, b = max(0, start - row.at), min(row.n_ids, stop - row.at)
                first, last = a // BLOCK, -(-b // BLOCK)
                words = np.frombuffer(row.words, "<u8")
                part = words[row.block_words[first] : row.block_words[last] if last < len(row.block_words) else None]
                ids = decode_words(part, np.frombuffer(row.escapes, "<u8"))[a - first * BLOCK : b - first * BLOCK]
                out.append((row.at + a, ids.astype("<u4").tobytes()))
            yield pd.DataFrame(out, columns=["start", "ids"])

    return some.mapInPandas(run, "start long, ids binary")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): start counts the ids of all documents before, ids are little-endian
    unsigned 32-bit."""
    files = _with_before(spark.read.schema(SEGMENT).parquet(path))
    decoded = files.select((F.col("before") + F.col("first")).alias("first"), "doc_ids", "lengths", "words", "escapes").mapInPandas(_decoded, DECODED)
    return decoded.select("doc_id", "start", "n_tokens", "ids")
