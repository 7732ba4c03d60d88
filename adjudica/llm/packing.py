"""Cost-balanced packing of documents into training sequences.

The cost of a piece of n tokens is estimated as ``n + quadratic * n * n`` (feed-forward plus
attention). Documents are taken in blocks of consecutive rows of a partition; a block's tokens fill its
sequences exactly: as many of ``capacity`` tokens as they make, and for what is left over sequences of
the powers of two that add up to it, so that nothing is padded. Inside a block, pieces go in
descending order to the lowest-cost sequence that still has room for them; a piece with room nowhere is
cut at the room of the emptiest sequence and its rest goes back among the others.

No shuffle: a block lives and dies in one task, which a lost executor's successor repeats from the
input. Memory is bounded by a block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from adjudica.llm.common import base_rows
from adjudica.llm.tokens import encoder

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def capacities(total: int, capacity: int) -> list[int]:
    """Sequence lengths that hold ``total`` tokens without padding."""
    left = total % capacity
    return [capacity] * (total // capacity) + [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]


def assign(lengths: list[int], capacity: int, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece of documents of the given lengths."""
    room = np.array(capacities(sum(lengths), capacity), np.int64)
    cost, fill = np.zeros(len(room)), np.zeros(len(room), np.int64)
    out: list[tuple[int, int, int, int, int]] = []
    waiting = [(-min(n - a, capacity), d, a) for d, n in enumerate(lengths) for a in range(0, n, capacity)]
    heapq.heapify(waiting)
    whole = 0  # sequences of full pieces: the first ones, each empty and so of the lowest cost
    while waiting:
        n, d, a = heapq.heappop(waiting)
        n = -n
        if n == capacity:
            s, whole = whole, whole + 1
        else:
            fits = np.flatnonzero(room >= n)
            if len(fits):
                s = int(fits[cost[fits].argmin()])
            else:
                most = np.flatnonzero(room == room.max())
                s = int(most[cost[most].argmin()])
                heapq.heappush(waiting, (-(n - int(room[s])), d, a + int(room[s])))
                n = int(room[s])
        out.append((d, a, n, s, int(fill[s])))
        room[s] -= n
        fill[s] += n
        cost[s] += n + quadratic * n * n
    return out


def _packed(path: str, end_id: int, capacity: int, quadratic: float, block_docs: int, block_tokens: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, task = encoder(path), TaskContext.get().partitionId()
        docs, ids, size, done = [], [], 0, 0

        def block() -> pd.DataFrame:
            lengths = [len(x) // 4 for x in ids]
            rows = [(docs[d], a, n, ids[d][4 * a : 4 * (a + n)], lengths[d], (task << 40) + done + s, at) for d, a, n, s, at in assign(lengths, capacity, quadratic)]
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])
            frame["doc_id"] = frame.doc_id.astype("Int64")
            return frame

        for frame in frames:
            for doc, text in zip(frame.doc_id.astype("Int64").tolist(), frame.text):
                docs.append(None if doc is pd.NA else doc)
                ids.append(enc.ids_bytes(text) + end)
                size += len(ids[-1]) // 4
                if len(docs) >= block_docs or size >= block_tokens:
                    yield block()
                    done += len(capacities(size, capacity))
                    size = 0
                    docs.clear()
                    ids.clear()
        if docs:
            yield block()
        enc.forget()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, quadratic: float = 1 / 1024, block_docs: int = 512, block_tokens: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset. Null text is empty (its end id alone); null and repeated doc_ids are packed row
    by row like any others; an empty table gives no row. Documents of any length are cut; those of equal length go in order of their rows; only
    the two named columns are read, so that no other can clash. ``capacity`` must be a power of two for sequences
    to need no padding. sequence_id is unique, not dense: the task's number and a count."""
    rows = base_rows(docs, id_col, text_col)
    return rows.mapInPandas(_packed(tokenizer, end_id, capacity, quadratic, block_docs, block_tokens), PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    """The contract's columns of packed pieces."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
