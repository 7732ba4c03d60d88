"""The trie of conversations' prefixes, by an external mergesort that knows longest common prefixes (LCP).

A turn is a unit of 20 bytes, 16 of the SHA-256 of role and text and 4 of the text's length, and a conversation is its
units in a row: texts are read once and go no further. Three steps, each a table in the shared folder:

1. ``sorted_runs``: each task sorts bounded runs of its conversations and writes them with the LCP, in turns, of each
   with the one before it.
2. ``merged``: ranges of (units, conv_id) go to tasks, so that neither a common first turn nor copies of one conversation
   make a range large. A task merges its slices of the runs by a loser tree; heads are compared from the
   LCP that both share with the last one out, so that shared turns are not read again. The merged stream drives a stack of
   open nodes: a node that the next conversation leaves is finished. What lies on the path of a task's first or last
   conversation may go on in other tasks: such *spine* nodes are written with their part of the sums.
3. ``seams``: the spines of all tasks, in order, go through one more such stack, which closes them. It reads two paths a
   task whatever the number of conversations, and the ids that end there in chunks of ``CHUNK`` bytes.

Memory: a run, a slice (both bounded in bytes), one conversation's units. Every step reads a written table or
the input, so a lost executor costs tasks, not steps.

Results in odd cases: turns go by number, null first; ties by role, then by the text's first 32 characters, then by digest;
repeated rows are turns of their own. Null role or text is empty. Rows without conv_id belong to no
conversation. Conversations of any length, and turns of any length, are whole. Equal conversations are members of one
node. Only the four named columns are read, so that no other can clash; an empty table gives no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from adjudica.llm.common import stored

UNIT = 20
RUN_BYTES = 16 << 20
SLICE_BYTES = 32 << 20
CHUNK = 1 << 14

RUN = "run long, pos long, lcp int, units binary, conv_id long"
_SUMS = "conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long"
MERGED = f"kind string, part int, slot int, chunk int, parent_slot int, parent_conv_id long, {_SUMS}, unit binary, ends binary"
_MERGED = [c.split()[0] for c in MERGED.split(", ")]
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_units(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, head, unit) of every turn; ``unit`` in hexadecimal, ``head`` for ties."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    unit = F.concat(digest, F.lpad(F.lower(F.hex(F.length(text).cast("long"))), 8, "0"))
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), F.left(text, F.lit(32)).alias("head"), unit.alias("unit"))
    return rows.where("conv_id IS NOT NULL")


def rebuilt(conversations: DataFrame, family: int = 100, kinds: int = 6, **columns: str) -> DataFrame:
    """(conv_id, units): the first h turns of conversation c - c % ``family``, then those of c after its first h, where h is
    the CRC-32 of decimal c modulo ``kinds``. One shuffle, of units, by the conversation that is begun with."""
    base = F.col("conv_id") - F.col("conv_id") % family
    turns = turn_units(conversations, **columns).withColumn("base", base).repartition("base")
    whole = turns.groupBy("base", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "head", "unit"))).getField("unit").alias("own"))
    first = F.first(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, kinds - 1)), ignorenulls=True).over(W.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % kinds).cast("int")
    taken = F.coalesce(F.slice("first", F.lit(1), h), F.array().cast("array<string>"))
    own = F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0)))
    return whole.withColumn("first", first).select("conv_id", F.unhex(F.array_join(F.concat(taken, own), "")).alias("units"))


def common_turns(a: bytes, b: bytes, start: int = 0) -> int:
    """Turns that ``a`` and ``b`` share, of which ``start`` are known."""
    end = min(len(a), len(b)) // UNIT
    if a[start * UNIT : end * UNIT] == b[start * UNIT : end * UNIT]:
        return end
    while a[start * UNIT : (start + 1) * UNIT] == b[start * UNIT : (start + 1) * UNIT]:
        start += 1
    return start


def _runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    task, rows, size, n = TaskContext.get().partitionId(), [], 0, 0

    def run() -> pd.DataFrame:
        rows.sort()
        lcps = [0, *(common_turns(a[0], b[0]) for a, b in zip(rows, rows[1:]))]
        return pd.DataFrame({"run": (task << 32) + n, "pos": range(len(rows)), "lcp": lcps, "units": [r[0] for r in rows], "conv_id": [r[1] for r in rows]})

    for frame in frames:
        for row in zip(frame.units, frame.conv_id.tolist()):
            rows.append(row)
            size += len(row[0]) + 100
            if size >= RUN_BYTES:
                yield run()
                rows, size, n = [], 0, n + 1
    if rows:
        yield run()


def sorted_runs(conversations: DataFrame) -> DataFrame:
    """Runs of (conv_id, units), written: ``RUN``."""
    return stored(conversations.mapInPandas(_runs, RUN), "trie-runs")


def merge(runs: list[list[tuple[bytes, int, int]]]) -> Iterator[tuple[bytes, int, int]]:
    """(units, conv_id, LCP with the one before) of all runs in order; a run's rows carry their LCPs likewise."""
    k = len(runs)
    at, lcp = [0] * k, [0] * k  # each run's head, and the turns that it shares with the last row out
    leaves = 1 << max(k - 1, 0).bit_length()

    def play(i: int, j: int) -> tuple[int, int]:
        """(winner, loser) of two runs' heads; the loser's LCP is then that with the winner."""
        if j < 0 or i < 0:
            return (i, j) if j < 0 else (j, i)
        if lcp[i] != lcp[j]:
            return (i, j) if lcp[i] > lcp[j] else (j, i)
        x, y = runs[i][at[i]], runs[j][at[j]]
        shared = common_turns(x[0], y[0], lcp[i])
        a, b = x[0][shared * UNIT : (shared + 1) * UNIT], y[0][shared * UNIT : (shared + 1) * UNIT]
        winner, loser = (i, j) if (a, x[1]) <= (b, y[1]) else (j, i)
        lcp[loser] = shared
        return winner, loser

    losers = [-1] * leaves

    def first(node: int) -> int:
        if node >= leaves:
            return node - leaves if node - leaves < k else -1
        best, losers[node] = play(first(2 * node), first(2 * node + 1))
        return best

    best = first(1) if k else -1
    while best >= 0:
        units, conv_id, _ = runs[best][at[best]]
        yield units, conv_id, lcp[best]
        at[best] += 1
        node, rival = (best + leaves) >> 1, best
        if at[best] < len(runs[best]):
            lcp[best] = runs[best][at[best]][2]
        else:
            rival = -1
        while node:
            rival, losers[node] = play(rival, losers[node])
            node >>= 1
        best = rival


class _Node:
    __slots__ = ("depth", "unit", "left", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends", "waiting", "names")

    def __init__(self, depth: int, unit: bytes, left: bool = False):
        self.depth, self.unit, self.left, self.conv_id = depth, unit, left, None
        self.n_convs = self.n_children = self.n_leaves = self.saved = 0
        self.ends, self.waiting, self.names = [], [], []

    def count(self, conv_id: int, n_convs: int, n_children: int, n_leaves: int, saved: int) -> None:
        self.conv_id = conv_id if self.conv_id is None else min(self.conv_id, conv_id)
        self.n_convs, self.n_children, self.n_leaves, self.saved = self.n_convs + n_convs, self.n_children + n_children, self.n_leaves + n_leaves, self.saved + saved

    def finish(self) -> None:
        self.n_leaves = self.n_leaves or 1
        if self.depth:
            self.saved += (self.n_convs - 1) * int.from_bytes(self.unit[16:], "big")

    def sums(self) -> tuple[int, int, int, int, int, int]:
        return self.conv_id or 0, self.depth, self.n_convs, self.n_children, self.n_leaves, self.saved

    def out(self, part: int | None, parent_slot: int | None, parent: int | None) -> tuple:
        return ("node", part, None, None, parent_slot, parent, *self.sums(), None, self.ends)


def _sha256(ids: list[int]) -> bytes:
    return hashlib.sha256(",".join(map(str, ids)).encode()).digest()


def _finished(rows: Iterable[tuple[bytes, int, int]], part: int) -> Iterator[tuple]:
    """``MERGED`` rows of one task's merged stream.

    A finished node waits in its parent for the parent's conv_id; one whose parent is on a spine goes out at once and names
    the parent's slot. The nodes of the first conversation's path, and those left open, are the spines.
    """
    stack, spine = [_Node(0, b"", True)], []

    def leave(depth: int) -> Iterator[tuple]:
        while len(stack) - 1 > depth:
            node = stack.pop()
            if node.left:
                spine.append(node)
                continue
            node.finish()
            node.ends = _sha256(node.ends)
            yield from (child.out(None, None, node.conv_id) for child in node.waiting)
            node.waiting = []
            parent = stack[-1]
            parent.count(node.conv_id, node.n_convs, 1, node.n_leaves, node.saved)
            if parent.left:
                yield node.out(part, parent.depth, None)
            else:
                parent.waiting.append(node)

    begun = False
    for units, conv_id, shared in rows:
        yield from leave(shared)
        for d in range(len(stack) - 1, len(units) // UNIT):
            stack.append(_Node(d + 1, units[d * UNIT : (d + 1) * UNIT], not begun))
        begun = True
        stack[-1].ends.append(conv_id)
        stack[-1].count(conv_id, 1, 0, 0, 0)
    if not begun:
        return
    lefts = len(spine) + sum(n.left for n in stack)
    right = [n for n in stack if not n.left]
    slots = {id(n): n.depth for n in (*spine, *stack) if n.left} | {id(n): lefts + k for k, n in enumerate(right)}
    for node in sorted((*spine, *stack), key=lambda n: slots[id(n)]):
        slot = slots[id(node)]
        yield from (child.out(part, slot, None) for child in node.waiting)
        ends = ",".join(map(str, node.ends)).encode()
        yield ("spine", part, slot, 0, None, None, *node.sums(), node.unit, ends[:CHUNK])
        yield from (("spine", part, slot, k // CHUNK, None, None, *[0] * 6, b"", ends[k : k + CHUNK]) for k in range(CHUNK, len(ends), CHUNK))


def _framed(rows: Iterable[tuple], of: int = 20_000) -> Iterator[pd.DataFrame]:
    held: list[tuple] = []

    def frame() -> pd.DataFrame:
        return pd.DataFrame({c: v if c in ("kind", "unit", "ends") else pd.array(v, "Int64") for c, v in zip(_MERGED, map(list, zip(*held)))})

    for row in rows:
        held.append(row)
        if len(held) == of:
            yield frame()
            held = []
    if held:
        yield frame()


def _merged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, runs = TaskContext.get().partitionId(), {}
    for frame in frames:
        for run, lcp, units, conv_id in zip(frame.run.tolist(), frame.lcp.tolist(), frame.units, frame.conv_id.tolist()):
            runs.setdefault(run, []).append((units, conv_id, lcp))
    slices = list(runs.values())
    yield from _framed(_finished(merge(slices), part))


def _seams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The nodes of all spines: a row each, and its conv_id under each name (part, slot) that it has."""

    def closed() -> Iterator[tuple]:
        stack: list[_Node] = []

        def leave(depth: int) -> Iterator[tuple]:
            while len(stack) - 1 > depth:
                node = stack.pop()
                node.finish()
                node.ends = node.ends.digest() if node.ends else _sha256([])
                yield from (child.out(None, None, node.conv_id) for child in node.waiting)
                yield from (("name", part, slot, *[None] * 3, node.conv_id, *[None] * 5, None, None) for part, slot in node.names)
                if stack:
                    stack[-1].count(node.conv_id, node.n_convs, 1, node.n_leaves, node.saved)
                    node.waiting, node.names = [], []
                    stack[-1].waiting.append(node)
                else:
                    yield node.out(None, None, None)

        for frame in frames:
            for row in frame.itertuples():
                if row.chunk == 0:
                    depth = int(row.depth)
                    if depth >= len(stack) or stack[depth].unit != row.unit:
                        yield from leave(depth - 1)
                        stack.append(_Node(depth, row.unit))
                    node = stack[depth]
                    node.names.append((int(row.part), int(row.slot)))
                    if row.n_convs:
                        node.count(int(row.conv_id), int(row.n_convs), int(row.n_children), int(row.n_leaves), int(row.saved_tokens))
                if row.ends:
                    if node.ends:
                        node.ends.update((b"," if row.chunk == 0 else b"") + row.ends)
                    else:
                        node.ends = hashlib.sha256(row.ends)
        yield from leave(-1)

    yield from _framed(closed())


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row a node of the trie of (conv_id, units): ``NODE``."""
    runs = sorted_runs(conversations)
    size = runs.agg(F.sum(F.octet_length("units") + 100)).first()[0] or 0
    n = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // SLICE_BYTES + 1)
    ranges = runs.repartitionByRange(n, "units", "conv_id").sortWithinPartitions("run", "pos")
    nodes = stored(ranges.mapInPandas(_merged, MERGED), "trie-nodes")
    spines = nodes.where("kind = 'spine'").select(*_MERGED[1:4], *_MERGED[6:]).repartition(1).sortWithinPartitions("part", "slot", "chunk")
    seams = stored(spines.mapInPandas(_seams, MERGED), "trie-seams")
    names = seams.where("kind = 'name'").select("part", F.col("slot").alias("parent_slot"), F.col("conv_id").alias("named"))
    waiting = nodes.where("kind = 'node' AND parent_slot IS NOT NULL").drop("parent_conv_id").join(names, ["part", "parent_slot"]).withColumnRenamed("named", "parent_conv_id")
    done = nodes.where("kind = 'node' AND parent_slot IS NULL").unionByName(seams.where("kind = 'node'"))
    hashed = F.lower(F.hex("ends")).alias("ends_sha256")
    return done.select(*NODE[:-1], hashed).unionByName(waiting.select(*NODE[:-1], hashed))


def contract(conversations: DataFrame) -> DataFrame:
    return prefix_trie(rebuilt(conversations))
