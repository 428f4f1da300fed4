"""The prefix trie of conversations, from sorted turn arrays.

A conversation is an array of turn digests. The arrays are range-sorted over all; each task goes through its
stretch once, compares each array with the one before it (longest common prefix, LCP) and keeps the
nodes of the current array on a stack: those deeper than the LCP are complete and leave it, adding their sums to their
parents. Nodes on the first or the last array of a task may go on in its neighbours; they are written as open
pieces, and one pass over the pieces (as many as tasks times the depth of their outer arrays)
stitches the stacks together. A parent's smallest member is known last, so children find it by one
join on the parent's piece, which is of their own task: a node with many children is many pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochron.llm.common import stored

#: Of ids to be hashed, bytes in a row of an open piece.
CHUNK = 1 << 20
_FIELDS = "kind string, task int, place int, part int, node bigint, parent bigint, depth bigint, turn binary, chars bigint, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends string"
_TYPES = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
_SCHEMA = pa.schema([(name, _TYPES[kind]) for name, kind in (f.split() for f in _FIELDS.split(", "))])
_AT = {name: k for k, name in enumerate(_SCHEMA.names)}


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (array of digest and chars) from conv_id, turn, role, text, in order of turn, nulls first.

    Null role or text is empty. The digest is the SHA-256 of role and text, the role's length before them; turns of one number are in
    order of their digests, and each counts. Rows without a conv_id belong to no conversation. A
    conversation's digests (some 50 bytes a turn) are one row.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat_ws(" ", F.octet_length(role), role, text), 256))
    small = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint"), F.struct("turn", digest.alias("digest"), F.char_length(text).alias("chars")).alias("t"))
    ordered = F.array_sort(F.collect_list("t"), lambda a, b: F.when(_before(a, b), -1).when(_before(b, a), 1).otherwise(0))
    return small.groupBy("conv_id").agg(ordered.alias("t")).select("conv_id", F.transform("t", lambda x: F.struct(x["digest"].alias("digest"), x["chars"].alias("chars"))).alias("turns"))


def _before(a, b):
    null_first = a["turn"].isNull() & b["turn"].isNotNull()
    return F.coalesce(null_first | (a["turn"] < b["turn"]) | (a["turn"].eqNullSafe(b["turn"]) & (a["digest"] < b["digest"])), F.lit(False))


def rebuilt(arrays: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """Conversations with a shared start: the first h turns of the first one of their block of ids (where it exists), then their own after the first h.

    h is the CRC-32 of the decimal id modulo ``most``; the remainder of a negative id is negative. Of a first conversation only the turns that may be taken move, to fewer than ``block`` others.
    """
    first = arrays.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("__base"), F.slice("turns", 1, most - 1).alias("__start"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    both = arrays.withColumn("__base", F.col("conv_id") - F.col("conv_id") % block).withColumn("__h", h).join(first, "__base", "left")
    start = F.slice(F.coalesce("__start", F.array().cast("array<struct<digest:binary,chars:int>>")), F.lit(1), F.col("__h"))
    own = F.slice("turns", F.col("__h") + 1, F.greatest(F.size("turns") - F.col("__h"), F.lit(0)))
    return both.select("conv_id", F.concat(start, own).alias("turns"))


class _Node:
    """A node on the stack, with the sums of what is complete below it."""

    __slots__ = ("chars", "children", "convs", "depth", "ends", "first", "id", "leaves", "low", "saved", "turn")

    def __init__(self, name: int, depth: int, turn: bytes | None, chars: int, first: bool) -> None:
        self.id, self.depth, self.turn, self.chars, self.first = name, depth, turn, chars, first
        self.low, self.convs, self.children, self.leaves, self.saved, self.ends = None, 0, 0, 0, 0, bytearray()

    def add(self, low: int | None, convs: int, children: int, leaves: int, saved: int) -> None:
        self.low = low if self.low is None else self.low if low is None else min(self.low, low)
        self.convs, self.children, self.leaves, self.saved = self.convs + convs, self.children + children, self.leaves + leaves, self.saved + saved

    def complete(self, parent: _Node | None) -> None:
        """All below it is known: its own share is added, and the whole to its parent."""
        self.leaves, self.saved = self.leaves if self.children else 1, self.saved + (self.convs - 1) * self.chars
        if parent:
            parent.add(self.low, self.convs, 1, self.leaves, self.saved)

    def row(self, kind: str, task: int, place: int, parent: int | None, ends: str, part: int = 0) -> tuple:
        sums = (self.convs, self.children, self.leaves, self.saved) if part == 0 else (0, 0, 0, 0)
        return (kind, task, place, part, self.id, parent, self.depth, self.turn, self.chars, self.low, *sums, ends)


def _batches(rows: Iterator[tuple], most: int = 4096) -> Iterator[pa.RecordBatch]:
    full: list[tuple] = []
    for row in rows:
        full.append(row)
        if len(full) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*full, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)
            full = []
    if full:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*full, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a stretch in order (conv_id, digests, chars) to complete nodes, and open pieces with their place in the stretch's outer arrays."""
    task = TaskContext.get().partitionId()

    def rows() -> Iterator[tuple]:
        stack: list[_Node] = []
        outer: list[_Node] = []  # nodes of the first array
        before: list[bytes] = []
        made = task << 33
        for batch in batches:
            digests, chars = batch.column(1), batch.column(2)
            starts = digests.offsets.to_pylist()
            flat, sizes = digests.values.to_pylist(), chars.values.to_pylist()
            base = chars.offsets[0].as_py() - starts[0]
            for k, conv in enumerate(batch.column(0).to_pylist()):
                turns = flat[starts[k] : starts[k + 1]]
                lcp, most = 0, min(len(turns), len(before))
                while lcp < most and turns[lcp] == before[lcp]:
                    lcp += 1
                opening = not stack
                while len(stack) > lcp + 1:
                    done = stack.pop()
                    if not done.first:
                        done.complete(stack[-1])
                        yield done.row("node", task, 0, stack[-1].id, hashlib.sha256(done.ends).hexdigest())
                for depth in range(len(stack), len(turns) + 1):
                    at = starts[k] + depth - 1
                    stack.append(_Node(made, depth, flat[at] if depth else None, sizes[base + at] if depth else 0, opening))
                    made += 1
                if opening:
                    outer = list(stack)
                top, before = stack[-1], turns
                top.add(conv, 1, 0, 0, 0)
                top.ends += b",%d" % conv if top.ends else b"%d" % conv
        for place, node in enumerate(outer + [x for x in stack if not x.first]):
            parts = [node.ends[lo : lo + CHUNK].decode() for lo in range(0, len(node.ends), CHUNK)] or [""]
            for part, ends in enumerate(parts):
                yield node.row("left" if node.first else "right", task, place, None, ends, part)

    return _batches(rows())


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open pieces of all tasks, in order of task, place and part, to complete nodes, and the smallest member of each piece's node."""

    def rows() -> Iterator[tuple]:
        stack: list[tuple[_Node, list[int], list]] = []  # node, its pieces, hash of its ends and whether it has any

        def close() -> Iterator[tuple]:
            node, pieces, ends = stack.pop()
            parent = stack[-1][0] if stack else None
            node.complete(parent)
            yield node.row("node", 0, 0, parent.id if parent else None, ends[0].hexdigest())
            for name in pieces:
                yield ("piece", 0, 0, 0, name, None, node.depth, None, 0, node.low, 0, 0, 0, 0, "")

        task, shared = None, True
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                get = lambda name, r=r: r[_AT[name]]
                depth = get("depth")
                if get("part") == 0:
                    if get("task") != task:
                        task, shared = get("task"), True  # its first array begins at the root
                    # a piece goes on with the open node of its depth if all turns up to it are the same, and that holds for its left pieces alone
                    shared = shared and get("kind") == "left" and depth < len(stack) and stack[depth][0].turn == get("turn")
                    if not shared:
                        while len(stack) > depth:
                            yield from close()
                        stack.append((_Node(get("node"), depth, get("turn"), get("chars"), False), [], [hashlib.sha256(), False]))
                    stack[depth][0].add(get("conv_id"), get("n_convs"), get("n_children"), get("n_leaves"), get("saved_tokens"))
                    stack[depth][1].append(get("node"))
                if get("ends"):
                    ends = stack[depth][2]
                    ends[0].update(b"," * (ends[1] and get("part") == 0) + get("ends").encode())
                    ends[1] = True
        while stack:
            yield from close()

    return _batches(rows())


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """Nodes of the trie of ``sequences`` (conv_id, unique; turns: array of digest, chars): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of first turns, from the root without any; its members start with it. conv_id: the smallest member; parent_conv_id: that of its
    parent (null at the root); n_children, and n_leaves (nodes without children at or below it); saved_tokens: over the nodes at or below it, (members - 1) times
    the characters of the last turn; ends_sha256: of the decimal ids, ascending, joined by commas, of the members that end there. Equal conversations of any
    number are neighbours in the sort and spread over tasks. Without sequences there is no node, not even the root.
    """
    flat = sequences.select("conv_id", F.transform("turns", lambda t: t["digest"]).alias("digests"), F.transform("turns", lambda t: t["chars"].cast("int")).alias("chars"))
    swept = stored(flat.orderBy("digests", "conv_id").mapInArrow(_sweep, _FIELDS))
    whole = swept.where("kind = 'node'")
    pieces = swept.where("kind <> 'node'").repartition(1).sortWithinPartitions("task", "place", "part")
    joined = stored(pieces.mapInArrow(_stitch, _FIELDS))
    nodes = whole.unionByName(joined.where("kind = 'node'"))
    members = whole.unionByName(joined.where("kind = 'piece'")).select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(members, "parent", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text; other columns are ignored)."""
    return prefix_trie(rebuilt(turn_arrays(conversations)))
