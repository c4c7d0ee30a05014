"""Exact dedup by Patricia-trie owners.

Rows are dealt by (length, content hash) to owner tasks, as many as the texts' bytes need. An owner inserts the full
byte strings into one compressed radix trie, whose terminal nodes store the number of rows and the smallest and
largest identifier seen. When the trie holds more than its budget, its heaviest subtrees go to files of the task,
as often as that happens: a spilled edge stays in the trie as a stub, and what reaches the stub later is appended to
its file. Files are worked off one after the other, by the same kind of trie, once the input has ended. Before the
shuffle each scan task runs such a trie over its own rows, so a group of copies reaches its owner as one row for each
flush of a scan task, however large the group is. Its rows then meet that owner by broadcast, if they are a large share
of all. Files are the task's own: a task that is lost is run again.

Defined results: null texts equal empty ones; a null id counts as smaller than all others; rows that repeat, ids
included, count as rows of one group, and of those that have the group's id one alone is a row of kept_rows(); an
empty table gives an empty result; any number of extra columns is ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import shutil
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import HOT_SHARE, fresh, ident, numbered, restored, texts, width_of, written

LOCAL_BYTES = 48 << 20
OWNER_BYTES = 96 << 20
#: Estimated text bytes of an owner; a trie spills, so this bounds files rather than memory.
PARTITION_BYTES = 512 << 20
#: Bytes that a node, an edge and a terminal take beside the label.
NODE_BYTES = 300
BUFFER_BYTES = 64 << 10


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by halving with slice comparisons."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    low, high = 0, most
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Terminal:
    """What a trie knows of one distinct byte string; identifiers are (id, row) pairs."""

    __slots__ = ("count", "high", "low")

    def __init__(self):
        self.count, self.low, self.high = 0, None, None

    def add(self, low: tuple, high: tuple, count: int) -> None:
        self.count += count
        self.low = low if self.low is None else min(self.low, low)
        self.high = high if self.high is None else max(self.high, high)


class Node:
    __slots__ = ("edges", "terminal")

    def __init__(self):
        #: first byte -> (label, Node or Stub)
        self.edges: dict = {}
        self.terminal: Terminal | None = None


class Stub:
    """A subtree that lies in a file: rests of keys below the edge, with their identifiers and counts."""

    def __init__(self, path: str):
        self.path, self.waiting, self.held = path, [], 0

    def add(self, rest: bytes, low: tuple, high: tuple, count: int) -> None:
        self.waiting.append((rest, low, high, count))
        self.held += len(rest) + 100
        if self.held >= BUFFER_BYTES:
            self.flush()

    def flush(self) -> None:
        with open(self.path, "ab") as f:
            for row in self.waiting:
                pickle.dump(row, f)
        self.waiting, self.held = [], 0

    def rows(self) -> Iterator[tuple]:
        self.flush()
        with open(self.path, "rb") as f:
            while True:
                try:
                    yield pickle.load(f)
                except EOFError:
                    break
        os.unlink(self.path)


class PatriciaTrie:
    """Compressed radix trie over byte strings under a byte budget, with spill by subtree."""

    def __init__(self, budget: int = 1 << 62, folder: str | None = None):
        self.budget, self.folder = budget, folder
        self.root, self.size, self.held, self.spills = Node(), 0, 0, 0

    def insert(self, key: bytes, low: tuple, high: tuple, count: int = 1) -> None:
        node, at = self.root, 0
        while at < len(key):
            edge = node.edges.get(key[at])
            if edge is None:
                leaf = Node()
                node.edges[key[at]] = (key[at:], leaf)
                self.held += len(key) - at + NODE_BYTES
                node, at = leaf, len(key)
                break
            label, child = edge
            if key.startswith(label, at):
                at += len(label)
                if isinstance(child, Stub):
                    child.add(key[at:], low, high, count)
                    return
                node = child
                continue
            k = common_prefix(label, key[at : at + len(label)])
            middle = Node()
            middle.edges[label[k]] = (label[k:], child)
            node.edges[label[0]] = (label[:k], middle)
            self.held += NODE_BYTES
            node, at = middle, at + k
        if node.terminal is None:
            node.terminal = Terminal()
            self.size += 1
        node.terminal.add(low, high, count)
        if self.held > self.budget:
            self.spill()

    def _weights(self) -> dict[int, int]:
        """Bytes of the subtree below each node, by id()."""
        order, stack = [], [self.root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(c for _, c in node.edges.values() if isinstance(c, Node))
        out: dict[int, int] = {}
        for node in reversed(order):
            out[id(node)] = sum(len(label) + NODE_BYTES + out.get(id(c), 0) for label, c in node.edges.values() if isinstance(c, Node))
        return out

    def spill(self) -> None:
        """Send subtrees to files, the heaviest first, until half of the budget is free. A subtree heavier than that is entered rather than sent whole."""
        weights = self._weights()
        self.held = weights[id(self.root)]
        places = [(self.root, first) for first in self.root.edges]
        while self.held > self.budget // 2 and places:
            places = [(n, f) for n, f in places if isinstance(n.edges[f][1], Node)]
            if not places:
                break
            node, first = max(places, key=lambda x: weights[id(x[0].edges[x[1]][1])] + len(x[0].edges[x[1]][0]))
            places.remove((node, first))
            label, child = node.edges[first]
            if weights[id(child)] > self.budget // 2:
                places += [(child, f) for f in child.edges]
                continue
            self._send(node, first)
            self.held -= weights[id(child)] + len(label) + NODE_BYTES

    def _send(self, node: Node, first: int) -> None:
        label, child = node.edges[first]
        self.folder = self.folder or tempfile.mkdtemp(prefix="trie-")
        self.spills += 1
        stub = Stub(os.path.join(self.folder, f"{id(self)}-{self.spills}"))
        # The edge keeps one byte of its label, since a leaf's label is most of what it holds.
        head = label[1:]
        for rest, t in _below(child):
            if isinstance(t, Stub):
                for tail, low, high, count in t.rows():
                    stub.add(head + rest + tail, low, high, count)
            else:
                self.size -= 1
                stub.add(head + rest, t.low, t.high, t.count)
        stub.flush()
        node.edges[first] = (label[:1], stub)

    def items(self) -> Iterator[tuple[bytes, Terminal]]:
        """All distinct strings, each once; spilled subtrees are worked off one at a time, by tries that may spill again."""
        stubs = []
        for key, t in _below(self.root):
            if isinstance(t, Stub):
                stubs.append((key, t))
            else:
                yield key, t
        self.root, self.held, self.size = Node(), 0, 0
        for head, stub in stubs:
            below = PatriciaTrie(self.budget, self.folder)
            for rest, low, high, count in stub.rows():
                below.insert(rest, low, high, count)
            for rest, t in below.items():
                yield head + rest, t

    def close(self) -> None:
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)


def _below(root: Node) -> Iterator[tuple[bytes, Terminal | Stub]]:
    """(string, terminal) of a subtree, and (string, stub) of what was spilled from it."""
    stack = [(b"", root)]
    while stack:
        head, node = stack.pop()
        if isinstance(node, Stub):
            yield head, node
            continue
        if node.terminal is not None:
            yield head, node.terminal
        stack.extend((head + label, child) for label, child in node.edges.values())


REPS = "text binary, low bigint, low_row bigint, high bigint, high_row bigint, n bigint"
GROUPS = "length bigint, sha binary, low bigint, low_row bigint, high bigint, high_row bigint, n bigint"
_IDS = [(c, pa.int64()) for c in ("low", "low_row", "high", "high_row", "n")]


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + sum(len(x) for x in row if isinstance(x, bytes))
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each distinct text of a stretch of the scan: the trie is handed on whenever it is full."""

    def handed(trie: PatriciaTrie):
        for text, t in trie.items():
            yield text, *t.low, *t.high, t.count

    def rows():
        trie = PatriciaTrie()
        for batch in batches:
            for ident_, row, text in zip(*(c.to_pylist() for c in batch.columns)):
                trie.insert(text, (ident_, row), (ident_, row))
                if trie.held > LOCAL_BYTES:
                    yield from handed(trie)
                    trie = PatriciaTrie()
        yield from handed(trie)

    return _batches(rows(), pa.schema([("text", pa.binary()), *_IDS]))


def _own(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            trie = PatriciaTrie(budget)
            try:
                for batch in batches:
                    for text, low, low_row, high, high_row, n in zip(*(c.to_pylist() for c in batch.columns)):
                        trie.insert(text, (low, low_row), (high, high_row), n)
                for text, t in trie.items():
                    yield len(text), hashlib.sha256(text).digest(), *t.low, *t.high, t.count
            finally:
                trie.close()

        return _batches(rows(), pa.schema([("length", pa.int64()), ("sha", pa.binary()), *_IDS]))

    return run


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", partitions: int | None = None, row: str | None = None, budget: int = OWNER_BYTES) -> DataFrame:
    """One row for each distinct text: length, sha (SHA-256), low and high (smallest and largest id) with the rows low_row and high_row that have them, n (rows). row: column of row numbers; without one they are 0."""
    t = df.select(ident(key).alias("id"), (F.col(row) if row else F.lit(0).cast("bigint")).alias("row"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    dealt = t.mapInArrow(_local, REPS).repartition(partitions or width_of(df, PARTITION_BYTES), F.octet_length("text"), F.xxhash64("text"))
    return dealt.mapInArrow(_own(budget), GROUPS)


def exact_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """Per row of df: key, keep_id (the id of its group that stays), group_size, kept, text_sha256.

    keep: "smallest" or "largest" id. Rows that share text and id are all marked kept, for they have the id that stays;
    kept_rows() returns one of them.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep}")
    found = groups(df, key, text).select("length", "sha", F.col("low" if keep == "smallest" else "high").alias("keep_id"), F.col("n").alias("group_size"))
    owner = written(found, "owners")
    total = owner.agg(F.sum("group_size")).first()[0] or 0
    least = max(2, int(total * HOT_SHARE) + 1)
    # Fewer than 1 / HOT_SHARE groups are as large. Their rows meet their owner by broadcast and go on under a number of
    # their own, which is no SHA-256, so that no task gets all rows of a group; the texts are read once for both ways.
    hot = owner.filter(F.col("group_size") >= least).select("length", "sha", F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_size"))
    cold = owner.filter(F.col("group_size") < least).select("length", F.col("sha").alias("at"), "keep_id", "group_size")
    rows = texts(df, key, text).select(F.col(key).alias("id"), F.octet_length("text").cast("bigint").alias("length"), F.unhex(F.sha2("text", 256)).alias("sha"))
    rows = rows.withColumn("number", F.monotonically_increasing_id()).join(F.broadcast(hot), ["length", "sha"], "left")
    at = F.when(F.col("hot_size").isNull(), F.col("sha")).otherwise(F.col("number").cast("string").cast("binary"))
    met = rows.withColumn("at", at).join(cold.hint("merge"), ["length", "at"], "left")
    best, size = F.coalesce("hot_id", "keep_id"), F.coalesce("hot_size", "group_size")
    out = met.select(F.col("id").alias(key), best.alias("keep_id"), size.alias("group_size"), (F.col("id") == best).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    out = restored(out, key, "keep_id")
    out.spent = [owner]
    return out


def kept_rows(df: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """One row of df for each distinct text, all columns as they were."""
    row = fresh(df, "_row")
    rows = numbered(df, "exact-rows", row)
    stays = "low_row" if keep == "smallest" else "high_row"
    owner = groups(rows, key, text, row=row).select(F.col(stays).alias(row))
    out = rows.join(owner, row, "left_semi").select(*df.columns)
    out.spent = [rows]
    return out
