"""Suffix-array dedup: remove every byte that a repeated string of `length` bytes covers.

Strings are judged on the input; they never cross documents, and repeats in the same document and overlapping ones
count. The whole corpus is never in one suffix array. Of the windows of `length` bytes each has an anchor, the
leftmost of its ANCHOR-byte strings with the smallest hash, so equal windows have equal anchors. Neighbouring
windows with the same anchor form a piece. Anchors that occur once in the corpus are settled: their windows are
unique. Pieces of the others go to shards by the anchor's hash, each distinct piece of a chunk once, and a shard
decides: a piece that occurs twice repeats in all its windows. The pieces of anchors that keep several distinct
contexts are suffix-sorted by external induction (induced_sort.py): a window repeats if the common prefix that the
sort carries from it to another window is of `length` or more. Windows whose hash no other window of the shard has
are left out of the sort at the ends of a piece, for no other window can equal them. Shards are as many as their bytes
need, and a sort takes about SORT_BYTES of whole anchors, its queues lying on disk.

Defined results: null texts are empty; texts shorter than `length` stay whole; repeated rows are repeats of each
other; an empty table gives an empty result; extra columns are ignored. What is left of a text may cut a UTF-8
sequence, so it is returned as binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .induced_sort import suffix_runs
from .shared import discard, ident, mixed, packed, powers, prefix_hash, restored, steps, unpacked, utf8, written

LENGTH = 200
ANCHOR = 64
CHUNK_BYTES = 6 << 20
SHARD_BYTES = 24 << 20
SHARD_ANCHORS = 1_000_000
#: Bytes that are suffix-sorted at once; a larger group of one anchor is sorted alone.
SORT_BYTES = 8 << 20
PLACE_BITS = 24

CHUNK = "chunk bigint, ids binary, sizes binary, data binary, bytes bigint"
_CHUNK = pa.schema([("chunk", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary()), ("bytes", pa.int64())])


class Pieces:
    """Pieces of some texts: begin and end in the bytes, windows (their number), and the anchor's hash."""

    def __init__(self, begin, end, windows, anchor):
        self.begin, self.end, self.windows, self.anchor = begin, end, windows, anchor


def pieces_of(data: np.ndarray, offsets: np.ndarray, length: int, sums: np.ndarray | None = None) -> Pieces:
    """offsets start at 0; sums: prefix_hash(data)."""
    n = len(data)
    k, span = ANCHOR, length - ANCHOR + 1
    if n < length:
        z = np.zeros(0, dtype=np.int64)
        return Pieces(z, z, z, z.astype(np.uint64))
    sums = prefix_hash(data) if sums is None else sums
    h = mixed((sums[k:] - sums[:-k]) * powers(n + 1)[1][: n - k + 1])
    bits = np.uint64(max(PLACE_BITS, n.bit_length()))
    low = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    width, best = 1, low
    while width * 2 <= span:
        best = np.minimum(best[: len(best) - width], best[width:])
        width *= 2
    best = np.minimum(best[: len(low) - span + 1], best[span - width : span - width + len(low) - span + 1]) if span > width else best
    place = (best & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    # Windows that cross the end of a text are none.
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    good = text[: len(place)] == text[length - 1 : length - 1 + len(place)]
    starts = np.flatnonzero(good)
    if not len(starts):
        z = np.zeros(0, dtype=np.int64)
        return Pieces(z, z, z, z.astype(np.uint64))
    place = place[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, len(starts)))
    begin = starts[first]
    # Smallest hashes are small numbers; mixed again they fill the range that shards divide.
    return Pieces(begin, begin + windows + length - 1, windows, mixed(h[place[first]] + np.uint64(0x9E3779B97F4A7C15)))


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made, parts, held = 0, [], 0

    def flush() -> pa.RecordBatch:
        ids, sizes, data = (np.concatenate(x) for x in zip(*parts))
        row = [(TaskContext.get().partitionId() << 24) + made, packed(ids), packed(sizes), packed(data), len(data)]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _CHUNK.types)], schema=_CHUNK)

    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for a, b in steps(offsets):
            parts.append((batch.column(0).slice(a, b - a).to_numpy(), np.diff(offsets[a : b + 1]), data[offsets[a] : offsets[b]]))
            held += int(offsets[b] - offsets[a]) + 100 * (b - a)
            if held >= CHUNK_BYTES:
                yield flush()
                made, parts, held = made + 1, [], 0
    if parts:
        yield flush()


def _stepped(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, Pieces]]:
    """(base, the step's prefix sums, its pieces relative to base) for steps of whole texts."""
    for a, b in steps(offsets):
        base = int(offsets[a])
        part = data[base : int(offsets[b])]
        sums = prefix_hash(part)
        yield base, sums, pieces_of(part, offsets[a : b + 1] - base, length, sums)


class Chunk:
    """A chunk's texts with all its pieces (positions in the chunk's bytes) and each piece's content hash."""

    def __init__(self, row: dict, length: int):
        self.ids, self.sizes, self.data = unpacked(row["ids"], np.int64), unpacked(row["sizes"], np.int64), unpacked(row["data"], np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes)))
        begin, end, windows, anchor, content = [], [], [], [], []
        for base, sums, p in _stepped(self.data, self.offsets, length):
            begin.append(p.begin + base)
            end.append(p.end + base)
            windows.append(p.windows)
            anchor.append(p.anchor)
            content.append(mixed((sums[p.end] - sums[p.begin]) * powers(len(sums))[1][p.begin] + mixed(p.anchor) * np.uint64(3) + p.windows.astype(np.uint64)))
        z = [np.zeros(0, np.int64)]
        self.begin, self.end, self.windows = (np.concatenate(x or z) for x in (begin, end, windows))
        self.anchor, self.content = (np.concatenate(x or [np.zeros(0, np.uint64)]) for x in (anchor, content))

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct anchor hashes, each piece's index into them, and their numbers."""
        return np.unique(self.anchor, return_inverse=True, return_counts=True)

    def _equal(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the pieces x and y are of one anchor and have equal bytes; hashes only spare the comparison."""
        out = (self.anchor[x] == self.anchor[y]) & (self.content[x] == self.content[y]) & (self.windows[x] == self.windows[y])
        same = np.flatnonzero(out)
        if len(same):
            size = self.end[x[same]] - self.begin[x[same]]
            equal = self.data[spans_index(self.begin[x[same]], size)] == self.data[spans_index(self.begin[y[same]], size)]
            out[same] = np.logical_and.reduceat(equal, np.cumsum(size) - size)
        return out

    def open_pieces(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """shared: for each distinct anchor, whether it occurs elsewhere too. Pieces to ask about, one of each content: their numbers, in order of (anchor, content), all open pieces, each one's index into them, multiplicities."""
        _, at, _ = self.anchors()
        live = np.flatnonzero(shared[at])
        order = np.lexsort((self.content[live], self.anchor[live]))
        ordered = live[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = ~self._equal(ordered[1:], ordered[:-1])
        index = np.empty(len(order), dtype=np.int64)
        index[order] = np.cumsum(new) - 1
        return live[order[new]], live, index, np.bincount(index, minlength=int(new.sum()))


def _ranges(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's range begins among sorted keys; shards is a power of two."""
    if shards == 1:
        return np.array([0, len(keys)])
    return np.searchsorted(keys >> np.uint64(64 - shards.bit_length() + 1), np.arange(shards + 1, dtype=np.uint64))


def _power(x: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, x)))))


_COUNT = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_SEEN = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("shared", pa.binary())])
ASK = "shard bigint, chunk bigint, anchors binary, windows binary, counts binary, data binary, begins binary, index binary, cuts binary"
_ASK = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), *[(c, pa.binary()) for c in ("anchors", "windows", "counts", "data", "begins", "index", "cuts")]])
#: The shard of a row that tells a chunk itself what it has asked.
OWN = -1
_TOLD = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("bits", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _count_requests(length: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, _, counts = Chunk(row, length).anchors()
                cuts = _ranges(keys, shards)
                rows = [(o, row["chunk"], keys[a:b].tobytes(), packed(counts[a:b].astype(np.uint32))) for o, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                if rows:
                    yield _batch(rows, _COUNT)

    return run


def _count(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    keys = [np.frombuffer(r["keys"], np.uint64) for r in rows]
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([unpacked(r["counts"], np.uint32) for r in rows]))
    ends = np.cumsum([len(k) for k in keys])
    return pa.Table.from_batches([_batch([(r["shard"], r["chunk"], packed(total[at[e - len(k) : e]] > 1)) for r, k, e in zip(rows, keys, ends)], _SEEN)])


def _shared_of(seen: list[dict], n: int) -> np.ndarray:
    parts = [unpacked(r["shared"], np.bool_) for r in sorted(seen, key=lambda r: r["shard"])]
    return np.concatenate(parts) if parts else np.zeros(n, dtype=bool)


def spans_index(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0] .. begin[0] + size[0] - 1, begin[1] .., as one array."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)


def may_repeat(contents: list[bytes], windows: list[int], length: int, block: int = 2000) -> list[tuple[int, int] | None]:
    """For each piece the first and last of its windows whose hash another window of any of them has too; None if there is none."""
    if not contents:
        return []
    parts = []
    for a in range(0, len(contents), block):
        t = np.frombuffer(b"".join(contents[a : a + block]), dtype=np.uint8)
        sizes, w = np.array([len(c) for c in contents[a : a + block]]), np.array(windows[a : a + block])
        at = spans_index(np.cumsum(sizes) - sizes, w)
        sums = prefix_hash(t)
        parts.append(mixed((sums[at + length] - sums[at]) * powers(len(sums))[1][at]))
    h = np.concatenate(parts)
    ordered = np.sort(h)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    hit = np.zeros(len(h), dtype=bool)
    if len(twice):
        hit = twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h
    w = np.array(windows)
    first = np.cumsum(w) - w
    place = spans_index(np.zeros(len(w), np.int64), w)
    low = np.minimum.reduceat(np.where(hit, place, len(h)), first).tolist()
    high = np.maximum.reduceat(np.where(hit, place, -1), first).tolist()
    return [(a, b) if b >= 0 else None for a, b in zip(low, high)]


def repeated_windows(contents: list[bytes], windows: list[int], length: int) -> list[np.ndarray]:
    """For distinct pieces: which of each one's windows also occurs in another place of any of them, by the common prefixes of sorted suffixes."""
    sizes = np.array([len(c) for c in contents])
    begin = np.cumsum(sizes) - sizes
    t = np.frombuffer(b"".join(contents), dtype=np.uint8)
    w = np.array(windows)
    first = np.cumsum(w) - w
    is_window = np.full(len(t), -1, dtype=np.int32)
    is_window[spans_index(begin, w)] = np.arange(int(w.sum()), dtype=np.int32)
    hit = np.zeros(int(w.sum()), dtype=bool)
    # Two windows are equal if no common prefix from the one to the other is shorter: none since the last window.
    last, shorter = np.zeros(0, dtype=np.int32), 0
    for run, common in suffix_runs(t, length):
        short = np.cumsum(common < length) + shorter
        here = np.flatnonzero(is_window[run] >= 0)
        number = np.concatenate((last, is_window[run[here]]))
        upto = np.concatenate(([0] if len(last) else [], short[here])).astype(np.int64)
        same = upto[1:] == upto[:-1]
        hit[number[:-1][same]] = True
        hit[number[1:][same]] = True
        if len(here):
            last, shorter = number[-1:], int(short[-1] - short[here[-1]])
        else:
            shorter = int(short[-1]) if len(short) else shorter
    return [hit[a : a + n] for a, n in zip(first.tolist(), windows)]


def _shard(length: int):
    def run(table: pa.Table) -> pa.Table:
        asks = table.to_pylist()
        known: dict[tuple[int, bytes], list] = {}
        groups: dict[int, list[tuple[int, bytes]]] = {}
        per_ask = []
        for r in asks:
            windows, counts = unpacked(r["windows"], np.uint32), unpacked(r["counts"], np.uint32)
            data = unpacked(r["data"], np.uint8).tobytes()
            mine, at = [], 0
            for anchor, w, c in zip(np.frombuffer(r["anchors"], np.uint64).tolist(), windows.tolist(), counts.tolist()):
                name = (anchor, data[at : at + w + length - 1])
                at += w + length - 1
                if name not in known:
                    known[name] = [0, w, None]
                    groups.setdefault(anchor, []).append(name)
                known[name][0] += c
                mine.append(name)
            per_ask.append(mine)

        open_groups = [names for names in groups.values() if len(names) > 1 and any(known[x][0] == 1 for x in names)]
        flat = [x for names in open_groups for x in names]
        maybe = dict(zip(flat, may_repeat([x for _, x in flat], [known[x][1] for x in flat], length)))

        def sort(names: list) -> None:
            spans = [maybe[x] for x in names]
            cut = [x[1][a : b + length] for x, (a, b) in zip(names, spans)]
            for name, (a, b), hit in zip(names, spans, repeated_windows(cut, [b - a + 1 for a, b in spans], length)):
                known[name][2] = np.zeros(known[name][1], dtype=bool)
                known[name][2][a : b + 1] = hit

        held, size = [], 0
        for names in open_groups:
            names = [x for x in names if maybe[x]]
            held += names
            size += sum(maybe[x][1] - maybe[x][0] + length for x in names)
            if size >= SORT_BYTES:
                sort(held)
                held, size = [], 0
        if held:
            sort(held)
        rows = []
        for r, mine in zip(asks, per_ask):
            bits = [np.ones(known[x][1], bool) if known[x][0] > 1 else known[x][2] if known[x][2] is not None else np.zeros(known[x][1], bool) for x in mine]
            rows.append((r["shard"], r["chunk"], packed(np.packbits(np.concatenate(bits)))))
        return pa.Table.from_batches([_batch(rows, _TOLD)])

    return run


def _asked(length: int, shards: int):
    """A chunk's questions, a row for each shard, and one for itself: where its open pieces are and which question each is."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            row = left.to_pylist()[0]
            c = Chunk(row, length)
            ask, live, index, counts = c.open_pieces(_shared_of(right.to_pylist(), 0))
            cuts = _ranges(c.anchor[ask], shards)
            bounds = [(o, a, b) for o, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            for o, a, b in bounds:
                part = ask[a:b]
                data = c.data[spans_index(c.begin[part], c.end[part] - c.begin[part])]
                rows.append((o, row["chunk"], c.anchor[part].tobytes(), packed(c.windows[part].astype(np.uint32)), packed(counts[a:b].astype(np.uint32)), packed(data), None, None, None))
            if bounds:
                own = [packed(x) for x in (c.windows[ask].astype(np.uint32), c.begin[live].astype(np.int64), index.astype(np.uint32), np.array([b for _, _, b in bounds], np.int64))]
                rows.append((OWN, row["chunk"], None, own[0], None, None, *own[1:]))
        return pa.Table.from_batches([_batch(rows, _ASK)] if rows else [], schema=_ASK)

    return run


def _result(length: int, key: str, keep: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row, rows = left.to_pylist()[0], right.to_pylist()
        ids, sizes, data = unpacked(row["ids"], np.int64), unpacked(row["sizes"], np.int64), unpacked(row["data"], np.uint8)
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        covered = np.zeros(len(data) + 1, dtype=np.int64)
        own = next((r for r in rows if r["shard"] == OWN), None)
        if own:
            windows, cuts = unpacked(own["windows"], np.uint32).astype(np.int64), unpacked(own["cuts"], np.int64).tolist()
            bounds = np.concatenate(([0], np.cumsum(windows)))
            told = sorted((r for r in rows if r["shard"] != OWN), key=lambda r: r["shard"])
            hits = [np.unpackbits(unpacked(r["bits"], np.uint8), count=int(bounds[b] - bounds[a])).astype(bool) for r, a, b in zip(told, [0, *cuts[:-1]], cuts, strict=True)]
            hit, index = np.concatenate(hits), unpacked(own["index"], np.uint32).astype(np.int64)
            size = windows[index]
            starts = spans_index(unpacked(own["begins"], np.int64), size)[hit[spans_index(bounds[:-1][index], size)]]
            # Windows of several pieces are different ones, so every start is there once.
            covered[starts] += 1
            covered[starts + length] -= 1
        gone = np.cumsum(covered[:-1]) > 0
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        inner = offsets[:-1][offsets[:-1] < len(gone)]
        first[inner] = gone[inner]
        sums = [np.concatenate(([0], np.cumsum(x))) for x in (gone, first)]
        removed, spans = (s[offsets[1:]] - s[offsets[:-1]] for s in sums)
        left_over = [(data[a:b][~gone[a:b]] if n else data[a:b]).tobytes() for a, b, n in zip(offsets.tolist(), offsets[1:].tolist(), removed.tolist())]
        out = {key: ids, "n_bytes": sizes, "n_removed": removed, "n_spans": spans, "kept_sha256": [hashlib.sha256(x).hexdigest() for x in left_over]}
        return pa.table(out | ({"kept": left_over} if keep else {}))

    return run


def substring_dedup(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256; with keep also the bytes that stay."""
    if length < ANCHOR:
        raise ValueError(f"length must be {ANCHOR} at least")
    rows = docs.select(ident(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chunks = written(rows.mapInArrow(_chunked, CHUNK), "chunks")
    total = chunks.agg(F.sum("bytes")).first()[0] or 0
    # Random hashes give two anchors to as many bytes as a window has ANCHOR-byte strings.
    anchors = 2 * total / (length - ANCHOR + 2)
    shards = _power(anchors / SHARD_ANCHORS)
    asked = chunks.mapInArrow(_count_requests(length, shards), "shard bigint, chunk bigint, keys binary, counts binary")
    seen = written(asked.groupBy("shard").applyInArrow(_count, "shard bigint, chunk bigint, shared binary"), "seen")
    # An open piece has some 250 bytes; were all open, this many shards would still hold them in bounds.
    wide = _power(anchors * 100 / SHARD_BYTES)
    asks = written(chunks.groupBy("chunk").cogroup(seen.groupBy("chunk")).applyInArrow(_asked(length, wide), ASK), "asks")
    questions = asks.filter(F.col("shard") != OWN).select("shard", "chunk", "anchors", "windows", "counts", "data")
    told = written(questions.groupBy("shard").applyInArrow(_shard(length), "shard bigint, chunk bigint, bits binary"), "told")
    own = asks.filter(F.col("shard") == OWN).select("shard", "chunk", "windows", "begins", "index", "cuts", F.lit(None).cast("binary").alias("bits"))
    none = F.lit(None).cast("binary")
    both = own.union(told.select("shard", "chunk", none, none, none, none, "bits"))
    schema = f"{key} bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if keep else "")
    out = restored(chunks.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(_result(length, key, keep), schema), key)
    discard(seen)
    out.spent = [chunks, asks, told]
    return out
