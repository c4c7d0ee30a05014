"""Benchmark decontamination: BM25 retrieval from an inverted index of test items by block-max WAND, then overlap checks.

The index holds the items; every training passage is a query. Scores of an item are divided by the score that
the item's own text would get, so 1 means all of the item, and one threshold serves all items. Passages are
windows of twice the longest item's words at strides of half a window, so an item lies whole in at least one.

Bounds come first: a passage whose terms' best scores sum to less than the threshold is done; then block-wise
bounds leave (passage, block) pairs; those are searched by pivoting over the posting lists. All three steps are
exact, so every item at or above the threshold is retrieved. A retrieved item counts when the passage holds
`overlap` of its distinct word shingles (five words), or of both its question's and its answer's. A question or
answer of fewer words than a shingle must lie in the passage word by word.

The index is made of shards of SHARD_ITEMS items, each broadcast by itself, and the documents are read once: a task
gathers texts of about GATHER_BYTES and takes them through one shard after the other, with one shard in memory at a
time. Document frequencies, mean length and longest item are those of all items, so results do not depend on the
shards; the driver holds one shard and 16 bytes for each distinct word of the benchmark.

Words are runs of letters, digits and non-ASCII bytes, lower-cased; an item's first line is its question, further
lines its answer, unless columns name them.

Defined results: null texts are empty and have no passages; items without words match nothing; an item whose
id is null or no integer counts like any other and is listed as null, before the others; equal items each count; null document ids stay null; repeated rows are judged alike, row by row, whatever their ids; empty tables give no matches; extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ALNUM, NULL_ID, restored, shingles, steps, texts, utf8, words

SHARD_ITEMS = 4096
GATHER_BYTES = 64 << 20
BLOCK = 4
BLOCKS = 64
WIDTH = 5
THRESHOLD = 0.6
OVERLAP = 0.8
K1, B = 1.2, 0.75


def hashed(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return words(data, np.array([0, len(data)]), ALNUM)[0]


def _part(h: np.ndarray) -> np.ndarray:
    """An item's part: its distinct shingles; one of fewer words than a shingle is one."""
    return shingles(h, np.array([len(h)]), WIDTH)[0]


def _shingles(h: np.ndarray) -> np.ndarray:
    """A passage: its distinct shingles and its shorter runs of words, with the hashes that parts of so few words have."""
    held = [_part(h)]
    for n in range(1, min(WIDTH, len(h) + 1)):
        runs = np.unique(np.lib.stride_tricks.sliding_window_view(h, n), axis=0)
        held.append(shingles(runs.reshape(-1), np.full(len(runs), n), WIDTH)[0])
    return np.concatenate(held)


def _place(cursor: list) -> int:
    return cursor[0]


def _stretches(blocks: np.ndarray | None, number: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring blocks."""
    if blocks is None:
        yield 0, number
    elif len(blocks):
        cut = np.flatnonzero(np.diff(blocks) > 1) + 1
        for part in np.split(blocks, cut):
            yield int(part[0]), int(part[-1]) + 1


class Totals:
    """What scores and passages take from all items: their number, words, longest, and the number of items that hold each word."""

    def __init__(self, wholes: Iterable[np.ndarray] = ()):
        self.items = self.words = self.longest = 0
        self.terms, self.held_by = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.add(wholes)

    def add(self, wholes: Iterable[np.ndarray]) -> None:
        distinct = []
        for w in wholes:
            self.items, self.words, self.longest = self.items + 1, self.words + len(w), max(self.longest, len(w))
            distinct.append(np.unique(w))
        if not distinct:
            return
        terms, counts = np.unique(np.concatenate(distinct), return_counts=True)
        self.terms, place = np.unique(np.concatenate((self.terms, terms)), return_inverse=True)
        self.held_by = np.bincount(place, np.concatenate((self.held_by, counts)), len(self.terms)).astype(np.int64)

    def frequency(self, terms: np.ndarray) -> np.ndarray:
        return self.held_by[np.searchsorted(self.terms, terms)]


class BlockMaxIndex:
    """Posting lists over items, with the best score of every list in every block of items. totals: of all items, where these are a group of them."""

    def __init__(self, items: list[tuple[int, str, str]], k1: float = K1, b: float = B, totals: Totals | None = None):
        self.ids = [i for i, _, _ in items]
        parts = [(hashed(q), hashed(a)) for _, q, a in items]
        whole = [np.concatenate(p) for p in parts]
        self.questions, self.answers, self.wholes = [_part(q) for q, _ in parts], [_part(a) for _, a in parts], [_part(w) for w in whole]
        totals = totals or Totals(whole)
        self.longest = totals.longest
        n, everything, mean = len(items), totals.items, totals.words / totals.items if totals.items else 1
        self.terms = np.unique(np.concatenate(whole)) if whole else np.zeros(0, np.uint64)
        lists: list[list[tuple[int, int]]] = [[] for _ in self.terms]
        for no, w in enumerate(whole):
            t, c = np.unique(w, return_counts=True)
            for at, f in zip(np.searchsorted(self.terms, t), c):
                lists[at].append((no, int(f)))
        impact = [{no: math.log(1 + (everything - df + 0.5) / (df + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(whole[no]) / mean)) for no, f in p} for p, df in zip(lists, totals.frequency(self.terms).tolist())]
        own = np.zeros(n)
        for p in impact:
            for no, x in p.items():
                own[no] += x
        self.postings = [(np.array(list(p), dtype=np.int64), np.array([x / own[no] for no, x in p.items()])) for p in impact]
        # Bounds of a passage are sums of rows of this table, so blocks grow with the items and their number stays.
        self.block = max(BLOCK, -(-n // BLOCKS))
        blocks = max(1, -(-n // self.block))
        self.block_best = np.zeros((len(self.terms), blocks), dtype=np.float32)
        for t, (nos, x) in enumerate(self.postings):
            np.maximum.at(self.block_best[t], nos // self.block, (x * (1 + 1e-6)).astype(np.float32))
        self.best = self.block_best.max(axis=1).astype(np.float64) if len(self.terms) else np.zeros(0)
        edges = np.arange(blocks + 1) * self.block
        self.starts = np.array([np.searchsorted(nos, edges) for nos, _ in self.postings], dtype=np.int32).reshape(len(self.terms), blocks + 1)
        # A first look by 16 bits spares most words the binary search.
        self.seen = np.zeros(1 << 16, dtype=bool)
        self.seen[(self.terms >> np.uint64(48)).astype(np.int64)] = True

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Term numbers, -1 for words of no item."""
        out = np.full(len(h), -1, dtype=np.int64)
        maybe = np.flatnonzero(self.seen[(h >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.terms, h[maybe]), max(len(self.terms) - 1, 0))
        same = self.terms[at] == h[maybe] if len(self.terms) else np.zeros(len(maybe), bool)
        out[maybe[same]] = at[same]
        return out

    def search(self, terms: np.ndarray, threshold: float, blocks: np.ndarray | None = None) -> dict[int, float]:
        """All items of score >= threshold for a query of distinct terms; blocks: the only ones to look into, in ascending order (all if None).

        Cursors stand at items in ascending order. The first place where the lists' best scores add up to the
        threshold is the pivot, the first item that can reach it. If its block's best scores don't, the cursors skip
        to the block's end or to where the next list joins in; else items are scored when all cursors reach them.
        """
        found, slack = {}, threshold - 1e-9
        for lo, hi in _stretches(blocks, self.block_best.shape[1]):
            begin, end = self.starts[terms, lo].tolist(), self.starts[terms, hi].tolist()
            # A cursor: current item, place, end, term.
            cursors = [[int(self.postings[t][0][a]), a, b, t] for t, a, b in zip(terms.tolist(), begin, end) if a < b]

            def seek(c: list, target: int) -> None:
                c[1] += int(self.postings[c[3]][0][c[1] : c[2]].searchsorted(target))
                c[0] = int(self.postings[c[3]][0][c[1]]) if c[1] < c[2] else -1

            while cursors:
                cursors.sort(key=_place)
                total, pivot = 0.0, None
                for k, c in enumerate(cursors):
                    total += self.best[c[3]]
                    if total >= slack:
                        pivot = k
                        break
                if pivot is None:
                    break
                no = cursors[pivot][0]
                block = no // self.block
                while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == no:
                    pivot += 1
                up_to = cursors[: pivot + 1]
                if float(self.block_best[[c[3] for c in up_to], block].sum()) < slack:
                    target = min((block + 1) * self.block, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else 1 << 62)
                    for c in up_to:
                        seek(c, target)
                elif cursors[0][0] == no:
                    score = math.fsum(float(self.postings[c[3]][1][c[1]]) for c in up_to)
                    if score >= slack:
                        found[no] = score
                    for c in up_to:
                        seek(c, no + 1)
                else:
                    for c in up_to:
                        if c[0] < no:
                            seek(c, no)
                cursors = [c for c in cursors if c[0] >= 0]
        return found

    def overlaps(self, no: int, held: np.ndarray, overlap: float) -> bool:
        """held: the passage's shingles and shorter runs. A part shorter than a shingle is one run, which must lie in the passage as it is."""

        def share(part: np.ndarray) -> float:
            return float(np.isin(part, held).mean()) if len(part) else 1.0

        return len(self.wholes[no]) > 0 and (share(self.wholes[no]) >= overlap or (share(self.questions[no]) >= overlap and share(self.answers[no]) >= overlap))


def find(index: BlockMaxIndex, data: np.ndarray, offsets: np.ndarray, threshold: float, overlap: float) -> tuple[np.ndarray, list[dict[int, float]], np.ndarray]:
    """For each text: the number of passages, retrieved items that overlap (number in the index -> best score), the number retrieved."""
    h, _, _, counts = words(data, offsets, ALNUM)
    n = len(counts)
    stride = max(index.longest, WIDTH)
    last = np.cumsum(counts)
    first = last - counts
    number = np.where(counts > 0, np.maximum(1, -(-counts // stride) - 1), 0)
    hits: list[dict[int, float]] = [{} for _ in range(n)]
    retrieved = np.zeros(n, dtype=np.int64)
    if not number.sum() or not len(index.terms):
        return number, hits, retrieved
    owner = np.repeat(np.arange(n), number)
    begin = first[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)) * stride
    end = np.minimum(begin + 2 * stride, last[owner])
    term = index.lookup(h)
    at = np.flatnonzero(term >= 0)
    term = term[at]
    lo, hi = np.searchsorted(at, begin), np.searchsorted(at, end)
    # With repetitions the sum bounds that of distinct terms.
    sums = np.concatenate(([0.0], np.cumsum(index.best[term])))
    live = np.flatnonzero(sums[hi] - sums[lo] >= threshold - 1e-6)
    for group in np.array_split(live, max(1, len(live) // 512)):
        if not len(group):
            continue
        size = hi[group] - lo[group]
        row = np.repeat(np.arange(len(group)), size)
        place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + lo[group][row]
        code = np.unique(row * len(index.terms) + term[place])
        row, t = code // len(index.terms), code % len(index.terms)
        edges = np.searchsorted(row, np.arange(len(group) + 1))
        bounds = np.add.reduceat(index.block_best[t], edges[:-1], axis=0)
        for k in np.flatnonzero((bounds >= threshold - 1e-4).any(axis=1)):
            terms = t[edges[k] : edges[k + 1]]
            blocks = np.flatnonzero(bounds[k] >= threshold - 1e-4)
            p = group[k]
            got = index.search(terms, threshold, blocks)
            if not got:
                continue
            retrieved[owner[p]] += len(got)
            held = _shingles(h[begin[p] : end[p]])
            for no, score in got.items():
                if index.overlaps(no, held, overlap):
                    hits[owner[p]][no] = max(hits[owner[p]].get(no, 0.0), score)
    return number, hits, retrieved


MATCH = "id bigint, n_passages bigint, n_retrieved bigint, items array<bigint>, best double"
_MATCH = pa.schema([("id", pa.int64()), ("n_passages", pa.int64()), ("n_retrieved", pa.int64()), ("items", pa.list_(pa.int64())), ("best", pa.float64())])


class Shards:
    """The shards of an index as broadcast variables; with more than one each is loaded for the texts at hand and dropped again."""

    def __init__(self, parts: list, threshold: float, overlap: float):
        self.parts, self.threshold, self.overlap = parts, threshold, overlap

    def indexes(self) -> Iterator[BlockMaxIndex]:
        for part in self.parts:
            yield part.value
            if len(self.parts) > 1:
                part.__dict__.pop("_value", None)

    def find(self, columns: list[pa.Array]) -> tuple[np.ndarray, list[dict[int, float]], np.ndarray]:
        """For the texts of some columns: passages, overlapping items (id -> best score, ids in order of the shards) and the number retrieved, over all shards."""
        spans = [(data, offsets[a : b + 1]) for data, offsets in map(utf8, columns) for a, b in steps(offsets)]
        n = sum(len(o) - 1 for _, o in spans)
        number, hits, retrieved = np.zeros(n, np.int64), [[] for _ in range(n)], np.zeros(n, np.int64)
        for index in self.indexes():
            at = 0
            for data, offsets in spans:
                some, found, got = find(index, data, offsets, self.threshold, self.overlap)
                end = at + len(found)
                number[at:end] = np.maximum(number[at:end], some)
                retrieved[at:end] += got
                for i, x in enumerate(found):
                    hits[at + i] += [(index.ids[no], score) for no, score in x.items()]
                at = end
        return number, hits, retrieved


def _gathered(batches: Iterator[pa.RecordBatch], text: int, alone: bool) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of about GATHER_BYTES of text; alone: one at a time."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(text).nbytes
        if alone or size >= GATHER_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _matcher(shards: Shards):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _gathered(batches, 1, len(shards.parts) < 2):
            number, hits, retrieved = shards.find([b.column(1) for b in group])
            ids = pa.concat_arrays([b.column(0) for b in group])
            items, best = [sorted(i for i, _ in x) for x in hits], [max((s for _, s in x), default=0.0) for x in hits]
            columns = [ids, pa.array(number), pa.array(retrieved), pa.array(items, pa.list_(pa.int64())), pa.array(best, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, schema=_MATCH)

    return run


def _cleaner(shards: Shards, text: int):
    """Batches as they are, without the rows that hold items; the text is column number `text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _gathered(batches, text, len(shards.parts) < 2):
            _, hits, _ = shards.find([b.column(text).fill_null("") for b in group])
            at = 0
            for batch in group:
                yield batch.filter(pa.array([not x for x in hits[at : at + batch.num_rows]], pa.bool_()))
                at += batch.num_rows

    return run


def item_shards(items: DataFrame, item: str, text: str, question: str | None, answer: str | None) -> Iterator[list[tuple[int, str, str]]]:
    """Items as (id, question, answer), SHARD_ITEMS at a time, in the order of their ids."""
    cut = F.split(F.coalesce(F.col(text), F.lit("")), "\n", 2) if not question else None
    q = F.coalesce(F.col(question), F.lit("")) if question else cut[0]
    rest = F.coalesce(F.try_element_at(cut, F.lit(2)), F.lit("")) if not question else F.lit("")
    a = F.coalesce(F.col(answer), F.lit("")) if answer else rest
    number = F.coalesce(F.col(item).try_cast("bigint"), F.lit(NULL_ID))
    rows = items.select(number.alias("i"), q.alias("q"), a.alias("a")).orderBy("i", "q", "a")
    held = []
    for r in rows.toLocalIterator():
        held.append((r.i, r.q, r.a))
        if len(held) == SHARD_ITEMS:
            yield held
            held = []
    if held:
        yield held


def index_of(items: DataFrame, item: str = "item_id", item_text: str = "text", question: str | None = None, answer: str | None = None, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> Shards:
    """Two passes over the items: statistics of all of them, then the shards, which are broadcast one by one."""
    totals = Totals()
    for shard in item_shards(items, item, item_text, question, answer):
        totals.add(np.concatenate((hashed(q), hashed(a))) for _, q, a in shard)
    send = items.sparkSession.sparkContext.broadcast
    parts = [send(BlockMaxIndex(shard, totals=totals)) for shard in item_shards(items, item, item_text, question, answer)]
    return Shards(parts or [send(BlockMaxIndex([], totals=totals))], threshold, overlap)


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **index) -> DataFrame:
    """Per row: key, n_passages, n_retrieved (passage-item pairs at or above the threshold), items (ids of overlapping items, ascending), best (their best score), contaminated. index: arguments of index_of()."""
    out = texts(docs, key, text).mapInArrow(_matcher(index_of(items, **index)), MATCH)
    out = restored(out.withColumnRenamed("id", key), key).withColumn("contaminated", F.size("items") > 0)
    return out.withColumn("items", F.transform("items", lambda i: F.nullif(i, F.lit(NULL_ID))))


def clean_rows(docs: DataFrame, items: DataFrame, text: str = "text", **index) -> DataFrame:
    """The rows of docs that hold no item, all columns as they were; rows stay in their tasks, so nothing is joined by id."""
    return docs.mapInArrow(_cleaner(index_of(items, **index), docs.columns.index(text)), docs.schema)
