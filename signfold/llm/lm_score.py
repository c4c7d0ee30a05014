"""LM scoring by deleted interpolation of a bigram, a unigram and a uniform model.

P(w | v) = l2[b] c(v w) / c(v) + l1[b] c(w) / N + l0[b] / (V + 1), where b is the bucket of the context frequency
c(v) (powers of two) and the weights of each bucket are learned by expectation-maximisation on held-out counts:
each training token is held out in turn, its own occurrence deleted from every count (leave-one-out).

Texts are packed into chunks of tokens (ids into the chunk's sorted word hashes). A chunk asks for the counts of
its distinct words and word pairs, once each: requests go to owner tasks by hash range as sorted blocks, with
the chunk's own training counts in them; an owner adds the blocks up and answers each block in its order, so
answers carry no keys. What travels follows the distinct n-grams of the chunks, so a very frequent n-gram costs
one number for each chunk. The number of owners follows the number of requests. Word and pair identities are
64-bit hashes.

Tokens: words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, then one end for each text.

Defined results: null texts are empty and consist of the end; repeated rows count as often as they occur; with
no training rows N and V are 0 and the model is uniform; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, ident, mixed, packed, packed_sorted, restored, steps, unpacked, unpacked_sorted, utf8, words, written

CHUNK_TOKENS = 600_000
OWNER_REQUESTS = 1_000_000
END, BEGIN = np.uint64(0x1D8AF066E5C7A3B1), np.uint64(0x7A3C19B24F5E6D08)
BUCKETS = 24
ROUNDS = 40
#: Cells of a nat for the histogram that the weights are learned from.
FINE = 8
LOG_CELLS = 30 * FINE


CHUNK = "chunk bigint, ids binary, sizes binary, train binary, vocabulary binary, tokens binary, requests bigint"
_CHUNK = pa.schema([("chunk", pa.int64()), *[(c, pa.binary()) for c in ("ids", "sizes", "train", "vocabulary", "tokens")], ("requests", pa.int64())])


class Chunk:
    """Token ids of some texts; ids index the sorted vocabulary, END is a word of it."""

    def __init__(self, ids, sizes, train, vocabulary, tokens):
        self.ids, self.sizes, self.train, self.vocabulary, self.tokens = ids, sizes, train, vocabulary, tokens

    @classmethod
    def of(cls, parts: list[tuple]) -> Chunk:
        ids, counts, train, hashes = (np.concatenate(x) for x in zip(*parts))
        sizes = counts + 1
        every = np.empty(int(sizes.sum()), dtype=np.uint64)
        ends = np.cumsum(sizes) - 1
        mask = np.ones(len(every), dtype=bool)
        mask[ends] = False
        every[ends], every[mask] = END, hashes
        vocabulary, tokens = np.unique(every, return_inverse=True)
        return cls(ids, sizes.astype(np.int64), train, vocabulary, tokens.astype(np.uint32))

    def row(self) -> list:
        return [packed(self.ids), packed(self.sizes), packed(self.train), packed_sorted(self.vocabulary), packed(self.tokens)]

    @classmethod
    def read(cls, row: dict) -> Chunk:
        return cls(unpacked(row["ids"], np.int64), unpacked(row["sizes"], np.int64), unpacked(row["train"], np.bool_), unpacked_sorted(row["vocabulary"]), unpacked(row["tokens"], np.uint32))

    @property
    def contexts(self) -> np.ndarray:
        """For each token the vocabulary id before it; len(vocabulary) at the begin of a text."""
        out = np.empty(len(self.tokens), dtype=np.int64)
        out[1:] = self.tokens[:-1]
        out[np.cumsum(self.sizes) - self.sizes] = len(self.vocabulary)
        return out

    @property
    def in_training(self) -> np.ndarray:
        return np.repeat(self.train, self.sizes)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs as context * (V + 1) + word, each token's index into them, and training counts."""
        width = len(self.vocabulary) + 1
        code, at = np.unique(self.contexts * width + self.tokens, return_inverse=True)
        return code, at, np.bincount(at, weights=self.in_training, minlength=len(code)).astype(np.uint32)

    def pair_hashes(self, code: np.ndarray) -> np.ndarray:
        width = len(self.vocabulary) + 1
        v = np.append(self.vocabulary, BEGIN)
        return mixed(v[code // width] * np.uint64(0x9FB21C651E98DF25) + mixed(v[code % width]))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made, parts, held = 0, [], 0

    def flush() -> pa.RecordBatch:
        chunk = Chunk.of(parts)
        number = (TaskContext.get().partitionId() << 24) + made
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([number, *chunk.row(), len(chunk.pairs()[0]) + len(chunk.vocabulary)], _CHUNK.types)], schema=_CHUNK)

    for batch in batches:
        data, offsets = utf8(batch.column(2))
        for a, b in steps(offsets):
            h, _, _, counts = words(data, offsets[a : b + 1])
            parts.append((batch.column(0).slice(a, b - a).to_numpy(), counts, batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False), h))
            held += len(h) + b - a
            if held >= CHUNK_TOKENS:
                yield flush()
                made, parts, held = made + 1, [], 0
    if parts:
        yield flush()


_REQUEST = pa.schema([("owner", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_ANSWER = pa.schema([("owner", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int32()), ("counts", pa.binary()), ("known", pa.int64()), ("total", pa.int64())])


def _split(keys: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by key and where each owner's range begins in it."""
    order = np.argsort(keys)
    shift = np.uint64(64 - owners.bit_length() + 1)
    edges = np.searchsorted(keys[order] >> shift, np.arange(owners + 1, dtype=np.uint64)) if owners > 1 else np.array([0, len(keys)])
    return order, edges


def _requests(owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk.read(row)
                code, _, pair_counts = chunk.pairs()
                word_counts = np.bincount(chunk.tokens, weights=chunk.in_training, minlength=len(chunk.vocabulary)).astype(np.uint32)
                for kind, keys, counts in ((1, chunk.vocabulary, word_counts), (2, chunk.pair_hashes(code), pair_counts)):
                    order, edges = _split(keys, owners)
                    keys, counts = keys[order], counts[order]
                    rows = [(o, row["chunk"], kind, packed_sorted(keys[a:b]), packed(counts[a:b])) for o, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _REQUEST.types)], schema=_REQUEST)

    return run


def _answers(table: pa.Table) -> pa.Table:
    """Sums for one owner and kind; its first answer also carries the owner's distinct known keys and their total."""
    rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    keys = [unpacked_sorted(r["keys"]) for r in rows]
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(at, weights=np.concatenate([unpacked(r["counts"], np.uint32) for r in rows]).astype(float), minlength=len(every)).astype(np.int64)
    out, place = [], 0
    for r, k in zip(rows, keys):
        out.append((r["owner"], r["chunk"], r["kind"], packed(sums[at[place : place + len(k)]]), int((sums > 0).sum()) if place == 0 else 0, int(sums.sum()) if place == 0 else 0))
        place += len(k)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ANSWER.types)], schema=_ANSWER)


COUNTED = CHUNK.removesuffix(", requests bigint") + ", word_counts binary, pair_counts binary"
_COUNTED = pa.schema([*list(_CHUNK)[:-1], ("word_counts", pa.binary()), ("pair_counts", pa.binary())])


def _joined(owners: int):
    """A chunk and the answers to it as one row: the counts of its words and of its pairs in their own order."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row, answers = left.to_pylist()[0], right.to_pylist()
        chunk, found = Chunk.read(row), []
        for kind, keys in ((1, chunk.vocabulary), (2, chunk.pair_hashes(chunk.pairs()[0]))):
            order, _ = _split(keys, owners)
            parts = [unpacked(a["counts"], np.int64) for a in sorted((a for a in answers if a["kind"] == kind), key=lambda a: a["owner"])]
            counts = np.empty(len(keys), dtype=np.int64)
            counts[order] = np.concatenate(parts)
            found.append(packed(counts))
        return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip([*(row[f.name] for f in list(_COUNTED)[:-2]), *found], _COUNTED)], schema=_COUNTED)

    return run


class Counted:
    """A chunk with the counts of its words and pairs."""

    def __init__(self, row: dict, documents: int):
        self.chunk = chunk = Chunk.read(row)
        code, self.at, self.own = chunk.pairs()
        width = len(chunk.vocabulary) + 1
        self.word_counts = unpacked(row["word_counts"], np.int64)
        self.pair = unpacked(row["pair_counts"], np.int64).astype(float)
        # A word is the context of as many tokens as it occurs: the end alone is followed by nothing, and every text has one begin.
        self.context = np.append(self.word_counts, documents)[code // width].astype(float)
        self.word = self.word_counts[code % width].astype(float)


def bucket_of(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0), BUCKETS - 1).astype(np.int64)


def log_cell(p: np.ndarray) -> np.ndarray:
    """0 for no probability, else 1 + a cell of its logarithm."""
    return np.where(p > 0, 1 + np.clip(np.round(-np.log(np.where(p > 0, p, 1)) * FINE), 0, LOG_CELLS - 2), 0).astype(np.int64)


def held_out_cells(c: Counted, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells (bucket, pair probability, word probability) of the training tokens, each held out of its own counts."""
    mine = c.own > 0
    pair, context, word = (x[mine] - 1 for x in (c.pair, c.context, c.word))
    p2 = np.where(context > 0, pair / np.maximum(context, 1), 0)
    code = (bucket_of(context) * LOG_CELLS + log_cell(p2)) * LOG_CELLS + log_cell(word / max(n - 1, 1))
    cells, at = np.unique(code, return_inverse=True)
    return cells, np.bincount(at, weights=c.own[mine], minlength=len(cells)).astype(np.int64)


def learn_weights(cells: np.ndarray, counts: np.ndarray, vocabulary: int, rounds: int = ROUNDS) -> np.ndarray:
    """BUCKETS rows of (pair, word, uniform) weights by expectation-maximisation on a histogram."""

    def p(cell: np.ndarray) -> np.ndarray:
        return np.where(cell > 0, np.exp(-(cell - 1) / FINE), 0)

    if not len(cells):
        return np.tile((0.0, 0.0, 1.0), (BUCKETS, 1))
    b = cells // LOG_CELLS**2
    parts = np.stack([p(cells // LOG_CELLS % LOG_CELLS), p(cells % LOG_CELLS), np.full(len(cells), 1 / (vocabulary + 1))], axis=1)
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = (0, 0.5, 0.5)
    for _ in range(rounds):
        share = weights[b] * parts
        share *= (counts / share.sum(axis=1))[:, None]
        new = np.stack([np.bincount(b, weights=share[:, k], minlength=BUCKETS) for k in range(3)], axis=1)
        # One pseudo-token for each model that a bucket can use keeps every text possible.
        new += np.where(weights > 0, 1.0, 0.0)
        weights = new / new.sum(axis=1, keepdims=True)
    return weights


def score_texts(c: Counted, weights: np.ndarray, n: int, v: int) -> tuple[np.ndarray, ...]:
    """n_tokens, n_known, base and model log10 probability of each text."""
    w = weights[bucket_of(c.context)]
    p = w[:, 0] * np.where(c.context > 0, c.pair / np.maximum(c.context, 1), 0) + w[:, 1] * c.word / max(n, 1) + w[:, 2] / (v + 1)
    # Without a usable context the pair model has no say and its weight goes to the others.
    first = np.cumsum(c.chunk.sizes) - c.chunk.sizes
    base = np.log10((c.word_counts + 0.5) / (n + 0.5 * (v + 1)))

    def by_text(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, first)

    known = (c.word_counts > 0).astype(np.int64)[c.chunk.tokens]
    return c.chunk.sizes, by_text(known), by_text(base[c.chunk.tokens]), by_text(np.log10(p)[c.at])


def lm_score(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, held_out, n_tokens, n_known, train_tokens, base_score (add-half unigrams), score (the model's log10 probability).

    held_out: condition on the columns of docs; rows that meet it are not learned from.
    """
    spark = docs.sparkSession
    rows = docs.select(ident(key).alias("id"), (~F.coalesce(held_out, F.lit(False))).alias("train"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chunks = written(rows.mapInArrow(_chunks, CHUNK), "chunks")
    requests = chunks.agg(F.sum("requests")).first()[0] or 0
    # A power of two, so that an owner is a range of hashes.
    owners = 1 << max(0, int(np.ceil(np.log2(max(1, requests / OWNER_REQUESTS)))))
    asked = chunks.mapInArrow(_requests(owners), "owner bigint, chunk bigint, kind int, keys binary, counts binary")
    answers = written(asked.groupBy("owner", "kind").applyInArrow(_answers, "owner bigint, chunk bigint, kind int, counts binary, known bigint, total bigint"), "answers")
    totals = answers.filter("kind = 1").agg(F.sum("total"), F.sum("known")).first()
    n, v = int(totals[0] or 0), int(totals[1] or 0)
    documents = rows.filter("train").count()
    # Texts of a chunk meet its answers once; weights and scores read the joined table where it lies.
    joined = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_joined(owners), COUNTED)
    joined = written(joined, "counted")
    discard(chunks, answers)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                code, counts = held_out_cells(Counted(row, documents), n)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(counts)], names=["cell", "n"])

    found = joined.mapInArrow(cells, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    order = np.argsort(found.column("cell").to_numpy())
    weights = learn_weights(found.column("cell").to_numpy()[order], found.column("n").to_numpy()[order].astype(float), v)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = Counted(row, documents)
                sizes, known, base, model = score_texts(c, weights, n, v)
                columns = [c.chunk.ids, ~c.chunk.train, sizes, known, np.full(len(sizes), n), base, model]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=[key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"{key} bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    out = restored(joined.mapInArrow(scores, schema), key)
    out.spent = [joined]
    return out
