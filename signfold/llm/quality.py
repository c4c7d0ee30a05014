"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the UTF-8 bytes of whole texts, a batch of texts at a time. Training runs on the driver on
at most `most_rows` labelled rows (those with the smallest hash of their id, so the choice is the same in every
run); everything else covers all rows. Trees are grown level by level from histograms of binned statistics and
flattened into arrays; scoring walks all rows of a batch down a tree at once.

Defined results: null and empty texts have all statistics 0 and get a score like any other; a null label is
left out, of several labels of one id the largest counts; without labels every score is 0.5, with one class
it is that class's smoothed share; repeated rows get equal scores and each learns and counts as a row; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import mixed, restored, steps, texts, utf8, words

MOST_ROWS = 20_000
FEATURES = (
    "log_bytes log_words word_length word_length_sd distinct_words distinct_pairs top_word upper digits punctuation symbols pipes exclaims stars high_bytes spaces lines line_words short_lines "
    "ends_with_stop repeated_neighbours capital_words long_words short_words plain_words double_marks letters"
).split()


def _classes() -> dict[str, np.ndarray]:
    def table(chars: str) -> np.ndarray:
        t = np.zeros(256, dtype=bool)
        t[list(chars.encode())] = True
        return t

    upper, lower, digits = (table("".join(map(chr, range(a, b)))) for a, b in ((65, 91), (97, 123), (48, 58)))
    return {"upper": upper, "digits": digits, "punctuation": table(".,;:!?'\"()-"), "symbols": table("#$%&*+<=>@[]^_`{|}~\\/"), "pipes": table("|"), "exclaims": table("!"), "stars": table("*#$%&"), "high_bytes": np.arange(256) >= 128, "spaces": table(" \t"), "letters": upper | lower}


CLASSES = _classes()


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    n = len(offsets) - 1
    base = int(offsets[0])
    part, edges = data[base : int(offsets[-1])], offsets - base
    size = np.diff(edges).astype(float)
    out = dict.fromkeys(FEATURES, np.zeros(n))

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return (sums[edges[1:]] - sums[edges[:-1]]).astype(float)

    per_byte = np.maximum(size, 1)
    for name, table in CLASSES.items():
        out[name] = share(table[part]) / per_byte
    h, starts, ends, counts = words(data, offsets)
    starts, ends = starts - base, ends - base
    owner = np.repeat(np.arange(n), counts)
    per_word = np.maximum(counts, 1).astype(float)

    def by_text(x: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=x, minlength=n) / per_word

    length = (ends - starts).astype(float)
    out["log_bytes"], out["log_words"] = np.log1p(size), np.log1p(counts)
    out["word_length"] = by_text(length)
    out["word_length_sd"] = np.sqrt(np.maximum(by_text(length**2) - out["word_length"] ** 2, 0))
    out["long_words"], out["short_words"] = by_text(length > 12), by_text(length <= 2)
    if len(h):
        first, last = part[starts], part[ends - 1]
        out["capital_words"] = by_text(CLASSES["upper"][first])
        out["plain_words"] = by_text(CLASSES["letters"][last] | (last >= 128))
        out["ends_with_stop"] = by_text((last == 46) | (last == 63))
        out["double_marks"] = by_text((length > 2) & (last == part[np.maximum(ends - 2, 0)]) & ~CLASSES["letters"][last] & (last < 128))
        same = np.zeros(len(h))
        same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        out["repeated_neighbours"] = by_text(same)
        # Rank words within a text by one sort of (text, hash) packed into 64 bits.
        for name, code in (("distinct_words", h), ("distinct_pairs", mixed(h + np.roll(h, 1) * np.uint64(3)))):
            key = np.sort((owner.astype(np.uint64) << np.uint64(44)) | (code >> np.uint64(20)))
            new = np.ones(len(key), dtype=bool)
            new[1:] = key[1:] != key[:-1]
            at = np.flatnonzero(new)
            text = (key[at] >> np.uint64(44)).astype(np.int64)
            out[name] = np.bincount(text, minlength=n) / per_word
            if name == "distinct_words":
                top = np.zeros(n)
                np.maximum.at(top, text, np.diff(np.append(at, len(key))))
                out["top_word"] = top / per_word
    breaks = share(part == 10)
    out["lines"] = np.log1p(breaks)
    out["line_words"] = np.log1p(counts / (breaks + 1))
    ends_line = np.flatnonzero(part == 10)
    if len(ends_line):
        gaps = np.diff(np.concatenate(([-1], ends_line)))
        text = np.searchsorted(edges, ends_line, side="right") - 1
        out["short_lines"] = np.bincount(text, weights=gaps < 40, minlength=n) / np.maximum(breaks, 1)
    return np.stack([np.asarray(out[k], dtype=np.float64) for k in FEATURES], axis=1)


# --- trees -----------------------------------------------------------------------------------------


class BoostedTrees:
    """Flat arrays of all trees: a node has a statistic, a threshold, its left child (the right one follows it) and, if a leaf, statistic -1 and a value."""

    def __init__(self, bias: float, feature=(), threshold=(), left=(), value=(), roots=()):
        self.bias = float(bias)
        self.feature, self.left, self.roots = (np.asarray(x, dtype=np.int32) for x in (feature, left, roots))
        self.threshold, self.value = (np.asarray(x, dtype=np.float64) for x in (threshold, value))

    def raw(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.bias), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root, dtype=np.int32)
            while True:
                f = self.feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] > self.threshold[node]
                node = np.where(inner, self.left[node] + right, node)
            total += self.value[node]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 5, rate: float = 0.1, bins: int = 64, ridge: float = 2.0, least: int = 20) -> BoostedTrees:
    """Newton boosting of the logistic loss."""
    n = len(y)
    share = (float(y.sum()) + 0.5) / (n + 1) if n else 0.5
    bias = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return BoostedTrees(bias)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    d = x.shape[1]
    feature, threshold, left, value, roots = [], [], [], [], []

    def new() -> int:
        for a, v in ((feature, -1), (threshold, 0.0), (left, -1), (value, 0.0)):
            a.append(v)
        return len(feature) - 1

    raw = np.full(n, bias)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        root = new()
        roots.append(root)
        node = np.full(n, root)
        level = [root]
        for _ in range(depth):
            place = {v: i for i, v in enumerate(level)}
            slot = np.array([place.get(v, -1) for v in range(len(feature))])[node]
            live = slot >= 0
            k = len(level)
            best = np.full(k, 1e-3)
            choice: list = [None] * k
            for j in range(d):
                width = len(cuts[j]) + 1
                if width < 2:
                    continue
                code = slot[live] * width + binned[live, j]
                gs, hs, ns = (np.bincount(code, weights=w, minlength=k * width).reshape(k, width) for w in (g[live], h[live], np.ones(int(live.sum()))))
                gl, hl, nl = (np.cumsum(a, axis=1)[:, :-1] for a in (gs, hs, ns))
                gt, ht, nt = (a.sum(axis=1, keepdims=True) for a in (gs, hs, ns))
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(nl < least) | (nt - nl < least)] = -1
                at = gain.argmax(axis=1)
                for i in np.flatnonzero(gain[np.arange(k), at] > best):
                    best[i], choice[i] = gain[i, at[i]], (j, int(at[i]))
            following = []
            for i, v in enumerate(level):
                if choice[i] is None:
                    continue
                j, at = choice[i]
                a, b = new(), new()
                feature[v], threshold[v], left[v] = j, float(cuts[j][at]), a
                here = node == v
                node[here] = np.where(binned[here, j] > at, b, a)
                following += [a, b]
            level = following
            if not level:
                break
        g_sum, h_sum = np.bincount(node, weights=g, minlength=len(feature)), np.bincount(node, weights=h, minlength=len(feature))
        for v in np.unique(node):
            value[v] = rate * g_sum[v] / (h_sum[v] + ridge)
        raw += np.array(value)[node]
    return BoostedTrees(bias, feature, threshold, left, value, roots)


# --- Spark -----------------------------------------------------------------------------------------


def _mapped(f, fields: list[tuple[str, pa.DataType]]):
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in steps(offsets):
                out = f(statistics(data, offsets[a : b + 1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), out], schema=schema)

    return run


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, label: str = "quality", key: str = "doc_id", text: str = "text", most_rows: int = MOST_ROWS, **how) -> BoostedTrees:
    """Fit on labelled rows; usable: a condition on the id that training rows meet."""
    rows = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
    rows = rows.filter(usable) if usable is not None else rows
    # Ids and labels only, and no more than most_rows of them, reach the driver.
    chosen = rows.groupBy(F.col(key).cast("bigint").alias(key)).agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64(key), key).limit(most_rows)
    picked = texts(docs, key, text).join(F.broadcast(chosen), key).select("y", "text")
    width = len(FEATURES)

    def lists(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * width, pa.int32()), pa.array(x.ravel()))

    table = picked.mapInArrow(_mapped(lists, [("y", pa.int32()), ("x", pa.list_(pa.float64()))]), "y int, x array<double>").toArrow()
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, width) if table.num_rows else np.zeros((0, width))
    y = table.column("y").to_numpy().astype(float)
    order = np.lexsort((*x.T, y)) if len(y) else np.zeros(0, int)
    return fit(x[order], y[order], **how)


def score(docs: DataFrame, model: BoostedTrees, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row."""
    run = _mapped(lambda x: pa.array(model.score(x)), [(key, pa.int64()), ("score", pa.float64())])
    return restored(texts(docs, key, text).mapInArrow(run, f"{key} bigint, score double"), key)


def good_rows(docs: DataFrame, model: BoostedTrees, least: float, text: str = "text") -> DataFrame:
    """The rows of docs with a score of `least` or more, all columns as they were; rows stay in their tasks, so nothing is joined by id."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(place).fill_null(""))
            for a, b in steps(offsets):
                yield batch.slice(a, b - a).filter(pa.array(model.score(statistics(data, offsets[a : b + 1])) >= least))

    return docs.mapInArrow(run, docs.schema)
