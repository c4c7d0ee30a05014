"""Bit-tuple distributions, Shannon entropies, conditional logits and the entropy gradient.

A tuple's pattern is the number whose bits are the tuple's bits, the first most significant. Rows are worked off in
Arrow batches by numpy, and a task hands on one partial sum for each tuple and pattern, whatever the number of rows;
partial sums meet as aggregates of tuples * 2**m groups. Soft probabilities are summed as logarithms shifted by their
largest, so that saturated logits neither overflow nor vanish. What is sent to the tasks has the size of the tuples.
Empty tables have no distributions, no entropies and no gradients: results are empty.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# --- tuples -----------------------------------------------------------------------------------------


def check_tuples(tuples: list[tuple[int, ...]]) -> int:
    """The common length of the tuples."""
    sizes = {len(t) for t in tuples}
    if len(sizes) != 1:
        raise ValueError(f"tuples must have one length, not {sorted(sizes)}")
    return sizes.pop()


def covering_combinations(n: int, k: int, cover: int, seed: int = 0) -> list[tuple[int, ...]]:
    """Sorted distinct k-subsets of range(n) such that each `cover`-subset is extended to one of its own; all of them if cover == k."""
    if not cover <= k <= n:
        raise ValueError("cover <= k <= n is needed")
    if cover == k:
        return list(itertools.combinations(range(n), k))
    r, out = random.Random(seed), set()
    for base in itertools.combinations(range(n), cover):
        rest = [i for i in range(n) if i not in base]
        for _ in range(1000):
            t = tuple(sorted((*base, *r.sample(rest, k - cover))))
            if t not in out:
                out.add(t)
                break
        else:
            raise ValueError("no further subset covers " + str(base))
    return sorted(out)


def padded_combinations(tuples: list[tuple[int, ...]], n: int, count: int, seed: int = 0) -> list[tuple[int, ...]]:
    """The tuples with random further ones of the same size, `count` in all, sorted."""
    import math

    k, out, r = check_tuples(tuples), set(tuples), random.Random(seed)
    if count > math.comb(n, k):
        raise ValueError("there are not so many tuples")
    while len(out) < count:
        out.add(tuple(sorted(r.sample(range(n), k))))
    return sorted(out)


def sub_tuples(tuples: list[tuple[int, ...]]) -> tuple[list[tuple[int, ...]], dict[int, list[int]]]:
    """Tuples with one place left out, each once in order of first appearance, and for each place the numbers of those that go with it."""
    seen: dict[tuple[int, ...], int] = {}
    of_bit: dict[int, list[int]] = {}
    for t in tuples:
        for j, place in enumerate(t):
            rest = t[:j] + t[j + 1 :]
            of_bit.setdefault(place, []).append(seen.setdefault(rest, len(seen)))
    return list(seen), of_bit


# --- hard bits --------------------------------------------------------------------------------------


def tuple_table(spark, tuples: list[tuple[int, ...]], names: list[str]) -> DataFrame:
    """(t, one column for each place): the tuples by number."""
    columns = {"t": pa.array(range(len(tuples)), pa.int32())}
    columns |= {n: pa.array([t[j] for t in tuples], pa.int32()) for j, n in enumerate(names)}
    return spark.createDataFrame(pa.table(columns))


def pattern_counts(df: DataFrame, fp: str, tuples: list[tuple[int, ...]], bits: int) -> DataFrame:
    """(t, pattern, n): counts of the patterns of tuple number t that occur; numpy counts, summed for each task before the shuffle. Null fingerprints count nowhere."""
    m = check_tuples(tuples)
    schema = pa.schema([("t", pa.int32()), ("pattern", pa.int32()), ("n", pa.int64())])
    places = np.array(tuples, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(places), 1 << m), dtype=np.int64)
        for batch in batches:
            code = batch.column(0).to_numpy().view(np.uint64)
            table = [((code >> np.uint64(bits - 1 - i)) & np.uint64(1)).astype(np.uint16) for i in range(bits)]
            for no, t in enumerate(places.tolist()):
                p = table[t[0]]
                for i in t[1:]:
                    p = p * 2 + table[i]
                counts[no] += np.bincount(p, minlength=1 << m)
        t, p = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(p.astype(np.int32)), pa.array(counts[t, p])], schema=schema)

    found = df.select(F.col(fp).cast("bigint")).filter(F.col(fp).isNotNull()).mapInArrow(run, "t int, pattern int, n bigint")
    return found.groupBy("t", "pattern").agg(F.sum("n").alias("n"))


def with_tuple(df: DataFrame, tuples: list[tuple[int, ...]], names: list[str]) -> DataFrame:
    """Tuple numbers t as columns of their places."""
    rest = [c for c in df.columns if c != "t"]
    return df.join(F.broadcast(tuple_table(df.sparkSession, tuples, names)), "t").select(*names, *rest)


def spine(spark, tuples: list[tuple[int, ...]]) -> DataFrame:
    """(t, pattern) of all patterns of all tuples."""
    m = check_tuples(tuples)
    every = F.explode(F.sequence(F.lit(0), F.lit((1 << m) - 1))).alias("pattern")
    return spark.range(len(tuples)).select(F.col("id").cast("int").alias("t"), every)


def average_distribution(df: DataFrame, fp: str, tuples: list[tuple[int, ...]], bits: int) -> DataFrame:
    """(t, pattern, p) for all 2**m patterns, zeros included."""
    counts = pattern_counts(df, fp, tuples, bits)
    totals = counts.groupBy("t").agg(F.sum("n").alias("total"))
    every = spine(df.sparkSession, tuples).join(counts, ["t", "pattern"], "left").join(totals, "t")
    return every.select("t", "pattern", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("p"))


def tuple_entropy(df: DataFrame, fp: str, tuples: list[tuple[int, ...]], bits: int) -> DataFrame:
    """(t, entropy) in bits: log2 N - sum n log2 n / N; patterns that do not occur add nothing."""
    c = pattern_counts(df, fp, tuples, bits).groupBy("t").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return c.select("t", F.greatest(F.log2("total") - F.col("s") / F.col("total"), F.lit(0.0)).alias("entropy"))


# --- soft bits --------------------------------------------------------------------------------------

#: Exponents of one bucket: their exponentials neither overflow nor vanish, and sums of one bucket can be added.
BUCKET = 600.0
#: Numbers that a step of the soft sums holds.
STEP_VALUES = 1 << 22


def log_sigmoids(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of sigma(-x) and sigma(x)."""
    tail = np.log1p(np.exp(-np.abs(x)))
    return np.minimum(-x, 0) - tail, np.minimum(x, 0) - tail


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def outer_sums(values: tuple[np.ndarray, ...], places: np.ndarray, operator=np.add) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Partial outer products over tuples of places: (tuple numbers, array of rows x tuples x patterns), a step of tuples at a time.

    values: an array (rows, places) for each value of a digit; a tuple's pattern combines its places' values by the
    operator, the first place most significant. Tuples that share a prefix of places share its product.
    """
    rows, m, base = len(values[0]), places.shape[1], len(values)
    step = max(1, STEP_VALUES // max(1, rows * base**m))
    stacked = np.stack(values, axis=-1)
    for a in range(0, len(places), step):
        part = places[a : a + step]
        out, of = None, np.zeros(len(part), dtype=np.int64)
        for j in range(m):
            prefixes, first, at = np.unique(part[:, : j + 1], axis=0, return_index=True, return_inverse=True)
            mine = stacked[:, prefixes[:, j], :]
            out = mine if out is None else operator(out[:, of[first], :, None], mine[:, :, None, :]).reshape(rows, len(prefixes), -1)
            of = at.ravel()
        yield np.arange(a, a + len(part)), out[:, of, :]


def soft_log_sums(df: DataFrame, logits: str, tuples: list[tuple[int, ...]]) -> DataFrame:
    """(t, pattern, log_sum, n): logarithm of the sum over rows of the pattern's probability under independent sigma(logits), and the rows.

    A task keeps the largest exponent of each tuple and pattern and the sum of exponentials below it. Its sums go to
    buckets of exponents, so that sums of many tasks add up before and after the shuffle. Null logits count nowhere.
    """
    m, places = check_tuples(tuples), np.array(tuples, dtype=np.int64)
    schema = pa.schema([("t", pa.int32()), ("pattern", pa.int32()), ("bucket", pa.float64()), ("v", pa.float64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, total, n = np.full((len(places), 1 << m), -np.inf), np.zeros((len(places), 1 << m)), 0
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                x = _matrix(batch.column(0).slice(a, 256))
                n += len(x)
                for at, logs in outer_sums(log_sigmoids(x), places):
                    new = np.maximum(top[at], logs.max(axis=0))
                    # A pattern that is impossible so far has no largest exponent to shift by.
                    shift = np.where(np.isfinite(new), new, 0.0)
                    total[at] = total[at] * np.exp(np.where(np.isfinite(top[at]), top[at] - shift, -np.inf)) + np.exp(logs - shift).sum(axis=0)
                    top[at] = new
        t, p = np.nonzero(np.isfinite(top))
        bucket = np.floor(top[t, p] / BUCKET)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(p.astype(np.int32)), pa.array(bucket), pa.array(total[t, p] * np.exp(top[t, p] - bucket * BUCKET)), pa.array(np.full(len(t), n))], schema=schema)

    found = df.select(F.col(logits)).filter(F.col(logits).isNotNull()).mapInArrow(run, "t int, pattern int, bucket double, v double, n bigint")
    sums = found.groupBy("t", "pattern", "bucket").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    met = sums.groupBy("t", "pattern").agg(F.max("bucket").alias("b"), F.collect_list(F.struct("bucket", "v")).alias("x"), F.sum("n").alias("n"))
    shifted = F.aggregate("x", F.lit(0.0), lambda acc, s: acc + s.v * F.exp(F.lit(BUCKET) * (s.bucket - F.col("b"))))
    return met.select("t", "pattern", (F.lit(BUCKET) * F.col("b") + F.log(shifted)).alias("log_sum"), "n")


def log_average_distribution(df: DataFrame, logits: str, tuples: list[tuple[int, ...]]) -> DataFrame:
    """(t, pattern, log_p): logarithms of the average probabilities."""
    return soft_log_sums(df, logits, tuples).select("t", "pattern", (F.col("log_sum") - F.log("n")).alias("log_p"))


def soft_distribution(df: DataFrame, logits: str, tuples: list[tuple[int, ...]]) -> DataFrame:
    """(t, pattern, p): average probabilities."""
    return log_average_distribution(df, logits, tuples).select("t", "pattern", F.exp("log_p").alias("p"))


def soft_entropy(df: DataFrame, logits: str, tuples: list[tuple[int, ...]]) -> DataFrame:
    """(t, entropy) in bits of the average soft distribution, from its logarithms."""
    term = F.exp("log_p") * F.col("log_p") / F.lit(float(np.log(2)))
    return log_average_distribution(df, logits, tuples).groupBy("t").agg(F.greatest(-F.sum(term), F.lit(0.0)).alias("entropy"))


# --- conditional logits and gradient ---------------------------------------------------------------


def _conditions(tuples: list[tuple[int, ...]]) -> tuple[pa.Table, list[tuple[int, ...]]]:
    """(t, j, bit, sub) of all leave-one-out pairs, place j of tuple t left out, and the sub-tuples."""
    m = check_tuples(tuples)
    if m == 1:
        raise NotImplementedError("tuples of one bit have no conditions")
    subs, _ = sub_tuples(tuples)
    number = {s: i for i, s in enumerate(subs)}
    rows = [(no, j, t[j], number[t[:j] + t[j + 1 :]]) for no, t in enumerate(tuples) for j in range(m)]
    return pa.table({c: pa.array(v, pa.int32()) for c, v in zip(("t", "j", "bit", "sub"), zip(*rows))}), subs


def _sides(values: DataFrame, tuples: list[tuple[int, ...]], value: str, none: float) -> DataFrame:
    """(bit, sub, pattern, v1, v0): the values (t, pattern, value) of bit 1 and bit 0 with each pattern of the sub-tuple; `none` for patterns without a row."""
    m = check_tuples(tuples)
    spark, (table, _) = values.sparkSession, _conditions(tuples)
    every = spine(spark, tuples).join(values, ["t", "pattern"], "left").select("t", "pattern", F.coalesce(F.col(value).cast("double"), F.lit(none)).alias("v"))
    live = every.join(values.select("t").distinct(), "t", "left_semi").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    low = F.call_function("shiftleft", F.lit(1), F.lit(m - 1) - F.col("j"))
    # The bit is taken out of the pattern: what is above it moves down by one place.
    sub = F.call_function("div", F.col("pattern"), low * 2).cast("int") * low + F.col("pattern") % low
    side = F.call_function("div", F.col("pattern"), low) % 2
    rows = live.select("t", "j", sub.alias("pattern"), side.alias("side"), "v").join(F.broadcast(spark.createDataFrame(table)), ["t", "j"])
    pick = [F.max(F.when(F.col("side") == k, F.col("v"))).alias(f"v{k}") for k in (1, 0)]
    return rows.groupBy("bit", "sub", "pattern").agg(*pick)


def conditional_logits(df: DataFrame, logits: str, tuples: list[tuple[int, ...]]) -> DataFrame:
    """(bit, sub, pattern, logit): log of the summed probability of bit 1 with the sub-tuple's pattern over that of bit 0; 0 where neither can be."""
    d = F.col("v1") - F.col("v0")
    sides = _sides(soft_log_sums(df, logits, tuples), tuples, "log_sum", float("-inf"))
    return sides.select("bit", "sub", "pattern", F.when(F.isnan(d), F.lit(0.0)).otherwise(d).alias("logit"))


def conditional_logits_discrete(df: DataFrame, fp: str, tuples: list[tuple[int, ...]], bits: int, prior: float = 1.0) -> DataFrame:
    """(bit, sub, pattern, logit) from counts with an additive prior."""
    sides = _sides(pattern_counts(df, fp, tuples, bits), tuples, "n", 0.0)
    logit = F.log(F.col("v1") + F.lit(float(prior))) - F.log(F.col("v0") + F.lit(float(prior)))
    return sides.select("bit", "sub", "pattern", logit.alias("logit"))


def average_counts(df: DataFrame, fp: str, tuples: list[tuple[int, ...]], bits: int) -> DataFrame:
    """(t, pattern, n) for all patterns, zeros included."""
    counts = pattern_counts(df, fp, tuples, bits)
    return spine(df.sparkSession, tuples).join(counts, ["t", "pattern"], "left").select("t", "pattern", F.coalesce("n", F.lit(0)).alias("n"))


def entropy_gradient(
    df: DataFrame, id: str, logits: str, tuples: list[tuple[int, ...]], kind: str = "normal", fp: str | None = None, bits: int = 64, prior: float = 1.0, weight: float = 1.0, shuffle: list[int] | None = None
) -> DataFrame:
    """(id, bit, grad): `weight` times the negative entropy gradient by the logits.

    kind: "normal" (soft conditional logits) or "pseudo-smooth" (from counts of the fingerprint column). shuffle: an
    order of the logits in which tuples name their places; gradients come back under the logits' own places. The
    conditional logits are a table of a size given by the tuples alone, which goes to the tasks as one array. Null
    logits have no gradient.
    """
    if kind == "straight-through":
        raise NotImplementedError("the straight-through gradient is not defined")
    if kind not in ("normal", "pseudo-smooth"):
        raise ValueError(f"unknown kind of gradient {kind}")
    m, (table, subs) = check_tuples(tuples) - 1, _conditions(tuples)
    if shuffle is not None:
        tuples = [tuple(shuffle[i] for i in t) for t in tuples]
        table, subs = _conditions(tuples)
    rows = df.filter(F.col(logits).isNotNull())
    found = conditional_logits(rows, logits, tuples) if kind == "normal" else conditional_logits_discrete(rows, fp, tuples, bits, prior)
    found, n = found.toArrow(), rows.count()
    places, owner = np.array(subs, dtype=np.int64).reshape(len(subs), m), table.column("bit").to_numpy()
    pairs = np.lexsort((table.column("sub").to_numpy(), owner))
    owner, sub = owner[pairs], table.column("sub").to_numpy()[pairs]
    slot = {(i, s): k for k, (i, s) in enumerate(zip(owner.tolist(), sub.tolist()))}
    values = np.zeros((len(pairs), 1 << m))
    for i, s, p, v in zip(*(found.column(c).to_pylist() for c in ("bit", "sub", "pattern", "logit"))):
        values[slot[i, s], p] = v
    # Where one side is impossible in all rows, so is the pattern or the slope of the bit: the term is none.
    finite = np.where(np.isfinite(values), values, 0.0)
    heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    touched = owner[heads]
    schema = pa.schema([("id", pa.int64()), ("bit", pa.int32()), ("grad", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                x = _matrix(batch.column(1).slice(a, 256))
                down, up = log_sigmoids(x)
                # Probabilities of the patterns of every sub-tuple, then each pair's share of the slope.
                joint = np.concatenate([np.exp(logs) for _, logs in outer_sums((down, up), places)], axis=1)
                slope = np.zeros((len(x), len(pairs)))
                for p in range(1 << m):
                    slope += joint[:, sub, p] * finite[:, p]
                grad = np.add.reduceat(slope, heads, axis=1) * np.exp(down + up)[:, touched] * (weight / max(n, 1))
                ids = np.repeat(batch.column(0).slice(a, 256).to_numpy(), len(touched))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.tile(touched, len(x)).astype(np.int32)), pa.array(grad.ravel())], schema=schema)

    return rows.select(F.col(id).cast("bigint").alias("id"), F.col(logits)).mapInArrow(run, "id bigint, bit int, grad double").withColumnRenamed("id", id)
