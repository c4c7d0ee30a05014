"""Ground truth and query sets derived from labels, and pair and triplet batches by rules instead of random streams.

Sampling is by hash of (seed, id), so it does not depend on the partitioning; parity with seeded generators is of
distribution only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import tables
from . import draws, ranking


def ground_truth(queries: DataFrame, database: DataFrame, with_ids: bool = False) -> DataFrame:
    """(query_id, n_truth[, truth]) for queries (query_id, label) against (id, label)."""
    if with_ids:
        lists = database.groupBy("label").agg(F.sort_array(F.collect_list("id")).alias("truth"))
        joined = queries.join(lists, "label", "left").select("query_id", F.coalesce("truth", F.array().cast("array<bigint>")).alias("truth"))
        return joined.select("query_id", F.size("truth").cast("bigint").alias("n_truth"), "truth")
    per_label = database.groupBy("label").agg(F.count("*").alias("n"))
    return queries.join(per_label, "label", "left").select("query_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_truth"))


def positive_labels(database: DataFrame) -> DataFrame:
    """(label, first_id): every label once, with its first row, so that sampling rows is uniform over labels."""
    return database.groupBy("label").agg(F.min("id").alias("first_id"))


def sample_positive(database: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(query_id, label, first_id): n draws with replacement, uniform over distinct labels.

    Labels are numbered by their order in ranges; a draw picks a number, and a join fetches its label.
    """
    ranked = ranking.positions(positive_labels(database), "label")
    spark = database.sparkSession
    drawn = spark.range(n).withColumnRenamed("id", "query_id").crossJoin(_total(ranked)).filter("total > 0").withColumn("position", draws.draw(F.col("total"), seed, F.col("query_id")))
    out = drawn.join(ranked, "position").select("query_id", "label", "first_id")
    out.spent = ranked.spent
    return out


def _total(df: DataFrame) -> DataFrame:
    """One row (total)."""
    return F.broadcast(df.agg(F.count("*").alias("total")))


def distinct_tuples(database: DataFrame, n: int, k: int = 2, seed: int = 0) -> DataFrame:
    """(row_id, labels): n rows of k distinct labels of the database, every ordered choice of them equally likely, rows independent.

    Distinct labels are numbered once by ranges and offsets; rows draw numbers, and a join gathers the labels, each of
    which is drawn about as often as any other, however many rows it has.
    """
    ranked = ranking.positions(database.select("label").distinct(), "label")
    total = ranked.agg(F.count("*").alias("n")).first().n
    if total < k:
        raise ValueError(f"{k} distinct labels are asked for and there are {total}")
    rows = database.sparkSession.range(n).withColumnRenamed("id", "row_id")
    places = F.array(*draws.distinct_places(k, draws.bigint(total), seed, F.col("row_id")))
    cells = rows.select("row_id", F.posexplode(places).alias("place", "position"))
    gathered = cells.join(ranked, "position").groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("place", "label"))).alias("cells"))
    out = gathered.select("row_id", F.transform("cells", lambda c: c.label).alias("labels"))
    out.spent = ranked.spent
    return out


def negative_tuple_pairs(database: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(a_key, b_key): n pairs of two distinct labels of the database."""
    pairs = distinct_tuples(database, n, 2, seed)
    out = pairs.select("row_id", F.col("labels")[0].alias("a_key"), F.col("labels")[1].alias("b_key"))
    out.spent = pairs.spent
    return out


#: Candidates of a round beyond what the share of accepted ones so far asks for.
MARGIN = 1.2


def sample_absent(database: DataFrame, n: int, size: int, seed: int = 0, least: int = 10_000) -> DataFrame:
    """(query_id, label): exactly n distinct labels of [0, size) that the database does not have, uniform over all of these.

    Candidates are the numbers 0, 1, 2, ... under a permutation of the label space, so none comes twice. A round
    takes the next of them, as many as the share accepted so far asks for and `least` at least, and drops those outside the space or in the
    database; rounds go on until n are there. The first n in order of candidates are the answer, which does not
    depend on the rounds. If all numbers are used up, there are fewer than n absent labels, an error.
    """
    spark, half = database.sparkSession, draws.half_bits(size)
    space = 1 << 2 * half
    known = tables.written(database.select("label").distinct(), "labels")
    rounds, found, tried = [], 0, 0
    ask = int(n * MARGIN * space / size)
    while not rounds or found < n:
        if tried >= space:
            tables.discard(known, *rounds)
            raise ValueError(f"only {found} labels of {size} are absent, {n} are asked for")
        upto = min(space, tried + max(ask, least))
        candidates = spark.range(tried, upto).select(F.col("id").alias("number"), draws.permuted(F.col("id"), half, seed).alias("label")).filter(F.col("label") < size)
        rounds.append(tables.written(candidates.join(known, "label", "left_anti"), "absent"))
        found, tried = found + rounds[-1].count(), upto
        # Nothing accepted yet: twice as many as were tried.
        ask = int((n - found) * MARGIN * tried / found) + 1 if found else 2 * tried
    every = rounds[0]
    for r in rounds[1:]:
        every = every.unionByName(r)
    placed = ranking.positions(every, "number")
    out = placed.filter(F.col("position") < n).select(F.col("position").alias("query_id"), "label")
    tables.discard(known, *rounds)
    out.spent = placed.spent
    return out


def uniform_labels(spark: SparkSession, n: int, size: int, seed: int = 0) -> DataFrame:
    """(id, label): n hashed draws from [0, size)."""
    return spark.range(n).select("id", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(size)).alias("label"))


def absent_labels(candidates: DataFrame, database: DataFrame) -> DataFrame:
    """Candidate labels that the database does not have."""
    return candidates.select("label").distinct().join(database.select("label"), "label", "left_anti")


def verify_query_sets(positive: DataFrame, negative: DataFrame, database: DataFrame) -> DataFrame:
    """One row (n_bad_positive, n_bad_negative): positive labels that miss, negative ones that hit; both should be 0."""
    miss = positive.select("label").join(database.select("label"), "label", "left_anti").agg(F.count("*").alias("n_bad_positive"))
    hit = negative.select("label").join(database.select("label"), "label", "left_semi").agg(F.count("*").alias("n_bad_negative"))
    return miss.crossJoin(hit)


def negative_pairs(labels: DataFrame, size: int) -> DataFrame:
    """(a_key, b_key): each label of [0, size) with another one of it, never itself."""
    other = F.pmod(F.col("label") + 1 + F.pmod(F.col("label") * 7919, F.lit(size - 1)), F.lit(size))
    return labels.select(F.col("label").alias("a_key"), other.alias("b_key"))


def positive_pairs(items: DataFrame) -> DataFrame:
    """(a_id, b_id, label): neighbours by id among the rows of a label."""
    after = F.lead("id").over(Window.partitionBy("label").orderBy("id"))
    return items.select(F.col("id").alias("a_id"), after.alias("b_id"), "label").filter("b_id IS NOT NULL")


def positive_neighbours(items: DataFrame) -> DataFrame:
    """As positive_pairs, for labels of any number of rows: rows get places in the order of (label, id), and a row meets the one after it by its place."""
    placed = ranking.positions(items.select("label", "id"), "label", "id")
    after = placed.select((F.col("position") - 1).alias("position"), F.col("id").alias("b_id"), F.col("label").alias("b_label"))
    out = placed.join(after, "position").filter(F.col("label").eqNullSafe(F.col("b_label"))).select(F.col("id").alias("a_id"), "b_id", "label")
    out.spent = placed.spent
    return out


def mixed_sizes(total: int | None = None, positive: int | None = None, negative: int | None = None) -> tuple[int, int]:
    """(positive, negative) of a batch of pairs, from any two of the three numbers; half and half of a total alone."""
    if total is None:
        if positive is None or negative is None:
            raise ValueError("two of total, positive and negative are needed, or the total alone")
        total = positive + negative
    elif positive is None and negative is None:
        positive = total // 2
    positive = total - negative if positive is None else positive
    negative = total - positive if negative is None else negative
    if positive + negative != total or positive < 0 or negative < 0:
        raise ValueError(f"{positive} positive and {negative} negative pairs do not make {total}")
    return positive, negative


def mixed_batch(items: DataFrame, negatives: DataFrame, seed: int = 0, **sizes) -> DataFrame:
    """(a_id, b_id, similar): so many positive and negative pairs, those of smallest hash. sizes: of mixed_sizes()."""
    n, m = mixed_sizes(**sizes)

    def few(pairs: DataFrame, most: int) -> DataFrame:
        return pairs.orderBy(F.xxhash64(F.lit(seed), "a_id", "b_id"), "a_id", "b_id").limit(most)

    positive = few(positive_pairs(items).select("a_id", "b_id"), n).withColumn("similar", F.lit(True))
    return positive.unionByName(few(negatives.select("a_id", "b_id"), m).withColumn("similar", F.lit(False)))


def labelled_batch(spark: SparkSession, n: int, size: int, replace: bool = True, seed: int = 0) -> DataFrame:
    """(id, label): a batch of n labels of [0, size), with or without replacement."""
    if replace:
        return uniform_labels(spark, n, size, seed)
    nothing = spark.createDataFrame([], "label bigint")
    return sample_absent(nothing, n, size, seed).withColumnRenamed("query_id", "id")


def mixed_pairs(items: DataFrame, negatives: DataFrame) -> DataFrame:
    """(a_id, b_id, similar): positive pairs and the given (a_id, b_id) negative ones."""
    return positive_pairs(items).select("a_id", "b_id", F.lit(True).alias("similar")).unionByName(negatives.select("a_id", "b_id", F.lit(False).alias("similar")))


def shifted_negatives(items: DataFrame, shift: int) -> DataFrame:
    """(a_id, b_id): rows whose ids differ by `shift` and whose labels differ; an equi-join on the shifted id."""
    other = items.select((F.col("id") - shift).alias("id"), F.col("id").alias("b_id"), F.col("label").alias("other"))
    return items.join(other, "id").filter("label <> other").select(F.col("id").alias("a_id"), "b_id")


def triplets(items: DataFrame, shift: int = 1) -> DataFrame:
    """(anchor_id, positive_id, negative_id): positive pairs with the shifted negative of their anchor."""
    return positive_pairs(items).join(shifted_negatives(items, shift).withColumnRenamed("b_id", "negative_id"), "a_id").select(F.col("a_id").alias("anchor_id"), F.col("b_id").alias("positive_id"), "negative_id")


def gather(items: DataFrame, bank: DataFrame, labels: str = "labels", bank_id: str = "bank_id", payload: str = "payload") -> DataFrame:
    """(id, payloads): the bank's payloads of an array of bank ids, in order."""
    cells = items.select("id", F.posexplode(labels).alias("place", "cell"))
    found = cells.join(bank.select(F.col(bank_id).alias("cell"), F.col(payload).alias("payload")), "cell")
    ordered = found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "payload"))).alias("x"))
    return ordered.select("id", F.transform("x", lambda s: s.payload).alias("payloads"))


_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (that of splitmix64)."""
    x = x + _MIX[0]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class HashedDraws:
    """Uniform integers below a bound for many rows at once, each row with a stream of its own that depends on (seed, row) only."""

    def __init__(self, rows: np.ndarray, seed: int):
        self.state = _mixed(rows.astype(np.uint64) ^ _mixed(np.full(len(rows), seed & ((1 << 64) - 1), dtype=np.uint64)))
        self.taken = np.zeros(len(rows), dtype=np.uint64)

    def below(self, bound: int, at: np.ndarray) -> np.ndarray:
        """For the rows `at`. Numbers of the last, incomplete stretch of the 64-bit range are drawn again, so that none is favoured."""
        whole = np.uint64((1 << 64) // bound * bound - 1)
        out, left = np.empty(len(at), dtype=np.uint64), np.arange(len(at))
        while len(left):
            rows = at[left]
            self.taken[rows] += np.uint64(1)
            x = _mixed(self.state[rows] + self.taken[rows] * _MIX[1])
            good = x <= whole
            out[left[good]] = x[good] % np.uint64(bound)
            left = left[~good]
        return out.astype(np.int64)


def distinct_rows(rows: np.ndarray, k: int, size: int, seed: int) -> np.ndarray:
    """k distinct integers of [0, size) for each row number, every ordered choice equally likely.

    Sparse choices draw again what a row has already; dense ones (more than half of the range) swap through it.
    """
    draws, n = HashedDraws(rows, seed), len(rows)
    every = np.arange(n)
    if 2 * k > size:
        deck = np.tile(np.arange(size), (n, 1))
        for j in range(k):
            at = j + draws.below(size - j, every)
            deck[every, at], deck[every, j] = deck[every, j].copy(), deck[every, at].copy()
        return deck[:, :k]
    out = np.full((n, k), -1, dtype=np.int64)
    for j in range(k):
        left = every
        while len(left):
            drawn = draws.below(size, left)
            good = ~(out[left, :j] == drawn[:, None]).any(axis=1)
            out[left[good], j] = drawn[good]
            left = left[~good]
    return out


def unique_rows(spark: SparkSession, rows: int, k: int, low: int, high: int, seed: int = 0) -> DataFrame:
    """(row_id, values): k distinct integers of [low, high) in each row, for ranges of up to 2**63 integers; a row depends on the seed and its number only."""
    size = high - low
    if k > size:
        raise ValueError(f"{k} distinct values do not fit a range of {size}")
    if size > 1 << 63:
        raise OverflowError("the range has more than 2**63 integers")
    schema = pa.schema([("row_id", pa.int64()), ("values", pa.list_(pa.int64()))])
    block = max(1, (1 << 20) // max(1, size if 2 * k > size else k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, block):
                part = batch.column(0).slice(a, block)
                values = distinct_rows(part.to_numpy(), k, size, seed) + low
                ends = pa.array(np.arange(len(values) + 1) * k, pa.int32())
                yield pa.RecordBatch.from_arrays([part, pa.ListArray.from_arrays(ends, pa.array(values.ravel()))], schema=schema)

    return spark.range(rows).mapInArrow(run, "row_id bigint, values array<bigint>")


def hashed_choice(values: Column, seed: int = 0, *keys: str) -> Column:
    """One element of an array, chosen by hash of the keys."""
    return F.element_at(values, F.pmod(F.xxhash64(F.lit(seed), *keys), F.size(values)).cast("int") + 1)


def id_range(df: DataFrame, start: int, stop: int, id: str = "id") -> DataFrame:
    """Half-open id range; the filter reaches Parquet row groups."""
    return df.filter((F.col(id) >= start) & (F.col(id) < stop))


def slices(stop: int, size: int | None = None, start: int = 0):
    """(begin, end) of consecutive slices."""
    size = size or max(stop - start, 1)
    for a in range(start, stop, size):
        yield a, min(a + size, stop)
