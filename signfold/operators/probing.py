"""Prioritized multi-probing: flip sets of bits in order of the sum of their absolute logits.

The first L sets use only the L - 1 least certain bits (a set whose largest place is j comes after the empty set
and the j singletons before it), so for small L all subsets of these are laid out as an array and the first L
taken, within one row and without a shuffle. For larger L a heap walks the sets lazily, Arrow batch by batch.
Both order ties by (cost, mask), add a set's costs up from its weakest bit on, and give the same probes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import pack

#: Up to this many probes the subsets fit an array of 2 ** (L - 1).
ARRAY_PROBES = 10


def sets_by_sum(values, masks=None) -> Iterator[tuple[float, tuple[int, ...]]]:
    """(sum, indices) of all subsets of nonnegative values by sum, then by the sum of their masks (2**index if none are given), lazily.

    A set of places in sorted order has two followers: with its last place moved on by one, and with the next place
    added; every set has one predecessor, so none comes twice. Places are in order of (value, mask), so a follower of
    equal sum has a larger mask, and the heap gives ties in order too.
    """
    values = np.asarray(values, dtype=float)
    if len(values) and values.min() < 0:
        raise ValueError("values must be nonnegative")
    yield 0.0, ()
    if not len(values):
        return
    masks = [1 << i for i in range(len(values))] if masks is None else list(masks)
    order = sorted(range(len(values)), key=lambda i: (values[i], masks[i]))
    v, m = [float(values[i]) for i in order], [masks[i] for i in order]

    def entry(places: tuple[int, ...]) -> tuple[float, int, tuple[int, ...]]:
        # Summed from the start, not from the predecessor's sum, so that equal sets of values have equal sums.
        return sum((v[i] for i in places), 0.0), sum(m[i] for i in places), places

    heap = [entry((0,))]
    while heap:
        cost, _, places = heapq.heappop(heap)
        yield cost, tuple(order[i] for i in places)
        last = places[-1]
        if last + 1 < len(v):
            heapq.heappush(heap, entry((*places[:-1], last + 1)))
            heapq.heappush(heap, entry((*places, last + 1)))


def weak_bits(x: Column, bits: int, number: int) -> Column:
    """(cost, mask) of the number - 1 least certain of the bits, in order."""
    each = F.transform(x, lambda v, i: F.struct(F.abs(v).cast("double").alias("cost"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(bits - 1) - i).alias("mask")))
    return F.slice(F.array_sort(each), 1, min(number - 1, bits))


def first_sets(weak: str, bits: int, number: int) -> Column:
    """(cost, mask) of the first `number` sets of bits, from the column of weak_bits()."""
    t = min(number - 1, bits)
    sets = []
    for s in range(1 << t):
        cost, mask = F.lit(0.0), F.lit(0).cast("bigint")
        for i in (i + 1 for i in range(t) if s >> i & 1):
            cost, mask = cost + F.element_at(weak, i).cost, mask.bitwiseOR(F.element_at(weak, i).mask)
        sets.append(F.struct(cost.alias("cost"), mask.alias("mask")))
    return F.slice(F.array_sort(F.array(*sets)), 1, number)


def probes(queries: DataFrame, number: int, bits: int, query_id: str = "query_id", logits: str = "logits") -> DataFrame:
    """(query_id, rank, probe_fp): the first `number` probes of each query, rank from 1 on."""
    if not 0 < bits <= 64:
        raise ValueError("1 to 64 bits are supported")
    if not 0 < number <= 1 << bits:
        raise ValueError("there are 2**bits probes at most")
    q = queries.select(F.col(query_id).alias("query_id"), F.slice(F.col(logits), 1, bits).alias("x"))
    if number > ARRAY_PROBES:
        return q.mapInArrow(_heap_probes(number, bits), "query_id bigint, rank int, probe_fp bigint")
    weak = weak_bits(F.col("x"), bits, number)
    first = first_sets("weak", bits, number)
    laid = q.select("query_id", pack("x", bits).alias("fp"), weak.alias("weak")).select("query_id", "fp", F.posexplode(first).alias("rank", "s"))
    return laid.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("fp").bitwiseXOR(F.col("s.mask")).alias("probe_fp"))


def _heap_probes(number: int, bits: int):
    schema = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("probe_fp", pa.int64())])
    # As signed words, like the masks of the array form.
    masks = [1 << (bits - 1 - i) if bits - 1 - i < 63 else -(1 << 63) for i in range(bits)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, max(1, 200_000 // number)):
                part = batch.slice(a, max(1, 200_000 // number))
                ids, codes = [], []
                for ident, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    fp = sum(1 << (bits - 1 - i) for i, v in enumerate(x) if v > 0)
                    for _, (_, flips) in zip(range(number), sets_by_sum(np.abs(np.asarray(x, dtype=np.float64)), masks)):
                        code = fp
                        for i in flips:
                            code ^= 1 << (bits - 1 - i)
                        ids.append(ident)
                        codes.append(code - (1 << 64) if code >> 63 else code)
                rank = np.arange(len(ids), dtype=np.int32) % number + 1
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rank), pa.array(codes, pa.int64())], schema=schema)

    return run


def multi_probe_counts(queries: DataFrame, index: DataFrame, number: int, bits: int, query_id: str = "query_id", logits: str = "logits") -> DataFrame:
    """(query_id, rank, n_hits) for every probe; the index (key, id) is aggregated before the join."""
    per_key = index.groupBy("key").agg(F.count("*").alias("n"))
    p = probes(queries, number, bits, query_id, logits).withColumnRenamed("probe_fp", "key")
    return p.join(per_key, "key", "left").select("query_id", "rank", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_hits"))


def multi_probe_search(queries: DataFrame, index: DataFrame, number: int, bits: int, query_id: str = "query_id", logits: str = "logits") -> DataFrame:
    """(query_id, rank, id) of all hits; ordered by (rank, id) they are the search's result. Probes of a query differ, so no id comes twice."""
    p = probes(queries, number, bits, query_id, logits).withColumnRenamed("probe_fp", "key")
    return p.join(index.select("key", "id"), "key").select("query_id", "rank", "id")
