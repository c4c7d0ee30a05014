"""Posting lists in segments: a bucket of any size is rows of bounded length, made by as many tasks as it needs.

A bucket's rows are numbered from 0 on in order of their ids, and segment s of a bucket holds the rows s * length up to
(s + 1) * length. Rows are sorted into ranges of (key, id), so that a large bucket fills several ranges and no task has
more than its range; the number of a bucket's rows in earlier ranges is a running sum of partial counts. At most one
bucket reaches into a range from the one before, so those sums are fewer than ranges and are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ranking

#: Rows of a segment.
LENGTH = 4096


def _carried(rows: DataFrame) -> DataFrame:
    """(part, key, before) of the buckets that reach into a range: how many of their rows are in earlier ones."""
    runs = rows.groupBy("part", "key").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return runs.select("part", "key", F.sum("n").over(earlier).alias("before")).filter("before > 0")


def segments(index: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, segment, first_id, n, ids) of (key, id) rows; ids ascending, `length` of them in all segments of a bucket but its last."""
    if length < 1:
        raise ValueError("a segment has one row at least")
    parted = ranking.sorted_parts(index.select("key", "id"), "key", "id", at="at")
    rows = parted.withColumn("part", ranking.partition_of("at"))
    here = F.row_number().over(Window.partitionBy("part", "key").orderBy("id")) - 1
    carried = F.broadcast(_carried(rows).withColumnsRenamed({"part": "p", "key": "k"}))
    numbered = rows.withColumn("here", here).join(carried, (F.col("part") == F.col("p")) & F.col("key").eqNullSafe(F.col("k")), "left")
    number = F.col("here") + F.coalesce("before", F.lit(0))
    cut = numbered.select("key", F.call_function("div", number, F.lit(length).cast("bigint")).alias("segment"), "id")
    out = cut.groupBy("key", "segment").agg(F.min("id").alias("first_id"), F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))
    out.spent = [parted]
    return out


def bucket_sizes(held: DataFrame) -> DataFrame:
    """(key, n, repr_id) of segments: sums over their rows, ids are not read."""
    return held.groupBy("key").agg(F.sum("n").alias("n"), F.min("first_id").alias("repr_id"))


def page(queries: DataFrame, held: DataFrame, start: int, stop: int, length: int = LENGTH, query_id: str = "query_id", key: str = "key") -> DataFrame:
    """(query_id, place, id): the hits of each query from place `start` up to `stop`, in order of ids.

    Only the segments that have these places are read (a filter that reaches the scan of saved ones), so a page costs
    the same in a bucket of any size.
    """
    if not 0 <= start <= stop:
        raise ValueError("0 <= start <= stop is needed")
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(key).alias("key"))
    some = held.filter((F.col("segment") >= start // length) & (F.col("segment") * length < stop))
    found = asked.join(some.select("key", "segment", "ids"), "key").select("query_id", "segment", F.posexplode("ids").alias("i", "id"))
    placed = found.select("query_id", (F.col("segment") * length + F.col("i")).alias("place"), "id")
    return placed.filter((F.col("place") >= start) & (F.col("place") < stop))
