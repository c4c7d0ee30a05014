"""Positions in a total order, and the rows at given positions, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import tables

#: monotonically_increasing_id() has the partition in the upper bits and the place in it in so many lower ones.
PLACE_BITS = 33


def partition_of(at: str) -> Column:
    return F.shiftright(F.col(at), PLACE_BITS).cast("int")


def place_of(at: str) -> Column:
    return F.col(at).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def sorted_parts(df: DataFrame, *order: Column | str, at: str = "at") -> DataFrame:
    """df in ranges of the order, written down with `at`: the partition and the place in it.

    Rows that tie in the whole order share a range, so the order should end in something that tells rows apart.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id())
    return tables.written(ranged, "ordered")


def offsets(parted: DataFrame, at: str = "at") -> DataFrame:
    """(part, before): rows in earlier partitions; a row for each partition, so it is small enough to be broadcast."""
    sizes = parted.groupBy(partition_of(at).alias("part")).agg(F.count("*").alias("size"))
    return sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))


def positions(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """Adds each row's place in the order, from 0 on without gaps. One range shuffle; the running sum is over partitions, not rows."""
    parted = sorted_parts(df, *order, at="_at")
    numbered = parted.withColumn("part", partition_of("_at")).join(F.broadcast(offsets(parted, "_at")), "part")
    out = numbered.withColumn(name, F.col("before") + place_of("_at")).drop("_at", "part", "before")
    out.spent = [parted]
    return out
