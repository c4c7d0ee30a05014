"""Exact interpolated quantiles of groups of any size, by refining a histogram of the values' bits.

A double's bits, put in order, are read 16 at a time from the top. Each pass counts the rows of every group by their
next 16 bits, only where the bits before lead to a rank that is asked for, and running sums of the counts tell which
16 bits that rank has. After four passes the value is known. Rows are never sorted or gathered: a pass is an
aggregation with partial counts, of at most 65,536 for each rank that is asked for, so a group that has most of all rows is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import tables
from .index import BROADCAST_ROWS

DIGIT = 16
SIGN = -(1 << 63)


def ordered_bits(x: Column) -> Column:
    """A bigint whose unsigned order is that of the doubles; both zeros are one, NaN comes last."""
    raw = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), x.cast("double") + F.lit(0.0)).cast("bigint")
    return F.when(raw < 0, F.bitwise_not(raw)).otherwise(raw.bitwiseXOR(F.lit(SIGN)))


def from_ordered_bits(b: Column) -> Column:
    raw = F.when(b < 0, b.bitwiseXOR(F.lit(SIGN))).otherwise(F.bitwise_not(b))
    return F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), raw).cast("double")


def values_at(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(grp, rank, value) for wanted (grp, rank) of rows (grp, bits); rank 0 is a group's smallest value. Groups may be null."""
    state = wanted.select("grp", "rank", F.lit(0).cast("bigint").alias("prefix"), F.col("rank").alias("rest"))
    spent: list[DataFrame] = []
    for shift in range(64 - DIGIT, -1, -DIGIT):
        here = rows.select("grp", F.shiftrightunsigned("bits", shift).alias("p"))
        if spent:
            active = state.select(F.col("grp").alias("g"), F.col("prefix").alias("to")).distinct()
            few = active.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
            here = here.join(F.broadcast(active) if few else active, F.col("grp").eqNullSafe(F.col("g")) & (F.shiftrightunsigned("p", DIGIT) == F.col("to")), "left_semi")
        counts = here.groupBy("grp", "p").agg(F.count("*").alias("n"))
        above = F.shiftrightunsigned("p", DIGIT) if spent else F.lit(0).cast("bigint")
        upto = F.sum("n").over(Window.partitionBy("grp", "above").orderBy(F.col("p").bitwiseXOR(F.lit(SIGN))))
        summed = counts.withColumn("above", above).withColumn("upto", upto).select(F.col("grp").alias("g"), "above", "p", "n", "upto")
        met = state.join(summed, F.col("grp").eqNullSafe(F.col("g")) & (F.col("prefix") == F.col("above")) & (F.col("rest") < F.col("upto")) & (F.col("rest") >= F.col("upto") - F.col("n")))
        state = tables.written(met.select("grp", "rank", F.col("p").alias("prefix"), (F.col("rest") - F.col("upto") + F.col("n")).alias("rest")), "ranks")
        spent.append(state)
    out = state.select("grp", "rank", from_ordered_bits(F.col("prefix")).alias("value"))
    tables.discard(*spent[:-1])
    out.spent = spent[-1:]
    return out


def grouped_quantiles(df: DataFrame, by: str, value: str, quantiles: tuple[float, ...] = (0.0, 0.05, 0.5, 0.95, 1.0)) -> DataFrame:
    """(by, n, q0, q5, ...): quantiles interpolated between the two values next to q * (n - 1). Null values do not count; a group without values has NaN."""
    if not all(0 <= q <= 1 for q in quantiles):
        raise ValueError("quantiles lie in [0, 1]")
    rows = tables.written(df.select(F.col(by).alias("grp"), F.when(F.col(value).isNotNull(), ordered_bits(F.col(value))).alias("bits")), "bits")
    sizes = rows.groupBy("grp").agg(F.count("bits").alias("n"))
    places = [F.lit(float(q)) * (F.col("n") - 1) for q in quantiles]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(h), F.ceil(h)) for h in places])))
    wanted = sizes.filter("n > 0").select("grp", F.explode(ranks).alias("rank"))
    found = values_at(rows.filter("bits IS NOT NULL"), wanted)
    held = found.groupBy("grp").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at")).withColumnRenamed("grp", "g")

    def interpolated(h: Column) -> Column:
        low, high = (F.element_at("at", x) for x in (F.floor(h), F.ceil(h)))
        # Equal neighbours need no arithmetic, which would make NaN of infinities.
        return F.when(F.col("n") == 0, F.lit(float("nan"))).when(low == high, low).otherwise(low + (high - low) * (h - F.floor(h)))

    out = sizes.join(held, F.col("grp").eqNullSafe(F.col("g")), "left").select(F.col("grp").alias(by), "n", *[interpolated(h).alias(f"q{round(q * 100)}") for q, h in zip(quantiles, places)])
    out.spent = [rows, *found.spent]
    return out
