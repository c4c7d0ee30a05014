"""Poisson bootstrap in one aggregation: every row counts in each replicate as often as a hash of both says.

Drawing n of n rows with replacement gives each row a Poisson(1) number of copies as n grows, and these are independent
but for their sum; so replicates need neither the number of rows nor a second pass, and partial sums of all of them are
made where the rows are. Only a row for each replicate is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .draws import FIRST, LOW31, SECOND, bigint, round_keys


def thresholds() -> list[int]:
    """floor(2**31 * P(Poisson(1) <= k)) for k = 0, 1, ..., as long as they differ from 2**31."""
    out, total, k = [], 0.0, 0
    while True:
        total += math.exp(-1) / math.factorial(k)
        if int(total * (1 << 31)) >= (1 << 31) - 1:
            return out
        out.append(int(total * (1 << 31)))
        k += 1


def uniform31(number: Column, replicate: Column, seed: int) -> Column:
    """31 hashed bits of the row's number and the replicate, in arithmetic that stays below 2**63."""
    folded = F.shiftrightunsigned(number, 31).bitwiseXOR(number).bitwiseAND(bigint(LOW31))
    x = folded * bigint(FIRST) + replicate * bigint(SECOND) + bigint(round_keys(seed)[0])
    for factor in (SECOND, FIRST):
        x = F.shiftrightunsigned(x, 29).bitwiseXOR(x).bitwiseAND(bigint(LOW31)) * bigint(factor)
    return F.shiftrightunsigned(x, 30).bitwiseXOR(x).bitwiseAND(bigint(LOW31))


def copies(u: Column) -> Column:
    """The Poisson(1) number of 31 uniform bits."""
    ends = thresholds()
    out = F.when(u < ends[0], bigint(0))
    for k, end in enumerate(ends[1:], 1):
        out = out.when(u < end, bigint(k))
    return out.otherwise(bigint(len(ends)))


def replicates(df: DataFrame, value: str, number: str, draws: int, seed: int = 0) -> DataFrame:
    """(replicate, n, total): the copies drawn and their sum of values. number: a bigint column that tells rows apart; null values do not count."""
    if draws < 1:
        raise ValueError("one replicate at least is needed")
    rows = df.filter(F.col(value).isNotNull()).select(F.col(number).cast("bigint").alias("number"), F.col(value).alias("v"))
    each = rows.select("number", "v", F.explode(F.sequence(F.lit(0).cast("bigint"), bigint(draws - 1))).alias("replicate"))
    weighed = each.select("replicate", "v", copies(uniform31(F.col("number"), F.col("replicate"), seed)).alias("w"))
    return weighed.groupBy("replicate").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("v")).alias("total"))


def bootstrap_interval(df: DataFrame, value: str, number: str, draws: int = 1000, z: float = 0.05, seed: int = 0) -> DataFrame:
    """One row (low, high): the z / 2 and 1 - z / 2 quantiles of the replicates' means; NaN without rows."""
    means = replicates(df, value, number, draws, seed).filter("n > 0").select((F.col("total") / F.col("n")).alias("mean"))
    ends = [F.coalesce(F.percentile("mean", q), F.lit(float("nan"))).alias(name) for name, q in (("low", z / 2), ("high", 1 - z / 2))]
    return means.agg(*ends)
