"""Draws that depend on a seed and a number only, as integer arithmetic: any engine can repeat them.

Nothing here overflows 64 signed bits, so that it holds under ANSI mode and in other engines' BIGINT.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Odd multipliers below 2**31; fixed values.
FIRST, SECOND = 1481765933, 625341585
ROUNDS = 6
LOW31 = (1 << 31) - 1


def bigint(x: int) -> Column:
    return F.lit(x).cast("bigint")


def half_bits(size: int) -> int:
    """Half the bits, rounded up, of the numbers below size."""
    if not 1 <= size <= 1 << 62:
        raise ValueError("sizes from 1 to 2**62 are supported")
    return max(1, ((size - 1).bit_length() + 1) // 2)


def round_keys(seed: int) -> list[int]:
    """Keys of the permutation's rounds, 30 bits each."""
    return [int.from_bytes(hashlib.sha256(f"{seed}:{r}".encode()).digest()[:4], "big") >> 2 for r in range(ROUNDS)]


def permute(number: np.ndarray, half: int, seed: int) -> np.ndarray:
    """permuted() of an array."""
    mask = (1 << half) - 1
    left, right = number >> half, number & mask
    for key in round_keys(seed):
        x = right * FIRST + key
        x = (((x >> 13) ^ x) & LOW31) * SECOND
        left, right = right, left ^ ((x >> 14) & mask)
    return (left << half) | right


def permuted(number: Column, half: int, seed: int) -> Column:
    """A permutation of [0, 2 ** (2 * half)): a Feistel network whose rounds hash one half into the other.

    Its values below a size are a permutation of [0, size), so distinct numbers never give the same one. A round uses
    its half three times, so as one expression the rounds would be repeated hundreds of times; they run on Arrow
    batches instead. Spark takes the result for indeterminate, lest a filter on it computes it again.
    """

    @F.pandas_udf("bigint")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(dtype=np.int64), half, seed))

    return run.asNondeterministic()(number)


def draw(bound: Column | int, seed: int, *numbers: Column) -> Column:
    """A number of [0, bound) from 60 bits of a hash of the seed and the numbers; for bounds far below 2**60 as good as uniform."""
    text = F.concat_ws(":", F.lit(str(seed)), *[n.cast("string") for n in numbers])
    bits = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    return F.pmod(bits, bound if isinstance(bound, Column) else bigint(bound))


def distinct_places(k: int, size: Column, seed: int, number: Column) -> list[Column]:
    """k distinct places of [0, size), every ordered choice equally likely.

    The j-th draw is of the size - j places that are left, in order; counted up past the places taken before it, from the smallest on.
    """
    out: list[Column] = []
    for j in range(k):
        place = draw(size - j, seed, number, F.lit(j))
        if out:
            taken = F.array_sort(F.array(*out))
            place = F.aggregate(taken, place, lambda at, t: at + F.when(t <= at, bigint(1)).otherwise(bigint(0)))
        out.append(place)
    return out
