"""Codes of more than 64 bits: words of 64 bits, masks and probes by word, and joins on all words of a code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import pack_words
from .probing import ARRAY_PROBES


def n_words(bits: int) -> int:
    return -(-bits // 64)


def _weak(x: Column, bits: int, t: int) -> Column:
    """(cost, place) of the t least certain bits; place 0 is the last bit, so ties go to the smaller mask."""
    return F.slice(F.array_sort(F.transform(x, lambda v, i: F.struct(F.abs(v).cast("double").alias("cost"), (F.lit(bits - 1) - i).alias("place")))), 1, t)


def _mask(places: Column, word: int, bits: int) -> Column:
    """The bits of one word among the places. The last word holds the last bits % 64 bits, at its lower end."""
    low = max(0, bits - 64 * (word + 1))
    high = bits - 64 * word
    here = F.filter(places, lambda p: (p >= low) & (p < high))
    return F.aggregate(here, F.lit(0).cast("bigint"), lambda m, p: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), p - low)))


def probes(queries: DataFrame, number: int, bits: int, query_id: str = "query_id", logits: str = "logits") -> DataFrame:
    """(query_id, rank, words): the first `number` probes of codes of any number of bits, by cost and then by mask.

    Masks are compared as their places from the highest on, which is the order of the numbers they would be.
    """
    if bits < 1 or not 0 < number <= min(ARRAY_PROBES, 1 << min(bits, 10)):
        raise ValueError(f"1 to {ARRAY_PROBES} probes of one bit or more are supported")
    t = min(number - 1, bits)
    q = queries.select(F.col(query_id).alias("query_id"), F.slice(F.col(logits), 1, bits).alias("x"))
    q = q.select("query_id", pack_words("x", bits).alias("words"), _weak(F.col("x"), bits, t).alias("weak"))
    sets = []
    for s in range(1 << t):
        chosen = [i + 1 for i in range(t) if s >> i & 1]
        cost = F.lit(0.0)
        for i in chosen:
            cost = cost + F.element_at("weak", i).cost
        places = F.sort_array(F.array(*[F.element_at("weak", i).place for i in chosen]), asc=False) if chosen else F.array().cast("array<int>")
        sets.append(F.struct(cost.alias("cost"), places.alias("places")))
    laid = q.select("query_id", "words", F.posexplode(F.slice(F.array_sort(F.array(*sets)), 1, number)).alias("rank", "s"))
    flipped = [F.col("words")[w].bitwiseXOR(_mask(F.col("s.places"), w, bits)) for w in range(n_words(bits))]
    return laid.select("query_id", (F.col("rank") + 1).alias("rank"), F.array(*flipped).alias("words"))


def _spread(df: DataFrame, words: int) -> DataFrame:
    """Words as columns of their own, so that a join hashes and compares numbers."""
    return df.withColumns({f"word{w}": F.col("words")[w] for w in range(words)}).drop("words")


def probe_counts(asked: DataFrame, index: DataFrame, bits: int) -> DataFrame:
    """(query_id, rank, n_hits, min_id) of probes (query_id, rank, words) in an index (words, id), aggregated by code before the join."""
    keys = [f"word{w}" for w in range(n_words(bits))]
    per_code = _spread(index, len(keys)).groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias("min_id"))
    met = _spread(asked, len(keys)).join(per_code, keys, "left")
    return met.select("query_id", "rank", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_hits"), "min_id")


def probe_search(asked: DataFrame, index: DataFrame, bits: int) -> DataFrame:
    """(query_id, rank, id) of all hits."""
    keys = [f"word{w}" for w in range(n_words(bits))]
    return _spread(asked, len(keys)).join(_spread(index, len(keys)), keys).select("query_id", "rank", "id")
