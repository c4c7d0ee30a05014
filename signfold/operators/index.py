"""Exact-key index: build, lookups, buckets, collisions, and the Hamming-radius join by bands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import hamming

MODES = ("errorifexists", "overwrite", "append")
#: Most rows of a batch of queries that is broadcast; counted, never assumed.
BROADCAST_ROWS = 100_000


def build_index(df: DataFrame, key: str, id: str = "id", label: str | None = None) -> DataFrame:
    """(key, id[, label]): the index is a keyed table; Spark's own hashed relations take the place of heads and links."""
    return df.select(F.col(key).alias("key"), F.col(id).alias("id"), *([F.col(label).alias("label")] if label else []))


def save_index(index: DataFrame, table: str, buckets: int = 64, mode: str = "errorifexists") -> None:
    """Write clustered by key, so that later lookups and self-joins by key need no shuffle of the index."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode}")
    index.write.mode(mode).bucketBy(buckets, "key").sortBy("key", "id").saveAsTable(table)


def point_lookup(index: DataFrame, key: int) -> DataFrame:
    """Ids with exactly this key, ascending; the filter reaches the scan."""
    return index.filter(F.col("key") == F.lit(key)).select("id").orderBy("id")


def lookup_ids(queries: DataFrame, index: DataFrame, query_id: str = "query_id", key: str = "key", broadcast_rows: int = 0, form: Callable[[Column], Column] = lambda ids: ids) -> DataFrame:
    """(query_id, ids): ids ascending, [] for a miss. For result lists; counts come cheaper from lookup_counts.

    A bucket's list is made once and meets its queries in the join that makes the result, so that each id is shuffled
    once, however often its bucket is asked for; the result itself has a list for each query.

    broadcast_rows: of up to so many queries (BROADCAST_ROWS is a sound bound) the keys are sent to the index, of which
    only the buckets asked for are shuffled then.
    form: what the lists are given out as, also made once for each bucket.
    """
    q = queries.select(F.col(query_id).alias("query_id"), F.col(key).alias("key"))
    held = index.select("key", "id")
    if broadcast_rows and q.limit(broadcast_rows + 1).count() <= broadcast_rows:
        held = held.join(F.broadcast(q.select("key").distinct()), "key", "left_semi")
    lists = held.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("key", form(F.col("ids")).alias("ids"))
    return q.join(lists, "key", "left").select("query_id", F.coalesce("ids", form(F.array().cast("array<bigint>"))).alias("ids"))


def lookup_counts(queries: DataFrame, index: DataFrame, query_id: str = "query_id", key: str = "key") -> DataFrame:
    """(query_id, n_hits, min_id, max_id). The index is aggregated by key before the join, so heavy buckets cost a row."""
    q = queries.select(F.col(query_id).alias("query_id"), F.col(key).alias("key"))
    per_key = index.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("min_id"), F.max("id").alias("max_id"))
    return q.join(per_key, "key", "left").select("query_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_hits"), "min_id", "max_id")


def buckets(index: DataFrame, with_ids: bool = False) -> DataFrame:
    """(key, n, repr_id, sum_ids[, ids ascending]): the smallest id stands for its bucket."""
    more = [F.sort_array(F.collect_list("id")).alias("ids")] if with_ids else []
    return index.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("repr_id"), F.sum("id").alias("sum_ids"), *more)


def bucket_of_row(index: DataFrame) -> DataFrame:
    """(id, n, repr_id) of the bucket that each row is in."""
    return index.join(index.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("repr_id")), "key").select("id", "n", "repr_id")


def rows_of_bucket(index: DataFrame, id: int) -> DataFrame:
    """Ids of the whole bucket that the row with this id is in, ascending; both filters reach the scan."""
    key = index.filter(F.col("id") == F.lit(id)).select("key").distinct()
    return index.join(F.broadcast(key), "key", "left_semi").select("id").orderBy("id")


def bucket_size_histogram(index: DataFrame) -> DataFrame:
    """(bucket_size, n_buckets)."""
    return index.groupBy("key").agg(F.count("*").alias("bucket_size")).groupBy("bucket_size").agg(F.count("*").alias("n_buckets"))


def distinct_codes(index: DataFrame) -> DataFrame:
    """One row (n_codes, n_unique)."""
    return index.agg(F.count("*").alias("n_codes"), F.count_distinct("key").alias("n_unique"))


def choose_two(n: Column) -> Column:
    return F.call_function("div", n * (n - 1), F.lit(2).cast("bigint"))


def internal_collisions(index: DataFrame) -> DataFrame:
    """One row (collisions, max_collisions): pairs of equal key and different label, counted without making them.

    Two aggregations, the first by (key, label), so a heavy key is spread and met as partial counts.
    """
    by_label = index.groupBy("key", "label").agg(F.count("*").alias("n"))
    by_key = by_label.groupBy("key").agg(F.sum("n").alias("n"), F.sum(choose_two(F.col("n"))).alias("same"))
    return by_key.agg(F.coalesce(F.sum(choose_two(F.col("n")) - F.col("same")), F.lit(0)).cast("bigint").alias("collisions"), F.coalesce(choose_two(F.sum("n")), F.lit(0)).cast("bigint").alias("max_collisions"))


def collision_pairs(index: DataFrame) -> DataFrame:
    """(a_id, b_id) of all such pairs: for cross-checks on small tables, since it grows with the square of a bucket."""
    a, b = (index.select("key", F.col("id").alias(f"{x}_id"), F.col("label").alias(f"{x}_label")) for x in "ab")
    return a.join(b, "key").filter((F.col("a_id") < F.col("b_id")) & (F.col("a_label") != F.col("b_label"))).select("a_id", "b_id")


def hamming_join(a: DataFrame, b: DataFrame, radius: int, bits: int = 64) -> DataFrame:
    """(a_id, b_id, distance) of all (id, fp) pairs within the radius.

    Pigeonhole: of radius + 1 bands of the bits, two such codes agree on one at least. Bands are equi-join keys, and a
    pair counts at its first equal band, so nothing is made twice and no nested loop is needed.
    """
    if not 0 <= radius < bits <= 64:
        raise ValueError("0 <= radius < bits <= 64 is needed")
    edges = [bits * i // (radius + 1) for i in range(radius + 2)]

    def banded(df: DataFrame, name: str) -> DataFrame:
        bands = [F.shiftrightunsigned(F.col("fp"), bits - hi).bitwiseAND(F.lit((1 << (hi - lo)) - 1 if hi - lo < 64 else -1)) for lo, hi in zip(edges, edges[1:])]
        return df.select(F.col("id").alias(f"{name}_id"), F.col("fp").alias(f"{name}_fp"), F.array(*bands).alias(f"{name}_bands")).select("*", F.posexplode(f"{name}_bands").alias("band", "value"))

    pairs = banded(a, "a").join(banded(b, "b"), ["band", "value"])
    first = F.array_position(F.zip_with("a_bands", "b_bands", lambda x, y: x == y), F.lit(True)) - 1
    distance = hamming("a_fp", "b_fp")
    return pairs.filter((distance <= radius) & (first == F.col("band"))).select("a_id", "b_id", distance.alias("distance"))


def hamming_links(codes: DataFrame, radius: int, bits: int = 64) -> DataFrame:
    """(id, repr_id, n_links) of (id, fp) rows: the smallest id with the same code, and the rows within the radius, itself included.

    Equal codes are one class from the start, so pairs are made between distinct codes and copies cost a row each.
    """
    classes = codes.groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    pairs = hamming_join(classes, classes, radius, bits).join(classes.select(F.col("id").alias("b_id"), "n"), "b_id")
    links = pairs.groupBy(F.col("a_id").alias("repr_id")).agg(F.sum("n").alias("n_links"))
    of_code = classes.select("fp", F.col("id").alias("repr_id")).join(links, "repr_id")
    return codes.join(of_code, "fp").select("id", "repr_id", "n_links")
