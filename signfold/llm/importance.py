r"""Importance resampling towards a target distribution, with a dictionary of distinct features.

Features are hashed n-grams: runs of 1 to max_n consecutive words, joined by a space, repeats counted. Their buckets
(crc32 modulo `buckets`) are counted in the documents and in the texts of the target; a bucket's gain is the
thousandfold logarithm of the ratio of its smoothed shares, a document's weight the sum of the gains of its features.
Gumbel noise from a hash of the seed and the id is added, and the highest scores of the eligible documents are drawn:
a sample without replacement with odds in proportion to the ratios.

1. Features of each document are counted where its row is (Arrow batches; a text is never cut) and written feature by
   feature: a row for each distinct feature of about TEXT_STEP bytes of texts, with the places of the documents that
   have it and its count in each. So a string is written once for many documents.
2. The dictionary: counts of each distinct string over all documents and the target, summed map-side first. A string
   is hashed once, here.
3. Buckets: their counts and gains are sums over the dictionary, one row a bucket; `buckets` bounds what is broadcast.
4. Gains go from the dictionary back to the documents' feature counts by a join on the string and are summed by
   document. Strings that fill more than HOT_SHARE of all (document, string) counts are split by a hash of the step,
   and there are fewer of those than 1 / HOT_SHARE.
5. Places in the order of scores come from a range shuffle and the sums of its partitions, not from one sorted task.

Words: A-Z lower-cased, `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, that is digits, letters and all beyond ASCII.

Defined results: null and empty texts have no features and weight 0; a null id is hashed as an empty text and sorts
first; rows with equal ids are documents of their own, ties among them go by features, then by row; null and empty target texts
add nothing, and without target texts gains follow from the smoothing alone; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ranking
from .shared import HOT_SHARE, gathered, restored, salted_join, texts, written

#: Bytes of texts whose features are counted together; a longer text is a step of its own.
TEXT_STEP = 16 << 20
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of kind 0 are documents (step + places[0] is the row), rows of kind 1 features of a step.
COUNTED = pa.schema([("kind", pa.int32()), ("step", pa.int64()), ("feature", pa.string()), ("n", pa.int64()), ("docs", pa.int64()), ("places", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("doc_id", pa.int64()), ("n_words", pa.int64())])
COUNTED_DDL = "kind int, step bigint, feature string, n bigint, docs bigint, places array<int>, counts array<int>, doc_id bigint, n_words bigint"


def grams(words: pa.Array, owner: np.ndarray, max_n: int) -> tuple[pa.Array, np.ndarray]:
    """Runs of 1 to max_n of the words and the text of each; owner: the text of each word."""
    found, owners, runs = [words], [owner], words
    for k in range(1, max_n):
        last = len(words) - k
        if last <= 0:
            break
        # Each run with the next word; those that go over the end of a text are left out.
        runs = pc.binary_join_element_wise(runs.slice(0, last), words.slice(k), " ")
        same = owner[:last] == owner[k:]
        found.append(runs.filter(pa.array(same)))
        owners.append(owner[:last][same])
    return pa.concat_arrays([g.cast(pa.large_string()) for g in found]), np.concatenate(owners)


def lists(places: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32()))


def counted(max_n: int):
    """(row, doc_id, text) batches, rows numbered one after the other, to COUNTED."""

    def of(rows: np.ndarray, ids: pa.Array, column: pa.Array) -> Iterator[pa.RecordBatch]:
        n = len(rows)
        split = pc.split_pattern_regex(pc.ascii_lower(column), WORD_BREAK).cast(pa.large_list(pa.string()))
        words, owner = pc.list_flatten(split), pc.list_parent_indices(split)
        some = pc.not_equal(words, "")
        words, owner = words.filter(some), owner.filter(some).to_numpy().astype(np.int64)
        flat, of_row = grams(words, owner, max_n)
        step, one = pa.array(np.full(n, rows[0])), np.ones(n, np.int64)
        n_features = np.bincount(of_row, minlength=n).astype(np.int64)
        at = lists((rows - rows[0]).astype(np.int32), np.arange(n + 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), step, pa.nulls(n, pa.string()), pa.array(n_features), pa.array(one), at, pa.nulls(n, pa.list_(pa.int32())), ids, pa.array(np.bincount(owner, minlength=n).astype(np.int64))], schema=COUNTED)
        if not len(flat):
            return
        coded = flat.dictionary_encode()
        keys, counts = np.unique(coded.indices.to_numpy().astype(np.int64) * n + of_row, return_counts=True)
        size = len(coded.dictionary)
        ends = np.searchsorted(keys, np.arange(size + 1) * n)
        sums = np.add.reduceat(counts, ends[:-1])
        m = np.full(size, rows[0])
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(size, np.int32)), pa.array(m), coded.dictionary.cast(pa.string()), pa.array(sums.astype(np.int64)), pa.array(np.diff(ends).astype(np.int64)), lists((rows[keys % n] - rows[0]).astype(np.int32), ends), lists(counts.astype(np.int32), ends), pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64())], schema=COUNTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in gathered(batches, 2, TEXT_STEP):
            yield from of(held.column(0).to_numpy(), held.column(1), held.column(2))

    return run


def features(docs: DataFrame, max_n: int, key: str, text: str, name: str) -> DataFrame:
    rows = texts(docs, key, text).select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), "text")
    return written(rows.mapInArrow(counted(max_n), COUNTED_DDL), name)


def gains(dictionary: DataFrame, buckets: int) -> DataFrame:
    """(bucket, s, t, gain) of (bucket, s, t) rows, `buckets` of them at most."""
    per_bucket = dictionary.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    totals = per_bucket.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    s, t, all_s, all_t = (F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t"))
    ratio = (t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets))
    return per_bucket.crossJoin(F.broadcast(totals)).select("bucket", "s", "t", F.floor(F.log(ratio) * 1000).cast("bigint").alias("gain"))


def gumbel(seed: int, key: str) -> Column:
    """floor(-1000 * ln(-ln u)), u a hash of the seed and the id in (0, 1)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.nullif(F.col(key), F.lit(-(1 << 63))).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000).cast("bigint")


def resample(docs: DataFrame, target: DataFrame, max_n: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """Per document: key, n_features, weight, score, and rank (1, 2, ...; null if it is not drawn)."""
    held = features(docs, max_n, key, text, "features")
    aim = features(target.select(F.lit(0).cast("bigint").alias("item"), F.col(target_text).alias("text")), max_n, "item", "text", "target")
    none = F.lit(0).cast("bigint")
    ours = held.filter("kind = 1").select("feature", F.col("n").alias("s"), none.alias("t"), "docs")
    theirs = aim.filter("kind = 1").select("feature", none.alias("s"), F.col("n").alias("t"), none.alias("docs"))
    summed = ours.unionByName(theirs).groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("s", "t", "docs")])
    dictionary = written(summed.select("feature", "s", "t", "docs", F.pmod(F.crc32("feature"), F.lit(buckets)).alias("bucket")), "dictionary")
    priced = dictionary.filter("docs > 0").join(F.broadcast(gains(dictionary, buckets).select("bucket", "gain")), "bucket").select("feature", "docs", "gain")
    total = dictionary.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n")).first().n
    counts = held.filter("kind = 1").select("step", "feature", "places", "counts")
    met = salted_join(counts, priced, ["feature"], "docs", max(2, int(total * HOT_SHARE) + 1), "step")
    shares = met.select("step", "counts", "gain", F.posexplode("places").alias("i", "place")).select((F.col("step") + F.col("place")).alias("row"), (F.get("counts", F.col("i")) * F.col("gain")).alias("weight"))
    # Documents come along as rows of weight 0, those without features too.
    parts = shares.select("row", "weight", *[F.lit(None).cast("bigint").alias(c) for c in ("doc_id", "n_words", "n_features")]).unionByName(held.filter("kind = 0").select((F.col("step") + F.col("places")[0]).alias("row"), F.lit(0).cast("bigint").alias("weight"), "doc_id", "n_words", F.col("n").alias("n_features")))
    summed = parts.groupBy("row").agg(F.sum("weight").alias("weight"), *[F.max(c).alias(c) for c in ("doc_id", "n_words", "n_features")])
    scored = written(summed.withColumn("score", F.col("weight") + gumbel(seed, "doc_id")), "scores")
    eligible = scored.filter(F.col("n_words") >= least_words)
    ranked = ranking.positions(eligible, F.desc("score"), "doc_id", "n_features", "row")
    drawn = eligible.agg(F.call_function("div", F.count("*") * percent, F.lit(100)).alias("drawn"))
    place = F.when(F.col("position") < F.col("drawn"), F.col("position") + 1)
    out = ranked.crossJoin(F.broadcast(drawn)).withColumn("rank", place).drop("position", "drawn").unionByName(scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint")))
    out = restored(out.select(F.col("doc_id").alias(key), "n_features", "weight", "score", "rank"), key)
    out.spent = [held, aim, dictionary, scored, *ranked.spent]
    return out
