"""All results of a grid of searches at once: codes of several lengths, each with several numbers of probes.

The variants are rows of a small table. The database is read once and counted by (bits, key, label) in one aggregation;
queries are read once, each laid out as its probes for every length, of which a variant uses the first ones; and one
more aggregation is keyed by the variant. A loop over single runs would read and shuffle everything once a variant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import pack
from .metrics import _judged, or_nan
from .probing import ARRAY_PROBES, first_sets, weak_bits

#: Variants of a grid; their table is broadcast.
MOST_VARIANTS = 10_000


def variant_hits(queries: DataFrame, database: DataFrame, grid: list[tuple[int, int]], logits: str = "logits") -> DataFrame:
    """(bits, probes, query_id, n_truth, n_hits, n_relevant) for (query_id, label, logits) against (label, logits) and a grid of (bits, probes)."""
    if not grid or len(set(grid)) != len(grid) or len(grid) > MOST_VARIANTS:
        raise ValueError("distinct variants are needed, one at least")
    if any(not 0 < b <= 64 or not 0 < n <= min(ARRAY_PROBES, 1 << b) for b, n in grid):
        raise ValueError(f"codes of 1 to 64 bits and 1 to {ARRAY_PROBES} probes are supported")
    most = {b: max(n for c, n in grid if c == b) for b, _ in grid}
    variants = F.broadcast(queries.sparkSession.createDataFrame(sorted(grid), "bits int, probes int"))

    codes = F.explode(F.array(*[F.struct(F.lit(b).alias("bits"), pack(logits, b).alias("key")) for b in most])).alias("c")
    both = database.select("label", codes).groupBy("c.bits", "c.key", "label").agg(F.count("*").alias("n_relevant"))
    by_key = both.groupBy("bits", "key").agg(F.sum("n_relevant").alias("n_hits"))
    by_label = database.groupBy("label").agg(F.count("*").alias("n_truth"))

    laid = queries.select("query_id", "label", *[pack(logits, b).alias(f"fp{b}") for b in most], *[weak_bits(F.slice(logits, 1, b), b, n).alias(f"weak{b}") for b, n in most.items()])
    laid = laid.select("query_id", "label", *[f"fp{b}" for b in most], *[first_sets(f"weak{b}", b, n).alias(f"sets{b}") for b, n in most.items()])

    def probes_of(b: int) -> Column:
        return F.transform(f"sets{b}", lambda s, i: F.struct(F.lit(b).alias("bits"), (i + 1).alias("rank"), F.col(f"fp{b}").bitwiseXOR(s.mask).alias("key")))

    asked = laid.select("query_id", "label", F.explode(F.concat(*map(probes_of, most))).alias("p")).select("query_id", "label", "p.bits", "p.rank", "p.key")
    met = asked.join(by_key, ["bits", "key"], "left").join(both, ["bits", "key", "label"], "left")
    used = met.join(variants, "bits").filter(F.col("rank") <= F.col("probes"))
    sums = used.groupBy("bits", "probes", "query_id", "label").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_hits", "n_relevant")])
    return sums.join(by_label, "label", "left").select("bits", "probes", "query_id", F.coalesce("n_truth", F.lit(0)).cast("bigint").alias("n_truth"), "n_hits", "n_relevant")


def sweep(queries: DataFrame, database: DataFrame, grid: list[tuple[int, int]], logits: str = "logits") -> DataFrame:
    """(bits, probes, n_queries, recall, avg_jaccard, perfect_rate, tpr, fpr): a row for each variant."""
    judged = _judged(variant_hits(queries, database, grid, logits).withColumn("n_irrelevant", F.col("n_hits") - F.col("n_relevant")))
    judged = judged.withColumn("perfect", F.col("complete") & F.col("sound"))

    def share(what: str, of: str) -> Column:
        return or_nan(F.count_if(of) > 0, F.avg(F.when(F.col(of), F.col(what).cast("double"))))

    truth, relevant = (F.sum(F.when(F.col("positive"), F.col(c))) for c in ("n_truth", "n_relevant"))
    return judged.groupBy("bits", "probes").agg(F.count("*").alias("n_queries"), or_nan(F.coalesce(truth, F.lit(0)) > 0, relevant / truth).alias("recall"), share("jaccard", "positive").alias("avg_jaccard"), share("perfect", "positive").alias("perfect_rate"), share("hit", "positive").alias("tpr"), share("hit", "negative").alias("fpr"))
