"""Retrieval metrics: per query, micro and macro averages, membership rates, Hamming histograms, quick reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import hamming
from .index import internal_collisions

NAN = float("nan")


def or_nan(condition: Column, value: Column) -> Column:
    """value where the condition holds, else NaN: an empty denominator gives NaN, not null."""
    return F.when(condition, value).otherwise(F.lit(NAN))


# --- per query, on id lists --------------------------------------------------------------------------


def relevant(retrieved: Column, truth: Column) -> Column:
    """Retrieved ids that are true, in order, repetitions kept."""
    return F.filter(retrieved, lambda r: F.array_contains(truth, r))


def irrelevant(retrieved: Column, truth: Column) -> Column:
    return F.filter(retrieved, lambda r: ~F.array_contains(truth, r))


def with_list_predicates(results: DataFrame) -> DataFrame:
    """Adds every predicate to (query_id, truth, retrieved): sizes, hit, positive/negative and their combinations, completeness, soundness, perfection (of sets), Jaccard index."""
    truth, retrieved = F.col("truth"), F.col("retrieved")
    d = results.withColumns({"n_truth": F.size(truth).cast("bigint"), "n_hits": F.size(retrieved).cast("bigint"), "n_relevant": F.size(relevant(retrieved, truth)).cast("bigint"), "n_irrelevant": F.size(irrelevant(retrieved, truth)).cast("bigint"), "missed": F.filter(truth, lambda x: ~F.array_contains(retrieved, x))})
    same = F.array_sort(F.array_distinct(truth)) == F.array_sort(F.array_distinct(retrieved))
    return _judged(d).withColumn("perfect", same)


def _judged(d: DataFrame) -> DataFrame:
    hit, positive = F.col("n_hits") > 0, F.col("n_truth") > 0
    union = F.col("n_truth") + F.col("n_irrelevant")
    return d.withColumns({
        "hit": hit, "positive": positive, "negative": ~positive, "true_positive": hit & positive, "true_negative": ~hit & ~positive, "false_positive": hit & ~positive, "false_negative": ~hit & positive,
        "complete": F.col("n_relevant") == F.col("n_truth"), "sound": F.col("n_irrelevant") == 0, "jaccard": F.when(union == 0, F.lit(1.0)).otherwise(F.col("n_relevant") / union),
    })


def list_results(queries: DataFrame, database: DataFrame) -> DataFrame:
    """(query_id, relevant, missed) with every predicate of with_list_predicates, for queries (query_id, key, label) against (key, id, label); ids ascending.

    An id of the database is in one list, that of its key and label, and is shuffled in it. A query finds its relevant
    ids in the list of its own key among those of its label, the missed ones in the others. Irrelevant hits are counted
    only: they are the rest of a bucket, which lookup_ids gives.
    """
    cells = database.groupBy("key", "label").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    by_key = cells.groupBy("key").agg(F.sum(F.size("ids")).cast("bigint").alias("n_hits"))
    by_label = cells.groupBy("label").agg(F.collect_list(F.struct(F.col("key").alias("of"), "ids")).alias("cells"))
    own = lambda x: F.coalesce(x.of == F.col("key"), F.lit(False))
    some = lambda c: F.coalesce(F.flatten(F.transform(c, lambda x: x.ids)), F.array().cast("array<bigint>"))
    d = queries.select("query_id", "key", "label").join(by_key, "key", "left").join(by_label, "label", "left")
    d = d.select("query_id", F.coalesce("n_hits", F.lit(0)).cast("bigint").alias("n_hits"), some(F.filter("cells", own)).alias("relevant"), F.sort_array(some(F.filter("cells", lambda x: ~own(x)))).alias("missed"))
    d = d.withColumns({"n_relevant": F.size("relevant").cast("bigint"), "n_truth": (F.size("relevant") + F.size("missed")).cast("bigint"), "n_irrelevant": F.col("n_hits") - F.size("relevant")})
    return _judged(d).withColumn("perfect", F.col("complete") & F.col("sound"))


# --- per query, by counting --------------------------------------------------------------------------


def query_results(queries: DataFrame, database: DataFrame) -> DataFrame:
    """Counts and predicates for queries (query_id, key, label) against (key, id, label).

    No id list is collected: the database is aggregated once by (key, label), and hits, truth and their overlap are
    three joins of the queries with its roll-ups, so heavy buckets cost a row each.
    """
    both = database.groupBy("key", "label").agg(F.count("*").alias("n_relevant"))
    by_key = both.groupBy("key").agg(F.sum("n_relevant").alias("n_hits"))
    by_label = both.groupBy("label").agg(F.sum("n_relevant").alias("n_truth"))
    d = queries.select("query_id", "key", "label").join(both, ["key", "label"], "left").join(by_key, "key", "left").join(by_label, "label", "left")
    d = d.select("query_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_truth", "n_hits", "n_relevant")])
    d = d.withColumn("n_irrelevant", F.col("n_hits") - F.col("n_relevant"))
    return _judged(d).withColumn("perfect", F.col("complete") & F.col("sound"))


def dictionary_rates(results: DataFrame) -> DataFrame:
    """One row (recall, avg_jaccard, perfect_rate) over positive queries."""
    r = results.filter("positive")
    n = F.count("*")
    return r.agg(or_nan(F.sum("n_truth") > 0, F.sum("n_relevant") / F.sum("n_truth")).alias("recall"), or_nan(n > 0, F.avg("jaccard")).alias("avg_jaccard"), or_nan(n > 0, F.avg(F.col("perfect").cast("double"))).alias("perfect_rate"))


def membership_rates(results: DataFrame) -> DataFrame:
    """One row (tpr, fpr): shares of positive and of negative queries that hit anything."""
    hit = F.col("hit").cast("double")
    return results.agg(or_nan(F.count_if("positive") > 0, F.avg(F.when(F.col("positive"), hit))).alias("tpr"), or_nan(F.count_if("negative") > 0, F.avg(F.when(F.col("negative"), hit))).alias("fpr"))


def results_row(queries: DataFrame, database: DataFrame) -> DataFrame:
    """All metrics in one row: dictionary, set and collision sections (joins of one-row aggregates)."""
    r = query_results(queries, database)
    return dictionary_rates(r).crossJoin(membership_rates(r)).crossJoin(internal_collisions(database))


def search_report(results: DataFrame) -> DataFrame:
    """(query_id, n_truth, n_relevant, n_irrelevant, completeness, soundness, verdict, n_missed)."""
    r = results.withColumns({"completeness": F.when(F.col("complete"), "COMPLETE").otherwise("INCOMPLETE"), "soundness": F.when(F.col("sound"), "SOUND").otherwise("UNSOUND"), "n_missed": F.col("n_truth") - F.col("n_relevant")})
    return r.select("query_id", "n_truth", "n_relevant", "n_irrelevant", "completeness", "soundness", F.when(F.col("perfect"), "PERFECT").otherwise("IMPERFECT").alias("verdict"), "n_missed")


def _first_by(database: DataFrame, by: str, apart: str, k: int) -> DataFrame:
    """(by, some): of each `by` the (id, apart) of smallest id, k at most of each `apart` and 2 k in all.

    Whatever one `apart` is left out, the first k ids of the others are among these. Both windows keep the first
    rows of a group only, which Spark does in each task before the shuffle too, so no large group is ever moved.
    """
    each = database.select(by, apart, "id").withColumn("n", F.row_number().over(Window.partitionBy(by, apart).orderBy("id"))).filter(F.col("n") <= k)
    few = each.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy("id"))).filter(F.col("n") <= 2 * k)
    return few.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col("id"), F.col(apart).alias("apart")))).alias("some"))


def first_failures(queries: DataFrame, database: DataFrame, k: int) -> DataFrame:
    """(query_id, irrelevant, missed): the first k ids of hits of another label, and of rows of the label that are no hits; for queries (query_id, key, label) against (key, id, label).

    A display of rows * columns results that leaves one row for relevant ones asks for k = (rows - 1) * columns.
    """
    if k < 1:
        raise ValueError("one id at least must be asked for")

    def rest(of: str) -> Column:
        found = F.filter("some", lambda x: ~x.apart.eqNullSafe(F.col(of)))
        return F.coalesce(F.slice(F.transform(found, lambda x: x.id), 1, k), F.array().cast("array<bigint>"))

    hits = queries.select("query_id", "key", "label").join(_first_by(database, "key", "label", k), "key", "left").select("query_id", "key", "label", rest("label").alias("irrelevant"))
    return hits.join(_first_by(database, "label", "key", k), "label", "left").select("query_id", "irrelevant", rest("key").alias("missed"))


# --- Hamming histograms -------------------------------------------------------------------------------


def dense_histogram(df: DataFrame, value: str, top: int, by: str | None = None, kinds: list[str] | None = None) -> DataFrame:
    """([by,] value, n) for every value of 0..top, zeros included."""
    spine = df.sparkSession.range(top + 1).select(F.col("id").cast("int").alias(value))
    keys = [value]
    if by:
        spine = spine.withColumn(by, F.explode(F.array(*[F.lit(k) for k in kinds])))
        keys = [by, value]
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return spine.join(counts, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def triplet_distances(triplets: DataFrame) -> DataFrame:
    """(kind, distance) from (anchor_fp, positive_fp, negative_fp)."""
    pairs = F.array(F.struct(F.lit("positive").alias("kind"), hamming("anchor_fp", "positive_fp").alias("distance")), F.struct(F.lit("negative").alias("kind"), hamming("anchor_fp", "negative_fp").alias("distance")))
    return triplets.select(F.explode(pairs).alias("p")).select("p.kind", "p.distance")


def hamming_histograms(triplets: DataFrame, bits: int) -> DataFrame:
    """(kind, distance, n)."""
    return dense_histogram(triplet_distances(triplets), "distance", bits, "kind", ["positive", "negative"])


def recall_at(histograms: DataFrame, radii: tuple[int, ...] = (0, 1, 2, 3)) -> DataFrame:
    """(r, recall, fallout): shares of positive and negative pairs within distance r."""
    upto = Window.partitionBy("kind").orderBy("distance")
    share = F.sum("n").over(upto) / F.sum("n").over(Window.partitionBy("kind"))
    s = histograms.select("kind", "distance", or_nan(F.sum("n").over(Window.partitionBy("kind")) > 0, share).alias("share")).filter(F.col("distance").isin(*radii))
    return s.groupBy(F.col("distance").alias("r")).agg(F.max(F.when(F.col("kind") == "positive", F.col("share"))).alias("recall"), F.max(F.when(F.col("kind") == "negative", F.col("share"))).alias("fallout"))


def precision_at(histograms: DataFrame, radii: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """(r, recall, precision): tp / pairs and tp / (tp + fp) within distance r; precision is null where nothing is."""
    w = Window.orderBy("distance")
    wide = histograms.groupBy("distance").agg(F.sum(F.when(F.col("kind") == "positive", F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("kind") == "negative", F.col("n")).otherwise(0)).alias("q"))
    c = wide.select("distance", F.sum("p").over(w).alias("tp"), F.sum("q").over(w).alias("fp"), F.sum("p").over(Window.partitionBy(F.lit(0))).alias("all"))
    return c.filter(F.col("distance").isin(*radii)).select(F.col("distance").alias("r"), or_nan(F.col("all") > 0, F.col("tp") / F.col("all")).alias("recall"), F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def quick_result(triplets: DataFrame, entropies: DataFrame | None = None) -> DataFrame:
    """One row: n_pairs, median distances (truncated), n_codes and n_unique_codes over anchors and negatives; with (size, entropy) rows of tuples of bits also worst_entropies, a map by size."""
    d = triplet_distances(triplets).agg(F.count_if(F.col("kind") == "positive").alias("n_pairs"), F.percentile(F.when(F.col("kind") == "positive", F.col("distance")), 0.5).cast("int").alias("median_positive"), F.percentile(F.when(F.col("kind") == "negative", F.col("distance")), 0.5).cast("int").alias("median_negative"))
    codes = triplets.select(F.explode(F.array("anchor_fp", "negative_fp")).alias("fp")).agg(F.count("*").alias("n_codes"), F.count_distinct("fp").alias("n_unique_codes"))
    row = d.crossJoin(codes)
    return row if entropies is None else row.crossJoin(worst_entropies(entropies))


def quick_results_at(triplets: DataFrame, step: int, entropies: DataFrame | None = None) -> DataFrame:
    """A quick result as a fact row of its step; results of all steps make a table that is appended to and read back."""
    return quick_result(triplets, entropies).select(F.lit(step).cast("bigint").alias("step"), "*")


def worst_entropies(entropies: DataFrame, by: str = "size") -> DataFrame:
    """One row with a map from tuple size to the smallest entropy, not below 0, of (size, entropy) rows."""
    least = entropies.groupBy(by).agg(F.greatest(F.min("entropy"), F.lit(0.0)).alias("worst"))
    return least.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(by, "worst")))).alias("worst_entropies"))


# --- training logs ------------------------------------------------------------------------------------


def summarise_log(log: DataFrame, step: str = "step", value: str = "value", quantiles: tuple[float, ...] = (0.0, 0.05, 0.5, 0.95, 1.0)) -> DataFrame:
    """(step, n, max, mean, q0, q5, ...) with exact interpolated quantiles; steps without values have NaN."""
    v = F.col(value)
    some = F.count(v) > 0
    cols = [or_nan(some, F.percentile(v, q)).alias(f"q{round(q * 100)}") for q in quantiles]
    return log.groupBy(step).agg(F.count(v).alias("n"), or_nan(some, F.max(v)).alias("max_value"), or_nan(some, F.avg(v)).alias("mean_value"), *cols)


def dot_histogram(pairs: DataFrame, dot: str, k: int) -> DataFrame:
    """(bin, n) over 2k equal bins of [-k, k]; the ends' bins take what lies at or beyond them, so every number counts (null and NaN nowhere)."""
    x = F.col(dot)
    place = F.least(F.greatest(F.floor(x + k), F.lit(0)), F.lit(2 * k - 1)).cast("int")
    return dense_histogram(pairs.filter(x.isNotNull() & ~F.isnan(x)).select(place.alias("bin")), "bin", 2 * k - 1)


def merge_histograms(histograms: DataFrame, bin: str = "bin", n: str = "n") -> DataFrame:
    """Element-wise sum over batches."""
    return histograms.groupBy(bin).agg(F.sum(n).alias(n))
