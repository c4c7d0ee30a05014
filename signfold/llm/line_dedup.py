"""Line dedup by a suffix array over line-ID sequences, built by distributed prefix doubling.

A document is the sequence of its lines (split at "\\n"; empty lines count). A line's ID is its content hash;
IDs get ranks by sorting the distinct ones. A doubling round ranks the pairs (rank of the run of h lines here, rank
of the run h lines on), so that after it ranks order suffixes by their first 2h lines. Only suffixes whose rank is
still shared, and which have 2h lines, go into a round: a rank that is unique is final, and so is that of a suffix
that ends here, for no longer run begins there. Rounds go on until no rank is shared. The first rounds stop at
min_lines on their way, so that runs of just so many lines have a depth of their own.

Suffixes of equal rank at depth h are neighbours in the array and form its intervals of longest common prefix >= h.
Of an interval the first occurrence by (document id, row, line) is the original, the others begin later copies of a
run of h lines. An interval counts if h >= min_lines, or if its run has least_words words (runs of non-space
characters), so that a long passage goes even as one or two lines. The deepest interval of a suffix gives its run;
overlapping and adjoining runs are merged into maximal ones, which are deleted.

Only DataFrame functions are used. Rows are named by numbers written with them, not by ids, which can be null or
repeat. Sorting acts on distinct IDs or pairs (pre-aggregated, so copies weigh nothing); ranks come from range
partitions and their offsets, never from one global window. Ranks go back to rows by spread_join(), which broadcasts
the few hot ones. The first occurrence of each interval, one row of it, is taken away by position, so no join meets
all members of an interval.

Defined results: null texts are empty ones, which are one empty line; a null id comes before all others; repeated
rows are rows of their own, the first one written being the original; a document with fewer than min_lines lines
loses runs of least_words words only; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, ident, numbered, restored, shuffle_width, spread_join, written

WORD = r"[^\x20\x09-\x0D]+"
PLACE = ["id", "row", "line"]


def dense_order(distinct: DataFrame, order: list[str], out: str, spent: list[DataFrame]) -> DataFrame:
    """distinct (columns `order` and n, the rows of each) with `out`: 1 + the number of rows that sort before it.

    Range partitions are numbered within and shifted by the totals of the partitions before, which are as many
    rows as there are partitions. spent: gets the table that the result reads.
    """
    spark = distinct.sparkSession
    parts = written(distinct.repartitionByRange(shuffle_width(spark), *order).withColumn("_part", F.spark_partition_id()), "order")
    spent.append(parts)
    totals = parts.groupBy("_part").agg(F.sum("n").alias("_total"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_shift"))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = parts.withColumn("_upto", F.sum("n").over(within))
    return ranked.join(F.broadcast(shift), "_part").select(*order, "n", (F.col("_shift") + F.col("_upto") - F.col("n") + 1).alias(out))


def line_positions(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, row, line, a, b, words): the 128-bit content hash of each line as two longs, and its number of words."""
    t = rows.select(ident(key).alias("id"), "row", F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("line", "t"))
    second = F.xxhash64(F.lit(7), F.col("t"), F.octet_length("t"))
    return t.select(*PLACE, F.xxhash64("t").alias("a"), second.alias("b"), F.regexp_count("t", F.lit(WORD)).alias("words"))


def later_copies(state: DataFrame, depth: int, counts: Column) -> DataFrame:
    """(row, line, reach) of the members of each interval of `state` but its first one, where `counts` holds; reach: the line after the run."""
    firsts = state.groupBy("rank").agg(F.min(F.struct(*PLACE)).alias("first")).select("first.*")
    return state.filter(counts).join(firsts, PLACE, "left_anti").select("row", "line", (F.col("line") + depth).alias("reach"))


def next_depth(depth: int, min_lines: int, counted: bool) -> int:
    """Lines that a round adds: below min_lines each depth counts if words do, else rounds double, past min_lines only from there."""
    if depth >= min_lines:
        return depth
    return 1 if counted else min(depth, min_lines - depth)


def repeated_runs(rows: DataFrame, min_lines: int = 3, least_words: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Later copies (row, line, reach): the run of lines from `line` up to `reach` also begins at an earlier place.

    rows: with a column `row` of distinct numbers. A suffix comes once for every depth at which it is a later copy; the
    largest reach is that of its deepest interval.
    """
    if min_lines < 1:
        raise ValueError("min_lines must be 1 at least")
    counted, spent = least_words is not None, []
    lines = written(line_positions(rows, key, text), "lines")
    alphabet = dense_order(lines.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1"), ["a", "b"], "rank", spent)
    # own: words of the first line, total: those of the run.
    ranked = spread_join(lines, alphabet, ["a", "b"], "n", lines.count())
    state = written(ranked.select(*PLACE, "rank", F.col("words").alias("own"), F.col("words").alias("total")), "ranks")
    discard(lines, *spent)
    depth, found = 1, []
    while True:
        if depth >= min_lines or counted:
            found.append(written(later_copies(state, depth, F.lit(True) if depth >= min_lines else F.col("total") >= least_words), "later"))
        step = next_depth(depth, min_lines, counted)
        follow = state.select("row", (F.col("line") - step).alias("line"), F.col("rank").alias("next"), F.col("total").alias("_rest"))
        pairs = state.join(follow, ["row", "line"]).select(*PLACE, "rank", "next", "own", (F.col("own") + F.col("_rest")).alias("total"))
        pairs = written(pairs, "pairs")
        n, spent = pairs.count(), [state, pairs]
        if n:
            order = dense_order(pairs.groupBy("rank", "next").agg(F.count("*").alias("n")).filter("n > 1"), ["rank", "next"], "deeper", spent)
            state = written(spread_join(pairs, order, ["rank", "next"], "n", n).select(*PLACE, F.col("deeper").alias("rank"), "own", "total"), "ranks")
        discard(*spent)
        if not n:
            break
        depth += step
    out = found[0] if found else lines.sparkSession.createDataFrame([], "row bigint, line int, reach int")
    for more in found[1:]:
        out = out.union(more)
    out.spent = found
    return out


def maximal_runs(found: DataFrame) -> DataFrame:
    """(row, start, stop) of the maximal runs of lines that later copies cover: overlapping and adjoining ones are merged."""
    in_order = Window.partitionBy("row").orderBy("line")
    before = F.max("reach").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    begins = found.withColumn("_begins", (F.col("line") > F.coalesce(before, F.lit(-1))).cast("int"))
    upto = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return begins.withColumn("_run", F.sum("_begins").over(upto)).groupBy("row", "_run").agg(F.min("line").alias("start"), F.max("reach").alias("stop")).select("row", "start", "stop")


def line_dedup(docs: DataFrame, min_lines: int = 3, key: str = "doc_id", text: str = "text", least_words: int | None = None) -> DataFrame:
    """Per row: key, kept text, n_lines, n_removed, n_runs and longest_run (maximal runs of removed lines, the lines of the longest). least_words: runs of fewer than min_lines lines go too if they have so many words."""
    rows = numbered(docs.select(ident(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("text")), "line-rows")
    found = repeated_runs(rows, min_lines, least_words, key)
    runs = maximal_runs(found).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("runs"))
    # Lines are split after the join, so that texts travel once.
    t = rows.join(runs, "row", "left").withColumn("lines", F.split("text", "\n", -1))
    gone = F.flatten(F.transform("runs", lambda r: F.sequence(r.start, r.stop - 1)))
    t = t.withColumn("gone", F.coalesce(gone, F.array().cast("array<int>")))
    # Set operations on line numbers, so that long documents cost no more than their length.
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    left = F.concat_ws("\n", F.transform(stay, lambda i: F.element_at("lines", i + 1)))
    untouched = F.col("runs").isNull()
    longest = F.array_max(F.transform("runs", lambda r: r.stop - r.start))

    def number(c: Column, name: str) -> Column:
        return F.when(untouched, F.lit(0)).otherwise(c).cast("bigint").alias(name)

    kept = F.when(untouched, F.col("text")).otherwise(left).alias("text")
    out = t.select(key, kept, F.size("lines").cast("bigint").alias("n_lines"), number(F.size("gone"), "n_removed"), number(F.size("runs"), "n_runs"), number(longest, "longest_run"))
    out = restored(out, key)
    out.spent = [rows, *found.spent]
    return out
