r"""Phrase collocation mining.

All runs of 1 to max_n words are exploded into rows (language, phrase, occurrences) and summed by language and phrase;
phrases of `least` occurrences or more are candidates. A candidate of a occurrences that is cut after its
first k words has the score floor(SCALE * a * a / (l * r)), l and r the counts of its two parts, in exact decimals; its lowest cut
counts. Candidates that a phrase of one word more contains `share` percent of the time or more are dropped, and the
best `top` of each language are returned.

* No part of a candidate is rarer than it is, so the phrases of `least` occurrences hold all parts as well; one
  table of them, written once, serves the candidates, both joins of counts and the anti-join.
* A longer phrase that contains a candidate has a part of one word more than the candidate which contains it and is as frequent at
  least, so extensions by one word are enough for longer ones of any length.
* Frequent words begin or end a large share of all candidates: their rows are split by a hash of the candidate.
* The best of a language are found in rounds, each of which keeps `top` rows of a group: first of groups by a hash of the
  phrase, at last of the language, so that no task sorts all candidates of a language.
* Exploding runs over Arrow batches: a row stands for all occurrences of a phrase in about STEP bytes of texts, which
  takes half the time of a row for each of them (README). A text is never cut; a longer one is a step of its own.

Lower-case: A-Z only. Pieces: the text split at `[.,;:!?\x0A-\x0D]`; words: `[^\x20\x09]+` of a piece.

Defined results: null and empty texts have no words; a null language counts as `und`, together with rows that say so;
repeated rows count each; languages without candidates have no rows; an empty table gives an empty result; extra
columns are ignored. Ties of the score go to more occurrences, then to the smaller phrase in UTF-8 byte order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import HOT_SHARE, gathered, salted_join, utf8, written

#: Characters that end a piece, and those that end a word only; fixed values, all of one byte.
ENDS = b".,;:!?\n\x0b\x0c\r"
SPACES = b" \t"
SCALE = 1_000_000
#: Bytes of texts whose phrases are counted together before they become rows.
STEP = 2 << 20
#: Exact up to counts of 16 digits: SCALE * a * a has 38 at most.
COUNT = "decimal(16,0)"
#: Groups of a language in each round of the choice of the best.
ROUNDS = (1024, 32, 1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_END, _IS_WORD = np.zeros(256, dtype=bool), np.ones(256, dtype=bool)
_IS_END[np.frombuffer(ENDS, np.uint8)] = True
_IS_WORD[np.frombuffer(ENDS + SPACES, np.uint8)] = False
ROWS = pa.schema([("key", pa.string()), ("n", pa.int64())])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of the texts data[offsets[i]:offsets[i + 1]], the text of each, and whether it begins a piece."""
    data = _LOWER[data[offsets[0] : offsets[-1]]]
    edges = offsets - offsets[0]
    inside = np.concatenate((_IS_WORD[data], [False]))
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[edges] = True
    starts = np.flatnonzero(inside[:-1] & (cut[:-1] | ~np.concatenate(([False], inside[:-2])))) if len(data) else np.zeros(0, np.int64)
    stops = np.flatnonzero(inside[:-1] & (cut[1:] | ~inside[1:])) + 1 if len(data) else starts
    ends = np.concatenate(([0], np.cumsum(_IS_END[data])))[starts]
    text = np.searchsorted(edges, starts, side="right") - 1
    first = np.ones(len(starts), dtype=bool)
    first[1:] = (ends[1:] != ends[:-1]) | (text[1:] != text[:-1])
    letters = data[inside[:-1]]
    places = np.concatenate(([0], np.cumsum(stops - starts))).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(letters)), text, first


def counted(langs: pa.Array, column: pa.Array, max_n: int) -> Iterator[pa.RecordBatch]:
    """(key, n) of all runs of 1 to max_n words, one batch for each length."""
    found, text, first = words(*utf8(column))
    if not len(found):
        return
    coded, named = found.dictionary_encode(), langs.fill_null("und").cast(pa.large_string()).dictionary_encode()
    code, n_words = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    # The piece of each word; a run of k words is one if its first and last word are of the same piece.
    piece, at = np.cumsum(first, dtype=np.int32), np.arange(len(code), dtype=np.int32)
    key, lang, parts = named.indices.to_numpy().astype(np.int64)[text] * n_words + code, np.arange(len(named.dictionary)), []
    for k in range(1, max_n + 1):
        if k > 1:
            # A run is the run of one word less that it begins with, by its number, and its last word.
            whole = at + k - 1 < len(code)
            at, key = at[whole], key[whole]
            whole = piece[at + k - 1] == piece[at]
            at, key = at[whole], key[whole]
            key = key * n_words + code[at + k - 1]
            if not len(at):
                return
        if k < max_n:
            run, number, counts = np.unique(key, return_inverse=True, return_counts=True)
            key = number.reshape(-1)
        else:
            run, counts = np.unique(key, return_counts=True)
        begun, last = np.divmod(run, n_words)
        lang, parts = lang[begun], [*[p[begun] for p in parts], last]
        strings = [coded.dictionary.take(pa.array(p)) for p in parts]
        phrase = pc.binary_join_element_wise(*strings, pa.scalar(" ", pa.large_string())) if k > 1 else strings[0]
        joined = pc.binary_join_element_wise(phrase, named.dictionary.take(pa.array(lang)), pa.scalar("\n", pa.large_string()))
        yield pa.RecordBatch.from_arrays([joined.cast(pa.string()), pa.array(counts.astype(np.int64))], schema=ROWS)


def phrases(docs: DataFrame, max_n: int, text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, n): a row for each phrase of a step, n its occurrences there. Phrase and language are one string: no word has a line feed, so the first one ends the phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in gathered(batches, 1, STEP):
            yield from counted(held.column(0), held.column(1), max_n)

    asked = docs.select(F.col(lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return asked.mapInArrow(run, "key string, n bigint")


def words_in(phrase: str) -> Column:
    return F.length(phrase) - F.length(F.replace(phrase, F.lit(" "), F.lit(""))) + 1


def words_of(count: Column) -> Column:
    """The first `count` words of the phrase, or the last ones if it is negative."""
    return F.call_function("substring_index", F.col("phrase"), F.lit(" "), count)


def best(df: DataFrame, top: int) -> DataFrame:
    """The first `top` of each lang with their rank."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for groups in ROUNDS:
        by = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(groups))) if groups > 1 else Window.partitionBy("lang")
        df = df.withColumn("rank", F.row_number().over(by.orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    return df


def collocations(docs: DataFrame, max_n: int = 3, least: int = 10, share: int = 50, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of 2 to max_n words of each language."""
    if max_n < 2 or least < 1:
        raise ValueError("phrases of two words or more and counts of one or more are needed")
    counts = phrases(docs, max_n, text, lang).groupBy("key").agg(F.sum("n").alias("f"))
    at = F.instr("key", "\n")
    counts = counts.select(F.substring(F.col("key"), at + 1, F.length("key")).alias("lang"), F.substring(F.col("key"), F.lit(1), at - 1).alias("phrase"), "f")
    # Rare phrases go into one row of each language, which holds how many of the occurrences are of rare words.
    rare = F.col("f") < least
    one_word = F.instr("phrase", " ") == 0
    folded = counts.groupBy("lang", F.when(~rare, F.col("phrase")).alias("phrase")).agg(F.sum(F.when(~rare | one_word, F.col("f")).otherwise(0)).alias("f"))
    known = written(folded.withColumn("n_words", words_in("phrase")), "phrases")
    totals = known.filter("phrase IS NULL OR n_words = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = known.filter("phrase IS NOT NULL")
    hot = max(least, int((totals.agg(F.sum("n").alias("n")).first().n or 0) * HOT_SHARE) + 1)

    # A row for each cut and side of a candidate; the counts of its parts come by one join.
    a = frequent.filter("n_words > 1").select("lang", "phrase", F.col("f").alias("a"), "n_words")
    sides = [F.when(F.col("n_words") > k, F.struct(F.lit(k).alias("k"), F.lit(i).alias("side"), part.alias("part"))) for k in range(1, max_n) for i, part in enumerate((words_of(F.lit(k)), words_of(k - F.col("n_words"))))]
    asked = a.select("lang", "phrase", "a", F.explode(F.array_compact(F.array(*sides))).alias("s")).select("lang", "phrase", "a", "s.k", "s.side", "s.part")
    met = salted_join(asked, frequent.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f")), ["lang", "part"], "part_f", hot, "phrase")

    def of_cut(k: int, side: int) -> Column:
        return F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("part_f")))

    cuts = met.groupBy("lang", "phrase", "a").agg(*[of_cut(k, side).alias(f"f{k}_{side}") for k in range(1, max_n) for side in (0, 1)])

    def score(k: int) -> Column:
        x, y, z = (F.col(c).cast(COUNT) for c in ("a", f"f{k}_0", f"f{k}_1"))
        return F.struct(F.call_function("div", x * x * F.lit(SCALE).cast("decimal(7,0)"), y * z).alias("score"), F.lit(k).alias("k"), F.col(f"f{k}_0").alias("l"), F.col(f"f{k}_1").alias("r"))

    lowest = F.array_min(F.array_compact(F.array(*[F.when(F.col(f"f{k}_0").isNotNull(), score(k)) for k in range(1, max_n)])))
    scored = cuts.select("lang", "phrase", "a", lowest.alias("s")).select("lang", "phrase", "a", "s.l", "s.r", "s.score")
    # What a phrase of one word more contains often enough: its two parts of one word less.
    shorter = F.array_distinct(F.array(words_of(F.col("n_words") - 1), words_of(1 - F.col("n_words"))))
    longer = frequent.filter("n_words > 2").select("lang", F.explode(shorter).alias("phrase"), "f")
    widest = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer_f"))
    alone = scored.join(widest, ["lang", "phrase"], "left").filter(F.col("longer_f").isNull() | (100 * F.col("longer_f") < share * F.col("a"))).drop("longer_f")
    out = best(alone, top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    out.spent = [known]
    return out
