"""Secret scans with an incremental blob ledger.

Every historical version of a path is content-addressed by SHA-256. A ledger table holds, for each pair of blob
and rule version that has been scanned, its findings (none included). A scan reads the ledger, takes the blobs
whose pair is not in it, scans each such blob once, appends to the ledger, and joins the findings of all blobs
back to all paths that hold them. Only DataFrame functions are used.

Rules (fixed values): see RULES. Matches are leftmost and non-overlapping for each kind, positions are code
points, ends exclusive; a match that fails its minimum is dropped after it has consumed its text. The rule version is
a hash of RULES.

Defined results: null ids stay null and are told apart by their texts; null texts are empty and have no findings; repeated rows each get the findings of their blob;
empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import restored, scratch, texts

#: kind: pattern, group whose length counts, least length. Fixed values.
RULES = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}


def rule_version() -> str:
    """A hash of all that findings depend on: any change of RULES makes every blob unseen."""
    return hashlib.sha256(repr(sorted(RULES.items())).encode()).hexdigest()[:32]


PIECES = "array<struct<m:bigint,c:bigint,g:bigint>>"
SPAN = "array<struct<start:bigint,kind_no:int,kind:string,stop:bigint>>"


def pieces_of(text: Column, kind: str) -> Column:
    """(m, c, g) of each match of one rule: its length, that of the group that counts, and the gap before it. What lies between matches comes from a split at the same pattern."""
    pattern, group, _ = RULES[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    both = F.zip_with(found, counted, lambda m, c: F.struct(F.length(m).cast("bigint").alias("m"), F.length(c).cast("bigint").alias("c")))
    triples = F.zip_with(both, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda x, g: F.struct(x.m.alias("m"), x.c.alias("c"), F.length(g).cast("bigint").alias("g")))
    return F.when(F.regexp_like(text, F.lit(pattern)), triples).otherwise(F.array().cast(PIECES))


def blobs(versions: DataFrame, key: str, text: str) -> DataFrame:
    t = texts(versions, key, text)
    return t.select(key, F.unhex(F.sha2("text", 256)).alias("blob"), "text")


def scan_blobs(unseen: DataFrame) -> DataFrame:
    """(blob, text) to ledger rows.

    Matches become rows, and running sums of gaps and lengths give their places, so a text's work grows with its
    matches and not with their square. A row of no rule stands for each blob, so those without findings stay.
    """
    kinds = [F.struct(F.lit(no).alias("kind_no"), F.lit(kind).alias("kind"), pieces_of(F.col("text"), kind).alias("pieces")) for no, kind in enumerate(RULES)]
    none = F.struct(F.lit(-1).alias("kind_no"), F.lit("").alias("kind"), F.array(F.struct(*[F.lit(0).cast("bigint").alias(c) for c in "mcg"])).alias("pieces"))
    by_kind = unseen.select("blob", F.explode(F.array(none, *kinds)).alias("k")).select("blob", "k.kind_no", "k.kind", F.posexplode("k.pieces").alias("j", "p"))
    stop = F.sum(F.col("p.g") + F.col("p.m")).over(Window.partitionBy("blob", "kind_no").orderBy("j"))
    # Dealt by blob, which serves all that follows. Rows that repeat both id and text are read each, and their matches met here as one.
    placed = by_kind.repartition("blob").dropDuplicates(["blob", "kind_no", "j"]).select("blob", "kind_no", "kind", "p", stop.alias("stop"))
    least = F.element_at(F.array(*[F.lit(n) for _, _, n in RULES.values()]), F.greatest("kind_no", F.lit(0)) + 1)
    span = F.struct((F.col("stop") - F.col("p.m")).alias("start"), "kind_no", "kind", "stop")
    hit = (F.col("kind_no") >= 0) & (F.col("p.c") >= least)
    return placed.groupBy("blob").agg(F.sort_array(F.collect_list(F.when(hit, span))).alias("spans")).select("blob", F.lit(rule_version()).alias("rule_version"), "spans")


def ledger_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """(blob, spans) that the ledger has for the rules as they are; None where there is no ledger yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.parquet(path).filter(F.col("rule_version") == rule_version()).select("blob", "spans")


def extend(versions: DataFrame, ledger: str, key: str = "doc_id", text: str = "text") -> None:
    """Scan the blobs of versions that the ledger has not seen under these rules, each once, and append them."""
    rows = blobs(versions, key, text)
    # One version stands for each blob: ids only are grouped, so copies meet as partial minima.
    owners = rows.groupBy("blob").agg(F.min(key).alias(key))
    seen = ledger_rows(versions.sparkSession, ledger)
    if seen is not None:
        owners = owners.join(seen.select("blob"), "blob", "left_anti")
    unseen = rows.join(owners, [key, "blob"], "left_semi").select("blob", "text")
    scan_blobs(unseen).write.mode("append").parquet(ledger)


def secret_scan(versions: DataFrame, key: str = "doc_id", text: str = "text", ledger: str | None = None) -> DataFrame:
    """Per row of versions: key, blob and spans (sorted by start, then by kind as listed).

    ledger: path of the ledger table, in storage that all executors share; pairs found in it are not scanned
    again, new ones are appended. Without one, a new ledger is laid down in the shared folder. Extra columns of
    the ledger are ignored.
    """
    spark = versions.sparkSession
    path = ledger or scratch(spark, "ledger")
    extend(versions, path, key, text)
    known = ledger_rows(spark, path).filter(F.size("spans") > 0)
    out = blobs(versions, key, text).select(key, "blob").join(known.dropDuplicates(["blob"]), "blob", "left").select(key, "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))
    out = restored(out, key)
    if not ledger:
        known.scratch_path = path
        out.spent = [known]
    return out


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.stop)), ",")
