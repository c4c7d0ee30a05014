"""Inputs of the registered queries, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import pack
from ..operators import draws
from ..operators.querysets import triplets

#: Base of the two-cell label keys; above every supplier key up to scale 1000.
BASE = 10_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, key): customers as labels under 12-bit fingerprints with collisions; every seventh row has a flipped bit."""
    o = table(spark, sf_dir, "orders")
    clean = F.shiftright(F.col("o_custkey") * F.lit(2654435761), 8).bitwiseAND(F.lit(4095).cast("bigint"))
    flip = F.when(F.col("o_orderkey") % 7 == 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("o_orderkey") % 12).cast("int"))).otherwise(F.lit(0).cast("bigint"))
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("label"), clean.bitwiseXOR(flip).alias("key"))


def split(spark: SparkSession, sf_dir: str, negatives: bool = False) -> tuple[DataFrame, DataFrame]:
    """(queries with query_id, database): every tenth order asks; with negatives some labels are only asked for."""
    o = orders(spark, sf_dir)
    database = o.filter("id % 10 <> 3")
    if negatives:
        database = database.filter("label % 10 <> 9")
    return o.filter("id % 10 = 3").withColumnRenamed("id", "query_id"), database


def mosaics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label_key, first_id, n): two-cell keys of part and supplier, each once."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * F.lit(BASE).cast("bigint") + F.col("l_suppkey")).alias("label_key"), "l_orderkey")
    return li.groupBy("label_key").agg(F.min("l_orderkey").alias("first_id"), F.count("*").alias("n"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, key) of line items: suppliers as keys, and one bucket of a tenth of all rows (quantities of 5 or less)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_quantity") <= 5, F.lit(0).cast("bigint")).otherwise(F.col("l_suppkey").cast("bigint")).alias("key"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a_id, b_id, a, b, similar): vectors of neighbouring ids."""
    v = vectors(spark, sf_dir)
    b = v.select((F.col("id") - 1).alias("id"), F.col("id").alias("b_id"), F.col("embedding").alias("b"), F.col("label").alias("bl"))
    return v.join(b, "id").select(F.col("id").alias("a_id"), "b_id", F.col("embedding").alias("a"), "b", F.when(F.col("label") == F.col("bl"), F.lit(1)).otherwise(F.lit(0)).alias("similar"))


def triplet_codes(spark: SparkSession, sf_dir: str, bits: int = 64) -> DataFrame:
    """(anchor_fp, positive_fp, negative_fp) of vectors."""
    v = vectors(spark, sf_dir)
    codes = v.select("id", pack("embedding", bits).alias("fp"))
    t = triplets(v.select("id", "label"))
    for name in ("anchor", "positive", "negative"):
        t = t.join(codes.select(F.col("id").alias(f"{name}_id"), F.col("fp").alias(f"{name}_fp")), f"{name}_id")
    return t.select("anchor_fp", "positive_fp", "negative_fp")


ORD = """ord AS (SELECT o_orderkey AS id, o_custkey AS label,
  xor(((o_custkey * 2654435761) >> 8) & 4095, CASE WHEN o_orderkey % 7 = 0 THEN (1::BIGINT) << (o_orderkey % 12) ELSE 0::BIGINT END) AS key FROM orders)"""
SPLIT = ORD + ", q AS (SELECT id AS query_id, label, key FROM ord WHERE id % 10 = 3), d AS (SELECT * FROM ord WHERE id % 10 <> 3)"
NEGATIVES = ORD + ", q AS (SELECT id AS query_id, label, key FROM ord WHERE id % 10 = 3), d AS (SELECT * FROM ord WHERE id % 10 <> 3 AND label % 10 <> 9)"
MOSAICS = f"mos AS (SELECT l_partkey * {BASE}::BIGINT + l_suppkey AS label_key, min(l_orderkey) AS first_id, count(*) AS n FROM lineitem GROUP BY 1)"
POSTINGS = "post AS (SELECT l_orderkey * 8 + l_linenumber AS id, CASE WHEN l_quantity <= 5 THEN 0::BIGINT ELSE l_suppkey::BIGINT END AS key FROM lineitem)"
EMB = "emb AS (SELECT vec_id AS id, label, embedding FROM embeddings)"
PAIRS = EMB + ", pairs AS (SELECT a.id AS a_id, b.id AS b_id, a.embedding AS a, b.embedding AS b, CASE WHEN a.label = b.label THEN 1 ELSE 0 END AS sim FROM emb a JOIN emb b ON b.id = a.id + 1)"


def packed(bits: int, vector: str = "embedding", start: int = 1) -> str:
    """SQL of a fingerprint of fewer than 64 bits."""
    return f"list_reduce(list_prepend(0::BIGINT, [CASE WHEN v > 0 THEN 1::BIGINT ELSE 0::BIGINT END for v in {vector}[{start}:{start + bits - 1}]]), lambda s, x: s * 2 + x)"


def distance(a: str, b: str, bits: int = 64) -> str:
    return f"CAST(list_sum([CASE WHEN ({a}[i] > 0) <> ({b}[i] > 0) THEN 1 ELSE 0 END for i in range(1, {bits + 1})]) AS INTEGER)"


TRIPLETS = (
    EMB
    + ", pos AS (SELECT id AS a_id, lead(id) OVER (PARTITION BY label ORDER BY id) AS p_id, label FROM emb)"
    + ", tri AS (SELECT a.embedding AS a, p.embedding AS p, n.embedding AS n FROM pos JOIN emb a ON a.id = a_id JOIN emb p ON p.id = p_id JOIN emb n ON n.id = a_id + 1 AND n.label <> pos.label)"
    + f", dist AS (SELECT 'positive' AS kind, {distance('a', 'p')} AS distance FROM tri UNION ALL SELECT 'negative', {distance('a', 'n')} FROM tri)"
)


def permutation(source: str, half: str, seed: int) -> str:
    """SQL tables p0, p1, ... of the permutation of draws.permuted for the numbers of `source` (number, and the columns of half); the last has (number, label)."""
    mask = f"((1::BIGINT << ({half})) - 1)"
    out = [f"p0 AS (SELECT *, number >> ({half}) AS l, number & {mask} AS r FROM {source})"]
    for i, key in enumerate(draws.round_keys(seed)):
        x = f"(r * {draws.FIRST}::BIGINT + {key}::BIGINT)"
        out.append(f"p{i + 1} AS (SELECT * EXCLUDE (l, r), r AS l, xor(l, (((xor({x} >> 13, {x}) & {draws.LOW31}) * {draws.SECOND}::BIGINT) >> 14) & {mask}) AS r FROM p{i})")
    out.append(f"perm AS (SELECT * EXCLUDE (l, r), (l << ({half})) | r AS label FROM p{len(out) - 1})")
    return ", ".join(out)


def drawn(bound: str, seed: int, *numbers: str) -> str:
    """SQL of draws.draw."""
    return f"(CAST('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(numbers)})), 1, 15) AS BIGINT) % ({bound}))"


def half_bits(size: str) -> str:
    return f"greatest(1, CAST(ceil(log2({size}) / 2) AS BIGINT))"
