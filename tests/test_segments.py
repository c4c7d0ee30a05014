import random

import pytest
from pyspark.sql import functions as F

from signfold.operators import ranking, segments


def frame(spark, rows):
    return spark.createDataFrame(rows, "key bigint, id bigint, label string") if rows else spark.createDataFrame([], "key bigint, id bigint, label string")


def brute(rows, length):
    by = {}
    for key, i, _ in rows:
        by.setdefault(key, []).append(i)
    return sorted(((k, s, sorted(ids)[s * length], sorted(ids)[s * length:(s + 1) * length]) for k, ids in by.items() for s in range(-(-len(ids) // length))), key=repr)


def held(df):
    return sorted(((r.key, r.segment, r.first_id, r.ids) for r in df.collect()), key=repr)


@pytest.mark.parametrize("length", [1, 7, 100, 10_000])
def test_as_sorted_lists(spark, length):
    rng = random.Random(length)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, 4, None, -5]), rng.randrange(200), "x") for _ in range(700)]
    assert held(segments.segments(frame(spark, rows).repartition(5), length)) == brute(rows, length)


def test_large_bucket_is_many_tasks(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 10 == 0, -1).otherwise(F.col("id") % 977).cast("bigint").alias("key"), "id")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = segments.segments(rows, 50)
        mine = got.filter("key = -1")
        tasks = mine.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
        assert mine.count() == 80 and len(tasks) > 8 and max(r["count"] for r in tasks) < 20
        parts = got.spent[0].filter("key = -1").select(ranking.partition_of("at").alias("p")).distinct().count()
        assert parts >= 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_pages_and_sizes(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3]), i, "x") for i in range(300)]
    held_rows = segments.segments(frame(spark, rows), 16)
    queries = spark.createDataFrame([(10, 1), (11, 1), (12, 2), (13, 99)], "query_id bigint, key bigint")
    got = sorted(tuple(r) for r in segments.page(queries, held_rows, 20, 45, 16).collect())
    ids = {k: sorted(i for key, i, _ in rows if key == k) for k in (1, 2, 99)}
    assert got == sorted((q, p, ids[k][p]) for q, k in ((10, 1), (11, 1), (12, 2), (13, 99)) for p in range(20, 45) if p < len(ids[k]))
    assert sorted(tuple(r) for r in segments.bucket_sizes(held_rows).collect()) == sorted((k, sum(r[0] == k for r in rows), min(r[1] for r in rows if r[0] == k)) for k in (1, 2, 3))
    assert segments.page(queries, held_rows, 5, 5, 16).collect() == []
    with pytest.raises(ValueError):
        segments.page(queries, held_rows, 6, 5, 16)


def test_empty(spark):
    assert held(segments.segments(frame(spark, []))) == []
    with pytest.raises(ValueError):
        segments.segments(frame(spark, []), 0)


def test_positions(spark):
    rng = random.Random(1)
    values = [(rng.choice([None, *range(50)]), i) for i in range(500)]
    got = ranking.positions(spark.createDataFrame(values, "v int, i int").repartition(7), F.desc("v"), "i")
    want = sorted(values, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [(r.v, r.i) for r in sorted(got.collect(), key=lambda r: r.position)] == want
    assert sorted(r.position for r in got.collect()) == list(range(500))
