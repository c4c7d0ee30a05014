import numpy as np
import pytest
from pyspark.sql import functions as F

from signfold.operators import draws, querysets


def labels(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id bigint, label bigint")


@pytest.mark.parametrize("half", [1, 3, 7])
def test_permutation(spark, half):
    n = 1 << 2 * half
    got = [r.p for r in spark.range(n).select(draws.permuted(F.col("id"), half, 5).alias("p")).collect()]
    assert sorted(got) == list(range(n)) and (half < 3 or got != list(range(n)))


def test_permutation_is_made_once(spark):
    kept = spark.range(1000).select("id", draws.permuted(F.col("id"), 24, 5).alias("p")).filter("p < 100000000000000")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 1000 and plan.count("run(") == 1
    assert {(r.id, r.p) for r in kept.collect()} == {(i, p) for i, p in enumerate(draws.permute(np.arange(1000), 24, 5).tolist()) if p < 10**14}


def test_permutation_of_large_spaces(spark):
    got = spark.range(1000).select(draws.permuted(F.col("id") + F.lit((1 << 62) - 1000), 31, 5).alias("p")).agg(F.count_distinct("p").alias("n"), F.min("p").alias("lo"), F.max("p").alias("hi")).first()
    assert got.n == 1000 and got.lo >= 0 and got.hi < 1 << 62 and got.hi - got.lo > 1 << 61


@pytest.mark.parametrize("size", [0, (1 << 62) + 1])
def test_sizes(size):
    with pytest.raises(ValueError):
        draws.half_bits(size)


def test_exactly_n_absent_labels(spark):
    # 99 of 100 are taken, some of them often; all absent ones but two are asked for.
    taken = [i for i in range(3000) if i % 100] + [1] * 500 + [10**9, None]
    got = querysets.sample_absent(labels(spark, taken), 28, 3000, seed=1, least=10)
    values = [r.label for r in got.collect()]
    assert len(values) == len(set(values)) == 28 and all(v % 100 == 0 and 0 <= v < 3000 for v in values)
    assert sorted(r.query_id for r in got.collect()) == list(range(28))
    assert [tuple(r) for r in querysets.sample_absent(labels(spark, taken), 28, 3000, seed=1).orderBy("query_id").collect()] == [tuple(r) for r in got.orderBy("query_id").collect()]
    with pytest.raises(ValueError, match="only 30"):
        querysets.sample_absent(labels(spark, taken), 31, 3000, seed=1)
    assert querysets.sample_absent(labels(spark, taken), 0, 3000).count() == 0
    assert querysets.sample_absent(labels(spark, []), 5, 5).count() == 5


def test_tuples_are_uniform(spark):
    database = labels(spark, [10, 20, 30, 40] + [10] * 300)
    got = querysets.distinct_tuples(database, 2400, 3, seed=2)
    counts = {}
    for r in got.collect():
        counts[tuple(r.labels)] = counts.get(tuple(r.labels), 0) + 1
    assert len(counts) == 24 and all(len(set(t)) == 3 for t in counts) and min(counts.values()) > 60 and max(counts.values()) < 145
    whole = querysets.distinct_tuples(database, 50, 4).collect()
    assert all(sorted(r.labels) == [10, 20, 30, 40] for r in whole)
    with pytest.raises(ValueError):
        querysets.distinct_tuples(database, 1, 5)


def test_positive_draws(spark):
    database = labels(spark, [5] * 200 + [6, 7])
    got = querysets.sample_positive(database, 900, seed=3).groupBy("label", "first_id").count().collect()
    assert {(r.label, r.first_id) for r in got} == {(5, 0), (6, 200), (7, 201)} and all(240 < r["count"] < 360 for r in got)
    assert querysets.sample_positive(labels(spark, []), 5).collect() == []
