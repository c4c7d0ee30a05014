import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from signfold.operators import bootstrap, quantiles

QS = (0.0, 0.05, 0.25, 0.5, 0.95, 1.0)


def check(spark, rows, qs=QS):
    got = {r.step: r for r in quantiles.grouped_quantiles(spark.createDataFrame(rows, "step bigint, value double"), "step", "value", qs).collect()}
    groups = {}
    for step, v in rows:
        groups.setdefault(step, []).append(v)
    assert set(got) == set(groups)
    for step, values in groups.items():
        values = [v for v in values if v is not None]
        assert got[step].n == len(values)
        for q in qs:
            have = got[step][f"q{round(q * 100)}"]
            if not values:
                assert math.isnan(have)
                continue
            ordered = sorted(values, key=lambda v: (math.isnan(v), v))
            h = q * (len(ordered) - 1)
            low, high = ordered[math.floor(h)], ordered[math.ceil(h)]
            want = low if low == high else low + (high - low) * (h - math.floor(h))
            assert have == want or math.isnan(have) and math.isnan(want), (step, q)


def test_as_sorted(spark):
    rng = random.Random(2)
    rows = [(rng.choice([0, 0, 0, 0, 1, 2, None]), rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e-300), rng.randrange(5) * 1.0, None, 1e300 * rng.random()])) for _ in range(3000)]
    check(spark, rows + [(9, None), (8, 3.5), (7, -2.0), (7, -2.0)])


def test_special_values(spark):
    inf = float("inf")
    check(spark, [(1, -inf), (1, inf), (1, inf), (2, -inf), (2, -inf), (3, float("nan")), (3, 1.0), (3, 2.0), (4, 0.0), (4, -0.0), (4, 5e-324), (4, -5e-324)], (0.0, 0.5, 1.0))


def test_many_active_groups(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BROADCAST_ROWS", 0)
    rng = random.Random(4)
    check(spark, [(rng.randrange(30), rng.random()) for _ in range(500)])


def test_empty(spark):
    assert quantiles.grouped_quantiles(spark.createDataFrame([], "step bigint, value double"), "step", "value").collect() == []
    with pytest.raises(ValueError):
        quantiles.grouped_quantiles(spark.createDataFrame([], "step bigint, value double"), "step", "value", (1.5,))


def test_bootstrap(spark):
    rng = np.random.default_rng(0)
    values = rng.integers(0, 100, 4000)
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(values)] + [(-1, None)], "id bigint, v bigint")
    r = bootstrap.bootstrap_interval(df, "v", "id", 400, 0.05, seed=1).first()
    error = values.std() / math.sqrt(len(values))
    assert r.low < values.mean() < r.high and 0.8 < (r.high - r.low) / (2 * 1.96 * error) < 1.2
    copies = bootstrap.replicates(df, "v", "id", 50, seed=2).agg(F.avg("n").alias("n"), F.stddev("n").alias("s")).first()
    assert abs(copies.n - 4000) < 40 and 35 < copies.s < 95
    none = bootstrap.bootstrap_interval(df.filter("v IS NULL"), "v", "id", 10).first()
    assert math.isnan(none.low) and math.isnan(none.high)


def test_copies_are_poisson(spark):
    n = 200_000
    got = {r.w: r.n / n for r in spark.range(n).select(bootstrap.copies(bootstrap.uniform31(F.col("id"), F.lit(3).cast("bigint"), 7)).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    for k in range(5):
        assert abs(got[k] - math.exp(-1) / math.factorial(k)) < 0.004
    # Two replicates of the same rows are not alike.
    w = [bootstrap.copies(bootstrap.uniform31(F.col("id"), F.lit(k).cast("bigint"), 7)).alias(f"w{k}") for k in (3, 4)]
    assert abs(spark.range(n).select(*w).agg(F.corr("w3", "w4").alias("c")).first().c) < 0.02
