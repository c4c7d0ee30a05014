import random

import pytest
from pyspark.sql import functions as F

from signfold.functions import codec
from signfold.operators import metrics, probing, sweep, wide

GRID = [(3, 1), (3, 4), (5, 2), (6, 1), (6, 7)]


def vectors(spark, seed, n, bits=6, labels=4):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, rng.randrange(labels), [rng.choice([-1, 1]) * rng.random() for _ in range(bits)]) for i in range(n)], "id bigint, label bigint, logits array<double>")


def test_sweep_equals_single_runs(spark):
    database, queries = vectors(spark, 1, 80), vectors(spark, 2, 25, labels=6).withColumnRenamed("id", "query_id")
    got = {(r.bits, r.probes): r for r in sweep.sweep(queries, database, GRID).collect()}
    assert set(got) == set(GRID)
    for bits, n in GRID:
        hits = probing.multi_probe_search(queries, database.select("id", codec.pack("logits", bits).alias("key")), n, bits).select("query_id", "id").collect()
        labels = {r.id: r.label for r in database.collect()}
        asked = {r.query_id: r.label for r in queries.collect()}
        found = {q: [r.id for r in hits if r.query_id == q] for q in asked}
        truth = {q: [i for i, v in labels.items() if v == lab] for q, lab in asked.items()}
        positive = [q for q in asked if truth[q]]
        right = {q: len(set(found[q]) & set(truth[q])) for q in asked}
        r = got[bits, n]
        assert r.n_queries == len(asked)
        assert r.recall == pytest.approx(sum(right[q] for q in positive) / sum(len(truth[q]) for q in positive))
        assert r.avg_jaccard == pytest.approx(sum(right[q] / len(set(found[q]) | set(truth[q])) for q in positive) / len(positive))
        assert r.perfect_rate == pytest.approx(sum(set(found[q]) == set(truth[q]) for q in positive) / len(positive))
        assert r.tpr == pytest.approx(sum(bool(found[q]) for q in positive) / len(positive))
        negative = [q for q in asked if not truth[q]]
        assert r.fpr == pytest.approx(sum(bool(found[q]) for q in negative) / len(negative))


def test_sweep_reads_each_side_once(spark, tmp_path):
    vectors(spark, 1, 30).write.parquet(f"{tmp_path}/d")
    vectors(spark, 2, 10).withColumnRenamed("id", "query_id").write.parquet(f"{tmp_path}/q")
    plan = sweep.sweep(spark.read.parquet(f"{tmp_path}/q"), spark.read.parquet(f"{tmp_path}/d"), GRID)._jdf.queryExecution().optimizedPlan().toString()
    # The queries once whatever the grid; the database for its codes (in two roll-ups, which share a shuffle) and its labels.
    assert plan.count("query_id#") > 0 and plan.count("/q") <= 1 and plan.count("Relation [query_id") == 1 and plan.count("Relation [id") == 3


@pytest.mark.parametrize("grid", [[], [(3, 1), (3, 1)], [(65, 1)], [(2, 5)], [(8, 11)]])
def test_bad_grids(spark, grid):
    with pytest.raises(ValueError):
        sweep.sweep(vectors(spark, 1, 3).withColumnRenamed("id", "query_id"), vectors(spark, 1, 3), grid)


def number(words, bits):
    out = 0
    for w, x in enumerate(words):
        n = min(64, bits - 64 * w)
        out = out << n | x & (1 << n) - 1
    return out


@pytest.mark.parametrize("bits", [5, 64, 70, 130])
def test_wide_probes(spark, bits):
    rng = random.Random(bits)
    rows = [(i, [rng.choice([-1.0, 1.0]) * rng.choice([0.5, 0.25, rng.random()]) for _ in range(bits)]) for i in range(20)]
    got = {}
    for r in wide.probes(spark.createDataFrame(rows, "query_id bigint, logits array<double>"), 6, bits).collect():
        got.setdefault(r.query_id, {})[r.rank] = number(r.words, bits)
    for i, x in rows:
        code = sum(1 << (bits - 1 - k) for k, v in enumerate(x) if v > 0)
        weak = sorted((abs(v), 1 << (bits - 1 - k)) for k, v in enumerate(x))[:5]
        sets = sorted((sum(c for c, _ in (w for j, w in enumerate(weak) if s >> j & 1)), sum(m for _, m in (w for j, w in enumerate(weak) if s >> j & 1))) for s in range(32))
        assert [got[i][r] for r in range(1, 7)] == [code ^ m for _, m in sets[:6]]


def test_wide_search(spark):
    rows = [(i, [1.0 if (i >> (k % 3)) & 1 else -1.0 for k in range(100)]) for i in range(16)]
    df = spark.createDataFrame(rows, "id bigint, logits array<double>")
    asked = wide.probes(df, 1, 100, "id")
    held = df.select("id", codec.pack_words("logits", 100).alias("words"))
    assert sorted((r.query_id, r.n_hits, r.min_id) for r in wide.probe_counts(asked, held, 100).collect()) == [(i, 2, i % 8) for i in range(16)]
    assert sorted((r.query_id, r.id) for r in wide.probe_search(asked, held, 100).collect()) == sorted((i, j) for i in range(16) for j in range(16) if i % 8 == j % 8)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_first_failures(spark, k):
    rng = random.Random(k)
    rows = [(rng.choice([0, 0, 0, 0, 1, 2]), i, rng.choice([7, 7, 7, 8, 9, None])) for i in range(300)]
    queries = [(q, rng.choice([0, 1, 2, 3]), rng.choice([7, 8, 9, 10, None])) for q in range(25)]
    got = metrics.first_failures(spark.createDataFrame(queries, "query_id bigint, key bigint, label bigint"), spark.createDataFrame(rows, "key bigint, id bigint, label bigint"), k)
    want = []
    for q, key, label in queries:
        irrelevant = [i for a, i, b in rows if a == key and b != label]
        missed = [i for a, i, b in rows if b == label and b is not None and a != key]
        want.append((q, irrelevant[:k], missed[:k]))
    assert sorted((r.query_id, r.irrelevant, r.missed) for r in got.collect()) == want
    with pytest.raises(ValueError):
        metrics.first_failures(got, got, 0)


def test_first_failures_keep_few_rows(spark):
    d = spark.range(1000).select(F.lit(1).alias("key"), "id", (F.col("id") % 3).alias("label"))
    plan = metrics.first_failures(spark.createDataFrame([(1, 1, 1)], "query_id bigint, key int, label bigint"), d, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4
