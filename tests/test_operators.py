import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from signfold.functions import codec
from signfold.operators import entropy, index, intervals, metrics, probing, querysets


def codes(spark, rows):
    return spark.createDataFrame(rows, "id bigint, key bigint, label bigint")


def test_index_against_dictionaries(spark):
    r = random.Random(1)
    rows = [(i, r.randint(0, 20), r.randint(0, 5)) for i in range(200)]
    df = codes(spark, rows)
    held = {}
    for i, k, _ in rows:
        held.setdefault(k, []).append(i)
    queries = spark.createDataFrame([(q, q) for q in range(25)], "query_id bigint, key bigint")
    assert {x.query_id: x.ids for x in index.lookup_ids(queries, df).collect()} == {q: held.get(q, []) for q in range(25)}
    few = index.lookup_ids(queries, df, broadcast_rows=100)
    assert {x.query_id: x.ids for x in few.collect()} == {q: held.get(q, []) for q in range(25)} and "Broadcast" in few._jdf.queryExecution().executedPlan().toString()
    assert index.lookup_ids(queries, df, broadcast_rows=3).count() == 25
    assert {x.query_id: x.n_hits for x in index.lookup_counts(queries, df).collect()} == {q: len(held.get(q, [])) for q in range(25)}
    assert [x.id for x in index.point_lookup(df, 7).collect()] == held[7]
    assert {x.key: (x.n, x.repr_id, x.sum_ids, x.ids) for x in index.buckets(df, with_ids=True).collect()} == {k: (len(v), v[0], sum(v), v) for k, v in held.items()}
    pairs = sum(a[1] == b[1] and a[2] != b[2] for a, b in itertools.combinations(rows, 2))
    assert index.internal_collisions(df).first().collisions == pairs == index.collision_pairs(df).count()
    assert index.internal_collisions(df).first().max_collisions == 200 * 199 // 2
    assert index.internal_collisions(df.limit(0)).first().collisions == 0
    assert index.internal_collisions(codes(spark, [(0, 1, 1), (1, 1, 1), (2, 1, 2), (3, 9, 2)])).first().collisions == 2


def test_lists_are_shuffled_once(spark):
    """No exchange is above the join that deals a bucket's list to its queries, so lists are not moved for each query."""
    df = codes(spark, [(i, i % 3, i % 4) for i in range(60)])
    queries = spark.createDataFrame([(q, q % 4 if q < 90 else None, q % 5) for q in range(100)], "query_id bigint, key bigint, label bigint")
    for got in (index.lookup_ids(queries, df), querysets.ground_truth(queries, df, with_ids=True)):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Join") == 1 and "Exchange" not in plan[: plan.index("Join")]
    held = {k: ",".join(str(i) for i in range(60) if i % 3 == k) for k in range(3)}
    text = index.lookup_ids(queries, df, form=lambda ids: F.array_join(F.transform(ids, lambda x: x.cast("string")), ","))
    assert {x.query_id: x.ids for x in text.collect()} == {q: held.get(q % 4, "") if q < 90 else "" for q in range(100)}
    assert {x.query_id: x.truth for x in querysets.ground_truth(queries, df, with_ids=True).collect()} == {q: [i for i in range(60) if i % 4 == q % 5] for q in range(100)}


def test_index_table_needs_no_shuffle(spark):
    df = codes(spark, [(i, i % 9, 0) for i in range(50)])
    index.save_index(index.build_index(df, "key"), "saved_index", buckets=4, mode="overwrite")
    plan = spark.table("saved_index").groupBy("key").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    with pytest.raises(Exception, match="(?i)exists"):
        index.save_index(index.build_index(df, "key"), "saved_index")
    with pytest.raises(ValueError):
        index.save_index(df, "x", mode="r+")
    spark.sql("DROP TABLE saved_index")


def test_hamming_join_as_nested_loop(spark):
    r = random.Random(3)
    rows = [(i, r.getrandbits(20)) for i in range(60)] + [(100, 5), (101, 5)]
    rows += [(200 + i, rows[i][1] ^ (1 << r.randrange(20)) ^ (1 << r.randrange(20))) for i in range(30)]
    df = spark.createDataFrame(rows, "id bigint, fp bigint")
    for radius in (0, 1, 3):
        want = {(a, b, bin(x ^ y).count("1")) for a, x in rows for b, y in rows if bin(x ^ y).count("1") <= radius}
        got = index.hamming_join(df, df, radius, 20)
        assert {tuple(x) for x in got.collect()} == want and got.count() == len(want)
    assert "NestedLoop" not in index.hamming_join(df, df, 3, 20)._jdf.queryExecution().executedPlan().toString()


def test_probes(spark):
    q = spark.createDataFrame([(1, [0.5, -0.1, 0.3])], "query_id bigint, logits array<float>")
    want = [0b101, 0b111, 0b100, 0b110]
    assert [x.probe_fp for x in probing.probes(q, 4, 3).orderBy("rank").collect()] == want
    r = np.random.default_rng(2)
    rows = [(i, [float(v) for v in r.normal(size=12)]) for i in range(20)]
    q = spark.createDataFrame(rows, "query_id bigint, logits array<double>")
    small = {(x.query_id, x.rank): x.probe_fp for x in probing.probes(q, 9, 12).collect()}
    large = {(x.query_id, x.rank): x.probe_fp for x in probing.probes(q, 60, 12).collect()}
    for i, x in rows:
        base = sum((v > 0) << (11 - k) for k, v in enumerate(x))
        sets = sorted((sum(abs(x[k]) for k in s), s) for n in range(13) for s in itertools.combinations(range(12), n))
        for rank, (_, s) in enumerate(sets[:60], 1):
            code = base ^ sum(1 << (11 - k) for k in s)
            assert large[(i, rank)] == code
            if rank <= 9:
                assert small[(i, rank)] == code
    with pytest.raises(ValueError):
        list(probing.sets_by_sum([1.0, -1.0]))
    assert sorted(s for _, s in probing.sets_by_sum([1.0, 1.0])) == [(), (0,), (0, 1), (1,)]
    wide = spark.createDataFrame([(1, [1.0] * 64)], "query_id bigint, logits array<double>")
    assert probing.probes(wide, 20, 64).filter("rank = 1").first().probe_fp == -1


def test_list_and_count_metrics_agree(spark):
    r = random.Random(5)
    rows = [(i, r.randint(0, 12), r.randint(0, 9)) for i in range(150)]
    df = codes(spark, rows)
    queries, database = df.filter("id % 5 = 0").withColumnRenamed("id", "query_id"), df.filter("id % 5 > 0 AND label < 8")
    lists = index.lookup_ids(queries, database).withColumnRenamed("ids", "retrieved").join(querysets.ground_truth(queries, database, with_ids=True).drop("n_truth"), "query_id")
    columns = ["query_id", "n_truth", "n_hits", "n_relevant", "n_irrelevant", "complete", "sound", "perfect", "jaccard", "hit", "positive", "false_positive", "true_negative"]
    a = metrics.with_list_predicates(lists).select(columns).orderBy("query_id").collect()
    b = metrics.query_results(queries, database).select(columns).orderBy("query_id").collect()
    assert a == b and len(a) == 30
    report = {x.verdict for x in metrics.search_report(metrics.query_results(queries, database)).collect()}
    assert report <= {"PERFECT", "IMPERFECT"}


def test_lists_of_cells_agree_with_whole_lists(spark):
    r = random.Random(6)
    rows = [(i, r.choice([None, *range(8)]), r.choice([None, *range(6)])) for i in range(300)]
    df = codes(spark, rows)
    queries, database = df.filter("id % 5 = 0").withColumnRenamed("id", "query_id"), df.filter("id % 5 > 0 AND coalesce(label, 0) < 5 AND coalesce(key, 0) < 7")
    found = metrics.list_results(queries, database)
    got = {x.query_id: x for x in found.collect()}
    base = [x for x in rows if x[0] % 5 and (x[2] or 0) < 5 and (x[1] or 0) < 7]
    for i, k, v in rows[::5]:
        hits, truth = ([x[0] for x in base if c is not None and x[at] == c] for at, c in ((1, k), (2, v)))
        x = got.pop(i)
        assert (x.relevant, x.missed, x.n_hits, x.n_irrelevant) == ([j for j in truth if j in hits], [j for j in truth if j not in hits], len(hits), len(set(hits) - set(truth)))
    assert not got
    columns = ["query_id", "n_truth", "n_hits", "n_relevant", "n_irrelevant", "complete", "sound", "perfect", "jaccard", "false_positive"]
    assert found.select(columns).orderBy("query_id").collect() == metrics.query_results(queries, database).select(columns).orderBy("query_id").collect()


def test_list_predicates_keep_repetitions(spark):
    df = spark.createDataFrame([(1, [1, 2], [2, 3]), (2, [], []), (3, [1], [1, 1]), (4, [5], [])], "query_id bigint, truth array<bigint>, retrieved array<bigint>")
    got = {x.query_id: x for x in metrics.with_list_predicates(df).collect()}
    assert got[1].jaccard == pytest.approx(1 / 3) and got[2].jaccard == 1.0 and got[2].true_negative
    assert got[3].n_relevant == 2 and got[3].perfect and not got[3].complete
    assert got[4].missed == [5] and got[4].false_negative


def test_empty_denominators_are_nan(spark):
    empty = metrics.query_results(codes(spark, []).withColumnRenamed("id", "query_id"), codes(spark, []))
    assert all(math.isnan(x) for x in metrics.dictionary_rates(empty).first()) and all(math.isnan(x) for x in metrics.membership_rates(empty).first())


def test_histograms(spark):
    d = spark.createDataFrame([("positive", 0), ("positive", 2), ("positive", 2), ("negative", 3)], "kind string, distance int")
    h = metrics.dense_histogram(d, "distance", 3, "kind", ["positive", "negative"])
    assert [x.n for x in h.filter("kind = 'positive'").orderBy("distance").collect()] == [1, 0, 2, 0]
    got = {x.r: (x.recall, x.fallout) for x in metrics.recall_at(h).collect()}
    assert got[0] == pytest.approx((1 / 3, 0)) and got[1] == pytest.approx((1 / 3, 0)) and got[2] == pytest.approx((1, 0)) and got[3] == pytest.approx((1, 1))
    p = {x.r: x.precision for x in metrics.precision_at(h, (0, 3)).collect()}
    assert p == {0: 1.0, 3: 0.75}
    dots = spark.createDataFrame([(-2.0,), (1.999,), (2.0,), (0.0,), (9.0,)], "x double")
    assert [x.n for x in metrics.dot_histogram(dots, "x", 2).orderBy("bin").collect()] == [1, 0, 1, 3]
    merged = metrics.merge_histograms(spark.createDataFrame([(0, 1), (0, 2), (1, 5)], "bin int, n bigint"))
    assert {x.bin: x.n for x in merged.collect()} == {0: 3, 1: 5}


def test_log_summary(spark):
    log = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 4.0), (2, None)], "step int, value double")
    got = {x.step: x for x in metrics.summarise_log(log).collect()}
    assert (got[1].max_value, got[1].q50, got[1].q0, got[1].q95) == pytest.approx((4, 2, 1, 3.8))
    assert math.isnan(got[2].mean_value) and math.isnan(got[2].q50)


def test_entropy(spark):
    df = spark.createDataFrame([(i, i) for i in range(4)], "id bigint, fp bigint")
    assert entropy.tuple_entropy(df, "fp", [(0, 1)], 2).first().entropy == pytest.approx(2)
    same = spark.createDataFrame([(i, 3) for i in range(4)], "id bigint, fp bigint")
    assert entropy.tuple_entropy(same, "fp", [(0, 1)], 2).first().entropy == 0
    r = random.Random(1)
    codes_ = spark.createDataFrame([(i, r.getrandbits(64) - (1 << 63)) for i in range(50)], "id bigint, fp bigint")
    tuples = [(0, 5, 63), (1, 2, 3), (7, 30, 31)]
    want = {}
    for x in codes_.collect():
        for no, t in enumerate(tuples):
            pattern = int("".join(str(x.fp >> (63 - i) & 1) for i in t), 2)
            want[no, pattern] = want.get((no, pattern), 0) + 1
    assert {(x.t, x.pattern): x.n for x in entropy.pattern_counts(codes_.repartition(3), "fp", tuples, 64).collect()} == want
    with pytest.raises(ValueError):
        entropy.check_tuples([(1, 2), (1,)])


def test_gradient_is_that_of_the_entropy(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(12, 3))
    tuples = list(itertools.combinations(range(3), 2))

    def negative_entropy(v):
        p = 1 / (1 + np.exp(-v))
        total = 0.0
        for i, j in tuples:
            d = np.array([[(p[:, i] if a else 1 - p[:, i]) * (p[:, j] if b else 1 - p[:, j]) for b in (0, 1)] for a in (0, 1)]).mean(axis=2)
            total += (d * np.log(d)).sum()
        return total

    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id bigint, x array<double>")
    got = {(g.id, g.bit): g.grad for g in entropy.entropy_gradient(df, "id", "x", tuples).collect()}
    for i, k in [(0, 0), (5, 1), (11, 2)]:
        e = np.zeros_like(x)
        e[i, k] = 1e-5
        assert got[(i, k)] == pytest.approx((negative_entropy(x + e) - negative_entropy(x - e)) / 2e-5, rel=1e-4)
    with pytest.raises(NotImplementedError):
        entropy.entropy_gradient(df, "id", "x", tuples, kind="straight-through")
    with pytest.raises(ValueError):
        entropy.entropy_gradient(df, "id", "x", tuples, kind="other")
    pseudo = entropy.entropy_gradient(df.withColumn("fp", codec.pack("x", 3)), "id", "x", tuples, "pseudo-smooth", "fp", 3)
    assert pseudo.count() == 36
    with pytest.raises(NotImplementedError):
        entropy.conditional_logits(df, "x", [(0,)])


def soft_brute(x, tuples):
    """Logarithms of the summed pattern probabilities, by exact enough arithmetic on logarithms."""
    down, up = -np.logaddexp(0, x), -np.logaddexp(0, -x)
    out = {}
    for no, t in enumerate(tuples):
        for p in range(1 << len(t)):
            logs = sum((up if p >> (len(t) - 1 - j) & 1 else down)[:, i] for j, i in enumerate(t))
            out[no, p] = np.logaddexp.reduce(logs)
    return out


@pytest.mark.parametrize("scale", [1.0, 300.0, 2000.0])
def test_soft_sums_of_saturated_logits(spark, scale):
    r = np.random.default_rng(7)
    x = np.round(r.normal(size=(40, 5)), 3) * scale
    tuples = list(itertools.combinations(range(5), 3))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id bigint, x array<double>").repartition(5)
    want = soft_brute(x, tuples)
    got = {(g.t, g.pattern): g.log_sum for g in entropy.soft_log_sums(df, "x", tuples).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    subs, of_bit = entropy.sub_tuples(tuples)
    logits = {(g.bit, g["sub"], g.pattern): g.logit for g in entropy.conditional_logits(df, "x", tuples).collect()}
    assert len(logits) == sum(map(len, of_bit.values())) * 4
    for (i, s, p), v in logits.items():
        t = (i, *subs[s])
        both = soft_brute(x, [t])
        assert v == pytest.approx(both[0, 4 + p] - both[0, p], rel=1e-6, abs=1e-9)
    grads = entropy.entropy_gradient(df, "id", "x", tuples).collect()
    assert len(grads) == 200 and all(math.isfinite(g.grad) for g in grads)


def test_entropy_of_empty_tables(spark):
    df = spark.createDataFrame([], "id bigint, x array<double>, fp bigint")
    tuples = [(0, 1), (1, 2)]
    assert entropy.soft_entropy(df, "x", tuples).collect() == [] and entropy.tuple_entropy(df, "fp", tuples, 3).collect() == []
    assert entropy.average_distribution(df, "fp", tuples, 3).collect() == []
    for kind in ("normal", "pseudo-smooth"):
        assert entropy.entropy_gradient(df, "id", "x", tuples, kind, "fp", 3).collect() == []


def test_outer_sums_share_prefixes():
    x = np.arange(12.0).reshape(2, 6)
    places = np.array([(0, 1, 2), (0, 1, 5), (3, 4, 5)])
    for at, got in entropy.outer_sums((x, 10 * x), places, np.multiply):
        for k, t in zip(range(len(at)), places[at]):
            want = [[np.prod([(10 if p >> (2 - j) & 1 else 1) * x[r, i] for j, i in enumerate(t)]) for p in range(8)] for r in range(2)]
            assert np.allclose(got[:, k], want)


def test_combinations():
    assert entropy.covering_combinations(5, 2, 2) == list(itertools.combinations(range(5), 2))
    c = entropy.covering_combinations(8, 4, 2, seed=1)
    assert c == sorted(set(c)) and len(c) == 28
    assert all(any(set(b) <= set(t) for t in c) for b in itertools.combinations(range(8), 2))
    assert len(entropy.padded_combinations([(0, 1)], 6, 9)) == 9
    subs, of_bit = entropy.sub_tuples([(0, 1), (0, 2)])
    assert subs == [(1,), (0,), (2,)] and of_bit == {0: [0, 2], 1: [1], 2: [1]}


def test_intervals(spark):
    low, high = intervals.clopper_pearson(10, 0, 0.95)
    assert low == 0 and high == pytest.approx(1 - 0.05 ** (1 / 10), abs=1e-6)
    assert intervals.clopper_pearson(10, 10, 0.95) == (pytest.approx(0.05 ** (1 / 10), abs=1e-6), 1.0)
    low, high = intervals.clopper_pearson(100, 30, 0.95)
    assert (low, high) == pytest.approx((0.2124, 0.3998), abs=1e-3)
    a, b = intervals.chebyshev(1000, 50, 0.01, 0.99, 0.95)
    assert float(a) <= 2 * 50 / (1000 * 999) / 0.99 <= float(b)
    assert intervals.binomial_cdf(2, 5, 0.3) == pytest.approx(sum(math.comb(5, i) * 0.3**i * 0.7 ** (5 - i) for i in range(3)))
    low, high = intervals.clopper_pearson(10**9, 300_000_000, 0.95)
    assert (low, high) == pytest.approx((0.3 - 1.96 * math.sqrt(0.21e-9), 0.3 + 1.96 * math.sqrt(0.21e-9)), abs=2e-8)
    assert intervals.invert(lambda v: v * v, 2, 0, 2) == pytest.approx(math.sqrt(2))
    df = spark.createDataFrame([(v,) for v in [1, 2, 2, 3, 5] * 20], "v int")
    low, high = intervals.bootstrap_mean(df, "v", 500, 100)
    assert low < 2.6 < high
    assert intervals.bootstrap_mean(df, "v", 500, 100) == (low, high)
    with pytest.raises(NotImplementedError):
        intervals.bootstrap_mean(df, "v", 10, 3)
    assert intervals.with_error(3.14159, 0.0123) == ("3.14", "0.02")
    assert intervals.leading_place(1234) == 3 and intervals.leading_place(0.02) == -2


def test_query_sets(spark):
    df = codes(spark, [(i, 0, i % 7) for i in range(50)])
    database = df.filter("label <> 3")
    assert {(x.label, x.first_id) for x in querysets.positive_labels(database).collect()} == {(k, k) for k in range(7) if k != 3}
    drawn = querysets.sample_positive(database, 200, seed=1).collect()
    assert len(drawn) == 200 and {x.label for x in drawn} == {0, 1, 2, 4, 5, 6} and all(x.first_id == x.label for x in drawn)
    absent = querysets.absent_labels(querysets.uniform_labels(spark, 100, 9), database)
    assert {x.label for x in absent.collect()} == {3, 7, 8}
    assert tuple(querysets.verify_query_sets(querysets.positive_labels(database), absent, database).first()) == (0, 0)
    assert tuple(querysets.verify_query_sets(absent, querysets.positive_labels(database), database).first()) == (3, 6)
    pairs = querysets.negative_pairs(spark.range(50).withColumnRenamed("id", "label"), 50).collect()
    assert all(x.a_key != x.b_key and 0 <= x.b_key < 50 for x in pairs)


@pytest.mark.parametrize("k,low,high", [(5, 0, 5), (3, 10, 1000), (1, 0, 1), (4, -2, 9), (10, 0, 10**9), (6, -5, 1 << 62)])
def test_unique_rows(spark, k, low, high):
    a = querysets.unique_rows(spark, 200, k, low, high, seed=2)
    rows = a.collect()
    assert all(len(set(x["values"])) == k and all(low <= v < high for v in x["values"]) for x in rows)
    assert a.repartition(7).orderBy("row_id").collect() == sorted(rows)
    with pytest.raises(ValueError):
        querysets.unique_rows(spark, 1, high - low + 1, low, high)


def test_probes_of_any_number_agree(spark):
    r = random.Random(4)
    rows = [(0, [1.0] * 6), (1, [0.0] * 6), (2, [-2.0, 0.0, 2.0, -1.0, 1.0, 0.0])] + [(3 + k, [r.choice([-0.3, 0.1, 0.2, 0.3]) for _ in range(6)]) for k in range(20)]
    q = spark.createDataFrame(rows, "query_id bigint, logits array<double>")
    get = lambda n: sorted(tuple(x) for x in probing.probes(q, n, 6).filter("rank <= 10").collect())
    assert get(10) == get(11) == get(64)
    wide = spark.createDataFrame([(0, [1.0] * 64), (1, [0.5] * 63 + [0.0])], "query_id bigint, logits array<double>")
    get = lambda n: sorted(tuple(x) for x in probing.probes(wide, n, 64).filter("rank <= 10").collect())
    assert get(10) == get(30)


def test_mixed_sizes():
    assert querysets.mixed_sizes(total=7) == (3, 4) and querysets.mixed_sizes(positive=2, negative=5) == (2, 5) and querysets.mixed_sizes(total=7, negative=7) == (0, 7)
    for bad in ({}, {"positive": 3}, {"total": 3, "positive": 4}, {"total": 9, "positive": 4, "negative": 4}):
        with pytest.raises(ValueError):
            querysets.mixed_sizes(**bad)


def test_slices_and_gather(spark):
    assert list(querysets.slices(10, 4)) == [(0, 4), (4, 8), (8, 10)]
    bank = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "bank_id bigint, payload string")
    items = spark.createDataFrame([(1, [3, 0, 3]), (2, [4])], "id bigint, labels array<bigint>")
    assert {x.id: x.payloads for x in querysets.gather(items, bank).collect()} == {1: ["p3", "p0", "p3"], 2: ["p4"]}
    x = spark.range(20).select(querysets.hashed_choice(F.array(F.lit(1), F.lit(2), F.lit(3)), 0, "id").alias("v")).collect()
    assert {r.v for r in x} == {1, 2, 3}


def test_quick_results(spark):
    t = spark.createDataFrame([(0, 1, 7), (3, 3, 0), (5, 4, 5)], "anchor_fp bigint, positive_fp bigint, negative_fp bigint")
    row = metrics.quick_results_at(t, 40).first()
    assert (row.step, row.n_pairs, row.median_positive, row.median_negative, row.n_codes, row.n_unique_codes) == (40, 3, 1, 2, 6, 4)
    e = spark.createDataFrame([(2, 1.5), (2, -1e-12), (3, 2.5)], "size int, entropy double")
    assert metrics.worst_entropies(e).first().worst_entropies == {2: 0.0, 3: 2.5}
