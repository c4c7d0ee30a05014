import random

import numpy as np
import pytest

from signfold.llm import mixing as m

SCHEMA = "doc_id bigint, text string, tokens string, p string, r string, rate string, domain string"
WORDS = {"high": ["river", "stone", "field"], "low": ["click", "here", "###"], "toxic": ["idiot", "clown"]}


def corpus(n, seed=1):
    r = random.Random(seed)
    rows, kinds = [], []
    for i in range(n):
        kind = r.choice(["high"] * 6 + ["low"] * 3 + ["toxic"])
        w = [r.choice(["the", "of", "and", *WORDS[kind]]) for _ in range(r.randint(5, 60))]
        rows.append((i, " ".join(w)))
        kinds.append((i, kind))
    return rows, kinds


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d", "e") for i, t in rows], SCHEMA)


def least_squares(t, p, w, ridge, steps=20_000):
    """The same problem by plain projected gradient descent in one array."""
    s, r = t.sum(), np.ones(len(t))
    near = p @ (t @ p / s) + ridge
    for _ in range(steps):
        e = (r * t) @ p / s - w
        r = np.maximum(0, r - (p @ e + ridge * near * (r - 1)) / (1 + ridge))
    return r


def test_fit_as_brute_force(spark):
    r = np.random.default_rng(2)
    t = r.integers(1, 200, 80).astype(float)
    p = r.dirichlet((0.4, 0.3, 0.2), 80)
    w = [0.75, 0.25, 0.0]
    members = spark.createDataFrame([(i, int(a), [float(x) for x in b]) for i, (a, b) in enumerate(zip(t, p))], "doc_id bigint, tokens bigint, p array<double>")
    rates, fit = m.fit_rates(members, w, ridge=0.02, steps=60, tolerance=1e-7)
    got = np.array([x.rate for x in rates.orderBy("doc_id").collect()])
    want = least_squares(t, p, np.array(w), 0.02)
    assert fit.converged
    assert (got >= 0).all() and (want == 0).any() and np.abs(got - want).max() < 1e-3
    assert np.allclose(fit.shares, (want * t) @ p / t.sum(), atol=1e-4)
    assert abs(fit.gap - np.abs(np.array(fit.shares) - w).max()) < 1e-12


def test_steps_lower_the_objective_to_a_fixed_point(spark, monkeypatch):
    """Every step keeps rates nonnegative and lowers the objective; in the end a projected gradient step changes nothing."""
    monkeypatch.setattr(m, "WRITE_STEPS", 2)
    r = np.random.default_rng(5)
    t, p, w, ridge = r.integers(1, 90, 60).astype(float), r.dirichlet((3.0, 2.0, 0.3), 60), np.array([0.1, 0.88, 0.02]), 1e-3
    members = spark.createDataFrame([(i, int(a), [float(x) for x in b]) for i, (a, b) in enumerate(zip(t, p))], "doc_id bigint, tokens bigint, p array<double>")
    near, last = p @ (t @ p / t.sum()) + ridge, np.inf
    for n in (1, 2, 3, 5, 40):
        rates, fit = m.fit_rates(members, list(w), ridge=ridge, steps=n)
        got = np.array([x.rate for x in rates.orderBy("doc_id").collect()])
        error = (got * t) @ p / t.sum() - w
        value = (error**2).sum() / 2 + ridge / 2 * (t / t.sum() * (got - 1) ** 2 * near).sum()
        assert (got >= 0).all() and value <= last + 1e-12
        last = value
    assert fit.converged and (got == 0).any() and (got > 0).any()
    assert np.abs(got - np.maximum(0, got - (p @ error / near + ridge * (got - 1)))).max() < 1e-5


def test_unreachable_targets_are_told(spark):
    members = spark.createDataFrame([(1, 10, [1.0, 0.0]), (2, 30, [1.0, 0.0])], "doc_id bigint, tokens bigint, p array<double>")
    rates, fit = m.fit_rates(members, [0.3, 0.7])
    assert fit.gap > 0.65 and all(x.rate >= 0 for x in rates.collect())


def test_expected_totals_match_targets(spark):
    rows, kinds = corpus(500)
    labels = spark.createDataFrame([x for x in kinds if x[0] % 2] + [(3, None), (None, "high"), (5, "other")], "doc_id bigint, domain string")
    targets = {"high": 6.0, "low": 3.5, "toxic": 0.5}
    df = m.mix(frame(spark, rows + [(900, None), (901, ""), (902, "of " * 40_000), (None, "the stone")]).repartition(3), labels, targets).toPandas()
    assert len(df) == 504 and (df.rate >= 0).all() and df.target_gap.max() < 0.01
    p = df[["p_high", "p_low", "p_toxic"]].to_numpy()
    assert np.allclose(p.sum(axis=1), 1)
    share = (df.rate * df.tokens).to_numpy() @ p / df.tokens.sum()
    assert np.allclose(share, [0.6, 0.35, 0.05], atol=0.01)
    held = [(i, k) for i, k in kinds if i % 2 == 0]
    best = df.set_index("doc_id")[["p_high", "p_low", "p_toxic"]].idxmax(axis=1)
    assert np.mean([best[i] == f"p_{k}" for i, k in held]) > 0.97
    assert df[df.doc_id.isin([900, 901])].rate.tolist() == [1, 1]


def test_edges(spark):
    rows, kinds = corpus(5)
    labels = spark.createDataFrame(kinds, "doc_id bigint, domain string")
    assert m.mix(frame(spark, rows).limit(0), labels, {"high": 1}).collect() == []
    alone = m.mix(frame(spark, rows), labels.limit(0), {"high": 1, "low": 1}).collect()
    assert all(x.p_high == x.p_low == 0.5 for x in alone)
    for bad in ({}, {"high": -1}, {"high": 0}):
        with pytest.raises(ValueError):
            m.mix(frame(spark, rows), labels, bad)
