import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from signfold.llm import lm_score as m

SCHEMA = "doc_id bigint, text string, held_out int, score string, n_tokens string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "s", "n") for i, t in rows], SCHEMA)


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered) + [None]


def corpus(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)]
    rows = []
    for i in range(n):
        w, at = [], 0
        for _ in range(r.randint(0, 60)):
            at = (at * 7 + r.choice([1, 1, 1, 2, 5])) % 40
            w.append(vocabulary[at])
        rows.append((i, " ".join(w)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "New wörds\x0bW1\tw1"), (n + 2, "twice")]


def brute(rows, is_train):
    """Scores by row, with the weights learned on probabilities that are rounded to eighths of a nat, and every context's probabilities summing to 1."""
    cell = lambda p: math.exp(-min(round(-math.log(p) * 8), 238) / 8) if p > 0 else 0
    data = [(i, tokens(t), is_train(i)) for i, t in rows]
    uni, bi, begins = Counter(), Counter(), 0
    for _, w, train in data:
        if train:
            begins += 1
            uni.update(w)
            bi.update(zip(["<s>", *w], w))
    n, v = sum(uni.values()), len(uni)
    context = lambda x: begins if x == "<s>" else uni[x]
    bucket = lambda c: min(int(math.floor(math.log2(c))) + 1, m.BUCKETS - 1) if c > 0 else 0
    events = []
    for (a, b), c in bi.items():
        p2 = (c - 1) / (context(a) - 1) if context(a) > 1 else 0
        events.append((bucket(context(a) - 1), cell(p2), cell((uni[b] - 1) / max(n - 1, 1)), 1 / (v + 1), c))
    weights = np.full((m.BUCKETS, 3), 1 / 3)
    weights[0] = (0, 0.5, 0.5)
    for _ in range(m.ROUNDS):
        new = np.where(weights > 0, 1.0, 0.0)
        for k, p2, p1, p0, c in events:
            share = weights[k] * (p2, p1, p0)
            new[k] += c * share / share.sum()
        weights = new / new.sum(axis=1, keepdims=True)
    def p(a, b):
        l2, l1, l0 = weights[bucket(context(a))]
        return l2 * (bi[(a, b)] / context(a) if context(a) else 0) + l1 * uni[b] / max(n, 1) + l0 / (v + 1)

    for a in {a for a, _ in bi}:
        assert sum(p(a, b) for b in [*uni, "a word that is not known"]) == pytest.approx(1)
    out = []
    for i, w, train in data:
        base = sum(math.log10((uni[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        score = sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w], w))
        out.append((i, not train, len(w), sum(uni[x] > 0 for x in w), n, base, score))
    return out


@pytest.mark.parametrize("chunk,owner", [(10**6, 10**6), (150, 200)])
def test_as_brute_force(spark, monkeypatch, chunk, owner):
    monkeypatch.setattr(m, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(m, "OWNER_REQUESTS", owner)
    rows = corpus(chunk, 120)
    got = sorted(tuple(r) for r in m.lm_score(frame(spark, rows).repartition(3), F.col("doc_id") % 5 == 1).collect())
    want = sorted(brute(rows, lambda i: i % 5 != 1))
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] == pytest.approx(w[6], rel=1e-6)


def test_model_beats_base_on_held_out_texts(spark):
    rows = corpus(9, 400)
    got = m.lm_score(frame(spark, rows), F.col("doc_id") % 5 == 1).filter("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert got[1] > 0.8 * got[0]


def test_different_words_of_equal_polynomial_hash_are_not_known(spark):
    word = "a"
    for _ in range(10):
        word += "".join("b" if c == "a" else "a" for c in word)
    other = "".join("b" if c == "a" else "a" for c in word)
    got = m.lm_score(frame(spark, [(1, word), (2, other), (3, f"{other} {word}")]), F.col("doc_id") > 1).collect()
    assert {r.doc_id: r.n_known for r in got} == {1: 2, 2: 1, 3: 2}


def test_no_training_rows_nulls_and_empty(spark):
    df = frame(spark, [(1, "a b"), (None, None)])
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens) for r in m.lm_score(df, F.lit(True)).collect())
    assert got == [("1", 3, 0, 0), ("None", 1, 0, 0)]
    assert m.lm_score(df.limit(0), F.lit(False)).collect() == []
