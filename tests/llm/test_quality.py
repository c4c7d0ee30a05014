import random

import numpy as np
from pyspark.sql import functions as F

from signfold.llm import quality as m
from signfold.llm.shared import words

SCHEMA = "doc_id bigint, text string, score string, y string, x string"


def stats(*texts):
    data = "".join(texts).encode()
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    return [dict(zip(m.FEATURES, r)) for r in m.statistics(np.frombuffer(data, np.uint8), offsets)]


def test_words():
    texts = ["Hello  wOrld\n", "", "x", "\x0b\t", "Éa éa", "ab"]
    data = "".join(texts).encode()
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    h, starts, ends, counts = words(np.frombuffer(data, np.uint8), offsets)
    assert counts.tolist() == [2, 0, 1, 0, 2, 1]
    assert [data[a:b].decode() for a, b in zip(starts, ends)] == ["Hello", "wOrld", "x", "Éa", "éa", "ab"]
    alone = [words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0][0] for w in ["hello", "WORLD", "X", "Éa", "éa", "AB"]]
    assert h.tolist() == alone and len(set(alone)) == 6


def test_statistics():
    a, b, c = stats("One two two.\nA | b!! 12", "", "same same same same")
    assert a["upper"] == 2 / 23 and a["digits"] == 2 / 23 and a["pipes"] == 1 / 23 and a["exclaims"] == 2 / 23
    assert np.isclose(a["log_words"], np.log1p(7)) and a["ends_with_stop"] == 1 / 7 and np.isclose(a["lines"], np.log(2))
    assert not any(b.values())
    assert c["distinct_words"] == 0.25 and c["top_word"] == 1 and c["repeated_neighbours"] == 0.75
    # A text's statistics do not depend on its neighbours.
    assert stats("x y z", "q r", "x y z")[2] == stats("x y z")[0]


def test_trees_fit_and_flat_walk():
    r = np.random.default_rng(0)
    x = r.normal(size=(4000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < -0.2)).astype(float)
    model = m.fit(x[:3000], y[:3000], trees=40)
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95

    def walk(row):
        total = model.bias
        for node in model.roots:
            while model.feature[node] >= 0:
                node = model.left[node] + (row[model.feature[node]] > model.threshold[node])
            total += model.value[node]
        return total

    assert np.allclose(model.raw(x[:50]), [walk(row) for row in x[:50]])
    assert m.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert m.fit(x[:10], np.ones(10)).score(x[:1])[0] > 0.9


def test_held_out_accuracy_and_edges(spark):
    r = random.Random(3)
    good = lambda: " ".join(r.choice(["the", "river", "runs", "over", "old", "stone"]) + r.choice(["", "", "."]) for _ in range(r.randint(5, 80)))
    bad = lambda: " | ".join(r.choice(["BUY", "now!!", "###", "12%%"]) for _ in range(r.randint(5, 80)))
    rows = [(i, good() if i % 3 else bad()) for i in range(600)] + [(1000, None), (1001, ""), (1002, "word " * 60_000), (None, "x"), (5, "again")]
    docs = spark.createDataFrame([(i, t, "s", "y", "x") for i, t in rows], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(500)] + [(3, None), (None, 1)], "doc_id bigint, quality int")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    model = m.train(docs, labels, ~held_out)
    got = {x.doc_id: x.score for x in m.score(docs.repartition(3), model).collect()}
    assert len(got) == 604 and all(0 <= x <= 1 for x in got.values())
    assert np.mean([(got[i] > 0.5) == (i % 3 > 0) for i in range(500, 600)]) > 0.97
    again = m.train(docs.repartition(5), labels.repartition(2), ~held_out)
    assert np.array_equal(again.value, model.value)
    assert m.score(docs.limit(0), model).collect() == []
    none = m.train(docs, labels.limit(0))
    assert {x.score for x in m.score(docs, none).collect()} == {0.5}
    assert m.train(docs, labels, most_rows=10).bias != model.bias
