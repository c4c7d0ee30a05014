import re

import corpus_pipeline
import numpy as np
import pytest

from signfold.llm import decontaminate, quality



def shingle_set(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return frozenset([tuple(w)] if 0 < len(w) < width else zip(*(w[k:] for k in range(width))))


def one_of_each(rows):
    """Smallest id of each component of documents with 5-word similarity of 0.8 or more."""
    sets = {i: shingle_set(t) for i, t in rows.items()}
    parent = {i: i for i in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(rows)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = top(i), top(j)
                parent[max(p, q)] = min(p, q)
    return {i: t for i, t in rows.items() if top(i) == i}


def exact_once(rows):
    first = {}
    for i in sorted(rows):
        first.setdefault(rows[i], i)
    return {i: rows[i] for i in first.values()}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A small corpus with every kind of document that a stage acts on."""
    import random

    r = random.Random(11)
    words = ["river", "stone", "old", "field", "runs", "over", "green", "hill", "wind", "light", "Water", "falls."]
    text = lambda n: " ".join(r.choice(words) + (str(r.randint(0, 9)) if r.random() < 0.2 else "") for _ in range(n))
    docs = [(i, text(r.randint(20, 120)), "en", f"s{i % 3}") for i in range(150)]
    docs += [(200 + i, docs[i][1], "en", "s1") for i in range(10)]
    docs += [(300 + i, docs[i][1] + " end", "en", "s0") for i in range(40, 60)]
    docs += [(400 + i, " | ".join(f"JUNK{r.randint(0, 99)}!!" for _ in range(60)), "en", "s0") for i in range(60)]
    items = [(k, f"question {k} asks what {text(9)}\nanswer {k} is {text(8)}") for k in range(6)]
    docs += [(500 + k, text(30) + " " + t.upper() + " " + text(30), "fr", "s2") for k, t in items]
    labels = [(i, 1 if i < 400 else 0, int(i % 13 == 0)) for i, *_ in docs if i % 3]
    out = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, lang, s, len(t)) for i, t, lang, s in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out), {i: t for i, t, *_ in docs}, items


def test_run_as_brute_force(spark, tables):
    path, docs, items = tables
    read = lambda t: spark.read.parquet(f"{path}/{t}.parquet")
    model = quality.train(read("documents"), read("labels"))

    def scored(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return model.score(quality.statistics(data, np.array([0, len(data)])))[0]

    kept = {i: t for i, t in docs.items() if scored(t) >= corpus_pipeline.LEAST_QUALITY}
    assert not any(400 <= i < 500 for i in kept) and len(kept) > 150
    kept = one_of_each(exact_once(kept))
    normal = lambda t: " ".join(re.findall(r"[a-z0-9]+", t.lower()))
    kept = {i for i, t in kept.items() if not any(normal(x) in normal(t) for _, x in items)}
    got = corpus_pipeline.run(spark, path).toPandas()
    assert set(got.doc_id) == kept and len(got) == len(kept)
    assert not {200 + i for i in range(10)} & kept and not {500 + k for k in range(6)} & kept
    p = got[[f"p_{d}" for d in corpus_pipeline.TARGETS]].to_numpy()
    share = (got.rate * got.tokens).to_numpy() @ p / got.tokens.sum()
    assert (got.rate >= 0).all() and np.abs(share - [0.95, 0.05]).max() < 0.02


def test_stages_return_the_columns_of_documents(spark, tables):
    path, *_ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "MinHash near-dedup", "benchmark decontamination", "mixing to target weights"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns


def test_edges(spark, tables):
    path, *_ = tables
    schema = spark.read.parquet(f"{path}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "word " * 50_000, None, "s", 1)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, path).collect()
        assert stage(spark, docs.limit(0), path).collect() == []


def test_decontaminate_stage_matches_operator(spark, tables):
    path, *_ = tables
    docs, items = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "benchmark"))
    flagged = {r.doc_id for r in decontaminate.decontaminate(docs, items).filter("contaminated").collect()}
    left = {r.doc_id for r in corpus_pipeline.decontaminate_stage(spark, docs, path).collect()}
    assert flagged and left == {r.doc_id for r in docs.collect()} - flagged


def test_registered_names(spark):
    import __spark_entry__ as registry

    names = registry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(registry.oracle_sql()) <= set(names)
