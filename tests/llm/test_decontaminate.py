import random

import numpy as np
import pytest

from signfold.llm import decontaminate as m

SCHEMA = "doc_id bigint, text string, items string, best string, id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], SCHEMA)


def make(seed, n_items=70, n_docs=60):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(150)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(k, text(r.randint(6, 20)) + ("\n" + text(r.randint(1, 20)) if k % 3 else "")) for k in range(n_items)]
    docs = []
    for i in range(n_docs):
        parts = [text(r.randint(0, 120))]
        for _ in range(r.randint(0, 2)):
            w = r.choice(items)[1].split()
            if r.random() < 0.4 and len(w) > 12:
                w[r.randrange(len(w))] = "changed"
            parts += [" ".join(w).upper() if r.random() < 0.3 else ", ".join(w), text(r.randint(0, 90))]
        docs.append((i, " ".join(parts)))
    return items, docs


def brute_scores(index, h):
    """Score of every item for a passage, without bounds."""
    terms = np.unique(index.lookup(h))
    out = np.zeros(len(index.ids))
    for t in terms[terms >= 0]:
        nos, x = index.postings[t]
        out[nos] += x
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_search_finds_all_above_threshold(seed):
    items, docs = make(seed)
    index = m.BlockMaxIndex([(i, *(t.split("\n") + [""])[:2]) for i, t in items])
    for threshold in (0.2, 0.5, 0.9):
        for _, text in docs:
            h = m.hashed(text)[:40]
            terms = np.unique(index.lookup(h))
            terms = terms[terms >= 0]
            want = {no: s for no, s in enumerate(brute_scores(index, h)) if s >= threshold - 1e-9}
            got = index.search(terms, threshold)
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
            blocks = np.flatnonzero(index.block_best[terms].sum(axis=0) >= threshold - 1e-4)
            assert index.search(terms, threshold, blocks).keys() == want.keys()


def brute(items, docs, threshold, overlap):
    index = m.BlockMaxIndex(sorted((i, *(t.split("\n", 1) + [""])[:2]) for i, t in items))
    out = {}
    for i, text in docs:
        h = m.hashed(text or "")
        stride, hits = max(index.longest, m.WIDTH), set()
        for a in range(0, max(len(h), 1), stride):
            window = h[a : a + 2 * stride]
            if not len(window) or (a and a + stride >= len(h)):
                continue
            held = m._shingles(window)
            hits |= {index.ids[no] for no, s in enumerate(brute_scores(index, window)) if s >= threshold - 1e-9 and index.overlaps(no, held, overlap)}
        out[i] = sorted(hits)
    return out


@pytest.mark.parametrize("shard", [4096, 16])
def test_as_brute_force(spark, monkeypatch, shard):
    items, docs = make(7)
    want = brute(items, docs, m.THRESHOLD, m.OVERLAP)
    monkeypatch.setattr(m, "SHARD_ITEMS", shard)
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, doc_id string")
    got = {r.doc_id: r["items"] for r in m.decontaminate(frame(spark, docs).repartition(3), table).collect()}
    if shard == 4096:
        assert got == want
    # Windows and statistics follow the shard; whole items are found with any.
    whole = {i: sorted(k for k, t in items if " ".join(t.split()) in " ".join(text.lower().replace(",", " ").split())) for i, text in docs}
    assert all(set(whole[i]) <= set(got[i]) for i in got) and sum(map(bool, whole.values())) > 10


def test_question_and_answer_columns_and_edges(spark):
    items = spark.createDataFrame([(1, "who wrote the very old book of songs", "nobody knows who wrote it at all"), (2, None, None), (3, "", ""), (None, "a b c", "d")], "item_id bigint, q string, a string")
    q, a = "who wrote the very old book of songs", "nobody knows who wrote it at all"
    rows = [(1, f"{q}? {a}!"), (2, q), (3, a), (4, None), (5, ""), (6, "z " * 50_000 + f"{q} {a}"), (7, f"{q} {a}"), (7, f"{q} {a}"), (None, f"{q} {a}")]
    got = m.decontaminate(frame(spark, rows), items, item_text="q", question="q", answer="a").collect()
    assert sorted((str(r.doc_id), r["items"], r.contaminated) for r in got) == sorted((str(i), [1] if i not in (2, 3, 4, 5) else [], i not in (2, 3, 4, 5)) for i, _ in rows)
    assert m.decontaminate(frame(spark, rows).limit(0), items, item_text="q").collect() == []
    assert not any(r.contaminated for r in m.decontaminate(frame(spark, rows), items.limit(0), item_text="q").collect())


def test_short_answers_and_questions(spark):
    q, a = "which of the old rivers runs over the green hill", "the river of stones"
    long = "nobody has ever seen the end of this road"
    items = spark.createDataFrame([(1, f"{q}\n{a}"), (2, f"why not\n{long}")], "item_id bigint, text string")
    rows = [(1, f"pad {q}? Answer: {a}. pad"), (2, f"{q}? Answer: the stones of river"), (3, f"{q}? Answer: the river of"), (4, f"{a} {a} {a}"), (5, f"{long} so why not"), (6, f"{long} so not why"), (7, q)]
    got = {r.doc_id: r["items"] for r in m.decontaminate(frame(spark, rows), items).collect()}
    assert got == {1: [1], 2: [], 3: [], 4: [], 5: [2], 6: [], 7: []}


def test_results_do_not_depend_on_shards(spark, monkeypatch):
    items, docs = make(9)
    docs += [docs[3], docs[3], (docs[4][0], docs[3][1]), (None, docs[3][1]), (None, docs[3][1]), (None, docs[5][1]), (900, None), (900, "")]
    table = spark.createDataFrame([(i, t) for i, t in items + [items[0], items[-1]]], "item_id bigint, text string")
    found = {}
    for shard in (4096, 16, 71):
        monkeypatch.setattr(m, "SHARD_ITEMS", shard)
        got = m.decontaminate(frame(spark, docs).repartition(3), table).collect()
        found[shard] = sorted(str((r.doc_id, r.n_passages, r.n_retrieved, r["items"], round(r.best, 9), r.contaminated)) for r in got)
    assert len(found[4096]) == len(docs) and found[16] == found[4096] == found[71]
    assert sum("True" in x for x in found[16]) > 10


@pytest.mark.parametrize("kind,ids", [("bigint", [None, 5, None]), ("string", ["a-1", "5", None])])
def test_items_without_integer_ids(spark, kind, ids):
    texts = [" ".join(f"{w}{k}" for k in range(12)) for w in ("one", "two", "three")]
    items = spark.createDataFrame(list(zip(ids, texts)), f"item_id {kind}, text string")
    docs = frame(spark, [(i, "before " + t + " after") for i, t in enumerate(texts)] + [(9, "nothing of it")])
    got = {r.doc_id: (r.contaminated, r["items"]) for r in m.decontaminate(docs, items).collect()}
    assert got == {0: (True, [None]), 1: (True, [5]), 2: (True, [None]), 9: (False, [])}
    assert [r.doc_id for r in m.clean_rows(docs, items).collect()] == [9]
