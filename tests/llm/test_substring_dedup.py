import hashlib
import random

import numpy as np
import pytest

from signfold.llm import induced_sort
from signfold.llm.induced_sort import Pass, TupleQueue, suffix_array, suffix_runs
from signfold.llm.substring_dedup import repeated_windows, substring_dedup

SCHEMA = "doc_id bigint, text string, n_bytes int, chunk string"


def brute(docs, length):
    """Byte by byte: doc -> (n_bytes, n_removed, n_spans, sha of the rest)."""
    data = [(i, (t or "").encode()) for i, t in docs]
    seen = {}
    for _, b in data:
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]] = seen.get(b[s : s + length], 0) + 1
    out = []
    for i, b in data:
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = [True] * length
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other = text(60), text(45)
    docs = [text(r.randint(0, 200)) for _ in range(25)]
    docs += [text(30) + passage + text(20), passage, passage[:-3] + "x" + text(30), text(9) + passage[5:] + other + text(3) + other, other]
    docs += ["a" * 500, "ab" * 300, "a" * 199, "a" * 200, "", None, docs[0], docs[0], docs[3] + "!"]
    docs += [text(400) + docs[5], text(25) + passage[40:300] + text(25) + passage[41:290]]
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("length", [200, 80])
def test_as_brute_force(spark, seed, length):
    docs = corpus(seed)
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in docs], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in substring_dedup(df, length).collect()), key=str)
    assert got == brute(docs, length)


def test_small_chunks_and_shards(spark, monkeypatch):
    import signfold.llm.substring_dedup as m

    docs = corpus(3)
    monkeypatch.setattr(m, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(m, "SHARD_ANCHORS", 20)
    monkeypatch.setattr(m, "SHARD_BYTES", 3000)
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in docs], SCHEMA)
    assert sorted((tuple(r) for r in substring_dedup(df, 200).collect()), key=str) == brute(docs, 200)


def test_kept_bytes_nulls_and_empty(spark):
    docs = [(1, "q" * 10), (None, "z" * 250), (None, "y"), (4, None)]
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in docs], SCHEMA)
    got = {(r.doc_id, r.n_bytes): bytes(r.kept) for r in substring_dedup(df, keep=True).collect()}
    assert got == {(1, 10): b"q" * 10, (None, 250): b"", (None, 1): b"y", (4, 0): b""}
    assert substring_dedup(df.limit(0)).collect() == []


@pytest.mark.parametrize("batch", [1, 3, 16, 1 << 16])
@pytest.mark.parametrize("limit", [3, 200, 400])
def test_suffixes_and_common_prefixes(monkeypatch, batch, limit):
    """Any batch, limit and budget give the order and the common prefixes that comparing gives."""
    monkeypatch.setattr(induced_sort, "BATCH", batch)
    r = random.Random(batch + limit)
    for turn in range(120):
        top = r.choice([0, 1, 2, 9, 250, 100_000])
        t = [r.randint(0, top) for _ in range(r.randint(0, 80))]
        t = t[: len(t) // 4 + 1] * 5 if turn % 3 == 0 else t
        want = sorted(range(len(t)), key=lambda i: t[i:])
        shared = []
        for a, b in zip(want, want[1:]):
            k = 0
            while k < limit and max(a, b) + k < len(t) and t[a + k] == t[b + k]:
                k += 1
            shared.append(k)
        order, commons = suffix_array(np.array(t, dtype=np.uint8 if top < 256 else np.int32), limit, budget=r.choice([0, 1 << 20]))
        assert order.tolist() == want and commons.tolist() == shared


def test_recursion_and_disk(monkeypatch):
    """Long texts of few distinct words: names repeat on several levels, and queues beyond the budget lie in files."""
    levels, made = [], []
    plain, room = induced_sort.lms_order, TupleQueue._room

    def counted(t, *rest):
        levels.append(len(t))
        return plain(t, *rest)

    def seen(self, n, kind):
        out = room(self, n, kind)
        made.append(isinstance(out, np.memmap))
        return out

    monkeypatch.setattr(induced_sort, "lms_order", counted)
    monkeypatch.setattr(TupleQueue, "_room", seen)
    r = random.Random(8)
    words = ["river ", "stone ", "field ", "runs "]
    text = "".join(r.choice(words) for _ in range(3000)) * 2
    t = np.frombuffer(text.encode(), np.uint8)
    order, commons = suffix_array(t, 200, budget=1000)
    b = text.encode()
    assert order.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
    assert all(b[x : x + 200] == b[y : y + 200] for x, y, c in zip(order, order[1:], commons) if c == 200)
    assert len(levels) > 3 and all(x > y for x, y in zip(levels, levels[1:])) and sum(made) > len(made) // 2


def test_windows_are_decided_by_carried_prefixes(monkeypatch):
    """With common prefixes that are all too short nothing repeats: no other comparison decides."""
    pieces = [b"x" + b"ab" * 40, b"y" + b"ab" * 40]
    assert sum(map(sum, repeated_windows(pieces, [81 - 64 + 1] * 2, 64))) > 30
    plain = suffix_runs
    monkeypatch.setattr("signfold.llm.substring_dedup.suffix_runs", lambda t, limit: ((x, np.minimum(c, 5)) for x, c in plain(t, limit)))
    assert sum(map(sum, repeated_windows(pieces, [81 - 64 + 1] * 2, 64))) == 0


def test_pass_is_monotone():
    t = np.array([2, 1, 3, 1, 2, 0], dtype=np.uint8)
    s = induced_sort.s_types(t)
    up = Pass(t, np.append(False, ~s[:-1]), np.bincount(t[~s], minlength=4), np.array([1, 3]), np.array([0, 1]), 200, True, 0)
    up.begin(5)
    popped = np.concatenate([x for x, _ in up.run()])
    assert (np.diff(t[popped].astype(int)) >= 0).all()


def test_neighbouring_symbols_make_few_batches(monkeypatch):
    """Symbols that induce into the next one, as names do, are not popped in a batch for each."""
    batches, plain = [], Pass._induce
    monkeypatch.setattr(Pass, "_induce", lambda self, *r: (batches.append(len(r[0])), plain(self, *r))[1])
    t = np.array([*range(4000, 0, -1)] * 3, dtype=np.int32)
    order, commons = suffix_array(t, 50)
    assert order.tolist() == sorted(range(len(t)), key=lambda i: (t[i], -i))
    assert commons.tolist() == [0 if t[a] != t[b] else min(50, len(t) - a) for a, b in zip(order, order[1:])]
    assert len(batches) < 100


@pytest.mark.parametrize("few", [0, 2, 1000])
@pytest.mark.parametrize("stretch", [1, 7])
@pytest.mark.parametrize("limit", [3, 300])
def test_batches_and_single_tuples_mix(monkeypatch, few, stretch, limit):
    """However batches and stretches of single tuples follow each other, order and common prefixes are the same."""
    monkeypatch.setattr(induced_sort, "FEW", few)
    monkeypatch.setattr(induced_sort, "STRETCH", (stretch, 2 * stretch))
    r = random.Random(few + stretch + limit)
    for turn in range(30):
        top = r.choice([1, 3, 30, 100_000])
        t = [r.randint(0, top) for _ in range(r.randint(0, 150))]
        t = t[: len(t) // 3 + 1] * 4 if turn % 2 else t
        want = sorted(range(len(t)), key=lambda i: t[i:])
        shared = [next((k for k in range(limit) if max(a, b) + k >= len(t) or t[a + k] != t[b + k]), limit) for a, b in zip(want, want[1:])]
        order, commons = suffix_array(np.array(t, dtype=np.int32), limit, budget=r.choice([0, 1 << 20]))
        assert order.tolist() == want and commons.tolist() == shared
