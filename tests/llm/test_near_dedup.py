import random
import re

import pytest

from signfold.llm import near_dedup
from signfold.llm.near_dedup import BANDS, components, kept_rows

SCHEMA = "doc_id bigint, text string, id string, component string, n string"


def shingle_set(text, width):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < width else frozenset(zip(*(w[k:] for k in range(width))))


def brute(rows, width, percent):
    sets = [(i, shingle_set(t, width)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = top(i), top(j)
                parent[max(p, q)] = min(p, q)
    return sorted((i, len(x), top(i), top(i) == i) for i, x in sets)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], SCHEMA)


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 4)))
    rows, made = [], []
    for _ in range(n):
        w = [word() for _ in range(r.choice([0, 1, 2, 3, 8, 12, 40, 200]))]
        made.append(w)
        for _ in range(r.randint(0, 4)):
            v = list(w)
            for _ in range(r.randint(0, max(1, len(v) // 14))):
                if v:
                    v[r.randrange(len(v))] = word()
            made.append(v)
    r.shuffle(made)
    for i, w in enumerate(made):
        rows.append((i * 3 + 5, r.choice([" ", "\n", "\t "]).join(w).upper() if i % 5 == 0 else " ".join(w)))
    return rows + [(1, None), (2, ""), (3, " \t\n")]


@pytest.mark.parametrize("seed,width,percent", [(1, 2, 80), (2, 5, 80), (3, 1, 60)])
def test_as_brute_force(spark, seed, width, percent):
    rows = corpus(seed)
    got = near_dedup.near_dedup(frame(spark, rows).repartition(3), width, percent)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, width, percent)


def test_links_between_leaves_are_found(spark):
    # A chain: each text shares most with the next, little with the ends; and a template that all share half of.
    base = [f"w{k}" for k in range(100)]
    rows = [(k + 1, " ".join(base[:100 - 0] if k == 0 else [f"v{j}" if j < 4 * k else x for j, x in enumerate(base)])) for k in range(20)]
    template = [f"t{k}" for k in range(60)]
    rows += [(100 + k, " ".join(template + [f"u{k // 2}x{j}" for j in range(40)])) for k in range(40)]
    got = near_dedup.near_dedup(frame(spark, rows), 2, 80)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 2, 80)


def test_large_group(spark):
    w = [f"w{k}" for k in range(80)]
    rows = [(k, " ".join(w[:k % 80] + ["z%d" % k] + w[k % 80 + 1 :])) for k in range(300)] + [(1000 + k, " ".join(w)) for k in range(200)]
    got = near_dedup.near_dedup(frame(spark, rows), 2, 80)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 2, 80)


def test_kept_rows_empty_and_null_ids(spark):
    rows = [(7, "a b c d e f"), (3, "A b c d e f"), (9, "other words here"), (None, "x y z")]
    out = kept_rows(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "id", "component", "n"]
    assert sorted(out.collect(), key=str) == sorted(frame(spark, [rows[1], rows[2], rows[3]]).collect(), key=str)
    assert near_dedup.near_dedup(frame(spark, rows).limit(0)).collect() == []


def test_rows_of_one_id_are_not_one_text(spark):
    """Null and repeated ids: texts are linked by what they hold, not by the id they share."""
    one, two = " ".join(f"a{k}" for k in range(20)), " ".join(f"b{k}" for k in range(20))
    for i in (None, 7):
        rows = [(1, one), (2, two), (i, one + " x"), (i, two + " x"), (i, "")]
        got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in near_dedup.near_dedup(frame(spark, rows), 2, 80).collect())
        assert got == sorted([("1", 19, "1"), ("2", 19, "2"), (str(i), 20, "1"), (str(i), 20, "2"), (str(i), 0, str(i))])
        assert sorted(r.text for r in kept_rows(frame(spark, rows), 2).collect()) == sorted([one, two, ""])
    rows = [(0, two), (1, one), (1, two), (5, one), (5, one), (None, one)]
    assert sorted((r.doc_id, r.text) for r in kept_rows(frame(spark, rows)).collect()) == [(0, two), (1, one)]


def test_different_words_of_equal_polynomial_hash(spark):
    """Thue-Morse words of 1,024 letters collide under any polynomial hash modulo 2**64."""
    word = "a"
    for _ in range(10):
        word += "".join("b" if c == "a" else "a" for c in word)
    other = "".join("b" if c == "a" else "a" for c in word)
    rows = [(1, f"{word} {word}"), (2, f"{other} {other}"), (3, word[:500]), (4, other[:500])]
    assert sorted(tuple(r) for r in near_dedup.near_dedup(frame(spark, rows), 2, 80).collect()) == brute(rows, 2, 80)


def test_small_blocks_and_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(near_dedup, "HOT_SHARE", 0.3)
    base = [f"t{k}" for k in range(60)]
    rows = [(100 + k, " ".join(base + [f"u{k // 2}x{j}" for j in range(40)])) for k in range(60)] + [(k, " ".join(base)) for k in range(30)]
    assert sorted(tuple(r) for r in near_dedup.near_dedup(frame(spark, rows), 2, 80).collect()) == brute(rows, 2, 80)


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)]
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = top(a), top(b)
        parent[max(p, q)] = min(p, q)
    touched = {x for a, b in edges if a != b for x in (a, b)}
    got = {x.id: x.component for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: top(x) for x in touched}


def test_bands_miss_few():
    assert (1 - 0.8**near_dedup.ROWS) ** BANDS < 1e-8
