import hashlib
import random

import pytest

from signfold.llm import exact_dedup
from signfold.llm.exact_dedup import PatriciaTrie, common_prefix, groups, kept_rows

SCHEMA = "doc_id bigint, text string, code string, length string, sha string, _row string, _keep string"


def brute(rows, keep):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    best = {t: (max if keep == "largest" else min)(x) for t, x in groups.items()}
    return sorted((i, best[t or ""], len(groups[t or ""]), i == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "c", "l", "s", "r", "k") for i, t in rows], SCHEMA)


ROWS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "x" * 70_000), (7, "x" * 70_000), (8, "x" * 69_999 + "y"), (9, "é"), (9, "é"), (10, "a ")]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_as_brute_force(spark, keep):
    got = exact_dedup.exact_dedup(frame(spark, ROWS).repartition(3), keep=keep)
    assert sorted(tuple(r) for r in got.collect()) == brute(ROWS, keep)


def test_large_group_and_flushes(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LOCAL_BYTES", 2000)
    r = random.Random(5)
    rows = [(i, "hot text" if i % 3 else f"{r.randint(0, 60)} some longer text {i % 7}") for i in range(900)]
    got = exact_dedup.exact_dedup(frame(spark, rows), keep="largest")
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, "largest")
    found = {(x.sha, x.low, x.high, x.n) for x in groups(frame(spark, rows), budget=2000, partitions=2).collect()}
    want = {}
    for i, t in rows:
        want.setdefault(t, []).append(i)
    assert found == {(hashlib.sha256(t.encode()).digest(), min(x), max(x), len(x)) for t, x in want.items()}


def test_rows_of_hot_groups_are_spread(spark):
    rows = [(i, f"text {i // 2}") for i in range(1400)] + [(i, "hot text") for i in range(1400, 2100)] + [(i, None) for i in range(2100, 2110)] + [(7, "hot text")] * 5
    got = exact_dedup.exact_dedup(frame(spark, rows).repartition(3), keep="largest")
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, "largest")
    # Rows of hot groups meet their owner by broadcast, others by merge.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "monotonically_increasing_id" in plan and "strategy=broadcast" in plan and "strategy=merge" in plan


def test_null_ids_and_empty(spark):
    got = exact_dedup.exact_dedup(frame(spark, [(None, "a"), (3, "a"), (None, "b")])).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == [("3", "None", 2), ("None", "None", 1), ("None", "None", 2)]
    assert exact_dedup.exact_dedup(frame(spark, ROWS).limit(0)).collect() == []
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(frame(spark, ROWS), keep="any")


def test_kept_rows_have_all_columns(spark):
    out = kept_rows(frame(spark, ROWS))
    assert out.columns == ["doc_id", "text", "code", "length", "sha", "_row", "_keep"]
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 4, 6, 8, 9, 10]


def test_kept_rows_with_repeated_and_null_ids(spark):
    rows = [(0, "B"), (1, "A"), (1, "B"), (5, "C"), (5, "C"), (None, "D"), (None, "E"), (None, "D")]
    assert sorted(r.text for r in kept_rows(frame(spark, rows).repartition(3)).collect()) == ["A", "B", "C", "D", "E"]
    assert sorted(r.text for r in kept_rows(frame(spark, rows), keep="largest").collect()) == ["A", "B", "C", "D", "E"]


@pytest.mark.parametrize("budget", [1, 3000, 20_000, 1 << 40])
def test_one_trie_holds_all_and_spills_by_subtree(budget):
    r = random.Random(1)
    keys = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) + b"tail" * r.randint(0, 3) for _ in range(2000)] + [b"shared head " * 50 + bytes([r.randint(0, 255)]) * r.randint(1, 40) for _ in range(1000)]
    trie, most = PatriciaTrie(budget), 0
    for i, k in enumerate(keys):
        trie.insert(k, (i, 0), (i, 0))
        most = max(most, trie.held)
    assert (trie.spills > 0) == (budget < 1 << 40) and most <= max(budget, 1)
    if budget == 1 << 40:
        assert trie.size == len(set(keys)) and len(trie.root.edges) < 5
    got = {}
    for text, t in trie.items():
        assert text not in got
        got[text] = (t.low[0], t.high[0], t.count)
    trie.close()
    assert got == {k: (keys.index(k), len(keys) - 1 - keys[::-1].index(k), keys.count(k)) for k in set(keys)}


def test_common_prefix():
    assert [common_prefix(a, b) for a, b in [(b"", b"a"), (b"ab", b"ab"), (b"abc", b"abd"), (b"x", b"y")]] == [0, 2, 2, 0]
