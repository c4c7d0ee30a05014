import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from signfold.llm import importance as m
from signfold.llm import shared

SCHEMA = "doc_id bigint, text string, row bigint, feature string, score string, rank string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "f", "s", "r") for i, t in rows], SCHEMA)


def target(spark, texts):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "item_id bigint, text string, feature bigint")


def grams(text, max_n):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return words, [" ".join(words[i:i + k]) for k in range(1, max_n + 1) for i in range(len(words) - k + 1)]


def brute(rows, aims, max_n=1, buckets=10_000, seed=2024, least=20, percent=10):
    def counts(texts):
        return Counter(zlib.crc32(g.encode()) % buckets for t in texts for g in grams(t, max_n)[1])

    s, t = counts(x for _, x in rows), counts(aims)
    all_s, all_t = sum(s.values()), sum(t.values())
    scored = []
    for i, text in rows:
        words, gs = grams(text, max_n)
        weight = sum(math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in (zlib.crc32(g.encode()) % buckets for g in gs))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, len(gs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least))
    order = sorted((-x[3], -(1 << 63) if x[0] is None else x[0], x[1]) for x in scored if x[4])
    place = {}
    for rank, o in enumerate(order[: len(order) * percent // 100], 1):
        place.setdefault(o, []).append(rank)
    out = []
    for i, n, weight, score, some in scored:
        ranks = place.get((-score, -(1 << 63) if i is None else i, n)) if some else None
        out.append((i, n, weight, score, ranks.pop(0) if ranks else None))
    return sorted(out, key=repr)


def held(df):
    assert [t for _, t in df.dtypes] == ["bigint"] * 5
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sample(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "of", "été", "Été", "x1", "42", "λόγος", "a", "𝄞", "b_c", "d-e", "ǅ", "İ"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(n)]


@pytest.mark.parametrize("max_n,buckets,percent", [(1, 10_000, 10), (2, 50, 33), (3, 7, 100)])
def test_as_counted_one_by_one(spark, max_n, buckets, percent):
    rows = sample(max_n, 150) + [(3, None), (200, ""), (201, "   ;;"), (None, "the " * 30), (None, None), (7, "dup " * 40), (7, "dup " * 40)]
    aims = ["The λόγος of été", None, "", "42 42 a"]
    got = held(m.resample(frame(spark, rows).repartition(3), target(spark, aims), max_n, buckets, percent=percent))
    assert got == brute(rows, aims, max_n, buckets, percent=percent)


def test_hot_words_and_small_steps(spark, monkeypatch):
    rows, aims = sample(4, 60) + [(100 + i, "hot " * 25) for i in range(60)], ["hot the"]
    want = brute(rows, aims, 2)
    monkeypatch.setattr(m, "TEXT_STEP", 64)
    monkeypatch.setattr(m, "HOT_SHARE", 0.0)
    monkeypatch.setattr(shared, "SALTS", 5)
    assert held(m.resample(frame(spark, rows), target(spark, aims), 2)) == want


def test_long_text(spark):
    rows = [(1, "w é " * 200_000 + "q" * 100_000), (2, "w " * 30)]
    assert held(m.resample(frame(spark, rows), target(spark, ["w"]), percent=100)) == brute(rows, ["w"], percent=100)


@pytest.mark.parametrize("rows,aims", [([], ["a"]), ([(1, "a b " * 20)], []), ([], [])])
def test_empty(spark, rows, aims):
    assert held(m.resample(frame(spark, rows), target(spark, aims), percent=100)) == brute(rows, aims, percent=100)
