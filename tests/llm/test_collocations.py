import random
import re
from collections import Counter

import pytest

from signfold.llm import collocations as m

SCHEMA = "doc_id bigint, text string, lang string, phrase string, n bigint, rank bigint, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, l, "p", 1, 2, "s") for i, (t, l) in enumerate(rows)], SCHEMA)


def brute(rows, max_n=3, least=10, share=50, top=2000):
    f, n = {}, Counter()
    for text, lang in rows:
        text = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^ \t]+", piece)
            lang = "und" if lang is None else lang
            n[lang] += len(words)
            for k in range(1, max_n + 1):
                for i in range(len(words) - k + 1):
                    f.setdefault(lang, Counter())[tuple(words[i:i + k])] += 1
    out = []
    for lang, c in f.items():
        some = [p for p, a in c.items() if len(p) > 1 and a >= least]
        rows = []
        for p in some:
            a = c[p]
            score, _, left, right = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            inside = (q for q in some if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if not any(100 * c[q] >= share * a for q in inside):
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def held(df):
    assert [t for _, t in df.dtypes] == ["string", "bigint", "string"] + ["bigint"] * 5
    return sorted(tuple(r) for r in df.collect())


def texts(seed, rows, words=6):
    rng = random.Random(seed)
    return [("".join(rng.choice(["a", "B", "c é", "dd", "E", "ff", "\t", "x"][:words]) + rng.choice([" ", " ", " ", "  ", ". ", ",", "\n", "\x0b", "!? "]) for _ in range(60)), rng.choice(["en", "en", "en", None, "und", "", "de"])) for _ in range(rows)]


@pytest.mark.parametrize("max_n,share,top", [(3, 50, 2000), (2, 50, 5), (4, 30, 7), (5, 101, 40)])
def test_as_counted_one_by_one(spark, max_n, share, top):
    rows = texts(max_n, 80) + [(None, "en"), ("", None), ("lonely", "xx"), ("a b a b a b " * 20, "rep"), ("one two three four. " * 12, "four")]
    want = brute(rows, max_n, 10, share, top)
    assert want and held(m.collocations(frame(spark, rows).repartition(3), max_n, share=share, top=top)) == want


def test_small_steps_and_hot_words(spark, monkeypatch):
    rows = texts(9, 30) + [("the a the b " * 300, "en")]
    want = brute(rows)
    monkeypatch.setattr(m, "STEP", 100)
    monkeypatch.setattr(m, "HOT_SHARE", 1e-6)
    monkeypatch.setattr(m, "ROUNDS", (3, 1))
    assert held(m.collocations(frame(spark, rows))) == want


def test_long_pieces(spark):
    rows = [("w%d x " % (i % 7) * 20_000, "en") for i in range(3)] + [("y" * 300_000 + " z " + "y" * 300_000, "en")] * 11
    assert held(m.collocations(frame(spark, rows), 2)) == brute(rows, 2)


def test_products_beyond_64_bits(spark):
    f = spark.createDataFrame([(3_000_000_000_000, 3_000_000_000_001, 3_000_000_000_007)], "a bigint, l bigint, r bigint")
    x, y, z = (f[c].cast(m.COUNT) for c in "alr")
    got = f.select(m.F.call_function("div", x * x * m.F.lit(m.SCALE).cast("decimal(7,0)"), y * z).alias("s")).first().s
    assert got == 1_000_000 * 3_000_000_000_000**2 // (3_000_000_000_001 * 3_000_000_000_007)


def test_empty(spark):
    assert held(m.collocations(frame(spark, []))) == []
    assert held(m.collocations(frame(spark, [(None, None), (" . ", "en")]))) == []
