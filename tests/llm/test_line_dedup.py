import random

import pytest

from signfold.llm.line_dedup import line_dedup, maximal_runs, repeated_runs

SCHEMA = "doc_id bigint, text string, line int, rank string, a bigint, n int, row int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "r", 2, 3, 7) for i, t in rows], SCHEMA)


def brute(rows, m):
    lines = {i: (t or "").split("\n") for i, t in rows}
    seen, gone = set(), {i: set() for i in lines}
    for i in sorted(lines):
        for s in range(len(lines[i]) - m + 1):
            run = tuple(lines[i][s : s + m])
            if run in seen:
                gone[i] |= set(range(s, s + m))
            seen.add(run)
    out = []
    for i, ls in lines.items():
        runs = sum(1 for k in gone[i] if k - 1 not in gone[i])
        longest = max((next(n for n in range(1, 10**6) if k + n not in gone[i]) for k in gone[i]), default=0)
        out.append((i, "\n".join(x for k, x in enumerate(ls) if k not in gone[i]), len(ls), len(gone[i]), runs, longest))
    return sorted(out)


@pytest.mark.parametrize("m", [1, 2, 3, 5])
def test_as_brute_force(spark, m):
    r = random.Random(m)
    rows = [(i, "\n".join(r.choice("abcdefgh") for _ in range(r.randint(1, 30)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n\n\n\n\n"), (103, "x\n" * 40), (104, rows[3][1]), (105, rows[3][1] + "\nend"), (106, "é\r\nb"), (107, "long " * 30_000)]
    got = line_dedup(frame(spark, rows).repartition(3), m)
    assert sorted(tuple(x) for x in got.collect()) == brute(rows, m)


def test_runs_at_every_depth(spark):
    rows = [(5, "a\nb\nc\nd"), (2, "z\na\nb\nc"), (9, "b\nc\nd"), (11, "\n".join(f"l{k}" for k in range(14))), (12, "\n".join(f"l{k}" for k in range(14)))]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, row bigint")
    got = {tuple(x) for x in repeated_runs(df, 3).collect()}
    # Depths are 3, 6, 12: the deepest interval of a suffix has the largest of them that it repeats.
    assert got == {(0, 0, 3), (2, 0, 3)} | {(4, k, k + h) for h in (3, 6, 12) for k in range(14 - h + 1)}
    assert sorted(tuple(x) for x in maximal_runs(repeated_runs(df, 3)).collect()) == [(0, 0, 3), (2, 0, 3), (4, 0, 14)]


def test_null_ids_repeated_rows_and_empty(spark):
    rows = [(None, "a\nb\nc"), (4, "a\nb\nc"), (4, "a\nb\nc")]
    got = sorted((str(x.doc_id), x.n_removed) for x in line_dedup(frame(spark, rows), 3).collect())
    assert got == [("4", 3), ("4", 3), ("None", 0)]
    assert line_dedup(frame(spark, rows).limit(0), 3).collect() == []
    with pytest.raises(ValueError):
        line_dedup(frame(spark, rows), 0)


def test_rows_of_one_id_are_not_one_text(spark):
    """Lines of two texts under one id, or of two without an id, make no run together."""
    for i in (None, 1):
        rows = [(i, "p\nb\nr"), (i, "a\nq\nc"), (4, "a\nb\nc"), (6, "a\nq\nc")]
        assert sorted((str(x.doc_id), x.n_removed) for x in line_dedup(frame(spark, rows), 3).collect()) == sorted([(str(i), 0), (str(i), 0), ("4", 0), ("6", 3)])


def test_a_very_common_line(spark):
    rows = [(k, f"hot\nhot\nhot\nx{k}") for k in range(300)] + [(1000 + k, "hot") for k in range(300)]
    assert sorted(tuple(x) for x in line_dedup(frame(spark, rows), 3).collect()) == brute(rows, 3)


@pytest.mark.parametrize("m", [3, 4, 5])
def test_short_runs_of_many_words(spark, m):
    r = random.Random(20 + m)
    line = lambda: r.choice("abcdefgh") + " w" * r.choice([0, 1, 3, 7])
    rows = [(i, "\n".join(line() for _ in range(r.randint(1, 12)))) for i in range(60)]
    rows += [(100, "one long passage of nine words in a line"), (101, "one long passage of nine words in a line"), (102, "two words"), (103, "two words"), (104, None)]
    least, lines = 8, {i: (t or "").split("\n") for i, t in rows}
    gone = {i: set() for i in lines}
    for n in range(1, m + 1):
        seen = set()
        for i in sorted(lines):
            for s in range(len(lines[i]) - n + 1):
                run = tuple(lines[i][s : s + n])
                if run in seen and (n == m or sum(len(x.split()) for x in run) >= least):
                    gone[i] |= set(range(s, s + n))
                seen.add(run)
    want = {i: ("\n".join(x for k, x in enumerate(ls) if k not in gone[i]), len(gone[i])) for i, ls in lines.items()}
    got = {x.doc_id: (x.text, x.n_removed) for x in line_dedup(frame(spark, rows).repartition(3), m, least_words=least).collect()}
    assert got == want and want[101] == ("", 1) and want[103] == ("two words", 0)
