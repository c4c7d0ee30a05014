import re
import time

from signfold.llm import secret_scan as m
from signfold.llm.shared import release

SCHEMA = "doc_id bigint, text string, blob string, spans string, rule_version string"
PATTERNS = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda x: len(x[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda x: len(x[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda x: len(x[0]) >= 24)]
TEXTS = [
    "password = hunter22 then token: 'abc' and API_KEY=\"Zm9vYmFy==\"",
    "é€𝄞 secret:token:abcdefgh passwd=longenough",
    "AKIA" + "A1" * 8 + " AKIAAKIA" + "B" * 20 + " akia" + "0123456789abcdef" * 3,
    "token=" + "0123456789abcdef" * 2,
    "", None, "password=12345", "plain text", "x" * 90_000 + " secret='zzzzzz'", "TOKEN\n=abcdefg token =abcdefg",
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "b", "s", "v") for i, t in rows], SCHEMA)


def brute(text):
    found = [(x.start(), no, kind, x.end()) for no, (kind, p, good) in enumerate(PATTERNS) for x in p.finditer(text or "") if good(x)]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


def spans(df):
    return sorted((str(r.doc_id), r.s) for r in df.select("doc_id", m.spans_text(df.spans).alias("s")).collect())


def test_as_regular_expressions(spark):
    rows = list(enumerate(TEXTS)) + [(50, TEXTS[0]), (50, TEXTS[0]), (None, TEXTS[2])]
    assert spans(m.secret_scan(frame(spark, rows).repartition(3))) == sorted((str(i), brute(t)) for i, t in rows)


def test_ledger_scans_each_pair_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    first = [(1, TEXTS[0]), (2, TEXTS[1]), (3, TEXTS[0])]
    m.secret_scan(frame(spark, first), ledger=path).collect()
    assert spark.read.parquet(path).count() == 2
    second = first + [(4, TEXTS[3]), (5, TEXTS[0])]
    got = m.secret_scan(frame(spark, second), ledger=path)
    assert spans(got) == sorted((str(i), brute(t)) for i, t in second)
    assert spark.read.parquet(path).count() == 3
    # A rule that changes makes a new version by itself.
    monkeypatch.setitem(m.RULES, "hex", (r"[0-9a-f]{30,}", 0, 30))
    m.secret_scan(frame(spark, second), ledger=path).collect()
    assert spark.read.parquet(path).count() == 6


def test_empty(spark):
    assert m.secret_scan(frame(spark, []).limit(0)).collect() == []


def test_many_matches_in_one_text(spark):
    n = 200_000
    rows = [(1, "token=abcdefgh " * n), (2, "x token=abcdefgh"), (2, "x token=abcdefgh")]
    began = time.time()
    got = {r.doc_id: r.spans for r in m.secret_scan(frame(spark, rows)).collect()}
    assert time.time() - began < 90
    assert [(s.start, s.stop) for s in got[1]] == [(15 * i, 15 * i + 14) for i in range(n)]
    assert [(s.start, s.stop) for s in got[2]] == [(2, 16)]


def test_two_scans_of_one_ledger(spark, tmp_path):
    rows = list(enumerate(TEXTS))
    path = str(tmp_path / "ledger")
    m.extend(frame(spark, rows[::2]), path)
    half = spark.read.parquet(path).count()
    assert spans(m.secret_scan(frame(spark, rows), ledger=path)) == sorted((str(i), brute(t)) for i, t in rows)
    assert half < spark.read.parquet(path).count() == len({t or "" for t in TEXTS})


def test_new_ledgers_are_released(spark):
    got = m.secret_scan(frame(spark, [(1, "token=abcdefgh")]))
    assert spans(got) == [("1", "assign:0:14")]
    path = got.spent[0].scratch_path
    assert m.ledger_rows(spark, path) is not None
    release(got)
    assert m.ledger_rows(spark, path) is None
