import itertools
import math
import random
import re

import pytest

from signfold.llm import url_filter as m

SCHEMA = "page_id bigint, url string, html string, row bigint, host string, verdict string"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, "h", 1, "x", "y") for i, u in rows], SCHEMA)


def parse(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    query = rest[len(host) + len(path):].split("#")[0][1:]
    host = host.translate(str.maketrans(m.UPPER, m.LOWER))
    return host, path, {"h:" + x for x in host.split(".") if x} | {"p:" + x for x in path.split("/") if x} | {"q:" + x.split("=")[0] for x in query.split("&") if x.split("=")[0]}


def by_list(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in m.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def brute(urls, labels=None, support=m.SUPPORT, confidence=m.CONFIDENCE):
    """All sets of tokens of all labelled URLs, counted one by one."""
    parsed = [(*parse(u), *by_list(*parse(u)[:2])) for u in urls]
    seen = [(parse(u)[2], v) for u, v in labels] if labels is not None else [(t, v) for _, _, t, _, v in parsed if v]
    enough = {x for t, _ in seen for x in t if sum(x in s for s, _ in seen) >= support * len(seen)}
    rules = {}
    for t, v in seen:
        t = sorted(t & enough)
        for k in range(1, len(t) + 1):
            for body in itertools.combinations(t, k):
                if (body, v) not in rules:
                    holds = [(s, w) for s, w in seen if set(body) <= s]
                    hits = [s for s, w in holds if w == v]
                    closed = set.intersection(*[s & enough for s in hits]) == set(body)
                    rules[body, v] = (len(hits) / len(holds), len(hits)) if closed and len(hits) >= support * len(seen) and len(hits) >= confidence * len(holds) else None
    out = []
    for host, path, t, rule, v in parsed:
        best = min(((-r[0], -r[1], len(body), list(body), w) for (body, w), r in rules.items() if r and set(body) <= t), default=None) if v is None else None
        out.append((host, path, rule, v or (best[4] if best else "allow"), " ".join(best[3]) if best else None, -best[0] if best else None))
    return out


def held(df):
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict, r.mined_by, r.confidence) for r in df.collect()), key=repr)


AWKWARD = [None, "", "no scheme", "://", "http://", "http://NET/", "http://net", "http://a.NeT/x", "http://xnet/", "http://user@net/", "http://example.net/en/", "http://example.net/en", "http://example.net/EN/", "HTTP://www.Example.NET/en/?a=1&b&=c", "a://b://c.org/fr/x#y?z", "http://org/fr/", "http://x.org/fr?/fr/", "http://x.org/fr#/fr/", "http://de.example.com/de//de/", "http://example.com?x=/de/", "http://é.org/fr/ü", "http://a\nb.net/\n", "http://net:80/", "http://.net/", "x://" + "a." * 300 + "net/" + "s/" * 3000]


def test_as_all_sets(spark):
    rng = random.Random(5)
    urls = AWKWARD + [f"http{rng.choice(['', 's'])}://{rng.choice(['www.', '', 'blog.'])}s{rng.randrange(4)}.example.{rng.choice(['net', 'com', 'org'])}/{rng.choice(['en', 'de', 'fr', 'es'])}/{rng.randrange(30)}{rng.choice(['', '?ref=x&page=2', '#t'])}" for _ in range(150)]
    urls = [u for u in urls if u is None or len(u) < 500]
    rows = list(enumerate(urls)) + [(3, urls[40]), (None, urls[41]), (None, urls[41])]
    want = sorted(((i, *x) for (i, _), x in zip(rows, brute([u for _, u in rows]))), key=repr)
    assert held(m.url_filter(frame(spark, rows).repartition(3))) == want
    assert any(x[5] for x in want)


def test_long_urls_and_their_copies(spark):
    # Forty copies of a URL of many tokens make one item, not 2 ** 3000 sets.
    rows = [(i, AWKWARD[-1]) for i in range(40)] + [(100, "http://x.org/en/1"), (101, "http://x.org/s/" + "s/" * 10), (102, "x://a.zzz/s/")]
    got = {r[0]: r for r in held(m.url_filter(frame(spark, rows)))}
    assert got[0][3:5] == ("net/", "block")
    # A rule asks for all tokens of the item.
    assert [got[i][4] for i in (100, 101, 102)] == ["allow"] * 3


def test_given_labels(spark):
    labels = [(f"http://casino.a{i}.com/x", "block") for i in range(9)] + [("http://good.com/x", "allow"), ("http://casino.com/x", "allow"), (None, "block"), ("http://odd.com", "perhaps"), ("http://none.com", None)]
    known = [x for x in labels if x[1] in m.VERDICTS]
    rows = list(enumerate(["http://casino.z.com/x", "http://good.com/x", "http://other.org/", "http://net/"]))
    got = m.url_filter(frame(spark, rows), labels=spark.createDataFrame(labels, "url string, verdict string"), support=0.1, confidence=0.8)
    want = sorted(((i, *x) for (i, _), x in zip(rows, brute([u for _, u in rows], known, 0.1, 0.8))), key=repr)
    assert held(got) == want
    assert [r[4] for r in held(got)][0] == "block"


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "http://example.org/en/")]])
def test_nothing_to_learn_from(spark, rows):
    got = held(m.url_filter(frame(spark, rows)))
    assert [r[4] for r in got] == ["allow"] * len(rows)


def test_rules_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(m, "BROADCAST_RULES", 0)
    urls = [f"http://{h}.example.{t}/{p}/" for h in "ab" for t in ("net", "com", "org") for p in ("en", "de", "fr")]
    want = sorted(((i, *x) for i, x in enumerate(brute(urls))), key=repr)
    assert held(m.url_filter(frame(spark, list(enumerate(urls))))) == want
    assert not any(isinstance(r[6], float) and math.isnan(r[6]) for r in want)
