"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

#: Runs of three lines, and of one or two that have 50 words, are judged by windows of so many lines; the union of all
#: windows that also occur earlier is what the maximal runs cover.
LINES = r"""
WITH n AS (SELECT *, row_number() OVER () AS r FROM documents),
l AS (SELECT r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM n),
p AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM l),
q AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w, lead(line, 1) OVER o AS line2, lead(line, 2) OVER o AS line3 FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
k AS (SELECT r, doc_id, i, line, CASE WHEN w >= 50 THEN sha256(line) END AS k1,
             CASE WHEN line2 IS NOT NULL AND w + len(regexp_extract_all(line2, '[^\x20\x09-\x0D]+')) >= 50 THEN sha256(line || chr(10) || line2) END AS k2,
             CASE WHEN line3 IS NOT NULL THEN sha256(line || chr(10) || line2 || chr(10) || line3) END AS k3 FROM q),
d AS (SELECT r, doc_id, i, line, CASE WHEN k1 IS NOT NULL AND row_number() OVER (PARTITION BY k1 ORDER BY doc_id NULLS FIRST, r, i) > 1 THEN 1 ELSE 0 END AS d1,
             CASE WHEN k2 IS NOT NULL AND row_number() OVER (PARTITION BY k2 ORDER BY doc_id NULLS FIRST, r, i) > 1 THEN 1 ELSE 0 END AS d2,
             CASE WHEN k3 IS NOT NULL AND row_number() OVER (PARTITION BY k3 ORDER BY doc_id NULLS FIRST, r, i) > 1 THEN 1 ELSE 0 END AS d3 FROM k),
g AS (SELECT r, doc_id, i, line, greatest(d1, max(d2) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), max(d3) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) AS gone FROM d),
h AS (SELECT *, CASE WHEN gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), 0) = 0 THEN 1 ELSE 0 END AS starts FROM g),
u AS (SELECT *, sum(starts) OVER (PARTITION BY r ORDER BY i) AS run FROM h),
z AS (SELECT r, max(n) AS longest FROM (SELECT r, run, count(*) AS n FROM u WHERE gone = 1 GROUP BY r, run) GROUP BY r)
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone) AS BIGINT) AS n_removed, CAST(sum(starts) AS BIGINT) AS n_runs, coalesce(any_value(longest), 0) AS longest_run,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE gone = 0), '')) AS kept_sha256
FROM h LEFT JOIN z USING (r) GROUP BY r, doc_id
"""

_KINDS = [("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]


def _secrets() -> str:
    parts = []
    for no, (kind, pattern, group, least) in enumerate(_KINDS):
        q = pattern.replace("'", "''")
        parts.append(
            f"""SELECT r, doc_id, {no} AS no, '{kind}' AS kind, unnest(regexp_extract_all(t, '{q}')) AS m, unnest(regexp_extract_all(t, '{q}', {group})) AS c,
            unnest(list_slice(regexp_split_to_array(t, '{q}'), 1, len(regexp_extract_all(t, '{q}')))) AS gap, unnest(range(len(regexp_extract_all(t, '{q}')))) AS j FROM n WHERE regexp_matches(t, '{q}')"""
        )
    return f"""
WITH n AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
e AS (SELECT *, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY r, no ORDER BY j) AS BIGINT) AS stop FROM m),
s AS (SELECT r, no, kind, stop - length(m) AS start, stop FROM e WHERE length(c) >= CASE no WHEN 0 THEN 6 WHEN 1 THEN 20 ELSE 24 END),
a AS (SELECT r, count(*) FILTER (WHERE no = 0) AS n0, count(*) FILTER (WHERE no = 1) AS n1, count(*) FILTER (WHERE no = 2) AS n2, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, no) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM n LEFT JOIN a USING (r)
"""


EXACT = """
WITH k AS (SELECT doc_id, coalesce(text, '') AS t, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size FROM documents)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM k
"""

WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first_id IS NOT NULL AND first_id IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to FROM f
"""

_TOKENS = r"""list_distinct(list_concat(list_concat([concat('h:', x) for x in string_split(host, '.') if x <> ''], [concat('p:', x) for x in string_split(path, '/') if x <> '']),
  [concat('q:', split_part(x, '=', 1)) for x in string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&') if split_part(x, '=', 1) <> '']))"""

#: All sets of frequent tokens of a labelled URL are laid out; SQL for small tables.
URLS = rf"""
WITH n AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT r, page_id, rest, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM n),
l AS (SELECT *, CASE WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/' WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
                     WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/' WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule, {_TOKENS} AS tokens FROM hp),
j AS (SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS listed FROM l),
tr AS (SELECT * FROM j WHERE listed IS NOT NULL),
m AS (SELECT 0.01::DOUBLE * count(*) AS least FROM tr),
fr AS (SELECT t FROM (SELECT unnest(tokens) AS t FROM tr) GROUP BY t HAVING count(*) >= (SELECT least FROM m)),
k AS (SELECT r, listed, list(t ORDER BY t) AS ts FROM (SELECT r, listed, unnest(tokens) AS t FROM tr) JOIN fr USING (t) GROUP BY r, listed),
e AS (SELECT listed, unnest([[ts[i + 1] for i in range(len(ts)) if (b >> i) & 1 = 1] for b in range(1, 1 << len(ts))]) AS body FROM k),
c AS (SELECT body, count(*) AS n FROM e GROUP BY body),
h AS (SELECT body, listed, count(*) AS hits FROM e GROUP BY body, listed HAVING count(*) >= (SELECT least FROM m)),
w AS (SELECT list_filter(body, lambda x: x <> item) AS body, listed, max(hits) AS most FROM (SELECT *, unnest(body) AS item FROM h) GROUP BY 1, 2),
s AS (SELECT body, listed AS verdict, hits, hits / n AS confidence FROM h JOIN c USING (body) LEFT JOIN w USING (body, listed) WHERE hits >= 0.9::DOUBLE * n AND (most IS NULL OR most < hits)),
b AS (SELECT r, verdict, confidence, array_to_string(body, ' ') AS mined_by, row_number() OVER (PARTITION BY r ORDER BY confidence DESC, hits DESC, len(body), body, verdict) AS place
      FROM j JOIN s ON len(list_filter(body, lambda x: NOT list_contains(tokens, x))) = 0 WHERE listed IS NULL)
SELECT page_id, host, path, rule, coalesce(listed, verdict, 'allow') AS verdict, mined_by, confidence FROM j LEFT JOIN (SELECT * FROM b WHERE place = 1) USING (r)
"""


def _crc32(text: str) -> str:
    """SQL of the unsigned crc32 of a text's UTF-8 bytes, bit by bit."""
    byte = f"CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, [{byte} for i in range(0, strlen({text}))]), lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

IMPORTANCE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT unnest(w) AS f, 0 AS s, 1 AS t FROM (SELECT {_WORDS} AS w FROM benchmark)),
a AS (SELECT f, CAST(sum(s) AS BIGINT) AS s, CAST(sum(t) AS BIGINT) AS t FROM (SELECT unnest(w) AS f, 1 AS s, 0 AS t FROM d UNION ALL SELECT * FROM b) GROUP BY f),
k AS (SELECT *, {_crc32("f")} % 10000 AS bucket FROM a),
g AS (SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM k GROUP BY bucket),
z AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM g),
v AS (SELECT f, CAST(floor(1000 * ln((g.t + 1) * (all_s + 10000) / ((g.s + 1) * (all_t + 10000)))) AS BIGINT) AS gain FROM k JOIN g USING (bucket), z),
e AS (SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM (SELECT r, unnest(w) AS f FROM d) JOIN v USING (f) GROUP BY r),
h AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN e USING (r)),
o AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM h),
p AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features, r) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= n * 10 // 100 THEN place END AS rank FROM p
"""


PHRASES = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS phrase FROM w, range(1, 4) r(k)),
c AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
q AS (SELECT lang, phrase, k, f AS a, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS ws FROM c WHERE k > 1 AND f >= 10),
x AS (SELECT q.lang, q.phrase, q.k, a, cut, l.f AS l, r.f AS r, 1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f) AS score FROM q
      JOIN c l ON l.lang = q.lang AND l.phrase = array_to_string(ws[1:cut], ' ') JOIN c r ON r.lang = q.lang AND r.phrase = array_to_string(ws[cut + 1:], ' ')),
s AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a AS f FROM q WHERE k = 3 AND cut = 1),
d AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.lang = s.lang AND o.phrase = s.phrase AND 100 * o.f >= 50 * s.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM d JOIN t USING (lang) QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": LINES, "op3_secret_scan": _secrets(), "op4_exact_dedup": EXACT, "op9_warc": WARC, "op11_collocations": PHRASES, "op12_url_filter": URLS, "op13_importance": IMPORTANCE}
