import gzip
import hashlib
import random

import numpy as np
import pytest

from signfold.llm import warc

SCHEMA = "page_id bigint, url string, html string, digest string, file string, at int"
FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:777>\r\nContent-Length: {}\r\n\r\n"
BIG = "b" * 150
PAGES = [
    (4, "http://a", "x" * 100), (2, "http://b", "x" * 100), (9, "http://c", "x" * 100), (5, "u", "x" * 99), (6, "u", "x" * 99),
    (7, None, None), (8, "bad\r\nurl here", ""), (10, "u", FAKE.format(3) + "abc\r\n\r\n" + FAKE.format(0)), (11, "u", BIG + FAKE.format(10**6) + "tail\r\n\r\n"),
    (12, "u", "é€𝄞\r\n\r\n" * 30), (13, "u", "é€𝄞\r\n\r\n" * 30), (14, "u", "\x00\x01\n" * 50), (15, "u", "y" * 400_000), (3, "u", FAKE.format(5)),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "d", "f", 1) for i, u, h in rows], SCHEMA)


def brute(rows):
    first, out = {}, []
    data = [(i, (h or "").encode()) for i, _, h in rows]
    for i, b in data:
        if len(b) >= 100:
            first[b] = min(first.get(b, i), i)
    for i, b in data:
        again = len(b) >= 100 and first[b] != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip(spark, tmp_path, compression):
    plan = warc.planned(frame(spark, PAGES).repartition(3))
    path = warc.write_warc(plan, str(tmp_path / "w"), compression=compression, file_bytes=2000)
    records = warc.read_warc(spark, path, payloads=True)
    assert sorted(tuple(r) for r in warc.page_digests(records).collect()) == brute(PAGES)
    rows = {r.id: r for r in records.collect()}
    assert bytes(rows[11].payload).decode() == PAGES[8][2] and rows[8].url == "bad%20%20url%20here"
    assert all(r.stated_digest == r.payload_digest for r in rows.values() if r.record_type == "response")


def test_candidates_inside_payloads_are_rejected(spark, tmp_path):
    path = warc.write_warc(warc.planned(frame(spark, PAGES)), str(tmp_path / "w"))
    found = warc.candidates(spark, path)
    assert found.count() >= len(PAGES) + 4
    assert sorted(r.id for r in warc.reachable(found).collect()) == sorted(p[0] for p in PAGES)


def test_broken_chain_is_an_error(spark, tmp_path):
    path = warc.write_warc(warc.planned(frame(spark, PAGES)).coalesce(1), str(tmp_path / "w"), compression="none")
    part = next((tmp_path / "w").rglob("part-*"))
    # Without its checksum file the change goes unnoticed by the file system.
    (part.parent / f".{part.name}.crc").unlink()
    part.write_bytes(part.read_bytes()[:-3])
    with pytest.raises(ValueError):
        warc.read_warc(spark, path).collect()
    part.write_bytes(b"not an archive")
    with pytest.raises(ValueError):
        warc.read_warc(spark, path).collect()


def test_query_form_and_empty(spark):
    assert sorted(tuple(r) for r in warc.warc_round_trip(frame(spark, PAGES)).collect()) == brute(PAGES)
    assert warc.warc_round_trip(frame(spark, PAGES).limit(0)).collect() == []
    got = warc.warc_round_trip(frame(spark, [(None, "u", "q" * 120), (3, "u", "z"), (3, "u", "z")])).collect()
    assert sorted((str(r.page_id), r.payload_bytes) for r in got) == [("3", 1), ("3", 1), ("None", 120)]


def test_very_long_urls(spark, tmp_path):
    pages = PAGES + [(20, "http://long/" + "u" * 70_000, "v" * 120), (21, "http://longer/" + "é" * 400_000 + " WARC/1.1", "v" * 120), (22, "u", "WARC/1.1\r\n" * 20_000)]
    records = warc.read_warc(spark, warc.write_warc(warc.planned(frame(spark, pages)), str(tmp_path / "w")))
    assert sorted(tuple(r) for r in warc.page_digests(records).collect()) == brute(pages)
    urls = {r.id: r.url for r in records.collect()}
    assert urls[20] == pages[-3][1] and urls[21] == pages[-2][1].replace(" ", "%20")


def test_files_are_bounded_in_bytes(spark, tmp_path):
    pages = [(k, "u", f"{k}" * 300) for k in range(100, 400)]
    path = warc.write_warc(warc.planned(frame(spark, pages)).coalesce(1), str(tmp_path / "w"), compression="none", file_bytes=20_000)
    sizes = [p.stat().st_size for p in (tmp_path / "w").rglob("part-*")]
    assert len(sizes) > 10 and max(sizes) < 22_000
    assert sorted(tuple(r) for r in warc.page_digests(warc.read_warc(spark, path)).collect()) == brute(pages)


def test_gzip_members_for_each_record(spark, tmp_path):
    """A standard archive: every record is a gzip member of its own."""
    path = warc.write_warc(warc.planned(frame(spark, PAGES)).coalesce(1), str(tmp_path / "w"), compression="none")
    part = next((tmp_path / "w").rglob("part-*"))
    content = part.read_bytes()
    found = list(warc.candidate_rows("f", content, False))
    on, ended = warc.chain(np.array([r[2] for r in found]), np.array([r[3] for r in found]), len(content))
    assert ended
    cuts = [r[2] for r, k in zip(found, on) if k] + [len(content)]
    (part.parent / f".{part.name}.crc").unlink()
    part.write_bytes(b"".join(gzip.compress(content[a:b]) for a, b in zip(cuts, cuts[1:])) + b"\0" * 7)
    assert sorted(tuple(r) for r in warc.page_digests(warc.read_warc(spark, path)).collect()) == brute(PAGES)


def test_chain_as_a_walk():
    r = random.Random(3)
    for _ in range(300):
        size = r.randint(1, 60)
        at = np.array(sorted(r.sample(range(size), r.randint(0, size))), dtype=np.int64)
        following = np.array([min(x + r.randint(1, 6), size + (r.random() < 0.1)) for x in at], dtype=np.int64)
        to, seen, here = dict(zip(at.tolist(), following.tolist())), set(), 0
        while here in to:
            seen.add(here)
            here = to[here]
        on, ended = warc.chain(at, following, size)
        assert set(at[on].tolist()) == seen and ended == (here == size)
