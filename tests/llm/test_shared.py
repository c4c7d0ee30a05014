import numpy as np

from signfold.llm import near_dedup, shared


def hashes(*texts):
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    return shared.words(data, np.concatenate(([0], ends)))[0]


def test_blocks_that_would_undo_each_other_in_one_state():
    a, b = hashes(b"secretsecretword"), hashes(b"o;0^u,fxrzx$c\"9i")
    assert a[0] != b[0]
    # Such pairs for one state: the second block takes back what the first one changed.
    rng = np.random.default_rng(0)
    start = shared.mixed(np.array([16], np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0xA0761D6478BD642F))

    def after(x):
        return shared.mixed((start ^ x) * np.uint64(0x9FB21C651E98DF25) + np.uint64(0x589965CC75374CC3))

    one = rng.integers(33, 126, 8, dtype=np.uint8).tobytes()
    other = np.frombuffer(b"secretwo", "<u8")
    for _ in range(200):
        two = rng.integers(33, 126, 8, dtype=np.uint8).tobytes()
        undone = (other ^ after(np.frombuffer(one, "<u8")) ^ after(np.frombuffer(two, "<u8"))).tobytes()
        if undone == other.tobytes() or set(undone) & {9, 10, 11, 12, 13, 32} or any(65 <= c <= 90 for c in undone + two + one):
            continue
        h = hashes(one + other.tobytes() + b" " + two + undone)
        assert len(h) == 2 and h[0] != h[1]


def test_words_of_all_lengths_are_told_apart():
    words = [bytes([97 + i % 26]) * n for n in range(1, 600) for i in (0, 1)] + [b"a" * n + b"b" for n in range(1, 600)]
    h = hashes(b" ".join(words))
    assert len(set(h.tolist())) == len(set(words))


def test_near_dedup_tells_such_words_apart(spark):
    rows = [(1, "secretsecretword"), (2, "o;0^u,fxrzx$c\"9i"), (3, "secretsecretword")]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), width=2)
    assert {r.doc_id: r.component_id for r in got.collect()} == {1: 1, 2: 2, 3: 1}
