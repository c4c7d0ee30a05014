import pytest

from signfold.sources import generated
from signfold.streaming import logstore


def test_chunks_are_partitions(spark):
    t = generated.load(spark, 7, 1050, 100, 3)
    rows = {r.id: r["values"] for r in t.collect()}
    assert sorted(rows) == list(range(1050)) and all(len(v) == 3 and all(0 <= x < 1 for x in v) for v in rows.values())
    assert t.rdd.getNumPartitions() == 11
    assert rows[0] != rows[100]


@pytest.mark.parametrize("condition,chunks", [("id = 250", 1), ("id IN (0, 5, 999)", 2), ("id >= 330 AND id < 470", 2), ("id > 398 AND id <= 400", 2), ("id IN (5, 999) AND id > 100", 1), ("id = 5 AND id > 100", 0), ("id < 0", 1), ("values[0] > 0.5", 10)])
def test_asked_ids_make_their_chunks_only(spark, condition, chunks):
    t = generated.load(spark, 7, 1000, 100, 2)
    got = t.filter(condition)
    assert got.rdd.getNumPartitions() == chunks
    whole = spark.createDataFrame(t.collect(), t.schema).filter(condition)
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))


@pytest.mark.parametrize("condition", ["true", "id >= 250 AND id < 150050", "id IN ({})".format(",".join(str(i * 1000) for i in range(150)))])
def test_many_chunks_share_partitions(spark, condition):
    """Partitions do not grow with the chunks; a chunk makes what it makes alone."""
    t = generated.load(spark, 7, 200_000, 10, 2).filter(condition)
    assert generated.FEW_CHUNKS <= t.rdd.getNumPartitions() <= 2 * generated.FEW_CHUNKS
    got = {r.id: r["values"] for r in t.collect()}
    assert set(got) == {r.id for r in spark.range(200_000).filter(condition).collect()}
    alone = generated.Reader(7, 200_000, 10, 2)
    for number in (25, 7000, 10_000):
        for batch in alone.read(generated.Chunks([number])):
            for i, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                assert i not in got or got[i] == values


def test_out_of_range(spark):
    t = generated.load(spark, 7, 1000, 100)
    with pytest.raises(Exception, match="out of range"):
        t.filter("id = 1000").collect()
    with pytest.raises(Exception, match="out of range"):
        t.filter("id IN (3, -1)").collect()
    for bad in ({"seed": -1, "size": 5}, {"seed": 65535, "size": 5}, {"seed": 1, "size": -5}, {"seed": 1, "size": 5, "chunk_size": 0}):
        with pytest.raises(ValueError):
            generated.Reader(**{"chunk_size": 10, "width": 1} | bad)


def test_labelled(spark):
    labels = spark.createDataFrame([(i, i % 5) for i in range(0, 1200, 7)], "id bigint, label bigint")
    got = {r.id: r for r in generated.labelled(spark, labels, 1200, "valid", 3, 2).collect()}
    other = {r.id: r for r in generated.labelled(spark, labels, 1200, "test", 3, 2).collect()}
    assert len(got) == labels.count() and all(0 <= x - r.label < 1 for r in got.values() for x in r["values"])
    assert all(got[i]["values"] != other[i]["values"] for i in got)
    with pytest.raises(ValueError):
        generated.labelled(spark, labels, 1200, "test", 21845)


def test_log_store_goes_on_after_a_restart(spark, tmp_path):
    schema = "seq bigint, step bigint, metric string, value double"
    rows = [(i, i % 3, "ab"[i % 2], None if i % 7 == 3 else float((i * 37) % 11)) for i in range(60)]
    source, store, marks = str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "marks")

    def feed(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)

    def go():
        logstore.upsert(spark.readStream.schema(schema).parquet(source), store, marks).awaitTermination()

    feed(rows[:20])
    go()
    feed(rows[20:45])
    feed(rows[45:])
    go()
    go()
    got = {(r.step, r.metric): r for r in logstore.read(spark, store).collect()}
    for step in range(3):
        for metric in "ab":
            values = [(seq, v) for seq, s, m, v in rows if s == step and m == metric and v is not None]
            r = got[step, metric]
            assert (r.n, r.max_value, r.last_value, r.last_seq) == (len(values), max(v for _, v in values), values[-1][1], values[-1][0])
            assert r.mean_value == pytest.approx(sum(v for _, v in values) / len(values))
    assert len(got) == 6
    text = {r.step: r.text for r in logstore.render(logstore.read(spark, store)).collect()}
    assert text[0] == " - ".join(f"{m}:{got[0, m].last_value:.4f}" for m in "ab")
