import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from signfold.plans import catalog
from signfold.sources import config, encoder, images, procedural, tables
from signfold.streaming import incremental


def test_procedural_table(spark):
    t = procedural.ProceduralTable(7, 1000, 64, lambda rng, n: rng.integers(0, 10**6, n))
    whole = {r.id: r.value for r in t.frame(spark).collect()}
    assert sorted(whole) == list(range(1000))
    part = {r.id: r.value for r in t.frame(spark, 100, 300).collect()}
    assert part == {i: whole[i] for i in range(100, 300)}
    ids = spark.createDataFrame([(5,), (999,), (5,), (64,), (None,)], "id bigint")
    assert sorted((r.id, r.value) for r in t.rows(ids).collect()) == sorted((i, whole[i]) for i in (5, 999, 5, 64))
    for outside in (1000, -1):
        with pytest.raises(Exception, match="out of range"):
            t.rows(spark.createDataFrame([(5,), (outside,)], "id bigint")).collect()
    assert t[3] == whole[3] and t[-1] == whole[999]
    assert t[[1, 500, 1]].tolist() == [whole[1], whole[500], whole[1]] and t[10:200:3].tolist() == [whole[i] for i in range(10, 200, 3)]
    for bad, error in [(1000, IndexError), (-1001, IndexError), (slice(5, 5), RuntimeError), (slice(None, None, 0), ValueError), (slice(9, 1, -1), NotImplementedError)]:
        with pytest.raises(error):
            t[bad]
    assert t.frame(spark, 10, 10).collect() == []
    with pytest.raises(ValueError):
        procedural.ProceduralTable(0xFFFF, 1, 1, None)


def test_labels_table(spark):
    labels = spark.createDataFrame([(i, i % 3) for i in range(50)], "id bigint, label bigint")
    a, b = (procedural.labels_table(labels, w, 1) for w in ("train", "test"))
    assert a.orderBy("id").collect() == procedural.labels_table(labels.repartition(5), "train", 1).orderBy("id").collect()
    assert a.join(b.withColumnRenamed("value", "other"), "id").filter("value = other").count() == 0
    assert procedural.labels_seed(2, "valid") == 7
    with pytest.raises(ValueError):
        procedural.labels_seed(0xFFFF // 3, "train")


def test_procedural_table_is_not_broadcast(spark):
    every = procedural.ProceduralTable(7, 100_000, 1000, lambda rng, n: rng.integers(0, 10, n)).frame(spark)
    joined = every.filter("value >= 0").join(spark.range(10_000_000), "id")
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 100_000


def test_many_shards_are_one_plan(spark, tmp_path):
    """20,000 shards; a plan with a scan for each of them would not end."""
    df = spark.range(40_000).withColumn("shard_of", F.expr("CAST(id DIV 2 AS INT)"))
    expected = df.groupBy(F.col("shard_of").alias("shard")).agg(F.count("*").alias("n"))
    merged = tables.merge_table(df, F.col("shard_of"), expected)
    assert merged.groupBy("shard").count().filter("count = 2").count() == 20_000
    for wrong in (df.filter("id <> 39999"), df.filter("id < 39998"), df.union(df.limit(1)), df.withColumn("shard_of", F.expr("CASE WHEN id > 0 THEN shard_of END"))):
        with pytest.raises(ValueError, match="incomplete"):
            tables.merge_table(wrong, F.col("shard_of"), expected)
    spark.range(0, 3_000_000, 1000).selectExpr("id AS o_orderkey", "id AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    got = catalog.src_merge_whole(spark, str(tmp_path))
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan") < 3
    assert got.filter("n = 1 AND refused").count() == 3000


def test_guards_ranges_and_shards(spark, tmp_path):
    df, path = spark.range(100), str(tmp_path / "t")
    tables.save(df, path)
    with pytest.raises(Exception, match="(?i)exists"):
        tables.save(df, path)
    tables.save(df, path, force=True)
    got = tables.read(spark, path, ["id"], 10, 20)
    assert sorted(r.id for r in got.collect()) == list(range(10, 20))
    assert "PushedFilters: [IsNotNull(id), GreaterThanOrEqual(id,10), LessThan(id,20)]" in got._jdf.queryExecution().executedPlan().toString()
    merged = tables.merge_shards([df.filter("id < 50"), df.filter("id >= 50")], [50, 50])
    assert merged.groupBy("shard").count().count() == 2
    with pytest.raises(ValueError):
        tables.merge_shards([df, df], [100, 99])
    with pytest.raises(ValueError):
        tables.merge_shards([df, df.withColumn("x", F.lit(1))])
    with pytest.raises(ValueError):
        tables.merge_shards([])
    assert tables.table_path("/root/", "task", "m", "v", "c", "codes") == "/root/task/m/v/c/codes"
    assert tables.split_range("test", {"test": (5, 9)}) == (5, 9)
    assert tables.eager(df).count() == 100


def test_resumable_sink(spark, tmp_path):
    sink = tables.ResumableSink(spark, str(tmp_path / "sink"), 10)
    df = spark.range(35)
    first = sink.pending(df)
    sink.write(first.filter("chunk < 2"))
    rest = sink.pending(df)
    assert sorted({r.chunk for r in rest.collect()}) == [2, 3]
    sink.write(rest)
    assert sink.pending(df).count() == 0
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "sink")).collect()) == list(range(35))


def test_lifecycle_of_many_labels(spark, tmp_path):
    """20,000 labels, about two orders each: none shares a code with another."""
    spark.range(40_000).selectExpr("id AS o_orderkey", "id % 20000 + IF(id % 10 = 3 AND id > 20000, 1, 0) AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    got = catalog.run_lifecycle(spark, str(tmp_path)).first()
    assert (got.n_database, got.n_queries, got.n_truth, got.recall, got.avg_jaccard, got.collisions) == (36_000, 4000, 4000, 1.0, 1.0, 0)
    with pytest.raises(ValueError):
        encoder.random_projection(4, 8, orthogonal=True)


def test_config(spark, tmp_path):
    task, model, grid = tmp_path / "task.json", tmp_path / "model.json", tmp_path / "grid.json"
    task.write_text(json.dumps({"seed": 1, "net": {"k": 64, "deep": {"a": 1}}}))
    model.write_text(json.dumps({"net": {"deep": {"b": 2}}, "name": "m"}))
    grid.write_text(json.dumps([["name", "seed", "net:deep:a"], ["x", 5, 0.5], ["y", 6, 1]]))
    got = config.load(task, model, grid, 1, {"seed": "9", "name": None})
    assert got == {"seed": 9, "net": {"k": 64, "deep": {"a": 1, "b": 2}}, "name": "y"}
    with pytest.raises(ValueError):
        config.load(task, model, grid)
    with pytest.raises(ValueError):
        config.grid_row(grid, 2)
    assert [tuple(r) for r in config.grid_frame(spark, grid).collect()] == [("x", 5, 0.5), ("y", 6, 1.0)]
    assert config.merged({"flag": True}, {"flag": "false"}, cast=True) == {"flag": True}
    base = {"a": {"b": 1}}
    assert config.merged(base, {"a": {"c": 2}}) == {"a": {"b": 1, "c": 2}} and base == {"a": {"b": 1}}
    assert config.difference({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 1, "c": 5}}) == {"a": {"c": (2, 5)}, "d": (3, config.MISSING)}
    assert config.nested({"a:b": 1, "a:c": 2}) == {"a": {"b": 1, "c": 2}}
    r = config.Registry()
    r.register(dict)
    assert r.build("dict", x=1) == {"x": 1}
    with pytest.raises(ValueError):
        r.build("nope")
    out = list(config.sweep([{"x": 1}, {"x": 0}], lambda c: 1 / c["x"]))
    assert out[0][1] == 1 and isinstance(out[1][1], ZeroDivisionError)


def test_encoder(spark):
    f = encoder.random_projection(4, 8, seed=1)
    rows = [(i, [float(i), 1.0, -2.0, 0.5]) for i in range(30)]
    df = spark.createDataFrame(rows, "id bigint, payload array<float>")
    got = {r.id: r.logits for r in encoder.encode(df.repartition(3), f, batch=7).collect()}
    assert all(np.allclose(got[i], f(np.array([x]))[0], atol=1e-4) for i, x in rows)
    assert encoder.rescale(np.array([0, 255], np.uint8)).tolist() == [-1, 1]


def test_images():
    tiles = np.arange(4 * 2 * 2).reshape(4, 2, 2)
    g = images.grid(tiles, 2, 2)
    assert g.shape == (4, 4) and g[0].tolist() == [0, 1, 4, 5] and g[2].tolist() == [8, 9, 12, 13]
    r = np.random.default_rng(1)
    rgb = r.random((5, 6, 3))
    assert np.allclose(images.hls_to_rgb(images.rgb_to_hls(rgb)), rgb)
    import colorsys

    assert np.allclose(images.rgb_to_hls(rgb)[2, 3], colorsys.rgb_to_hls(*rgb[2, 3]))
    assert np.allclose(images.jitter(rgb, 0, 0), rgb)
    pair = images.blended_pair(np.zeros((4, 6, 3)), np.ones((4, 6, 3)), 10)
    assert pair.shape == (4, 10, 3) and pair[0, 0, 0] == 0 and pair[0, -1, 0] == 1 and 0 < pair[0, 4, 0] < pair[0, 5, 0] < 1
    assert np.allclose(images.distort(rgb, np.zeros((5, 6)), np.zeros((5, 6))), rgb)
    assert images.to_uint8(images.to_float(np.array([0, 7, 255], np.uint8))).tolist() == [0, 7, 255]
    assert images.gaussian_noise(rgb, r).std() > 0
    field = images.perlin(32, 24, 3, np.random.default_rng(5))
    assert field.shape == (32, 24) and np.abs(field).max() <= 1.01 and np.abs(np.diff(field, axis=0)).max() < 0.5
    one, two = (images.noisy(rgb, np.random.default_rng(s), reach=1.0) for s in (1, 2))
    assert one.shape == rgb.shape and not np.allclose(one, two) and np.allclose(one, images.noisy(rgb, np.random.default_rng(1), reach=1.0))


def test_stream(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [(i, i % 5, f"2024-01-01 00:{i:02d}:00") for i in range(40)]
    spark.createDataFrame(rows, "event bigint, key bigint, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(src)
    static = spark.createDataFrame([(10, 1), (11, 1), (12, 2)], "id bigint, key bigint")
    schema = spark.read.parquet(src).schema
    hits = incremental.stream_lookup(spark.readStream.schema(schema).parquet(src), static)
    incremental.append_to(hits, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r.event: (r.n_hits, r.repr_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {i: {1: (2, 10), 2: (1, 12)}.get(k, (0, None)) for i, k, _ in rows}
    spark.createDataFrame([(99, 1, "2024-01-01 01:30:00")], "event bigint, key bigint, ts string").withColumn("ts", F.to_timestamp("ts")).write.mode("append").parquet(src)
    incremental.append_to(hits, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 41
    windows = incremental.windowed_hits(hits, "ts", "10 minutes", "5 minutes")
    incremental.append_to(windows, str(tmp_path / "win"), str(tmp_path / "ck2")).awaitTermination()
    w = {str(r.window_start)[11:16]: (r.n_queries, r.n_hit) for r in spark.read.parquet(str(tmp_path / "win")).collect()}
    assert w["00:00"] == (10, 4)


def test_files_are_decoded(spark, tmp_path):
    for k, name in enumerate(["b.raw", "a.raw", "c.txt"]):
        (tmp_path / name).write_bytes(bytes([k, k + 1]))
    items = encoder.binary_items(spark, str(tmp_path), "*.raw")
    got = {r.id: (r["shape"], r.payload) for r in encoder.decode(items, lambda b: np.frombuffer(b, np.uint8)).collect()}
    assert got == {0: ([2], [1.0, 2.0]), 1: ([2], [0.0, 1.0])}
    named = encoder.binary_items(spark, str(tmp_path), ids={"c.txt": 7})
    assert [(r.id, bytes(r.content)) for r in named.collect()] == [(7, b"\x02\x03")]
