import itertools
import re

import pytest
from pyspark.sql import functions as F

from signfold.operators.saved import SavedIndex

names = (f"kept{i}" for i in itertools.count())


def frame(spark, rows):
    return spark.createDataFrame(rows, "key bigint, id bigint, label string")


def batch(spark, a, b):
    return spark.range(a, b).select((F.col("id") % 37).alias("key"), "id", F.lit("x").alias("label"))


def brute(queries, rows):
    out = []
    for q, k in queries:
        ids = [i for key, i, _ in rows if key == k]
        out.append((q, len(ids), min(ids, default=None), max(ids, default=None)))
    return sorted(out)


def test_base_and_deltas(spark, tmp_path):
    queries = [(100 + k, k) for k in range(40)] + [(200, 3)]
    q = spark.createDataFrame(queries, "query_id bigint, key bigint")
    rows = [(i % 37, i, "x") for i in range(900)]
    index = SavedIndex(spark, next(names), "w", buckets=8, path=str(tmp_path))
    for a, b in ((0, 500), (500, 800), (800, 900)):
        index.append(batch(spark, a, b))
    assert len(index.tables()) == 3 and index.version == 0
    want = brute(queries, rows)
    assert sorted(tuple(r) for r in index.lookup_counts(q).collect()) == want
    assert sorted((r.query_id, r.id) for r in index.lookup(q).collect()) == sorted((a, i) for a, k in queries for key, i, _ in rows if key == k)
    index.compact()
    assert index.tables() == [f"{index.name}_base_1"]
    assert sorted(tuple(r) for r in SavedIndex(spark, index.name).lookup_counts(q).collect()) == want
    # Rows of base and deltas are met when they are aggregated.
    index.append(batch(spark, 0, 50))
    assert {r["count"] for r in index.rows().groupBy("key", "id").count().filter("id < 50").collect()} == {2}
    index.compact()
    assert SavedIndex(spark, index.name).rows().count() == 950
    # Merged cluster by cluster: as many files as clusters that have rows, each of one cluster.
    files = [r.f for r in spark.table(index.tables()[0]).select(F.input_file_name().alias("f")).distinct().collect()]
    assert 0 < len(files) <= 8
    index.append(batch(spark, 900, 950))
    assert index.tables() == [f"{index.name}_base_2", f"{index.name}_delta_2_1"]
    assert sorted(tuple(r) for r in index.lookup_counts(q).collect()) == brute(queries, [(i % 37, i, "x") for i in [*range(950), *range(50)]])
    index.drop()
    assert not index.ready


def test_index_is_not_shuffled(spark, tmp_path):
    index = SavedIndex(spark, next(names), "w", buckets=8, path=str(tmp_path))
    index.append(batch(spark, 0, 500))
    index.append(batch(spark, 500, 800))
    q = spark.createDataFrame([(1, 2)], "query_id bigint, key bigint")
    for found in (index.lookup(q), index.lookup_counts(q)):
        text = found._jdf.queryExecution().executedPlan().toString()
        scans = [m.start() for m in re.finditer("FileScan", text)]
        lines = text.split("\n")
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        bucketed = [i for i, line in enumerate(lines) if "FileScan" in line and "_parts" not in line and ("base" in line or "delta" in line)]
        assert scans and len(bucketed) == 2
        for i in bucketed:
            above, at = [], depth(lines[i])
            for line in reversed(lines[:i]):
                if depth(line) < at:
                    above.append(line)
                    at = depth(line)
            joined = [k for k, line in enumerate(above) if "SortMergeJoin" in line]
            assert joined and not any("Exchange" in line for line in above[: joined[0]]), text


def test_hot_keys_are_split(spark, tmp_path):
    index = SavedIndex(spark, next(names), "w", buckets=4, part_rows=10, path=str(tmp_path))
    rows = [(7, i, "x") for i in range(95)] + [(8, i, "y") for i in range(5)]
    index.append(frame(spark, rows))
    index.append(frame(spark, [(8, 100 + i, "z") for i in range(25)] + [(9, 1, "w")]))
    every = rows + [(8, 100 + i, "z") for i in range(25)] + [(9, 1, "w")]
    queries = [(1, 7), (2, 8), (3, 9), (4, 10)]
    q = spark.createDataFrame(queries, "query_id bigint, key bigint")
    assert {r.key: r.parts for r in index.parts().collect()} == {7: 10, 8: 3}
    assert index.rows().filter("key = 7").select("part").distinct().count() > 5
    for _ in range(2):
        assert sorted(tuple(r) for r in index.lookup_counts(q).collect()) == brute(queries, every)
        index.compact()


def test_modes(spark, tmp_path):
    name = next(names)
    with pytest.raises(FileNotFoundError):
        SavedIndex(spark, name)
    with pytest.raises(ValueError):
        SavedIndex(spark, name, "x")
    with pytest.raises(ValueError):
        SavedIndex(spark, "a b", "w")
    index = SavedIndex(spark, name, "a", path=str(tmp_path))
    with pytest.raises(FileNotFoundError):
        index.rows()
    index.append(frame(spark, [(1, 2, "x")]))
    reader = SavedIndex(spark, name, "r")
    assert reader.ready
    for refused in (lambda: reader.append(frame(spark, [(1, 3, "x")])), reader.compact, reader.drop):
        with pytest.raises(PermissionError):
            refused()
    with pytest.raises(FileExistsError):
        SavedIndex(spark, name, "w")
    index.compact()
    assert index.tables() == [f"{name}_base_0"]
