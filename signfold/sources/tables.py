"""Parquet tables with the guards and restarts that the file-based formats had."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def workspace(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir). Where that is unset a local master gets a temporary folder, a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    root = root or tempfile.mkdtemp(prefix="signfold-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again, so that a lost executor costs no recomputation."""
    path = workspace(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*frames: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more; others are left alone."""
    for t in frames:
        path = getattr(t, "scratch_path", None)
        if path:
            discard_path(t.sparkSession, path)


def release(result: DataFrame) -> None:
    """Delete the intermediate tables that a result reads (its attribute `spent`), once the result has been used."""
    discard(*getattr(result, "spent", ()))
    result.spent = []


def save(df: DataFrame, path: str, force: bool = False) -> None:
    """Write; an existing target is an error unless forced."""
    df.write.mode("overwrite" if force else "errorifexists").parquet(path)


def read(spark: SparkSession, path: str, columns: list[str] | None = None, start: int | None = None, stop: int | None = None, id: str = "id") -> DataFrame:
    """Columns and a half-open id range; both reach the scan."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.filter(F.col(id) >= start)
    if stop is not None:
        df = df.filter(F.col(id) < stop)
    return df.select(*columns) if columns else df


def eager(df: DataFrame) -> DataFrame:
    """Load now and keep; spills to disk where memory is short."""
    df = df.persist()
    df.count()
    return df


def table_path(root: str, task: str, model: str, name: str, checkpoint: str, table: str) -> str:
    return "/".join(x.strip("/") if i else x.rstrip("/") for i, x in enumerate((root, task, model, name, checkpoint, table)))


def merge_shards(shards: list[DataFrame], expected: list[int] | None = None) -> DataFrame:
    """Shards under one schema, in order of a `shard` column; unequal schemas or row counts are errors."""
    if not shards:
        raise ValueError("no shards")
    for s in shards[1:]:
        if dict(s.dtypes) != dict(shards[0].dtypes):
            raise ValueError("shards differ in their columns")
    parts = [s.withColumn("shard", F.lit(i)) for i, s in enumerate(shards)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if expected is not None:
        found = {r.shard: r.n for r in out.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        short = [i for i, n in enumerate(expected) if found.get(i, 0) != n]
        if short:
            raise ValueError(f"shards {short} are incomplete")
    return out


def merge_table(rows: DataFrame, shard: Column, expected: DataFrame) -> DataFrame:
    """Any number of shards that lie in one table: its rows with the `shard` that each is of; row counts other than those of `expected` (shard, n) are an error.

    Counts are compared where they are, so a plan of one scan does for all shards and only the first few wrong ones reach the driver.
    """
    out = rows.withColumn("shard", shard)
    found = out.groupBy("shard").agg((-F.count("*")).alias("n"))
    wrong = expected.select("shard", "n").unionByName(found).groupBy("shard").agg(F.sum("n").alias("n")).filter("n <> 0")
    few = [r.shard for r in wrong.orderBy("shard").limit(10).collect()]
    if few:
        raise ValueError(f"shards {few} are incomplete")
    return out


class ResumableSink:
    """A table written chunk by chunk: chunks that are complete are not written again after a restart.

    A chunk is a partition of the table; its directory appears by the commit of its write, so a chunk that exists is
    whole. pending() leaves the rows of finished chunks out before anything expensive runs on them.
    """

    def __init__(self, spark: SparkSession, path: str, chunk_size: int, id: str = "id"):
        self.spark, self.path, self.chunk_size, self.id = spark, path, chunk_size, id

    def chunk(self):
        return F.call_function("div", F.col(self.id), F.lit(self.chunk_size).cast("bigint"))

    def finished(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], "chunk bigint")
        return self.spark.read.parquet(self.path).select(F.col("chunk").cast("bigint").alias("chunk")).distinct()

    def pending(self, df: DataFrame) -> DataFrame:
        return df.withColumn("chunk", self.chunk()).join(F.broadcast(self.finished()) if self._few() else self.finished(), "chunk", "left_anti")

    def _few(self) -> bool:
        return self.finished().limit(100_001).count() <= 100_000

    def write(self, df: DataFrame) -> None:
        """Append the rows of df, which holds whole chunks with their `chunk` column."""
        df.repartition("chunk").write.mode("append").partitionBy("chunk").parquet(self.path)


def split_range(which: str, splits: dict[str, tuple[int, int]]) -> tuple[int, int]:
    """The half-open id range of a named split."""
    if which not in splits:
        raise ValueError(f"unknown split {which}; known are {sorted(splits)}")
    return splits[which]
