"""A saved index: a base and later deltas, each a table clustered by key, and lookups that move queries only.

The tables of an index are named by its version: `<name>_base_<v>` and `<name>_delta_<v>_<k>`. A table shows in the
catalog once it is whole, so an append or a compaction that dies leaves the index as it was. Compaction writes the base
of the next version and then drops the last one's tables. There is one writer at a time; readers see the tables that
were there when they opened the index.

Clusters are by (key, part). A key of more than `part_rows` rows in a batch is dealt to several parts by a hash of the
id, so that no cluster is one key's; a second table of the batch (`..._parts`) names these keys, of which there are
fewer than rows / part_rows. Lookups ask for each part of a key.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import discard_path

MODES = ("r", "w", "a")
#: Rows of a key in one part.
PART_ROWS = 1_000_000


class SavedIndex:
    """mode "r": an index that is there, for lookups only; "w": a new one; "a": one that is there, or else a new one.

    path: a folder that the cluster shares, for the files of its tables; without one they are in the warehouse.
    """

    def __init__(self, spark: SparkSession, name: str, mode: str = "r", buckets: int = 64, part_rows: int = PART_ROWS, path: str | None = None):
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}, not {mode}")
        if not re.fullmatch(r"[a-z]\w*", name):
            raise ValueError(f"{name} is no table name")
        self.spark, self.name, self.mode, self.buckets, self.part_rows, self.path = spark, name, mode, buckets, part_rows, path
        if mode == "r" and not self.tables():
            raise FileNotFoundError(f"there is no index {name}")
        if mode == "w" and self.tables():
            raise FileExistsError(f"index {name} is there already")

    def _named(self) -> list[tuple[int, int, str]]:
        found = [re.fullmatch(rf"{self.name}_(?:base_(\d+)|delta_(\d+)_(\d+))", t.name) for t in self.spark.catalog.listTables(pattern=f"{self.name}_*")]
        return sorted((int(m[1] or m[2]), int(m[3] or 0), m[0]) for m in found if m)

    @property
    def version(self) -> int:
        """Of the newest base; -1 without one."""
        return max((v for v, k, t in self._named() if not k), default=-1)

    def tables(self) -> list[str]:
        """Of the version that is current: base, then deltas in order."""
        now = self.version
        return [t for v, _, t in self._named() if v == now]

    @property
    def ready(self) -> bool:
        return bool(self.tables())

    def _writable(self) -> None:
        if self.mode == "r":
            raise PermissionError(f"index {self.name} was opened for reading")

    def _save(self, rows: DataFrame, table: str, clustered: bool = True) -> None:
        out = rows.write.bucketBy(self.buckets, "key", "part").sortBy("key", "part", "id") if clustered else rows.write
        (out.option("path", f"{self.path}/{table}") if self.path else out).mode("overwrite").saveAsTable(table)

    def _drop(self, tables: list[str]) -> None:
        for t in [x for t in tables for x in (t, f"{t}_parts")]:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
            if self.path:
                discard_path(self.spark, f"{self.path}/{t}")

    def append(self, rows: DataFrame) -> None:
        """Add a batch of (key, id[, label]): as the base if there is none, else as a delta. What is there is not read."""
        self._writable()
        named = self._named()
        now = self.version
        table = f"{self.name}_base_0" if now < 0 else f"{self.name}_delta_{now}_{1 + max(k for v, k, _ in named if v == now)}"
        sizes = rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > self.part_rows)
        parts = sizes.select("key", F.ceil(F.col("n") / self.part_rows).cast("int").alias("parts"))
        self._save(parts, f"{table}_parts", clustered=False)
        split = rows.join(F.broadcast(self.spark.table(f"{table}_parts")), "key", "left")
        dealt = split.withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
        # One file a cluster, or the sort order of files would be of no use.
        self._save(dealt.repartition(self.buckets, "key", "part"), table)

    def _present(self) -> list[str]:
        tables = self.tables()
        if not tables:
            raise FileNotFoundError(f"index {self.name} has no rows yet")
        return tables

    def rows(self) -> DataFrame:
        """(key, id[, label], part) of base and deltas.

        Their files are read without their clusters: Spark 4.1.2 takes a union of clustered tables for clustered, does
        not read it so, and then counts a key in each table apart when the union is aggregated.
        """
        first, *rest = [self._plain(t) for t in self._present()]
        for t in rest:
            first = first.unionByName(t)
        return first

    def _plain(self, table: str) -> DataFrame:
        where = next(r.data_type for r in self.spark.sql(f"DESCRIBE FORMATTED {table}").collect() if r.col_name == "Location")
        return self.spark.read.schema(self.spark.table(table).schema).parquet(where)

    def parts(self) -> DataFrame:
        """(key, parts) of the keys that have more than one."""
        every = [self.spark.table(f"{t}_parts") for t in self.tables()]
        out = every[0]
        for t in every[1:]:
            out = out.unionByName(t)
        return out.groupBy("key").agg(F.max("parts").alias("parts"))

    def asked(self, queries: DataFrame, query_id: str = "query_id", key: str = "key") -> DataFrame:
        """(query_id, key, part): a row for each part that the query's key has."""
        q = queries.select(F.col(query_id).alias("query_id"), F.col(key).alias("key")).join(F.broadcast(self.parts()), "key", "left")
        return q.select("query_id", "key", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))

    def _met(self, queries: DataFrame, query_id: str, key: str, of=lambda t: t) -> DataFrame:
        """Queries joined with each table (a join with their union would deal the union anew), as one."""
        asked = self.asked(queries, query_id, key)
        first, *rest = [asked.hint("merge").join(of(self.spark.table(t)), ["key", "part"]).drop("key", "part") for t in self._present()]
        for r in rest:
            first = first.unionByName(r)
        return first

    def lookup(self, queries: DataFrame, query_id: str = "query_id", key: str = "key") -> DataFrame:
        """(query_id, id, ...) of all hits. Queries are dealt to the index's clusters; the index stays where it is."""
        return self._met(queries, query_id, key)

    def lookup_counts(self, queries: DataFrame, query_id: str = "query_id", key: str = "key") -> DataFrame:
        """(query_id, n_hits, min_id, max_id). Hits are counted by cluster first, so a heavy key is as many rows as it has parts."""
        counts = [F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")]
        found = self._met(queries, query_id, key, lambda t: t.groupBy("key", "part").agg(*counts))
        none = queries.select(F.col(query_id).alias("query_id"), F.lit(0).cast("bigint").alias("n"), *[F.lit(None).cast("bigint").alias(c) for c in ("lo", "hi")])
        return found.unionByName(none).groupBy("query_id").agg(F.sum("n").alias("n_hits"), F.min("lo").alias("min_id"), F.max("hi").alias("max_id"))

    def compact(self) -> None:
        """Merge base and deltas into the base of a new version, one file a cluster: each row is moved once.

        Keys that were split in one of the batches may then have rows in part 0 and in others; lookups ask for all.
        """
        self._writable()
        old = self.tables()
        if len(old) < 2:
            return
        table = f"{self.name}_base_{self.version + 1}"
        self._save(self.parts(), f"{table}_parts", clustered=False)
        self._save(self.rows().repartition(self.buckets, "key", "part"), table)
        self._drop(old)

    def drop(self) -> None:
        self._writable()
        self._drop([t for _, _, t in self._named()])
