"""A procedural table as a Python data source: chunks are made where they are read, up to MOST_VALUES numbers in a partition's chunks.

    spark.read.format("procedural").options(seed=7, size=10_000, chunk_size=500, width=4).load()

Row i is one of its chunk's draws, whatever else is read. Filters on the id choose the chunks before any is made; ids
that are asked for one by one and lie outside the table are an error.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: A chunk's seed is SEEDS * chunk + seed, so no two (seed, chunk) agree.
SEEDS = 0xFFFF
#: Chunks of labels-driven tables, and what a split adds to three times their seed.
LABELS_CHUNK = 500
#: Tables of up to so many chunks have a partition for each; of larger ones, partitions take several chunks each, as many as make so many numbers at most.
FEW_CHUNKS, MOST_VALUES = 64, 1 << 20
SPLITS = {"train": 0, "valid": 1, "test": 2}


@dataclass
class Chunks(InputPartition):
    numbers: Sequence[int]


class Reader(DataSourceReader):
    def __init__(self, seed: int, size: int, chunk_size: int, width: int):
        if not 0 <= seed < SEEDS:
            raise ValueError(f"seed must lie in [0, {SEEDS})")
        if size < 0 or chunk_size < 1 or width < 1:
            raise ValueError("size must not be negative, chunk_size and width must be positive")
        self.seed, self.size, self.chunk_size, self.width = seed, size, chunk_size, width
        self.low, self.high, self.ids = 0, size, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Ranges and lists of ids choose chunks; all filters stay with Spark, which drops the other rows of a chunk."""
        for f in filters:
            if getattr(f, "attribute", None) == ("id",):
                if isinstance(f, (EqualTo, In)):
                    asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                    if wrong := sorted(i for i in asked if i is not None and not 0 <= i < self.size):
                        raise IndexError(f"{wrong[:5]} are out of range")
                    self.ids = asked if self.ids is None else self.ids & asked
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value + isinstance(f, LessThanOrEqual))
            yield f

    def partitions(self) -> list[Chunks]:
        if self.ids is not None:
            numbers = sorted({i // self.chunk_size for i in self.ids if i is not None and self.low <= i < self.high})
        else:
            numbers = range(self.low // self.chunk_size, -(-self.high // self.chunk_size)) if self.low < self.high else ()
        each = 1 if len(numbers) <= FEW_CHUNKS else max(1, min(MOST_VALUES // (self.chunk_size * self.width), len(numbers) // FEW_CHUNKS))
        return [Chunks(numbers[i : i + each]) for i in range(0, len(numbers), each)] or [Chunks(())]

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        for number in partition.numbers:
            first = number * self.chunk_size
            n = min(self.chunk_size, self.size - first)
            values = np.random.default_rng(SEEDS * number + self.seed).random((n, self.width))
            ends = pa.array(np.arange(n + 1) * self.width, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), pa.ListArray.from_arrays(ends, pa.array(values.ravel()))], names=["id", "values"])


class ProceduralSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "procedural"

    def schema(self) -> str:
        return "id bigint, values array<double>"

    def reader(self, schema) -> Reader:
        given = {k: int(self.options.get(k, default)) for k, default in (("seed", 0), ("size", 0), ("chunk_size", LABELS_CHUNK), ("width", 1))}
        return Reader(**given)


def load(spark: SparkSession, seed: int, size: int, chunk_size: int = LABELS_CHUNK, width: int = 1) -> DataFrame:
    """(id, values) with id filters pushed into the source."""
    # The planner's and the executors' Python get the classes themselves, wherever the package is.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ProceduralSource)
    return spark.read.format("procedural").options(seed=seed, size=size, chunk_size=chunk_size, width=width).load()


def labelled(spark: SparkSession, labels: DataFrame, size: int, which: str, seed: int, width: int = 1, make: Column | None = None) -> DataFrame:
    """(id, label, values) of (id, label) rows with ids of [0, size): an item is its label plus the draws of its id; a split never shares a seed with another.

    make: another way to make the values, of the columns label and noise.
    """
    if not 0 <= seed < SEEDS // 3:
        raise ValueError(f"seed must lie in [0, {SEEDS // 3})")
    noise = load(spark, 3 * seed + SPLITS[which], size, LABELS_CHUNK, width).withColumnRenamed("values", "noise")
    made = make if make is not None else F.transform("noise", lambda x: x + F.col("label"))
    return labels.select("id", "label").join(noise, "id").select("id", "label", made.alias("values"))
