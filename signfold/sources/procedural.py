"""Procedural tables: a row is a function of the seed and its chunk, and is made on demand, in any order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEEDS = 0xFFFF
SPLITS = {"train": 0, "valid": 1, "test": 2}


def chunk_seed(seed: int, chunk: int) -> int:
    """65535 * chunk + seed: no two (seed, chunk) agree."""
    return SEEDS * chunk + seed


class ProceduralTable:
    """make(rng, n) -> n values, for one chunk; value i of the table is value i % chunk_size of its chunk."""

    def __init__(self, seed: int, size: int, chunk_size: int, make: Callable[[np.random.Generator, int], np.ndarray]):
        if not 0 <= seed < SEEDS:
            raise ValueError(f"seed must lie in [0, {SEEDS})")
        if size < 0 or chunk_size < 1:
            raise ValueError("size must not be negative and chunk_size must be positive")
        self.seed, self.size, self.chunk_size, self.make = seed, size, chunk_size, make

    def _chunk(self, number: int) -> np.ndarray:
        n = min(self.chunk_size, self.size - number * self.chunk_size)
        return self.make(np.random.default_rng(chunk_seed(self.seed, number)), n)

    def frame(self, spark: SparkSession, start: int = 0, stop: int | None = None) -> DataFrame:
        """(id, value) of a range: whole chunks are dealt to tasks, others are never made.

        A row of the plan's range is a chunk, so Spark takes the table for chunk_size times smaller than it is. The hint keeps joins from broadcasting it.
        """
        stop = self.size if stop is None else min(stop, self.size)
        first, last = start // self.chunk_size, -(-stop // self.chunk_size)
        if stop <= start:
            return spark.createDataFrame([], "id bigint, value double")

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for number in part["id"]:
                    values = self._chunk(int(number))
                    ids = np.arange(len(values)) + int(number) * self.chunk_size
                    keep = (ids >= start) & (ids < stop)
                    yield pd.DataFrame({"id": ids[keep], "value": np.asarray(values, dtype=float)[keep]})

        return spark.range(first, last).mapInPandas(run, "id bigint, value double").hint("merge")

    def rows(self, ids: DataFrame, id: str = "id") -> DataFrame:
        """(id, value) of the requested ids, repetitions kept, nulls left out, ids out of range an error; a chunk is made once for all ids of it that meet in a task."""
        inside = (F.col(id) >= 0) & (F.col(id) < self.size)
        wanted = ids.select(F.when(inside | F.col(id).isNull(), F.col(id)).otherwise(F.raise_error(F.concat(F.col(id).cast("string"), F.lit(" is out of range")))).cast("bigint").alias("id")).filter("id IS NOT NULL")
        chunk = F.call_function("div", F.col("id"), F.lit(self.chunk_size).cast("bigint"))

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            number, values = -1, None
            for part in parts:
                out = np.empty(len(part))
                for k, i in enumerate(part["id"]):
                    if i // self.chunk_size != number:
                        number = i // self.chunk_size
                        values = self._chunk(int(number))
                    out[k] = values[i % self.chunk_size]
                yield pd.DataFrame({"id": part["id"], "value": out})

        return wanted.withColumn("chunk", chunk).repartition("chunk").sortWithinPartitions("id").select("id").mapInPandas(run, "id bigint, value double")

    def __getitem__(self, k):
        """Driver-side access: an integer (negative from the end), a list, or a forward slice."""
        if isinstance(k, slice):
            if k.step == 0:
                raise ValueError("a slice's step must not be 0")
            if k.step is not None and k.step < 0:
                raise NotImplementedError("slices run forward")
            places = list(range(*k.indices(self.size)))
            if not places:
                raise RuntimeError("the slice is empty")
            return self[places]
        if isinstance(k, list | tuple):
            made: dict[int, np.ndarray] = {}
            out = []
            for i in k:
                i = self._place(i)
                c = i // self.chunk_size
                if c not in made:
                    made[c] = self._chunk(c)
                out.append(made[c][i % self.chunk_size])
            return np.array(out)
        i = self._place(k)
        return self._chunk(i // self.chunk_size)[i % self.chunk_size]

    def _place(self, i: int) -> int:
        if not -self.size <= i < self.size:
            raise IndexError(f"{i} is out of range")
        return i % self.size


def labels_seed(seed: int, which: str) -> int:
    """Seed of a labels-driven table: splits never share one."""
    if not 0 <= seed < SEEDS // 3:
        raise ValueError(f"seed must lie in [0, {SEEDS // 3})")
    return 3 * seed + SPLITS[which]


def labels_table(labels: DataFrame, which: str, seed: int, noise: float = 1.0, id: str = "id", label: str = "label") -> DataFrame:
    """(id, label, value): a label's value with noise that depends on the seed, the split and the id alone."""
    s = labels_seed(seed, which)
    return labels.select(F.col(id).alias("id"), F.col(label).alias("label"), (F.col(label) + F.lit(noise) * unit(s, id)).alias("value"))


def unit(seed: int, id: str) -> Column:
    """A hashed number of [0, 1) for each id."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(id)), F.lit(1 << 30)) / F.lit(float(1 << 30))
