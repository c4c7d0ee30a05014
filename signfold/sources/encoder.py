"""Encoders turn items into logits. The network is a plug-in; a seeded sign-random projection is built in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Encoder = Callable[[np.ndarray], np.ndarray]


def random_projection(width: int, bits: int, seed: int = 0, orthogonal: bool = False) -> Encoder:
    """Signs of its logits are sides of random planes through the origin; orthogonal ones (bits <= width) split items with independent numbers evenly.

    In a space of few dimensions planes bound few cells (64 of them in 8 dimensions about 10 ** 9), so unlike items
    come to share codes; only as many dimensions as bits leave all 2 ** bits codes open.
    """
    matrix = np.random.default_rng(seed).normal(size=(width, bits))
    if orthogonal:
        if bits > width:
            raise ValueError("no more orthogonal planes than dimensions")
        matrix = np.linalg.qr(matrix)[0]
    return lambda x: x @ matrix


def encode(df: DataFrame, encoder: Encoder, id: str = "id", payload: str = "payload", batch: int = 4096) -> DataFrame:
    """(id, logits): the encoder on (n, width) arrays, an Arrow batch at a time; payload: ARRAY<FLOAT> of one width."""
    schema = pa.schema([("id", pa.int64()), ("logits", pa.list_(pa.float32()))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for a in range(0, part.num_rows, batch):
                piece = part.slice(a, batch)
                x = np.asarray(piece.column(1).flatten(), dtype=np.float64).reshape(piece.num_rows, -1)
                y = np.asarray(encoder(x), dtype=np.float32)
                ends = np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(y.ravel()))], schema=schema)

    return df.selectExpr(f"CAST({id} AS BIGINT) AS id", payload).mapInArrow(run, "id bigint, logits array<float>")


def rescale(x: np.ndarray) -> np.ndarray:
    """uint8 pixels to [-1, 1]."""
    return (x.astype(np.float32) - 127.5) / 127.5


def binary_items(spark: SparkSession, path: str, pattern: str = "*", ids: dict[str, int] | None = None) -> DataFrame:
    """(id, path, content) of the files under a path, read lazily: the id is the place of the path in name order, or given by `ids`.

    Listing is by Spark; only rows that are used have their content read, a projection without it reads none.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    if ids is not None:
        names = F.create_map(*[x for k, v in ids.items() for x in (F.lit(k), F.lit(v))])
        return files.select(names[F.element_at(F.split("path", "/"), -1)].cast("bigint").alias("id"), "path", "content").filter("id IS NOT NULL")
    order = files.select("path").withColumn("id", F.row_number().over(Window.orderBy("path")).cast("bigint") - 1)
    return order.join(files.select("path", "content"), "path").select("id", "path", "content")


def decode(items: DataFrame, decoder: Callable[[bytes], np.ndarray], id: str = "id", content: str = "content") -> DataFrame:
    """(id, shape, payload): a decoder plug-in on each file's bytes, in Arrow batches."""
    schema = pa.schema([("id", pa.int64()), ("shape", pa.list_(pa.int32())), ("payload", pa.list_(pa.float32()))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for ident, data in zip(part.column(0).to_pylist(), part.column(1)):
                x = np.asarray(decoder(data.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([ident], pa.int64()), pa.array([list(x.shape)], pa.list_(pa.int32())), pa.array([x.ravel().astype(np.float32)], pa.list_(pa.float32()))], schema=schema)

    return items.selectExpr(f"CAST({id} AS BIGINT) AS id", content).mapInArrow(run, "id bigint, shape array<int>, payload array<float>")
