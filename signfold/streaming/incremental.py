"""Structured Streaming: fingerprints that arrive are looked up in a static index, and encoded chunk by chunk.

The index side of a stream-static join is an ordinary table, re-read with each micro-batch; the sink's checkpoint
holds how far the stream has come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_lookup(stream: DataFrame, index: DataFrame, key: str = "key") -> DataFrame:
    """Adds n_hits and repr_id of the index to each streamed row; the index is aggregated by key first."""
    per_key = index.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("n_hits"), F.min("id").alias("repr_id"))
    return stream.join(per_key, stream[key] == F.col("_key"), "left").drop("_key").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)).cast("bigint"))


def windowed_hits(hits: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """(window_start, n_queries, n_hit) of tumbling windows; rows later than the watermark are left out."""
    w = hits.withWatermark(time, late).groupBy(F.window(time, width))
    return w.agg(F.count("*").alias("n_queries"), F.count_if(F.col("n_hits") > 0).alias("n_hit")).select(F.col("window.start").alias("window_start"), "n_queries", "n_hit")


def append_to(stream: DataFrame, path: str, checkpoint: str, now: bool = True) -> StreamingQuery:
    """Append a stream to a Parquet table, restartable from the checkpoint; now: work off what is there, then stop."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if now else writer).start()
