"""A store of training logs as a stream: records come in, one row for each step and metric is kept up to date.

The sums live in the stream's state, so a restart goes on from the checkpoint, and what was read is not read again. Each
micro-batch writes the rows it changed under its own number; a batch that is run again after a failure writes over
itself. Reading takes the newest row of each key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ROWS = "step bigint, metric string, n bigint, max_value double, mean_value double, last_value double, last_seq bigint, batch bigint"


def upsert(records: DataFrame, path: str, checkpoint: str, now: bool = True) -> StreamingQuery:
    """Stream (seq, step, metric, value) records into the store; of a key's values the one of the largest seq is its last. now: work off what is there, then stop."""
    some = records.filter(F.col("value").isNotNull())
    kept = some.groupBy("step", "metric").agg(F.count("*").alias("n"), F.max("value").alias("max_value"), F.avg("value").alias("mean_value"), F.max_by("value", "seq").alias("last_value"), F.max("seq").alias("last_seq"))

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = kept.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if now else writer).start()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of each (step, metric); ties cannot be, since a batch has a key once."""
    rows = spark.read.schema(ROWS).parquet(path)
    values = [c for c in rows.columns if c not in ("step", "metric", "batch")]
    newest = rows.groupBy("step", "metric").agg(F.max_by(F.struct(*values), "batch").alias("row"))
    return newest.select("step", "metric", "row.*")


def render(log: DataFrame) -> DataFrame:
    """(step, text): the metrics of a step in one line, by name."""
    parts = F.format_string("%s:%.4f", "metric", "last_value")
    lines = log.groupBy("step").agg(F.array_sort(F.collect_list(F.struct("metric", parts.alias("part")))).alias("parts"))
    return lines.select("step", F.array_join(F.transform("parts", lambda p: p.part), " - ").alias("text"))
