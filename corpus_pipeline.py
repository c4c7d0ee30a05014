"""The corpus pipeline: quality, exact dedup, near dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet and reads it again as
the next stage's docs. All stages but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from signfold.llm import decontaminate, exact_dedup, mixing, near_dedup, quality
from signfold.llm.queries import domains
from signfold.llm.shared import discard, written

#: Documents below this score are rejected: those that the model takes for junk, not those it is unsure of.
LEAST_QUALITY = 0.3
#: Shares of the expected tokens. Few documents of low quality are left by then; theirs is no domain here, so what is left of them counts as high or toxic.
TARGETS = {"high": 0.95, "toxic": 0.05}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.good_rows(docs, model, LEAST_QUALITY)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.kept_rows(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.kept_rows(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: its tokens, posteriors and rate, how often a sampler is to draw it; at rate 0 it never is. Rows stay, since posteriors are soft and the draw is the sampler's."""
    return mixing.mix(docs, domains(spark.read.parquet(f"{sf_dir}/labels.parquet")), TARGETS)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("mixing to target weights", mixing_stage),
]

#: SQL can't express trees, sketches and the fit; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        past, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(past)
    return docs
