"""The corpus pipeline: five operators one after another, each stage written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from silt.llm import stages
from silt.llm.common import scratch_path, table

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("line_dedup", stages.line_dedup),
    ("ngram_jaccard_join", stages.ngram_jaccard_join),
    ("benchmark_decontamination", stages.benchmark_decontamination),
    ("source_mixing", stages.source_mixing),
]

#: MinHash, shingle sets and hash-driven rounding are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over documents; stages are written below spark.checkpoint.dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
