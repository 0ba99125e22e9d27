"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns what stays of docs, in docs' columns.

All but the last return the columns of documents; nulls, repeated rows and empty tables are treated as the operators'
docstrings say. A stage's result is written before it is let go, see common.step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silt.llm import decontam, jaccard, lines, mixing, quality
from silt.llm.common import step, table


def _row(docs: DataFrame, but: tuple[str, ...] = ()) -> Column:
    """All columns of docs but some as one struct, which no column that an operator adds can clash with."""
    return F.struct(F.lit(0).alias("silt"), *[F.col(f"`{c}`") for c in docs.columns if c not in but]).alias("silt_row")


def _own(docs: DataFrame, **changed: Column) -> list[Column]:
    """The columns of docs from the struct, or those given for them."""
    return [changed[c].alias(c) if c in changed else F.col(f"silt_row.`{c}`") for c in docs.columns]


@step
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; their texts stay as they are."""
    judged = quality.line_first_cleaning(docs.select(_row(docs), F.col("text").alias("silt_text")), "silt_text")
    return judged.where("kept").select(*_own(docs))


@step
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less their repeated lines; one that lost lines and has no words left goes. n_chars is counted anew."""
    out = lines.dedup_lines(docs.select("doc_id", "text", _row(docs, ("doc_id", "text"))))
    out = out.where("n_removed = 0 or n_removed < n_lines")
    own = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("silt_row.n_chars"))
    return out.select(*_own(docs, **own))


@step
def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest doc_id."""
    return jaccard.one_of_each(docs)


@step
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a leak of a benchmark item."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


@step
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, numbered by `copy`."""
    return mixing.mix(docs)
