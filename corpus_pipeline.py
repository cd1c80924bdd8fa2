"""The corpus pipeline: from all documents to a training mix, in five stages.

Each stage takes all rows that the one before kept and returns rows with the columns of documents (the last one adds
domain, n_tokens and copies). run() writes every stage's rows to the shared folder and reads them back, so a lost
executor costs one stage at most. Empty documents, null texts and ids, repeated rows and extra columns are treated as the
operators say; texts of any length are taken whole, ties go to the smaller id, and empty documents give an empty mix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pricemesh import staging
from pricemesh.llm import decontaminate, line_runs, mixing, quality_model, queries, simhash

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read like trusted text; the others go."""
    return quality_model.keep_good(docs, queries.trusted_rows(spark, sf_dir))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated line runs; a document of which no word is left goes."""
    cut = line_runs.deduplicate(docs)
    gone = (F.col("n_lines_cut") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return cut.where(~gone).drop("n_lines_cut")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: the one with the smallest doc_id."""
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which fewer than one word in twenty comes from the benchmark."""
    return decontaminate.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents picked for the target weights, with the number of epochs each appears in."""
    return mixing.mix(
        docs, queries.domain_of_source(), queries.MIX_PERCENT, queries.MIX_WEIGHTS, max_epochs=queries.MIX_EPOCHS, seed=queries.MIX_SEED
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mix", mix),
]
#: Perplexities of a model trained on the way and suffix ranks are beyond SQL; tests compare with brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the result is read from the last stage's table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staging.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
