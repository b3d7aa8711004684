"""A training-corpus pipeline: quality rules, line dedup, near-duplicate documents, benchmark decontamination, mixing of sources.

Each stage works on what the one before it kept, written as Parquet and reread. run() applies them to documents.

Defined results, at every stage: an empty table gives an empty one; repeated rows are one document in the n-gram join, which keeps one
of them, and are treated alike elsewhere; null ids come first; a null or empty text fails the quality rules, and a stage by itself
takes it as a text without words: it keeps its lines, is no near duplicate, holds no benchmark passage and counts 0 words in the mix;
extra columns, whatever their names, go through all stages but the last as they are (n_chars is counted anew where lines went).
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontam, line_dedup, mixing, ngram_join, quality, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Intermediate tables of the last stage that was called, by application. Its result has been written when the next one is called.
_behind: dict[str, list[str]] = {}


def _stage(f: Stage) -> Stage:
    """f, which first deletes the intermediate tables of the stage before it."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app, n = spark.sparkContext.applicationId, len(scratch.made)
        scratch.drop(spark, _behind.pop(app, []))
        out = f(spark, docs, sf_dir)
        _behind[app] = scratch.made[n:]
        return out

    return run


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules, weighed by how often they are right, take for good."""
    return quality.keep_good(docs)


@_stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that are like an earlier line of the corpus; documents of which nothing is left go."""
    out = line_dedup.dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.keep_first(docs)


@_stage
def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mixing.mix_documents(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", lines), ("ngram_join", near_duplicates), ("decontamination", clean_of_benchmark), ("mixing", mixed)]

#: The quality rules are weighed by expectation-maximisation, which SQL can't express; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
