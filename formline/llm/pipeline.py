"""A training corpus from raw documents, in five stages.

quality rules -> near duplicates -> secrets -> mix of sources -> sampled segmentations. Each stage takes (spark, docs, sf_dir) and
returns a DataFrame; run() writes each result as Parquet in the shared folder and reads it again for the next.
All stages but the last return the columns of documents, whatever they are named beside doc_id, text and source. Null and empty texts fail the quality rules; the
other stages, given them, keep them. An empty table gives empty results. A stage deletes the scratch tables of the stages before it, as their results
are stored by then.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from formline.llm import common, op1_quality, op2_pieces, op4_secrets, op5_jaccard, op9_mixing

_scratch: list[str] = []


def _stage(f: Callable) -> Callable:
    """f, with scratch tables of earlier stages deleted first and its own noted."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.release(spark, _scratch)
        _scratch.clear()
        with common.scratch_tables(_scratch):
            return f(spark, docs, sf_dir)

    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return op1_quality.filter_quality(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links connect: the one with the smallest doc_id. Differing rows of one doc_id are documents of their own."""
    return op5_jaccard.one_of_each(docs)


@_stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return op4_secrets.redact(docs)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weight: whole documents, as often as the mix takes them."""
    return op9_mixing.emit(docs)


@_stage
def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations: doc_id, sample, ids, log_p, perturbed, log_inclusion."""
    return op2_pieces.encode(docs)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("secrets", secrets), ("mix of sources", mix), ("sampled segmentations", pieces)]

#: Expectation-maximisation and hashed sampling noise cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents table in sf_dir."""
    docs, before = common.documents(spark, sf_dir), []
    for name, stage in STAGES:
        now: list[str] = []
        out = stage(spark, docs, sf_dir)
        with common.scratch_tables(now):
            docs = common.materialize(out, f"pipeline-{name.replace(' ', '-')}")
        common.release(spark, before)
        before = now
    return docs
