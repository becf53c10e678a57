"""A corpus cleaned, mixed and encoded in five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. Between two stages the rows are written as Parquet and read
again, so a lost executor repeats at most one stage. A stage begins by deleting the tables that the one before wrote on its way,
which is why its result must be written before the next begins, and why a session runs one pipeline at a time.

All stages but the last return the columns of ``documents``; ``n_chars`` follows the text where a stage changes it. NULL and
empty texts are rejected by the first stage and pass through any other; very long texts are handled whole; of repeated rows and ties
``near_dedup`` keeps one, the other stages treat each alike; further columns pass through all stages but the last, whatever their
names; an empty table passes through all of them.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, linededup, mixing, neardup, quality
from loomgraph.llm.common import discard, forget, materialise, scope, table

#: Stages that SQL can't express (an isolation forest, sketches with alignments, a dynamic program, BPE) leave no SQL for the whole.
ORACLE_SQL = None


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(f: Stage) -> Stage:
    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        forget(spark, "stage")
        with scope("stage"):
            return f(spark, docs, sf_dir)

    return run


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the isolation forest takes for anomalies go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in too many documents go; documents stay."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    return linededup.drop_frequent_lines(docs).withColumn("n_chars", F.when(F.col("lines_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*names)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return neardup.keep_one(docs)


@_stage
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the token budget of their source stay."""
    return mixing.mix(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


@_stage
def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, tokens, fragments, round_trip."""
    return bpe.encode_documents(docs, keep=("doc_id", "source"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("bpe_encoding", bpe_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the whole of ``documents``."""
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        if hasattr(before, "written_at"):
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
