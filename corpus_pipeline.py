"""Documents to packed token ids: quality, near duplicates, benchmark leaks, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, in the columns of ``documents``; the last one
returns packed rows. In every stage null texts count as empty and an empty table gives an empty table; extra columns are
kept but for the last stage, whatever their names; very long texts are read whole. Rows without an id are told by their
text (shared.row_key). Rows that repeat an id share their fate, but near_dedup leaves one row of each id that has words.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from maskwright.llm.decontaminate import without_leaks
from maskwright.llm.mixing import mixed
from maskwright.llm.near_dedup import one_of_each
from maskwright.llm.packing import pack_tokens
from maskwright.llm.quality import accepted
from maskwright.llm.shared import cut, forget_paths, scratch, small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score 0.3 or more). Null and empty texts are scored like others."""
    return accepted(docs, _table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest id. Documents without words all stay."""
    small_batches(spark)
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture wants them: each rate rounded by a hash of the id."""
    return mixed(docs, _table(spark, sf_dir, "labels"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids. Documents without tokens leave nothing."""
    small_batches(spark)
    return pack_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mixing", mixing), ("pack", pack)]

#: SQL can't express the fitted stages: the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet into the shared folder and read again; what a stage wrote
    by the way is deleted once its result is written."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch() as made:
            docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        forget_paths(spark, [p for p in made if p != docs.written_to])
    return STAGES[-1][1](spark, docs, sf_dir)
