"""The corpus pipeline: five stages, each on all that the one before kept.

Language identification drops what its model rejects; near-duplicate detection keeps one
document of each group; suffix arrays cut repeated strings; decontamination drops documents that
overlap the benchmark; packing gives the pieces of training sequences.

A stage's result reads working tables of that stage, which the next call of a stage deletes (its own ones alone, not those of other
queries): write it first, as ``run`` does.

Cases: nulls in any column, empty and very long texts, repeated rows, empty tables and columns with clashing names are what the
operators of the stages say: a null text has no language and goes; rows without an id pass near-duplicate detection and
repeat removal as they are; rows that repeat a kept id stay, each; a text that overlaps the benchmark goes in every row that has it; a document of
packing gives its end token at least. Columns beyond the documents' own pass through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernstone import ship
from quernstone.llm import decontaminate, language_id, near_dedup, packing, suffix_dedup
from quernstone.llm.common import discard, narrow_batches, recording, scratch_path

#: Near duplicates: five words, a similarity of 0.8 or more.
NEAR_PERCENT = 80
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Working tables of the stage called last.
_tables: list[str] = []


def _stage(function: Stage) -> Stage:
    """What the stage before has returned is written by now, so its working tables go."""

    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        narrow_batches(spark)
        discard(spark, _tables)
        with recording(_tables):
            return function(spark, docs, sf_dir)

    stage.__name__, stage.__doc__ = function.__name__, function.__doc__
    return stage


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the model, learned from labelled rows of ``docs``, takes for no learned language."""
    return language_id.keep_identified(docs, language_id.fit(docs))


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group; rows without an id stay."""
    return near_dedup.keep_representatives(docs, percent=NEAR_PERCENT)


@_stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings that also stand in a document with a smaller id; the rows stay."""
    return suffix_dedup.cut_repeats(docs)


@_stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that overlap an item of the benchmark."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, of all rows."""
    return packing.pack(docs)


STAGES = [
    ("language id", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("repeated strings", cut_repeats),
    ("decontamination", decontaminated),
    ("packing", pack),
]

#: SQL expresses none of the stages but near duplicates and repeats; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        discard(spark, before)
        before = [path]
    discard(spark, _tables)
    return docs
