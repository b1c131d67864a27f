"""A corpus pipeline of five stages over `documents`. Each stage's rows are written as Parquet and read again by the next.

1. quality: documents that the repetition rules reject go.
2. line_dedup: common blocks of lines are deleted from later documents; a document of which nothing is
   left goes, and n_chars is counted anew where lines went.
3. near_dup: one document of each group of near duplicates stays.
4. decontaminate: documents with a hit of a benchmark window go.
5. mix: the documents with the words that the mix takes of each, in all and for each output shard.

Defined results, in every stage: an empty table gives an empty one with the stage's columns; other columns pass through whatever
their names, but for the columns that mix adds, which replace columns of their names. A null or empty text has no words: quality
drops it (fewer words than the least); the later stages, given one, keep it, and mix takes nothing of it. A null doc_id is kept
and comes before all others. Repeated rows: quality, decontaminate and mix treat each alike by itself, line_dedup too (rows
of one doc_id and text are one document), near_dup keeps one of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from relspark.llm import decontaminate, jaccard, linededup, mixing, repetition
from relspark.shared import delete_folder, shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base rules and the repetition rules keep; a null or empty text goes."""
    return repetition.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without blocks of earlier ones; a null or empty text stays as it is, a document that loses all its lines goes."""
    return linededup.clean(docs)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id (null first) of each class; documents without words all stay."""
    return jaccard.keep_one(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a benchmark window, with texts as they are; a null or empty text has none and stays."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with size, source_size, target, taken and by_shard; a null source is a source of its own."""
    return mixing.mix(docs, text=True)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dup", near_dup),
    ("decontaminate", clean_of_benchmark),
    ("mix", mix),
]
#: SQL can't express the suffix arrays, alignments and MinHash of the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over sf_dir's documents.

    What lies between is in a new folder of the shared checkpoint folder; a stage's rows are deleted once the next one's are
    written. The last are read while the result is computed, and stay as long as the checkpoint folder.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            delete_folder(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
