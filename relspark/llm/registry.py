"""The subpackage's queries, each over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from relspark.llm import decontaminate, htmlextract, jaccard, language, licenses, linededup, mixing, oracles, repetition, secrets, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlextract.extract(_read(spark, sf_dir, "pages"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages")).drop("file")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_read(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op7_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.score(_read(spark, sf_dir, "documents")).drop("longest_repeat", "n_maximal_repeats")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_deleted", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_warc": op2_warc,
    "op3_decontaminate": op3_decontaminate,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_language": op5_language,
    "op6_mixing": op6_mixing,
    "op7_repetition": op7_repetition,
    "op8_licenses": op8_licenses,
    "op9_secrets": op9_secrets,
    "op10_line_dedup": op10_line_dedup,
}

ORACLES: dict[str, str] = {
    "op2_warc": oracles.WARC,
    "op3_decontaminate": oracles.DECONTAMINATE,
    "op4_ngram_jaccard": oracles.JACCARD,
    "op6_mixing": mixing.oracle_sql(),
    "op7_repetition": oracles.REPETITION,
    "op8_licenses": licenses.oracle_sql(),
    "op9_secrets": oracles.SECRETS,
}
