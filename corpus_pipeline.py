"""The corpus pipeline: language, repeated lines, near copies, benchmark leaks, mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's `docs`. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableferry.llm import benchmark, language, lines, production, simhash
from tableferry.llm.tables import kept


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones are in; missing labels are filled in."""
    return language.keep(docs, language.train(docs), production.LANGUAGE_LEAST_SCORE)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines are deleted, and documents that consist of such lines only."""
    found = lines.drop_repeated_lines(docs, min_lines=production.RUN_LINES, min_chars=production.RUN_CHARS)
    shorter = found.filter("n_removed = 0 OR n_removed < n_lines")
    return shorter.select(
        *[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else shorter[f"`{c}`"] for c in docs.columns]
    )


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies stays: the one with the smallest id."""
    return simhash.drop_near_copies(docs, shingle=production.SHINGLE, max_bits=production.MAX_BITS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return benchmark.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights, once for each epoch they are taken in."""
    return production.mixed(docs)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", repeated_lines),
    ("simhash_near_dedup", near_copies),
    ("benchmark_decontamination", benchmark_leaks),
    ("mixture", mixture),
]

#: A trained language model is no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's result is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
