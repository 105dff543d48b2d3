"""The corpus pipeline: language, boilerplate lines, near-duplicates, benchmark items, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents. Nulls,
empty texts, repeated rows and extra columns are each stage's operator's: rows without a known
language go at the first stage, so a null or empty text never reaches the others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablero.llm import decontamination, language_id, line_dedup, near_dedup, packing
from tablero.llm.shared import Scratch, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text resembles a learned language."""
    return language_id.keep(docs)


def boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their source's boilerplate lines; ``n_chars`` follows the text."""
    cleaned = line_dedup.clean(docs)
    changed = F.when(F.col("_dropped") > 0, F.length("text").cast("long"))
    return cleaned.withColumn("n_chars", F.coalesce(changed, F.col("n_chars"))).select(
        *docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.keep(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.keep(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, packed into sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("line_dedup", boilerplate),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark),
    ("packing", pack),
]

# Near-duplicate classes, rank-order profiles and packing are no SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next begins."""
    scratch = Scratch(spark, "corpus-pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
