"""From raw documents to packed sequences: language, repeated lines, near duplicates, benchmark
passages, packing. Every stage but the last returns the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm import decontaminate, language_id, line_winnow, ngram_join, packing
from scoreloom.llm.common import fresh, table
from scoreloom.llm.queries import language_model
from scoreloom.session import scratch_path


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those whose language is ambiguous, go.

    The classifier learns from the documents of the corpus itself.
    """
    model = language_model(table(spark, sf_dir, "documents"))
    (text,) = fresh(docs, "_text")
    judged = language_id.identify(docs.withColumn(text, F.col("text")), model, text)
    return judged.where(~F.col("ambiguous")).select(*docs.columns)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines are deleted; a document that loses all its text goes.

    One whose text is null or blank from the start has lost nothing and stays.
    """
    (gone,) = fresh(docs, "_gone")
    out = line_winnow.dedup_lines(docs, removed=gone)
    return out.where((F.size(gone) == 0) | F.col("text").rlike(r"\S")).drop(gone)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the first by id."""
    return ngram_join.drop_near_duplicates(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of what is left, placed in sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_known_language),
    ("line_dedup", remove_repeated_lines),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_benchmark),
    ("packing", pack_sequences),
]

ORACLE_SQL = None    # a classifier, MinHash and packing are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
