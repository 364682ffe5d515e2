"""Views of the test tables in the shapes the operators expect, for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import scan_table


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents, spread over the cores for work on whole texts."""
    return scan_table(spark, f"{sf}/documents.parquet", "doc_id")


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    """Scored records with a prediction in -1..4, split 4:1 by key."""
    base = F.floor(F.col("value") / 20)
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("item"),
        F.col("event_id").alias("idx"),
        F.col("event_type").alias("mode"),
        F.least(base, F.lit(4)).cast("int").alias("score"),
        F.least(F.greatest(base, F.lit(0)) + k % 3 - 1, F.lit(4)).cast("int").alias("pred"),
        F.when(
            F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 8), 16, 10)
            .cast("bigint") % 5 == 0, "valid",
        ).otherwise("train").alias("split"),
    )


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with a score where one is known."""
    return (
        documents(spark, sf)
        .join(table(spark, sf, "labels"), "doc_id", "left")
        .select(
            F.col("source").alias("item"), F.col("doc_id").alias("idx"),
            F.col("lang").alias("mode"), "text", F.col("quality").alias("score"),
        )
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        (F.col("vec_id") % 5).alias("item"), F.col("vec_id").alias("idx"),
        F.col("label").alias("score"), "embedding",
    )


def layers(spark: SparkSession, sf: str) -> DataFrame:
    """Four slices of 16 values, used as layers or as the tokens of a sequence."""
    slices = [F.slice("embedding", 1 + 16 * i, 16) for i in range(4)]
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("idx"), *[s.alias(f"h{i + 1}") for i, s in enumerate(slices)]
    )


def chats(spark: SparkSession, sf: str) -> DataFrame:
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.transform(
            turns, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))
        ).alias("messages")
    )


def checkpoint_preds(spark: SparkSession, sf: str) -> DataFrame:
    return ratings(spark, sf).withColumn("checkpoint", (50 * (1 + F.col("idx") % 12)).cast("int"))


def vector_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector beside its next four neighbours by id."""
    v = vectors(spark, sf)
    left = v.select("idx", "score", F.col("embedding").alias("emb1"), F.explode(
        F.sequence(F.lit(1), F.lit(4))).alias("step"))
    right = v.select(F.col("idx").alias("idx2"), F.col("score").alias("score2"),
                     F.col("embedding").alias("emb2"))
    return (
        left.withColumn("idx2", F.col("idx") + F.col("step"))
        .join(right, "idx2")
        .select(
            F.col("idx").alias("idx1"), "idx2", "emb1", "emb2",
            F.abs(F.col("score") - F.col("score2")).alias("diff"),
        )
    )


def pair_eval(spark: SparkSession, sf: str) -> DataFrame:
    """One row per evaluated pair: label difference, distance and similarity logit."""
    from ..functions.vectors import cosine

    cos = F.round(cosine("emb1", "emb2"), 6)
    return vector_pairs(spark, sf).select(
        "idx1", "idx2", F.col("diff"), cos.alias("logit"), (1 - cos).alias("dist")
    )


def u32(expression: str) -> str:
    """SQL for the first 32 bits of the md5 of a text expression."""
    return f"('0x' || substr(md5({expression}), 1, 8))::BIGINT"


RATINGS = f"""ratings AS (
  SELECT user_id AS item, event_id AS idx, event_type AS mode,
         CAST(least(floor(value/20), 4) AS INT) AS score,
         CAST(least(greatest(floor(value/20), 0)
              + (CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 3) - 1, 4) AS INT) AS pred,
         CASE WHEN {u32("CAST(event_id AS VARCHAR)")} % 5 = 0 THEN 'valid' ELSE 'train' END AS split
  FROM events)"""

RESPONSES = """responses AS (
  SELECT source AS item, d.doc_id AS idx, lang AS mode, text, quality AS score
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

VECTORS = """vectors AS (
  SELECT vec_id % 5 AS item, vec_id AS idx, label AS score, embedding FROM embeddings)"""

LAYERS = """layers AS (
  SELECT vec_id AS idx, embedding[1:16]::DOUBLE[] AS h1, embedding[17:32]::DOUBLE[] AS h2,
         embedding[33:48]::DOUBLE[] AS h3, embedding[49:64]::DOUBLE[] AS h4 FROM embeddings)"""

CHATS = """chats AS (
  SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS messages
  FROM conversations GROUP BY conv_id)"""

CHECKPOINT_PREDS = RATINGS + """, checkpoint_preds AS (
  SELECT *, CAST(50 * (1 + idx % 12) AS INT) AS checkpoint FROM ratings)"""

VECTOR_PAIRS = """vector_pairs AS (
  SELECT a.vec_id AS idx1, b.vec_id AS idx2, a.embedding::DOUBLE[] AS emb1,
         b.embedding::DOUBLE[] AS emb2, abs(a.label - b.label) AS diff
  FROM (SELECT *, unnest(range(1, 5)) AS step FROM embeddings) a
  JOIN embeddings b ON b.vec_id = a.vec_id + a.step)"""

PAIR_EVAL = VECTOR_PAIRS + """, pair_eval AS (
  SELECT idx1, idx2, diff, logit, 1 - logit AS dist FROM (
    SELECT *, round(list_dot_product(emb1, emb2)
      / (sqrt(list_dot_product(emb1, emb1)) * sqrt(list_dot_product(emb2, emb2))), 6) AS logit
    FROM vector_pairs))"""
