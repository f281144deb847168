"""The driver's tables in the shape of the model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as messages: id, session_id, ordinal, kind, text, content_sha; no times."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.lpad(F.col("turn").cast("string"), 6, "0")).alias("id"), F.col("conv_id").cast("string").alias("session_id"), F.shiftleft("turn", 12).alias("ordinal"),
        F.col("role").alias("kind"), "text", F.sha2("text", 256).alias("content_sha"), F.lit(None).cast("timestamp").alias("ts"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as messages: the source is the session, the language the kind."""
    rows = table(spark, sf_dir, "documents")
    return rows.select(
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("id"), F.col("source").alias("session_id"), F.col("doc_id").alias("ordinal"), F.col("lang").alias("kind"), "text", F.sha2("text", 256).alias("content_sha"),
        F.lit(None).cast("timestamp").alias("ts"),
    )


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as messages with times: the user is the session, the type the kind."""
    rows = table(spark, sf_dir, "events")
    return rows.select(
        F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("ordinal"), F.col("event_type").alias("kind"), "ts", F.col("value"), F.col("props").alias("enrichment"),
        (F.col("event_type") == "error").alias("is_error"),
    )
