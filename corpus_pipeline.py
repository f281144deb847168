"""A corpus from raw documents to token shards: the stages of ``STAGES``, each over all that its predecessor kept.

Each stage's result is written as Parquet and read again, so a lost executor costs a task, not a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import decontaminate, mixing, near_dedup, quality, token_store
from tallyloom.llm._store import Workspace, tidied
from tallyloom.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the classifier reject go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return near_dedup.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of its schedule."""
    return mixing.apply_mix(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the shards, which keep the order of the mix: that of the rows in its files."""
    folder = Workspace(spark, "pipeline").path
    rows, order = token_store.in_file_order(docs)
    token_store.write(rows, folder, tokenizer_path(), order=order)
    return token_store.index(spark, folder)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing sources to target weights", source_weights),
    ("token-ID / binary output", token_shards),
]

#: SQL can't express the classifier, the signatures and the tokenizer; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "corpus")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        if number + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        with tidied(spark):  # what the stage's steps have written goes when its result is
            done = space.table(stage(spark, docs, sf_dir), f"stage{number + 1}")
        if number:
            space.drop(docs)
        docs = done
