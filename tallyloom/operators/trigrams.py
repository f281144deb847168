"""A stored trigram index: which texts can hold a literal, without reading any text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.functions.regex import required_literals
from tallyloom.operators.grep import Pattern, found, trigrams

BUCKETS = 64


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def grams_of(literal: str) -> list[str]:
    low = literal.lower()
    return sorted({low[i : i + 3] for i in range(len(low) - 2)})


class TrigramIndex:
    """Postings (gram, id) in folders by the gram's hash, sorted. `rows` are the texts to verify candidates on."""

    def __init__(self, spark: SparkSession, folder: str, rows: DataFrame):
        self.postings, self.rows = spark.read.schema("gram string, id string, bucket int").parquet(folder), rows

    @staticmethod
    def build(rows: DataFrame, folder: str) -> TrigramIndex:
        spread = rows.select(F.col("id").cast("string").alias("id"), F.explode(trigrams(F.col("text"))).alias("gram")).withColumn("bucket", _bucket(F.col("gram")))
        spread.repartition("bucket").sortWithinPartitions("bucket", "gram", "id").write.partitionBy("bucket").parquet(folder)
        return TrigramIndex(rows.sparkSession, folder, rows)

    def candidates(self, literals: list[str]) -> DataFrame | None:
        """id of the texts that have every trigram of any of the literals; None if one of them is too short to tell."""
        wanted = [grams_of(x) for x in literals]
        if not wanted or not all(wanted):
            return None
        every = sorted({g for w in wanted for g in w})
        hits = self.postings.where(F.col("gram").isin(every) & F.col("bucket").isin(*[_bucket(F.lit(g)) for g in every]))
        have = hits.groupBy("id").agg(F.collect_set("gram").alias("g"))
        return have.where(reduce(Column.__or__, [F.size(F.array_intersect("g", F.array(*[F.lit(g) for g in w]))) == len(w) for w in wanted])).select("id")

    def found(self, pattern: Pattern) -> DataFrame:
        """The rows that match: candidates by the literals that every match holds, then the pattern itself. A pattern without such is matched on all texts."""
        literals = list(pattern.patterns) if pattern.fixed else required_literals(pattern.source(), pattern.folds)
        narrow = self.candidates([x for x in literals or []])
        rows = self.rows if narrow is None else self.rows.join(narrow, self.rows["id"].cast("string") == narrow["id"], "left_semi")
        return found(rows, pattern)
