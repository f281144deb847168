"""A stored inverted index for ranked search: one row per term and text, in folders by the term's beginning, sorted by term.

A query reads the row groups of its terms only (the folder, equality and prefix all reach the scan), never the texts.
Each posting carries its text's length and kind, so that scores need no join; the number of texts and their mean length
are one row, read once. `spread` deals each folder's postings over several files, for indexes with very common terms.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.functions.text import plain_terms, terms
from tallyloom.operators.search import B, BOOST, BOOSTED, IDF_FLOOR, K1, Match

POSTINGS = "term string, id string, tf int, length int, kind string, bucket int"
BUCKETS, HEAD = 64, 3


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(F.left(term, F.lit(HEAD))), F.lit(BUCKETS)).cast("int")


class SearchIndex:
    """The index below one folder. `rows` (id, text) are looked at for phrases only, and then only those that hold the words."""

    def __init__(self, spark: SparkSession, folder: str, rows: DataFrame | None = None):
        self.postings = spark.read.schema(POSTINGS).parquet(f"{folder}/postings")
        row = spark.read.schema("n long, mean double").parquet(f"{folder}/totals").first()
        self.n_rows, self.mean, self.rows = row.n, row.mean, rows

    @staticmethod
    def build(rows: DataFrame, folder: str, spread: int = 1) -> SearchIndex:
        """Indexes `rows` (id, unique; text; kind, where they have one). Null texts count as rows without a term."""
        kind = F.col("kind").cast("string") if "kind" in rows.columns else F.lit(None).cast("string")
        taken = rows.select(F.col("id").cast("string").alias("id"), kind.alias("kind"), terms(F.col("text")).alias("t"))
        # A text's occurrences of a term are counted before the shuffle, in the aggregate's partial half.
        each = taken.select("id", "kind", F.size("t").alias("length"), F.explode("t").alias("term"))
        counted = each.groupBy("id", "term").agg(F.count("*").cast("int").alias("tf"), F.first("length").alias("length"), F.first("kind").alias("kind"))
        placed = counted.select("term", "id", "tf", "length", "kind", _bucket(F.col("term")).alias("bucket"), F.pmod(F.xxhash64("id"), F.lit(spread)).alias("part"))
        placed.repartition("bucket", "part").sortWithinPartitions("bucket", "term", "id").drop("part").write.partitionBy("bucket").parquet(f"{folder}/postings")
        taken.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("mean")).write.parquet(f"{folder}/totals")
        return SearchIndex(rows.sparkSession, folder, rows)

    def _tallied(self, wanted: list[tuple[str, bool]]) -> DataFrame:
        """id, length, kind and f0, f1, ...: how often each (term, is it a prefix) stands in the text; null: never. Texts with none are left out."""
        one = [(F.col("term").startswith(t) if prefix else F.col("term") == t) for t, prefix in wanted]
        folders = [None if prefix and len(t) < HEAD else F.col("bucket") == _bucket(F.lit(t)) for t, prefix in wanted]
        hits = self.postings.where(reduce(Column.__or__, one))
        if all(f is not None for f in folders):
            hits = hits.where(reduce(Column.__or__, folders))
        sums = [F.sum(F.when(c, F.col("tf"))).alias(f"f{i}") for i, c in enumerate(one)]
        return hits.groupBy("id").agg(F.first("length").alias("length"), F.first("kind").alias("kind"), *sums)

    def _conditions(self, match: Match) -> tuple[list[tuple[str, bool]], Column | None]:
        wanted = match.terms()
        banned = [(t, False) for w in match.without for t in plain_terms(w)]
        has = [F.col(f"f{i}").isNotNull() for i in range(len(wanted))]
        keep = reduce(Column.__or__ if match.any else Column.__and__, has) if has else None
        for j in range(len(banned)):
            keep = keep & F.col(f"f{len(wanted) + j}").isNull() if keep is not None else None
        return wanted + banned, keep

    def matching(self, match: Match) -> DataFrame:
        """id, length, kind, f0, ... of the texts that match."""
        wanted, keep = self._conditions(match)
        if keep is None:  # phrases alone, or nothing: no term narrows the texts
            found = self._with_phrases(self.rows.select(F.col("id").cast("string").alias("id"), "text"), match) if match.phrases else self.rows.where("false")
            return found.select("id")
        found = self._tallied(wanted).where(keep)
        return self._with_phrases(found.join(self.rows.select(F.col("id").cast("string").alias("id"), "text"), "id"), match).drop("text") if match.phrases else found

    @staticmethod
    def _with_phrases(rows: DataFrame, match: Match) -> DataFrame:
        return rows.where(reduce(Column.__and__, [F.lower("text").contains(p.lower()) for p in match.phrases]))

    def bm25(self, match: Match, boosted: bool = False) -> DataFrame:
        """id and score of the texts that match: the number of texts, their mean length and how many hold each term enter as literals."""
        wanted, keep = self._conditions(match)
        if keep is None:
            return self.matching(match).select("id", F.lit(0.0).alias("score"))
        own = match.terms()
        df = self._tallied(wanted).agg(*[F.count(f"f{i}") for i in range(len(own))]).first()
        score = F.lit(0.0)
        for i, n in enumerate(df):
            f = F.coalesce(F.col(f"f{i}"), F.lit(0))
            idf = max(math.log((self.n_rows - n + 0.5) / (n + 0.5)), IDF_FLOOR)
            score = score + F.lit(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.lit(self.mean or 1.0)))
        if boosted:
            score = score * F.when(F.col("kind").isin(*BOOSTED), BOOST).otherwise(1.0)
        return self.matching(match).select("id", score.alias("score"))

    def term_counts(self, words: list[str]) -> dict[str, int]:
        """How many texts hold each word: one pass over the words' postings."""
        of = {w: Match((w,)).terms() for w in words}
        wanted = list(dict.fromkeys(t for ts in of.values() for t in ts))
        if not wanted:
            return dict.fromkeys(words, 0)
        at: Callable[[tuple], Column] = lambda t: F.col(f"f{wanted.index(t)}").isNotNull()
        holds = [F.sum(reduce(Column.__and__, [at(t) for t in ts]).cast("int")) if ts else F.lit(0) for ts in of.values()]
        got = self._tallied(wanted).agg(*[h.alias(f"n{i}") for i, h in enumerate(holds)]).first()
        return {w: got[i] or 0 for i, w in enumerate(words)}
