"""Exact and regular-expression search over message texts.

A message matches if any line does (the whole text in multiline mode). Order of work: literal prefilter, match,
collapse of equal texts, cap per session, page. Ranking works on ids, hashes and small columns; texts are joined
for the page's rows only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyloom.functions.regex import required_literals, smart_case, to_java
from tallyloom.functions.text import clip_bytes

RELEVANCE_CAP = 1000
LINE_CAP, LINE_BYTES = 10, 300


@dataclass(frozen=True)
class Pattern:
    """What to look for: several patterns are alternatives. `ignore_case` None means smart case."""

    patterns: tuple[str, ...]
    fixed: bool = False
    ignore_case: bool | None = None
    words: bool = False
    multiline: bool = False

    @property
    def folds(self) -> bool:
        return smart_case(list(self.patterns)) if self.ignore_case is None else self.ignore_case

    def source(self) -> str:
        """The alternatives as one RE2 pattern."""
        import re

        parts = [re.sub(r"([\\.+*?()|\[\]{}^$])", r"\\\1", p) if self.fixed else p for p in self.patterns]
        joined = "|".join(f"(?:{p})" for p in parts) if len(parts) > 1 else parts[0]
        return rf"\b(?:{joined})\b" if self.words else joined

    def java(self) -> str:
        return to_java(self.source(), self.folds, self.multiline)

    def prefilter(self, text: Column) -> Column | None:
        """A cheap necessary condition: one of the literals is in the text."""
        if self.fixed and not self.words and len(self.patterns) == 1 and not self.folds:
            return text.contains(self.patterns[0])
        found = required_literals(self.source(), self.folds)
        if not found:
            return None
        where = F.lower(text) if self.folds else text
        return reduce(lambda a, b: a | b, [where.contains(x) for x in dict.fromkeys(found)])

    def matches(self, text: Column) -> Column:
        if self.fixed and not self.words and not self.folds:
            return reduce(lambda a, b: a | b, [text.contains(p) for p in self.patterns])
        exact = text.rlike(self.java())
        cheap = self.prefilter(text)
        return exact if cheap is None else cheap & exact

    def count(self, text: Column) -> Column:
        return F.regexp_count(text, F.lit(self.java()))


def found(messages: DataFrame, pattern: Pattern) -> DataFrame:
    return messages.where(F.col("text").isNotNull() & pattern.matches(F.col("text")))


def newest() -> list[Column]:
    return [F.col("ts").desc_nulls_last(), F.col("id").asc()]


def oldest() -> list[Column]:
    return [F.col("ts").asc_nulls_last(), F.col("id").asc()]


def collapsed(rows: DataFrame, order: list[Column], key: str = "content_sha") -> DataFrame:
    """One row for each text: the first in the order, with copies (how many more there are)."""
    first = F.row_number().over(W.partitionBy(key).orderBy(*order))
    copies = F.count("*").over(W.partitionBy(key)) - 1
    return rows.withColumn("__first", first).withColumn("copies", copies).where("__first = 1").drop("__first")


def capped_per_session(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    nth = F.row_number().over(W.partitionBy("session_id").orderBy(*order))
    return rows.withColumn("__nth", nth).where(F.col("__nth") <= most).drop("__nth")


def page(messages: DataFrame, pattern: Pattern, order: str = "newest", limit: int = 20, offset: int = 0, max_per_session: int | None = None, rank_newest: int | None = None) -> DataFrame:
    """The page of collapsed hits. `messages` need id, session_id, ts, text and content_sha. `rank_newest`: rank only so many of the newest hits."""
    hits = found(messages, pattern)
    if rank_newest:
        hits = hits.orderBy(*newest()).limit(rank_newest)
    if order == "relevance":
        hits = hits.withColumn("matches", F.least(pattern.count(F.col("text")), F.lit(RELEVANCE_CAP)))
    keys = {"newest": newest(), "oldest": oldest(), "relevance": [F.col("matches").desc(), *newest()]}[order]
    hits = collapsed(hits, keys)
    if max_per_session:
        hits = capped_per_session(hits, keys, max_per_session)
    return hits.orderBy(*keys).offset(offset).limit(limit)


def counted_page(messages: DataFrame, pattern: Pattern, limit: int = 20, offset: int = 0, **options) -> tuple[DataFrame, dict]:
    """The page, and what tells how to go on: total (distinct texts that match), exact, next_offset (None at the end)."""
    total = totals(messages, pattern).first().texts
    following = offset + limit
    return page(messages, pattern, limit=limit, offset=offset, **options), {"total": total, "exact": True, "next_offset": following if following < total else None}


def bounded(rows: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """At most so many rows, for a caller with a budget; and whether there are more (the result is then partial)."""
    return rows.limit(most), rows.limit(most + 1).count() > most


def sessions_with(messages: DataFrame, pattern: Pattern) -> DataFrame:
    """session_id, messages (distinct texts that match) and matches of each session: the -l and -c modes."""
    hits = found(messages, pattern).select("session_id", "content_sha", pattern.count(F.col("text")).alias("n"))
    return hits.dropDuplicates(["session_id", "content_sha"]).groupBy("session_id").agg(F.count("*").alias("messages"), F.sum("n").cast("long").alias("matches"))


def totals(messages: DataFrame, pattern: Pattern) -> DataFrame:
    hits = found(messages, pattern)
    return hits.agg(F.count("*").alias("messages"), F.count_distinct("content_sha").alias("texts"), F.count_distinct("session_id").alias("sessions"))


def lines(hits: DataFrame, pattern: Pattern, before: int = 0, after: int = 0) -> DataFrame:
    """id, line (from 1), text and is_match of the matching lines, with lines of context."""
    split = hits.select("id", F.split("text", "\n").alias("all")).select("id", "all", F.posexplode("all").alias("at", "line_text"))
    marked = split.select("id", (F.col("at") + 1).alias("line"), "line_text", pattern.matches(F.col("line_text")).alias("is_match"))
    if not before and not after:
        return marked.where("is_match")
    near = W.partitionBy("id").orderBy("line").rowsBetween(-after, before)
    return marked.withColumn("__near", F.max("is_match").over(near)).where("__near").drop("__near")


def shown_lines(hits: DataFrame, pattern: Pattern, most: int = LINE_CAP, size: int = LINE_BYTES) -> DataFrame:
    """id, line, line_text (at most `size` bytes) of the first `most` matching lines of each text, and more: how many others match."""
    matching = lines(hits, pattern)
    nth, n = F.row_number().over(W.partitionBy("id").orderBy("line")), F.count("*").over(W.partitionBy("id"))
    shown = matching.withColumn("__nth", nth).withColumn("more", F.greatest(n - most, F.lit(0))).where(F.col("__nth") <= most)
    return shown.select("id", "line", clip_bytes(F.col("line_text"), size).alias("line_text"), "more")


def only_matching(hits: DataFrame, pattern: Pattern) -> DataFrame:
    """id, line, nth and match of every match."""
    rows = lines(hits, pattern).select("id", "line", F.posexplode(F.regexp_extract_all("line_text", F.lit(pattern.java()), F.lit(0))).alias("nth", "match"))
    return rows.withColumn("nth", F.col("nth") + 1)


def trigrams(text: Column) -> Column:
    """Distinct code-point trigrams, in lower case. The characters are split once and bound to a lambda's argument."""

    def slide(chars):
        return F.transform(F.slice(chars, F.lit(1), F.greatest(F.size(chars) - 2, F.lit(0))), lambda c, i: F.concat(c, F.get(chars, i + 1), F.get(chars, i + 2)))

    chars = F.filter(F.split(F.lower(text), ""), lambda c: c != "")
    return F.array_distinct(F.element_at(F.transform(F.array(chars), slide), 1))


def continued(messages: DataFrame, pattern: Pattern, after: tuple | None, limit: int) -> DataFrame:
    """The next page of a pinned snapshot: keyset on (ts, id), newest first."""
    hits = collapsed(found(messages, pattern), newest())
    if after:
        at, id_ = after
        ts = F.lit(at).cast("timestamp")
        hits = hits.where((F.col("ts") < ts) | ((F.col("ts") == ts) & (F.col("id") > id_)) | F.col("ts").isNull()) if at else hits.where(F.col("ts").isNull() & (F.col("id") > id_))
    return hits.orderBy(*newest()).limit(limit)
