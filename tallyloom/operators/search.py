"""Ranked lexical search: BM25 over index terms, phrases, prefixes and query relaxation."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.functions.text import STOPWORDS, n_terms, plain_terms, terms

K1, B, IDF_FLOOR, BOOST = 1.2, 0.75, 1e-6, 1.5
BOOSTED = ("user", "assistant", "agent_message")
PROBE_CAP = 4096
SNIPPET = 160


def split_query(query: str) -> tuple[list[str], list[str]]:
    """Words and "quoted phrases"; an unclosed quote runs to the end."""
    words: list[str] = []
    phrases: list[str] = []
    for i, part in enumerate(query.split('"')):
        if i % 2:
            phrases.append(" ".join(part.split()))
        else:
            words += part.split()
    return words, [p for p in phrases if p]


@dataclass(frozen=True)
class Match:
    """A lexical strategy. Phrases hold in any case; words all of them, or any."""

    words: tuple[str, ...] = ()
    phrases: tuple[str, ...] = ()
    without: tuple[str, ...] = ()
    any: bool = False
    note: str = ""

    def terms(self) -> list[tuple[str, bool]]:
        """(term, is it a prefix) of the words, each once."""
        out: list[tuple[str, bool]] = []
        for w in self.words:
            star = w.endswith("*")
            own = plain_terms(w.rstrip("*"))
            out += [(t, star and i == len(own) - 1) for i, t in enumerate(own)]
        return list(dict.fromkeys(out))

    def condition(self, own: Column, text: Column) -> Column:
        """`own` are the row's terms."""
        wanted = [F.exists(own, _starts(t)) if prefix else F.array_contains(own, t) for t, prefix in self.terms()]
        out = reduce((lambda a, b: a | b) if self.any else (lambda a, b: a & b), wanted) if wanted else F.lit(bool(self.phrases))
        for p in self.phrases:
            out = out & F.lower(text).contains(p.lower())
        for w in self.without:
            for t in plain_terms(w):
                out = out & ~F.array_contains(own, t)
        return out


def _starts(prefix: str) -> Callable[[Column], Column]:
    return lambda x: x.startswith(prefix)


def parse(query: str, any_: bool = False) -> Match:
    """Operators: OR between all words, -word, "phrase", word*."""
    words, phrases = split_query(query)
    either = any(w.lower() == "or" for w in words)
    plain = [w for w in words if w.lower() != "or"]
    return Match(tuple(w for w in plain if not w.startswith("-")), tuple(phrases), tuple(w[1:] for w in plain if w.startswith("-") and len(w) > 1), any_ or either)


def with_terms(rows: DataFrame) -> DataFrame:
    return rows.withColumn("__terms", terms(F.col("text")))


def matching(rows, match: Match) -> DataFrame:
    """The rows that match: of a table (id, text), read whole, or of a SearchIndex."""
    if not isinstance(rows, DataFrame):
        return rows.matching(match)
    cheap = [F.lower("text").contains(p.lower()) for p in match.phrases]
    holds = [F.lower("text").contains(t) for t, _ in match.terms()]
    cheap += [reduce(lambda a, b: a | b, holds)] if match.any and holds else holds
    narrowed = rows.where(reduce(lambda a, b: a & b, cheap)) if cheap else rows
    return with_terms(narrowed).where(match.condition(F.col("__terms"), F.col("text")))


def bm25(rows: DataFrame, match: Match, kind: str | None = None) -> DataFrame:
    """id and score (higher is better) of the matching rows.

    N, document frequencies and the average length are over all rows: one aggregate, whose single row is fetched and
    enters the scores as literals. The matches are then scored where they lie, without a shuffle.
    """
    wanted = match.terms()
    text = F.col("text")
    n_rows, mean, *df = rows.agg(F.count("*"), F.avg(n_terms(text)), *[F.sum(_holds(text, t, p).cast("int")) for t, p in wanted]).first()
    found = matching(rows, match)
    length, score = F.size("__terms"), F.lit(0.0)
    for (t, prefix), n in zip(wanted, df, strict=True):
        f = F.size(F.filter("__terms", _starts(t) if prefix else _equals(t)))
        idf = max(math.log((n_rows - (n or 0) + 0.5) / ((n or 0) + 0.5)), IDF_FLOOR)
        score = score + F.lit(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * length / F.lit(mean or 1.0)))
    if kind:
        score = score * F.when(F.col(kind).isin(*BOOSTED), BOOST).otherwise(1.0)
    return found.withColumn("score", score).drop("__terms")


def _equals(term: str) -> Callable[[Column], Column]:
    return lambda x: x == term


def _holds(text: Column, term: str, prefix: bool) -> Column:
    """Whether a text has the term; only texts that contain it anywhere are taken apart."""
    own = terms(text)
    return F.when(F.lower(text).contains(term), F.exists(own, _starts(term)) if prefix else F.array_contains(own, term)).otherwise(F.lit(False))


def probe(rows, match: Match, cap: int = PROBE_CAP) -> int:
    return matching(rows, match).limit(cap).count()


def term_counts(rows, words: list[str]) -> dict[str, int]:
    """How many rows hold each word: one pass for all of them."""
    if not isinstance(rows, DataFrame):
        return rows.term_counts(words)
    text = F.col("text")
    holds = [[_holds(text, t, p) for t, p in Match((w,)).terms()] for w in words]
    got = rows.agg(*[F.sum(reduce(lambda a, b: a & b, h).cast("int") if h else F.lit(0)).alias(f"n{i}") for i, h in enumerate(holds)]).first()
    return {w: got[i] or 0 for i, w in enumerate(words)}


def relaxed(rows, query: str, cap: float = math.inf) -> Match:
    """The strictest of these that has a hit: all words; without stopwords; then, beside the rarest word, without the
    words that occur nowhere, then without the most common ones. Phrases and the rarest word always stay.
    Words are counted in full, so there is a rarest one at any size; with a `cap`, those that reach it count the same and none of them is the rarest."""
    strict = parse(query)
    if strict.any or strict.without or probe(rows, strict, 1):
        return strict
    kept: list[str] = []
    for w in strict.words:
        w = re.sub(r"^[^\w*]+|[^\w*]+$", "", w.lower())
        if w and w not in STOPWORDS and w not in kept:
            kept.append(w)
    if not kept:
        return strict
    candidate = Match(tuple(kept), strict.phrases)
    if probe(rows, candidate, 1):
        return _noted(candidate, "")
    counts = {w: min(n, cap) for w, n in term_counts(rows, kept).items()}
    known = [w for w in kept if 0 < counts[w] < cap]
    if not known:
        return strict
    anchor = min(known, key=lambda w: counts[w])
    drop = sorted((w for w in kept if w != anchor), key=lambda w: (counts[w] > 0, -counts[w]))
    for i in range(1, len(drop) + 1):
        left = [*drop[i:], anchor]
        candidate = Match(tuple(left), strict.phrases)
        if probe(rows, candidate, 1):
            return _noted(candidate, anchor)
    return strict


def _noted(match: Match, anchor: str) -> Match:
    needs = " ".join([*match.words, *[f'"{p}"' for p in match.phrases]])
    more = f" (rarest: {anchor})" if anchor else ""
    return replace(match, note=f"nothing holds every term; required instead: {needs}{more}")


def snippet(text: Column, first_term: str, width: int = SNIPPET) -> Column:
    """snippet (about `width` characters around the first occurrence) and its line number."""
    at = F.instr(F.lower(text), first_term.lower())
    start = F.greatest(at - width // 4, F.lit(1))
    body = F.substring(text, start, F.lit(width))
    line = F.length(F.substring(text, F.lit(1), F.greatest(at - 1, F.lit(0)))) - F.length(F.replace(F.substring(text, F.lit(1), F.greatest(at - 1, F.lit(0))), F.lit("\n"), F.lit(""))) + 1
    shown = F.concat(F.when(start > 1, F.lit("…")).otherwise(F.lit("")), F.regexp_replace(body, r"[ \t\n\r]+", " "), F.when(start + width <= F.length(text), F.lit("…")).otherwise(F.lit("")))
    return F.struct(shown.alias("snippet"), line.alias("line"))
