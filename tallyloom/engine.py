"""The read API over one set of tables: grep, search, sessions, read, outline, trace, raw, diagnostics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tallyloom.operators import digest, evidence as ev, grep as g, reports, search as s, sessions as se
from tallyloom.operators.filters import Filters, scoped


@dataclass
class Engine:
    """`messages` and `sessions` in the model's columns; the other tables only where a method needs them."""

    messages: DataFrame
    sessions: DataFrame
    devices: DataFrame | None = None
    users: DataFrame | None = None
    parses: DataFrame | None = None

    def _view(self, filters: Filters) -> DataFrame:
        rows = scoped(self.messages, self.sessions, filters)
        return rows if "content_sha" in rows.columns else rows.withColumn("content_sha", F.sha2("text", 256))

    def grep(self, *patterns: str, filters: Filters = Filters(), order: str = "newest", offset: int = 0, max_per_session: int | None = None, **how) -> DataFrame:
        return g.page(self._view(filters), g.Pattern(patterns, **how), order, filters.clamp(), offset, max_per_session)

    def grep_lines(self, *patterns: str, filters: Filters = Filters(), before: int = 0, after: int = 0, **how) -> DataFrame:
        pattern = g.Pattern(patterns, **how)
        return g.lines(g.page(self._view(filters), pattern, limit=filters.clamp()), pattern, before, after)

    def grep_sessions(self, *patterns: str, filters: Filters = Filters(), **how) -> DataFrame:
        return g.sessions_with(self._view(filters), g.Pattern(patterns, **how))

    def search(self, query: str, matching: str = "auto", filters: Filters = Filters(), order: str = "relevance", offset: int = 0) -> DataFrame:
        """Ranked hits with a snippet; counts for the rank are over all messages, filters apply to the hits."""
        rows = self.messages if "content_sha" in self.messages.columns else self.messages.withColumn("content_sha", F.sha2("text", 256))
        if matching not in ("auto", "all", "any"):
            raise ValueError(f"matching is auto, all or any, not {matching}")
        match = s.relaxed(self._view(filters), query) if matching == "auto" else s.parse(query, any_=matching == "any")
        scored = s.bm25(rows, match, kind="kind")
        hits = scored.join(self._view(filters).select("id"), "id", "left_semi")
        keys = g.newest() if order == "newest" else [F.col("score").desc(), *g.newest()]
        page = g.collapsed(hits, keys).orderBy(*keys).offset(offset).limit(filters.clamp())
        first = (match.terms() or [(match.phrases[0] if match.phrases else "", False)])[0][0]
        return page.select("*", s.snippet(F.col("text"), first).alias("snippet"))

    def list_sessions(self, filters: Filters = Filters(), after: str | None = None) -> DataFrame:
        rows = self.sessions.where(filters.session_predicate())
        cursor = None
        if after:
            micros, id_ = se.parse_cursor(after)
            cursor = (None if micros is None else self.sessions.sparkSession.sql(f"SELECT CAST(timestamp_micros({micros}) AS STRING)").first()[0], id_)
        return se.page_after(rows, cursor, filters.clamp())

    def read(self, id_: str, before: int = 5, after: int = 5) -> DataFrame:
        return se.around(self.messages, id_, before, after)

    def read_address(self, address: str, before: int = 5, after: int = 5) -> DataFrame:
        """SESSION/ORDINAL, the session by id or unique prefix."""
        session, _, ordinal = address.partition("/")
        found = se.resolve(self.sessions, session)
        if len(found) != 1:
            raise ValueError(f"{'ambiguous' if found else 'no'} session {session}: {', '.join(found[:5])}")
        best = se.best_version(self.messages.where(F.col("session_id") == found[0])).where(F.col("ordinal") == int(ordinal or 0) if ordinal else F.lit(True)).orderBy("ordinal", "id").limit(1).collect()
        return self.read(best[0].id if best else "", before, after)

    def outline(self, conversation_id: str, after: tuple[int, str] | None = None) -> DataFrame:
        return se.outline(self.messages, conversation_id, after)

    def digests(self) -> DataFrame:
        return digest.digests(self.messages, self.sessions)

    def trace(self, *commits: str) -> DataFrame:
        """Sessions in which the commits were made, with the evidence."""
        return ev.trace(ev.commit_evidence(self.messages), list(commits)).join(self.sessions.where("hidden_at is null").select(F.col("id").alias("conversation_id"), "session_id"), "conversation_id")

    def diagnostics(self) -> DataFrame:
        return reports.issues(reports.latest(self.parses))
