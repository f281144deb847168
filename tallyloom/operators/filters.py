"""Predicates over messages and sessions; all compose by AND."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.functions.text import glob_like, repo_match, under

DEFAULT_LIMIT, MAX_LIMIT = 20, 500
LIVE_SECONDS, HELD_SECONDS = 600, 3600


def live() -> Column:
    return ~F.col("superseded")


def on_path() -> Column:
    return F.coalesce(F.col("on_active_path"), F.lit(True))


def ilike_any(columns: list[Column], pattern: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(c.ilike(pattern), F.lit(False))
    return out


@dataclass(frozen=True)
class Filters:
    """What a query keeps. Times are strings that Spark reads as timestamps; `now` is given, never taken."""

    kinds: tuple[str, ...] = ()
    not_kinds: tuple[str, ...] = ()
    tools: tuple[str, ...] = ()
    since: str | None = None
    until: str | None = None
    agents: tuple[str, ...] = ()
    device: str | None = None
    user: str | None = None
    repo: str | None = None
    branch: str | None = None
    sessions: str | None = None
    exclude_subagents: bool = False
    exclude_live: bool = False
    now: str | None = None
    own_session: str | None = None
    own_user: str | None = None
    include_superseded: bool = False
    include_off_path: bool = False
    limit: int = DEFAULT_LIMIT

    def clamp(self) -> int:
        return DEFAULT_LIMIT if self.limit <= 0 else min(self.limit, MAX_LIMIT)

    def to_dict(self) -> dict:
        return {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items() if v not in (None, (), False) and not (k == "limit" and v == DEFAULT_LIMIT)}

    @classmethod
    def from_dict(cls, values: dict) -> Filters:
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known})

    def message_predicate(self) -> Column:
        out = F.lit(True)
        if not self.include_superseded:
            out = out & live()
        if not self.include_off_path:
            out = out & on_path()
        if self.kinds:
            out = out & F.col("kind").isin(*self.kinds)
        else:
            out = out & (F.col("kind") != "injected")
        if self.not_kinds:
            out = out & ~F.col("kind").isin(*self.not_kinds)
        if self.tools:
            out = out & F.lower("tool_name").isin(*[t.lower() for t in self.tools])
        if self.since:
            out = out & (F.col("ts") >= F.lit(self.since).cast("timestamp"))
        if self.until:
            out = out & (F.col("ts") < F.lit(self.until).cast("timestamp"))
        return out

    def session_predicate(self) -> Column:
        out = F.col("hidden_at").isNull()
        if self.agents:
            out = out & F.col("agent").isin(*self.agents)
        if self.exclude_subagents:
            out = out & (F.col("depth") == 0) & F.col("parent_session_id").isNull()
        if self.branch:
            pattern = glob_like(self.branch) if "*" in self.branch or "?" in self.branch else glob_like(self.branch).strip("%")
            out = out & F.exists("branches", lambda b: b.ilike(pattern))
        if self.repo:
            prefix, like = repo_match(self.repo)
            if prefix:
                out = out & (F.coalesce(under(F.col("repo_root"), prefix), F.lit(False)) | F.coalesce(under(F.col("cwd"), prefix), F.lit(False)))
            else:
                out = out & ilike_any([F.concat(F.lit("/"), F.col("repo_root")), F.concat(F.lit("/"), F.col("cwd"))], like)
        if self.sessions:
            base = F.element_at(F.split(F.coalesce("repo_root", "cwd"), "/"), -1)
            out = out & ilike_any([F.col("session_id"), F.col("title"), F.coalesce("repo_root", "cwd"), base], glob_like(self.sessions))
        if self.own_session:
            out = out & (F.col("session_id") == self.own_session)
        if self.own_user:
            out = out & (F.col("user_id") == self.own_user)
        if self.exclude_live:
            now = F.lit(self.now).cast("timestamp")
            out = out & ~F.coalesce(F.col("last_activity_at") > now - F.make_dt_interval(secs=F.lit(LIVE_SECONDS)), F.lit(False))
        return out


def without_live(sessions: DataFrame, now: str, held: list[str]) -> DataFrame:
    """Sessions that are not live: active within LIVE_SECONDS; or held open (their native id is in `held`) and active within HELD_SECONDS; or
    below such a session of their device."""
    at = F.lit(now).cast("timestamp")
    since = lambda s: F.coalesce(F.col("last_activity_at") > at - F.make_dt_interval(secs=F.lit(s)), F.lit(False))
    open_ = F.col("session_id").isin(held) & since(HELD_SECONDS) if held else F.lit(False)
    parents = sessions.where(open_).select(F.col("session_id").alias("parent_session_id"), "device_id").distinct()
    return sessions.where(~since(LIVE_SECONDS) & ~open_).join(parents, ["parent_session_id", "device_id"], "left_anti").select(*sessions.columns)


def scoped(messages: DataFrame, sessions: DataFrame, filters: Filters) -> DataFrame:
    """Messages of the sessions that pass. The session side is narrowed first and joined by id; Spark broadcasts it where it is small."""
    kept = sessions.where(filters.session_predicate())
    return messages.where(filters.message_predicate()).join(kept.select(F.col("id").alias("conversation_id")), "conversation_id", "left_semi")


def by_device_or_user(sessions: DataFrame, devices: DataFrame, users: DataFrame, device: str | None = None, user: str | None = None) -> DataFrame:
    """Sessions of a device (by id or name) and of a user (by id, or email in any case)."""
    if device:
        named = devices.where((F.col("id") == device) | (F.col("name") == device)).select(F.col("id").alias("device_id"))
        sessions = sessions.join(named, "device_id", "left_semi")
    if user:
        named = users.where((F.col("id") == user) | (F.lower("email") == user.lower())).select(F.col("id").alias("user_id"))
        sessions = sessions.join(named, "user_id", "left_semi")
    return sessions


def without_tombstones(sessions: DataFrame, tombstones: DataFrame) -> DataFrame:
    return sessions.join(tombstones.select("user_id", "session_id"), ["user_id", "session_id"], "left_anti")
