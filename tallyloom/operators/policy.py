"""Path policy: which mode holds for a session, by where it ran."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

#: Modes from the least to the most restrictive.
MODES = ("allow", "local", "deny")


def glob_regex(pattern: str) -> str:
    """A path glob as a Java regular expression: ** crosses elements, relative patterns match anywhere, what lies below is covered."""
    pattern = pattern.rstrip("/").lower()
    if not pattern.startswith("/"):
        pattern = "**/" + pattern
    out, parts = "", pattern.lstrip("/").split("/")
    for i, part in enumerate(parts):
        if part == "**":
            out += "(?:/[^/]*)*" if i < len(parts) - 1 else "(?:/.*)?"
            continue
        body = re.sub(r"\\\*", "[^/]*", re.sub(r"\\\?", "[^/]", re.sub(r"([.\\+*?()|{}^$])", r"\\\1", part)))
        out += "/" + body
    return f"^{out}(?:/.*)?$"


def remote_regex(pattern: str) -> str:
    """A repository glob, anchored at the host."""
    return "^" + glob_regex("/" + pattern.strip("/"))[2:]


@dataclass(frozen=True)
class Rule:
    mode: str
    pattern: str
    repo: bool = False
    admin: bool = False


MOST_BROADCAST = 10_000  # rules


def parse_rule(line: str, admin: bool = False) -> Rule:
    """MODE PATTERN, or MODE repo:PATTERN."""
    mode, _, pattern = line.strip().partition(" ")
    pattern = pattern.strip()
    if mode not in MODES or not pattern:
        raise ValueError(f"bad rule: {line}")
    return Rule(mode, pattern.removeprefix("repo:"), pattern.startswith("repo:"), admin)


def _rank():
    return F.expr(f"array_position(array({', '.join(repr(m) for m in MODES)}), mode)")


def decide(sessions: DataFrame, rules: DataFrame, unplaceable: str = "local") -> DataFrame:
    """id, mode and pattern: the most restrictive rule that matches a place (path rules) or the remote (repo rules); on a
    tie an admin's. Sessions without any place or remote get the unplaceable mode, sessions that no rule matches allow.

    Sessions are reduced to distinct places before they meet the rules: both are small against the messages.
    """
    places = sessions.select("id", F.explode(F.array_distinct(F.array_compact(F.array("cwd", "repo_root")))).alias("place"), F.lit(False).alias("is_repo"))
    places = places.unionByName(sessions.where("remote is not null").select("id", F.col("remote").alias("place"), F.lit(True).alias("is_repo")))
    rank = _rank()
    ranked = rules.select("is_repo", "regex", F.struct(rank.alias("rank"), F.col("is_admin").cast("int").alias("admin"), "mode", "pattern").alias("rule"))
    distinct = places.select("place", "is_repo").distinct()
    if rules.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        ranked = F.broadcast(ranked)  # every place meets all rules of its kind where it lies; a table of more rules is left to Spark
    met = distinct.join(ranked, "is_repo").where(F.rlike(F.lower("place"), F.col("regex"))).groupBy("place", "is_repo").agg(F.max("rule").alias("rule"))
    best = places.join(met, ["place", "is_repo"]).groupBy("id").agg(F.max("rule").alias("rule"))
    out = sessions.join(best, "id", "left")
    placed = F.coalesce("cwd", "repo_root", "remote").isNotNull()
    return out.select("id", F.when(~placed, F.lit(unplaceable)).otherwise(F.coalesce("rule.mode", F.lit("allow"))).alias("mode"), F.when(placed, F.col("rule.pattern")).alias("pattern"))


def most_restrictive(decisions: DataFrame, by: str) -> DataFrame:
    rank = _rank()
    return decisions.groupBy(by).agg(F.max_by("mode", rank).alias("mode"))


def hidden_by(sessions: DataFrame, decisions: DataFrame, now: str) -> DataFrame:
    """Sessions with hidden_at set for what is denied and cleared for what no longer is."""
    denied = decisions.where("mode = 'deny'").select("id", F.col("pattern").alias("__rule"))
    out = sessions.join(denied, "id", "left")
    return out.withColumn("hidden_at", F.when(F.col("__rule").isNotNull(), F.coalesce("hidden_at", F.lit(now).cast("timestamp")))).withColumn("hidden_rule", F.col("__rule")).drop("__rule")


def to_purge(sessions: DataFrame, now: str, days: int = 7) -> DataFrame:
    return sessions.where(F.col("hidden_at") <= F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(days)))


def evidence_rollup(evidence: DataFrame) -> DataFrame:
    """key, verdict (deny over local over allow) and mapping (unmapped over mapped over none) of rows (key, mode, mapping)."""
    has = lambda c, v: F.bool_or(F.col(c) == v)
    return evidence.groupBy("key").agg(
        F.when(has("mode", "deny"), "deny").when(has("mode", "local"), "local").otherwise("allow").alias("verdict"), F.when(has("mapping", "unmapped"), "unmapped").when(has("mapping", "mapped"), "mapped").otherwise("none").alias("mapping")
    )
