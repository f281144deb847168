"""What may be seen and kept: hidden trees, policy placements, late sources, credentials, versions of parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyloom.operators.graph import descendants


def _below(sessions: DataFrame) -> DataFrame:
    """Links from each session to its parent: the one that its conversation names, else the one of its parent's native id on the same device and of the same agent."""
    ids = sessions.select(F.col("session_id").alias("s"), F.col("device_id").alias("d"), F.col("agent").alias("a"), F.col("id").alias("up"))
    near = (F.col("c.parent_session_id") == F.col("p.s")) & F.col("c.device_id").eqNullSafe(F.col("p.d")) & F.col("c.agent").eqNullSafe(F.col("p.a"))
    by_native = sessions.where("parent_conversation_id is null").alias("c").join(ids.alias("p"), near).select(F.col("c.id").alias("child"), F.col("p.up").alias("parent"))
    return sessions.where("parent_conversation_id is not null").select(F.col("id").alias("child"), F.col("parent_conversation_id").alias("parent")).unionByName(by_native)


def hidden_extension(sessions: DataFrame) -> DataFrame:
    """id of the sessions that a hidden one holds at any depth and that are not hidden yet."""
    roots = sessions.where("hidden_at is not null").select("id")
    return descendants(_below(sessions), roots).where("depth > 0").select("id").distinct().join(sessions.where("hidden_at is null").select("id"), "id", "left_semi")


def extend_hidden(sessions: DataFrame, now: str, rule: str = "parent is hidden") -> DataFrame:
    """The sessions with those below hidden ones hidden as well."""
    marks = hidden_extension(sessions).withColumn("__below", F.lit(True))
    rows = sessions.join(marks, "id", "left")
    at = F.when(F.col("__below"), F.lit(now).cast("timestamp")).otherwise(F.col("hidden_at"))
    return rows.withColumn("hidden_at", at).withColumn("hidden_rule", F.when(F.col("__below"), F.lit(rule)).otherwise(F.col("hidden_rule"))).select(*sessions.columns)


def restored(sessions: DataFrame, root: str, rule: str = "parent is hidden") -> DataFrame:
    """The sessions with `root` shown again, and those below it that were hidden only because of it."""
    below = descendants(_below(sessions), sessions.where(F.col("id") == root).select("id")).select("id").distinct().withColumn("__below", F.lit(True))
    rows = sessions.join(below, "id", "left")
    shown = F.coalesce("__below", F.lit(False)) & ((F.col("id") == root) | (F.col("hidden_rule") == rule))
    return rows.withColumn("hidden_at", F.when(~shown, F.col("hidden_at"))).withColumn("hidden_rule", F.when(~shown, F.col("hidden_rule"))).select(*sessions.columns)


def placement_keys(sessions: DataFrame, policy_links: DataFrame, wanted: DataFrame) -> DataFrame:
    """id and depth of the sessions whose policy placements decide over the `wanted` ones (id, a native session id): themselves, their
    ancestors, and what policy links (session_id, policy_session_id), read both ways, tie to any of these."""
    up = sessions.select(F.col("parent_session_id").alias("child"), F.col("session_id").alias("parent"))
    there = policy_links.select(F.col("policy_session_id").alias("child"), F.col("session_id").alias("parent"))
    back = policy_links.select(F.col("session_id").alias("child"), F.col("policy_session_id").alias("parent"))
    own = descendants(up, wanted).select("id").distinct()
    return descendants(there.unionByName(back), own)


def late_sources(sources: DataFrame) -> DataFrame:
    """source and generation: sources that a newer one names as its previous (unless each names the other), with the newer ones' highest generation."""
    live = sources.where(~F.col("tombstoned"))
    newer = live.select(F.col("source").alias("by"), F.col("previous").alias("source"), "generation")
    own = sources.select("source", F.col("previous").alias("own_previous"))
    met = newer.join(own, "source").where(~F.col("by").eqNullSafe(F.col("own_previous")))
    return met.groupBy("source").agg(F.max("generation").alias("generation"), F.count("*").alias("n")).where("n > 0").select("source", "generation")


def ended_credentials(credentials: DataFrame, now: str, idle_days: int = 90) -> DataFrame:
    """id and reason of credentials that end as of `now`: past their deadline (sessions excepted), or of a device that was not seen for so long."""
    at = F.lit(now).cast("timestamp")
    expired = (F.col("kind") != "session") & (F.col("expires_at") <= at)
    idle = (F.col("kind") == "device") & (F.col("last_seen_at") <= at - F.make_dt_interval(days=F.lit(idle_days)))
    return credentials.where("revoked_at is null").select("id", F.when(F.coalesce(expired, F.lit(False)), "expired").when(F.coalesce(idle, F.lit(False)), "idle").alias("reason")).where("reason is not null")


def to_parse_again(parses: DataFrame, contract: str) -> DataFrame:
    """source of the latest generations that another version of the parser wrote."""
    return parses.groupBy("source").agg(F.max_by("contract", "generation").alias("contract")).where(~F.col("contract").eqNullSafe(F.lit(contract))).select("source")


def message_sources(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """id, conversation_id and source_generation of the messages asked for."""
    return messages.join(ids.select("id").distinct(), "id", "left_semi").select("id", "conversation_id", "source_generation")


def evidence_limits(messages: DataFrame, most_records: int = 100_000, most_bytes: int = 64 << 20) -> DataFrame:
    """conversation_id, records, bytes and limited: whether a conversation's tool records are more than one fold reads at once."""
    tools = messages.where(F.col("kind").isin("tool_call", "tool_result"))
    sums = tools.groupBy("conversation_id").agg(F.count("*").alias("records"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("bytes"))
    return sums.withColumn("limited", (F.col("records") > most_records) | (F.col("bytes") > most_bytes))


def operation_timings(rows: DataFrame, operation: str, value: str) -> DataFrame:
    """operation, n, total and longest."""
    return rows.groupBy(F.col(operation).alias("operation")).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("longest"))
