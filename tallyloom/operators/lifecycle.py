"""Deletion, backup, pairing, delivery states and other operations over the model's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyloom.functions.text import clip_bytes, one_line
from tallyloom.operators.digest import SHELL_TOOLS, digests
from tallyloom.operators.filters import live, on_path
from tallyloom.operators.graph import descendants, session_tree

#: States of a bus message in the order in which they are reached.
STATE_ORDER = ("queued", "held", "claimed", "delivered", "read", "refused", "expired", "failed")
#: Arguments that tell most of a tool call, in order.
TELLING = ("command", "cmd", "file_path", "notebook_path", "path", "pattern", "query", "url", "description", "prompt")
QUARANTINE_AFTER = 5
SEND_PER_HOUR = 30
SEAL_SECONDS = 300


def within_tree(messages: DataFrame, sessions: DataFrame, session_id: str) -> DataFrame:
    """Messages of a session and of all below it."""
    return messages.join(session_tree(sessions, session_id).select(F.col("id").alias("session_id")), "session_id", "left_semi")


def deletion_closure(sessions: DataFrame, user_id: str, session_id: str) -> DataFrame:
    """session_id and depth of what goes with a session of a user, on every device: it and its subagents, the deepest first to delete."""
    own = sessions.where(F.col("user_id") == user_id)
    links = own.select(F.col("session_id").alias("child"), F.col("parent_session_id").alias("parent"))
    return descendants(links, own.where(F.col("session_id") == session_id).select(F.col("session_id").alias("id"))).select(F.col("id").alias("session_id"), "depth")


def deleted(sessions: DataFrame, tombstones: DataFrame, user_id: str, session_id: str) -> tuple[DataFrame, DataFrame]:
    """(sessions without the closure, tombstones with it)."""
    gone = deletion_closure(sessions, user_id, session_id).select(F.lit(user_id).alias("user_id"), "session_id")
    return sessions.join(gone, ["user_id", "session_id"], "left_anti"), tombstones.unionByName(gone).distinct()


def backup_chunks(chunks: DataFrame, manifest: DataFrame, gone_sources: DataFrame) -> DataFrame:
    """Chunks that a source refers to which is not gone."""
    kept = manifest.join(gone_sources.select("source").distinct(), "source", "left_anti")
    return chunks.join(kept.select("hash").distinct(), "hash", "left_semi")


def damaged(chunks: DataFrame) -> DataFrame:
    """Chunks (hash, data) whose data has another hash."""
    return chunks.where(F.sha2("data", 256) != F.col("hash"))


def not_held(offered: DataFrame, held: DataFrame) -> DataFrame:
    """Offered hashes that the user does not hold."""
    return offered.select("hash").distinct().join(held.select("hash"), "hash", "left_anti")


def appended(manifest: DataFrame, batch: DataFrame) -> DataFrame:
    """The manifest with a batch's entries; entries that come again change nothing."""
    key = ["source", "generation", "ordinal"]
    return manifest.unionByName(batch.join(manifest.select(*key), key, "left_anti").dropDuplicates(key))


def paired_calls(messages: DataFrame) -> DataFrame:
    """call and result (ids) of each tool call: the first result of its call id after it, in the same conversation; null if none."""
    rows = messages.where(live() & on_path() & F.col("tool_call_id").isNotNull())
    calls = rows.where("kind = 'tool_call'").select("conversation_id", "tool_call_id", F.col("id").alias("call"), F.col("ordinal").alias("__o"))
    results = rows.where("kind = 'tool_result'").select("conversation_id", "tool_call_id", "ordinal", "id")
    met = calls.join(results, ["conversation_id", "tool_call_id"], "left").where("id is null or ordinal > __o")
    return met.groupBy("conversation_id", "call").agg(F.min_by("id", F.struct("ordinal", "id")).alias("result"))


def last_parts(messages: DataFrame) -> DataFrame:
    """conversation_id, line (native id without its part) and id of the last row of each physical line: what a child line hangs on."""
    rows = messages.where(live() & F.col("native_id").isNotNull()).withColumn("line", F.split("native_id", "#")[0])
    return rows.groupBy("conversation_id", "line").agg(F.max_by("id", F.struct("ordinal", "part", "id")).alias("id"))


def inferred_spawns(children: DataFrame, messages: DataFrame) -> DataFrame:
    """id of each child and the parent's result whose enrichment names its agent or run id."""
    named = messages.where("kind = 'tool_result' and enrichment is not null").select(F.col("id").alias("message_id"), F.explode(F.array_compact(F.array(F.get_json_object("enrichment", "$.agent_id"), F.get_json_object("enrichment", "$.workflow_run_id")))).alias("run"))
    runs = children.select("id", F.explode(F.array_compact(F.array(F.get_json_object("extra", "$.agent_id"), F.get_json_object("extra", "$.workflow_run_id")))).alias("run"))
    return runs.join(named, "run").groupBy("id").agg(F.min("message_id").alias("message_id"))


def call_summary() -> Column:
    """One line that tells a tool call: its command or first telling argument, else its text."""
    argument = F.coalesce(*[F.get_json_object("text", f"$.{a}") for a in TELLING], F.col("text"))
    return clip_bytes(one_line(argument), 120)


def is_shell() -> Column:
    return F.coalesce(F.lower("tool_name").isin(*SHELL_TOOLS), F.lit(False))


def age_label(seconds: Column) -> Column:
    """5s, 12m, 3h, 9d: whole units."""
    return (
        F.when(seconds < 60, F.concat(F.floor(seconds).cast("string"), F.lit("s"))).when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m")))
        .when(seconds < 86_400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h"))).otherwise(F.concat(F.floor(seconds / 86_400).cast("string"), F.lit("d")))
    )


def nearest_names(wanted: DataFrame, known: DataFrame, most: int = 2) -> DataFrame:
    """wanted and the known names at an edit distance of at most `most`. Two such names have in common what is left of each without
    at most as many characters; they meet by that."""

    def left_over(name: str):
        found = F.array(F.col(name))
        for _ in range(most):
            fewer = F.flatten(F.transform(found, lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))))
            found = F.array_distinct(F.concat(found, fewer))
        return found

    a = wanted.withColumn("__h", F.explode(left_over("wanted")))
    b = known.withColumn("__h", F.explode(left_over("name")))
    met = a.join(b, "__h").drop("__h").distinct()
    return met.withColumn("distance", F.levenshtein("wanted", "name")).where(F.col("distance") <= most)


def current_states(events: DataFrame) -> DataFrame:
    """id and state of bus messages from their events (id, state, at): the furthest state wins, whatever the order of arrival."""
    rank = F.expr(f"array_position(array({', '.join(repr(s) for s in STATE_ORDER)}), state)")
    return events.groupBy("id").agg(F.max_by("state", F.struct(rank, "at")).alias("state"))


def send_states(sends: DataFrame, accepts: DataFrame, most: int = SEND_PER_HOUR) -> DataFrame:
    """id and state of sends (id, sender, recipient, created_at): refused beyond `most` of one sender within an hour, held unless accepted."""
    seconds = F.unix_timestamp(F.col("created_at").cast("timestamp"))
    recent = F.count("*").over(W.partitionBy("sender").orderBy(seconds).rangeBetween(-3599, 0))
    pairs = accepts.select(F.col("owner").alias("recipient"), "sender").distinct().withColumn("__ok", F.lit(True))
    rows = sends.withColumn("__n", recent).join(pairs, ["recipient", "sender"], "left")
    ok = F.coalesce("__ok", F.lit(False)) | (F.col("sender") == F.col("recipient"))
    return rows.select("id", F.when(F.col("__n") > most, "refused").when(ok, "queued").otherwise("held").alias("state"))


def with_quarantine(parses: DataFrame, after: int = QUARANTINE_AFTER) -> DataFrame:
    return parses.withColumn("quarantined", F.col("quarantined") | (F.col("failures") >= after))


def sealed(tails: DataFrame, now: str, idle: int = SEAL_SECONDS) -> DataFrame:
    """Provisional tails that nothing was added to for long enough."""
    return tails.where(F.col("touched_at") <= F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(idle)))


def touched_digests(digest: DataFrame, batch: DataFrame, messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """The digests with those recomputed whose conversations a batch touches; the same as recomputing all."""
    touched = batch.select("conversation_id").distinct()
    fresh = digests(messages.join(touched, "conversation_id", "left_semi"), sessions.join(touched, sessions.id == touched.conversation_id, "left_semi"))
    return digest.join(touched, "conversation_id", "left_anti").unionByName(fresh)


def trace_coverage(sessions: DataFrame, evidence: DataFrame) -> DataFrame:
    """agent, has_evidence and all_hidden of the searched sessions: what an empty answer means."""
    have = evidence.select("conversation_id").distinct().withColumn("__e", F.lit(True))
    rows = sessions.join(have, sessions.id == have.conversation_id, "left")
    return rows.groupBy("agent").agg(F.bool_or(F.coalesce("__e", F.lit(False))).alias("has_evidence"), F.bool_and(F.col("hidden_at").isNotNull()).alias("all_hidden"))


def device_list(devices: DataFrame, users: DataFrame, credentials: DataFrame, now: str) -> DataFrame:
    """Devices with their owner's mail and whether a credential (device_id, expires_at) is live."""
    valid = credentials.where(F.col("expires_at") > F.lit(now).cast("timestamp")).select(F.col("device_id").alias("id")).distinct().withColumn("__v", F.lit(True))
    return devices.join(users.select(F.col("id").alias("user_id"), "email"), "user_id", "left").join(valid, "id", "left").select("id", "name", "email", F.coalesce("__v", F.lit(False)).alias("live"))
