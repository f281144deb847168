"""Sessions: listing, keyset pages, reading around a message, outlines, addresses, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tallyloom.functions.text import common_prefix
from tallyloom.operators.filters import live, on_path

SHORT_ID = 8


def enriched(messages: DataFrame, sessions: DataFrame, devices: DataFrame, users: DataFrame) -> DataFrame:
    """Messages with their visible session, device and user. The dimensions' sizes decide how Spark joins."""
    visible = sessions.where("hidden_at is null").select(F.col("id").alias("conversation_id"), "agent", "device_id", "user_id", "cwd", "repo_root", "title", "depth")
    names = devices.select(F.col("id").alias("device_id"), F.col("name").alias("device"))
    mails = users.select(F.col("id").alias("user_id"), "email")
    return messages.join(visible, "conversation_id").join(names, "device_id", "left").join(mails, "user_id", "left")


def listing(sessions: DataFrame, oldest: bool = False) -> list:
    at = F.col("last_activity_at")
    return [at.asc_nulls_last(), F.col("id").asc()] if oldest else [at.desc_nulls_last(), F.col("id").desc()]


def page_after(sessions: DataFrame, cursor: tuple[str | None, str] | None, limit: int) -> DataFrame:
    """Sessions after the cursor (last activity, id), newest first, undated last; one more row than the limit tells that there is more."""
    if cursor:
        at, id_ = cursor
        if at is None:
            sessions = sessions.where(F.col("last_activity_at").isNull() & (F.col("id") < id_))
        else:
            ts = F.lit(at).cast("timestamp")
            sessions = sessions.where((F.col("last_activity_at") < ts) | ((F.col("last_activity_at") == ts) & (F.col("id") < id_)) | F.col("last_activity_at").isNull())
    return sessions.orderBy(*listing(sessions)).limit(limit + 1)


def cursor_of(micros: int | None, id_: str) -> str:
    return f"{'-' if micros is None else micros}.{id_}"


def parse_cursor(cursor: str) -> tuple[int | None, str]:
    at, _, id_ = cursor.partition(".")
    if not id_:
        raise ValueError("bad cursor")
    return (None if at == "-" else int(at)), id_


def first_messages(messages: DataFrame, kind: str | None = None) -> DataFrame:
    """The first live message of each session, by (ordinal, id): one aggregate, no window."""
    rows = messages.where(live() & on_path())
    if kind:
        rows = rows.where(F.col("kind") == kind)
    return rows.groupBy("conversation_id").agg(F.min_by(F.struct("id", "ordinal", "text"), F.struct("ordinal", "id")).alias("m")).select("conversation_id", "m.*")


def around(messages: DataFrame, id_: str, before: int, after: int) -> DataFrame:
    """The message and its neighbours by (ordinal, id) in its session, with offset (0 is the message)."""
    focus = messages.where(F.col("id") == id_).select("conversation_id")
    rows = messages.where(live() & on_path()).join(focus, "conversation_id", "left_semi")
    order = W.partitionBy("conversation_id").orderBy("ordinal", "id")
    numbered = rows.withColumn("__n", F.row_number().over(order))
    at = F.max(F.when(F.col("id") == id_, F.col("__n"))).over(W.partitionBy("conversation_id"))
    return numbered.withColumn("offset", F.col("__n") - at).where(F.col("offset").between(-before, after)).drop("__n")


def outline(messages: DataFrame, conversation_id: str, after: tuple[int, str] | None = None, limit: int = 100) -> DataFrame:
    """Skeleton of a session: prompts and replies by ordinal, keyset on (ordinal, id)."""
    rows = messages.where(live() & on_path() & (F.col("conversation_id") == conversation_id) & F.col("kind").isin("user", "assistant", "agent_message"))
    if after:
        ordinal, id_ = after
        rows = rows.where((F.col("ordinal") > ordinal) | ((F.col("ordinal") == ordinal) & (F.col("id") > id_)))
    return rows.select("id", "ordinal", "kind", F.left(F.regexp_replace("text", r"\s+", " "), F.lit(100)).alias("line")).orderBy("ordinal", "id").limit(limit)


def best_version(messages: DataFrame) -> DataFrame:
    """One row for each (session, ordinal): live before superseded, on the path before off it, newest version, least id."""
    order = W.partitionBy("session_id", "ordinal").orderBy("superseded", F.coalesce("on_active_path", F.lit(True)).desc(), F.col("version").desc(), "id")
    return messages.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def short_ids(sessions: DataFrame) -> DataFrame:
    """session_id and its shortest unique prefix, of at least SHORT_ID characters.

    Neighbours in byte order decide. Ids are range-partitioned by their first characters, so no task orders them all;
    ids with other beginnings of SHORT_ID characters can't share a longer prefix.
    """
    ids = sessions.select("session_id").where("session_id is not null").distinct().withColumn("__head", F.left("session_id", F.lit(SHORT_ID)))
    order = W.partitionBy("__head").orderBy("session_id")
    shared = F.greatest(F.coalesce(common_prefix(F.col("session_id"), F.lag("session_id").over(order)), F.lit(0)), F.coalesce(common_prefix(F.col("session_id"), F.lead("session_id").over(order)), F.lit(0)))
    n = F.greatest(shared + 1, F.lit(SHORT_ID))
    return ids.withColumn("__n", n).select("session_id", F.substring("session_id", F.lit(1), F.col("__n")).alias("short"))


def resolve(sessions: DataFrame, wanted: str) -> list[str]:
    """The session of that id, else of that unique prefix; several candidates (at most six) if it is ambiguous."""
    exact = sessions.where(F.col("session_id") == wanted).select("session_id").limit(1).collect()
    if exact:
        return [wanted]
    return [r.session_id for r in sessions.where(F.col("session_id").startswith(wanted)).select("session_id").distinct().orderBy("session_id").limit(6).collect()]


def parents(sessions: DataFrame) -> DataFrame:
    """id and parent_id by native session id: the least id on the same device and of the same agent, else on any; unresolved parents stay null."""
    place = ["device_id", "agent"]
    near = sessions.groupBy(F.col("session_id").alias("s"), *place).agg(F.min("id").alias("near_id"))
    far = sessions.groupBy(F.col("session_id").alias("parent_session_id")).agg(F.min("id").alias("far_id"))
    same = (F.col("c.parent_session_id") == F.col("n.s")) & F.col("c.device_id").eqNullSafe(F.col("n.device_id")) & F.col("c.agent").eqNullSafe(F.col("n.agent"))
    own = sessions.select("id", "parent_session_id", *place).alias("c").join(near.alias("n"), same, "left").select("c.id", "c.parent_session_id", "n.near_id")
    return own.join(far, "parent_session_id", "left").select("id", "parent_session_id", F.coalesce("near_id", "far_id").alias("parent_id"))


def spawn_links(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """id of each child session and the parent's tool call that spawned it: by call id or native id, the least message id."""
    children = parents(sessions).join(sessions.select("id", "spawned_by_native_id"), "id").where("parent_id is not null and spawned_by_native_id is not null")
    calls = messages.where("kind = 'tool_call'").select(F.col("conversation_id").alias("parent_id"), "tool_call_id", "native_id", F.col("id").alias("message_id"))
    by_call = children.join(calls.withColumnRenamed("tool_call_id", "spawned_by_native_id"), ["parent_id", "spawned_by_native_id"])
    by_native = children.join(calls.withColumnRenamed("native_id", "spawned_by_native_id"), ["parent_id", "spawned_by_native_id"])
    return by_call.select("id", "message_id").unionByName(by_native.select("id", "message_id")).groupBy("id").agg(F.min("message_id").alias("message_id"))


def repo_scope(sessions: DataFrame, remote: str) -> DataFrame:
    """Sessions of a repository by remote, and their direct children."""
    own = sessions.where(F.col("remote") == remote).select("session_id")
    children = sessions.join(own.withColumnRenamed("session_id", "parent_session_id"), "parent_session_id", "left_semi").select("session_id")
    return sessions.join(own.union(children).distinct(), "session_id", "left_semi")


def repo_edges(sessions: DataFrame) -> DataFrame:
    """Edges between sessions' places and what they share: a remote, or a device and checkout."""
    place = F.concat_ws(":", F.lit("place"), "device_id", "repo_root")
    by_remote = sessions.where("repo_root is not null and remote is not null").select(place.alias("a"), F.concat(F.lit("remote:"), F.col("remote")).alias("b"))
    alone = sessions.where("repo_root is not null").select(place.alias("a"), place.alias("b"))
    return by_remote.unionByName(alone).distinct()
