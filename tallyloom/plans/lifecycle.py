"""Queries of deletion, pairing, delivery and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import evidence as ev, lifecycle as lc
from tallyloom.plans.fixtures import cte, frame
from tallyloom.plans.registry import query
from tallyloom.plans.summaries import EVIDENCE
from tallyloom.sources import views as v


@query("tree_messages", f"WITH RECURSIVE {cte('sessions', 'messages')}, t(id) AS (SELECT 's-beta-2' UNION SELECT s.session_id FROM sessions s JOIN t ON s.parent_session_id = t.id) SELECT id FROM messages WHERE session_id IN (SELECT id FROM t)")
def tree_messages(spark, sf_dir):
    return lc.within_tree(frame(spark, "messages", sf_dir), frame(spark, "sessions", sf_dir), "s-beta-2").select("id")


@query("deletion_closure", f"WITH RECURSIVE {cte('sessions')}, t(session_id, depth) AS (SELECT 's-alpha-1', 0 UNION SELECT s.session_id, t.depth + 1 FROM sessions s JOIN t ON s.parent_session_id = t.session_id WHERE s.user_id = 'u1' AND t.depth < 10) SELECT session_id, depth::INTEGER AS depth FROM t")
def deletion_closure(spark, sf_dir):
    return lc.deletion_closure(frame(spark, "sessions", sf_dir), "u1", "s-alpha-1")


@query("backup_chunks", f"WITH {cte('chunks', 'manifest')} SELECT hash FROM chunks c WHERE EXISTS (SELECT 1 FROM manifest m WHERE m.hash = c.hash AND m.source <> 'f2')")
def backup_chunks(spark, sf_dir):
    gone = spark.createDataFrame([("f2",)], "source string")
    return lc.backup_chunks(frame(spark, "chunks", sf_dir), frame(spark, "manifest", sf_dir), gone).select("hash")


@query("paired_calls", f"""WITH {cte('messages')}, m AS (SELECT * FROM messages WHERE NOT superseded AND coalesce(on_active_path, TRUE) AND tool_call_id IS NOT NULL)
SELECT c.conversation_id, c.id AS call, (SELECT arg_min(r.id, (r.ordinal, r.id)) FROM m r WHERE r.kind = 'tool_result' AND r.conversation_id = c.conversation_id AND r.tool_call_id = c.tool_call_id AND r.ordinal > c.ordinal) AS result FROM m c WHERE c.kind = 'tool_call'""")  # fmt: skip
def paired_calls(spark, sf_dir):
    return lc.paired_calls(frame(spark, "messages", sf_dir))


@query("last_parts", f"WITH {cte('messages')} SELECT conversation_id, split_part(native_id, '#', 1) AS line, arg_max(id, (ordinal, part, id)) AS id FROM messages WHERE NOT superseded GROUP BY 1, 2")
def last_parts(spark, sf_dir):
    return lc.last_parts(frame(spark, "messages", sf_dir))


@query("call_summaries", rf"""WITH {cte('messages')} SELECT id, coalesce(nullif(regexp_extract(text, '"command":"([^"]*)"', 1), ''), nullif(regexp_extract(text, '"file_path":"([^"]*)"', 1), ''), trim(regexp_replace(text, '\s+', ' ', 'g'))) AS summary FROM messages WHERE kind = 'tool_call'""")
def call_summaries(spark, sf_dir):
    return frame(spark, "messages", sf_dir).where("kind = 'tool_call'").select("id", lc.call_summary().alias("summary"))


@query("order_ages", """WITH l AS (SELECT max(o_orderdate) AS t FROM orders), a AS (SELECT o_orderkey, epoch(t - o_orderdate) AS s FROM orders, l)
SELECT o_orderkey, CASE WHEN s < 60 THEN floor(s)::BIGINT || 's' WHEN s < 3600 THEN floor(s / 60)::BIGINT || 'm' WHEN s < 86400 THEN floor(s / 3600)::BIGINT || 'h' ELSE floor(s / 86400)::BIGINT || 'd' END AS age FROM a""")  # fmt: skip
def order_ages(spark, sf_dir):
    orders = v.table(spark, sf_dir, "orders").select("o_orderkey", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("t"))
    latest = orders.agg(F.max("t")).first()[0] or 0
    return orders.select("o_orderkey", lc.age_label(F.lit(latest) - F.col("t")).alias("age"))


@query("bus_states", f"WITH {cte('bus')}, e AS (SELECT thread_id AS id, state, created_at AS t FROM bus) SELECT id, arg_max(state, (list_position(['queued', 'held', 'claimed', 'delivered', 'read', 'refused', 'expired', 'failed'], state), t)) AS state FROM e GROUP BY id")
def bus_states(spark, sf_dir):
    return lc.current_states(frame(spark, "bus", sf_dir).select(F.col("thread_id").alias("id"), "state", F.col("created_at").alias("at")))


@query("send_limits", """WITH s AS (SELECT event_id AS id, user_id AS sender, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS n FROM events) SELECT id, CASE WHEN n > 2 THEN 'refused' WHEN sender % 2 = 0 THEN 'queued' ELSE 'held' END AS state FROM s""".replace("epoch(ts)::BIGINT", "floor(epoch(ts))::BIGINT"))
def send_limits(spark, sf_dir):
    events = v.table(spark, sf_dir, "events")
    sends = events.select(F.col("event_id").alias("id"), F.col("user_id").alias("sender"), F.lit(-1).cast("long").alias("recipient"), F.col("ts").alias("created_at"))
    accepts = events.where("user_id % 2 = 0").select(F.lit(-1).cast("long").alias("owner"), F.col("user_id").alias("sender")).distinct()
    return lc.send_states(sends, accepts, 2)


@query("trace_coverage", f"WITH {cte('messages', 'sessions')}, {EVIDENCE} SELECT agent, bool_or(id IN (SELECT conversation_id FROM evidence)) AS has_evidence, bool_and(hidden_at IS NOT NULL) AS all_hidden FROM sessions GROUP BY agent")
def trace_coverage(spark, sf_dir):
    return lc.trace_coverage(frame(spark, "sessions", sf_dir), ev.commit_evidence(frame(spark, "messages", sf_dir)))


@query("manifest_append", f"WITH {cte('manifest')} SELECT source, generation, ordinal, hash FROM manifest UNION ALL SELECT 'f1', 1, 2, 'h9'")
def manifest_append(spark, sf_dir):
    batch = spark.createDataFrame([("f1", 1, 1, "h2"), ("f1", 1, 2, "h9"), ("f1", 1, 2, "h9")], "source string, generation long, ordinal int, hash string")
    return lc.appended(frame(spark, "manifest", sf_dir), batch)


@query("customers_without_orders", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def customers_without_orders(spark, sf_dir):
    return v.table(spark, sf_dir, "customer").join(v.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("order_line_status", "SELECT l_orderkey, count(*) FILTER (WHERE l_linestatus = 'O') AS open_lines, count(*) AS lines, bool_or(l_returnflag = 'R') AS returned FROM lineitem GROUP BY l_orderkey")
def order_line_status(spark, sf_dir):
    rows = v.table(spark, sf_dir, "lineitem")
    return rows.groupBy("l_orderkey").agg(F.count(F.when(F.col("l_linestatus") == "O", 1)).alias("open_lines"), F.count("*").alias("lines"), F.bool_or(F.col("l_returnflag") == "R").alias("returned"))
