"""Queries over joins, trees, links, merges, policy and the message bus."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import bus as b, graph as gr, merge as m, policy as p, sessions as se
from tallyloom.plans.fixtures import cte, frame
from tallyloom.plans.registry import query
from tallyloom.sources import views as v


@query("messages_enriched_join", f"""WITH {cte('messages', 'sessions', 'devices', 'users')} SELECT m.id, s.agent, d.name AS device, u.email, s.depth FROM messages m JOIN sessions s ON s.id = m.conversation_id AND s.hidden_at IS NULL
LEFT JOIN devices d ON d.id = s.device_id LEFT JOIN users u ON u.id = s.user_id""")  # fmt: skip
def messages_enriched_join(spark, sf_dir):
    return se.enriched(frame(spark, "messages", sf_dir), frame(spark, "sessions", sf_dir), frame(spark, "devices", sf_dir), frame(spark, "users", sf_dir)).select("id", "agent", "device", "email", "depth")


@query("semi_repo_scope", f"WITH {cte('sessions')} SELECT id FROM sessions WHERE remote = 'github.com/acme/app' OR parent_session_id IN (SELECT session_id FROM sessions WHERE remote = 'github.com/acme/app')")
def semi_repo_scope(spark, sf_dir):
    return se.repo_scope(frame(spark, "sessions", sf_dir), "github.com/acme/app").select("id")


TREE = "WITH RECURSIVE {s}, t(id, depth) AS (SELECT '{root}', 0 UNION SELECT s.session_id, t.depth + 1 FROM sessions s JOIN t ON s.parent_session_id = t.id WHERE t.depth < 10), tree AS (SELECT id, min(depth)::INTEGER AS depth FROM t GROUP BY id)"


@query("session_tree", TREE.format(s=cte("sessions"), root="s-alpha-1") + " SELECT id, depth FROM tree")
def session_tree(spark, sf_dir):
    return gr.session_tree(frame(spark, "sessions", sf_dir), "s-alpha-1")


@query("session_tree_cycle", TREE.format(s=cte("sessions"), root="s-loop-a") + " SELECT id, depth FROM tree")
def session_tree_cycle(spark, sf_dir):
    return gr.session_tree(frame(spark, "sessions", sf_dir), "s-loop-a")


@query("anti_exclude_tree", TREE.format(s=cte("sessions"), root="s-alpha-1") + " SELECT id FROM sessions WHERE session_id NOT IN (SELECT id FROM tree)")
def anti_exclude_tree(spark, sf_dir):
    return gr.without_tree(frame(spark, "sessions", sf_dir), "s-alpha-1").select("id")


@query("region_tree", """SELECT 'region' AS level, count(*) AS n FROM region WHERE r_name = 'ASIA' UNION ALL SELECT 'nation', count(*) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'
UNION ALL SELECT 'customer', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'""")  # fmt: skip
def region_tree(spark, sf_dir):
    """The same closure over the driver's tables: region, its nations, their customers."""
    t = lambda name: v.table(spark, sf_dir, name)
    nations = t("nation").select(F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("child"), F.concat(F.lit("region/"), F.col("n_regionkey").cast("string")).alias("parent"))
    customers = t("customer").select(F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("child"), F.concat(F.lit("nation/"), F.col("c_nationkey").cast("string")).alias("parent"))
    root = t("region").where("r_name = 'ASIA'").select(F.concat(F.lit("region/"), F.col("r_regionkey").cast("string")).alias("id"))
    return gr.descendants(nations.unionByName(customers), root).groupBy(F.split("id", "/")[0].alias("level")).agg(F.count("*").alias("n"))


@query("ancestors_walk", f"WITH RECURSIVE {cte('sessions')}, t(id, depth) AS (SELECT 's-beta-9', 0 UNION SELECT s.parent_session_id, t.depth + 1 FROM sessions s JOIN t ON s.session_id = t.id WHERE s.parent_session_id IS NOT NULL AND t.depth < 10) SELECT id, depth::INTEGER AS depth FROM t")
def ancestors_walk(spark, sf_dir):
    s = frame(spark, "sessions", sf_dir)
    return gr.ancestors(s.select(F.col("session_id").alias("child"), F.col("parent_session_id").alias("parent")), s.where("session_id = 's-beta-9'").select(F.col("session_id").alias("id")))


@query("parent_link_resolve", f"WITH {cte('sessions')} SELECT s.id, s.parent_session_id, coalesce((SELECT min(p.id) FROM sessions p WHERE p.session_id = s.parent_session_id AND p.device_id IS NOT DISTINCT FROM s.device_id AND p.agent IS NOT DISTINCT FROM s.agent), (SELECT min(p.id) FROM sessions p WHERE p.session_id = s.parent_session_id)) AS parent_id FROM sessions s")
def parent_link_resolve(spark, sf_dir):
    return se.parents(frame(spark, "sessions", sf_dir))


@query("spawn_link_min", f"""WITH {cte('sessions', 'messages')} SELECT c.id, min(m.id) AS message_id FROM sessions c JOIN sessions p ON p.session_id = c.parent_session_id
JOIN messages m ON m.conversation_id = p.id AND m.kind = 'tool_call' AND (m.tool_call_id = c.spawned_by_native_id OR m.native_id = c.spawned_by_native_id) GROUP BY c.id""")  # fmt: skip
def spawn_link_min(spark, sf_dir):
    return se.spawn_links(frame(spark, "sessions", sf_dir), frame(spark, "messages", sf_dir))


@query("lateral_first_message", "SELECT conv_id::VARCHAR AS conversation_id, arg_min(text, turn) AS text FROM conversations GROUP BY conv_id")
def lateral_first_message(spark, sf_dir):
    rows = v.chat(spark, sf_dir).withColumn("superseded", F.lit(False)).withColumn("on_active_path", F.lit(None).cast("boolean")).withColumnRenamed("session_id", "conversation_id")
    return se.first_messages(rows).select("conversation_id", "text")


@query("read_context_window", f"""WITH {cte('messages')}, r AS (SELECT id, row_number() OVER (ORDER BY ordinal, id) AS n FROM messages WHERE conversation_id = 'c1' AND NOT superseded AND coalesce(on_active_path, TRUE)), f AS (SELECT n AS k FROM r WHERE id = 'm05')
SELECT id, (n - k)::INTEGER AS "offset" FROM r, f WHERE n - k BETWEEN -2 AND 3""")  # fmt: skip
def read_context_window(spark, sf_dir):
    return se.around(frame(spark, "messages", sf_dir), "m05", 2, 3).select("id", F.col("offset").cast("int").alias("offset"))


@query("read_outline", f"WITH {cte('messages')} SELECT id, ordinal, kind, left(regexp_replace(text, '\\s+', ' ', 'g'), 100) AS line FROM messages WHERE conversation_id = 'c1' AND NOT superseded AND coalesce(on_active_path, TRUE) AND kind IN ('user', 'assistant', 'agent_message') ORDER BY ordinal, id")
def read_outline(spark, sf_dir):
    return se.outline(frame(spark, "messages", sf_dir), "c1")


@query("best_version", f"WITH {cte('messages')} SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY session_id, ordinal ORDER BY superseded, coalesce(on_active_path, TRUE) DESC, version DESC, id) AS n FROM messages) t WHERE n = 1")
def best_version(spark, sf_dir):
    return se.best_version(frame(spark, "messages", sf_dir)).select("id")


@query("shortest_unique_prefix", f"""WITH {cte('sessions')}, p AS (SELECT a.session_id, (SELECT max(k) FROM range(0, 40) r(k) WHERE k <= length(a.session_id) AND EXISTS (SELECT 1 FROM sessions b WHERE b.session_id <> a.session_id AND left(b.session_id, k::INT) = left(a.session_id, k::INT))) AS shared FROM sessions a)
SELECT session_id, left(session_id, greatest(coalesce(shared, 0) + 1, 8)::INT) AS short FROM p""")  # fmt: skip
def shortest_unique_prefix(spark, sf_dir):
    return se.short_ids(frame(spark, "sessions", sf_dir))


@query("repo_components", f"""WITH {cte('sessions')}, pl AS (SELECT DISTINCT 'place:' || device_id || ':' || repo_root AS place, remote FROM sessions WHERE repo_root IS NOT NULL)
SELECT p.place, least(coalesce(min(q.place), p.place), p.place) AS component FROM (SELECT DISTINCT place FROM pl) p LEFT JOIN pl r ON r.place = p.place AND r.remote IS NOT NULL LEFT JOIN pl q ON q.remote = r.remote GROUP BY p.place""")  # fmt: skip
def repo_components(spark, sf_dir):
    spark.sparkContext.setCheckpointDir(v_folder(spark))
    found = gr.components(se.repo_edges(frame(spark, "sessions", sf_dir)))
    return found.where(F.col("id").startswith("place:")).select(F.col("id").alias("place"), "component")


def v_folder(spark) -> str:
    from tallyloom.sources.shared import shared_folder

    return shared_folder(spark)


@query("active_path_set", f"WITH RECURSIVE {cte('nodes')}, t AS (SELECT session, node, parent FROM nodes WHERE is_leaf UNION SELECT n.session, n.node, n.parent FROM nodes n JOIN t ON n.session = t.session AND n.node = t.parent) SELECT session, node FROM t")
def active_path_set(spark, sf_dir):
    return gr.active_path(frame(spark, "nodes", sf_dir))


@query("merge_upsert_actions", f"""WITH {cte('messages', 'batch')} SELECT b.conversation_id, b.native_id, CASE WHEN h.id IS NULL THEN 'insert' WHEN h.text = b.text THEN 'touch' WHEN starts_with(b.text, h.text) THEN 'grow' ELSE 'version' END AS action
FROM (SELECT DISTINCT * FROM batch) b LEFT JOIN messages h ON h.conversation_id = b.conversation_id AND h.native_id = b.native_id AND h.part = b.part AND NOT h.superseded""")  # fmt: skip
def merge_upsert_actions(spark, sf_dir):
    return m.actions(frame(spark, "messages", sf_dir), frame(spark, "batch", sf_dir)).select("conversation_id", "native_id", "action")


@query("merge_upsert_versions", f"""WITH {cte('messages', 'batch')}, a AS (SELECT b.*, h.id AS hid, h.version AS v, CASE WHEN h.id IS NULL THEN 'insert' WHEN h.text = b.text THEN 'touch' WHEN starts_with(b.text, h.text) THEN 'grow' ELSE 'version' END AS action
FROM (SELECT DISTINCT * FROM batch) b LEFT JOIN messages h ON h.conversation_id = b.conversation_id AND h.native_id = b.native_id AND h.part = b.part AND NOT h.superseded)
SELECT m.id, CASE WHEN a.action = 'grow' THEN a.text ELSE m.text END AS text, m.version, m.superseded OR coalesce(a.action = 'version', FALSE) AS superseded FROM messages m LEFT JOIN a ON a.hid = m.id
UNION ALL SELECT concat_ws('/', conversation_id, native_id, part::VARCHAR, coalesce(v + 1, 1)::VARCHAR), text, coalesce(v + 1, 1)::INTEGER, FALSE FROM a WHERE action IN ('insert', 'version')""")  # fmt: skip
def merge_upsert_versions(spark, sf_dir):
    return m.upsert(frame(spark, "messages", sf_dir), frame(spark, "batch", sf_dir), 2).select("id", "text", "version", "superseded")


@query("supersede_absent", f"WITH {cte('messages')} SELECT id, superseded OR source_generation < 1 AS superseded FROM messages")
def supersede_absent(spark, sf_dir):
    return m.supersede_absent(frame(spark, "messages", sf_dir), 1).select("id", "superseded")


@query("latest_order_per_customer", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def latest_order_per_customer(spark, sf_dir):
    rows = v.table(spark, sf_dir, "orders")
    return rows.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


DECIDED = f"""{cte('sessions', 'rules')}, places AS (SELECT id, cwd AS place, FALSE AS r FROM sessions WHERE cwd IS NOT NULL UNION SELECT id, repo_root, FALSE FROM sessions WHERE repo_root IS NOT NULL UNION SELECT id, remote, TRUE FROM sessions WHERE remote IS NOT NULL),
met AS (SELECT p.id, r.mode, r.pattern, list_position(['allow', 'local', 'deny'], r.mode) AS rank, r.is_admin::INT AS admin FROM places p JOIN rules r ON r.is_repo = p.r AND regexp_matches(lower(p.place), r.regex)),
best AS (SELECT id, arg_max(mode, (rank, admin, mode, pattern)) AS mode, arg_max(pattern, (rank, admin, mode, pattern)) AS pattern FROM met GROUP BY id),
d AS (SELECT s.id, s.agent, CASE WHEN coalesce(cwd, repo_root, remote) IS NULL THEN 'local' ELSE coalesce(b.mode, 'allow') END AS mode, b.pattern FROM sessions s LEFT JOIN best b ON b.id = s.id)"""


@query("policy_decide", f"WITH {DECIDED} SELECT id, mode, pattern FROM d")
def policy_decide(spark, sf_dir):
    return p.decide(frame(spark, "sessions", sf_dir), frame(spark, "rules", sf_dir))


@query("policy_most_restrictive", f"WITH {DECIDED} SELECT agent, arg_max(mode, list_position(['allow', 'local', 'deny'], mode)) AS mode FROM d GROUP BY agent")
def policy_most_restrictive(spark, sf_dir):
    sessions = frame(spark, "sessions", sf_dir)
    return p.most_restrictive(p.decide(sessions, frame(spark, "rules", sf_dir)).join(sessions.select("id", "agent"), "id"), "agent")


NOW = "2026-01-01 12:01:10"
PRESENT = f"""{cte('presence')}, pr AS (SELECT session_id, agent, user_id, unnest(arg_max(struct_pack(repo := repo, remote := remote, busy := busy, seen_at := seen_at), (seen_at, busy)))
FROM presence WHERE enabled AND seen_at > TIMESTAMP '{NOW}' - INTERVAL 75 SECOND GROUP BY session_id, agent, user_id)"""


@query("peers", f"WITH {PRESENT} SELECT session_id, agent, user_id, busy, user_id = 'u1' AS own FROM pr WHERE session_id <> 's2'")
def peers(spark, sf_dir):
    return b.peers(frame(spark, "presence", sf_dir), NOW, "u1", "s2").select("session_id", "agent", "user_id", "busy", "own")


@query("route_eligible", f"""WITH {PRESENT}, t AS (SELECT *, CASE WHEN coalesce(lower(remote) = 'acme/app' OR ends_with(lower(remote), '/acme/app'), FALSE) THEN 2 WHEN remote IS NULL AND repo = 'app' THEN 1 ELSE 0 END AS tier FROM pr),
x AS (SELECT *, max(tier) OVER (PARTITION BY user_id) AS best FROM t) SELECT session_id, user_id, tier FROM x WHERE tier = best AND tier > 0""")  # fmt: skip
def route_eligible(spark, sf_dir):
    return b.eligible(frame(spark, "presence", sf_dir), NOW, "acme/app").select("session_id", "user_id", "tier")


STATES = f"{cte('bus', 'accepts')}, s AS (SELECT * REPLACE (CASE WHEN state IN ('queued', 'held') AND created_at <= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR THEN 'expired' ELSE state END AS state) FROM bus)"


@query("inbox", f"""WITH {STATES}, r AS (SELECT id, state, 'received' AS direction, created_at FROM s WHERE recipient = 'u1' AND state NOT IN ('held', 'refused') AND (state <> 'expired' OR EXISTS (SELECT 1 FROM accepts a WHERE a.owner = 'u1' AND a.sender = s.sender))
UNION ALL SELECT id, state, 'sent', created_at FROM s WHERE sender = 'u1') SELECT id, state, direction FROM r ORDER BY created_at DESC, id DESC, direction LIMIT 50""")  # fmt: skip
def inbox(spark, sf_dir):
    return b.inbox(frame(spark, "bus", sf_dir), frame(spark, "accepts", sf_dir), "u1", NOW).select("id", "state", "direction")


@query("threads_latest", f"""WITH {cte('bus', 'accepts')}, l AS (SELECT thread_id, arg_max(id, (created_at, id)) AS id, count(*) AS messages FROM bus GROUP BY thread_id),
pp AS (SELECT thread_id, list_sort(list(DISTINCT p)) AS participants FROM (SELECT thread_id, sender AS p FROM bus UNION ALL SELECT thread_id, recipient FROM bus) t GROUP BY thread_id)
SELECT l.thread_id, l.id, l.messages, pp.participants, EXISTS (SELECT 1 FROM accepts a WHERE a.owner = b.recipient AND a.sender = b.sender) AND EXISTS (SELECT 1 FROM accepts a WHERE a.owner = b.sender AND a.sender = b.recipient) AS mutual
FROM l JOIN pp USING (thread_id) JOIN bus b ON b.id = l.id""")  # fmt: skip
def threads_latest(spark, sf_dir):
    return b.threads(frame(spark, "bus", sf_dir), frame(spark, "accepts", sf_dir)).select("thread_id", "id", "messages", "participants", "mutual")


@query("held_summary", f"WITH {cte('bus')} SELECT sender, count(*) AS held, min(created_at) AS oldest FROM bus WHERE recipient = 'u1' AND state = 'held' GROUP BY sender")
def held_summary(spark, sf_dir):
    return b.held(frame(spark, "bus", sf_dir), "u1").select("sender", "held", "oldest")


@query("sweep_expire", f"WITH {STATES} SELECT id, state FROM s WHERE NOT (state IN ('read', 'refused', 'expired', 'failed') AND created_at <= TIMESTAMP '{NOW}' - INTERVAL 7 DAY)")
def sweep_expire(spark, sf_dir):
    return b.sweep(frame(spark, "bus", sf_dir), NOW).select("id", "state")


@query("deliverable", f"WITH {STATES} SELECT id FROM s WHERE state = 'queued' AND EXISTS (SELECT 1 FROM accepts a WHERE a.owner = s.recipient AND a.sender = s.sender)")
def deliverable(spark, sf_dir):
    return b.deliverable(frame(spark, "bus", sf_dir), frame(spark, "accepts", sf_dir), NOW).select("id")


@query("accept_rehold", f"WITH {cte('bus', 'accepts')}, j AS (SELECT b.*, EXISTS (SELECT 1 FROM accepts a WHERE a.owner = b.recipient AND a.sender = b.sender) AS ok FROM bus b) SELECT id, CASE WHEN state = 'held' AND ok THEN 'queued' WHEN state = 'queued' AND NOT ok THEN 'held' ELSE state END AS state FROM j")
def accept_rehold(spark, sf_dir):
    return b.held_or_released(frame(spark, "bus", sf_dir), frame(spark, "accepts", sf_dir)).select("id", "state")
