"""Queries of hidden trees, placements, sources, credentials, routes, line caps and stored trigrams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators import bus as b, digest as d, filters as fl, governance as gv, grep as g, reports as rp
from tallyloom.plans.fixtures import cte, frame
from tallyloom.plans.registry import query
from tallyloom.plans.retrieval import CORPUS, THE_TION, file_state
from tallyloom.plans.summaries import EVIDENCE, LIVE
from tallyloom.sources import views as v
from tallyloom.sources.shared import shared_folder

BELOW = """up AS (SELECT c.id AS child, p.id AS parent FROM sessions c JOIN sessions p ON p.session_id = c.parent_session_id AND p.device_id IS NOT DISTINCT FROM c.device_id AND p.agent IS NOT DISTINCT FROM c.agent WHERE c.parent_conversation_id IS NULL
UNION ALL SELECT id, parent_conversation_id FROM sessions WHERE parent_conversation_id IS NOT NULL)"""
NOW = "2026-01-01 12:01:10"


@query("hidden_extension", f"WITH RECURSIVE {cte('sessions')}, {BELOW}, t AS (SELECT id FROM sessions WHERE hidden_at IS NOT NULL UNION SELECT up.child FROM up JOIN t ON t.id = up.parent) SELECT id FROM t WHERE id IN (SELECT id FROM sessions WHERE hidden_at IS NULL)")
def hidden_extension(spark, sf_dir):
    return gv.hidden_extension(frame(spark, "sessions", sf_dir))


@query("placement_keys", f"""WITH RECURSIVE {cte('sessions', 'policy_links')}, a AS (SELECT 's-beta-9' AS id UNION SELECT 'gs99' UNION SELECT s.parent_session_id FROM sessions s JOIN a ON a.id = s.session_id WHERE s.parent_session_id IS NOT NULL),
k AS (SELECT id FROM a UNION SELECT CASE WHEN l.session_id = k.id THEN l.policy_session_id ELSE l.session_id END FROM policy_links l JOIN k ON l.session_id = k.id OR l.policy_session_id = k.id) SELECT id FROM k""")  # fmt: skip
def placement_keys(spark, sf_dir):
    wanted = spark.createDataFrame([("s-beta-9",), ("gs99",)], "id string")
    return gv.placement_keys(frame(spark, "sessions", sf_dir), frame(spark, "policy_links", sf_dir), wanted).select("id")


@query("late_sources", f"WITH {cte('sources')} SELECT o.source, max(n.generation) AS generation FROM sources o JOIN sources n ON n.previous = o.source AND NOT n.tombstoned WHERE n.source IS DISTINCT FROM o.previous GROUP BY o.source HAVING count(*) > 0")
def late_sources(spark, sf_dir):
    return gv.late_sources(frame(spark, "sources", sf_dir))


@query("parse_again", f"WITH {cte('sources')} SELECT source FROM sources WHERE contract IS DISTINCT FROM 'v2'")
def parse_again(spark, sf_dir):
    return gv.to_parse_again(frame(spark, "sources", sf_dir), "v2")


@query("ended_credentials", f"""WITH {cte('credentials')} SELECT id, CASE WHEN kind <> 'session' AND expires_at <= TIMESTAMP '{NOW}' THEN 'expired' ELSE 'idle' END AS reason FROM credentials WHERE revoked_at IS NULL
AND (coalesce(kind <> 'session' AND expires_at <= TIMESTAMP '{NOW}', FALSE) OR coalesce(kind = 'device' AND last_seen_at <= TIMESTAMP '{NOW}' - INTERVAL 90 DAY, FALSE))""")  # fmt: skip
def ended_credentials(spark, sf_dir):
    return gv.ended_credentials(frame(spark, "credentials", sf_dir), NOW)


@query("message_sources", f"WITH {cte('messages')} SELECT id, conversation_id, source_generation FROM messages WHERE superseded")
def message_sources(spark, sf_dir):
    rows = frame(spark, "messages", sf_dir)
    return gv.message_sources(rows, rows.where("superseded").select("id"))


@query("evidence_limits", f"WITH {cte('messages')} SELECT conversation_id, count(*) AS records, sum(octet_length(encode(text)))::BIGINT AS bytes, count(*) > 3 OR sum(octet_length(encode(text))) > 100000 AS limited FROM messages WHERE kind IN ('tool_call', 'tool_result') GROUP BY conversation_id")
def evidence_limits(spark, sf_dir):
    return gv.evidence_limits(frame(spark, "messages", sf_dir), 3, 100_000)


@query("event_timings", "SELECT event_type AS operation, count(*) AS n, round(sum(value), 4) AS total, max(value) AS longest FROM events GROUP BY event_type")
def event_timings(spark, sf_dir):
    return gv.operation_timings(v.table(spark, sf_dir, "events"), "event_type", "value").withColumn("total", F.round("total", 4))


@query("filter_self", f"WITH {cte('sessions')} SELECT id FROM sessions WHERE hidden_at IS NULL AND session_id = 'gs7' AND user_id = 'u2'")
def filter_self(spark, sf_dir):
    return frame(spark, "sessions", sf_dir).where(fl.Filters(own_session="gs7", own_user="u2").session_predicate()).select("id")


@query("filter_held", f"""WITH {cte('sessions')}, h AS (SELECT * FROM sessions WHERE session_id IN ('gs8', 'gs9', 's-orphan') AND last_activity_at > TIMESTAMP '2026-02-01 01:40:00' - INTERVAL 1 HOUR)
SELECT id FROM sessions s WHERE NOT coalesce(last_activity_at > TIMESTAMP '2026-02-01 01:40:00' - INTERVAL 10 MINUTE, FALSE) AND id NOT IN (SELECT id FROM h) AND NOT EXISTS (SELECT 1 FROM h WHERE h.session_id = s.parent_session_id AND h.device_id = s.device_id)""")  # fmt: skip
def filter_held(spark, sf_dir):
    return fl.without_live(frame(spark, "sessions", sf_dir), "2026-02-01 01:40:00", ["gs8", "gs9", "s-orphan"]).select("id")


@query("extraction_summary", f"""WITH {cte('parses')}, k AS (SELECT report, len(list_filter(json_keys(coalesce(report, '{{}}')), lambda x: (report->>x)::BIGINT > 0)) > 0 AS has, len(list_filter(json_keys(coalesce(report, '{{}}')), lambda x: x <> 'assignment' AND (report->>x)::BIGINT > 0)) > 0 AS warns,
len(list_filter(json_keys(coalesce(report, '{{}}')), lambda x: x = 'assignment' AND (report->>x)::BIGINT > 0)) > 0 AS tells FROM parses)
SELECT count(report) AS assessed, count(*) - count(report) AS unassessed, count(*) FILTER (WHERE has) AS affected, count(*) FILTER (WHERE warns) AS warning, count(*) FILTER (WHERE tells) AS info FROM k""")  # fmt: skip
def extraction_summary(spark, sf_dir):
    return rp.extraction_summary(frame(spark, "parses", sf_dir), ("assignment",))


@query("resolved_routes", f"""WITH {cte('presence')}, l AS (SELECT DISTINCT session_id, agent, user_id, arg_max(repo, (seen_at, busy)) OVER w AS repo, arg_max(coalesce(remote, ''), (seen_at, busy)) OVER w AS remote FROM presence WHERE enabled AND seen_at > TIMESTAMP '{NOW}' - INTERVAL 75 SECOND WINDOW w AS (PARTITION BY session_id, agent, user_id)),
o AS (SELECT * FROM l WHERE lower(split_part(coalesce(nullif(remote, ''), repo), '/', -1)) = 'app'), s AS (SELECT user_id, list_sort(list(DISTINCT remote) FILTER (WHERE remote <> '')) AS remotes, list_sort(list(DISTINCT repo) FILTER (WHERE remote = '')) AS bare FROM o GROUP BY user_id),
n AS (SELECT *, coalesce(len(remotes), 0) AS r, coalesce(len(bare), 0) AS m FROM s)
SELECT user_id, CASE WHEN r = 1 AND m = 0 THEN remotes[1] WHEN NOT (r > 0 AND r + m > 1) THEN 'app' END AS route, CASE WHEN r > 0 AND r + m > 1 THEN array_to_string(list_concat(coalesce(remotes, []), list_transform(coalesce(bare, []), lambda x: x || ' (no remote)')), '; ') END AS ambiguous FROM n""")  # fmt: skip
def resolved_routes(spark, sf_dir):
    return b.resolved_routes(frame(spark, "presence", sf_dir), NOW, "app")


@query("swept_presence", f"WITH {cte('presence')} SELECT session_id, count(*) AS n FROM presence WHERE seen_at > TIMESTAMP '{NOW}' - INTERVAL 2 HOUR GROUP BY session_id")
def swept_presence(spark, sf_dir):
    return b.swept_presence(frame(spark, "presence", sf_dir), NOW, 2).groupBy("session_id").agg(F.count("*").alias("n"))


@query("coalesced_refusals", f"WITH {cte('bus')} SELECT sender, date_trunc('hour', created_at) AS since, count(*) AS n FROM bus WHERE state = 'refused' GROUP BY ALL")
def coalesced_refusals(spark, sf_dir):
    return b.coalesced_refusals(frame(spark, "bus", sf_dir))


@query("moved_messages", f"WITH {cte('bus')} SELECT id, CASE WHEN state = 'queued' AND seq % 3 = 0 THEN 'read' WHEN state = 'queued' AND seq % 3 = 1 THEN 'delivered' WHEN state = 'delivered' THEN 'read' ELSE state END AS state FROM bus")
def moved_messages(spark, sf_dir):
    rows = frame(spark, "bus", sf_dir)
    named = F.when(F.col("seq") % 3 == 2, F.array(F.lit("ack"), F.lit("read"))).when(F.col("seq") % 3 == 1, F.when(F.col("state") == "queued", F.array(F.lit("read"), F.lit("claim"), F.lit("ack"))).otherwise(F.array(F.lit("read")))).otherwise(F.array(F.lit("claim"), F.lit("ack"), F.lit("claim"), F.lit("read")))
    return b.moved(rows, rows.select("id", F.posexplode(named).alias("at", "event"))).select("id", "state")


@query("grep_shown_lines", f"""WITH {CORPUS}, l AS (SELECT id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS t FROM corpus WHERE regexp_matches(text, 'th[a-z]+tion')),
m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line) AS k, count(*) OVER (PARTITION BY id) AS n FROM l WHERE regexp_matches(t, 'th[a-z]+tion')) SELECT id, line::INTEGER AS line, greatest(n - 2, 0) AS more FROM m WHERE k <= 2""")  # fmt: skip
def grep_shown_lines(spark, sf_dir):
    return g.shown_lines(g.found(v.corpus(spark, sf_dir), THE_TION), THE_TION, most=2).select("id", "line", "more")


@query("grep_rank_newest", f"WITH {CORPUS}, h AS (SELECT id, content_sha, least(len(regexp_extract_all(text, 'th[a-z]+tion')), 1000) AS matches FROM corpus WHERE regexp_matches(text, 'th[a-z]+tion') ORDER BY id LIMIT 40), c AS (SELECT min(id) AS id, matches FROM h GROUP BY content_sha, matches) SELECT id, matches FROM c ORDER BY matches DESC, id LIMIT 10")
def grep_rank_newest(spark, sf_dir):
    return g.page(v.corpus(spark, sf_dir), THE_TION, order="relevance", limit=10, rank_newest=40).select("id", "matches")


_trigrams: dict[tuple, object] = {}


@query("grep_indexed", f"WITH {CORPUS} SELECT id FROM corpus WHERE lower(text) LIKE '%apache license%' OR lower(text) LIKE '%mit license%'")
def grep_indexed(spark, sf_dir):
    from uuid import uuid4

    from tallyloom.operators.trigrams import TrigramIndex

    rows = v.corpus(spark, sf_dir)
    key = file_state(spark, rows)
    if key not in _trigrams:
        _trigrams[key] = TrigramIndex.build(rows, f"{shared_folder(spark)}/trigrams-{uuid4().hex}")
    return _trigrams[key].found(g.Pattern(("Apache License", "MIT License"), fixed=True, ignore_case=True)).select("id")


@query("branch_labels", f"""WITH {cte('sessions')} SELECT id, array_to_string(list_filter(list_transform(range(1, len(branches) + 1), lambda i: CASE WHEN i = 1 OR branches[i] IS DISTINCT FROM branches[i - 1] THEN branches[i] END), lambda x: x IS NOT NULL), '→') AS label FROM sessions""")
def branch_labels(spark, sf_dir):
    return frame(spark, "sessions", sf_dir).select("id", F.array_join(d.changes(F.col("branches")), "→").alias("label"))


@query("place_labels", f"WITH {cte('sessions')} SELECT id, regexp_replace(split_part(repo_root, '/', -1), '^\\.+', '') || CASE WHEN len(branches) > 0 THEN '@' || array_to_string(branches, '→') ELSE '' END AS label, len(branches) || CASE WHEN len(branches) = 1 THEN ' branch' ELSE ' branches' END AS n FROM sessions WHERE repo_root IS NOT NULL")
def place_labels(spark, sf_dir):
    rows = frame(spark, "sessions", sf_dir).where("repo_root is not null")
    return rows.select("id", T.place_label(F.col("repo_root"), F.col("branches")).alias("label"), T.plural(F.size("branches"), "branch", "branches").alias("n"))


@query("digest_commits", f"WITH {cte('messages')}, {EVIDENCE} SELECT e.conversation_id, list(hash ORDER BY m.ordinal) AS commits, FALSE AS more_commits FROM (SELECT conversation_id, hash, min(result_id) AS result_id FROM evidence GROUP BY ALL) e JOIN messages m ON m.id = e.result_id GROUP BY e.conversation_id")
def digest_commits(spark, sf_dir):
    return d.commits(frame(spark, "messages", sf_dir))


@query("session_digest", f"""WITH {cte('messages', 'sessions')}, {EVIDENCE}, m AS (SELECT * FROM messages WHERE {LIVE}),
n AS (SELECT conversation_id, count(*) AS messages, count(*) FILTER (WHERE kind = 'tool_call') AS calls, count(*) FILTER (WHERE kind = 'tool_call' AND lower(tool_name) = 'bash') AS commands, count(DISTINCT CASE WHEN is_error THEN coalesce(tool_call_id, id) END) AS failed FROM m GROUP BY conversation_id),
t AS (SELECT conversation_id, CASE WHEN max(ts) > min(ts) THEN floor(epoch(max(ts)) - epoch(min(ts)))::BIGINT END AS seconds FROM messages WHERE NOT superseded GROUP BY conversation_id),
c AS (SELECT e.conversation_id, list(hash ORDER BY o.ordinal) AS commits FROM (SELECT conversation_id, hash, min(result_id) AS result_id FROM evidence GROUP BY ALL) e JOIN messages o ON o.id = e.result_id GROUP BY e.conversation_id)
SELECT s.id AS conversation_id, n.messages, n.calls, n.commands, n.failed, t.seconds, c.commits, CASE WHEN coalesce(repo_root, remote) IS NOT NULL THEN list_filter([repo_root, remote], lambda x: x IS NOT NULL) WHEN cwd IS NOT NULL THEN [cwd] ELSE [] END AS repos,
  (SELECT count(*) FROM sessions k WHERE k.parent_session_id = s.session_id AND k.session_id <> s.session_id) AS subagents FROM sessions s LEFT JOIN n ON n.conversation_id = s.id LEFT JOIN t ON t.conversation_id = s.id LEFT JOIN c ON c.conversation_id = s.id""")  # fmt: skip
def session_digest(spark, sf_dir):
    return d.digests(frame(spark, "messages", sf_dir), frame(spark, "sessions", sf_dir)).select("conversation_id", "messages", "calls", "commands", "failed", "seconds", "commits", "repos", "subagents")
