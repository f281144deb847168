"""Queries of digests, evidence, redaction, reports and streams."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators import digest as d, evidence as e, redact as r, reports as rp
from tallyloom.operators.merge import Snapshots
from tallyloom.plans.fixtures import cte, frame
from tallyloom.plans.registry import query
from tallyloom.sources import views as v
from tallyloom.sources.shared import shared_folder
from tallyloom.streaming import incremental as inc

LIVE = "NOT superseded AND coalesce(on_active_path, TRUE)"


@query("digest_counts", f"WITH {cte('messages')} SELECT conversation_id, kind, tool_name, count(*) AS n FROM messages WHERE {LIVE} GROUP BY ALL")
def digest_counts(spark, sf_dir):
    return d.counts(frame(spark, "messages", sf_dir))


@query("digest_failed_distinct", f"WITH {cte('messages')} SELECT conversation_id, count(DISTINCT CASE WHEN is_error THEN coalesce(tool_call_id, id) END) AS failed FROM messages WHERE {LIVE} GROUP BY conversation_id")
def digest_failed_distinct(spark, sf_dir):
    return d.failed(frame(spark, "messages", sf_dir))


@query("event_failures", "SELECT user_id::VARCHAR AS session_id, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) AS n FROM events GROUP BY user_id")
def event_failures(spark, sf_dir):
    return v.activity(spark, sf_dir).groupBy("session_id").agg(F.count(F.when(F.col("is_error"), 1)).alias("failed"), F.count("*").alias("n"))


@query("digest_tokens_dedup", f"""WITH {cte('messages')}, u AS (SELECT conversation_id, coalesce(enrichment->>'$.message_id', id) AS m, (enrichment->>'$.usage.input_tokens')::BIGINT AS i, (enrichment->>'$.usage.output_tokens')::BIGINT AS o, (enrichment->>'$.usage.cache_read_input_tokens')::BIGINT AS cr,
(enrichment->>'$.usage.cache_creation_input_tokens')::BIGINT AS cw, ordinal, id FROM messages WHERE NOT superseded AND enrichment->>'$.usage' IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY conversation_id, m ORDER BY o DESC, ordinal DESC, id DESC) AS k FROM u)
SELECT conversation_id, sum(i)::BIGINT AS input, sum(o)::BIGINT AS output, sum(cr)::BIGINT AS cache_read, sum(cw)::BIGINT AS cache_write FROM n WHERE k = 1 GROUP BY conversation_id""")  # fmt: skip
def digest_tokens_dedup(spark, sf_dir):
    return d.tokens(frame(spark, "messages", sf_dir))


def _weak(x: str) -> str:
    quoted = [p.replace("'", "''") for p in d.WEAK_PREFIXES]
    return f"(length({x}) < 20 OR {' OR '.join(f"starts_with(lower({x}), '{p}')" for p in quoted)})"


def _clipped(x: str, n: int) -> str:
    return f"CASE WHEN octet_length(encode({x})) <= {n} THEN {x} ELSE rtrim(left({x}, list_max(list_filter(range(0, {n + 1}), lambda k: octet_length(encode(left({x}, k::INT))) <= {n - 3}))::INT)) || '…' END"


@query("digest_intent_last", rf"""WITH {cte('messages', 'sessions')}, m AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS line FROM messages WHERE {LIVE}),
a AS (SELECT conversation_id, arg_min(line, (ordinal, id)) FILTER (WHERE prompt) AS first, arg_min(line, (ordinal, id)) FILTER (WHERE prompt AND NOT {_weak('line')}) AS strong, arg_max(line, (ordinal, id)) FILTER (WHERE kind = 'assistant' AND line <> '') AS reply
  FROM (SELECT *, kind = 'user' AND line <> '' AND NOT starts_with(line, '{d.NOISE}') AS prompt FROM m) p GROUP BY conversation_id),
c AS (SELECT conversation_id, CASE WHEN first IS NOT NULL AND NOT {_weak('first')} THEN first WHEN coalesce(title, '') <> '' AND NOT {_weak('title')} THEN title ELSE coalesce(strong, first) END AS intent, reply
  FROM a LEFT JOIN (SELECT id, trim(regexp_replace(title, '\s+', ' ', 'g')) AS title FROM sessions) s ON s.id = a.conversation_id)
SELECT conversation_id, {_clipped('intent', d.INTENT_BYTES)} AS intent, {_clipped('reply', d.LAST_BYTES)} AS last FROM c""")  # fmt: skip
def digest_intent_last(spark, sf_dir):
    return d.intents(frame(spark, "messages", sf_dir), frame(spark, "sessions", sf_dir))


@query("digest_files_edited", rf"""WITH {cte('messages', 'sessions')}, e AS (SELECT conversation_id, ordinal, id, CASE WHEN tool_name IN ('Edit', 'Write') THEN regexp_extract_all(text, '"file_path":"([^"]+)"', 1) ELSE regexp_extract_all(text, 'File: ([^\n]+)', 1) END AS paths
FROM messages WHERE kind = 'tool_call' AND tool_name IN ('Edit', 'Write', 'apply_patch') AND {LIVE}), p AS (SELECT conversation_id, ordinal, id, unnest(range(len(paths))) AS nth, unnest(paths) AS path FROM e),
f AS (SELECT p.conversation_id, CASE WHEN s.repo_root IS NOT NULL AND starts_with(path, s.repo_root || '/') THEN substr(path, length(s.repo_root) + 2) ELSE path END AS file, min((ordinal, p.id, nth)) AS pos FROM p LEFT JOIN sessions s ON s.id = p.conversation_id GROUP BY ALL),
n AS (SELECT conversation_id, list(file ORDER BY pos) AS files FROM f GROUP BY conversation_id) SELECT conversation_id, files[1:25] AS files, len(files) > 25 AS more FROM n""")  # fmt: skip
def digest_files_edited(spark, sf_dir):
    return d.edited_files(frame(spark, "messages", sf_dir), frame(spark, "sessions", sf_dir))


@query("digest_refs", f"""WITH {cte('messages')}, t AS (SELECT conversation_id, text FROM messages WHERE {LIVE} AND kind IN ('user', 'assistant'))
SELECT DISTINCT conversation_id, 'pull' AS kind, regexp_extract(x, 'com/([^/]+/[^/]+)/pull', 1) || '#' || regexp_extract(x, '([0-9]+)$', 1) AS ref FROM (SELECT conversation_id, unnest(regexp_extract_all(text, 'https://github\\.com/[\\w.-]+/[\\w.-]+/pull/[0-9]+')) AS x FROM t) a
UNION ALL SELECT DISTINCT conversation_id, 'issue', regexp_extract(x, 'com/([^/]+/[^/]+)/issues', 1) || '#' || regexp_extract(x, '([0-9]+)$', 1) FROM (SELECT conversation_id, unnest(regexp_extract_all(text, 'https://github\\.com/[\\w.-]+/[\\w.-]+/issues/[0-9]+')) AS x FROM t) a""")  # fmt: skip
def digest_refs(spark, sf_dir):
    return d.references(frame(spark, "messages", sf_dir))


@query("digest_duration", f"WITH {cte('messages')} SELECT conversation_id, min(ts) AS started_at, max(ts) AS last_activity_at, CASE WHEN max(ts) > min(ts) THEN floor(epoch(max(ts)) - epoch(min(ts)))::BIGINT END AS seconds FROM messages WHERE NOT superseded GROUP BY conversation_id")
def digest_duration(spark, sf_dir):
    return d.durations(frame(spark, "messages", sf_dir))


@query("user_spans", "SELECT user_id, min(ts) AS started_at, max(ts) AS last_activity_at, floor(epoch(max(ts)) - epoch(min(ts)))::BIGINT AS seconds FROM events GROUP BY user_id HAVING max(ts) > min(ts)")
def user_spans(spark, sf_dir):
    rows = v.table(spark, sf_dir, "events").select(F.col("user_id").alias("conversation_id"), "ts", F.lit(False).alias("superseded"))
    return d.durations(rows).where("seconds is not null").withColumnRenamed("conversation_id", "user_id")


@query("subagent_count", f"WITH {cte('sessions')} SELECT p.id, (SELECT count(*) FROM sessions k WHERE k.parent_session_id = p.session_id AND k.session_id <> p.session_id) AS subagents FROM sessions p")
def subagent_count(spark, sf_dir):
    return d.subagents(frame(spark, "sessions", sf_dir))


@query("coverage_filter_counts", f"""WITH {cte('parses')}, l AS (SELECT * FROM parses p WHERE generation = (SELECT max(generation) FROM parses q WHERE q.source = p.source)), x AS (SELECT *, coalesce(requested > coalesce(parsed, 0) AND NOT quarantined, FALSE) AS pending FROM l)
SELECT device, count(*) FILTER (WHERE requested IS NULL) AS untracked, count(*) FILTER (WHERE pending) AS pending, count(*) FILTER (WHERE pending AND failures > 0) AS failing, count(*) FILTER (WHERE quarantined) AS quarantined, min(requested_at) FILTER (WHERE pending) AS oldest_pending FROM x GROUP BY device""")  # fmt: skip
def coverage_filter_counts(spark, sf_dir):
    return rp.parse_coverage(frame(spark, "parses", sf_dir))


@query("json_map_sum", "SELECT 'k' AS key, sum((props->>'$.k')::BIGINT)::BIGINT AS n FROM events HAVING sum((props->>'$.k')::BIGINT) > 0")
def json_map_sum(spark, sf_dir):
    return rp.key_sums(v.table(spark, sf_dir, "events"), "props")


@query("redaction_status", f"WITH {cte('parses')}, l AS (SELECT * FROM parses p WHERE report IS NOT NULL AND generation = (SELECT max(generation) FROM parses q WHERE q.source = p.source)), k AS (SELECT unnest(json_keys(report)) AS key, report FROM l) SELECT key, sum((report->>key)::BIGINT)::BIGINT AS n FROM k GROUP BY key HAVING sum((report->>key)::BIGINT) > 0")
def redaction_status(spark, sf_dir):
    return rp.key_sums(rp.latest(frame(spark, "parses", sf_dir)))


@query("hidden_summary", f"WITH {cte('sessions')} SELECT user_id, hidden_rule, count(*) AS hidden, min(hidden_at) AS oldest FROM sessions WHERE hidden_at IS NOT NULL GROUP BY GROUPING SETS ((user_id, hidden_rule), (user_id), ())")
def hidden_summary(spark, sf_dir):
    return rp.hidden_summary(frame(spark, "sessions", sf_dir))


@query("storage_usage", f"WITH {cte('chunks')} SELECT owner, sum(stored)::BIGINT AS stored, coalesce(sum(octet_length(encode(tail))), 0)::BIGINT AS tails FROM chunks GROUP BY owner")
def storage_usage(spark, sf_dir):
    return rp.storage_usage(frame(spark, "chunks", sf_dir))


@query("orphan_chunks", f"WITH {cte('chunks', 'manifest')} SELECT hash FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM manifest m WHERE m.hash = c.hash)")
def orphan_chunks(spark, sf_dir):
    return rp.orphan_chunks(frame(spark, "chunks", sf_dir), frame(spark, "manifest", sf_dir)).select("hash")


@query("events_newest", "SELECT event_id, ts FROM events ORDER BY ts DESC NULLS LAST, event_id LIMIT 50")
def events_newest(spark, sf_dir):
    return rp.newest_events(v.table(spark, sf_dir, "events"), 50).select("event_id", "ts")


@query("quarantined_sources", f"WITH {cte('parses')} SELECT source FROM parses p WHERE quarantined AND generation = (SELECT max(generation) FROM parses q WHERE q.source = p.source)")
def quarantined_sources(spark, sf_dir):
    return rp.quarantined(frame(spark, "parses", sf_dir)).select("source")


#: What the calls that commit and their results show.
EVIDENCE = r"""evidence AS (SELECT c.conversation_id, regexp_extract(r.text, '\[[a-z]+ ([0-9a-f]{7,40})\] ', 1) AS hash, 'commit' AS operation, c.id AS command_id, r.id AS result_id, CASE WHEN r.is_error THEN 'failed' ELSE 'succeeded' END AS outcome
FROM messages c JOIN messages r ON r.conversation_id = c.conversation_id AND r.tool_call_id = c.tool_call_id AND r.kind = 'tool_result' AND NOT r.superseded
WHERE c.kind = 'tool_call' AND c.tool_name = 'Bash' AND NOT c.superseded AND c.text LIKE '%git commit%' AND regexp_extract(r.text, '\[[a-z]+ ([0-9a-f]{7,40})\] ', 1) <> '')"""


@query("commit_evidence", f"WITH {cte('messages')}, {EVIDENCE} SELECT conversation_id, hash, operation, command_id, result_id, outcome FROM evidence")
def commit_evidence(spark, sf_dir):
    return e.commit_evidence(frame(spark, "messages", sf_dir)).select("conversation_id", "hash", "operation", "command_id", "result_id", "outcome")


@query("trace_prefix_join", """WITH d AS (SELECT doc_id, n_chars, sha256(text) AS h FROM documents), ev AS (SELECT doc_id, left(h, 7 + (n_chars % 20)::INT) AS hash FROM d), w AS (SELECT DISTINCT h AS wanted FROM d)
SELECT wanted, doc_id FROM w JOIN ev ON starts_with(wanted, hash)""")  # fmt: skip
def trace_prefix_join(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("h"))
    observed = docs.select("doc_id", F.substring("h", F.lit(1), (7 + F.col("n_chars") % 20).cast("int")).alias("hash"))
    return e.trace_all(observed, docs.select(F.col("h").alias("wanted")).distinct()).select("wanted", "doc_id")


@query("redact_find_counts", f"SELECT * FROM (VALUES ('aws-access-key', 1), ('assignment', 1), ('github-token', 1), ('url-password', 1), ('auth-header', 1), ('gitlab-token', 1), ('cookie-header', 1)) t(rule, n)")
def redact_find_counts(spark, sf_dir):
    return r.redacted(frame(spark, "secrets"), ["id"], "line").where("rules != ''").select(F.explode(F.split("rules", ",")).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@query("redact_length_preserved", "SELECT doc_id, octet_length(encode(text))::INTEGER AS bytes, regexp_matches(text, '(?i)token = \"[0-9a-f]{40}\"') AS masked FROM documents")
def redact_length_preserved(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents")
    return r.redacted(docs, ["doc_id"]).select("doc_id", F.octet_length("text").alias("bytes"), F.array_contains(F.split("rules", ","), r.ASSIGNMENT).alias("masked"))


@query("secret_entropy", f"WITH {cte('secrets')}, c AS (SELECT id, unnest(string_split(line, '')) AS ch FROM secrets), f AS (SELECT id, ch, count(*) AS n FROM c GROUP BY id, ch), t AS (SELECT id, sum(n) AS total FROM f GROUP BY id) SELECT f.id, round(-sum(n / total * log2(n / total)), 6) AS bits FROM f JOIN t USING (id) GROUP BY f.id")
def secret_entropy(spark, sf_dir):
    return frame(spark, "secrets", sf_dir).select("id", F.round(T.entropy(F.col("line")), 6).alias("bits"))


@query("page_hosts", "SELECT lower(split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1)) AS host, count(*) AS n FROM pages GROUP BY 1")
def page_hosts(spark, sf_dir):
    return v.table(spark, sf_dir, "pages").groupBy(F.split(T.normal_remote(F.col("url")), "/")[0].alias("host")).agg(F.count("*").alias("n"))


@query("previews", "SELECT conv_id, turn, left(coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')[1], ''), 80) AS preview FROM conversations")
def previews(spark, sf_dir):
    return v.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.preview(F.col("text")).alias("preview"))


@query("stream_activity", "SELECT user_id, count(*) AS n, min(ts) AS started_at, max(ts) AS last_activity_at FROM events GROUP BY user_id")
def stream_activity(spark, sf_dir):
    """The events as a stream of micro-batches into snapshots, then the totals: the same as of the whole table."""
    folder = f"{shared_folder(spark)}/stream-{uuid4().hex}"
    whole = v.table(spark, sf_dir, "events")
    whole.repartition(3).write.parquet(f"{folder}/in")
    stream = inc.stream_of(spark, f"{folder}/in", whole.schema)
    table = inc.into_snapshots(stream, Snapshots(spark, f"{folder}/table"), f"{folder}/checkpoint", inc.merge_activity)
    return inc.activity_totals(table)


@query("daily_counts", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def daily_counts(spark, sf_dir):
    return inc.windowed_counts(v.table(spark, sf_dir, "events"))


@query("snapshot_swap", "SELECT r_regionkey, r_name FROM region")
def snapshot_swap(spark, sf_dir):
    """Two versions of a table; the reader pins the first."""
    snapshots = Snapshots(spark, f"{shared_folder(spark)}/swap-{uuid4().hex}")
    first = snapshots.commit(v.table(spark, sf_dir, "region"))
    snapshots.commit(v.table(spark, sf_dir, "region").where("r_regionkey < 2"))
    return snapshots.read(first)
