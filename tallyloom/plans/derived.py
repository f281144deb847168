"""The model's tables as rules over the driver's tables, in SQL that Spark and DuckDB both run. They grow with the input and
meet the hand-made rows of `fixtures`, which hold the rare cases."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    """What Spark and DuckDB write differently."""

    folder: str | None = None  # None: DuckDB, which knows the tables by name

    def table(self, name: str) -> str:
        return f"parquet.`{self.folder}/{name}.parquet`" if self.folder else name

    def later(self, base: str, seconds: str) -> str:
        step = f"make_dt_interval(0, 0, 0, {seconds})" if self.folder else f"to_seconds({seconds})"
        return f"(CAST('{base}' AS TIMESTAMP) + {step})"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.folder else f"[{', '.join(items)}]"


RULES: dict[str, Callable[[Dialect], str]] = {}
C, T = "CAST(conv_id AS STRING)", "CAST(turn AS STRING)"
PAIR = "CAST(CAST(floor(turn / 4.0) AS BIGINT) AS STRING)"  # a call and its result
TOOL = "CASE WHEN (conv_id + floor(turn / 4.0)) % 3 = 0 THEN 'Edit' ELSE 'Bash' END"
TEXT = f"""CASE WHEN turn % 4 = 2 AND {TOOL} = 'Edit' THEN '{{"file_path":"/work/app' || CAST(conv_id % 3 AS STRING) || '/f' || CAST(conv_id % 9 AS STRING) || '.py","old_string":"a"}}'
WHEN turn % 4 = 2 THEN '{{"command":"git commit -m x"}}' WHEN turn % 4 = 3 AND {TOOL} = 'Bash' THEN '[main ' || substr(md5({C} || '-' || {T}), 1, 7) || '] x' ELSE text END"""
START = "2026-02-01 00:00:00"


def rule(name: str):
    def put(f):
        RULES[name] = f
        return f

    return put


@rule("messages")
def _messages(d: Dialect) -> str:
    usage = """'{"message_id":"a' || CAST(CAST(floor(turn / 2.0) AS BIGINT) AS STRING) || '","usage":{"input_tokens":' || CAST(length(text) AS STRING) || ',"output_tokens":' || CAST(turn AS STRING) || ',"cache_read_input_tokens":1,"cache_creation_input_tokens":0}}'"""
    return f"""SELECT 'g' || {C} || '-' || {T} AS id, 'gc' || {C} AS conversation_id, 'gs' || {C} AS session_id, 'n' || {T} AS native_id, CAST(0 AS INT) AS part, CAST(turn * 4096 AS BIGINT) AS ordinal,
CASE WHEN turn % 4 = 2 THEN 'tool_call' WHEN turn % 4 = 3 THEN 'tool_result' WHEN role = 'system' THEN 'injected' ELSE role END AS kind,
CASE WHEN turn % 4 IN (2, 3) THEN {TOOL} END AS tool_name, CASE WHEN turn % 4 IN (2, 3) THEN 't' || {C} || '-' || {PAIR} END AS tool_call_id,
CASE WHEN turn % 4 = 3 THEN conv_id % 5 = 0 END AS is_error, CASE WHEN turn % 7 <> 5 THEN {d.later(START, 'conv_id * 600 + turn * 7')} END AS ts, {TEXT} AS text,
(conv_id * 3 + turn) % 13 = 0 AS superseded, CASE WHEN turn % 4 <> 1 THEN (conv_id + turn) % 11 <> 0 END AS on_active_path,
CAST(CASE WHEN (conv_id * 3 + turn) % 13 = 0 THEN 0 ELSE 1 END AS INT) AS version, CAST(conv_id % 2 AS BIGINT) AS source_generation, CASE WHEN role = 'assistant' AND turn % 4 < 2 THEN {usage} END AS enrichment
FROM {d.table('conversations')} WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL"""


@rule("sessions")
def _sessions(d: Dialect) -> str:
    app = "CAST(conv_id % 3 AS STRING)"
    return f"""SELECT 'gc' || {C} AS id, 'gs' || {C} AS session_id, CASE WHEN conv_id % 10 <> 0 THEN 'gs' || CAST(CAST(floor(conv_id / 2.0) AS BIGINT) AS STRING) END AS parent_session_id, CASE WHEN conv_id % 4 > 1 AND conv_id % 10 <> 0 THEN 'gc' || CAST(CAST(floor(conv_id / 2.0) AS BIGINT) AS STRING) END AS parent_conversation_id,
CASE WHEN conv_id % 4 = 1 THEN 'n2' END AS spawned_by_native_id, CASE conv_id % 4 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' WHEN 2 THEN 'devin' ELSE 'opencode' END AS agent,
'd' || CAST(conv_id % 7 AS STRING) AS device_id, 'u' || CAST(conv_id % 5 AS STRING) AS user_id, CASE WHEN conv_id % 17 <> 16 THEN '/work/app' || {app} || '/src' END AS cwd,
CASE WHEN conv_id % 6 <> 5 THEN '/work/app' || {app} END AS repo_root, CASE WHEN conv_id % 5 <> 4 THEN 'github.com/acme/app' || {app} END AS remote, CASE WHEN conv_id % 3 <> 0 THEN 'Title ' || {C} END AS title,
CAST(CASE WHEN conv_id % 10 = 0 THEN 0 ELSE 1 + conv_id % 3 END AS INT) AS depth, CASE WHEN conv_id % 2 = 0 THEN {d.array("'main'", f"'fix/' || {C}")} ELSE {d.array("'Main'")} END AS branches,
{d.later(START, 'conv_id * 600')} AS started_at, {d.later(START, 'conv_id * 600 + hi * 7')} AS last_activity_at, CASE WHEN conv_id % 23 = 3 THEN {d.later(START, 'conv_id * 601')} END AS hidden_at, CASE WHEN conv_id % 23 = 3 THEN 'deny /work/**' END AS hidden_rule
FROM (SELECT conv_id, max(turn) AS hi FROM {d.table('conversations')} WHERE conv_id IS NOT NULL GROUP BY conv_id) c"""


@rule("nodes")
def _nodes(d: Dialect) -> str:
    return f"""SELECT 'gs' || {C} AS session, turn AS node, CASE WHEN turn = lo THEN NULL WHEN turn % 5 = 4 AND turn - 2 >= lo THEN turn - 2 ELSE turn - 1 END AS parent, turn = hi AS is_leaf
FROM (SELECT conv_id, turn, min(turn) OVER (PARTITION BY conv_id) AS lo, max(turn) OVER (PARTITION BY conv_id) AS hi FROM {d.table('conversations')} WHERE conv_id IS NOT NULL AND turn IS NOT NULL) c"""


@rule("devices")
def _devices(d: Dialect) -> str:
    n = "CAST(n_nationkey + 10 AS STRING)"
    return f"SELECT 'd' || {n} AS id, 'host' || {n} AS name, 'u' || {n} AS user_id FROM {d.table('nation')}"


@rule("users")
def _users(d: Dialect) -> str:
    n = "CAST(n_nationkey + 10 AS STRING)"
    return f"SELECT 'u' || {n} AS id, 'user' || {n} || '@example.org' AS email FROM {d.table('nation')}"


@rule("batch")
def _batch(d: Dialect) -> str:
    """Each row twice: sources deliver at least once."""
    one = f"SELECT 'gc' || {C} AS conversation_id, 'n' || {T} AS native_id, CAST(0 AS INT) AS part, CASE WHEN conv_id % 3 = 0 THEN {TEXT} WHEN conv_id % 3 = 1 THEN {TEXT} || ' and more' ELSE 'something else' END AS text FROM {d.table('conversations')} WHERE (conv_id + turn) % 4 = 0 AND text IS NOT NULL"
    return f"{one} UNION ALL {one}"


@rule("presence")
def _presence(d: Dialect) -> str:
    return f"""SELECT 'p' || CAST(user_id % 40 AS STRING) AS session_id, CASE WHEN user_id % 2 = 0 THEN 'claude' ELSE 'codex' END AS agent, 'u' || CAST(user_id % 5 AS STRING) AS user_id, 'app' || CAST(user_id % 2 AS STRING) AS repo,
CASE WHEN user_id % 8 <> 7 THEN 'github.com/acme/app' || CAST(user_id % 2 AS STRING) END AS remote, event_id % 2 = 0 AS busy, user_id % 40 <> 9 AS enabled, {d.later('2026-01-01 11:58:00', 'event_id % 150')} AS seen_at FROM {d.table('events')} WHERE user_id IS NOT NULL"""


@rule("bus")
def _bus(d: Dialect) -> str:
    k = "CAST(o_orderkey AS STRING)"
    return f"""SELECT 'o' || {k} AS id, 'o' || CAST(o_orderkey - o_orderkey % 4 AS STRING) AS thread_id, CASE WHEN o_orderkey % 4 = 3 THEN 'o' || CAST(o_orderkey - 1 AS STRING) END AS retry_of, 'u' || CAST(o_custkey % 6 AS STRING) AS sender,
'u' || CAST((o_custkey + o_orderkey) % 6 AS STRING) AS recipient, 'app' || CAST(o_orderkey % 3 AS STRING) AS repo, 'about order ' || {k} AS body,
CASE o_orderkey % 6 WHEN 0 THEN 'read' WHEN 1 THEN 'delivered' WHEN 2 THEN 'held' WHEN 3 THEN 'queued' WHEN 4 THEN 'refused' ELSE 'expired' END AS state, {d.later('2025-12-20 00:00:00', '(o_orderkey * 97) % 1080000')} AS created_at, CAST(o_orderkey + 100 AS BIGINT) AS seq FROM {d.table('orders')}"""


@rule("accepts")
def _accepts(d: Dialect) -> str:
    return f"SELECT DISTINCT 'u' || CAST(n_nationkey % 6 AS STRING) AS owner, 'u' || CAST((n_nationkey * 5 + 1) % 6 AS STRING) AS sender FROM {d.table('nation')} WHERE n_nationkey % 6 > 2"


@rule("parses")
def _parses(d: Dialect) -> str:
    k = "CAST(p_partkey AS STRING)"
    row = lambda g: f"""SELECT 'p' || {k} AS source, 'd' || CAST(p_partkey % 7 AS STRING) AS device, CAST({g} AS BIGINT) AS generation, CAST(CASE WHEN p_partkey % 6 <> 5 THEN p_size + {g} END AS BIGINT) AS requested,
CAST(CASE WHEN p_partkey % 4 <> 3 THEN 20 END AS BIGINT) AS parsed, CAST(p_partkey % 4 AS INT) AS failures, p_partkey % 11 = 0 AS quarantined, {d.later('2026-01-01 00:00:00', f'p_partkey * 60 + {g}')} AS requested_at,
CASE WHEN p_partkey % 5 <> 4 THEN '{{"jwt":' || CAST(p_size AS STRING) || ',"assignment":' || CAST(p_partkey % 3 AS STRING) || '}}' END AS report FROM {d.table('part')}"""  # noqa: E731
    return f"{row(1)} UNION ALL {row(2)} WHERE p_partkey % 3 = 0"


@rule("chunks")
def _chunks(d: Dialect) -> str:
    return f"SELECT md5('d' || CAST(doc_id AS STRING)) AS hash, 'u' || CAST(doc_id % 5 AS STRING) AS owner, CAST(n_chars AS BIGINT) AS size, CAST(floor(n_chars / 2.0) AS BIGINT) AS stored, CASE WHEN doc_id % 9 = 0 THEN substr(text, 1, 5) END AS tail FROM {d.table('documents')}"


@rule("manifest")
def _manifest(d: Dialect) -> str:
    return f"SELECT 'g' || CAST(doc_id % 50 AS STRING) AS source, CAST(1 AS BIGINT) AS generation, CAST(floor(doc_id / 50.0) AS INT) AS ordinal, md5('d' || CAST(doc_id AS STRING)) AS hash FROM {d.table('documents')} WHERE doc_id % 10 <> 0"


@rule("tombstones")
def _tombstones(d: Dialect) -> str:
    return f"SELECT DISTINCT 'u' || CAST(conv_id % 5 AS STRING) AS user_id, 'gs' || {C} AS session_id FROM {d.table('conversations')} WHERE conv_id % 29 = 7"


@rule("secrets")
def _secrets(d: Dialect) -> str:
    return f"SELECT CAST(doc_id + 100 AS INT) AS id, text AS line FROM {d.table('documents')} WHERE text <> ''"


@rule("sources")
def _sources(d: Dialect) -> str:
    k = "CAST(p_partkey AS STRING)"
    return f"SELECT 'p' || {k} AS source, CASE WHEN p_partkey % 3 = 0 THEN 'p' || CAST(p_partkey - 1 AS STRING) WHEN p_partkey % 12 = 5 THEN 'p' || CAST(p_partkey + 1 AS STRING) END AS previous, p_partkey % 10 = 0 AS tombstoned, CAST(p_size AS BIGINT) AS generation, 'v' || CAST(p_partkey % 3 AS STRING) AS contract FROM {d.table('part')}"


@rule("credentials")
def _credentials(d: Dialect) -> str:
    k = "CAST(c_custkey AS STRING)"
    return f"""SELECT 'k' || {k} AS id, CASE c_custkey % 3 WHEN 0 THEN 'device' WHEN 1 THEN 'session' ELSE 'minted' END AS kind, CASE WHEN c_custkey % 4 <> 0 THEN {d.later('2026-01-01 00:00:00', '(c_custkey % 20) * 86400')} END AS expires_at,
{d.later('2025-09-01 00:00:00', '(c_custkey % 150) * 86400')} AS last_seen_at, CASE WHEN c_custkey % 7 = 0 THEN {d.later('2026-01-01 00:00:00', 'c_custkey % 100')} END AS revoked_at FROM {d.table('customer')}"""


@rule("policy_links")
def _policy_links(d: Dialect) -> str:
    return f"SELECT DISTINCT 'gs' || {C} AS session_id, 'gs' || CAST(conv_id + 5 AS STRING) AS policy_session_id FROM {d.table('conversations')} WHERE conv_id % 8 = 3"
