"""Small deterministic tables for what the driver's tables lack, as DataFrames and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.plans.derived import RULES, Dialect

#: name: (Spark schema, rows). Values are strings, numbers, booleans, None or lists of strings; timestamps are strings of type TIMESTAMP.
TABLES: dict[str, tuple[str, list[tuple]]] = {}


def table(name: str, schema: str, rows: list[tuple]) -> None:
    TABLES[name] = (schema, rows)


def _columns(schema: str) -> list[tuple[str, str]]:
    return [tuple(part.strip().split(" ", 1)) for part in schema.split(",")]


def _literal(value, kind: str, spark: bool) -> str:
    kind = kind.upper()
    sql_kind = {"STRING": "STRING" if spark else "VARCHAR", "LONG": "BIGINT", "ARRAY<STRING>": "ARRAY<STRING>" if spark else "VARCHAR[]"}.get(kind, kind)
    if value is None:
        return f"CAST(NULL AS {sql_kind})"
    if isinstance(value, list):
        items = ", ".join(_literal(v, "STRING", spark) for v in value)
        return f"CAST(array({items}) AS {sql_kind})" if spark else f"CAST([{items}] AS {sql_kind})"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, str):
        text = value.replace("'", "''")
        if spark:
            text = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
        return f"CAST('{text}' AS {sql_kind})"
    return f"CAST({value} AS {sql_kind})"


def frame(spark: SparkSession, name: str, sf_dir: str | None = None) -> DataFrame:
    """The hand-made rows and, given the folder of the driver's tables, those that are derived from them."""
    schema, rows = TABLES[name]
    columns = _columns(schema)
    select = [", ".join(f"{_literal(v, kind, True)} AS {c}" for v, (c, kind) in zip(row, columns, strict=True)) for row in rows]
    hand = spark.sql(" UNION ALL ".join(f"SELECT {s}" for s in select))
    if sf_dir is None or name not in RULES:
        return hand
    return hand.unionByName(spark.sql(RULES[name](Dialect(sf_dir))))


def cte(*names: str, derived: bool = True) -> str:
    """``name AS (...)`` for each, to put after WITH."""
    out = []
    for name in names:
        schema, rows = TABLES[name]
        columns = _columns(schema)
        select = ["SELECT " + ", ".join(f"{_literal(v, kind, False)} AS {c}" for v, (c, kind) in zip(row, columns, strict=True)) for row in rows]
        if derived and name in RULES:
            select.append(f"SELECT {', '.join(c for c, _ in columns)} FROM ({RULES[name](Dialect())}) AS derived")
        out.append(f"{name} AS ({' UNION ALL '.join(select)})")
    return ", ".join(out)


table("messages", "id STRING, conversation_id STRING, session_id STRING, native_id STRING, part INT, ordinal LONG, kind STRING, tool_name STRING, tool_call_id STRING, is_error BOOLEAN, ts TIMESTAMP, text STRING, superseded BOOLEAN, on_active_path BOOLEAN, version INT, source_generation LONG, enrichment STRING", [
    ("m01", "c1", "s-alpha-1", "n1", 0, 4096, "user", None, None, None, "2026-01-01 10:00:00", "Fix the Parser for empty input files please", False, True, 1, 1, None),
    ("m02", "c1", "s-alpha-1", "n2", 0, 8192, "assistant", None, None, None, "2026-01-01 10:00:05", "I will look at the parser now.\nIt lives in src/parse.py", False, True, 1, 1, '{"message_id":"a1","usage":{"input_tokens":100,"output_tokens":10,"cache_read_input_tokens":5,"cache_creation_input_tokens":0}}'),
    ("m03", "c1", "s-alpha-1", "n3", 0, 12288, "tool_call", "Bash", "t1", None, "2026-01-01 10:00:09", '{"command":"git commit -m fix"}', False, True, 1, 1, '{"message_id":"a1","usage":{"input_tokens":100,"output_tokens":25,"cache_read_input_tokens":5,"cache_creation_input_tokens":0}}'),
    ("m04", "c1", "s-alpha-1", "n4", 0, 16384, "tool_result", "Bash", "t1", False, "2026-01-01 10:00:12", "[main abc1234] fix\n 1 file changed", False, True, 1, 1, None),
    ("m05", "c1", "s-alpha-1", "n5", 0, 20480, "tool_call", "Edit", "t2", None, "2026-01-01 10:01:00", '{"file_path":"/work/app/src/parse.py","old_string":"a","new_string":"b"}', False, True, 1, 1, None),
    ("m06", "c1", "s-alpha-1", "n6", 0, 24576, "tool_result", "Edit", "t2", True, "2026-01-01 10:01:02", "error: no such file", False, True, 1, 1, None),
    ("m07", "c1", "s-alpha-1", "n6", 1, 24577, "tool_result", "Edit", "t2", True, "2026-01-01 10:01:02", "error: no such file (again)", False, True, 1, 1, None),
    ("m08", "c1", "s-alpha-1", "n7", 0, 28672, "injected", None, None, None, "2026-01-01 10:01:03", "system reminder: parser", False, True, 1, 1, None),
    ("m09", "c1", "s-alpha-1", "n8", 0, 32768, "assistant", None, None, None, None, "Done: parser fixed, see https://github.com/acme/app/pull/42 and https://github.com/acme/app/issues/7", False, None, 1, 1, '{"message_id":"a2","usage":{"input_tokens":7,"output_tokens":3,"cache_read_input_tokens":0,"cache_creation_input_tokens":2}}'),
    ("m10", "c1", "s-alpha-1", "n9", 0, 36864, "assistant", None, None, None, "2026-01-01 10:02:00", "An abandoned branch about the parser", False, False, 1, 1, None),
    ("m11", "c1", "s-alpha-1", "n1", 0, 4096, "user", None, None, None, "2026-01-01 09:59:00", "Fix the Parser", True, True, 0, 0, None),
    ("m12", "c2", "s-beta-2", "n1", 0, 4096, "user", None, None, None, "2026-01-02 08:00:00", "continue", False, True, 1, 1, None),
    ("m13", "c2", "s-beta-2", "n2", 0, 8192, "user", None, None, None, "2026-01-02 08:00:30", "Write the migration guide for release two", False, True, 1, 1, None),
    ("m14", "c2", "s-beta-2", "n3", 0, 12288, "tool_call", "Write", "t9", None, "2026-01-02 08:01:00", '{"file_path":"/work/docs/guide.md","content":"x"}', False, True, 1, 1, None),
    ("m15", "c2", "s-beta-2", "n4", 0, 16384, "tool_call", "apply_patch", "t10", None, "2026-01-02 08:01:10", "*** Begin Patch\n*** Update File: docs/a.md\n*** Add File: docs/b.md\n*** End Patch", False, True, 1, 1, None),
    ("m16", "c2", "s-beta-2", "n5", 0, 20480, "assistant", None, None, None, "2026-01-02 08:02:00", "I will look at the parser now.\nIt lives in src/parse.py", False, True, 1, 1, None),
    ("m17", "c3", "s-beta-9", "n1", 0, 4096, "user", None, None, None, "2026-01-03 12:00:00", "[Request interrupted by user]", False, True, 1, 1, None),
    ("m18", "c3", "s-beta-9", "n2", 0, 8192, "thinking", None, None, None, "2026-01-03 12:00:10", "hmm parser", False, True, 1, 1, None),
    ("m19", "c3", "s-beta-9", "n3", 0, 12288, "agent_message", None, None, None, "2026-01-03 12:10:10", "parser parser PARSER", False, True, 1, 1, None),
    ("m20", "c4", "s-gamma", "n1", 0, 4096, "user", None, None, None, "2026-01-04 00:00:00", "hidden parser talk", False, True, 1, 1, None),
])

table("sessions", "id STRING, session_id STRING, parent_session_id STRING, parent_conversation_id STRING, spawned_by_native_id STRING, agent STRING, device_id STRING, user_id STRING, cwd STRING, repo_root STRING, remote STRING, title STRING, depth INT, branches ARRAY<STRING>, started_at TIMESTAMP, last_activity_at TIMESTAMP, hidden_at TIMESTAMP, hidden_rule STRING", [
    ("c1", "s-alpha-1", None, None, None, "claude", "d1", "u1", "/work/app/src", "/work/app", "github.com/acme/app", "Parser fix", 0, ["main", "fix/parser", "main"], "2026-01-01 10:00:00", "2026-01-01 10:02:00", None, None),
    ("c2", "s-beta-2", "s-alpha-1", None, "t1", "codex", "d1", "u1", "/work/docs", "/work/docs", "github.com/acme/docs", None, 1, ["main"], "2026-01-02 08:00:00", "2026-01-02 08:02:00", None, None),
    ("c3", "s-beta-9", "s-beta-2", None, None, "claude", "d2", "u2", "/home/x/app", "/home/x/app", "github.com/acme/app", "Thinking aloud", 2, [], "2026-01-03 12:00:00", "2026-01-03 12:10:10", None, None),
    ("c4", "s-gamma", None, None, None, "devin", "d2", "u2", "/secret/place", None, None, "Hidden one", 0, ["main"], "2026-01-04 00:00:00", "2026-01-04 00:00:00", "2026-01-05 00:00:00", "deny /secret/**"),
    ("c5", "s-loop-a", "s-loop-b", None, None, "claude", "d3", "u3", None, None, None, None, 1, [], None, None, None, None),
    ("c6", "s-loop-b", "s-loop-a", None, None, "claude", "d3", "u3", None, None, None, "100%_done [x]", 1, ["release/2"], None, "2026-01-01 00:00:00", None, None),
    ("c7", "s-orphan", "s-gone", None, None, "opencode", "d3", "u3", "/work/app2", "/work/app2", None, "Orphan", 1, ["Main"], "2026-01-06 00:00:00", "2026-01-06 01:00:00", None, None),
])

table("devices", "id STRING, name STRING, user_id STRING", [("d1", "laptop", "u1"), ("d2", "server", "u2"), ("d3", "tablet", "u3")])
table("users", "id STRING, email STRING", [("u1", "Ann@Example.org"), ("u2", "bob@example.org"), ("u3", "cy@example.org")])
table("rules", "mode STRING, pattern STRING, is_repo BOOLEAN, is_admin BOOLEAN, regex STRING", [
    ("deny", "/secret/**", False, True, "^/secret(/.*)?$"), ("allow", "/work/**", False, False, "^/work(/.*)?$"), ("local", "/work/docs", False, False, "^/work/docs(/.*)?$"),
    ("allow", "github.com/acme/*", True, False, "^github\\.com/acme/[^/]*(/.*)?$"), ("local", "github.com/acme/docs", True, True, "^github\\.com/acme/docs(/.*)?$"),
])
table("nodes", "session STRING, node LONG, parent LONG, is_leaf BOOLEAN", [("a", 1, None, False), ("a", 2, 1, False), ("a", 3, 2, True), ("a", 4, 2, False), ("b", 1, None, False), ("b", 2, 1, True), ("b", 3, 1, False)])
table("batch", "conversation_id STRING, native_id STRING, part INT, text STRING", [
    ("c1", "n1", 0, "Fix the Parser for empty input files please"), ("c1", "n2", 0, "I will look at the parser now.\nIt lives in src/parse.py and more"), ("c1", "n4", 0, "something else"), ("c1", "n77", 0, "a new row"), ("c9", "n1", 0, "a new conversation"),
])
table("presence", "session_id STRING, agent STRING, user_id STRING, repo STRING, remote STRING, busy BOOLEAN, enabled BOOLEAN, seen_at TIMESTAMP", [
    ("s1", "claude", "u1", "app", "github.com/acme/app", False, True, "2026-01-01 12:00:00"), ("s1", "claude", "u1", "app", "github.com/acme/app", True, True, "2026-01-01 12:00:30"),
    ("s2", "codex", "u1", "docs", "github.com/acme/docs", False, True, "2026-01-01 12:00:20"), ("s3", "claude", "u2", "app", "github.com/acme/app", False, True, "2026-01-01 12:00:31"),
    ("s4", "claude", "u2", "app", "github.com/other/app", False, True, "2026-01-01 11:58:00"), ("s5", "codex", "u3", "app", "github.com/other/app", True, False, "2026-01-01 12:00:32"), ("s6", "codex", "u3", "app", None, True, True, "2026-01-01 12:00:33"),
])
table("bus", "id STRING, thread_id STRING, retry_of STRING, sender STRING, recipient STRING, repo STRING, body STRING, state STRING, created_at TIMESTAMP, seq LONG", [
    ("b1", "b1", None, "u1", "u2", "app", "hello\nthere", "read", "2026-01-01 10:00:00", 1), ("b2", "b1", None, "u2", "u1", "app", "  \nre: hello", "delivered", "2026-01-01 10:05:00", 2),
    ("b3", "b3", None, "u3", "u1", "docs", "please review", "held", "2026-01-01 10:06:00", 3), ("b4", "b3", "b3", "u3", "u1", "docs", "please review again", "held", "2026-01-01 11:06:00", 4),
    ("b5", "b5", None, "u1", "u3", "app", "queued one", "queued", "2025-12-30 09:00:00", 5), ("b6", "b5", "b4", "u3", "u1", "docs", "third try", "expired", "2025-12-20 09:00:00", 6),
])
table("accepts", "owner STRING, sender STRING", [("u1", "u2"), ("u2", "u1")])
table("secrets", "id INT, line STRING", [
    (1, "AKIA" + "ABCDEFGH234567QR" + " is a key"), (2, "token = \"" + "0123456789abcdef" * 2 + "\""), (3, "ghp_" + "a1B2" * 9 + " end"), (4, "nothing to see here"), (5, "postgres://app:devpass@" + "localhost/db"),
    (6, "postgres://app:S3cr" + "etPw9@db.example.net/x"), (7, "password: changeme"), (8, "max_tokens = 4096"), (9, "SSH_PUBLIC_KEY=AAAAB3NzaC1yc2E"), (10, "Authorization: Bearer " + "abcDEF123456ghiJKL789"),
    (11, "glpat-" + "abcdefghij0123456789"), (12, "xAKIA" + "ABCDEFGH234567QR"), (13, "Cookie: sid=" + "a8f3k2l9q0z7x6"), (14, "api_key: getenv(KEY)"), (15, "SECRET=aaaaaaaaaaaaaaaa"),
])
table("parses", "source STRING, device STRING, generation LONG, requested LONG, parsed LONG, failures INT, quarantined BOOLEAN, requested_at TIMESTAMP, report STRING", [
    ("f1", "d1", 1, 3, 3, 0, False, "2026-01-01 00:00:00", '{"jwt":2,"assignment":1}'), ("f1", "d1", 2, 4, 4, 0, False, "2026-01-02 00:00:00", '{"jwt":3}'), ("f2", "d1", 1, 5, 2, 1, False, "2026-01-01 06:00:00", '{"assignment":4,"slack-token":0}'),
    ("f3", "d2", 1, 2, 1, 5, True, "2026-01-01 03:00:00", None), ("f4", "d2", 1, None, None, 0, False, None, "{}"),
])
table("chunks", "hash STRING, owner STRING, size LONG, stored LONG, tail STRING", [("h1", "u1", 100, 40, None), ("h2", "u1", 50, 50, "tail"), ("h3", "u2", 10, 9, "é"), ("h4", "u2", 10, 9, None)])
table("manifest", "source STRING, generation LONG, ordinal INT, hash STRING", [("f1", 1, 0, "h1"), ("f1", 1, 1, "h2"), ("f2", 1, 0, "h3")])
table("tombstones", "user_id STRING, session_id STRING", [("u2", "s-gamma")])
table("sources", "source STRING, previous STRING, tombstoned BOOLEAN, generation LONG, contract STRING", [("f1", None, False, 1, "v1"), ("f2", "f1", False, 2, "v2"), ("f3", "f4", False, 3, "v2"), ("f4", "f3", False, 4, None), ("f5", "f2", True, 5, "v2")])
table("credentials", "id STRING, kind STRING, expires_at TIMESTAMP, last_seen_at TIMESTAMP, revoked_at TIMESTAMP", [
    ("x1", "device", "2026-01-01 00:00:00", "2026-01-01 00:00:00", None), ("x2", "session", "2025-01-01 00:00:00", None, None), ("x3", "device", None, "2025-01-01 00:00:00", None), ("x4", "minted", "2025-01-01 00:00:00", None, "2025-06-01 00:00:00"),
])
table("policy_links", "session_id STRING, policy_session_id STRING", [("s-alpha-1", "s-policy"), ("s-policy", "s-far"), ("s-other", "s-else")])
