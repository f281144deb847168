import json

from pyspark.sql import functions as F

from tallyloom.operators import lifecycle as lc, policy
from tallyloom.operators.digest import digests
from tallyloom.plans.fixtures import frame
from tallyloom.sources import transcripts


def test_exports(spark):
    nodes = spark.createDataFrame([("s", 1, None, json.dumps({"role": "user", "content": "hi"}), 0), ("s", 2, 1, json.dumps({"role": "tool", "content": "out"}), 5)], "session_id string, node_id long, parent_node_id long, chat_message string, created_at long")
    assert [(r.kind, r.text, r.ordinal) for r in transcripts.devin_export(nodes).orderBy("ordinal").collect()] == [("user", "hi", 4096), ("tool_result", "out", 8192)]
    parts = spark.createDataFrame([("s", "m", "p1", "assistant", json.dumps({"type": "text", "text": "yo"}), 1), ("s", "m", "p2", "assistant", json.dumps({"type": "tool", "tool": "bash", "callID": "c", "state": {"input": {"command": "ls"}, "output": "a b"}}), 2)], "session_id string, message_id string, part_id string, role string, data string, created_ms long")
    assert sorted((r.native_id, r.kind, r.text) for r in transcripts.opencode_export(parts).collect()) == [("p1", "assistant", "yo"), ("p2", "tool_call", '{"command":"ls"}'), ("p2#out", "tool_result", "a b")]


def test_deletion_and_backup(spark):
    left, stones = lc.deleted(frame(spark, "sessions"), frame(spark, "tombstones"), "u1", "s-alpha-1")
    assert {r.id for r in left.collect()} == {"c3", "c4", "c5", "c6", "c7"} and stones.count() == 3
    chunks = spark.createDataFrame([("2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824", bytearray(b"hello")), ("00", bytearray(b"x"))], "hash string, data binary")
    assert [r.hash for r in lc.damaged(chunks).collect()] == ["00"]
    assert [r.hash for r in lc.not_held(chunks, chunks.where("hash = '00'")).collect()] == ["2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"]


def test_touched_digests_equal_all(spark):
    messages, sessions = frame(spark, "messages"), frame(spark, "sessions")
    whole = digests(messages, sessions)
    stale = whole.withColumn("messages", F.when(F.col("conversation_id") == "c1", 0).otherwise(F.col("messages")))
    key = lambda df: sorted(map(str, df.select("conversation_id", "messages", "failed", "intent", "files").collect()))
    assert key(lc.touched_digests(stale, messages.where("id = 'm02'"), messages, sessions)) == key(whole)


def test_small_operators(spark):
    spawned = lc.inferred_spawns(spark.createDataFrame([("k", '{"agent_id":"a9"}')], "id string, extra string"), spark.createDataFrame([("m2", "tool_result", '{"agent_id":"a9"}'), ("m1", "tool_result", '{"workflow_run_id":"a9"}')], "id string, kind string, enrichment string"))
    assert [tuple(r) for r in spawned.collect()] == [("k", "m1")]
    near = lc.nearest_names(spark.createDataFrame([("--sesion",)], "wanted string"), spark.createDataFrame([("--session",), ("--since",)], "name string"))
    assert [r.name for r in near.collect()] == ["--session"]
    assert lc.with_quarantine(frame(spark, "parses")).where("quarantined").count() == 1
    tails = spark.createDataFrame([("a", "2026-01-01 00:00:00"), ("b", "2026-01-01 00:04:00")], "source string, t string").select("source", F.col("t").cast("timestamp").alias("touched_at"))
    assert [r.source for r in lc.sealed(tails, "2026-01-01 00:05:00").collect()] == ["a"]
    listed = lc.device_list(frame(spark, "devices"), frame(spark, "users"), spark.createDataFrame([("d1", "2027-01-01"), ("d2", "2020-01-01")], "device_id string, e string").select("device_id", F.col("e").cast("timestamp").alias("expires_at")), "2026-01-01")
    assert {r.id: r.live for r in listed.collect()} == {"d1": True, "d2": False, "d3": False}


def test_hidden_sessions_follow_the_rules(spark):
    sessions = frame(spark, "sessions")
    hidden = policy.hidden_by(sessions, policy.decide(sessions, frame(spark, "rules")), "2026-02-01")
    assert [(r.id, r.hidden_rule) for r in hidden.where("hidden_at is not null").collect()] == [("c4", "/secret/**")]
    assert policy.to_purge(hidden, "2026-02-01").count() == 1 and policy.to_purge(hidden, "2026-01-06").count() == 0
    evidence = spark.createDataFrame([("k", "allow", "mapped"), ("k", "deny", "none"), ("j", "local", "unmapped")], "key string, mode string, mapping string")
    assert {r.key: (r.verdict, r.mapping) for r in policy.evidence_rollup(evidence).collect()} == {"k": ("deny", "mapped"), "j": ("local", "unmapped")}


def test_references_of_gh_commands(spark):
    from tallyloom.operators.digest import references

    url = "https://github.com/o/r/pull/5"
    rows = [("c", "1", 1, "tool_call", "Bash", "t1", None, '{"command":"gh pr create"}'), ("c", "2", 2, "tool_result", "Bash", "t1", False, url), ("c", "3", 3, "tool_call", "Bash", "t2", None, '{"command":"gh pr list"}'), ("c", "4", 4, "tool_result", "Bash", "t2", False, url + "6"), ("c", "5", 5, "tool_call", "Bash", "t3", None, '{"command":"gh pr view 7"}'), ("c", "6", 6, "tool_result", "Bash", "t3", True, url + "7")]
    df = spark.createDataFrame(rows, "conversation_id string, id string, ordinal long, kind string, tool_name string, tool_call_id string, is_error boolean, text string")
    df = df.withColumn("superseded", F.lit(False)).withColumn("on_active_path", F.lit(True)).withColumn("enrichment", F.lit(None).cast("string"))
    assert [(r.kind, r.ref) for r in references(df).collect()] == [("pull", "o/r#5")]


def test_line_windows(spark):
    from tallyloom.functions.text import line_range, line_window

    one = lambda n, b, a: spark.range(1).select(line_window(F.lit("a\nb\nc\nd"), F.lit(n), b, a)).first()[0]
    assert one(2, 1, 1) == "a\nb\nc" and one(1, 5, 0) == "a" and one(4, 0, 9) == "d"
    assert line_range("L3-L5") == (3, 5) and line_range("7") == (7, 7) and line_range("5-3") is None and line_range("x") is None
