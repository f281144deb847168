"""Session digests: one deterministic summary row for each session, as aggregates over its live messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyloom.functions.text import clip_bytes, one_line
from tallyloom.operators.filters import live, on_path

INTENT_BYTES, LAST_BYTES, MAX_FILES, MAX_REFS, MAX_COMMITS, MAX_REPOS = 120, 160, 25, 10, 20, 4

#: Beginnings of a prompt that don't say what a session is for.
WEAK_PREFIXES = (
    "continue", "go on", "go ahead", "keep going", "proceed", "resume", "carry on", "yes", "ok", "okay", "this session is being continued", "traceback", "panic:", "error", "fatal:", "fail", "exception",
    "```", "{", "[", "<", "$ ", "> ", "at ", "npm err", "diff --git", "--- ", "+++ ",
)
NOISE = "[Request interrupted"
#: Tools that run a shell command; arguments that name an edited file.
SHELL_TOOLS = ("bash", "exec_command", "shell", "local_shell", "shell_command", "container.exec", "run_command", "exec")
EDIT_ARGUMENTS = {"Edit": "file_path", "Write": "file_path", "MultiEdit": "file_path", "NotebookEdit": "notebook_path"}
#: Links to pull requests and issues, commits that git prints, files of a patch.
PULL = r"https://github\.com/([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)/pull/([0-9]+)"
ISSUE = r"https://github\.com/([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)/issues/([0-9]+)"
COMMIT = r"\[(?:detached HEAD|[^\]\s]+)(?: \([^)\n]*\))? ([0-9a-f]{7,40})\] "
GH = {"pull": r"\bgh\s+pr\s+(?:create|edit|merge|view|ready|comment|review|close|reopen)\b", "issue": r"\bgh\s+issue\s+(?:create|edit|view|comment|close|reopen)\b"}
PATCH_FILE = r"(?m)^\*\*\* (?:Add|Update|Delete) File: (.+)$|^\*\*\* Move to: (.+)$"


def counted(rows: DataFrame) -> DataFrame:
    """Rows that a digest counts: live and on the path, without rows that only carry evidence of a completed command."""
    evidence = F.coalesce(F.get_json_object("enrichment", "$.command_completion") == "true", F.lit(False)) & ~F.coalesce(F.get_json_object("enrichment", "$.completion_legacy") == "true", F.lit(False))
    return rows.where(live() & on_path() & ~evidence)


def counts(messages: DataFrame) -> DataFrame:
    """conversation_id, kind, tool_name, n."""
    return counted(messages).groupBy("conversation_id", "kind", "tool_name").agg(F.count("*").alias("n"))


def failed(messages: DataFrame) -> DataFrame:
    """conversation_id and failed: distinct calls with an error."""
    rows = counted(messages)
    return rows.groupBy("conversation_id").agg(F.count_distinct(F.when(F.col("is_error"), F.coalesce("tool_call_id", "id"))).alias("failed"))


def usage(text: Column) -> dict[str, Column]:
    part = lambda name: F.coalesce(F.get_json_object(text, f"$.usage.{name}").cast("long"), F.lit(0))
    return {"input": part("input_tokens"), "output": part("output_tokens"), "cache_read": part("cache_read_input_tokens"), "cache_write": part("cache_creation_input_tokens")}


def tokens(messages: DataFrame) -> DataFrame:
    """conversation_id, input, output, cache_read, cache_write: one row for each API message counts, that with the most output."""
    rows = messages.where(live() & F.col("enrichment").isNotNull() & F.get_json_object("enrichment", "$.usage").isNotNull())
    parts = usage(F.col("enrichment"))
    rows = rows.select("conversation_id", F.coalesce(F.get_json_object("enrichment", "$.message_id"), F.col("id")).alias("message"), F.struct(parts["output"].alias("output"), F.col("ordinal"), F.col("id"), *[c.alias(n) for n, c in parts.items() if n != "output"]).alias("u"))
    best = rows.groupBy("conversation_id", "message").agg(F.max("u").alias("u"))
    return best.groupBy("conversation_id").agg(*[F.sum(f"u.{n}").alias(n) for n in ("input", "output", "cache_read", "cache_write")])


def weak(text: Column) -> Column:
    low = F.lower(text)
    out = F.length(text) < 20
    for p in WEAK_PREFIXES:
        out = out | low.startswith(p)
    return out


def intents(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """conversation_id, intent and last: the first prompt that says something, and the last reply."""
    rows = counted(messages).withColumn("line", one_line(F.col("text")))
    prompt = (F.col("kind") == "user") & ~F.col("line").startswith(NOISE) & (F.col("line") != "")
    at = F.struct("ordinal", "id")
    reply = (F.col("kind") == "assistant") & (F.col("line") != "")
    own = rows.groupBy("conversation_id").agg(
        F.min_by(F.when(prompt, F.col("line")), F.when(prompt, at)).alias("first"), F.min_by(F.when(prompt & ~weak(F.col("line")), F.col("line")), F.when(prompt & ~weak(F.col("line")), at)).alias("strong"),
        F.max_by(F.when(reply, F.col("line")), F.when(reply, at)).alias("reply"),
    )
    titled = own.join(sessions.select(F.col("id").alias("conversation_id"), one_line(F.coalesce("title", F.lit(""))).alias("title")), "conversation_id", "left")
    chosen = F.when(F.col("first").isNotNull() & ~weak(F.col("first")), F.col("first")).when((F.col("title") != "") & ~weak(F.col("title")), F.col("title")).otherwise(F.coalesce("strong", "first"))
    return titled.select("conversation_id", clip_bytes(chosen, INTENT_BYTES).alias("intent"), clip_bytes(F.col("reply"), LAST_BYTES).alias("last"))


def edited_files(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """conversation_id, files (in order of first edit, the first MAX_FILES) and more."""
    calls = counted(messages).where("kind = 'tool_call'")
    argument = F.coalesce(*[F.when(F.col("tool_name") == tool, F.get_json_object("text", f"$.{key}")) for tool, key in EDIT_ARGUMENTS.items()])
    body = F.coalesce(F.get_json_object("text", "$.input"), F.get_json_object("text", "$.patch"), F.col("text"))
    patched = F.when(body.contains("*** Begin Patch"), F.transform(F.arrays_zip(F.regexp_extract_all(body, F.lit(PATCH_FILE), F.lit(1)).alias("a"), F.regexp_extract_all(body, F.lit(PATCH_FILE), F.lit(2)).alias("b")), lambda x: F.trim(F.concat(F.coalesce(x["a"], F.lit("")), F.coalesce(x["b"], F.lit(""))))))
    changed = F.from_json(F.get_json_object("enrichment", "$.changed_paths"), "array<string>")
    paths = F.when(F.col("tool_name").isin(*EDIT_ARGUMENTS), F.array_compact(F.array(argument))).otherwise(F.coalesce(changed, patched))
    rows = calls.select("conversation_id", "ordinal", "id", F.posexplode(paths).alias("nth", "path")).join(sessions.select(F.col("id").alias("conversation_id"), "repo_root"), "conversation_id", "left")
    clean = F.regexp_replace(F.regexp_replace(F.trim("path"), "/(?:\\./)+", "/"), "(?<=.)/+$", "")
    inside = F.when(F.col("repo_root").isNotNull() & clean.startswith(F.concat("repo_root", F.lit("/"))), F.substring(clean, F.length("repo_root") + 2, F.length(clean))).otherwise(clean)
    parts = F.split(inside, "/")
    short = F.when(inside.startswith("/") & (F.size(parts) > 5), F.concat(F.lit("…/"), F.array_join(F.slice(parts, -4, 4), "/"))).otherwise(inside)
    first = rows.select("conversation_id", short.alias("file"), F.struct("ordinal", "id", "nth").alias("at")).where("file != ''").groupBy("conversation_id", "file").agg(F.min("at").alias("at"))
    listed = first.groupBy("conversation_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "file"))), lambda x: x["file"]).alias("files"))
    return listed.select("conversation_id", F.slice("files", 1, MAX_FILES).alias("files"), (F.size("files") > MAX_FILES).alias("more"))


def references(messages: DataFrame) -> DataFrame:
    """conversation_id, kind (pull, issue), ref (owner/name#number) of links in prompts and replies, and in what
    succeeding gh commands of that kind print; the first MAX_REFS of each kind."""
    rows = counted(messages)
    said = rows.where(F.col("kind").isin("user", "assistant") & F.col("text").contains("github.com/")).select("conversation_id", "ordinal", "id", "text")
    calls = rows.where((F.col("kind") == "tool_call") & F.lower("tool_name").isin(*SHELL_TOOLS) & F.col("text").contains("gh ")).select("conversation_id", "tool_call_id", F.coalesce(F.get_json_object("text", "$.command"), F.get_json_object("text", "$.cmd"), F.col("text")).alias("command"))
    results = rows.where((F.col("kind") == "tool_result") & ~F.coalesce("is_error", F.lit(False)) & F.col("text").contains("github.com/"))
    printed = results.join(calls, ["conversation_id", "tool_call_id"])
    out = None
    for kind, pattern in (("pull", PULL), ("issue", ISSUE)):
        texts = said.unionByName(printed.where(F.col("command").rlike(GH[kind])).select(*said.columns))
        refs = F.transform(F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("b")), lambda x: F.concat(x["a"], F.lit("#"), x["b"]))
        own = texts.select("conversation_id", F.lit(kind).alias("kind"), "ordinal", "id", F.posexplode(refs).alias("nth", "ref"))
        out = own if out is None else out.unionByName(own)
    first = out.groupBy("conversation_id", "kind", "ref").agg(F.min(F.struct("ordinal", "id", "nth")).alias("at"))
    nth = F.row_number().over(W.partitionBy("conversation_id", "kind").orderBy("at"))
    return first.withColumn("__n", nth).where(F.col("__n") <= MAX_REFS).select("conversation_id", "kind", "ref")


def durations(messages: DataFrame) -> DataFrame:
    """conversation_id, started_at, last_activity_at and seconds (null unless the last is later)."""
    rows = messages.where(live()).groupBy("conversation_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_activity_at"))
    seconds = F.floor((F.unix_micros(F.col("last_activity_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1_000_000).cast("long")
    return rows.withColumn("seconds", F.when(F.col("last_activity_at") > F.col("started_at"), seconds))


def subagents(sessions: DataFrame) -> DataFrame:
    """id and subagents: sessions that name it as their parent, itself excepted."""
    children = sessions.where("parent_session_id != session_id").groupBy(F.col("parent_session_id").alias("session_id")).agg(F.count("*").alias("n"))
    return sessions.select("id", "session_id").join(children, "session_id", "left").select("id", F.coalesce("n", F.lit(0)).alias("subagents"))


def repos(sessions: DataFrame) -> DataFrame:
    """conversation_id, repos (the checkout and the remote, else the directory; at most MAX_REPOS) and branches (as they followed each other)."""
    known = F.array_distinct(F.filter(F.array("repo_root", "remote"), lambda r: r.isNotNull() & (r != "")))
    own = F.when(F.size(known) > 0, known).when(F.coalesce("cwd", F.lit("")) != "", F.array("cwd")).otherwise(F.array().cast("array<string>"))
    return sessions.select(F.col("id").alias("conversation_id"), F.slice(own, 1, MAX_REPOS).alias("repos"), changes(F.coalesce("branches", F.array().cast("array<string>"))).alias("branches"))


def changes(values: Column) -> Column:
    """An array without values that repeat the one before: a, a, b, a gives a, b, a."""
    return F.filter(values, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(values, i - 1)))


def directories(messages: DataFrame, column: str = "cwd") -> DataFrame:
    """conversation_id and the distinct values of a column in the order of their first occurrence."""
    first = messages.where(F.col(column).isNotNull()).groupBy("conversation_id", column).agg(F.min(F.struct("ordinal", "id")).alias("at"))
    return first.groupBy("conversation_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", column))), lambda x: x[column]).alias("directories"))


def commits(messages: DataFrame) -> DataFrame:
    """conversation_id, commits (hashes that results print, and those that a later command reveals, in order; the first MAX_COMMITS) and more_commits."""
    from tallyloom.operators.evidence import commit_evidence

    seen = commit_evidence(messages)
    at = messages.select(F.col("id").alias("result_id"), "ordinal")
    first = seen.join(at, "result_id").groupBy("conversation_id", "hash").agg(F.min(F.struct("ordinal", "result_id")).alias("at"))
    listed = first.groupBy("conversation_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "hash"))), lambda x: x["hash"]).alias("all"))
    return listed.select("conversation_id", F.slice("all", 1, MAX_COMMITS).alias("commits"), (F.size("all") > MAX_COMMITS).alias("more_commits"))


def digests(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row for each session with all of the above; recomputed for the sessions that a batch touches, and from masked rows after a redaction."""
    by_kind = counts(messages)
    call = F.col("kind") == "tool_call"
    totals = by_kind.groupBy("conversation_id").agg(
        F.sum("n").alias("messages"), F.sum(F.when(call, F.col("n")).otherwise(0)).alias("calls"), F.sum(F.when(call & F.lower("tool_name").isin(*SHELL_TOOLS), F.col("n")).otherwise(0)).alias("commands"),
    )
    tools = by_kind.where(call & F.col("tool_name").isNotNull()).groupBy("conversation_id", "tool_name").agg(F.sum("n").alias("n")).groupBy("conversation_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool_name", "n")))).alias("tools"))
    links = references(messages).groupBy("conversation_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("ref")))).alias(f"{k}s") for k in ("pull", "issue")])
    below = subagents(sessions).select(F.col("id").alias("conversation_id"), "subagents")
    out = sessions.select(F.col("id").alias("conversation_id"), "session_id", "cwd")
    for part in (totals, tools, failed(messages), tokens(messages), intents(messages, sessions), edited_files(messages, sessions), durations(messages), repos(sessions), links, commits(messages), below):
        out = out.join(part, "conversation_id", "left")
    return out
