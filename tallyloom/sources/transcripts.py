"""Session transcripts as message rows: JSON lines of two harnesses, and exported rows of two stores.

Lines are read as text and taken apart with Spark's JSON functions; one line gives a row for each content block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

MAX_PART = 4095


def lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no, byte_offset, byte_len and line of each line; an unfinished last line is a tail (is_tail)."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))
    split = files.select("path", F.posexplode(F.split("body", "\n")).alias("at", "line"), F.size(F.split("body", "\n")).alias("n"))
    before = W.partitionBy("path").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    rows = split.withColumn("byte_offset", F.coalesce(F.sum(F.octet_length("line") + 1).over(before), F.lit(0)).cast("long"))
    return rows.where("line != ''").select("path", (F.col("at") + 1).cast("long").alias("line_no"), "byte_offset", F.octet_length("line").cast("long").alias("byte_len"), "line", (F.col("at") + 1 == F.col("n")).alias("is_tail"))


def ordinal(line_no: Column, part: Column) -> Column:
    return F.shiftleft(line_no, 12).bitwiseOR(F.least(part, F.lit(MAX_PART)).cast("long"))


def _j(c: str, path: str) -> Column:
    return F.get_json_object(c, path)


BLOCKS = "array<struct<type:string,text:string,thinking:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean>>"


def claude(rows: DataFrame) -> DataFrame:
    """Messages of the first harness: records of type user, assistant and system; content a string or blocks."""
    typed = rows.withColumn("type", _j("line", "$.type")).where(F.col("type").isin("user", "assistant", "system"))
    content = F.coalesce(_j("line", "$.message.content"), _j("line", "$.content"))
    blocks = F.when(content.startswith("["), F.from_json(content, BLOCKS)).otherwise(F.from_json(F.to_json(F.array(F.struct(F.lit("text").alias("type"), content.alias("text")))), BLOCKS))
    parts = typed.select("*", F.posexplode(blocks).alias("part", "b"))
    inner = F.when(F.col("b.content").startswith("["), F.array_join(F.transform(F.from_json("b.content", "array<struct<text:string>>"), lambda x: x["text"]), "\n")).otherwise(F.col("b.content"))
    meta = F.coalesce(_j("line", "$.isMeta") == "true", F.lit(False)) | F.coalesce(_j("line", "$.isCompactSummary") == "true", F.lit(False))
    kind = (
        F.when(F.col("b.type") == "tool_use", "tool_call").when(F.col("b.type") == "tool_result", "tool_result").when(F.col("b.type") == "thinking", "thinking").when(F.col("type") == "system", "system")
        .when(meta, "injected").when(F.col("b.type") == "text", F.col("type")).otherwise("unknown")
    )
    usage = F.when(_j("line", "$.message.usage").isNotNull(), F.to_json(F.struct(_j("line", "$.message.id").alias("message_id"), F.from_json(_j("line", "$.message.usage"), "map<string,string>").alias("usage"))))
    return parts.select(
        _j("line", "$.sessionId").alias("session_id"), F.concat(_j("line", "$.uuid"), F.when(F.col("part") > 0, F.concat(F.lit("#"), F.col("part").cast("string"))).otherwise("")).alias("native_id"), _j("line", "$.parentUuid").alias("parent_native_id"),
        F.col("part").cast("int").alias("part"), ordinal(F.col("line_no"), F.col("part")).alias("ordinal"), kind.alias("kind"), F.col("b.name").alias("tool_name"), F.coalesce("b.id", "b.tool_use_id").alias("tool_call_id"),
        F.when(F.col("b.type") == "tool_result", F.coalesce("b.is_error", F.lit(False))).alias("is_error"), F.try_to_timestamp(_j("line", "$.timestamp")).alias("ts"),
        F.coalesce("b.text", "b.thinking", "b.input", inner, F.lit("")).alias("text"), usage.alias("enrichment"), _j("line", "$.cwd").alias("cwd"), _j("line", "$.gitBranch").alias("branch"), "line_no", "byte_offset", "byte_len",
    )


def claude_attachments(rows: DataFrame) -> DataFrame:
    """Messages in attachments: prompts that a person queued (kind user) and what hooks added to the context (kind injected, one for each text)."""
    a = rows.where(_j("line", "$.type") == "attachment").withColumn("a", _j("line", "$.attachment"))
    meta = F.coalesce(_j("line", "$.isMeta") == "true", F.lit(False)) | F.coalesce(_j("a", "$.isMeta") == "true", F.lit(False))
    queued = (_j("a", "$.type") == "queued_command") & (_j("a", "$.commandMode") == "prompt") & ~meta
    hooks = (_j("a", "$.type") == "hook_additional_context") & ~F.coalesce(_j("line", "$.isMeta") == "true", F.lit(False))
    content = _j("a", "$.content")
    texts = F.when(queued, F.array(_j("a", "$.prompt"))).when(hooks, F.when(content.startswith("["), F.from_json(content, "array<string>")).otherwise(F.array(content)))
    parts = a.withColumn("kind", F.when(queued, "user").when(hooks, "injected")).where("kind is not null").select("*", F.posexplode(texts).alias("part", "text")).where("text != ''")
    enrichment = F.when(F.col("kind") == "injected", F.to_json(F.struct(F.lit(True).alias("hook_context")))).otherwise(F.to_json(F.struct(F.lit(True).alias("queued_command"))))
    return parts.select(
        _j("line", "$.sessionId").alias("session_id"), F.concat(_j("line", "$.uuid"), F.when(F.col("part") > 0, F.concat(F.lit("#"), F.col("part").cast("string"))).otherwise("")).alias("native_id"), F.col("part").cast("int").alias("part"),
        ordinal(F.col("line_no"), F.col("part")).alias("ordinal"), "kind", F.try_to_timestamp(_j("line", "$.timestamp")).alias("ts"), "text", enrichment.alias("enrichment"), "line_no", "byte_offset", "byte_len",
    )


def hook_context(agent: Column, kind: Column, role: Column, enrichment: Column) -> Column:
    """Whether a message is context that hooks added. What an agent or a person wrote never is, whatever its text."""
    marked = F.coalesce(F.get_json_object(enrichment, "$.hook_context").isNotNull(), F.lit(False))
    return F.coalesce(F.when(agent.isin("claude", "opencode"), marked & (kind == "injected")).when(agent == "codex", marked & (kind == "system")).when(agent == "devin", (kind == "system") & (role == "system")), F.lit(False))


def foreign_index(rows: DataFrame) -> DataFrame:
    """Messages of an exported index of another tool: lines of version 1 that hold a conversation (the first line) or one of its messages.
    A file is taken whole or not at all: one bad line, or a message of another session, leaves it out."""
    r = rows.withColumn("c", _j("line", "$.conversation")).withColumn("m", _j("line", "$.message")).withColumn("v", _j("line", "$.version"))
    head = r.where("c is not null").groupBy("path").agg(F.min_by(_j("c", "$.session_id"), "line_no").alias("session_id"), F.min("line_no").alias("at"), F.count("*").alias("heads"))
    first = r.groupBy("path").agg(F.min("line_no").alias("first"))
    bad = F.coalesce(F.col("v") != "1", F.lit(True)) | (F.col("c").isNull() == F.col("m").isNull())
    met = r.join(head, "path", "left").join(first, "path")
    wrong = met.where(bad | F.col("session_id").isNull() | (F.col("at") != F.col("first")) | (F.col("heads") != 1) | (F.col("m").isNotNull() & ~_j("m", "$.session_id").eqNullSafe(F.col("session_id")))).select("path").distinct()
    good = met.where("m is not null").join(wrong, "path", "left_anti")
    return good.select("path", "session_id", _j("m", "$.native_id").alias("native_id"), _j("m", "$.kind").alias("kind"), _j("m", "$.text").alias("text"), F.try_to_timestamp(_j("m", "$.ts")).alias("ts"), "line_no", "byte_offset", "byte_len")


def codex(rows: DataFrame) -> DataFrame:
    """Messages of the second harness: response items; the session is that of the file's session_meta line."""
    p = rows.withColumn("type", _j("line", "$.type")).withColumn("payload", _j("line", "$.payload"))
    meta = p.where("type = 'session_meta'").groupBy("path").agg(F.min_by(F.struct(_j("payload", "$.id").alias("session_id"), _j("payload", "$.cwd").alias("cwd")), "line_no").alias("m")).select(F.col("path").alias("mpath"), "m.*")
    item = p.where("type in ('response_item', 'compacted')").withColumn("kind_of", _j("payload", "$.type"))
    said = F.array_join(F.transform(F.from_json(_j("payload", "$.content"), "array<struct<text:string>>"), lambda x: x["text"]), "\n")
    kind = (
        F.when(F.col("type") == "compacted", "injected").when(F.col("kind_of") == "message", F.when(_j("payload", "$.role").isin("user", "assistant", "system"), _j("payload", "$.role")).otherwise("injected")).when(F.col("kind_of") == "reasoning", "thinking")
        .when(F.col("kind_of").isin("function_call", "custom_tool_call", "web_search_call", "tool_search_call", "image_generation_call"), "tool_call").when(F.col("kind_of").isin("function_call_output", "custom_tool_call_output", "tool_search_output"), "tool_result")
        .when(F.col("kind_of") == "agent_message", "agent_message").otherwise("unknown")
    )
    text = F.coalesce(said, _j("payload", "$.arguments"), _j("payload", "$.input"), _j("payload", "$.output"), _j("payload", "$.message"), F.array_join(F.transform(F.from_json(_j("payload", "$.summary"), "array<struct<text:string>>"), lambda x: x["text"]), "\n"), F.lit(""))
    out = item.join(meta, item.path == meta.mpath, "left")
    return out.select(
        "session_id", F.coalesce(_j("payload", "$.id"), F.concat(F.lit("line-"), F.col("line_no").cast("string"))).alias("native_id"), F.lit(None).cast("string").alias("parent_native_id"), F.lit(0).alias("part"),
        ordinal(F.col("line_no"), F.lit(0)).alias("ordinal"), kind.alias("kind"), _j("payload", "$.name").alias("tool_name"), _j("payload", "$.call_id").alias("tool_call_id"), F.lit(None).cast("boolean").alias("is_error"),
        F.try_to_timestamp(_j("line", "$.timestamp")).alias("ts"), text.alias("text"), F.lit(None).cast("string").alias("enrichment"), "cwd", F.lit(None).cast("string").alias("branch"), "line_no", "byte_offset", "byte_len",
    )


def devin_export(nodes: DataFrame) -> DataFrame:
    """Messages of an exported store: rows (session_id, node_id, parent_node_id, chat_message JSON, created_at)."""
    role = _j("chat_message", "$.role")
    kind = F.when(role.isin("user", "assistant", "system"), role).when(role == "tool", "tool_result").otherwise("unknown")
    return nodes.select("session_id", F.col("node_id").cast("string").alias("native_id"), F.col("parent_node_id").cast("string").alias("parent_native_id"), F.lit(0).alias("part"), F.shiftleft(F.col("node_id").cast("long"), 12).alias("ordinal"), kind.alias("kind"), F.coalesce(_j("chat_message", "$.content"), F.lit("")).alias("text"), F.timestamp_seconds("created_at").alias("ts"))


def opencode_export(parts: DataFrame) -> DataFrame:
    """Messages of an exported store: rows (session_id, message_id, part_id, role, data JSON, created_ms)."""
    type_ = _j("data", "$.type")
    kind = F.when(type_ == "text", F.col("role")).when(type_ == "reasoning", "thinking").when(type_ == "tool", "tool_call").otherwise("unknown")
    text = F.coalesce(_j("data", "$.text"), _j("data", "$.state.input"), F.lit(""))
    call = parts.select("session_id", F.col("part_id").alias("native_id"), F.col("message_id").alias("parent_native_id"), kind.alias("kind"), _j("data", "$.tool").alias("tool_name"), _j("data", "$.callID").alias("tool_call_id"), text.alias("text"), F.timestamp_millis("created_ms").alias("ts"))
    done = parts.where((type_ == "tool") & _j("data", "$.state.output").isNotNull())
    result = done.select("session_id", F.concat("part_id", F.lit("#out")).alias("native_id"), F.col("message_id").alias("parent_native_id"), F.lit("tool_result").alias("kind"), _j("data", "$.tool").alias("tool_name"), _j("data", "$.callID").alias("tool_call_id"), _j("data", "$.state.output").alias("text"), F.timestamp_millis("created_ms").alias("ts"))
    return call.unionByName(result)


def reassembled(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """source, generation and body (binary) from ordered chunks (hash, data)."""
    met = manifest.join(chunks.select("hash", "data"), "hash")
    parts = met.groupBy("source", "generation").agg(F.array_sort(F.collect_list(F.struct("ordinal", "data"))).alias("parts"))
    return parts.select("source", "generation", F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["data"])).alias("body"))


def raw_slice(bodies: DataFrame, offset: Column, length: Column) -> Column:
    return F.substring("body", offset + 1, length)


def diagnostics(rows: DataFrame) -> DataFrame:
    """code and locator of lines that are no JSON object, or lack a type."""
    bad = F.when(F.try_parse_json("line").isNull(), "malformed").when(_j("line", "$.type").isNull(), "untyped")
    return rows.select(bad.alias("code"), F.concat_ws(":", "path", F.col("line_no").cast("string")).alias("locator")).where("code is not null")
