"""From log records to sessions, prompts and transcripts (ING-26..29, FN-18..26, FLT-21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as T

BLOCKS = "array<struct<type: string, text: string>>"
ROOT_SOURCES = ("cli", "vscode", "exec", "mcp")
LEAST_VERSION = (0, 93, 0)
PAIR_LINES = 4


def _at(path: str) -> Column:
    return F.get_json_object("raw", path)


def content_text(content: Column) -> Column:
    """Text of a content that is a string or an array of blocks: text blocks, a line each (FN-32)."""
    blocks = F.from_json(content, BLOCKS)
    texts = F.filter(blocks, lambda b: b["type"].isin("text", "input_text", "output_text"))
    return F.when(F.ltrim(content).startswith("["), F.array_join(F.transform(texts, lambda b: b["text"]), "\n")).otherwise(content)


def has_block(content: Column, kind: str) -> Column:
    return F.coalesce(F.exists(F.from_json(content, BLOCKS), lambda b: b["type"] == kind), F.lit(False))


def sessions_a(lines: DataFrame) -> DataFrame:
    """path, native_id, parent_native, forked_from, cwd, branch, repository, project, project_source, thread_kind of provider A's files, from the first session record."""
    meta = lines.filter(F.col("raw").contains('"session_meta"')).filter(_at("$.type") == "session_meta")
    first = Window.partitionBy("path").orderBy("line_no")
    m = meta.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    source = _at("$.payload.source")
    subagent = F.get_json_object(source, "$.subagent").isNotNull()
    versioned = T.version_at_least(_at("$.payload.cli_version"), LEAST_VERSION) & source.isin(*ROOT_SOURCES)
    kind = F.when(subagent | (_at("$.payload.thread_source") == "subagent"), "subagent").when((_at("$.payload.thread_source") == "user") | versioned, "root").otherwise("unknown")
    out = m.select(
        "path", F.coalesce(T.null_if_empty(_at("$.payload.session_id")), _at("$.payload.id")).alias("native_id"), _at("$.payload.parent_thread_id").alias("parent_native"), _at("$.payload.forked_from_id").alias("forked_from"),
        _at("$.payload.cwd").alias("cwd"), _at("$.payload.git.branch").alias("branch"), T.repository_name(_at("$.payload.git.repository_url")).alias("repository"), kind.alias("thread_kind"), F.sha2("raw", 256).alias("_first"),
    )
    project = T.project_of(F.col("repository"), F.col("cwd"))
    return out.withColumns({"project": project["project"], "project_source": project["source"], "identity": F.coalesce(F.concat(F.lit("native:"), T.null_if_empty(F.col("native_id"))), F.concat(F.lit("sha256:"), F.col("_first")))}).drop("_first")


def sessions_b(lines: DataFrame) -> DataFrame:
    """Provider B's sessions: the first directory and branch that their lines name, and what the path tells."""
    at = lambda p: F.get_json_object("raw", p)
    first = lines.groupBy("path").agg(*[F.min_by(at(f"$.{c}"), F.when(at(f"$.{c}").isNotNull(), F.col("line_no"))).alias(n) for c, n in (("cwd", "cwd"), ("gitBranch", "branch"))])
    facts, none = T.thread_facts(F.col("path")), F.lit(None).cast("string")
    project = T.project_of(none, F.col("cwd"))
    return first.select("path", facts["native_id"].alias("native_id"), facts["parent_id"].alias("parent_native"), none.alias("forked_from"), "cwd", "branch", none.alias("repository"), project["project"].alias("project"), project["source"].alias("project_source"), facts["thread_kind"].alias("thread_kind"))


def _finished(rows: DataFrame) -> DataFrame:
    """Cleaned text with its classification, kind, and whether it can be searched."""
    clean = rows.withColumn("text", T.clean(F.col("text"))).filter("text <> ''")
    c = clean.withColumn("classification", F.when(F.col("role") == "user", T.classification(F.col("text"))).otherwise("assistant"))
    c = c.withColumn("oversized", T.is_oversized(F.col("text")))
    c = c.withColumn("searchable", F.col("searchable") & ~F.col("oversized") & F.col("classification").isin("human", "assistant"))
    return c.withColumn("kind", T.prompt_kind(F.col("text"), F.col("role"), F.col("classification")))


def prompts_a(lines: DataFrame, assistant: bool = False) -> DataFrame:
    """path, line_no, ts, role, text, confirmed, searchable, classification, kind of provider A (ING-26).

    A user message is a confirmed prompt. A response item of the user is only metadata; one that a message of equal
    text and time follows within four lines is that message and no row of its own. Records after a session record of
    another id don't count.
    """
    raw_id = F.when(_at("$.type") == "session_meta", F.coalesce(T.null_if_empty(_at("$.payload.session_id")), _at("$.payload.id")))
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    r = lines.withColumns({"_id": raw_id, "_type": _at("$.type"), "_kind": _at("$.payload.type"), "ts": _at("$.timestamp")})
    r = r.withColumn("_same", (F.min("_id").over(w).eqNullSafe(F.max("_id").over(w)))).filter("_same")
    message = (F.col("_type") == "event_msg") & (F.col("_kind") == "user_message")
    item = (F.col("_type") == "response_item") & (F.col("_kind") == "message") & _at("$.payload.role").isin("user", *(["assistant"] if assistant else []))
    rows = r.filter(message | item).select(
        "path", "line_no", "ts", F.when(message, "user").otherwise(_at("$.payload.role")).alias("role"), F.when(message, _at("$.payload.message")).otherwise(content_text(_at("$.payload.content"))).alias("text"), message.alias("confirmed"),
    )
    rows = rows.withColumn("_hash", F.xxhash64(T.clean(F.col("text")), "role"))
    following = F.lead(F.struct("confirmed", "line_no", "ts")).over(Window.partitionBy("path", "_hash").orderBy("line_no"))
    twin = ~F.col("confirmed") & (F.col("role") == "user") & following["confirmed"] & (following["line_no"] - F.col("line_no") <= PAIR_LINES) & following["ts"].eqNullSafe(F.col("ts"))
    rows = rows.withColumn("_twin", F.coalesce(twin, F.lit(False))).filter("not _twin").drop("_twin", "_hash")
    return _finished(rows.withColumn("searchable", F.col("confirmed") | (F.col("role") == "assistant")))


def prompts_b(lines: DataFrame, assistant: bool = False) -> DataFrame:
    """path, line_no, ts, role, text, message_id, searchable, classification, kind of provider B (ING-27).

    Results of tools, meta and compacted records can't be searched; sidechain records count only in subagents' files.
    """
    role = F.coalesce(_at("$.message.role"), _at("$.type"))
    content = _at("$.message.content")
    flag = lambda p: F.coalesce(_at(p) == "true", F.lit(False))
    in_subagent = T.thread_facts(F.col("path"))["thread_kind"] == "subagent"
    r = lines.filter(_at("$.type").isin("user", *(["assistant"] if assistant else []))).filter(~flag("$.isSidechain") | in_subagent)
    rows = r.select("path", "line_no", _at("$.timestamp").alias("ts"), role.alias("role"), content_text(content).alias("text"), _at("$.uuid").alias("message_id"), (~has_block(content, "tool_result") & ~flag("$.isMeta") & ~flag("$.isCompactSummary")).alias("searchable"))
    return _finished(rows)


def exclusions(prompts: DataFrame) -> DataFrame:
    """Rows left out of searches by classification and reason (ING-28)."""
    reason = F.when(F.col("oversized"), "oversized").when(~F.col("classification").isin("human", "assistant"), "wrapper").otherwise("metadata")
    return prompts.filter("not searchable").groupBy("classification", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def transcript_a(lines: DataFrame) -> DataFrame:
    """Provider-neutral records of provider A: kind, role, tool, call_id, text (ING-29)."""
    kind, t = _at("$.payload.type"), _at("$.type")
    item = t == "response_item"
    out = (
        F.when((t == "event_msg") & (kind == "user_message"), "message").when(item & (kind == "message"), "message")
        .when(item & kind.isin("function_call", "custom_tool_call", "local_shell_call"), "tool_call").when(item & kind.isin("function_call_output", "custom_tool_call_output"), "tool_result")
        .when(item & (kind == "reasoning"), "thinking").when(t.isin("session_meta", "turn_context"), "metadata").when(t == "event_msg", "system").otherwise("unrecognized")
    )
    text = F.coalesce(_at("$.payload.message"), _at("$.payload.arguments"), _at("$.payload.output"), content_text(_at("$.payload.content")), F.col("raw"))
    return lines.select("path", "line_no", _at("$.timestamp").alias("ts"), out.alias("kind"), F.coalesce(_at("$.payload.role"), F.when(out == "message", "user")).alias("role"), _at("$.payload.name").alias("tool"), _at("$.payload.call_id").alias("call_id"), text.alias("text"), F.col("path").alias("session_id"))


def transcript_b(lines: DataFrame) -> DataFrame:
    """Provider-neutral records of provider B, one a block: kind, role, tool, call_id, text (ING-29)."""
    content = _at("$.message.content")
    full = "array<struct<type: string, text: string, thinking: string, name: string, id: string, tool_use_id: string, content: string, input: string>>"
    blocks = F.when(F.ltrim(content).startswith("["), F.from_json(content, full)).otherwise(F.from_json(F.to_json(F.array(F.struct(F.lit("text").alias("type"), content.alias("text")))), full))
    rows = lines.filter(content.isNotNull()).select("path", "line_no", _at("$.timestamp").alias("ts"), F.coalesce(_at("$.message.role"), _at("$.type")).alias("role"), F.posexplode(blocks).alias("block_no", "b"))
    kind = F.when(F.col("b.type") == "text", "message").when(F.col("b.type") == "tool_use", "tool_call").when(F.col("b.type") == "tool_result", "tool_result").when(F.col("b.type") == "thinking", "thinking").otherwise("unrecognized")
    return rows.select("path", "line_no", "block_no", "ts", kind.alias("kind"), "role", F.col("b.name").alias("tool"), F.coalesce("b.id", "b.tool_use_id").alias("call_id"), F.coalesce("b.text", "b.thinking", "b.content", "b.input").alias("text"), F.col("path").alias("session_id"))
