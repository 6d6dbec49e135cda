"""Prompts, sessions and transcripts from records; reports; graphs; comparisons."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import attribution as A
from ledgerloom.operators import corpus as R
from ledgerloom.operators import graph as G
from ledgerloom.operators import history as Y
from ledgerloom.operators import vault as V
from ledgerloom.plans import bindings as B
from ledgerloom.plans import reports


def lines_of(spark, files):
    return spark.createDataFrame([(p, k, json.dumps(r) if not isinstance(r, str) else r) for p, records in files.items() for k, r in enumerate(records, 1)], "path string, line_no long, raw string")


def meta(sid, **more):
    return {"timestamp": "t0", "type": "session_meta", "payload": {"id": sid, "cwd": "/home/me/proj", "cli_version": "0.93.0", "source": "cli", "git": {"branch": "b", "repository_url": "git@h.com:t/Repo.git"}, **more}}


def said(text, ts="t1"):
    return {"timestamp": ts, "type": "event_msg", "payload": {"type": "user_message", "message": text}}


def item(text, role="user", ts="t1"):
    return {"timestamp": ts, "type": "response_item", "payload": {"type": "message", "role": role, "content": [{"type": "input_text", "text": text}]}}


def test_prompts_of_provider_a(spark):
    lines = lines_of(spark, {"f": [meta("s1"), item("hello "), said("hello\r\n"), item("alone"), item("late"), "x", "x", "x", "x", said("late"), item("answer", "assistant"), said("<heartbeat>x</heartbeat>"), meta("s2"), said("other session")], "g": [meta("s3", source={"subagent": "x"}, git=None, cwd="/tmp/q"), said("  ")]})
    got = Y.prompts_a(lines).orderBy("path", "line_no").collect()
    assert [(r.line_no, r.text, r.confirmed, r.searchable, r.kind) for r in got] == [(3, "hello", True, True, "human"), (4, "alone", False, False, "human"), (5, "late", False, False, "human"), (10, "late", True, True, "human"), (12, "<heartbeat>x</heartbeat>", True, True, "control")]
    assert "answer" in [r.text for r in Y.prompts_a(lines, assistant=True).filter("role = 'assistant'").collect()]
    s = {r.path: r for r in Y.sessions_a(lines).collect()}
    assert (s["f"].native_id, s["f"].repository, s["f"].project, s["f"].project_source, s["f"].thread_kind, s["f"].identity) == ("s1", "Repo", "repo", "git", "root", "native:s1")
    assert (s["g"].thread_kind, s["g"].project) == ("subagent", None)
    assert {(r.classification, r.reason): r.n for r in Y.exclusions(Y.prompts_a(lines)).collect()} == {("human", "metadata"): 2}


def test_prompts_of_provider_b(spark):
    user = lambda content, **more: {"type": "user", "uuid": "u", "timestamp": "t", "message": {"role": "user", "content": content}, **more}
    records = [user("plain"), user([{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]), user([{"type": "tool_result", "content": "r"}, {"type": "text", "text": "mixed"}]), user("<system-reminder>x</system-reminder>", isMeta=True), user("side", isSidechain=True), user("<b>xml</b> text")]
    lines = lines_of(spark, {"/r/projects/p/a.jsonl": records, "/r/projects/p/a/subagents/s.jsonl": [user("sub", isSidechain=True)]})
    got = Y.prompts_b(lines).orderBy("path", "line_no").collect()
    assert [(r.text, r.searchable) for r in got] == [("plain", True), ("a\nb", True), ("mixed", False), ("<system-reminder>x</system-reminder>", False), ("<b>xml</b> text", True), ("sub", True)]
    assert sorted(r.text for r in got if r.searchable) == ["<b>xml</b> text", "a\nb", "plain", "sub"]


def test_transcripts(spark):
    call = {"timestamp": "t", "type": "response_item", "payload": {"type": "function_call", "name": "ls", "call_id": "c", "arguments": "{}"}}
    out = {"timestamp": "t", "type": "response_item", "payload": {"type": "function_call_output", "call_id": "c", "output": "files"}}
    got = Y.transcript_a(lines_of(spark, {"f": [meta("s"), said("hi"), call, out, {"type": "response_item", "payload": {"type": "reasoning"}}, {"type": "odd"}]})).orderBy("line_no").collect()
    assert [r.kind for r in got] == ["metadata", "message", "tool_call", "tool_result", "thinking", "unrecognized"] and got[2].tool == "ls" and got[3].text == "files"
    b = [{"type": "assistant", "message": {"role": "assistant", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "name": "rm", "id": "i"}, {"type": "text", "text": "done"}]}}, {"type": "user", "message": {"role": "user", "content": "say \"x\""}}]
    got = Y.transcript_b(lines_of(spark, {"f": b})).orderBy("line_no", "block_no").collect()
    assert [(r.kind, r.text) for r in got] == [("thinking", "hm"), ("tool_call", None), ("message", "done"), ("message", 'say "x"')]


def test_tree_ends_at_cycles_and_depth(spark):
    links = spark.createDataFrame([(1, 2, 5), (1, 3, 4), (2, 4, 0), (4, 2, 0), (3, 5, 0), (5, 6, 0)], "parent long, child long, k int")
    roots = spark.createDataFrame([(1,)], "node long")
    assert [r.node for r in G.preorder(G.tree(links, roots, F.col("k"), 16)).orderBy("place").collect()] == [1, 3, 5, 6, 2, 4]
    assert {r.node for r in G.tree(links, roots, F.col("k"), 1).collect()} == {1, 2, 3}


def test_edges_wait_for_parents(spark):
    s = spark.createDataFrame([(1, "p", "n1", "root", None, None), (2, "p", "n2", "subagent", "n1", None), (3, "q", "n3", "subagent", "n1", None), (4, "p", "n4", "root", None, "n4")], "session_id long, provider string, native_id string, thread_kind string, parent_native string, forked_from string")
    assert {(r.child, r.kind): r.parent for r in G.resolve(G.edges(s), s).collect()} == {(2, "subagent"): 1, (3, "subagent"): None, (4, "fork"): None}


def test_comparisons(spark):
    a, b = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "k int, v int"), spark.createDataFrame([(2, 2), (3, 4), (4, 4)], "k int, v int")
    assert {r.k: r.state for r in A.differences(a, b, ["k"], "v").collect()} == {1: "missing", 2: "equal", 3: "different", 4: "extra"}
    heads = spark.createDataFrame([("a", True, False), ("a", False, True), ("b", False, True), ("b", False, False)], "session_id string, available boolean, settled boolean")
    assert [(r.session_id, r.settled, r.unsettled) for r in A.missing_state(heads).collect()] == [("b", 1, 1)]
    m = spark.createDataFrame([("/a/x", "x", 1), ("/a/x", "x", 2), ("/b/x", "x", 1)], "source_path string, rel_path string, version int")
    assert V.resolve(m, "/a/x").first().version == 2
    for name in ("x", "none"):
        with pytest.raises(LookupError):
            V.resolve(m, name)
    with pytest.raises(ValueError):
        R.grouped_statistics(m, m, m, ["nonsense"])


SF = "/root/testdata/sf0.001"


def test_reports(spark):
    usage, rates = B.usage(spark, SF).cache(), B.rates(spark)
    d = reports.daily(usage, rates)
    assert len(d["data"]) == 30 and d["command"] == "daily" and d["data"] == sorted(d["data"], key=lambda r: r["date"])
    assert len(reports.monthly(usage, rates, since="1997-01-01", until="1997-12-31")["data"]) == 12
    m = reports.models(usage, rates, sort="cost")["data"]
    assert [r["cost"] for r in m] == sorted((r["cost"] for r in m), reverse=True)
    s = reports.summary(usage, rates, provider="codex")["data"]
    assert len(s["providers"]) == 1 and len(s["top_models"]) == 5
    assert reports.heatmap(usage, rates, model="Brand#5")["data"]["metric"] == "tokens"
    assert reports.heatmap(usage, rates, model="Brand#6")["data"]["metric"] == "cost"
    assert reports.doctor(usage, B.manifest(spark, SF))["data"]["store"]["models"] == 25 and len(reports.pricing(rates)["data"]) == 40
    for bad in ({"since": "1997-2-1"}, {"since": "1997-02-02", "until": "1997-02-01"}, {"provider": "x"}, {"last": 3, "since": "1997-02-01"}, {"since": "1997-02-30"}):
        with pytest.raises(ValueError):
            reports.daily(usage, rates, **bad)
