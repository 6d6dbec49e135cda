"""Scalar functions, cursors, queries' grammar and sinks."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import money, times
from ledgerloom.functions import text as T
from ledgerloom.operators import pagination as N
from ledgerloom.operators import pricing as P
from ledgerloom.operators import search as H
from ledgerloom.sources import sinks as K


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_money(spark):
    got = values(spark, [(5_000_000,), (4_999_999,), (-5_000_000,), (-4_999_999,), (123_456_789_012_345,)], "n long", money.cents(F.col("n")), money.usd(F.col("n")))
    assert got == [(1, "0.01"), (0, "0.00"), (-1, "-0.01"), (0, "0.00"), (12345679, "123456.79")]
    got = values(spark, [(2**62, 4), (3, 7), (-1, 7), (5, None), (0, 7)], "t long, r long", money.checked_product(F.col("t"), F.col("r")))
    assert [g[0] for g in got] == [None, 21, None, None, 0]
    got = values(spark, [("1.25",), ("3",), ("0.001",), ("1.2345",), ("-1",), ("1e3",), ("",)], "x string", money.milli_rate(F.col("x")))
    assert [g[0] for g in got] == [1250, 3000, 1, None, None, None, None]
    assert values(spark, [(1, 3), (0, 0)], "a long, b long", money.percent(F.col("a"), F.col("b"))) == [(33.3,), (0.0,)]
    assert values(spark, [(1234567,)], "a long", money.thousands(F.col("a"))) == [("1,234,567",)]


def test_sum_that_overflows(spark):
    rows = spark.createDataFrame([("a", 2**62), ("a", 2**62), ("b", 5)], "k string, m long")
    assert {r.k: r.s for r in rows.groupBy("k").agg(P.checked_sum(F.col("m")).alias("s")).collect()} == {"a": None, "b": 5}


USAGE = "date string, provider string, model string, input long, cache_read long, cache_write_5m long, cache_write_1h long, cache_write_unclassified long, output long, reasoning long"


def test_row_cost(spark):
    rates = P.rate_table(spark, [("m", 10, 1, None, 3, 0, "published", None, "2026-01-31"), ("m", 20, 1, 2, 3, 4, "proxy", "2026-02-02", None)])
    rows = [("2026-01-31", "p", "m", 100, 40, 7, 2, 1, 5, 0), ("2026-02-01", "p", "m", 100, 0, 0, 0, 0, 5, 0), ("2026-02-02", "p", "m", 10, 40, 0, 0, 0, 0, 0), ("2026-02-02", "p", "x", 1, 0, 0, 0, 0, 0, 0)]
    got = {(r.date, r.model): (r.cost, r.priced_tokens, r.unpriced_tokens, r.provenance) for r in P.price(spark.createDataFrame(rows, USAGE), rates).collect()}
    assert got == {("2026-01-31", "m"): (50 * 10 + 40 + 6 + 3, 50 + 40 + 2 + 1 + 5, 7, "published"), ("2026-02-01", "m"): (0, 0, 105, None), ("2026-02-02", "m"): (40, 40, -30, "proxy"), ("2026-02-02", "x"): (0, 0, 1, None)}


def test_rate_tables(spark):
    with pytest.raises(ValueError):
        P.rate_table(spark, [("m", 1, 1, 1, 1, 1, "published", None, "2026-01-31"), ("m", 1, 1, 1, 1, 1, "published", "2026-01-31", None)])
    with pytest.raises(ValueError):
        P.rate_table(spark, [("m", -1, 1, 1, 1, 1, "published", None, None)])
    with pytest.raises(ValueError):
        P.user_rates(spark, {"m": {"input": 1}})
    a, b = ("m", 1, None, 1, 1, 1, "user", None, None), ("k", 1, None, 1, 1, 1, "user", None, None)
    assert P.fingerprint([a, b]) == P.fingerprint([b, a]) != P.fingerprint([a])
    assert {r.model: r.status for r in P.overlay(P.rate_table(spark, [a, b]), P.user_rates(spark, {"m": {"input": 5, "output": 6}})).collect()} == {"m": "user", "k": "user"}


_MESSAGE, _NESTED = '<teammate-message id="a">done</teammate-message>', '<teammate-message id="a">quoted <teammate-message id="b">inner</teammate-message> text</teammate-message>'
_BEFORE, _AFTER = T.TEAMMATE_PREAMBLE, T.TEAMMATE_TRAILER
KINDS = [
    (_BEFORE + _MESSAGE, "human", "agent_message"), (_BEFORE + '<teammate-message\n  id="a"\n  color="b">done</teammate-message>', "human", "agent_message"), (_BEFORE + _MESSAGE + "\n\n" + _AFTER, "human", "agent_message"),
    (_BEFORE + _NESTED + "\n \t\n" + _AFTER, "human", "agent_message"), (_BEFORE + _MESSAGE + "\nfollow-up\n" + _MESSAGE + "\n\n" + _AFTER, "human", "agent_message"), (_BEFORE + _NESTED, "human", "human"), (_NESTED, "human", "human"),
    ("Please read:\n" + _BEFORE + _MESSAGE, "human", "human"), (_BEFORE + _MESSAGE + "\nThanks", "human", "human"), (_BEFORE + _MESSAGE + "\n\n" + _AFTER + "\nThanks", "human", "human"), (_BEFORE + " \n" + _MESSAGE + "\n\n" + _AFTER, "human", "human"),
    ("<teammate-message id=a>done</teammate-message>", "human", "human"), (_BEFORE, "human", "human"), (_BEFORE + _AFTER, "human", "human"),
    ("Message Type: NEW_TASK\nTask name: a\nSender: b\nPayload:\nx", "human", "delegation"), ("<codex_delegation>x</codex_delegation>", "human", "delegation"), ("Message Type: MESSAGE\nTask name: a\nSender: b\nPayload:\nx", "human", "agent_message"),
    ('<teammate-message from="a">hello</teammate-message>', "human", "agent_message"), ("<teammate-message>a</teammate-message><teammate-message>b</teammate-message>", "human", "human"), ("<command-name>/x</command-name>", "human", "command"),
    ("<bash-input>ls</bash-input><bash-stdout>a</bash-stdout>", "human", "command"), ("<turn_aborted>x</turn_aborted>", "system_injected", "control"), ("<heartbeat></heartbeat>", "human", "control"), ("<system-reminder>x</system-reminder>", "agent_instruction", "unknown"),
    ("<b>bold</b> and text", "human", "human"), ("<environment_context>a</environment_context> and more", "human", "human"), ("# AGENTS.md instructions for /x\n\n<INSTRUCTIONS>do</INSTRUCTIONS>", "agent_instruction", "unknown"), ("", "unknown", "unknown"),
]


def test_prompt_kinds(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(KINDS)], "k int, t string").withColumn("c", T.classification(F.col("t")))
    got = rows.withColumn("kind", T.prompt_kind(F.col("t"), F.lit("user"), F.col("c"))).orderBy("k").collect()
    assert [(r.c, r.kind) for r in got] == [(c, kind) for _, c, kind in KINDS]


def test_snippets(spark):
    long = "mit one " + "w " * 30 + "the mit license mit license here " + "z " * 30
    rows = [(long,), ("a mit license",), ("license license mit",), ("aa aa aa b",)]

    def shown(text, *phrases, size=24):
        docs = H.with_tokens(spark.createDataFrame([(text,)], "t string"), "t")
        return docs.select(H.snippet(F.col("_words"), *phrases, size=size)).first()[0]

    assert shown(rows[0][0], ["mit", "license"]) == "... " + "w " * 11 + "the [mit license] [mit license] here " + " ".join(["z"] * 7) + " ..."
    assert shown(rows[1][0], ["mit", "license"]) == "a [mit license]"
    assert shown(rows[2][0], ["license"], ["mit"]) == "[license] [license] [mit]"
    assert shown(rows[3][0], ["aa", "aa"]) == "[aa aa aa] b"  # overlapping matches
    assert shown(rows[0][0], ["one"], size=4) == "mit [one] w w ..."
    assert shown("x y", ["absent"]) == "x y"
    assert shown("", ["a"]) == ""


def test_text(spark):
    assert values(spark, [("a\r\nb ",), ("\u00a0x\u2003",)], "t string", T.clean(F.col("t"))) == [("a\nb",), ("x",)]
    rows = [("https://user@Host.com:22/a/b.git",), ("git@host.com:team/repo.git",), ("ssh://host/x/",), ("nothing",), (None,)]
    assert values(spark, rows, "u string", T.repository_identity(F.col("u")), T.repository_name(F.col("u"))) == [("host.com/a/b", "b"), ("host.com/team/repo", "repo"), ("host/x", "x"), (None, None), (None, None)]
    got = values(spark, [("Repo ", "/x"), (None, "/home/me/Proj/"), ("", "/tmp/x"), (None, "C:\\"), (None, None)], "r string, c string", T.project_of(F.col("r"), F.col("c")))
    assert [tuple(g[0]) for g in got] == [("repo", "git"), ("proj", "cwd"), (None, None), (None, None), (None, None)]
    got = values(spark, [("0.93.0",), ("0.92.9",), ("1.0.0",), ("0.93.0-beta",), ("v0.94.1",), ("x",), (None,)], "v string", T.version_at_least(F.col("v"), (0, 93, 0)))
    assert [g[0] for g in got] == [True, False, True, False, True, False, False]
    got = values(spark, [("/r/projects/p/abc.jsonl",), ("/r/projects/p/abc/subagents/s1.jsonl",), ("/other/x.jsonl",)], "p string", T.thread_facts(F.col("p")))
    assert [tuple(g[0]) for g in got] == [("root", "abc", None), ("subagent", "s1", "abc"), ("unknown", None, None)]
    assert values(spark, [("=1",), ("a",), ("\tb",)], "t string", T.csv_guard(F.col("t"))) == [("'=1",), ("a",), ("'\tb",)]
    long = "é" * 400
    got = values(spark, [("a\nb\nc\nd\ne",), (long,), ("x" + long,), ("日" * 300,)], "t string", T.preview(F.col("t")))
    assert [g[0] for g in got] == ["a\nb\nc\nd", "é" * 256, "x" + "é" * 255, "日" * 170]
    assert values(spark, [(" X ",), ("",), (None,)], "t string", T.label_or_unknown(F.col("t"))) == [("x",), ("unknown",), ("unknown",)]


def test_times(spark):
    got = values(spark, [("2026-01-01T00:00:00.123456789Z",), ("2026-01-01T02:00:00+02:00",), ("bad",), (None,)], "t string", times.instant_key(F.col("t")))
    assert [g[0] for g in got] == ["2026-01-01T00:00:00.123456789Z", "2026-01-01T00:00:00.000000000Z", "", ""]
    assert times.rolling_year(date(2024, 2, 29)) == (date(2023, 3, 2), date(2024, 2, 29)) and times.rolling_year(date(2026, 1, 1))[0] == date(2025, 1, 2)
    assert times.zone_fingerprint("UTC") != times.zone_fingerprint("America/New_York")
    since, until = times.window_in_zone("America/New_York", 2026, 3, 8)
    assert (until - since).total_seconds() == 23 * 3600 and times.window_in_zone("UTC") == (None, None)
    assert times.window_in_zone("UTC", 2026, 12)[1].year == 2027


def test_cursors():
    c = N.encode_cursor(["a", None, 3], "f", 7)
    assert N.decode_cursor(c, "f", 7) == ["a", None, 3]
    for bad in (c[3:], c + "x!", "v1:AAAA", c.replace("v1", "v2")):
        with pytest.raises(ValueError):
            N.decode_cursor(bad, "f", 7)
    for other in (("g", 7), ("f", 8)):
        with pytest.raises(ValueError):
            N.decode_cursor(c, *other)


def test_pages_cover_everything_once(spark):
    rows = spark.createDataFrame([(k, None if k % 5 == 0 else f"t{k % 3}") for k in range(37)], "id int, ts string")
    keys, last, seen = [("ts", True), ("id", False)], None, []
    while True:
        got = N.page(rows, keys, 6, last).collect()
        seen += [r.id for r in got[:6]]
        if len(got) <= 6:
            break
        last = [got[5].ts, got[5].id]
    assert len(seen) == 37 and sorted(seen) == list(range(37)) and all(k % 5 == 0 for k in seen[-8:])
    with pytest.raises(ValueError):
        N.page(rows, keys, 501)


def test_search_grammar(spark):
    docs = spark.createDataFrame([(1, "Café au lait"), (2, "the quick brown fox"), (3, "quick the fox"), (4, None), (5, "")], "id int, t string")
    find = lambda q: sorted(r.id for r in H.with_tokens(docs, "t").filter(H.boolean(F.col("_words"), H.parse(q))).collect())
    assert find("cafe") == [1] and find('"quick brown"') == [2] and find("qui* NOT brown") == [3] and find("cafe OR fox") == [1, 2, 3]
    assert find("NEAR(the fox, 0)") == [3] and find("NEAR(the fox, 2)") == [2, 3] and find("(the AND quick) brown") == [2]
    for bad in ("(a", "a OR", ")", "NOT"):
        with pytest.raises(ValueError):
            H.parse(bad)
    assert [r.tf for r in H.match_phrase(docs, "t", "CAFÉ").collect()] == [1] and H.match_phrase(docs, "t", " ,").count() == 0


def test_sinks(spark, tmp_path):
    K.atomic_write(str(tmp_path / "f"), b"one")
    K.atomic_write(str(tmp_path / "f"), b"two")
    assert (tmp_path / "f").read_bytes() == b"two" and [p.name for p in tmp_path.iterdir()] == ["f"]
    (tmp_path / "v").mkdir()
    hashes = K.write_bundle(str(tmp_path / "v" / "2026-01.tar.zst"), {"a/x.jsonl": b"1\n", "b.jsonl": b"22\n"})
    got = K.read_bundles(spark, str(tmp_path / "v")).collect()
    assert {(r.name, r.size, r.sha256) for r in got} == {("a/x.jsonl", 2, hashes["a/x.jsonl"]), ("b.jsonl", 3, hashes["b.jsonl"])}
    text = K.markdown([{"role": "user", "text": "a ``` b"}], "t", "n0")
    assert "## user [n0]" in text and "````\na ``` b\n````" in text
    e = K.envelope("daily", [1], warnings=["a", "b", "a"])
    assert e["warnings"] == ["a", "b"] and list(e)[:2] == ["schema", "command"]
    records = spark.createDataFrame([("s", 1, "tool_call", "ls", "c1", "x"), ("s", 2, "tool_result", None, "c1", "y"), ("s", 3, "message", None, None, "z")], "session_id string, line_no int, kind string, tool string, call_id string, text string")
    assert [(r.tool, r.text) for r in K.volume_policy(K.with_tool_names(records)).orderBy("line_no").collect()] == [("ls", None), ("ls", None), (None, "z")]
    K.write_transcripts(records, str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).count() == 3
