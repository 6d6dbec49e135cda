"""Batch jobs over generations, upkeep, and reports on sessions."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import maintenance as M
from ledgerloom.operators import search as H
from ledgerloom.plans import bindings as B
from ledgerloom.plans import history_reports as Z
from ledgerloom.plans import jobs
from tests.test_extraction import context, count, lines_of, message

ONE = count("2026-01-01T01:00:00Z", (4, 2, 0, 1, 0))
SF = "/root/testdata/sf0.001"


def total(spark, store, generation):
    return jobs.usage(spark, store, generation).agg(F.sum("input")).first()[0]


def test_sync_over_generations(spark, tmp_path):
    root, store = tmp_path / "logs", str(tmp_path / "store")
    root.mkdir()
    (root / "a.jsonl").write_text(f"{context('m')}\n{ONE}\n")
    (root / "b.jsonl").write_text(f"{context('m')}\n{ONE}\n{ONE}\n")
    (root / "c.jsonl").write_text(f"{context('m')}\n{ONE}\n")  # a copy of a
    g, counts = jobs.sync(spark, str(root), store, 0)
    assert (g, counts) == (1, {"new": 3}) and total(spark, store, 1) == 12
    g, counts = jobs.sync(spark, str(root), store, 1)
    assert counts == {"unchanged": 3} and total(spark, store, 2) == 12
    (root / "b.jsonl").write_text(f"{context('m')}\n{ONE}\n{ONE}\n{ONE}\n")
    os.remove(root / "a.jsonl")
    g, counts = jobs.sync(spark, str(root), store, 2)
    assert counts == {"appended": 1, "missing": 1, "unchanged": 1} and total(spark, store, 3) == 16  # what vanished stays
    (root / "b.jsonl").write_text(f"{context('m')}\n{count('2026-01-01T01:00:00Z', (50, 0, 0, 1, 0))}\n{ONE}\n{ONE}\n{ONE}\n{ONE}\n")
    g, counts = jobs.sync(spark, str(root), store, 3)
    assert counts["rewritten"] == 1 and total(spark, store, 4) == 4 + 50 + 16


def counted(n):
    return count("2026-01-01T01:00:00Z", (n, 0, 0, 1, 0))


def reply(mid, raw, output):
    return message(mid, "2026-01-01T01:00:00Z", raw=raw, output=output)


def log(*counts, model="m"):
    return "".join(line + "\n" for line in [context(model), *map(counted, counts)])


def test_a_copy_counts_once_its_owner_differs(spark, tmp_path):
    root, store = tmp_path / "logs", str(tmp_path / "store")
    root.mkdir()
    (root / "a.jsonl").write_text(log(100))
    (root / "b.jsonl").write_text(log(100))
    jobs.sync(spark, str(root), store, 0)
    assert total(spark, store, 1) == 100
    (root / "a.jsonl").write_text(log(15))
    assert jobs.sync(spark, str(root), store, 1)[1] == {"rewritten": 1, "unchanged": 1} and total(spark, store, 2) == 115
    (root / "a.jsonl").write_text(log(100) + log(7))  # it goes on from its copy again, under another first count
    jobs.sync(spark, str(root), store, 2)
    (root / "b.jsonl").write_text(log(100) + log(7))
    jobs.sync(spark, str(root), store, 3)
    assert total(spark, store, 4) == 107


def test_moves_and_files_that_go_on_from_another(spark, tmp_path):
    root, store = tmp_path / "logs", str(tmp_path / "store")
    root.mkdir()
    (root / "a.jsonl").write_text(log(10, 20))
    jobs.sync(spark, str(root), store, 0)
    os.rename(root / "a.jsonl", root / "z.jsonl")
    (root / "z.jsonl").write_text(log(10, 20, 5))  # moved, and written on
    assert jobs.sync(spark, str(root), store, 1)[1] == {"moved": 1} and total(spark, store, 2) == 35
    (root / "longer.jsonl").write_text(log(10, 20, 5, 100))  # holds all of z, and more
    assert jobs.sync(spark, str(root), store, 2)[1] == {"unchanged": 1, "new": 1} and total(spark, store, 3) == 135
    (root / "longer.jsonl").write_text(log(10, 20, 5, 100, 1000))
    assert jobs.sync(spark, str(root), store, 3)[1] == {"unchanged": 1, "appended": 1} and total(spark, store, 4) == 1135
    (root / "z.jsonl").write_text(log(3))  # what longer went on from is another file now
    jobs.sync(spark, str(root), store, 4)
    assert total(spark, store, 5) == 1138
    os.remove(root / "z.jsonl")
    assert jobs.sync(spark, str(root), store, 5)[1]["missing"] == 1 and total(spark, store, 6) == 1138


def test_only_new_bytes_are_booked(spark, tmp_path, monkeypatch):
    root, store = tmp_path / "logs", str(tmp_path / "store")
    root.mkdir()
    (root / "a.jsonl").write_text(log(1, 2) + counted(4)[:20])  # the last record isn't whole
    jobs.sync(spark, str(root), store, 0)
    assert total(spark, store, 1) == 3
    seen = []
    booked = jobs.L.lines_at
    monkeypatch.setattr(jobs.L, "lines_at", lambda files: seen.append([tuple(r) for r in booked(files).select("path", "line_no").collect()]) or booked(files))
    (root / "a.jsonl").write_text(log(1, 2) + counted(4) + "\n" + counted(8) + "\n")
    jobs.sync(spark, str(root), store, 1)
    assert [n for _, n in seen[0]] == [4, 5] and total(spark, store, 2) == 15
    assert jobs.usage(spark, store, 2).select("model").distinct().collect()[0][0] == "m"
    seen.clear()
    jobs.sync(spark, str(root), store, 2)
    assert seen[0] == [] and total(spark, store, 3) == 15


def test_both_providers(spark, tmp_path):
    a, b, store = tmp_path / "a", tmp_path / "b", str(tmp_path / "store")
    a.mkdir(), b.mkdir()
    (a / "x.jsonl").write_text(log(10))
    (b / "y.jsonl").write_text(reply("m1", 5, 1) + "\n" + reply("m1", 7, 2) + "\n")
    roots = {"codex": str(a), "claude": str(b)}
    jobs.sync(spark, roots, store, 0)
    assert {r.provider: r.input for r in jobs.usage(spark, store, 1).groupBy("provider").agg(F.sum("input").alias("input")).collect()} == {"codex": 10, "claude": 7}
    (b / "copy.jsonl").write_text(reply("m1", 7, 2) + "\n" + reply("m2", 1, 1) + "\n")
    (b / "y.jsonl").write_text(reply("m1", 5, 1) + "\n" + reply("m1", 7, 2) + "\n" + reply("m1", 9, 2) + "\n")
    assert jobs.sync(spark, roots, store, 1)[1] == {"unchanged": 1, "appended": 1, "new": 1}
    assert {r.provider: r.input for r in jobs.usage(spark, store, 2).groupBy("provider").agg(F.sum("input").alias("input")).collect()} == {"codex": 10, "claude": 10}
    assert jobs.issues(spark, store, 2).count() == 0


def test_stream_forgets_what_is_gone(spark, tmp_path):
    from ledgerloom.streaming.ingest import cube_of, ingest, ledger_writer

    root, out = tmp_path / "logs", str(tmp_path / "out")
    root.mkdir()
    (root / "a.jsonl").write_text(log(50))
    ingest(spark, str(root), out, str(tmp_path / "mark")).awaitTermination()
    assert cube_of(spark, out).agg(F.sum("input")).first()[0] == 50
    # another version of the file, without events
    gone = spark.createDataFrame([(spark.read.parquet(out + "/files").first()["path"], bytearray((context("m") + "\n").encode()))], "path string, content binary")
    ledger_writer(out)(gone, 7)
    assert cube_of(spark, out).count() == 0
    other = tmp_path / "b"
    other.mkdir()
    (other / "y.jsonl").write_text(reply("m1", 5, 1) + "\n" + reply("m1", 7, 2) + "\n")
    ingest(spark, str(other), out, str(tmp_path / "mark-b"), provider="claude").awaitTermination()
    assert cube_of(spark, out, providers=("codex", "claude")).agg(F.sum("input")).first()[0] == 7


def test_resumed_log(spark):
    lines = lines_of(spark, {"f": [ONE, context("next"), ONE], "g": [ONE]})
    marks = spark.createDataFrame([("f", "before"), ("h", "x")], "path string, model string")
    assert [(r.path, r.model) for r in M.resumed_events_a(lines, marks).orderBy("path", "line_no").collect()] == [("f", "before"), ("f", "next"), ("g", "unknown")]


def test_marks(spark):
    c = spark.createDataFrame([("a", True, True), ("b", False, False), ("c", True, False)], "path string, missing boolean, settled boolean")
    seen = spark.createDataFrame([("a",)], "path string")
    marked = M.mark_missing(c, seen)
    assert {r.path: (r.missing, r.settled) for r in marked.collect()} == {"a": (False, False), "b": (True, False), "c": (True, False)}
    assert {r.path: r.settled for r in M.settle(marked).collect()} == {"a": False, "b": True, "c": True}
    assert {r.path: r.settled for r in M.settle(marked, spark.createDataFrame([("b",), ("a",)], "path string")).collect()} == {"a": False, "b": True, "c": False}
    rows = spark.createDataFrame([(None, "/x/P", None, None, None), ("R", "/x", "old", "git", 9)], "repository string, cwd string, project string, project_source string, rule_version int")
    assert [(r.project, r.rule_version) for r in M.backfill(rows, 3).collect()] == [("p", 3), ("old", 9)]
    ids = rows.select(M.stable_id("repository", "cwd").alias("i")).distinct()
    assert ids.count() == 2
    docs = spark.createDataFrame([(1, "a b"), (2, "b")], "id int, t string")
    index = H.postings(docs, "id", "t")
    assert M.index_differences(index, index).count() == 0 and M.index_differences(index.filter("term = 'a'"), index).count() == 2
    f = M.freshness(spark.createDataFrame([("a", 1, "2026-01-01 00:00:00"), ("n", 1, "2026-01-01 09:58:00")], "path string, size int, mtime string"), spark.createDataFrame([("a", 2, "2026-01-01 00:00:00"), ("z", 1, "x")], "path string, size int, mtime string"), "2026-01-01 10:00:00").first()
    assert tuple(f) == (1, 1, 1, 1)


def test_session_reports(spark):
    p, s, o = B.prompts(spark, SF).cache(), B.sessions(spark, SF).cache(), B.occurrences(spark, SF).cache()
    page, coverage = Z.catalog(s, size=5)
    assert page.count() == 6 and coverage.first().sessions == s.count()
    first = Z.listing(p, o, size=3).collect()
    rest = Z.listing(p, o, size=500, last=[first[2].ts, first[2].prompt_id]).collect()
    assert first[3].prompt_id == rest[0].prompt_id
    word = H.fold_text(p.filter("role = 'user' and kind = 'human'").first().text)[0]
    hits = Z.search(p, o, word).collect()
    assert all(f"[{word}]" in r.snippet for r in hits) and [r.rank for r in hits] == sorted(r.rank for r in hits)
    assert {r.prompt_id for r in Z.search(p, o, f"{word} OR zzzz", raw=True, size=500).collect()} == {r.prompt_id for r in Z.search(p, o, word, size=500).collect()}
    assert Z.search(p, o, " , ").count() == 0
    a = Z.sample(p, "prompt_id", "stratified", 10, "s", group="role").collect()
    assert a == Z.sample(p.repartition(3), "prompt_id", "stratified", 10, "s", group="role").collect() and len(a) == 10
    assert Z.sample_coverage(Z.sample(p, "prompt_id", "random", 10, "s", session="session_id"), s).first().sessions == min(10, s.count())
    for bad in (dict(strategy="random", count=0), dict(strategy="stratified", count=5), dict(strategy="x", count=5)):
        with pytest.raises(ValueError):
            Z.sample(p, "prompt_id", seed="s", **bad)
    scalars, groups = Z.statistics(s, p, o, ["provider"], 5)
    assert scalars.first().prompts == p.count() and sum(r.sessions for r in groups.collect()) == s.count()
    assert Z.vault_page(B.manifest(spark, SF), "size", provider="codex", size=10).count() == 11
    for df in (p, s, o):
        df.unpersist()



def test_files_of_one_first_record_do_not_meet_in_pairs(spark, tmp_path):
    root, store = tmp_path / "logs", str(tmp_path / "store")
    root.mkdir()
    for k in range(30):
        (root / f"f{k}.jsonl").write_text(log(1, *[k + 1] * (k % 3)))
    jobs.sync(spark, str(root), store, 0)
    assert spark.read.parquet(f"{store}/generation=1/near").count() == 0
    (root / "g.jsonl").write_text(log(1, 500))
    jobs.sync(spark, str(root), store, 1)
    # the ten files of the first record alone, equal in content, are one row for g
    assert spark.read.parquet(f"{store}/generation=2/prefixes").count() == 1
    assert total(spark, store, 2) == 1 + 500 + sum((k % 3) * (k + 1) + 1 for k in range(30) if k % 3)
