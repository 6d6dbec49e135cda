"""The index of sessions and prompts, and of bundles, over generations."""

import json
import os

from ledgerloom.plans import history_jobs as I
from ledgerloom.sources import sinks as S


def rollout(native, *said):
    meta = {"type": "session_meta", "timestamp": "2026-01-01T00:00:00Z", "payload": {"id": native, "cwd": "/work/team", "cli_version": "0.95.0", "source": "cli"}}
    told = [{"type": "event_msg", "timestamp": f"2026-01-01T00:0{k}:00Z", "payload": {"type": "user_message", "message": t}} for k, t in enumerate(said, 1)]
    return "".join(json.dumps(r, separators=(",", ":")) + "\n" for r in [meta, *told])


def turns(*said):
    return "".join(json.dumps({"type": "user", "timestamp": "2026-01-02T00:00:00Z", "uuid": f"u{k}", "cwd": "/work/other", "message": {"role": "user", "content": t}}, separators=(",", ":")) + "\n" for k, t in enumerate(said))


def found(spark, store, generation):
    return sorted((r.text, r.available) for r in I.prompts_with_state(spark, store, generation).collect())


def test_index_over_generations(spark, tmp_path):
    a, b, store = tmp_path / "a", tmp_path / "projects" / "p", str(tmp_path / "store")
    a.mkdir(), b.mkdir(parents=True)
    roots = {"codex": str(a), "claude": str(tmp_path / "projects")}
    (a / "x.jsonl").write_text(rollout("n1", "first", "<environment_context>x</environment_context>"))
    (b / "s1.jsonl").write_text(turns("hello", "more"))
    assert I.index_history(spark, roots, store, 0) == (1, {"new": 2})
    assert found(spark, store, 1) == [("<environment_context>x</environment_context>", True), ("first", True), ("hello", True), ("more", True)]
    assert [(r.classification, r.reason, r.n) for r in I.excluded(spark, store, 1).collect()] == [("system_injected", "wrapper", 1)]
    s = {r.native_id: r for r in spark.read.parquet(store + "/generation=1/sessions").collect()}
    assert (s["n1"].project, s["n1"].thread_kind, s["n1"].line_count) == ("team", "root", 3) and (s["s1"].provider, s["s1"].project, s["s1"].thread_kind) == ("claude", "other", "root")
    assert I.index_history(spark, roots, store, 1)[1] == {"unchanged": 2}
    os.rename(b / "s1.jsonl", b / "s2.jsonl")
    (a / "x.jsonl").write_text(rollout("n1", "other"))
    (a / "y.jsonl").write_text("no json\n")
    assert I.index_history(spark, roots, store, 2)[1] == {"moved": 1, "changed": 1, "new": 1}
    assert found(spark, store, 3) == [("hello", True), ("more", True), ("other", True)]
    os.remove(a / "x.jsonl")
    assert I.index_history(spark, roots, store, 3)[1] == {"missing": 1, "unchanged": 2}
    assert found(spark, store, 4) == [("hello", True), ("more", True), ("other", False)]
    assert {r.kind: r.n for r in spark.read.parquet(store + "/generation=4/run").collect()} == {"missing": 1, "unchanged": 2}


def test_bundles_are_skipped(spark, tmp_path):
    root, store = tmp_path / "vault", str(tmp_path / "store")
    root.mkdir()
    S.write_bundle(str(root / "a.tar.zst"), {"x.jsonl": b"one\n", "y.jsonl": b"two\n"})
    assert I.index_bundles(spark, str(root), store, 0) == (1, {"new": 1})
    assert I.index_bundles(spark, str(root), store, 1) == (2, {"unchanged": 1})
    os.utime(root / "a.tar.zst", (2e9, 2e9))  # touched, of the same members
    S.write_bundle(str(root / "b.tar.zst"), {"z.jsonl": b"three\n"})
    assert I.index_bundles(spark, str(root), store, 2) == (3, {"unchanged": 1, "new": 1})
    S.write_bundle(str(root / "b.tar.zst"), {"z.jsonl": b"four\n", "w.jsonl": b""})
    os.utime(root / "b.tar.zst", (2.1e9, 2.1e9))
    assert I.index_bundles(spark, str(root), store, 3) == (4, {"unchanged": 1, "changed": 1})
    assert sorted(r.name for r in spark.read.parquet(store + "/generation=4/members").collect()) == ["w.jsonl", "x.jsonl", "y.jsonl", "z.jsonl"]
