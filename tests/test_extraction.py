"""Trap fixtures of the two log formats."""

import json
import os

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ledgerloom.operators import extraction as X
from ledgerloom.operators.cube import cube
from ledgerloom.sources import jsonl as J


def count(ts, last, total=None, **more):
    keys = ("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens")
    usage = lambda v: {**dict(zip(keys, v)), "total_tokens": v[0] + v[3], **more}
    return json.dumps({"timestamp": ts, "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": usage(total or last), "last_token_usage": usage(last)}}}, separators=(",", ":"))


def context(model):
    return json.dumps({"timestamp": "2026-01-01T00:00:00Z", "type": "turn_context", "payload": {"model": model}}, separators=(",", ":"))


def lines_of(spark, files):
    rows = [(p, k, r) for p, records in files.items() for k, r in enumerate(records, 1)]
    return spark.createDataFrame(rows, "path string, line_no long, raw string")


def events(spark, records):
    got = X.events_a(lines_of(spark, {"f": records})).orderBy("line_no").collect()
    return [(r.model, r.input, r.cache_read, r.cache_write_5m, r.output, r.reasoning) for r in got]


NORMAL = [
    context("  first  "), json.dumps({"type": "event_msg", "payload": {"type": "token_count", "info": None}}), count("2026-01-01T01:00:00Z", (100, 40, 3, 20, 5)), '{"type":"event_msg","payload":{"type":"token_count"',
    json.dumps({"type": "response_item", "payload": {"text": 'mentions "token_count"'}}), context("second"), count("2026-01-01T08:07:00-04:00", (30, 10, 0, 4, 2), total_tokens=999), count("not a time", (5, 0, 0, 1, 0)),
]


def test_normal_log(spark):
    assert events(spark, NORMAL) == [("first", 100, 40, 3, 20, 5), ("second", 30, 10, 0, 4, 2)]
    at = X.events_a(lines_of(spark, {"f": NORMAL})).orderBy("line_no").select(F.date_format("ts", "HH:mm").alias("t")).collect()
    assert [r.t for r in at] == ["01:00", "12:07"]
    d = X.diagnostics_a(lines_of(spark, {"f": NORMAL})).first()
    assert (d.token_events, d.last_usage_mismatches) == (3, 1)
    assert d.malformed == 2


def test_model_before_and_after(spark):
    one = count("2026-01-01T01:00:00Z", (4, 2, 0, 1, 0))
    assert [e[0] for e in events(spark, [one, context("later"), one])] == ["later", "later"]
    assert events(spark, [one]) == [("unknown", 4, 2, 0, 1, 0)]
    assert [e[0] for e in events(spark, [one, context("  "), one, context("x"), one])] == ["unknown", "unknown", "x"]
    d = X.diagnostics_a(lines_of(spark, {"f": [one, context("later")], "g": [one]})).first()
    assert (d.buffered_before_model, d.unknown_model_events) == (2, 1)


def test_counter_diagnostics(spark):
    rows = [context("m"), count("2026-01-01T01:00:00Z", (10, 0, 0, 2, 0), (10, 0, 0, 2, 0)), count("2026-01-01T01:01:00Z", (0, 0, 0, 0, 0), (10, 0, 0, 2, 0)), count("2026-01-01T01:02:00Z", (3, 0, 0, 1, 0), (3, 0, 0, 1, 0)), count("2026-01-01T01:03:00Z", (-5, 0, 0, 1, 0), (9, 0, 0, 9, 0))]
    assert [e[1] for e in events(spark, rows)] == [10, 3]
    d = X.diagnostics_a(lines_of(spark, {"f": rows})).first()
    assert (d.counter_resets, d.duplicate_snapshots) == (1, 1)


def message(mid, ts, raw=0, read=0, creation=0, output=0, model="b", five=0, hour=0, **more):
    usage = {"input_tokens": raw, "cache_read_input_tokens": read, "cache_creation_input_tokens": creation, "output_tokens": output, "cache_creation": {"ephemeral_5m_input_tokens": five, "ephemeral_1h_input_tokens": hour}, **more}
    return json.dumps({"timestamp": ts, "type": "assistant", "message": {"id": mid, "model": model, "usage": usage}}, separators=(",", ":"))


def test_messages(spark):
    turn = {"model": "", "input_tokens": 1, "cache_read_input_tokens": 2, "cache_creation_input_tokens": 9, "output_tokens": 3, "cache_creation": {"ephemeral_5m_input_tokens": 4, "ephemeral_1h_input_tokens": 1}}
    rows = [
        message("m1", "2026-01-01T10:00:00+02:00", 10, 5, 20, 7, five=3, hour=1, iterations=[]), message("m2", "2026-01-01T09:00:00Z", iterations=[turn, {"model": "other"}]), message("", "2026-01-01T09:00:00Z", 1),
        message("m3", "bad", 1), json.dumps({"timestamp": "2026-01-01T09:00:00Z", "type": "user", "message": {"id": "u", "usage": {"input_tokens": 1}}}, separators=(",", ":")), message("m4", "2026-01-01T09:00:00Z", 8).replace('"usage":{', '"usage": {'), '{"message":{"usage":{',
    ]
    got = X.candidates_b(lines_of(spark, {"f": rows})).orderBy("message_id").collect()
    assert [(r.message_id, r.score, len(r.iterations)) for r in got] == [("m1", 42, 1), ("m2", 15, 2)]
    out = X.events_b(X.candidates_b(lines_of(spark, {"f": rows}))).orderBy("input").collect()
    assert [(r.model, r.input, r.cache_write_5m, r.cache_write_1h, r.cache_write_unclassified, r.output) for r in out] == [("b", 12, 4, 1, 4, 3), ("b", 35, 3, 1, 16, 7)]


def test_progressive_messages(spark):
    at = lambda h: f"2026-01-01T{h:02d}:00:00Z"
    rows = [message("equal", at(10), 5, model="x"), message("equal", at(9), 5, model="y"), message("up", at(11), 5), message("up", at(12), 9), message("down", at(12), 9), message("down", at(8), 5)]
    kept = {r.message_id: r for r in X.progressive(X.candidates_b(lines_of(spark, {"f": rows})), "message_id", ["path", "line_no"]).collect()}
    assert {k: (r.score, r.ts.hour) for k, r in kept.items()} == {"equal": (5, 10), "up": (9, 11), "down": (9, 12)}
    assert kept["equal"].iterations[0].model == "x"
    d = X.dedupe_diagnostics(X.candidates_b(lines_of(spark, {"f": rows})), "message_id", ["path", "line_no"]).first()
    assert (d.retained, d.duplicates, d.differing) == (3, 3, 2)


def test_pairing(spark):
    rows = spark.createDataFrame([("f", 1, "A", "h", "t"), ("f", 3, "B", "h", "t"), ("f", 4, "A", "g", "t"), ("f", 9, "B", "g", "t"), ("f", 10, "A", "k", "t"), ("f", 11, "B", "k", "u")], "path string, line_no long, kind string, text_hash string, ts string")
    assert [r.line_no for r in X.paired(rows).filter("paired").collect()] == [1]


def test_positions_and_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.jsonl").write_bytes(b'{"timestamp":"2026-01-01T00:00:00Z"}\r\n{"timestamp":"bad"}\n{"half"')
    (tmp_path / "y.jsonl").write_bytes(b"same\n")
    (tmp_path / "z.jsonl").write_bytes(b"same\n")
    (tmp_path / "note.txt").write_bytes(b"no\n")
    files = J.contents(spark, str(tmp_path))
    assert J.listing(spark, str(tmp_path)).count() == 3
    lines = J.positioned_lines(files).filter(F.col("path").contains("x.jsonl")).orderBy("line_no").collect()
    assert [(r.line_no, r.start_offset, r.end_offset) for r in lines] == [(1, 0, 38), (2, 38, 58)] and lines[0].raw.endswith("}")
    assert J.positioned_lines(files, complete_only=False).count() == 5
    bounded = J.positioned_lines(files.withColumn("bound", F.lit(38)), bounds="bound")
    assert bounded.filter(F.col("path").contains("x.jsonl")).count() == 1
    later = J.positioned_lines(files.withColumn("from", F.when(F.col("path").contains("x.jsonl"), 38).otherwise(0)), start="from")
    assert [r.start_offset for r in later.filter(F.col("path").contains("x.jsonl")).collect()] == [38]
    stats = {os.path.basename(r.path): r for r in J.line_statistics(J.positioned_lines(files)).collect()}
    assert stats["x.jsonl"].line_count == 2 and stats["x.jsonl"].first_ts is not None and stats["y.jsonl"].first_ts is None
    owners = {os.path.basename(r.path): os.path.basename(r.owner) for r in J.content_owners(files).collect()}
    assert owners == {"x.jsonl": "x.jsonl", "y.jsonl": "y.jsonl", "z.jsonl": "y.jsonl"}
    before = J.fingerprints(files).select("path", "size", "mtime", F.col("size").alias("byte_offset"), "tail_hash").toPandas()
    (tmp_path / "y.jsonl").write_bytes(b"same\nmore\n")
    (tmp_path / "z.jsonl").write_bytes(b"else\nmore\n")
    (tmp_path / "new.jsonl").write_bytes(b"n\n")
    checkpoints = spark.createDataFrame(before).unionByName(spark.createDataFrame(before.head(1).assign(path="gone")))
    now = J.contents(spark, str(tmp_path))
    kinds = {os.path.basename(r.path): r.kind for r in J.classify_files(now.select("path", "size", "mtime"), checkpoints, now).collect()}
    assert kinds == {"x.jsonl": "unchanged", "y.jsonl": "appended", "z.jsonl": "rewritten", "new.jsonl": "new", "gone": "missing"}


def test_roots(monkeypatch, tmp_path):
    monkeypatch.setenv("LOG_HOME", str(tmp_path))
    assert J.resolve_root("codex", None, ("NOT_SET_HERE", "LOG_HOME"), "~/x")["origin"] == "env:LOG_HOME"
    assert J.resolve_root("codex", "/flag", ("LOG_HOME",))["path"] == "/flag"
    assert J.resolve_root("codex", None, (), "~/x")["origin"] == "default"


def test_streamed_ledger(spark, tmp_path):
    from ledgerloom.streaming.ingest import cube_of, ingest

    root, out, mark = tmp_path / "logs", tmp_path / "ledger", tmp_path / "mark"
    root.mkdir()
    one = count("2026-01-01T01:00:00Z", (4, 2, 0, 1, 0))
    (root / "a.jsonl").write_text(context("m") + "\n" + one + "\n")
    ingest(spark, str(root), str(out), str(mark)).awaitTermination()
    (root / "b.jsonl").write_text("\n".join([context("m"), one, one]) + "\n")
    ingest(spark, str(root), str(out), str(mark)).awaitTermination()
    assert [(r.date, r.model, r.input, r.output) for r in cube_of(spark, str(out)).collect()] == [("2026-01-01", "m", 12, 3)]
    batch = cube(X.to_cube_rows(X.events_a(J.positioned_lines(J.contents(spark, str(root))))))
    assert [tuple(r) for r in batch.collect()] == [tuple(r) for r in cube_of(spark, str(out)).collect()]


def test_streamed_messages(spark, tmp_path):
    from ledgerloom.streaming.ingest import message_updates

    schema = "message_id string, line_no long, ts timestamp, score long"
    rows = [("a", 1, "2026-01-01 10:00:00", 5), ("a", 2, "2026-01-01 09:00:00", 5), ("a", 3, "2026-01-01 11:00:00", 9), ("b", 4, "2026-01-01 12:00:00", 1)]
    spark.createDataFrame(rows, "message_id string, line_no long, t string, score long").selectExpr("message_id", "line_no", "cast(t as timestamp) ts", "score").write.parquet(str(tmp_path / "in"))
    stream = message_updates(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("messages").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.message_id, r.score, r.ts.hour, r.old_score) for r in spark.table("messages").collect()} == {("a", 9, 10, None), ("b", 1, 12, None)}


def test_messages_share_a_state_in_groups(spark, tmp_path):
    """A state for a group of messages, not for each; the changes are those of a state for each, late and better snapshots included."""
    from ledgerloom.streaming.ingest import message_updates

    schema = "message_id string, line_no long, ts timestamp, score long"
    rng = np.random.default_rng(4)
    batches = [[(f"m{m}" if m else None, int(k), f"2026-01-01 {h:02d}:30:00", int(s)) for k, m, h, s in zip(rng.permutation(1500) + 1000 * b, rng.integers(0, 600, 1500), rng.integers(0, 24, 1500), rng.integers(-2, 6 + 6 * b, 1500))] for b in (0, 1)]
    shown = {}
    for groups in (None, 5):
        root = tmp_path / str(groups)
        for b, rows in enumerate(batches):
            spark.createDataFrame(rows, "message_id string, line_no long, t string, score long").selectExpr("message_id", "line_no", "cast(t as timestamp) ts", "score").write.mode("append").parquet(str(root / "in"))
            stream = message_updates(spark.readStream.schema(schema).parquet(str(root / "in")), groups=groups)
            write = lambda batch, batch_id, root=root, b=b: batch.write.mode("overwrite").parquet(str(root / f"out{b}"))
            stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", str(root / "c")).trigger(availableNow=True).start().awaitTermination()
            states = spark.read.format("statestore").load(str(root / "c")).count()
            assert states == groups if groups else states > 500
        shown[groups] = [sorted(map(str, spark.read.parquet(str(root / f"out{b}")).collect())) for b in (0, 1)]
    from ledgerloom.streaming import ingest as I

    class State:
        exists, value = False, None

        def update(self, value):
            self.value = value

    frame = pd.DataFrame({"message_id": "a", "line_no": [4, 1, 3, 2], "ts": [3, 1, 2, 0], "score": [7, 5, 5, 3]})  # records: lines 1 and 4, however frames are cut
    for fold in (I._beat, I._beat_group):
        (out,) = fold(("a",), iter([frame[:2], frame[2:]]), State())
        assert out.values.tolist() == [["a", 7, 1, None, None]]
        (out,) = fold(("a",), iter([frame[2:], frame[:2]]), State())
        assert out.values.tolist() == [["a", 7, 1, None, None]]
    assert shown[None] == shown[5] and len(shown[5][0]) > 500 and any("old_score=None" not in r for r in shown[5][1])


def test_a_message_s_rows_are_folded_without_frames_of_their_own():
    """A message costs far less than a frame's operations do (500 took about 2 s with those); the record is the same in any order of rows."""
    import time

    import pandas as pd

    from ledgerloom.streaming import ingest as I

    class State:
        exists = False

        def update(self, value):
            self.value = value

    ts = [pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h) for h in (3, 1, 2, 0)]
    frame = pd.DataFrame({"message_id": "a", "line_no": [4, 1, 3, 2], "ts": ts, "score": [7, 5, 5, 3]})  # records: lines 1 and 4
    begun = time.process_time()
    for _ in range(500):
        (out,) = I._beat(("a",), iter([frame]), State())
    assert time.process_time() - begun < 1
    assert out.values.tolist() == [["a", 7, ts[1], None, None]]
