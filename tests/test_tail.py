"""Logs by byte range, streams that follow growing files, and the keyed parser."""

import json
import os
import random
import tempfile
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import extraction as X
from ledgerloom.operators.cube import cube
from ledgerloom.sources import tail as L
from ledgerloom.streaming import carried as C


def put(path, content, mode="wb"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(content)


def reference(content):
    """(start, end, text) of the complete lines."""
    out, at = [], 0
    while (stop := content.find(b"\n", at)) >= 0:
        out.append((at, stop + 1, content[at : stop + 1].rstrip(b"\r\n").decode("utf-8", "replace")))
        at = stop + 1
    return out


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
@pytest.mark.parametrize("chunk", [3, 1 << 20])
def test_ranges_give_each_line_once(tmp_path, monkeypatch, size, chunk):
    monkeypatch.setattr(L, "CHUNK", chunk)
    random.seed(size)
    content = b"\n\nfirst\r\n" + "é日".encode() + b"\n" + b"\n".join(b"x" * random.randrange(40) for _ in range(60)) + b"\ntail without an end"
    put(f"{tmp_path}/a/one.jsonl", content)
    put(f"{tmp_path}/empty.jsonl", b"")
    put(f"{tmp_path}/half.jsonl", b"no line end")
    put(f"{tmp_path}/other.txt", b"not asked for\n")
    reader = L.LogReader({"path": str(tmp_path), "rangebytes": str(size)})
    ranges = reader.partitions()
    rows = [tuple(r.values()) for part in ranges for batch in reader.read(part) for r in batch.to_pylist()]
    assert [(a, b, raw) for path, _, a, b, raw in sorted(rows, key=lambda r: r[2]) if path.endswith("one.jsonl")] == reference(content)
    assert len(rows) == len(reference(content)) and (size > 7 or len(ranges) > 100)


class Counted:
    """Counts the bytes that are read from files."""

    def __init__(self, monkeypatch):
        self.read = 0
        opened = L.file_system

        def counting(uri):
            fs, path = opened(uri)
            outer = self

            class Source:
                def __init__(self, f):
                    self.f = f

                def __enter__(self):
                    return self

                def __exit__(self, *_):
                    self.f.close()

                def seek(self, n):
                    self.f.seek(n)

                def read(self, n):
                    got = self.f.read(n)
                    outer.read += len(got)
                    return got

            class Files:
                def open_input_file(self, path):
                    return Source(fs.open_input_file(path))

                def __getattr__(self, name):
                    return getattr(fs, name)

            return Files(), path

        monkeypatch.setattr(L, "file_system", counting)


def test_stream_reads_only_what_is_new(tmp_path, monkeypatch):
    logs, options = f"{tmp_path}/logs", {"path": f"{tmp_path}/logs", "state": f"{tmp_path}/state", "rangebytes": "4096"}
    big = b"".join(b'{"n":%d}\n' % n for n in range(100_000))
    put(f"{logs}/big.jsonl", big + b'{"half')
    put(f"{logs}/still.jsonl", b"a\nb\n")

    def run(start):
        stream = L.LogStream(options)  # a new one, as after a restart
        end = stream.latestOffset()
        rows = [r for part in stream.partitions(start, end) for batch in stream.read(part) for r in batch.to_pylist()] if end != start else []
        return end, rows

    first, rows = run({"manifest": 0})
    assert len(rows) == 100_002 and len(L.LogStream(options).partitions({"manifest": 0}, first)) > 100
    again, rows = run(first)
    assert again == first and rows == []
    put(f"{logs}/big.jsonl", b'way":1}\nand more\n', "ab")
    counted = Counted(monkeypatch)
    second, rows = run(first)
    assert [(r["start_offset"], r["raw"]) for r in rows] == [(len(big), '{"halfway":1}'), (len(big) + 14, "and more")]
    assert counted.read < 3 * L.HEAD  # of a file of a megabyte: its head, twice, and what is new
    # a file that is written anew, one that vanishes, one that is new
    put(f"{logs}/big.jsonl", b"other\n")
    os.remove(f"{logs}/still.jsonl")
    put(f"{logs}/sub/new.jsonl", b"n\n")
    third, rows = run(second)
    assert sorted((r["raw"], r["life"], r["start_offset"]) for r in rows) == [("n", 0, 0), ("other", 1, 0)]
    # an offset that was planned and never committed: its range comes with the next one
    put(f"{logs}/sub/new.jsonl", b"o\n", "ab")
    lost = L.LogStream(options).latestOffset()
    put(f"{logs}/sub/new.jsonl", b"p\n", "ab")
    end = L.LogStream(options).latestOffset()
    stream = L.LogStream(options)
    assert lost != end and [r["raw"] for part in stream.partitions(third, end) for b in stream.read(part) for r in b.to_pylist()] == ["o", "p"]
    for n in range(12):
        put(f"{logs}/sub/new.jsonl", b"q\n", "ab")
        stream.commit(stream.latestOffset())
    assert len(os.listdir(f"{tmp_path}/state")) <= 12


def test_stream_needs_a_folder():
    with pytest.raises(ValueError):
        L.LogStream({"path": "/tmp/x"})


def test_facts_of_a_grown_file(tmp_path, monkeypatch):
    """A chained hash of any beginning; of a grown file only what follows its last whole block is read."""
    monkeypatch.setattr(L, "BLOCK", 1000)
    monkeypatch.setattr(L, "CHUNK", 700)
    path = f"{tmp_path}/a.jsonl"
    whole = b"".join(b"line %d\n" % k for k in range(900))

    def facts(content, *more):
        put(path, content)
        with pa.fs.LocalFileSystem().open_input_file(path) as f:
            return dict(zip([c.split()[0] for c in L.FACTS.split(", ")][1:], L.file_facts(f, *more)))

    def known(f):
        return tuple(f[c] for c in ("byte_offset", "lines", "complete_sha", "head_hash", "chain"))

    marks = [0, 1, 999, 1000, 1001, 5003, len(whole), len(whole) + 1]
    first = facts(whole, marks)
    assert (first["byte_offset"], first["lines"], first["content_sha"], first["resumed"]) == (len(whole), 900, first["complete_sha"], False)
    for n, sha in zip(marks, first["prefixes"]):
        assert sha == (facts(whole[:n])["content_sha"] if n <= len(whole) else None)
    for cut in (0, 3, 8, 999, 1000, 1007, 4321, len(whole)):
        before = facts(whole[:cut])
        again = facts(whole, [], known(before))
        fresh = facts(whole)
        assert {k: v for k, v in again.items() if k not in ("resumed", "read")} == {k: v for k, v in fresh.items() if k not in ("resumed", "read")}
        assert again["resumed"] == (before["byte_offset"] > 0) and (not again["resumed"] or again["read"] <= len(whole) - before["byte_offset"] + 1000)
    before = facts(whole[:4321])
    for other in (b"other\n" + whole, whole[:4200], whole[:4300] + b"?" + whole[4301:], b""):
        assert not facts(other, [], known(before))["resumed"]


def context(model):
    return json.dumps({"timestamp": "2024-01-01T00:00:00Z", "type": "turn_context", "payload": {"model": model}})


def count(day, n, total=None, out=1):
    usage = {"input_tokens": n, "cached_input_tokens": n // 2, "cache_write_input_tokens": 0, "output_tokens": out, "reasoning_output_tokens": 0, "total_tokens": n + out}
    all_of = {**usage, "total_tokens": n if total is None else total}
    return json.dumps({"timestamp": f"2024-01-{day:02d}T05:00:00Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": all_of, "last_token_usage": usage}}})


def rows_of(df):
    return Counter((r["date"], r["model"], r["input"], r["cache_read"], r["output"]) for r in df.collect())


def whole(spark, contents):
    lines = [(p, k, raw) for p, c in contents.items() for k, (_, _, raw) in enumerate(reference(c))]
    return rows_of(cube(X.to_cube_rows(X.events_a(spark.createDataFrame(lines, "path string, line_no long, raw string")))))


def test_parser_carries_its_state(spark):
    """Files cut at arbitrary bytes, one without a model for long, one that begins anew: always the cube of one whole read."""
    root = tempfile.mkdtemp(prefix="spark-tail-", dir="/tmp")
    random.seed(3)
    contents = {
        "a": [context("m1"), count(1, 10), count(2, 20), context(" "), count(2, 5), "{broken turn_context", count(3, 0, out=0)],
        "b": [count(1, 7), count(1, 8), "no json", count(2, 9), context("late"), count(2, 1), context("m1"), count(1, 2)],
        "c": [count(4, 3, 9), count(4, 3, 9), count(4, 2, 5)],
        "d": [context("m2"), count(5, 6)],
    }
    contents = {k: "".join(f"{x}\n" for x in v).encode() for k, v in contents.items()}
    marks = {k: sorted(random.sample(range(len(v)), 2)) + [len(v)] for k, v in contents.items()}
    for step in range(3):
        for k, v in contents.items():
            put(f"{root}/logs/{k}.jsonl", v[: marks[k][step]])
        C.follow_logs(spark, f"{root}/logs", f"{root}/out", f"{root}/mark").awaitTermination()
        now = {k: v[: marks[k][step]] for k, v in contents.items()}
        assert rows_of(C.cube_of_changes(spark, f"{root}/out")) == whole(spark, now), step
    found = spark.read.parquet(f"{root}/out/deltas").groupBy(F.regexp_extract("path", r"(\w+)\.jsonl", 1).alias("f")).agg(F.sum("resets").alias("resets"), F.sum("repeats").alias("repeats"))
    assert {r["f"]: (r["resets"], r["repeats"]) for r in found.collect()}["c"] == (1, 1)
    # written anew, shorter and longer; another run without a change
    contents["b"], contents["d"] = (context("m9") + "\n" + count(9, 4) + "\n").encode(), (count(1, 1) + "\n" + context("mm") + "\n").encode() * 9
    for k in "bd":
        put(f"{root}/logs/{k}.jsonl", contents[k])
    for _ in range(2):
        C.follow_logs(spark, f"{root}/logs", f"{root}/out", f"{root}/mark").awaitTermination()
        assert rows_of(C.cube_of_changes(spark, f"{root}/out")) == whole(spark, contents)


def test_batches_of_lines_are_bounded(tmp_path):
    put(f"{tmp_path}/a.jsonl", b"x\n" * (2 * L._BATCH_LINES + 1))
    reader = L.LogReader({"path": f"file:{tmp_path}"})
    sizes = [b.num_rows for part in reader.partitions() for b in reader.read(part)]
    assert sizes == [L._BATCH_LINES, L._BATCH_LINES, 1] and all(isinstance(b, pa.RecordBatch) for part in reader.partitions() for b in reader.read(part))


@pytest.mark.parametrize("size", [3, 50, 1 << 20])
def test_many_files_make_few_tasks(tmp_path, monkeypatch, size):
    """However many files and ranges there are, their tasks are bounded, and each line comes once."""
    monkeypatch.setattr(L, "MOST_TASKS", 10)
    random.seed(size)
    files = {f"f{k}": b"\n".join(b"y" * random.randrange(9) for _ in range(k % 7)) + b"\nrest" * (k % 2) for k in range(100)} | {"big": b"z\n" * 999}
    for name, content in files.items():
        put(f"{tmp_path}/logs/{name}.jsonl", content)
    reader = L.LogReader({"path": f"{tmp_path}/logs", "rangebytes": str(size)})
    options = {"path": f"{tmp_path}/logs", "state": f"{tmp_path}/state", "rangebytes": str(size)}
    stream = L.LogStream(options)
    for tasks, read in ((reader.partitions(), reader.read), (stream.partitions({"manifest": 0}, stream.latestOffset()), stream.read)):
        rows = [(r["path"].rpartition("/")[2], r["start_offset"], r["end_offset"], r["raw"]) for task in tasks for batch in read(task) for r in batch.to_pylist()]
        assert len(tasks) <= 10 and sorted(rows) == sorted((f"{name}.jsonl", *line) for name, content in files.items() for line in reference(content))


def test_a_file_s_state_is_read_and_written_once():
    """However many days and models a file is booked for, a batch makes two calls of the state store."""
    import pandas as pd

    calls, held = [], {}

    class Value:
        def get(self):
            calls.append("get")
            return held.get("v")

        def update(self, v):
            calls.append("update")
            held["v"] = v

    class Handle:
        def getValueState(self, name, schema):
            return Value()

    def batch(start, model, life=0):
        rows = [("p", life, start, model, False, None, *[0] * (len(C._TOKENS) + len(C._TOTALS)))] if model else []
        rows += [("p", life, start + k, None, True, f"2024-01-{k:02d}", *[k] * (len(C._TOKENS) + len(C._TOTALS))) for k in range(1, 29)]
        return pd.DataFrame(rows, columns=list(C.DECODED))

    parser = C.UsageParser()
    parser.init(Handle())
    sums = {}
    for frame in (batch(0, None), batch(100, "m1"), batch(0, "m2", life=1)):
        calls.clear()
        for out in parser.handleInputRows(("p",), iter([frame.sample(frac=1, random_state=1)]), None):
            for r in out.itertuples():
                sums[r.date, r.model] = sums.get((r.date, r.model), 0) + r.input
        assert sorted(calls) == ["get", "update"]
    assert {k: v for k, v in sums.items() if v} == {(f"2024-01-{k:02d}", "m2"): k for k in range(1, 29)}


def test_a_range_reads_little_beyond_its_end(tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_bytes(b"".join(b"%07d\n" % k for k in range(50_000)) + b"x" * 300_000 + b"\n")
    size, read = path.stat().st_size, []

    class Counted:
        def __init__(self, source):
            self.source = source

        def seek(self, at):
            self.source.seek(at)

        def read(self, n):
            got = self.source.read(n)
            read.append(len(got))
            return got

    seen = []
    with pa.OSFile(str(path)) as source:
        for a in range(0, size, 4000):
            seen += L.lines_of(Counted(source), L.Range(str(path), 0, a, min(size, a + 4000), size, not a))
    assert [e for _, e, _ in seen] == [8 * (k + 1) for k in range(50_000)] + [size]
    assert sum(read) < 4 * size
