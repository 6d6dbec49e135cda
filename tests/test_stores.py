"""Bucketed tables, maintained counts, the partly written ledger, the cost cache, seekable tables, merges."""

import os
import tempfile
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import merging as M
from ledgerloom.operators import pagination as N
from ledgerloom.operators import sampling as S
from ledgerloom.operators import seekable as Q
from ledgerloom.plans import bindings as B
from ledgerloom.plans import cost_cache, jobs
from ledgerloom.sources import buckets as K
from ledgerloom.sources.scratch import new_folder
from tests.test_tail import context, count, put


def test_counts_equal_a_recount_and_touch_little(spark):
    root, kinds = new_folder(spark, "counts"), "g string, h long"
    rng = np.random.default_rng(1)
    rows = {k: (None if k % 7 == 0 else f"g{k % 50}", int(k % 3)) for k in range(400)}
    at, before = 0, {}

    def frame(held):
        return spark.createDataFrame([(k, *v) for k, v in held.items()], "k long, g string, h long")

    steps = [dict(rows)]
    steps.append({**rows, 5: ("other", 9), 1000: ("g1", 1)})  # one changes, one comes
    steps.append({k: v for k, v in steps[-1].items() if k not in (5, 6)})  # two go
    steps.append(dict(steps[-2]))  # and come back
    steps += [dict(steps[-1]), {}]
    for step, after in enumerate(steps):
        last = K.manifest(spark, root, at)
        at = K.add_counts(spark, root, at, K.signed_changes(frame(before), frame(after), "k", ["g", "h"]), ["g", "h"], kinds)
        got = Counter({(r["g"], r["h"]): r["n"] for r in K.read(spark, root, at, f"{kinds}, n long").collect()})
        assert got == Counter(after.values()), step
        now = K.manifest(spark, root, at)
        written = {b for b in set(now) | set(last) if now.get(b) != last.get(b)}
        if step in (1, 2, 3):
            assert len(written) <= 4
        if step == 4:
            assert not written
        before = after
    assert int(rng.integers(10)) >= 0 and K.read(spark, root, 1, f"{kinds}, n long").count() == len(set(rows.values()))  # an old generation stays


def test_sync_writes_the_buckets_of_what_changed(spark):
    root = tempfile.mkdtemp(prefix="spark-sync-", dir="/tmp")
    for k in range(40):
        put(f"{root}/logs/f{k}.jsonl", (context(f"m{k}") + "\n" + count(1 + k % 20, 10 + k) + "\n").encode())
    g, _ = jobs.sync(spark, f"{root}/logs", f"{root}/store", 0)
    before = K.manifest(spark, f"{root}/store/ledger", g)
    put(f"{root}/logs/f3.jsonl", (count(2, 5) + "\n").encode(), "ab")
    g, counts = jobs.sync(spark, f"{root}/logs", f"{root}/store", g)
    after = K.manifest(spark, f"{root}/store/ledger", g)
    assert counts["appended"] == 1 and len([b for b in after if after[b] != before.get(b)]) == 1
    got = {(r["date"], r["model"], r["input"]) for r in jobs.usage(spark, f"{root}/store", g).collect()}
    want = {(f"2024-01-{1 + k % 20:02d}", f"m{k}", 10 + k) for k in range(40)} | {("2024-01-02", "m3", 5)}
    assert got == want
    os.remove(f"{root}/logs/f4.jsonl")  # vanished: it keeps what it gave
    g, _ = jobs.sync(spark, f"{root}/logs", f"{root}/store", g)
    assert K.manifest(spark, f"{root}/store/ledger", g) == after
    assert {(r["date"], r["model"], r["input"]) for r in jobs.usage(spark, f"{root}/store", g).collect()} == want


EVENT = "session_id long, ts timestamp, provider string, model string, input long, cache_read long, cache_write_5m long, cache_write_1h long, cache_write_unclassified long, output long, reasoning long"


def test_cost_cache(spark, monkeypatch):
    model = B.rate_entries()[0][0]
    events = [(s, datetime(2024, 1, 1 + d), "codex", model, 100 * s + d, 0, 0, 0, 0, 7, 0) for s in range(1, 6) for d in range(3)]
    sessions = spark.createDataFrame([(k,) for k in range(0, 6)], "session_id long")
    rates, store = B.rates(spark), new_folder(spark, "costs")

    def call(at, rows, fingerprint="r1", who=sessions, **window):
        at, found, counts = cost_cache.session_costs(spark, store, at, spark.createDataFrame(rows, EVENT), rates, fingerprint, who, **window)
        from ledgerloom.operators import attribution as A

        kept = A.in_window(spark.createDataFrame(rows, EVENT), window.get("since"), window.get("until"))[0] if window else spark.createDataFrame(rows, EVENT)
        columns = sorted(found.columns)
        assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, A.session_costs(kept, rates, who).select(columns).collect()))
        return at, counts["priced"]

    at, priced = call(0, events)
    assert priced == 6
    at, priced = call(at, list(reversed(events)))
    assert priced == 0  # the same events in another order
    changed = [e if e[0] != 2 else (*e[:4], e[4] + 1, *e[5:]) for e in events]
    at, priced = call(at, changed)
    assert priced == 1
    at, priced = call(at, events)
    assert priced == 0  # the older result is still there
    at, priced = call(at, events, "r2")
    assert priced == 6
    at, priced = call(at, events, "r2", since="2024-01-02")
    assert priced == 6
    at, priced = call(at, events, "r2", who=sessions.filter("session_id < 3"))
    assert priced == 0 and {r["session_id"] for r in spark.read.parquet(f"{store}/generation={at}/costs").collect()} == {0, 1, 2}
    monkeypatch.setattr(cost_cache, "MOST_OF_SESSION", 2)
    monkeypatch.setattr(cost_cache, "MOST", 4)
    at, priced = call(at, events, "r3")
    assert priced == 6 and spark.read.parquet(f"{store}/generation={at}/costs").count() == 4


def test_pages_read_few_files(spark):
    rng = np.random.default_rng(3)
    rows = [(k, None if k % 17 == 0 else int(rng.integers(50)), f"t{k}") for k in range(3000)]
    df, keys = spark.createDataFrame(rows, "id long, at long, t string"), [("at", True), ("id", False)]
    path = new_folder(spark, "sorted")
    Q.write(df, keys, path, 100)
    files = spark.read.parquet(f"{path}/files").count()
    assert files > 20
    for last in (None, [25, 0], [25, 1500], [0, 2999], [None, 1700], [None, 2999]):
        table = Q.open_sorted(spark, path, keys)
        got = [tuple(r) for r in table.page(40, last).collect()]
        assert got == [tuple(r) for r in N.page(df, keys, 40, last).collect()]
        assert len(table.opened) <= 4
    table, seen, last = Q.open_sorted(spark, path, keys), [], None
    for _ in range(3000 // 500 + 1):
        page = [tuple(r) for r in table.page(500, last).collect()][:500]
        seen += page
        last = [page[-1][1], page[-1][0]] if page else last
    assert sorted(seen) == sorted(rows) and len(seen) == 3000


def test_walks_read_few_files(spark):
    units = spark.createDataFrame([(k,) for k in range(2000)], "unit long")
    path = new_folder(spark, "sampled")
    Q.write_sampled(units, "unit", path, 100)
    for seed in ("a", "b", "c", "d"):
        found, opened = Q.walk(spark, path, "unit", 30, seed)
        assert [tuple(r) for r in found.collect()] == [tuple(r) for r in S.random_sample(units, "unit", 30, seed).select(*found.columns).collect()]
        assert len(opened) <= 5
    monkey = S.pivot
    try:
        Q.pivot = S.pivot = lambda seed: "ffffffffffffffff"  # past all: the walk begins with the lowest
        found, opened = Q.walk(spark, path, "unit", 30, "x")
        assert [tuple(r) for r in found.collect()] == [tuple(r) for r in S.random_sample(units, "unit", 30, "x").select(*found.columns).collect()] and len(opened) <= 5
    finally:
        Q.pivot = S.pivot = monkey


def test_chains_are_flattened(spark):
    pairs = [(k, k - 1) for k in range(1, 40)] + [(100, 50), (50, 7), (200, 200), (7, 6)]
    got = {r["donor"]: r["canonical"] for r in M.flattened(spark.createDataFrame(pairs, "donor long, recipient long")).collect()}
    assert got == {**{k: 0 for k in range(1, 40)}, 100: 0, 50: 0}
    with pytest.raises(ValueError):
        M.flattened(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "donor long, recipient long"))
    assert M.flattened(spark.createDataFrame([], "donor long, recipient long")).collect() == []


def test_merged_sessions(spark):
    make = spark.createDataFrame
    m = M.merge_sessions(
        make([(3, 2), (2, 1), (9, 1)], "donor long, recipient long"),
        make([(1, "b", "c", None, "x"), (2, "a", "c", "repo2", None), (3, "b", "d", "repo3", None), (4, "q", "q", "r4", "y")], "session_id long, first_ts string, last_ts string, repository string, cwd string"),
        make([(10, 1, "k1"), (20, 2, "k1"), (21, 2, "k2"), (30, 3, "k2"), (31, 3, "k3"), (40, 4, "k1")], "prompt_id long, session_id long, logical_key string"),
        make([(10, 1), (20, 1), (20, 2), (21, 3), (30, 3), (30, 4), (40, 5)], "prompt_id long, location_id long"),
        make([(3, 4, "fork"), (2, 4, "fork"), (2, 1, "fork"), (4, 3, "subagent")], "child long, parent long, kind string"),
        make([(3, 4, "fork", 1), (2, 4, "fork", 1), (2, 4, "fork", 2)], "child long, parent long, kind string, location_id long"),
        make([(77, 3, "session"), (78, 30, "prompt"), (79, 4, "session"), (80, 21, "session")], "alias long, canonical long, kind string"),
    )
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(m.sessions) == [(1, "a", "d", "repo2", "x"), (4, "q", "q", "r4", "y")]
    assert rows(m.prompts) == [(10, 1, "k1"), (21, 1, "k2"), (31, 1, "k3"), (40, 4, "k1")]
    assert rows(m.occurrences) == [(10, 1), (10, 2), (21, 3), (21, 4), (40, 5)]
    assert rows(m.edges) == [(1, 4, "fork"), (4, 1, "subagent")]
    assert rows(m.supports) == [(1, 4, "fork", 1), (1, 4, "fork", 2)]
    assert rows(m.aliases) == sorted([(77, 1, "session"), (78, 21, "prompt"), (79, 4, "session"), (80, 21, "session"), (2, 1, "session"), (3, 1, "session"), (20, 10, "prompt"), (30, 21, "prompt")])


def test_sorted_table_has_few_ranges_and_small_files(spark, monkeypatch):
    """Ranges are bounded and files are not: each has as many rows as asked for, in the order of the keys."""
    from ledgerloom.operators import seekable
    from ledgerloom.sources.scratch import new_folder

    monkeypatch.setattr(seekable, "MOST_RANGES", 3)
    path, keys = new_folder(spark, "sorted"), [("v", True), ("id", False)]
    rows = spark.range(1000).selectExpr("id", "if(id % 50 = 0, null, id % 7) AS v")
    seekable.write(rows, keys, path, 20)
    files = spark.read.parquet(f"{path}/files").collect()
    assert sum(r["rows"] for r in files) == 1000 and max(r["rows"] for r in files) <= 20 and len({r["file"].rpartition("/")[2].split("-")[1] for r in files}) <= 3
    want = sorted(((r["id"], r["v"]) for r in rows.collect()), key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    table, last, got = seekable.open_sorted(spark, path, keys), None, []
    for _ in range(3):
        page = [(r["id"], r["v"]) for r in table.page(100, last).collect()][:100]
        got, last = got + page, [page[-1][1], page[-1][0]]
    assert got == want[:300]


def test_all_pages_are_those_of_a_walk(spark, tmp_path):
    rows = spark.createDataFrame([(k, None if k % 9 == 0 else float(k % 5)) for k in range(103)], "id long, v double")
    keys = [("v", True), ("id", False)]
    Q.write(rows, keys, str(tmp_path / "t"), 10)  # pages lie across files
    got = Q.paged(spark, str(tmp_path / "t"), keys, 7, "f", 3).collect()
    page, cursor = 0, None
    while page == 0 or cursor:
        found = N.page(rows, keys, 7, N.decode_cursor(cursor, "f", 3) if cursor else None).collect()
        assert {r.id for r in found[:7]} == {r.id for r in got if r.page == page} and {r.cursor for r in got if r.page == page} == {cursor}
        cursor = N.encode_cursor([found[6].v, found[6].id], "f", 3) if len(found) > 7 else None
        page += 1
    assert page == 15 and len(got) == 103


def test_events_by_session_are_read_without_a_shuffle(spark):
    events = spark.createDataFrame([(k % 7, k) for k in range(100)], "session_id long, input long")
    kept = cost_cache.by_session(events)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, events.collect()))
    plan = cost_cache.content_hashes(kept)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and sorted(map(tuple, cost_cache.content_hashes(kept).collect())) == sorted(map(tuple, cost_cache.content_hashes(events).collect()))
