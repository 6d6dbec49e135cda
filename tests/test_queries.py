"""Registered queries against their oracles on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [
    "report_daily", "report_models", "previews", "usage_events_a", "log_diagnostics_a", "resumed_usage_a", "usage_events_b", "prompts_of_rollouts_a", "prompts_of_rollouts_b", "transcripts_a", "transcripts_b", "positioned_lines", "lines_from_a_checkpoint",
    "appended_and_rewritten", "indexed_bm25", "rate_listing", "newest_kept", "stale_index", "search_hits", "cost_rollup", "priced_rows", "retract_by_difference", "heat_levels", "heat_statistics", "year_grid", "model_attribution", "progressive_snapshots", "prompt_listing",
    "statistics_by_repository", "top_projects_and_other", "bm25", "boolean_search", "stratified_sample", "session_representatives", "resolved_edges", "session_tree", "vault_readiness", "vault_page",
]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, db, name):
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    found = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    want = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    rows = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall())
    assert found == rows


def test_search_hits_are_not_a_page(spark, monkeypatch):
    from ledgerloom.plans import corpus_queries as Q

    prompts = spark.range(700).selectExpr("id AS prompt_id", "id AS turn", "timestamp'2024-01-10' AS ts", "concat('the word ', id) AS text", "true AS searchable", "'user' AS role", "'human' AS kind", "'s' AS session_id")
    monkeypatch.setattr(Q.B, "prompts", lambda spark, d: prompts)
    monkeypatch.setattr(Q.B, "occurrences", lambda spark, d: prompts.selectExpr("prompt_id", "true AS available"))
    assert entry.queries()["search_hits"](spark, "").count() == 700


def test_whole_previews_cut_at_a_character(spark, tmp_path):
    texts = [pad + c * 400 + tail for pad in ("", "a", "ab", "abc") for c in ("x", "é", "€", "😀") for tail in ("", "\nend")]
    texts += ["l\n" * 9, "\n" + "é\n" * 300, "€" * 170 + "ab", "€" * 170 + "é", "€" * 170 + "abc", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def brute(text):
        raw, cut = "\n".join(text.split("\n")[:4]).encode(), 512
        while cut < len(raw) and raw[cut] & 0xC0 == 0x80:
            cut -= 1
        return raw[:cut].decode()

    got = {r.doc_id: r["head"] for r in entry.queries()["previews"](spark, str(tmp_path)).collect()}
    assert got == {k: None if t is None else brute(t) for k, t in enumerate(texts)}


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 90


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_entry(spark):
    assert entry.entry(spark).count() == 30
