"""Documents of reports: nothing is left out, and the dashboard's pages come from one cube."""

import pytest

from ledgerloom.operators import pricing as P
from ledgerloom.plans import reports as Y

USAGE = "date string, provider string, model string, input long, cache_read long, cache_write_5m long, cache_write_1h long, cache_write_unclassified long, output long, reasoning long"


@pytest.fixture(scope="module")
def usage(spark):
    rows = [(f"2026-01-0{k}", "codex", f"m{k % 2}", 10 * k, 0, 0, 0, 0, k, 0) for k in range(1, 6)] + [("2026-01-03", "claude", "x", 7, 0, 0, 0, 0, 1, 0)]
    return spark.createDataFrame(rows, USAGE)


@pytest.fixture(scope="module")
def rates(spark):
    return P.rate_table(spark, [("m0", 10, 1, None, None, 20, "published", None, None), ("m1", 30, 1, None, None, 40, "proxy", None, None)])


def test_documents_are_whole_or_fail(usage, rates, monkeypatch):
    made = Y.daily(usage, rates)
    assert [r["date"] for r in made["data"]] == [f"2026-01-0{k}" for k in range(1, 6)] and made["warnings"] == ["no rate for claude/x: 8 tokens"]
    assert {r["model"]: r["cost"] for r in Y.models(usage, rates, "cost")["data"]} == {"m0": 60 * 10 + 6 * 20, "m1": 90 * 30 + 9 * 40, "x": 0}
    monkeypatch.setattr(Y, "MOST_ROWS", 4)
    with pytest.raises(ValueError):
        Y.daily(usage, rates)


def test_row_whose_sum_passes_64_bits(spark):
    rates = P.rate_table(spark, [("m", 2**62, None, None, None, 2**62, "published", None, None)])
    rows = [("2026-01-01", "p", "m", 1, 0, 0, 0, 0, 1, 0), ("2026-01-01", "p", "m", 1, 0, 0, 0, 0, 0, 0)]
    got = [(r.cost, r.priced_tokens, r.unpriced_tokens, r.provenance) for r in P.price(spark.createDataFrame(rows, USAGE), rates).orderBy("output").collect()]
    assert got == [(2**62, 1, 0, "published"), (0, 0, 2, None)]


def test_pages(spark, usage, rates):
    sessions = spark.createDataFrame([("codex", "m0", 2)], "provider string, model string, sessions long")
    made = Y.pages(usage, rates, sessions, "2026-01-05", ["2026-01-04", "2026-01-05"])
    found = {k: df.collect() for k, df in made.items()}
    assert found["totals"][0].input == 157 and len(found["days"]) == 5 and found["statistics"][0].active_days == 5
    assert found["rails"][0].today == 50 * 30 + 5 * 40 and {r.model for r in found["models"]} == {"m0", "m1", "x"} and found["unpriced"][0].model == "x"
