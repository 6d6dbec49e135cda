"""The reports that a caller asks for: validated options in, a document out (RPT-1..20, FLT-4)."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import calendar as K
from ledgerloom.operators import cube as C
from ledgerloom.operators import pricing as P
from ledgerloom.sources.sinks import envelope

PROVIDERS = ("codex", "claude")


def options(since: str | None = None, until: str | None = None, provider: str | None = None, model: str | None = None, last: int | None = None) -> dict:
    """Checked options: real days, until not before since, a known provider, `last` not together with a range (FLT-4)."""
    for day in (since, until):
        if day is not None and (not re.fullmatch(r"\d{4}-\d{2}-\d{2}", day) or date.fromisoformat(day).isoformat() != day):
            raise ValueError(f"{day} is no day")
    if since and until and until < since:
        raise ValueError("until is before since")
    if provider is not None and provider not in PROVIDERS:
        raise ValueError(f"unknown provider {provider}")
    if last is not None and (last < 1 or since or until):
        raise ValueError("last is a positive number and excludes a range")
    return {k: v for k, v in {"since": since, "until": until, "provider": provider, "model": model, "last": last}.items() if v is not None}


def _selected(usage: DataFrame, o: dict) -> DataFrame:
    kept = C.filtered(usage, o.get("since"), o.get("until"), o.get("provider"), o.get("model"))
    return C.last_active_days(kept, o["last"]) if "last" in o else kept


#: Rows of a document that a caller reads; more of them are a table to be written.
MOST_ROWS = 10_000


def _rows(df: DataFrame) -> list[dict]:
    """A document's rows: periods or models. More than MOST_ROWS are an error; nothing is left out."""
    found = [r.asDict(recursive=True) for r in df.limit(MOST_ROWS + 1).collect()]
    if len(found) > MOST_ROWS:
        raise ValueError(f"a document has at most {MOST_ROWS} rows; take the report's table")
    return found


def _warnings(priced: DataFrame) -> list[str]:
    found = _rows(P.unpriced_models(priced).orderBy("provider", "model"))
    return [f"no rate for {r['provider']}/{r['model']}: {r['unpriced_tokens']} tokens" for r in found]


def _costed(priced: DataFrame, *by) -> DataFrame:
    return priced.groupBy(*by).agg(*C.token_sums(), *P.costs(), P.dominant_provenance(F.col("provenance"), F.col("priced_tokens")).alias("provenance"))


def daily_table(priced: DataFrame) -> DataFrame:
    return _costed(priced, "date")


def monthly_table(priced: DataFrame) -> DataFrame:
    return _costed(priced, F.substring("date", 1, 7).alias("month"))


def model_table(priced: DataFrame) -> DataFrame:
    return C.with_shares(_costed(priced, "provider", "model"))


def store_state(usage: DataFrame) -> DataFrame:
    """One row: rows, models and days of the store (AGG-32)."""
    return usage.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("model").alias("models"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def daily(usage: DataFrame, rates: DataFrame, **flags) -> dict:
    o = options(**({"last": 30} | flags if not flags.get("since") and not flags.get("until") else flags))
    priced = P.price(_selected(usage, o), rates)
    return envelope("daily", _rows(daily_table(priced).orderBy("date")), o, _warnings(priced))


def monthly(usage: DataFrame, rates: DataFrame, **flags) -> dict:
    o = options(**flags)
    priced = P.price(_selected(usage, o), rates)
    return envelope("monthly", _rows(monthly_table(priced).orderBy("month")), o, _warnings(priced))


def models(usage: DataFrame, rates: DataFrame, sort: str = "tokens", **flags) -> dict:
    """By tokens, cost or name (SRT-3)."""
    o = options(**flags)
    priced = P.price(_selected(usage, o), rates)
    rows = model_table(priced)
    order = {"tokens": [F.desc("total")], "cost": [F.desc("cost")], "name": [F.lower("model")]}[sort]
    return envelope("models", _rows(rows.orderBy(*order, "provider", "model")), o, _warnings(priced))


def summary(usage: DataFrame, rates: DataFrame, **flags) -> dict:
    o = options(**flags)
    priced = P.price(_selected(usage, o), rates)
    data = _rows(C.totals(priced))[0]
    data["cost"] = _rows(priced.agg(*P.costs()))[0]
    data["providers"] = _rows(C.by_provider(priced).orderBy("provider"))
    data["top_models"] = _rows(priced.groupBy("provider", "model").agg(*C.token_sums()).orderBy(F.desc("total"), "provider", "model").limit(5))
    return envelope("summary", data, o, _warnings(priced))


def heatmap(usage: DataFrame, rates: DataFrame, **flags) -> dict:
    """Dense days with levels and statistics, by cost; by tokens where nothing is priced."""
    o = options(**flags)
    priced = P.price(_selected(usage, o), rates)
    by = priced.groupBy("date").agg(P.checked_sum(F.col("cost")).alias("cost"), F.sum(F.col("input") + F.col("output")).alias("tokens"), F.sum("priced_tokens").alias("priced"))
    metric = "cost" if (by.agg(F.sum("priced")).first()[0] or 0) > 0 else "tokens"
    days = K.dense_days(by, metric)
    return envelope("heatmap", {"metric": metric, "days": _rows(K.levels(days, metric).orderBy("date")), "stats": _rows(K.heat_statistics(days, metric))[0]}, o, _warnings(priced))


def pages(usage: DataFrame, rates: DataFrame, model_sessions: DataFrame, today: str, matrix_days: list[str]) -> dict[str, DataFrame]:
    """What the pages of a dashboard show, each as a table over one priced cube: days with levels, statistics, streaks, rails, months, models, models by day (RPT-19)."""
    from ledgerloom.plans.history_reports import model_page

    priced = P.price(usage, rates)
    days = priced.groupBy("date").agg(P.checked_sum(F.col("cost")).alias("cost"))
    return {
        "totals": C.totals(usage), "days": K.levels(days, "cost"), "statistics": K.heat_statistics(days, "cost"), "streaks": K.streaks(days, "cost"), "rails": K.rails(days, today),
        "months": K.year_grid(days), "trend": K.week_over_week(days, "cost"), "models": model_page(priced, model_sessions, today), "matrix": K.matrix(priced, matrix_days), "unpriced": P.unpriced_models(priced),
    }


def pricing(rates: DataFrame) -> dict:
    return envelope("pricing", _rows(rates.orderBy("model", F.coalesce("effective_from", F.lit("")))))


def doctor(usage: DataFrame, manifest: DataFrame) -> dict:
    """Counts and bounds of what there is (RPT-9, AGG-32)."""
    store = store_state(usage)
    vault = manifest.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return envelope("doctor", {"store": _rows(store)[0], "vault": _rows(vault)[0]})
