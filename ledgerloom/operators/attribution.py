"""Costs of sessions, and comparisons of what should agree (PRC-10..12, AGG-27, AGG-40..43, JN-5, JN-8, JN-12, SRT-13..14, FLT-16, FLT-23)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.money import div
from ledgerloom.operators import pricing as P
from ledgerloom.operators.cube import sums

PREFERENCE = ("provider_live", "provider_archive", "vault")
MOST_CANDIDATES = 3


def preferred_locations(locations: DataFrame, key: str = "session_id", k: int = MOST_CANDIDATES) -> DataFrame:
    """Up to k readable places of each session, live before archive before vault, newest first (SRT-14, PRC-10)."""
    order = F.array_position(F.array(*[F.lit(p) for p in PREFERENCE]), F.col("kind"))
    w = Window.partitionBy(key).orderBy(order, F.desc("recency"), "location_id")
    return locations.filter("available").withColumn("choice", F.row_number().over(w)).filter(F.col("choice") <= k)


def session_usage(events: DataFrame) -> DataFrame:
    """UTC date x provider x model rows of each session; events without a time keep the date 'unknown' (AGG-27)."""
    day = F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("unknown"))
    return events.groupBy("session_id", day.alias("date"), "provider", "model").agg(*sums())


def session_costs(events: DataFrame, rates: DataFrame, sessions: DataFrame) -> DataFrame:
    """cost, tokens and attribution of every session: complete, incomplete (something unpriced) or no_usage_events (PRC-10)."""
    priced = P.price(session_usage(events), rates)
    by = priced.groupBy("session_id").agg(*P.costs(), F.sum(F.col("input") + F.col("output")).alias("tokens"))
    state = F.when(F.col("tokens").isNull(), "no_usage_events").when(F.col("unpriced_tokens") != 0, "incomplete").otherwise("complete")
    return sessions.select("session_id").join(by, "session_id", "left").withColumn("attribution_status", state).fillna(0, ["cost", "priced_tokens", "unpriced_tokens", "tokens"])


def in_window(events: DataFrame, since: str | None, until: str | None) -> tuple[DataFrame, DataFrame]:
    """Events inside the bounds, and one row of what has no time: how many and how many tokens (FLT-16)."""
    kept = events.filter("ts is not null")
    kept = kept.filter(F.col("ts") >= F.lit(since).cast("timestamp")) if since else kept
    kept = kept.filter(F.col("ts") <= F.lit(until).cast("timestamp")) if until else kept
    lost = events.agg(F.count_if(F.col("ts").isNull()).alias("events"), F.coalesce(F.sum(F.when(F.col("ts").isNull(), F.col("input") + F.col("output"))), F.lit(0)).alias("tokens"))
    return kept, lost


def provider_mix(priced: DataFrame) -> DataFrame:
    """Share of each provider by cost, or by unpriced tokens if nothing is priced (AGG-40)."""
    g = priced.groupBy("provider").agg(P.checked_sum(F.col("cost")).alias("cost"), F.sum("priced_tokens").alias("priced_tokens"), F.sum("unpriced_tokens").alias("unpriced_tokens"))
    whole = g.agg(P.checked_sum(F.col("cost")).alias("_c"), F.sum("priced_tokens").alias("_p"), F.sum("unpriced_tokens").alias("_u"))
    share = F.when(F.col("_p") > 0, F.col("cost") / F.nullif("_c", F.lit(0))).otherwise(F.col("unpriced_tokens") / F.nullif("_u", F.lit(0)))
    return g.join(F.broadcast(whole)).select("provider", "cost", F.round(F.coalesce(share, F.lit(0.0)) * 100, 6).alias("share"))


def averages(days: DataFrame, value: str = "cost") -> DataFrame:
    """Integer average of an active day, and the day of the most (the first of equals) (AGG-41)."""
    active = days.filter(F.col(value) > 0)
    peak = F.max_by("date", F.struct(F.col(value), -F.unix_date(F.to_date("date"))))
    return active.agg(div(F.sum(value), F.count_distinct("date")).alias("average"), peak.alias("peak_day"))


def differences(want: DataFrame, got: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys of either side with state: equal, different, missing or extra (JN-12)."""
    a, b = want.select(*key, F.col(value).alias("want")), got.select(*key, F.col(value).alias("got"))
    state = F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("want") == F.col("got"), "equal").otherwise("different")
    return a.join(b, key, "full_outer").withColumn("state", state)


def same_content(live: DataFrame, vaulted: DataFrame) -> DataFrame:
    """Live rows whose bytes the vault holds for the same session (JN-8)."""
    return live.join(vaulted.select("session_id", "content_sha256"), ["session_id", "content_sha256"], "left_semi")


def project_statistics(sessions: DataFrame, k: int = 20) -> DataFrame:
    """Projects by sessions (SRT-13)."""
    g = sessions.filter("coalesce(project, '') <> ''").groupBy("project").agg(F.count(F.lit(1)).alias("sessions"))
    return g.orderBy(F.desc("sessions"), F.lower("project"), "project").limit(k)


def missing_state(heads: DataFrame) -> DataFrame:
    """Sessions without an available head: how many of their heads are settled and how many not (AGG-43)."""
    g = heads.groupBy("session_id").agg(F.count_if("available").alias("_a"), F.count_if(~F.col("available") & F.col("settled")).alias("settled"), F.count_if(~F.col("available") & ~F.col("settled")).alias("unsettled"))
    return g.filter("_a = 0").drop("_a")


def due(last: Column, now: Column, hours: int) -> Column:
    """Never tried, or tried long enough ago (FLT-23)."""
    return last.isNull() | (F.unix_timestamp(now) - F.unix_timestamp(last) >= hours * 3600)


def run_counters(kinds: DataFrame) -> DataFrame:
    """One row of what a run met (AGG-47)."""
    return kinds.agg(F.count(F.lit(1)).alias("scanned"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("new", "unchanged", "appended", "rewritten", "missing")])
