"""Pricing of a token cube with effective-dated rates, in exact integer money (PRC-*, JN-10, AGG-7..9, AGG-24)."""

from __future__ import annotations

import hashlib
import json
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.money import checked_product, weighted_rate
from ledgerloom.operators.cube import BUCKETS

RATE_SCHEMA = "model string, base_input long, cache_read long, write_5m long, write_1h long, output long, status string, effective_from string, effective_until string"
RATES = ("base_input", "cache_read", "write_5m", "write_1h", "output")
STATUSES = ("user", "published", "proxy", "estimated")  # in order of precedence on ties
MAX_RATE_ROWS = 100_000


def rate_table(spark: SparkSession, entries: list[tuple]) -> DataFrame:
    """Validated rates (RATE_SCHEMA): known status, non-negative rates, ranges of a model that don't overlap (SRC-10)."""
    spans: dict[str, list[tuple[str, str]]] = {}
    for e in entries:
        model, rates, status, first, last = e[0], e[1:6], e[6], e[7] or "", e[8] or "9999-12-31"
        if status not in STATUSES or any(r is not None and r < 0 for r in rates) or first > last:
            raise ValueError(f"bad rate entry for {model}")
        spans.setdefault(model, []).append((first, last))
    for model, own in spans.items():
        own.sort()
        if any(a[1] >= b[0] for a, b in zip(own, own[1:])):
            raise ValueError(f"rates of {model} overlap")
    if len(entries) > MAX_RATE_ROWS:
        raise ValueError("a rate table is small")
    return spark.createDataFrame(entries, RATE_SCHEMA)


def overlay(rates: DataFrame, override: DataFrame) -> DataFrame:
    """The override's models replace all entries of theirs (PRC-4)."""
    return rates.join(_small(override.select("model").distinct()), "model", "left_anti").unionByName(override)


def _small(rates: DataFrame) -> DataFrame:
    """Broadcast if counted to be at most MAX_RATE_ROWS rows; else Spark decides how to join."""
    return F.broadcast(rates) if rates.limit(MAX_RATE_ROWS + 1).count() <= MAX_RATE_ROWS else rates


def user_rates(spark: SparkSession, rates: dict[str, dict[str, int]]) -> DataFrame:
    """User rates as entries without dates; cache rates that aren't given stay null (SRC-11, PRC-9)."""
    rows = []
    for model, r in sorted(rates.items()):
        if {"input", "output"} - r.keys() or r.keys() - {"input", "output", "cache_read", "cache_write"}:
            raise ValueError(f"rates of {model}: input and output are required, cache_read and cache_write allowed")
        rows.append((model, r["input"], r.get("cache_read"), r.get("cache_write"), r.get("cache_write"), r["output"], "user", None, None))
    return rate_table(spark, rows)


def fingerprint(entries: list[tuple]) -> str:
    """Hash of the effective entries: a cache key (PRC-5)."""
    return hashlib.sha256(json.dumps(sorted(map(list, entries), key=lambda e: (e[0], e[7] or "")), separators=(",", ":")).encode()).hexdigest()


def with_rates(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """usage left join rates on model and date in [from, until], open ends allowed; at most one entry fits (JN-10).

    A rate table is small, which is counted, so it is broadcast and the join is a hash join on model.
    """
    r = _small(rates.withColumnsRenamed({"model": "_model", **{c: f"rate_{c}" for c in RATES}}))
    fits = (F.col("model") == F.col("_model")) & (F.col("effective_from").isNull() | (F.col("date") >= F.col("effective_from"))) & (F.col("effective_until").isNull() | (F.col("date") <= F.col("effective_until")))
    return usage.join(r, fits, "left").drop("effective_from", "effective_until")


def row_cost(rated: DataFrame) -> DataFrame:
    """cost (nanodollars), priced_tokens, unpriced_tokens, provenance of every row (PRC-1, PRC-6).

    base input = input less cache reads and writes; unclassified writes take the one-hour rate; a bucket without tokens
    counts nowhere; a null rate, an overflow or negative tokens make a bucket unpriced.
    """
    base = F.col("input") - F.col("cache_read") - F.col("cache_write_5m") - F.col("cache_write_1h") - F.col("cache_write_unclassified")
    buckets: list[tuple[Column, str]] = [
        (base, "rate_base_input"), (F.col("cache_read"), "rate_cache_read"), (F.col("cache_write_5m"), "rate_write_5m"),
        (F.col("cache_write_1h"), "rate_write_1h"), (F.col("cache_write_unclassified"), "rate_write_1h"), (F.col("output"), "rate_output"),
    ]
    money = [checked_product(tokens, F.col(rate)) for tokens, rate in buckets]
    whole = reduce(add, [F.coalesce(m, F.lit(0)).cast("decimal(38,0)") for m in money])
    fits = whole <= 9223372036854775807  # a row whose sum passes 64 bits is unpriced
    zero = F.lit(0).cast("long")
    priced = reduce(add, [F.when(m.isNotNull() & fits & (t != 0), t).otherwise(zero) for m, (t, _) in zip(money, buckets)])
    unpriced = reduce(add, [F.when((m.isNull() | ~fits) & (t != 0), t).otherwise(zero) for m, (t, _) in zip(money, buckets)])
    out = rated.withColumns({"cost": F.when(fits, whole.cast("long")).otherwise(zero), "priced_tokens": priced, "unpriced_tokens": unpriced})
    return out.withColumn("provenance", F.when(F.col("priced_tokens") > 0, F.col("status")))


def price(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """usage with cost, priced_tokens, unpriced_tokens and provenance."""
    return row_cost(with_rates(usage, rates)).drop("_model", "status", *[f"rate_{c}" for c in RATES])


def checked_sum(money: Column) -> Column:
    """Sum of money; null if it passes 64 bits (AGG-9: the whole sum is then unpriced, whatever the order)."""
    total = F.sum(money.cast("decimal(38,0)"))
    return F.when(F.abs(total) <= 9223372036854775807, total.cast("long"))


def dominant_provenance(status: Column, tokens: Column) -> Column:
    """The status of most priced tokens; any user tokens win; ties by precedence (AGG-8)."""
    amount = {s: F.sum(F.when(status == s, tokens).otherwise(0)) for s in STATUSES}
    ranked = F.array(*[F.struct(amount[s].alias("n"), F.lit(-k).alias("k"), F.lit(s).alias("s")) for k, s in enumerate(STATUSES)])
    best = F.array_max(ranked)
    return F.when(amount["user"] > 0, "user").when(best["n"] > 0, best["s"])


def costs() -> list[Column]:
    return [F.coalesce(checked_sum(F.col("cost")), F.lit(0)).alias("cost"), F.sum("priced_tokens").alias("priced_tokens"), F.sum("unpriced_tokens").alias("unpriced_tokens")]


def cost_rollup(priced: DataFrame) -> DataFrame:
    """All granularities in one pass: grand, date, month, provider, model, date x provider, month x provider (AGG-7)."""
    p = priced.withColumn("month", F.substring("date", 1, 7))
    c = {n: F.col(n) for n in ("date", "month", "provider", "model")}
    sets = [[], [c["date"]], [c["month"]], [c["provider"]], [c["provider"], c["model"]], [c["date"], c["provider"]], [c["month"], c["provider"]]]
    return p.groupingSets(sets, *c.values()).agg(*costs())


def provenance_rollup(priced: DataFrame) -> DataFrame:
    """Models, cost and tokens of each status (AGG-24)."""
    rows = priced.filter("priced_tokens > 0")
    return rows.groupBy("provenance").agg(F.count_distinct("provider", "model").alias("models"), checked_sum(F.col("cost")).alias("cost"), F.sum("priced_tokens").alias("tokens"))


def listing(rates: DataFrame) -> DataFrame:
    """The entries of each model in order of their first day, numbered from 1 (PRC-8)."""
    w = Window.partitionBy("model").orderBy(F.coalesce("effective_from", F.lit("")))
    return rates.withColumn("place", F.row_number().over(w).cast("long"))


def unpriced_models(priced: DataFrame) -> DataFrame:
    """Models with unpriced tokens, most first (PRC-7)."""
    return priced.groupBy("provider", "model").agg(F.sum("unpriced_tokens").alias("unpriced_tokens")).filter("unpriced_tokens <> 0")


def weighted_rates(priced: DataFrame) -> DataFrame:
    """Average rate by model over what is priced (FN-6)."""
    g = priced.groupBy("provider", "model").agg(checked_sum(F.col("cost")).alias("cost"), F.sum("priced_tokens").alias("priced_tokens"))
    return g.withColumn("rate", weighted_rate(F.col("cost"), F.col("priced_tokens")))


def nearest_models(name: str, models: DataFrame, k: int = 3, distance: int = 2) -> DataFrame:
    """Up to k known names within an edit distance (SRT-15)."""
    d = F.levenshtein(F.lower("model"), F.lit(name.lower()))
    return models.select("model", d.cast("long").alias("distance")).filter(F.col("distance") <= distance).orderBy("distance", "model").limit(k)


def cap_models(session_models: DataFrame, cap: int = 32) -> DataFrame:
    """The costliest rows of each session (PRC-11)."""
    w = Window.partitionBy("session_id").orderBy(F.desc("cost"), "date", "provider", "model")
    return session_models.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cap)


TOKENS = BUCKETS
