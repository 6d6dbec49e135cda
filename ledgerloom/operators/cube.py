"""The day x provider x model cube: sums, reports' groupings, ledger and retraction (AGG-1..6, ING-18, DML-1..2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = ("input", "cache_read", "cache_write_5m", "cache_write_1h", "cache_write_unclassified", "output", "reasoning")
KEY = ("date", "provider", "model")


def sums(names: tuple[str, ...] = BUCKETS) -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names]


def token_sums() -> list[Column]:
    """Nine sums: the buckets and the derived cache_write and total; nothing counts as 0 (AGG-1)."""
    write = F.col("cache_write_5m") + F.col("cache_write_1h") + F.col("cache_write_unclassified")
    return [*sums(), F.coalesce(F.sum(write), F.lit(0)).cast("long").alias("cache_write"), F.coalesce(F.sum(F.col("input") + F.col("output")), F.lit(0)).cast("long").alias("total")]


def cube(events: DataFrame) -> DataFrame:
    """Events or a ledger of contributions -> one row a day, provider and model; all-zero rows are no rows (DML-1)."""
    return events.groupBy(*KEY).agg(*sums()).filter(" or ".join(f"{c} <> 0" for c in BUCKETS))


def filtered(usage: DataFrame, since: str | None = None, until: str | None = None, provider: str | None = None, model: str | None = None) -> DataFrame:
    """Inclusive day range, provider and model, each optional (FLT-1)."""
    for condition, value in ((F.col("date") >= since, since), (F.col("date") <= until, until), (F.col("provider") == provider, provider), (F.col("model") == model, model)):
        usage = usage.filter(condition) if value is not None else usage
    return usage


def daily(usage: DataFrame) -> DataFrame:
    return usage.groupBy("date").agg(*token_sums())


def monthly(usage: DataFrame) -> DataFrame:
    return usage.groupBy(F.substring("date", 1, 7).alias("month")).agg(*token_sums())


def by_model(usage: DataFrame) -> DataFrame:
    """With active days and range (AGG-5)."""
    return usage.groupBy("provider", "model").agg(*token_sums(), F.count_distinct("date").alias("active_days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def with_shares(models: DataFrame, amount: str = "total") -> DataFrame:
    """Share of the grand total in percent, one decimal (WIN-5, FN-3)."""
    whole = models.agg(F.sum(amount).alias("_whole"))  # one row
    share = F.when(F.col("_whole") == 0, 0.0).otherwise(F.round(F.col(amount) / F.col("_whole") * 1000) / 10)
    return models.join(F.broadcast(whole)).withColumn("share", share).drop("_whole")


def breakdown(usage: DataFrame, date: str) -> DataFrame:
    """One day: models, providers and the grand total in one pass (AGG-3)."""
    day = usage.filter(F.col("date") == date)
    p, m = F.col("provider"), F.col("model")
    return day.groupingSets([[p, m], [p], []], p, m).agg(*token_sums())


def totals(usage: DataFrame) -> DataFrame:
    """One row, also of nothing (AGG-6)."""
    return usage.agg(*token_sums(), F.count_distinct("date").alias("active_days"), F.coalesce(F.min("date"), F.lit("")).alias("first_date"), F.coalesce(F.max("date"), F.lit("")).alias("last_date"))


def by_provider(usage: DataFrame) -> DataFrame:
    return usage.groupBy("provider").agg(*token_sums(), F.count_distinct("date").alias("active_days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def last_active_days(usage: DataFrame, n: int = 30) -> DataFrame:
    """The trailing n days that have rows: a bounded top-n, then a broadcast semi-join of n days (SRT-1, FLT-3)."""
    days = usage.select("date").distinct().orderBy(F.desc("date")).limit(n)
    return usage.join(F.broadcast(days), "date", "left_semi")


def retract(ledger: DataFrame, path_key: str, replaced: DataFrame) -> DataFrame:
    """The ledger with the contributions of replaced files exchanged: their old rows go, the new ones come (ING-18)."""
    gone = replaced.select(path_key).distinct()
    return ledger.join(gone, path_key, "left_anti").unionByName(replaced)


def negate(rows: DataFrame) -> DataFrame:
    """Rows that take back what they brought (ING-18, ING-19 as a stream of differences)."""
    return rows.withColumns({c: -F.col(c) for c in BUCKETS})


def upsert(current: DataFrame, changes: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Changes replace current rows of their key; of several, the last in order stays (DML-2)."""
    w = Window.partitionBy(*key).orderBy(*order)
    last = changes.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return current.join(last.select(*key), key, "left_anti").unionByName(last)


def grown(before: DataFrame, after: DataFrame, kind: str) -> DataFrame:
    """Counts of each kind after less before (AGG-46)."""
    a = after.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))
    b = before.groupBy(kind).agg((-F.count(F.lit(1))).alias("n"))
    return a.unionByName(b).groupBy(kind).agg(F.sum("n").alias("delta"))
