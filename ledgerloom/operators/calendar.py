"""Calendar analytics on daily rows: dense days, levels, streaks, deltas, grids (AGG-22..42, WIN-6..10, FLT-19..20)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.money import div
from ledgerloom.functions.times import day_spine


def dense_days(days: DataFrame, value: str) -> DataFrame:
    """(date, value) for every day from the first to the last; 0 where there is no row (FN-14)."""
    bounds = days.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    return day_spine(bounds.filter("first is not null")).join(days.select("date", value), "date", "left").fillna(0, [value])


def levels(days: DataFrame, value: str) -> DataFrame:
    """Heat levels 0 to 4 by nearest-rank quartiles of the positive values; the maximum is 4; equal bounds lift (WIN-7)."""
    positive = F.when(F.col(value) > 0, F.col(value))
    # one number a calendar day: bounded by the days, not by the events
    sorted_ = days.agg(F.sort_array(F.collect_list(positive)).alias("v"))
    n = F.size("v")
    q = [F.try_element_at("v", F.ceil(n * k / 4).cast("int")) for k in (1, 2, 3)]
    bounds = sorted_.select(*[c.alias(f"q{k}") for k, c in enumerate(q, 1)], F.array_max("v").alias("most"))
    x = F.col(value)
    at = F.when(x <= F.col("q1"), F.col("q1")).when(x <= F.col("q2"), F.col("q2")).when(x <= F.col("q3"), F.col("q3"))
    level = F.when(x <= 0, 0).when(x == F.col("most"), 4).when(at.isNull(), 4).when(at == F.col("q3"), 3).when(at == F.col("q2"), 2).otherwise(1)
    return days.join(F.broadcast(bounds)).withColumn("level", level).drop("q1", "q2", "q3", "most")


def streaks(days: DataFrame, value: str) -> DataFrame:
    """Runs of consecutive days with a positive value: first, last, days (WIN-6). Days are few; no partition is needed."""
    active = days.filter(F.col(value) > 0).select(F.to_date("date").alias("d"))
    w = Window.orderBy("d")
    runs = active.withColumn("island", F.date_sub("d", F.row_number().over(w)))
    return runs.groupBy("island").agg(F.date_format(F.min("d"), "yyyy-MM-dd").alias("first"), F.date_format(F.max("d"), "yyyy-MM-dd").alias("last"), F.count(F.lit(1)).alias("days")).drop("island")


def heat_statistics(days: DataFrame, value: str) -> DataFrame:
    """active_days, total, busiest_day (the first of equals), longest_streak (AGG-29)."""
    longest = streaks(days, value).agg(F.coalesce(F.max("days"), F.lit(0)).alias("longest_streak"))
    day_no = F.unix_date(F.to_date("date"))
    one = days.agg(F.count_if(F.col(value) > 0).alias("active_days"), F.coalesce(F.sum(value), F.lit(0)).alias("total"), F.max_by("date", F.when(F.col(value) > 0, F.struct(F.col(value), -day_no))).alias("busiest_day"))
    return one.join(F.broadcast(longest))


def week_over_week(days: DataFrame, value: str) -> DataFrame:
    """Mean of the last 7 days against the mean of up to 7 before, in percent; null without a base (WIN-9)."""
    w = Window.orderBy("date")
    last, before = w.rowsBetween(-6, 0), w.rowsBetween(-13, -7)
    rows = days.select("date", F.avg(value).over(last).alias("now"), F.avg(value).over(before).alias("base"))
    return rows.select("date", F.when(F.col("base") > 0, F.round((F.col("now") - F.col("base")) / F.col("base") * 100, 6)).alias("delta"))


def sparkline(days: DataFrame, value: str, buckets: int = 10, heights: int = 8) -> DataFrame:
    """bucket, value, height: equal buckets of the days, heights 0 to heights-1 between minimum and maximum (WIN-10)."""
    w = Window.orderBy("date")
    n = days.agg(F.count(F.lit(1)).alias("n"))
    placed = days.withColumn("i", F.row_number().over(w) - 1).join(F.broadcast(n)).withColumn("bucket", F.floor(F.col("i") * buckets / F.col("n")).cast("int"))
    sums = placed.groupBy("bucket").agg(F.sum(value).alias("value"))
    span = sums.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    height = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.round((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (heights - 1)).cast("int"))
    return sums.join(F.broadcast(span)).select("bucket", "value", height.alias("height"))


def compress(days: DataFrame, value: str, points: int = 30) -> DataFrame:
    """At most so many points: buckets of equal size, averaged in integers (AGG-30)."""
    n = days.agg(F.greatest(F.ceil(F.count(F.lit(1)) / points), F.lit(1)).alias("size"))
    w = Window.orderBy("date")
    placed = days.withColumn("i", F.row_number().over(w) - 1).join(F.broadcast(n)).withColumn("bucket", F.floor(F.col("i") / F.col("size")).cast("int"))
    return placed.groupBy("bucket").agg(F.min("date").alias("first_date"), div(F.sum(value), F.count(F.lit(1))).alias("value"))


def rails(days: DataFrame, today: str, value: str = "cost") -> DataFrame:
    """Today, 7 and 30 days, and the largest day of 30 (the first of equals) (AGG-40, FLT-19)."""
    d, t = F.to_date("date"), F.to_date(F.lit(today))
    inside = lambda n: (d > F.date_sub(t, n)) & (d <= t)
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col(value))), F.lit(0)).cast("long")
    peak = F.when(inside(30) & (F.col(value) > 0), F.struct(F.col(value), -F.unix_date(d)))
    return days.agg(total(d == t).alias("today"), total(inside(7)).alias("last_7"), total(inside(30)).alias("last_30"), F.max_by("date", peak).alias("peak_day"), F.coalesce(F.max(F.when(inside(30), F.col(value))), F.lit(0)).alias("peak"))


def year_grid(days: DataFrame, value: str = "cost") -> DataFrame:
    """Twelve months for every year: active days, sum, integer average of an active day, peak day (AGG-23)."""
    day = days.withColumn("month", F.substring("date", 1, 7))
    years = day.select(F.substring("date", 1, 4).alias("year")).distinct()
    grid = years.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.concat("year", F.lit("-"), F.lpad(m.cast("string"), 2, "0")))).alias("month"))
    made = day.groupBy("month").agg(
        F.count_if(F.col(value) > 0).alias("active_days"), F.sum(value).alias("value"),
        F.max_by("date", F.when(F.col(value) > 0, F.struct(F.col(value), -F.unix_date(F.to_date("date"))))).alias("peak_day"),
    )
    rows = grid.join(made, "month", "left").fillna(0, ["active_days", "value"])
    return rows.withColumn("average", F.coalesce(div(F.col("value"), F.col("active_days")), F.lit(0)))


def zoomed(days: DataFrame, zoom: str, year: int | None = None, month: str | None = None) -> DataFrame:
    """period: the year, month or day of a row, and only rows inside the zoom (FLT-20)."""
    size = {"years": 4, "year": 7, "month": 10}[zoom]
    rows = days.withColumn("period", F.substring("date", 1, size))
    if zoom == "year":
        rows = rows.filter(F.substring("date", 1, 4) == str(year))
    elif zoom == "month":
        rows = rows.filter(F.substring("date", 1, 7) == month)
    return rows


def matrix(priced: DataFrame, dates: list[str], value: str = "cost") -> DataFrame:
    """Models by the given days, and the row total over them (AGG-38). The days are named, so the pivot needs no pass of its own."""
    rows = priced.filter(F.col("date").isin(dates)).groupBy("provider", "model").pivot("date", dates).agg(F.sum(value))
    cells = [F.coalesce(F.col(f"`{d}`"), F.lit(0)) for d in dates]
    return rows.select("provider", "model", *[c.alias(f"d{d.replace('-', '')}") for c, d in zip(cells, dates)], sum(cells[1:], cells[0]).alias("row_total"))


def recency(models: DataFrame, report_date: str) -> DataFrame:
    """Days since last use, 0 at least (AGG-39)."""
    return models.withColumn("recency_days", F.greatest(F.lit(0), F.datediff(F.to_date(F.lit(report_date)), F.to_date("last_date"))))


def hour_profile(rows: DataFrame, ts: str, mask: str | None = None) -> DataFrame:
    """All 24 hours with counts, and counts inside a mask (AGG-22, AGG-48)."""
    spine = rows.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    made = rows.groupBy(F.hour(ts).alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr(mask) if mask else F.lit(True)).alias("masked"))
    return spine.join(F.broadcast(made.filter("hour is not null")), "hour", "left").fillna(0)  # at most 24 rows


def weekday_profile(rows: DataFrame, ts: str) -> DataFrame:
    """Sunday 0 to Saturday 6, dense; -1 for unknown times if there are any (AGG-22)."""
    spine = rows.sparkSession.range(7).select(F.col("id").cast("int").alias("weekday"))
    made = rows.groupBy(F.coalesce(F.dayofweek(ts) - 1, F.lit(-1)).alias("weekday")).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(F.broadcast(made), "weekday", "full_outer").fillna(0, ["n"])  # at most 8 rows
