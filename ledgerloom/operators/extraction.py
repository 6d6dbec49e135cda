"""From log records to usage events: prefilters, decoding, model attribution, progressive snapshots (ING-1..12, WIN-1..2, WIN-16, AGG-36..37)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COUNTS = "input_tokens long, cached_input_tokens long, cache_write_input_tokens long, output_tokens long, reasoning_output_tokens long, total_tokens long"
RECORD_A = f"timestamp string, type string, payload struct<model: string, type: string, info: struct<total_token_usage: struct<{COUNTS.replace(' long', ': long')}>, last_token_usage: struct<{COUNTS.replace(' long', ': long')}>>>"
_CREATION = "struct<ephemeral_5m_input_tokens: long, ephemeral_1h_input_tokens: long>"
_TURN = f"model: string, input_tokens: long, cache_read_input_tokens: long, cache_creation_input_tokens: long, output_tokens: long, cache_creation: {_CREATION}"
RECORD_B = f"timestamp string, type string, message struct<id: string, model: string, usage: struct<{_TURN.removeprefix('model: string, ')}, iterations: string>>"
EVENT = ("ts", "provider", "model", "input", "cache_read", "cache_write_5m", "cache_write_1h", "cache_write_unclassified", "output", "reasoning")


def model_or_unknown(x: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(x), F.lit("")), F.lit("unknown"))


def of_interest_a(lines: DataFrame) -> DataFrame:
    """Provider A's lines with the exact bytes of the two kinds that matter (ING-1)."""
    return lines.filter(F.col("raw").contains('"turn_context"') | F.col("raw").contains('"token_count"'))


def decode_a(lines: DataFrame) -> DataFrame:
    """Provider A's records (path, line_no, raw) of the two kinds that matter, decoded; the exact bytes are looked for before any JSON is parsed (ING-1, ING-3, ING-4)."""
    r = of_interest_a(lines).withColumn("r", F.from_json("raw", RECORD_A, {"mode": "PERMISSIVE"}))
    is_context = F.col("r.type") == "turn_context"
    counted = (F.col("r.type") == "event_msg") & (F.col("r.payload.type") == "token_count") & F.col("r.payload.info.total_token_usage").isNotNull() & F.col("r.payload.info.last_token_usage").isNotNull()
    return r.select(
        "path", "line_no",
        F.col("r").isNull().alias("broken") | F.col("r.type").isNull().alias("broken"),
        F.when(is_context, model_or_unknown(F.col("r.payload.model"))).alias("context_model"),
        F.coalesce(counted, F.lit(False)).alias("is_count"),
        F.try_to_timestamp("r.timestamp").alias("ts"),
        F.col("r.payload.info.last_token_usage").alias("u"),
        F.col("r.payload.info.total_token_usage").alias("total"),
    ).toDF("path", "line_no", "broken", "context_model", "is_count", "ts", "u", "total")


def attribute_models(rows: DataFrame, partition: list[str], order: list[str], model: str = "context_model") -> DataFrame:
    """model of every row: the last one set so far, else the first one set later, else unknown (WIN-1, JN-16, STR-5)."""
    w = Window.partitionBy(*partition).orderBy(*order)
    so_far = F.last(model, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    later = F.first(model, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn("model", F.coalesce(so_far, later, F.lit("unknown"))).withColumn("buffered", so_far.isNull())


def events_a(lines: DataFrame, provider: str = "codex") -> DataFrame:
    """Provider A's usage events: the last usage of each count, never the cumulative one; nothing of zero tokens, of an unreadable time (ING-5, ING-6, SRC-6)."""
    rows = attribute_models(decode_a(lines), ["path"], ["line_no"])
    n = lambda c: F.coalesce(F.col(f"u.{c}"), F.lit(0))
    counted = rows.filter("is_count").filter((n("input_tokens") + n("output_tokens") > 0) & F.col("ts").isNotNull())
    zero = F.lit(0).cast("long")
    return counted.select("path", "line_no", "buffered", "ts", F.lit(provider).alias("provider"), "model", n("input_tokens").alias("input"), n("cached_input_tokens").alias("cache_read"), n("cache_write_input_tokens").alias("cache_write_5m"), zero.alias("cache_write_1h"), zero.alias("cache_write_unclassified"), n("output_tokens").alias("output"), n("reasoning_output_tokens").alias("reasoning"))


def counter_changes(rows: DataFrame, partition: str, order: str, value: str) -> DataFrame:
    """Per file, how often its counter fell and how often it stood still (AGG-37)."""
    w = Window.partitionBy(partition).orderBy(order)
    before = rows.withColumn("_before", F.lag(value).over(w))
    return before.groupBy(partition).agg(F.count_if(F.col(value) < F.col("_before")).alias("resets"), F.count_if(F.col(value) == F.col("_before")).alias("repeats"))


def diagnostics_a(lines: DataFrame) -> DataFrame:
    """One row: token_events, last_usage_mismatches, counter_resets, duplicate_snapshots, buffered_before_model, unknown_model_events, malformed (AGG-37, WIN-16)."""
    rows = attribute_models(decode_a(lines), ["path"], ["line_no"])
    w = Window.partitionBy("path").orderBy("line_no")
    parts = [c.split()[0] for c in COUNTS.split(", ")]
    n = lambda s, c: F.coalesce(F.col(f"{s}.{c}"), F.lit(0))
    counts = rows.filter("is_count").withColumn("before", F.lag("total").over(w))
    less, same = F.lit(False), F.lit(True)
    for c in parts:
        less, same = less | (n("total", c) < n("before", c)), same & (n("total", c) == n("before", c))
    known = F.col("before").isNotNull()
    positive = n("u", "input_tokens") + n("u", "output_tokens") > 0
    found = counts.agg(
        F.count(F.lit(1)).alias("token_events"),
        F.count_if(n("u", "total_tokens") != n("u", "input_tokens") + n("u", "output_tokens")).alias("last_usage_mismatches"),
        F.count_if(known & less).alias("counter_resets"),
        F.count_if(known & same).alias("duplicate_snapshots"),
        F.count_if(positive & F.col("ts").isNotNull() & F.col("buffered")).alias("buffered_before_model"),
        F.count_if(positive & F.col("ts").isNotNull() & F.col("buffered") & (F.col("model") == "unknown")).alias("unknown_model_events"),
        F.count_if(positive & F.col("ts").isNull()).alias("bad_times"),
    )
    broken = rows.agg(F.count_if("broken").alias("broken"))  # one row each
    return found.join(F.broadcast(broken)).withColumn("malformed", F.col("bad_times") + F.col("broken")).drop("bad_times", "broken")


def iterations_of(message: Column) -> Column:
    """A message's iterations: its non-empty array, else the one that its usage makes; the model falls back to the message's, then unknown (ING-8)."""
    usage = message["usage"]
    n = lambda x: F.coalesce(x, F.lit(0))

    def one(x: Column, model: Column) -> Column:
        five, hour = n(x["cache_creation"]["ephemeral_5m_input_tokens"]), n(x["cache_creation"]["ephemeral_1h_input_tokens"])
        creation = n(x["cache_creation_input_tokens"])
        return F.struct(
            F.coalesce(F.nullif(model, F.lit("")), F.nullif(message["model"], F.lit("")), F.lit("unknown")).alias("model"),
            n(x["input_tokens"]).alias("raw_input"), n(x["cache_read_input_tokens"]).alias("cache_read"), creation.alias("cache_creation"),
            five.alias("w5m"), hour.alias("w1h"), F.greatest(F.lit(0).cast("long"), creation - five - hour).alias("unclassified"), n(x["output_tokens"]).alias("output"),
        )

    several = F.from_json(usage["iterations"], f"array<struct<{_TURN}>>")
    return F.when(F.coalesce(F.size(several), F.lit(0)) > 0, F.transform(several, lambda x: one(x, x["model"]))).otherwise(F.array(one(usage, F.lit(None).cast("string"))))


def score(iterations: Column) -> Column:
    """All tokens of all iterations: what decides between snapshots of one message (ING-9)."""
    return F.aggregate(iterations, F.lit(0).cast("long"), lambda a, x: a + x["raw_input"] + x["cache_read"] + x["cache_creation"] + x["output"])


def candidates_b(lines: DataFrame) -> DataFrame:
    """Provider B's message snapshots: path, line_no, message_id, ts, iterations, score. Only lines with the exact bytes `"usage":{` count (ING-2, ING-7)."""
    r = lines.filter(F.col("raw").contains('"usage":{')).withColumn("r", F.from_json("raw", RECORD_B))
    good = (F.col("r.type") == "assistant") & F.col("r.message.usage").isNotNull() & (F.coalesce(F.col("r.message.id"), F.lit("")) != "")
    made = r.filter(good).withColumn("ts", F.try_to_timestamp("r.timestamp")).filter("ts is not null").withColumn("iterations", iterations_of(F.col("r.message")))
    return made.select("path", "line_no", F.col("r.message.id").alias("message_id"), "ts", "iterations", score(F.col("iterations")).alias("score"))


def progressive(candidates: DataFrame, key: str, order: list[str], ts: str = "ts", value: str = "score") -> DataFrame:
    """Per key in order of arrival: rows that beat all before them are records; the last record wins, with the earliest time of the records (WIN-2, ING-19)."""
    w = Window.partitionBy(key).orderBy(*order)
    before = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    records = candidates.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col(value) > F.col("_before")))
    back = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    placed = records.withColumn("_n", F.row_number().over(back)).withColumn("_first", F.min(ts).over(Window.partitionBy(key)))
    return placed.filter("_n = 1").withColumn(ts, F.col("_first")).drop("_n", "_first", "_before")


def events_b(candidates: DataFrame, provider: str = "claude") -> DataFrame:
    """One event for each iteration with tokens of the messages kept; input counts reads and creation too (ING-11)."""
    x = candidates.select("message_id", "ts", F.explode("iterations").alias("i"))
    made = x.select("ts", F.lit(provider).alias("provider"), F.col("i.model").alias("model"), (F.col("i.raw_input") + F.col("i.cache_read") + F.col("i.cache_creation")).alias("input"), F.col("i.cache_read").alias("cache_read"), F.col("i.w5m").alias("cache_write_5m"), F.col("i.w1h").alias("cache_write_1h"), F.col("i.unclassified").alias("cache_write_unclassified"), F.col("i.output").alias("output"), F.lit(0).cast("long").alias("reasoning"))
    return made.filter("input + output > 0")


def dedupe_diagnostics(candidates: DataFrame, key: str, order: list[str], value: str = "score") -> DataFrame:
    """One row: retained messages, duplicates, duplicates whose score differs from what is retained at that time (AGG-36)."""
    w = Window.partitionBy(key).orderBy(*order)
    best = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = candidates.withColumn("_best", best)
    return rows.agg(F.count_distinct(key).alias("retained"), F.count_if(F.col("_best").isNotNull()).alias("duplicates"), F.count_if(F.col("_best") != F.col(value)).alias("differing"))


def to_cube_rows(events: DataFrame, zone: str = "UTC") -> DataFrame:
    """Events with their local day as `date` (ING-12, ING-20: another zone is another projection)."""
    return events.withColumn("date", F.date_format(F.from_utc_timestamp("ts", zone), "yyyy-MM-dd"))


def paired(rows: DataFrame, partition: str = "path", order: str = "line_no", within: int = 4) -> DataFrame:
    """Rows (kind A or B, text_hash, ts) with paired: an A row that a B row of equal text and time follows within so many lines (WIN-17, ING-26)."""
    w = Window.partitionBy(partition, "text_hash").orderBy(order)
    following = F.lead(F.struct("kind", order, "ts")).over(w)
    pair = (F.col("kind") == "A") & (following["kind"] == "B") & (following[order] - F.col(order) <= within) & following["ts"].eqNullSafe(F.col("ts"))
    return rows.withColumn("paired", F.coalesce(pair, F.lit(False)))
