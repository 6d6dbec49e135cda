"""The logical relations, derived from the driver's tables; each as a DataFrame and, for the oracles, as a DuckDB CTE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators import cube as C
from ledgerloom.operators import pricing as P


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def usage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions: one row a line item, with its file (path), local day, provider, model and buckets."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    quantity, output = F.floor("l_quantity"), F.floor(F.col("l_extendedprice") * F.col("l_tax"))
    return rows.select(
        F.concat(F.lit("f"), (F.col("l_suppkey") % 40).cast("string")).alias("path"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"),
        F.when(F.col("l_linestatus") == "O", "codex").otherwise("claude").alias("provider"),
        F.col("p_brand").alias("model"),
        F.floor("l_extendedprice").alias("input"),
        F.floor(F.col("l_extendedprice") * F.col("l_discount")).alias("cache_read"),
        F.col("l_linenumber").cast("long").alias("cache_write_5m"),
        quantity.alias("cache_write_1h"),
        (quantity % 3).alias("cache_write_unclassified"),
        output.alias("output"),
        F.call_function("div", output, F.lit(2).cast("long")).alias("reasoning"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cube(usage_rows(spark, sf_dir))


def rate_entries() -> list[tuple]:
    """One or two entries for each brand but every fifth; some rates null, some ranges closed."""
    rows: list[tuple] = []
    for k in range(1, 26):
        if k % 5 == 0:
            continue
        status = ("published", "proxy", "estimated", "user")[k % 4]
        for turn, (first, last) in enumerate(((None, "1997-12-31"), ("1998-01-01", "2000-12-31" if k % 7 == 0 else None))):
            rows.append((f"Brand#{k}", 1000 + 100 * k + turn, None if k % 3 == 0 else 100 + 10 * k, 1250 + k, None if k % 4 == 0 else 2000 + k, 5000 + 50 * k - turn, status, first, last))
    return rows


def rates(spark: SparkSession) -> DataFrame:
    return P.rate_table(spark, rate_entries())


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.price(usage(spark, sf_dir), rates(spark))


def _value(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


USAGE_ROWS_SQL = """usage_rows AS (
    SELECT 'f' || (l_suppkey % 40) AS path, strftime(l_shipdate, '%Y-%m-%d') AS date, CASE l_linestatus WHEN 'O' THEN 'codex' ELSE 'claude' END AS provider, p_brand AS model,
           CAST(floor(l_extendedprice) AS BIGINT) AS input, CAST(floor(l_extendedprice * l_discount) AS BIGINT) AS cache_read, CAST(l_linenumber AS BIGINT) AS cache_write_5m,
           CAST(floor(l_quantity) AS BIGINT) AS cache_write_1h, CAST(floor(l_quantity) AS BIGINT) % 3 AS cache_write_unclassified,
           CAST(floor(l_extendedprice * l_tax) AS BIGINT) AS output, CAST(floor(l_extendedprice * l_tax) AS BIGINT) // 2 AS reasoning
    FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_SUMS = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in C.BUCKETS)
SUMS_SQL = _SUMS + ", CAST(coalesce(sum(cache_write_5m + cache_write_1h + cache_write_unclassified), 0) AS BIGINT) AS cache_write, CAST(coalesce(sum(input + output), 0) AS BIGINT) AS total"
USAGE_SQL = USAGE_ROWS_SQL + f", usage AS (SELECT date, provider, model, {_SUMS} FROM usage_rows GROUP BY date, provider, model)"
RATES_SQL = "rates(model, base_input, r_read, w5m, w1h, r_output, status, effective_from, effective_until) AS (VALUES " + ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in rate_entries()) + ")"
_BUCKET_RATES = (("base", "base_input"), ("cache_read", "r_read"), ("cache_write_5m", "w5m"), ("cache_write_1h", "w1h"), ("cache_write_unclassified", "w1h"), ("output", "r_output"))
_COST = " + ".join(f"CASE WHEN {t} >= 0 AND {r} IS NOT NULL THEN {t} * {r} ELSE 0 END" for t, r in _BUCKET_RATES)
_PRICED = " + ".join(f"CASE WHEN {t} >= 0 AND {r} IS NOT NULL THEN {t} ELSE 0 END" for t, r in _BUCKET_RATES)
_UNPRICED = " + ".join(f"CASE WHEN {t} < 0 OR {r} IS NULL THEN {t} ELSE 0 END" for t, r in _BUCKET_RATES)
PRICED_SQL = f"""{USAGE_SQL}, {RATES_SQL}, rated AS (
    SELECT u.*, base_input, r_read, w5m, w1h, r_output, status, input - cache_read - cache_write_5m - cache_write_1h - cache_write_unclassified AS base
    FROM usage u LEFT JOIN rates r ON u.model = r.model AND (effective_from IS NULL OR date >= effective_from) AND (effective_until IS NULL OR date <= effective_until)),
  costs AS (SELECT *, CAST({_COST} AS BIGINT) AS cost, CAST({_PRICED} AS BIGINT) AS priced_tokens, CAST({_UNPRICED} AS BIGINT) AS unpriced_tokens FROM rated),
  priced AS (SELECT date, provider, model, {", ".join(C.BUCKETS)}, cost, priced_tokens, unpriced_tokens, CASE WHEN priced_tokens > 0 THEN status END AS provenance FROM costs)"""


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    key = F.col("conv_id") * 1000 + F.col("turn")
    at = F.timestamp_seconds(F.lit(1704067200) + (F.col("conv_id") * 97 + F.col("turn") * 11) * 60)
    return c.select(
        key.alias("prompt_id"), F.col("conv_id").alias("session_id"), "turn", "role", "text",
        F.when(F.col("conv_id") % 5 < 3, "codex").otherwise("claude").alias("provider"),
        F.when(key % 13 != 0, F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000000000Z"))).alias("ts"),
        F.when(F.col("role") != "user", "unknown").when(key % 10 == 3, "control").when(key % 10 == 7, "command").otherwise("human").alias("kind"),
        (F.col("role") != "system").alias("searchable"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = prompts(spark, sf_dir).groupBy("session_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    i = F.col("session_id")
    name = lambda prefix, n: F.concat(F.lit(prefix), (i % n).cast("string"))
    return s.select(
        "session_id", "first_ts", "last_ts",
        F.when(i % 5 < 3, "codex").otherwise("claude").alias("provider"),
        F.when(i % 4 != 0, name("Repo", 26)).alias("repository"),
        F.when(i % 11 == 0, "").when(i % 7 == 0, F.concat(F.lit("solo"), i.cast("string"))).otherwise(name("project", 9)).alias("project"),
        F.when(i % 11 == 0, None).when(i % 4 == 0, "cwd").otherwise("git").alias("project_source"),
        name("/work/team", 6).alias("cwd"),
        F.when(i % 3 == 0, "").otherwise(name("branch", 36)).alias("branch"),
        F.when(i % 12 == 0, "subagent").when(i % 5 == 0, "unknown").otherwise("root").alias("thread_kind"),
        F.concat(F.lit("n"), i.cast("string")).alias("native_id"),
        F.when(i % 12 == 0, F.concat(F.lit("n"), F.floor(i / 2).cast("string"))).alias("parent_native"),
        F.when(i % 9 == 4, F.concat(F.lit("n"), (i - 1).cast("string"))).alias("forked_from"),
    )


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prompts(spark, sf_dir).select("prompt_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("prompt_id") % 3)).alias("i"))
    kind = F.element_at(F.array(F.lit("provider_live"), F.lit("provider_archive"), F.lit("vault")), (F.col("i") + 1).cast("int"))
    return p.select("prompt_id", (F.col("prompt_id") * 10 + F.col("i")).alias("location_id"), kind.alias("kind"), ((F.col("prompt_id") + F.col("i")) % 4 != 0).alias("available"))


PROMPTS_SQL = """prompts AS (
    SELECT conv_id * 1000 + turn AS prompt_id, conv_id AS session_id, turn, role, text, CASE WHEN conv_id % 5 < 3 THEN 'codex' ELSE 'claude' END AS provider,
           CASE WHEN (conv_id * 1000 + turn) % 13 <> 0 THEN strftime(TIMESTAMP '2024-01-01' + to_minutes(CAST(conv_id * 97 + turn * 11 AS BIGINT)), '%Y-%m-%dT%H:%M:%S') || '.000000000Z' END AS ts,
           CASE WHEN role <> 'user' THEN 'unknown' WHEN (conv_id * 1000 + turn) % 10 = 3 THEN 'control' WHEN (conv_id * 1000 + turn) % 10 = 7 THEN 'command' ELSE 'human' END AS kind,
           role <> 'system' AS searchable FROM conversations)"""
SESSIONS_SQL = """sessions AS (
    SELECT session_id, min(ts) AS first_ts, max(ts) AS last_ts, CASE WHEN session_id % 5 < 3 THEN 'codex' ELSE 'claude' END AS provider,
           CASE WHEN session_id % 4 <> 0 THEN 'Repo' || (session_id % 26) END AS repository,
           CASE WHEN session_id % 11 = 0 THEN '' WHEN session_id % 7 = 0 THEN 'solo' || session_id ELSE 'project' || (session_id % 9) END AS project,
           CASE WHEN session_id % 11 = 0 THEN NULL WHEN session_id % 4 = 0 THEN 'cwd' ELSE 'git' END AS project_source, '/work/team' || (session_id % 6) AS cwd,
           CASE WHEN session_id % 3 = 0 THEN '' ELSE 'branch' || (session_id % 36) END AS branch,
           CASE WHEN session_id % 12 = 0 THEN 'subagent' WHEN session_id % 5 = 0 THEN 'unknown' ELSE 'root' END AS thread_kind,
           'n' || session_id AS native_id, CASE WHEN session_id % 12 = 0 THEN 'n' || (session_id // 2) END AS parent_native, CASE WHEN session_id % 9 = 4 THEN 'n' || (session_id - 1) END AS forked_from
    FROM prompts GROUP BY session_id)"""
OCCURRENCES_SQL = """occurrences AS (
    SELECT prompt_id, prompt_id * 10 + i AS location_id, ['provider_live', 'provider_archive', 'vault'][i + 1] AS kind, (prompt_id + i) % 4 <> 0 AS available
    FROM (SELECT prompt_id, unnest(range(0, prompt_id % 3 + 1)) AS i FROM prompts))"""
CORPUS_SQL = ", ".join((PROMPTS_SQL, SESSIONS_SQL, OCCURRENCES_SQL))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    provider = F.when(F.col("o_orderstatus") == "F", "codex").otherwise("claude")
    known = F.col("o_orderkey") % 17 != 0
    return o.select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source_path"),
        F.row_number().over(w).cast("long").alias("version"),
        F.floor("o_totalprice").alias("size"), provider.alias("provider"),
        F.concat(provider, F.lit("-"), F.date_format("o_orderdate", "yyyy-MM")).alias("archive"),
        F.when(known, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("first_ts"),
        F.when(known, F.date_format(F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 5).cast("int")), "yyyy-MM-dd")).alias("last_ts"),
    )


MANIFEST_SQL = """manifest AS (
    SELECT 'c' || o_custkey AS source_path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, CAST(floor(o_totalprice) AS BIGINT) AS size,
           CASE WHEN o_orderstatus = 'F' THEN 'codex' ELSE 'claude' END AS provider, CASE WHEN o_orderstatus = 'F' THEN 'codex' ELSE 'claude' END || '-' || strftime(o_orderdate, '%Y-%m') AS archive,
           CASE WHEN o_orderkey % 17 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS first_ts,
           CASE WHEN o_orderkey % 17 <> 0 THEN strftime(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INTEGER), '%Y-%m-%d') END AS last_ts FROM orders)"""


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log: a user is a file; a signup sets the model, a purchase counts tokens."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    return e.select(
        F.col("user_id").alias("path"), F.col("event_id").alias("line_no"), "ts", "event_type",
        F.when(F.col("event_type") == "signup", F.concat(F.lit("m"), k)).alias("context_model"),
        (F.col("event_type") == "purchase").alias("is_count"), F.floor("value").cast("long").alias("tokens"),
    )


LOG_SQL = """log AS (
    SELECT user_id AS path, event_id AS line_no, ts, event_type, CASE WHEN event_type = 'signup' THEN 'm' || json_extract_string(props, '$.k') END AS context_model,
           event_type = 'purchase' AS is_count, CAST(floor(value) AS BIGINT) AS tokens FROM events)"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as progressive snapshots: a message is a user's hour."""
    e = table(spark, sf_dir, "events").filter("value is not null")
    return e.select(F.concat(F.col("user_id").cast("string"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd-HH")).alias("message_id"), F.col("event_id").alias("line_no"), "ts", F.floor(F.col("value") * 100).cast("long").alias("score"))


SNAPSHOTS_SQL = """snapshots AS (
    SELECT user_id || '/' || strftime(ts, '%Y-%m-%d-%H') AS message_id, event_id AS line_no, ts, CAST(floor(value * 100) AS BIGINT) AS score FROM events WHERE value IS NOT NULL)"""
