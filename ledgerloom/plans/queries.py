"""The registered queries on the driver's tables, each with its oracle: cube, pricing and calendar."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import money, times
from ledgerloom.operators import calendar as K
from ledgerloom.operators import cube as C
from ledgerloom.operators import pricing as P
from ledgerloom.plans import bindings as B
from ledgerloom.plans import reports as Y

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        if name in QUERIES:
            raise ValueError(f"{name} is taken")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


U, PR, S = B.USAGE_SQL, B.PRICED_SQL, B.SUMS_SQL
COSTS = "CAST(sum(cost) AS BIGINT) AS cost, CAST(sum(priced_tokens) AS BIGINT) AS priced_tokens, CAST(sum(unpriced_tokens) AS BIGINT) AS unpriced_tokens"
DAYS = f"{PR}, days AS (SELECT date, CAST(sum(cost) AS BIGINT) AS cost FROM priced GROUP BY date)"
TODAY = "1998-06-30"


def day_costs(spark, d) -> DataFrame:
    return B.priced(spark, d).groupBy("date").agg(P.checked_sum(F.col("cost")).alias("cost"))


# --- cube


@query("cube", f"WITH {U} SELECT * FROM usage")
def _cube(spark, d):
    return B.usage(spark, d)


@query("daily", f"WITH {U} SELECT date, {S} FROM usage GROUP BY date")
def _daily(spark, d):
    return C.daily(B.usage(spark, d))


@query("monthly", f"WITH {U} SELECT substr(date, 1, 7) AS month, {S} FROM usage GROUP BY 1")
def _monthly(spark, d):
    return C.monthly(B.usage(spark, d))


@query("by_model", f"WITH {U} SELECT provider, model, {S}, count(DISTINCT date) AS active_days, min(date) AS first_date, max(date) AS last_date FROM usage GROUP BY ALL")
def _by_model(spark, d):
    return C.by_model(B.usage(spark, d))


@query("by_provider", f"WITH {U} SELECT provider, {S}, count(DISTINCT date) AS active_days, min(date) AS first_date, max(date) AS last_date FROM usage GROUP BY provider")
def _by_provider(spark, d):
    return C.by_provider(B.usage(spark, d))


@query("totals", f"WITH {U} SELECT {S}, count(DISTINCT date) AS active_days, coalesce(min(date), '') AS first_date, coalesce(max(date), '') AS last_date FROM usage")
def _totals(spark, d):
    return C.totals(B.usage(spark, d))


@query("totals_of_nothing", f"WITH {U} SELECT {S}, count(DISTINCT date) AS active_days, coalesce(min(date), '') AS first_date, coalesce(max(date), '') AS last_date FROM usage WHERE date > '2999'")
def _totals_of_nothing(spark, d):
    return C.totals(C.filtered(B.usage(spark, d), since="2999-01-01"))


@query("day_breakdown", f"WITH {U}, last AS (SELECT max(date) AS date FROM usage WHERE date <= '{TODAY}') SELECT provider, model, {S} FROM usage JOIN last USING (date) GROUP BY GROUPING SETS ((provider, model), (provider), ())")
def _day_breakdown(spark, d):
    usage = B.usage(spark, d)
    last = usage.filter(F.col("date") <= TODAY).agg(F.max("date")).first()[0]
    return C.breakdown(usage, last)


@query("usage_filter", f"WITH {U} SELECT * FROM usage WHERE date >= '1996-02-01' AND date <= '1997-03-31' AND provider = 'codex' AND model = 'Brand#7'")
def _usage_filter(spark, d):
    return C.filtered(B.usage(spark, d), "1996-02-01", "1997-03-31", "codex", "Brand#7")


@query("model_shares", f"WITH {U}, m AS (SELECT provider, model, {S}, count(DISTINCT date) AS active_days, min(date) AS first_date, max(date) AS last_date FROM usage GROUP BY provider, model) SELECT *, round(total / sum(total) OVER () * 1000) / 10 AS share FROM m")
def _model_shares(spark, d):
    return C.with_shares(C.by_model(B.usage(spark, d)))


@query("last_active_days", f"WITH {U} SELECT date, {S} FROM usage WHERE date IN (SELECT DISTINCT date FROM usage ORDER BY date DESC LIMIT 30) GROUP BY date")
def _last_active_days(spark, d):
    return C.daily(C.last_active_days(B.usage(spark, d), 30))


@query("top_models_by_tokens", f"WITH {U} SELECT provider, model, {S} FROM usage GROUP BY provider, model ORDER BY total DESC, provider, model LIMIT 5")
def _top_models(spark, d):
    return B.usage(spark, d).groupBy("provider", "model").agg(*C.token_sums()).orderBy(F.desc("total"), "provider", "model").limit(5)


@query("top_models_by_cost", f"WITH {PR} SELECT provider, model, {COSTS} FROM priced GROUP BY provider, model ORDER BY cost DESC, provider, model LIMIT 5")
def _top_models_cost(spark, d):
    return B.priced(spark, d).groupBy("provider", "model").agg(*P.costs()).orderBy(F.desc("cost"), "provider", "model").limit(5)


@query("model_table_by_name", f"WITH {U}, m AS (SELECT provider, model, {S} FROM usage GROUP BY provider, model) SELECT provider, model, total, row_number() OVER (ORDER BY lower(model), provider, model) AS place FROM m")
def _model_table(spark, d):
    m = B.usage(spark, d).groupBy("provider", "model").agg(*C.token_sums())
    return m.select("provider", "model", "total", F.row_number().over(Window.orderBy(F.lower("model"), "provider", "model")).cast("long").alias("place"))


@query("file_ledger", f"WITH {B.USAGE_ROWS_SQL} SELECT path, date, provider, model, {B._SUMS} FROM usage_rows GROUP BY ALL")
def _file_ledger(spark, d):
    return B.usage_rows(spark, d).groupBy("path", *C.KEY).agg(*C.sums())


_REWRITTEN = f"{B.USAGE_ROWS_SQL}, rewritten AS (SELECT path, date, provider, model, input * 2 AS input, cache_read, cache_write_5m, cache_write_1h, cache_write_unclassified, output, reasoning FROM usage_rows WHERE path IN ('f3', 'f7'))"


@query("retract_rewritten_files", f"WITH {_REWRITTEN}, ledger AS (SELECT * FROM usage_rows WHERE path NOT IN ('f3', 'f7') UNION ALL SELECT * FROM rewritten) SELECT date, provider, model, {B._SUMS} FROM ledger GROUP BY ALL")
def _retract(spark, d):
    ledger = B.usage_rows(spark, d)
    fresh = ledger.filter(F.col("path").isin("f3", "f7")).withColumn("input", F.col("input") * 2)
    return C.cube(C.retract(ledger, "path", fresh))


@query("retract_by_difference", f"WITH {_REWRITTEN}, ledger AS (SELECT * FROM usage_rows WHERE path NOT IN ('f3', 'f7') UNION ALL SELECT * FROM rewritten) SELECT date, provider, model, {B._SUMS} FROM ledger GROUP BY ALL")
def _retract_difference(spark, d):
    rows = B.usage_rows(spark, d)
    old = rows.filter(F.col("path").isin("f3", "f7"))
    fresh = old.withColumn("input", F.col("input") * 2)
    changes = C.cube(C.negate(old).unionByName(fresh))
    return C.cube(C.cube(rows).unionByName(changes))


@query("upsert_latest", f"WITH {B.MANIFEST_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY version DESC) AS k FROM manifest) SELECT source_path, version, size FROM ranked WHERE k = 1")
def _upsert(spark, d):
    m = B.manifest(spark, d).select("source_path", "version", "size")
    first = m.filter("version = 1")
    return C.upsert(first, m, ["source_path"], [F.desc("version")])


@query("kind_deltas", "SELECT o_orderstatus AS kind, CAST(count(*) FILTER (WHERE o_orderdate < TIMESTAMP '2000-01-01') - count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1998-01-01') AS BIGINT) AS delta FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' GROUP BY 1")
def _deltas(spark, d):
    o = B.table(spark, d, "orders").select(F.col("o_orderstatus").alias("kind"), F.date_format("o_orderdate", "yyyy").alias("y"))
    return C.grown(o.filter("y < '1998'"), o.filter("y < '2000'"), "kind")


# --- pricing


@query("priced_rows", f"WITH {PR} SELECT * FROM priced")
def _priced(spark, d):
    return B.priced(spark, d)


@query("daily_costs", f"WITH {PR} SELECT date, {COSTS} FROM priced GROUP BY date")
def _daily_costs(spark, d):
    return B.priced(spark, d).groupBy("date").agg(*P.costs())


_DOMINANT = """CASE WHEN sum(CASE WHEN provenance = 'user' THEN priced_tokens ELSE 0 END) > 0 THEN 'user'
    WHEN greatest(sum(CASE WHEN provenance = 'published' THEN priced_tokens ELSE 0 END), sum(CASE WHEN provenance = 'proxy' THEN priced_tokens ELSE 0 END), sum(CASE WHEN provenance = 'estimated' THEN priced_tokens ELSE 0 END)) = 0 THEN NULL
    WHEN sum(CASE WHEN provenance = 'published' THEN priced_tokens ELSE 0 END) >= greatest(sum(CASE WHEN provenance = 'proxy' THEN priced_tokens ELSE 0 END), sum(CASE WHEN provenance = 'estimated' THEN priced_tokens ELSE 0 END)) THEN 'published'
    WHEN sum(CASE WHEN provenance = 'proxy' THEN priced_tokens ELSE 0 END) >= sum(CASE WHEN provenance = 'estimated' THEN priced_tokens ELSE 0 END) THEN 'proxy' ELSE 'estimated' END"""


@query("report_daily", f"WITH {PR}, last AS (SELECT DISTINCT date FROM priced ORDER BY date DESC LIMIT 30) SELECT date, {S}, CAST(sum(cost) AS BIGINT) AS cost, {_DOMINANT} AS provenance FROM priced WHERE date IN (SELECT date FROM last) GROUP BY date")
def report_daily(spark, d):
    """The flagship: scan, join, range join with rates, exact money, aggregate, last 30 active days."""
    # the last days are found by their dates alone, and only their rows are added up and priced
    rows = C.last_active_days(B.usage_rows(spark, d), 30)
    return Y.daily_table(P.price(C.cube(rows), B.rates(spark))).drop("priced_tokens", "unpriced_tokens")


@query("report_monthly", f"WITH {PR} SELECT substr(date, 1, 7) AS month, {S}, CAST(sum(cost) AS BIGINT) AS cost, {_DOMINANT} AS provenance FROM priced GROUP BY 1")
def _report_monthly(spark, d):
    return Y.monthly_table(B.priced(spark, d)).drop("priced_tokens", "unpriced_tokens")


@query("report_models", f"""WITH {PR}, m AS (SELECT provider, model, {S}, count(DISTINCT date) AS active_days, min(date) AS first_date, max(date) AS last_date, {COSTS}, {_DOMINANT} AS provenance FROM priced GROUP BY provider, model)
    SELECT *, round(total / sum(total) OVER () * 1000) / 10 AS share, CASE WHEN sum(priced_tokens) OVER () > 0 THEN round(cost / sum(cost) OVER () * 1000) / 10 END AS cost_share FROM m""")
def _report_models(spark, d):
    m = B.priced(spark, d).groupBy("provider", "model").agg(
        *C.token_sums(), F.count_distinct("date").alias("active_days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), *P.costs(), P.dominant_provenance(F.col("provenance"), F.col("priced_tokens")).alias("provenance")
    )
    whole = m.agg(F.sum("total").alias("_t"), F.sum("cost").alias("_c"), F.sum("priced_tokens").alias("_p"))
    rows = m.join(F.broadcast(whole))
    return rows.withColumns({"share": F.round(F.col("total") / F.col("_t") * 1000) / 10, "cost_share": F.when(F.col("_p") > 0, F.round(F.col("cost") / F.col("_c") * 1000) / 10)}).drop("_t", "_c", "_p")


@query("cost_rollup", f"WITH {PR} SELECT date, substr(date, 1, 7) AS month, provider, model, {COSTS} FROM priced GROUP BY GROUPING SETS ((), (date), (month), (provider), (provider, model), (date, provider), (month, provider))".replace("substr(date, 1, 7) AS month, provider, model, CAST(sum(cost)", "month, provider, model, CAST(sum(cost)").replace("FROM priced GROUP BY GROUPING", "FROM (SELECT *, substr(date, 1, 7) AS month FROM priced) GROUP BY GROUPING"))
def _rollup(spark, d):
    return P.cost_rollup(B.priced(spark, d))


@query("provenance_rollup", f"WITH {PR} SELECT provenance, count(DISTINCT (provider, model)) AS models, CAST(sum(cost) AS BIGINT) AS cost, CAST(sum(priced_tokens) AS BIGINT) AS tokens FROM priced WHERE priced_tokens > 0 GROUP BY provenance")
def _provenance(spark, d):
    return P.provenance_rollup(B.priced(spark, d))


@query("unpriced_models", f"WITH {PR} SELECT provider, model, CAST(sum(unpriced_tokens) AS BIGINT) AS unpriced_tokens FROM priced GROUP BY ALL HAVING sum(unpriced_tokens) <> 0")
def _unpriced(spark, d):
    return P.unpriced_models(B.priced(spark, d))


@query("weighted_rates", f"WITH {PR} SELECT provider, model, CAST(sum(cost) AS BIGINT) AS cost, CAST(sum(priced_tokens) AS BIGINT) AS priced_tokens, CASE WHEN sum(priced_tokens) <> 0 THEN CAST(sum(cost) // sum(priced_tokens) AS BIGINT) END AS rate FROM priced GROUP BY provider, model")
def _weighted(spark, d):
    return P.weighted_rates(B.priced(spark, d))


@query("rate_listing", """WITH r AS (SELECT p_brand AS model, nullif(1990 + p_size % 10, 1990) AS y, CAST(floor(min(p_retailprice)) AS BIGINT) AS base_input, CAST(floor(max(p_retailprice)) AS BIGINT) AS output FROM part GROUP BY 1, 2),
    f AS (SELECT model, base_input, output, y || '-01-01' AS effective_from FROM r) SELECT *, row_number() OVER (PARTITION BY model ORDER BY coalesce(effective_from, '')) AS place FROM f""")
def _rate_listing(spark, d):
    year = 1990 + F.col("p_size") % 10
    r = B.table(spark, d, "part").groupBy(F.col("p_brand").alias("model"), year.alias("y")).agg(F.floor(F.min("p_retailprice")).alias("base_input"), F.floor(F.max("p_retailprice")).alias("output"))
    return P.listing(r.select("model", "base_input", "output", F.when(F.col("y") > 1990, F.concat("y", F.lit("-01-01"))).alias("effective_from")))


@query("state_of_the_store", f"WITH {U} SELECT count(*) AS rows, count(DISTINCT model) AS models, min(date) AS first_date, max(date) AS last_date FROM usage")
def _store_state(spark, d):
    return Y.store_state(B.usage(spark, d))


@query("capped_models", f"WITH {PR}, k AS (SELECT provider AS session_id, date, model, cost, row_number() OVER (PARTITION BY provider ORDER BY cost DESC, date, model) AS rank FROM priced) SELECT session_id, date, model, rank FROM k WHERE rank <= 32")
def _capped(spark, d):
    rows = B.priced(spark, d).withColumn("session_id", F.col("provider"))
    return P.cap_models(rows).select("session_id", "date", "model", F.col("rank").cast("long").alias("rank"))


@query("milli_rates", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(round(o_totalprice * 1000) AS BIGINT) END AS milli FROM orders")
def _milli(spark, d):
    text = F.format_string("%.2f", F.col("o_totalprice"))
    return B.table(spark, d, "orders").select("o_orderkey", money.milli_rate(F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("-"), text)).otherwise(text)).alias("milli"))


@query("user_rate_overlay", f"""WITH {U}, {B.RATES_SQL}, merged AS (SELECT * FROM rates WHERE model NOT IN ('Brand#3', 'Brand#5') UNION ALL VALUES ('Brand#3', 700, NULL, NULL, NULL, 900, 'user', NULL, NULL), ('Brand#5', 1, 2, 3, 3, 4, 'user', NULL, NULL)),
    rated AS (SELECT u.*, base_input, r_read, w5m, w1h, r_output, status, input - cache_read - cache_write_5m - cache_write_1h - cache_write_unclassified AS base FROM usage u LEFT JOIN merged r ON u.model = r.model AND (effective_from IS NULL OR date >= effective_from) AND (effective_until IS NULL OR date <= effective_until)),
    priced AS (SELECT *, CAST({B._COST} AS BIGINT) AS cost, CAST({B._PRICED} AS BIGINT) AS priced_tokens, CAST({B._UNPRICED} AS BIGINT) AS unpriced_tokens FROM rated)
    SELECT model, {COSTS} FROM priced GROUP BY model""")
def _overlay(spark, d):
    own = P.user_rates(spark, {"Brand#3": {"input": 700, "output": 900}, "Brand#5": {"input": 1, "output": 4, "cache_read": 2, "cache_write": 3}})
    return P.price(B.usage(spark, d), P.overlay(B.rates(spark), own)).groupBy("model").agg(*P.costs())


@query("export_rows", f"""WITH {PR} SELECT date, substr(date, 1, 7) AS month, strftime(CAST(date AS DATE), '%B') AS month_name, substr(date, 1, 4) AS year, provider, model, {", ".join(C.BUCKETS)}, input + output AS total, CASE WHEN priced_tokens > 0 THEN cost END AS cost, coalesce(provenance, '') AS provenance FROM priced""")
def _export(spark, d):
    p = B.priced(spark, d)
    return p.select("date", F.substring("date", 1, 7).alias("month"), times.month_name(F.col("date")).alias("month_name"), F.substring("date", 1, 4).alias("year"), "provider", "model", *C.BUCKETS, (F.col("input") + F.col("output")).alias("total"), F.when(F.col("priced_tokens") > 0, F.col("cost")).alias("cost"), F.coalesce("provenance", F.lit("")).alias("provenance"))


@query("usd_text", f"WITH {PR} SELECT date, provider, model, CAST((cost + 5000000) // 10000000 AS BIGINT) AS cents, printf('%d.%02d', (cost + 5000000) // 10000000 // 100, (cost + 5000000) // 10000000 % 100) AS usd, format('{{:,}}', input) AS input_text FROM priced")
def _usd(spark, d):
    return B.priced(spark, d).select("date", "provider", "model", money.cents(F.col("cost")).alias("cents"), money.usd(F.col("cost")).alias("usd"), money.thousands(F.col("input")).alias("input_text"))


@query("nearest_models", "SELECT DISTINCT p_brand AS model, levenshtein(lower(p_brand), 'brnd#11') AS distance FROM part WHERE levenshtein(lower(p_brand), 'brnd#11') <= 2 ORDER BY distance, model LIMIT 3")
def _nearest(spark, d):
    return P.nearest_models("Brnd#11", B.table(spark, d, "part").select(F.col("p_brand").alias("model")).distinct())


# --- calendar


@query("day_spine", f"WITH {DAYS}, spine AS (SELECT strftime(unnest(generate_series((SELECT min(CAST(date AS DATE)) FROM days), (SELECT max(CAST(date AS DATE)) FROM days), INTERVAL 1 DAY)), '%Y-%m-%d') AS date) SELECT date, coalesce(cost, 0) AS cost FROM spine LEFT JOIN days USING (date)")
def _spine(spark, d):
    return K.dense_days(day_costs(spark, d), "cost")


_LEVELS = f"""{DAYS}, p AS (SELECT list_sort(list(cost)) AS v FROM days WHERE cost > 0),
    q AS (SELECT v[CAST(ceil(len(v) / 4) AS BIGINT)] AS q1, v[CAST(ceil(len(v) * 2 / 4) AS BIGINT)] AS q2, v[CAST(ceil(len(v) * 3 / 4) AS BIGINT)] AS q3, v[len(v)] AS most FROM p)"""


@query("heat_levels", f"""WITH {_LEVELS} SELECT date, cost, CASE WHEN cost <= 0 THEN 0 WHEN cost = most THEN 4 WHEN cost > q3 THEN 4
    WHEN (CASE WHEN cost <= q1 THEN q1 WHEN cost <= q2 THEN q2 ELSE q3 END) = q3 THEN 3 WHEN (CASE WHEN cost <= q1 THEN q1 ELSE q2 END) = q2 THEN 2 ELSE 1 END AS level FROM days, q""")
def _levels(spark, d):
    return K.levels(day_costs(spark, d), "cost")


_ISLANDS = f"{DAYS}, a AS (SELECT CAST(date AS DATE) AS d, CAST(date AS DATE) - CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS island FROM days WHERE cost > 0)"


@query("streaks", f"WITH {_ISLANDS} SELECT strftime(min(d), '%Y-%m-%d') AS first, strftime(max(d), '%Y-%m-%d') AS last, count(*) AS days FROM a GROUP BY island")
def _streaks(spark, d):
    return K.streaks(day_costs(spark, d), "cost")


@query("heat_statistics", f"WITH {_ISLANDS}, runs AS (SELECT count(*) AS n FROM a GROUP BY island) SELECT count(*) FILTER (WHERE cost > 0) AS active_days, CAST(coalesce(sum(cost), 0) AS BIGINT) AS total, (SELECT date FROM days WHERE cost > 0 ORDER BY cost DESC, date LIMIT 1) AS busiest_day, (SELECT coalesce(max(n), 0) FROM runs) AS longest_streak FROM days")
def _heat_statistics(spark, d):
    return K.heat_statistics(day_costs(spark, d), "cost")


@query("week_over_week", f"WITH {DAYS}, w AS (SELECT date, avg(cost) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS now, avg(cost) OVER (ORDER BY date ROWS BETWEEN 13 PRECEDING AND 7 PRECEDING) AS base FROM days) SELECT date, CASE WHEN base > 0 THEN round((now - base) / base * 100, 6) END AS delta FROM w")
def _wow(spark, d):
    return K.week_over_week(day_costs(spark, d), "cost")


_SPARK = f"{DAYS}, last AS (SELECT * FROM days ORDER BY date DESC LIMIT 30), b AS (SELECT CAST((row_number() OVER (ORDER BY date) - 1) * 10 // count(*) OVER () AS INTEGER) AS bucket, cost FROM last), s AS (SELECT bucket, CAST(sum(cost) AS BIGINT) AS value FROM b GROUP BY bucket)"


@query("sparkline", f"WITH {_SPARK} SELECT bucket, value, CASE WHEN max(value) OVER () = min(value) OVER () THEN 0 ELSE CAST(round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) * 7) AS INTEGER) END AS height FROM s")
def _sparkline(spark, d):
    return K.sparkline(day_costs(spark, d).orderBy(F.desc("date")).limit(30), "cost")


@query("compressed_days", f"WITH {DAYS}, n AS (SELECT greatest(CAST(ceil(count(*) / 30) AS BIGINT), 1) AS size FROM days), b AS (SELECT CAST((row_number() OVER (ORDER BY date) - 1) // size AS INTEGER) AS bucket, date, cost FROM days, n) SELECT bucket, min(date) AS first_date, CAST(sum(cost) // count(*) AS BIGINT) AS value FROM b GROUP BY bucket")
def _compressed(spark, d):
    return K.compress(day_costs(spark, d), "cost")


@query("rails", f"""WITH {DAYS}, x AS (SELECT *, CAST('{TODAY}' AS DATE) - CAST(date AS DATE) AS age FROM days) SELECT CAST(coalesce(sum(cost) FILTER (WHERE age = 0), 0) AS BIGINT) AS today, CAST(coalesce(sum(cost) FILTER (WHERE age BETWEEN 0 AND 6), 0) AS BIGINT) AS last_7,
    CAST(coalesce(sum(cost) FILTER (WHERE age BETWEEN 0 AND 29), 0) AS BIGINT) AS last_30, (SELECT date FROM x WHERE age BETWEEN 0 AND 29 AND cost > 0 ORDER BY cost DESC, date LIMIT 1) AS peak_day, coalesce(max(cost) FILTER (WHERE age BETWEEN 0 AND 29), 0) AS peak FROM x""")
def _rails(spark, d):
    return K.rails(day_costs(spark, d), TODAY)


@query("year_grid", f"""WITH {DAYS}, g AS (SELECT DISTINCT substr(date, 1, 4) || '-' || lpad(CAST(m AS VARCHAR), 2, '0') AS month FROM days, range(1, 13) t(m)), x AS (SELECT substr(date, 1, 7) AS month, * FROM days),
    s AS (SELECT month, count(*) FILTER (WHERE cost > 0) AS active_days, CAST(sum(cost) AS BIGINT) AS value, arg_min(date, (-cost, date)) FILTER (WHERE cost > 0) AS peak_day FROM x GROUP BY month)
    SELECT month, coalesce(active_days, 0) AS active_days, coalesce(value, 0) AS value, peak_day, CASE WHEN active_days > 0 THEN value // active_days ELSE 0 END AS average FROM g LEFT JOIN s USING (month)""")
def _year_grid(spark, d):
    return K.year_grid(day_costs(spark, d))


@query("zoom_year", f"WITH {DAYS} SELECT substr(date, 1, 7) AS period, CAST(sum(cost) AS BIGINT) AS cost FROM days WHERE substr(date, 1, 4) = '1997' GROUP BY 1")
def _zoom_year(spark, d):
    return K.zoomed(day_costs(spark, d), "year", 1997).groupBy("period").agg(F.sum("cost").alias("cost"))


@query("zoom_month", f"WITH {DAYS} SELECT date AS period, cost FROM days WHERE substr(date, 1, 7) = '1997-05'")
def _zoom_month(spark, d):
    return K.zoomed(day_costs(spark, d), "month", month="1997-05").select("period", "cost")


_MATRIX_DAYS = [f"1998-06-{k:02d}" for k in range(21, 31)]


@query("model_matrix", f"WITH {PR} SELECT provider, model, {', '.join(f'''CAST(coalesce(sum(cost) FILTER (WHERE date = '{x}'), 0) AS BIGINT) AS d{x.replace('-', '')}''' for x in _MATRIX_DAYS)}, CAST(sum(cost) AS BIGINT) AS row_total FROM priced WHERE date IN ({', '.join(map(repr, _MATRIX_DAYS))}) GROUP BY provider, model")
def _matrix(spark, d):
    return K.matrix(B.priced(spark, d), _MATRIX_DAYS)


@query("model_recency", f"WITH {U}, m AS (SELECT provider, model, max(date) AS last_date FROM usage GROUP BY ALL) SELECT *, greatest(0, CAST(DATE '2001-10-01' - CAST(last_date AS DATE) AS INTEGER)) AS recency_days FROM m")
def _recency(spark, d):
    return K.recency(B.usage(spark, d).groupBy("provider", "model").agg(F.max("date").alias("last_date")), "2001-10-01")


@query("hour_profile", "SELECT CAST(h AS INTEGER) AS hour, count(ts) AS n, count(ts) FILTER (WHERE event_type = 'error') AS masked FROM range(24) t(h) LEFT JOIN events ON extract(hour FROM ts) = h GROUP BY h")
def _hours(spark, d):
    return K.hour_profile(B.table(spark, d, "events"), "ts", "event_type = 'error'")


@query("weekday_profile", "SELECT CAST(w AS INTEGER) AS weekday, count(ts) AS n FROM range(7) t(w) LEFT JOIN events ON extract(dow FROM ts) = w GROUP BY w")
def _weekdays(spark, d):
    return K.weekday_profile(B.table(spark, d, "events"), "ts")


@query("local_days", "SELECT strftime(timezone('America/New_York', timezone('UTC', ts)), '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def _local_days(spark, d):
    return B.table(spark, d, "events").groupBy(times.local_day(F.col("ts"), "America/New_York").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("calendar_labels", "SELECT event_id, strftime(ts, '%A') AS weekday, strftime(ts, '%H') AS hour, strftime(ts, '%Y-%m') AS month, strftime(ts, '%b %d %Y') AS label FROM events")
def _labels(spark, d):
    ts = F.col("ts")
    return B.table(spark, d, "events").select("event_id", times.weekday(ts).alias("weekday"), times.hour(ts).alias("hour"), times.month(ts).alias("month"), times.span_label(ts, ts).alias("label"))
