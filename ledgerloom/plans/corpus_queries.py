"""The registered queries on the driver's tables, each with its oracle: extraction, corpus, search, samples, graph, archive, pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.functions import times
from ledgerloom.operators import attribution as A
from ledgerloom.operators import corpus as R
from ledgerloom.operators import extraction as X
from ledgerloom.operators import fulltext as K
from ledgerloom.operators import graph as G
from ledgerloom.operators import maintenance as D
from ledgerloom.operators import merging as MG
from ledgerloom.operators import pagination as N
from ledgerloom.operators import pricing as P
from ledgerloom.operators import sampling as M
from ledgerloom.operators import search as H
from ledgerloom.operators import seekable
from ledgerloom.operators import vault as V
from ledgerloom.plans import bindings as B
from ledgerloom.plans import cost_cache
from ledgerloom.plans import history_reports as Z
from ledgerloom.sources import buckets
from ledgerloom.sources.jsonl import content_owners, line_statistics
from ledgerloom.sources.scratch import kept, new_folder

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


Q = B.CORPUS_SQL
FIRST, LAST = "2024-01-10T00:00:00", "2024-01-25T00:00:00"

# --- extraction

_ASOF = f"""{B.LOG_SQL}, m AS (SELECT *, last_value(context_model IGNORE NULLS) OVER w AS before, first_value(context_model IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later
    FROM log WINDOW w AS (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("model_attribution", f"WITH {_ASOF} SELECT path, line_no, tokens, coalesce(before, later, 'unknown') AS model, before IS NULL AS buffered FROM m WHERE is_count AND tokens > 0")
def _attribution(spark, d):
    rows = X.attribute_models(B.log_events(spark, d), ["path"], ["line_no"])
    return rows.filter("is_count and tokens > 0").select("path", "line_no", "tokens", "model", "buffered")


@query("tokens_by_model_and_day", f"WITH {_ASOF} SELECT strftime(ts, '%Y-%m-%d') AS date, coalesce(before, later, 'unknown') AS model, CAST(sum(tokens) AS BIGINT) AS tokens FROM m WHERE is_count AND tokens > 0 GROUP BY 1, 2")
def _tokens_by_model(spark, d):
    rows = X.to_cube_rows(X.attribute_models(B.log_events(spark, d), ["path"], ["line_no"]).filter("is_count and tokens > 0"))
    return rows.groupBy("date", "model").agg(F.sum("tokens").alias("tokens"))


_PROGRESSIVE = f"""{B.SNAPSHOTS_SQL}, r AS (SELECT *, max(score) OVER (PARTITION BY message_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM snapshots),
    records AS (SELECT * FROM r WHERE best IS NULL OR score > best), k AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY line_no DESC) AS place, min(ts) OVER (PARTITION BY message_id) AS first FROM records)"""


@query("progressive_snapshots", f"WITH {_PROGRESSIVE} SELECT message_id, line_no, score, strftime(first, '%Y-%m-%d %H:%M:%S') AS first_ts FROM k WHERE place = 1")
def _progressive(spark, d):
    kept = X.progressive(B.snapshots(spark, d), "message_id", ["line_no"])
    return kept.select("message_id", "line_no", "score", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("first_ts"))


@query("snapshot_diagnostics", f"WITH {_PROGRESSIVE} SELECT count(DISTINCT message_id) AS retained, count(best) AS duplicates, count(*) FILTER (WHERE best <> score) AS differing FROM r")
def _snapshot_diagnostics(spark, d):
    return X.dedupe_diagnostics(B.snapshots(spark, d), "message_id", ["line_no"])


@query("counter_resets", "WITH x AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events WHERE event_type = 'purchase') SELECT user_id, count(*) FILTER (WHERE value < before) AS resets, count(*) FILTER (WHERE value = before) AS repeats FROM x GROUP BY user_id")
def _resets(spark, d):
    return X.counter_changes(B.table(spark, d, "events").filter("event_type = 'purchase'"), "user_id", "event_id", "value")


@query("listing_against_checkpoints", """WITH c AS (SELECT 'p' || c_custkey AS path, CAST(floor(c_acctbal) AS BIGINT) AS size FROM customer WHERE c_mktsegment <> 'BUILDING'), o AS (SELECT 'p' || o_custkey AS path, CAST(floor(max(o_totalprice)) AS BIGINT) AS size FROM orders GROUP BY 1)
    SELECT coalesce(o.path, c.path) AS path, CASE WHEN o.path IS NULL THEN 'missing' WHEN c.path IS NULL THEN 'new' WHEN o.size = c.size THEN 'unchanged' ELSE 'rewritten' END AS kind FROM o FULL JOIN c ON o.path = c.path""")
def _freshness(spark, d):
    from ledgerloom.sources.jsonl import classify_files

    c = B.table(spark, d, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("path"), F.floor("c_acctbal").alias("size"), F.lit(0).alias("mtime"))
    o = B.table(spark, d, "orders").groupBy(F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("path")).agg(F.floor(F.max("o_totalprice")).alias("size"), F.lit(0).alias("mtime"))
    return classify_files(o, c)


@query("customers_without_orders", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _anti(spark, d):
    return G.unsupported(B.table(spark, d, "customer"), B.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey", "c_name")


@query("duplicate_contents", "SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS owner FROM documents")
def _owners(spark, d):
    return content_owners(B.table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content"))).withColumnRenamed("path", "doc_id")


@query("file_extents", "SELECT user_id AS path, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts, count(*) AS line_count FROM events GROUP BY user_id")
def _extents(spark, d):
    f = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    lines = B.table(spark, d, "events").select(F.col("user_id").alias("path"), F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), "event_id")).alias("raw"))
    return line_statistics(lines).select("path", f("first_ts"), f("last_ts"), "line_count")


# --- corpus


@query("prompt_listing", f"WITH {Q} SELECT prompt_id, session_id, ts, repository FROM prompts p JOIN sessions s USING (session_id) WHERE searchable AND role = 'user' AND kind = 'human' AND EXISTS (SELECT 1 FROM occurrences o WHERE o.prompt_id = p.prompt_id AND available)")
def _listing(spark, d):
    p = R.available_prompts(B.prompts(spark, d).filter(R.prompt_filter()), B.occurrences(spark, d))
    return p.join(B.sessions(spark, d).select("session_id", "repository"), "session_id").select("prompt_id", "session_id", "ts", "repository")


@query("prompts_by_role_and_consent", f"WITH {Q} SELECT prompt_id, role FROM prompts WHERE searchable AND (role <> 'user' OR kind = 'human') AND kind <> 'control' AND (role <> 'assistant' OR provider = 'codex')")
def _consent(spark, d):
    return B.prompts(spark, d).filter(R.prompt_filter(role=None, exclude_control=True, consented=["codex"])).select("prompt_id", "role")


@query("prompts_in_vault", f"WITH {Q} SELECT prompt_id FROM prompts p WHERE EXISTS (SELECT 1 FROM occurrences o WHERE o.prompt_id = p.prompt_id AND available AND o.kind = 'vault')")
def _in_vault(spark, d):
    return R.available_prompts(B.prompts(spark, d), B.occurrences(spark, d), "vault").select("prompt_id")


@query("prompts_in_time", f"WITH {Q} SELECT prompt_id, ts FROM prompts WHERE ts >= '{FIRST}' AND ts <= '{LAST}'")
def _in_time(spark, d):
    return B.prompts(spark, d).filter(R.in_time("ts", FIRST, LAST)).select("prompt_id", "ts")


@query("overlapping_sessions", f"WITH {Q} SELECT session_id, first_ts, last_ts FROM sessions WHERE last_ts >= '{FIRST}' AND first_ts <= '{LAST}'")
def _overlapping(spark, d):
    return R.overlapping(B.sessions(spark, d), FIRST, LAST).select("session_id", "first_ts", "last_ts")


@query("active_sessions", f"WITH {Q} SELECT session_id FROM sessions s WHERE EXISTS (SELECT 1 FROM prompts p WHERE p.session_id = s.session_id AND p.ts >= '{FIRST}' AND p.ts <= '{LAST}')")
def _active(spark, d):
    return R.active_sessions(B.sessions(spark, d), B.prompts(spark, d), FIRST, LAST).select("session_id")


_KNOWN = "count(*) FILTER (WHERE coalesce({0}, '') <> '') AS {0}_known, count(*) FILTER (WHERE coalesce({0}, '') = '') AS {0}_unknown"


@query("catalog_coverage", f"""WITH {Q} SELECT count(*) AS sessions, {_KNOWN.format("repository")}, {_KNOWN.format("branch")}, count(*) FILTER (WHERE project_source = 'git') AS project_git, count(*) FILTER (WHERE project_source = 'cwd') AS project_cwd,
    count(*) FILTER (WHERE coalesce(project, '') = '') AS project_unknown, count(*) FILTER (WHERE thread_kind = 'root') AS root, count(*) FILTER (WHERE thread_kind = 'subagent') AS subagent, count(*) FILTER (WHERE thread_kind = 'unknown') AS thread_unknown FROM sessions""")
def _catalog_coverage(spark, d):
    return R.catalog_coverage(B.sessions(spark, d))


@query("prompt_coverage", f"WITH {Q} SELECT min(p.ts) AS first_ts, max(p.ts) AS last_ts, count(DISTINCT session_id) AS sessions, count(DISTINCT CASE WHEN coalesce(repository, '') <> '' THEN session_id END) AS repository_known, count(DISTINCT CASE WHEN coalesce(branch, '') <> '' THEN session_id END) AS branch_known FROM prompts p JOIN sessions USING (session_id)")
def _prompt_coverage(spark, d):
    return R.prompt_coverage(B.prompts(spark, d), B.sessions(spark, d))


@query("role_statistics", f"WITH {Q} SELECT role, count(*) AS prompts, count(DISTINCT session_id) AS sessions, CAST(sum(strlen(text)) AS BIGINT) AS bytes, min(ts) AS first_ts, max(ts) AS last_ts FROM prompts GROUP BY role")
def _roles(spark, d):
    return R.role_statistics(B.prompts(spark, d))


@query("corpus_statistics", f"""WITH {Q} SELECT (SELECT count(*) FROM sessions) AS sessions, count(*) AS prompts, count(DISTINCT substr(ts, 1, 10)) AS active_days, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS bytes, CAST(coalesce(median(strlen(text)), 0) AS DOUBLE) AS median_bytes, count(*) FILTER (WHERE NOT searchable) AS not_searchable,
    (SELECT count(*) FROM occurrences) AS occurrences, (SELECT count(*) FROM occurrences WHERE available AND kind = 'provider_live') AS provider_live, (SELECT count(*) FROM occurrences WHERE available AND kind = 'provider_archive') AS provider_archive, (SELECT count(*) FROM occurrences WHERE available AND kind = 'vault') AS vault FROM prompts""")
def _corpus(spark, d):
    return R.corpus_statistics(B.sessions(spark, d), B.prompts(spark, d), B.occurrences(spark, d))


@query("occurrence_counts", f"WITH {Q} SELECT prompt_id, count(location_id) AS n, count(location_id) FILTER (WHERE o.kind = 'vault') AS vault FROM prompts p LEFT JOIN (SELECT * FROM occurrences WHERE available) o USING (prompt_id) GROUP BY prompt_id")
def _occurrences(spark, d):
    return R.occurrence_counts(B.prompts(spark, d), B.occurrences(spark, d))


@query("project_labels", f"WITH {Q}, n AS (SELECT project, count(*) AS n FROM sessions GROUP BY project) SELECT session_id, CASE WHEN trim(coalesce(project, '')) = '' THEN 'unknown' WHEN n < 2 THEN 'other' ELSE project END AS project_label FROM sessions JOIN n USING (project) WHERE thread_kind = 'root'")
def _labels(spark, d):
    s = B.sessions(spark, d)
    return R.fold_rare(s.filter("thread_kind = 'root'"), s).select("session_id", "project_label")


def _grouped(spark, d, dims):
    s = B.sessions(spark, d)
    p = B.prompts(spark, d)
    return R.grouped_statistics(R.fold_rare(s, s), p, R.occurrence_counts(p, B.occurrences(spark, d)), dims)


_FACTS = f"""{Q}, n AS (SELECT project, count(*) AS n FROM sessions GROUP BY project), labelled AS (SELECT s.*, CASE WHEN trim(coalesce(project, '')) = '' THEN 'unknown' WHEN n < 2 THEN 'other' ELSE project END AS project_label FROM sessions s JOIN n USING (project)),
    counts AS (SELECT prompt_id, count(*) AS n FROM occurrences WHERE available GROUP BY prompt_id),
    facts AS (SELECT session_id, prompt_id, role, ts, coalesce(n, 0) AS n, strlen(text) AS bytes FROM prompts LEFT JOIN counts USING (prompt_id))"""
_MEASURES = "count(DISTINCT session_id) AS sessions, count(DISTINCT prompt_id) AS prompts, CAST(coalesce(sum(n), 0) AS BIGINT) AS occurrences, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes"


@query("statistics_by_provider_and_thread", f"WITH {_FACTS} SELECT provider, thread_kind, {_MEASURES} FROM labelled LEFT JOIN facts USING (session_id) GROUP BY 1, 2")
def _by_provider(spark, d):
    return _grouped(spark, d, ["provider", "thread_kind"])


@query("statistics_by_project", f"WITH {_FACTS} SELECT project_label AS project, {_MEASURES} FROM labelled LEFT JOIN facts USING (session_id) GROUP BY 1")
def _by_project(spark, d):
    return _grouped(spark, d, ["project"])


@query("statistics_by_repository", f"WITH {_FACTS} SELECT coalesce(nullif(lower(trim(repository)), ''), 'unknown') AS repository, {_MEASURES} FROM labelled LEFT JOIN facts USING (session_id) GROUP BY 1")
def _by_repository(spark, d):
    return _grouped(spark, d, ["repository"])


@query("statistics_by_weekday_hour_role", f"WITH {_FACTS} SELECT CASE WHEN ts IS NULL THEN 'unknown' ELSE strftime(strptime(substr(ts, 1, 19), '%Y-%m-%dT%H:%M:%S'), '%A') END AS weekday, coalesce(substr(ts, 12, 2), 'unknown') AS hour, role, {_MEASURES} FROM labelled JOIN facts USING (session_id) GROUP BY 1, 2, 3")
def _by_weekday(spark, d):
    return _grouped(spark, d, ["weekday", "hour", "role"])


@query("top_projects_and_other", f"""WITH {_FACTS}, sizes AS (SELECT project_label AS k, count(DISTINCT session_id) AS n FROM labelled GROUP BY 1), top AS (SELECT k FROM sizes ORDER BY k IN ('unknown', 'other') DESC, n DESC, lower(k), k LIMIT 5)
    SELECT CASE WHEN k IS NOT NULL THEN project_label ELSE 'other' END AS label, count(DISTINCT session_id) AS sessions, count(*) AS rows FROM labelled LEFT JOIN top ON project_label = k GROUP BY 1""")
def _top_projects(spark, d):
    s = B.sessions(spark, d)
    return R.top_and_other(R.fold_rare(s, s), "project_label", "session_id", 5, ("unknown", "other"))


@query("sessions_by_day", f"WITH {Q} SELECT substr(ts, 1, 10) AS date, count(DISTINCT session_id) AS sessions, count(DISTINCT provider) AS providers, min(ts) AS first_ts FROM prompts WHERE ts IS NOT NULL GROUP BY 1")
def _by_day(spark, d):
    return R.sessions_by_day(B.prompts(spark, d))


@query("activity_endpoints", f"WITH {Q}, e AS (SELECT session_id, substr(ts, 1, 10) AS date, min(ts) AS a, max(ts) AS b FROM prompts WHERE ts IS NOT NULL GROUP BY 1, 2) SELECT session_id, date, a AS ts FROM e UNION SELECT session_id, date, b FROM e")
def _endpoints(spark, d):
    return R.activity_endpoints(B.prompts(spark, d))


@query("model_sessions", f"WITH {_ASOF}, x AS (SELECT DISTINCT path, event_type, coalesce(before, later, 'unknown') AS model FROM m) SELECT event_type AS provider, model, count(*) AS sessions FROM x GROUP BY 1, 2")
def _model_sessions(spark, d):
    rows = X.attribute_models(B.log_events(spark, d), ["path"], ["line_no"])
    return R.model_sessions(rows.select(F.col("path").alias("session_id"), F.col("event_type").alias("provider"), "model"))


@query("canonical_prompts", f"WITH {Q}, k AS (SELECT *, row_number() OVER (PARTITION BY session_id, role ORDER BY ts IS NULL, ts DESC, strlen(text) DESC, prompt_id) AS place FROM prompts) SELECT session_id, role, prompt_id FROM k WHERE place = 1")
def _canonical(spark, d):
    return R.canonical(B.prompts(spark, d), ["session_id", "role"], [F.col("ts").isNull(), F.desc("ts"), F.desc(F.octet_length("text")), F.col("prompt_id")]).select("session_id", "role", "prompt_id")


@query("newest_rows_by_session", f"WITH {Q}, k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS place FROM prompts) SELECT session_id, prompt_id FROM k WHERE place <= 3")
def _newest(spark, d):
    return R.top_k(B.prompts(spark, d), ["session_id"], [F.desc("turn")], 3).select("session_id", "prompt_id")


@query("merged_metadata", f"""WITH {Q} SELECT native_id, arg_max(repository, (last_ts, session_id)) FILTER (WHERE coalesce(repository, '') <> '') AS repository, arg_max(branch, (last_ts, session_id)) FILTER (WHERE branch <> '') AS branch
    FROM (SELECT session_id, coalesce(last_ts, '') AS last_ts, repository, branch, cwd AS native_id FROM sessions) GROUP BY native_id""")
def _merged(spark, d):
    s = B.sessions(spark, d).withColumns({"native_id": F.col("cwd"), "last_ts": F.coalesce("last_ts", F.lit(""))})
    return R.merged(s, "native_id", ["repository", "branch"], [F.col("last_ts"), F.col("session_id")])


@query("provenance_lists", f"WITH {Q} SELECT prompt_id, string_agg(location_id, ',' ORDER BY location_id) AS locations FROM occurrences GROUP BY prompt_id")
def _provenance_lists(spark, d):
    return R.provenance_list(B.occurrences(spark, d))


@query("prompts_around", f"WITH {Q}, k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS n FROM prompts), t AS (SELECT session_id, n FROM k WHERE prompt_id = (SELECT min(prompt_id) FROM prompts WHERE turn = 2)) SELECT prompt_id, k.n - t.n AS \"offset\" FROM k JOIN t USING (session_id) WHERE abs(k.n - t.n) <= 2")
def _around(spark, d):
    p = B.prompts(spark, d)
    target = p.filter("turn = 2").agg(F.min("prompt_id")).first()[0]
    return R.around(p, "session_id", [F.col("turn")], F.col("prompt_id") == target, 2).select("prompt_id", "offset")


@query("project_list", f"WITH {Q} SELECT DISTINCT project, lower(project) AS k FROM sessions WHERE project <> ''")
def _projects(spark, d):
    return R.labels(B.sessions(spark, d), "project")


@query("text_functions", """SELECT doc_id, length(text) AS chars, strlen(text) AS bytes, sha256(text) AS sha, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16) AS sample_key, CASE WHEN substr(text, 1, 1) IN ('=', '+', '-', '@', chr(9), chr(13), chr(10)) THEN '''' || text ELSE text END AS guarded, right(source, 2) AS short FROM documents""")
def _text_functions(spark, d):
    x = F.col("text")
    return B.table(spark, d, "documents").select("doc_id", F.length(x).cast("long").alias("chars"), F.octet_length(x).cast("long").alias("bytes"), F.sha2(x, 256).alias("sha"), T.sample_key(F.col("doc_id")).alias("sample_key"), T.csv_guard(x).alias("guarded"), F.right("source", F.lit(2)).alias("short"))


#: The first four lines as hexadecimal digits, cut after 512 bytes or, where the next byte goes on with a character, before that character.
_HEAD = "h AS (SELECT doc_id, hex(encode(array_to_string(string_split(text, chr(10))[1:4], chr(10)))) AS x FROM documents), k AS (SELECT doc_id, x, CASE WHEN length(x) <= 1024 THEN length(x) " + " ".join(f"WHEN substr(x, {2 * c + 1}, 1) NOT IN ('8', '9', 'A', 'B') THEN {2 * c}" for c in (512, 511, 510)) + " ELSE 1018 END AS n FROM h)"


@query("previews", f"WITH {_HEAD} SELECT doc_id, decode(unhex(left(x, n))) AS head FROM k")
def _previews(spark, d):
    return B.table(spark, d, "documents").select("doc_id", T.preview(F.col("text")).alias("head"))


@query("instant_keys", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.250000000Z' AS key FROM events")
def _instants(spark, d):
    return B.table(spark, d, "events").select("event_id", times.instant_key(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".25Z"))).alias("key"))


@query("minimum_length", "SELECT conv_id, turn FROM conversations WHERE length(text) >= 200")
def _minimum(spark, d):
    return R.long_enough(B.table(spark, d, "conversations"), "text", 200).select("conv_id", "turn")


# --- search

_WORDS = "regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+')"


def _phrase_sql(phrase: str) -> str:
    w = H.fold_text(phrase)
    return f"len(list_filter(range(0, len(w)), lambda i: {' AND '.join(f'w[i + {k + 1}] = ' + repr(x) for k, x in enumerate(w))}))"


_TOKENS = f"tokens AS (SELECT doc_id, text, {_WORDS} AS w FROM documents)"
_EN = "tokens AS (SELECT * FROM (SELECT doc_id, text, lang, " + _WORDS + " AS w FROM documents))"


@query("phrase_search", f"WITH {_TOKENS} SELECT doc_id, CAST({_phrase_sql('that the')} AS BIGINT) AS tf FROM tokens WHERE {_phrase_sql('that the')} > 0")
def _phrase(spark, d):
    return H.match_phrase(B.table(spark, d, "documents"), "text", "That THE").select("doc_id", "tf")


@query("postings_of_rare_terms", f"WITH {_TOKENS}, t AS (SELECT doc_id, unnest(w) AS term FROM tokens), p AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY ALL) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM p GROUP BY term HAVING count(*) >= 3")
def _postings(spark, d):
    p = H.postings(B.table(spark, d, "documents"), "doc_id", "text")
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).filter("df >= 3")


def _bm25_sql(terms: list[str]) -> str:
    tf = [_phrase_sql(t) for t in terms]
    columns = ", ".join(f"{c} AS tf{k}" for k, c in enumerate(tf))
    idf = [f"greatest(ln((n - df{k} + 0.5) / (df{k} + 0.5)), 1e-6)" for k in range(len(terms))]
    rank = " + ".join(f"{i} * (tf{k} * 2.2) / (tf{k} + 1.2 * (0.25 + 0.75 * size / mean))" for k, i in enumerate(idf))
    return f"""WITH {_TOKENS}, c AS (SELECT doc_id, len(w) AS size, {columns} FROM tokens), s AS (SELECT count(*) AS n, avg(size) AS mean, {", ".join(f"count(*) FILTER (WHERE tf{k} > 0) AS df{k}" for k in range(len(terms)))} FROM c)
    SELECT doc_id, round(-({rank}), 9) AS rank FROM c, s WHERE {" AND ".join(f"tf{k} > 0" for k in range(len(terms)))}"""


@query("bm25", _bm25_sql(["released", "mit license"]))
def _bm25(spark, d):
    return H.bm25(B.table(spark, d, "documents"), "doc_id", "text", ["released", "mit license"]).select("doc_id", F.round("rank", 9).alias("rank"))


@query("indexed_phrase_search", f"WITH {_TOKENS} SELECT doc_id, CAST({_phrase_sql('that the')} AS BIGINT) AS tf FROM tokens WHERE {_phrase_sql('that the')} > 0")
def _indexed_phrase(spark, d):
    return H.indexed_phrase(H.positions(B.table(spark, d, "documents"), "doc_id", "text"), "That THE").select("doc_id", "tf")


@query("indexed_bm25", _bm25_sql(["released", "mit license"]))
def _indexed_bm25(spark, d):
    docs, terms = B.table(spark, d, "documents"), ["released", "mit license"]
    index = kept(H.rows_of_terms(H.positions(docs, "doc_id", "text"), terms), "rows-of-terms")  # read once for each term and for its count
    return H.indexed_bm25(index, H.corpus_size(docs, "text"), terms).select("doc_id", F.round("rank", 9).alias("rank"))


@query("stale_index", f"WITH {_TOKENS}, t AS (SELECT doc_id, unnest(w) AS term FROM tokens) SELECT 'missing' AS side, term, doc_id, count(*) AS tf FROM t WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY ALL")
def _stale_index(spark, d):
    docs = B.table(spark, d, "documents")
    bad = B.table(spark, d, "labels").filter("quality = 0").select("doc_id")
    return D.index_differences(H.postings(docs.join(bad, "doc_id", "left_anti"), "doc_id", "text"), H.postings(docs, "doc_id", "text")).select("side", "term", "doc_id", "tf")


@query("listing_page", f"WITH {Q} SELECT prompt_id, ts FROM prompts p WHERE searchable AND role = 'user' AND kind = 'human' AND EXISTS (SELECT 1 FROM occurrences o WHERE o.prompt_id = p.prompt_id AND available) AND (ts IS NULL OR ts < '2024-01-20T00:00:00.000000000Z') ORDER BY ts IS NULL, ts DESC, prompt_id LIMIT 31")
def _listing_page(spark, d):
    return Z.listing(B.prompts(spark, d), B.occurrences(spark, d), size=30, last=["2024-01-20T00:00:00.000000000Z", 10**15]).select("prompt_id", "ts")


@query("top_groups", f"WITH {_FACTS} SELECT provider, thread_kind, {_MEASURES} FROM labelled LEFT JOIN facts USING (session_id) GROUP BY 1, 2 ORDER BY sessions DESC, provider, thread_kind LIMIT 4")
def _top_groups(spark, d):
    return Z.statistics(B.sessions(spark, d), B.prompts(spark, d), B.occurrences(spark, d), ["provider", "thread_kind"], 4)[1]


@query("disagreeing_roles", "WITH o AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS a, count(*) FILTER (WHERE o_orderstatus = 'O') AS b, date_diff('hour', min(o_orderdate), max(o_orderdate)) AS h FROM orders GROUP BY 1) SELECT o_custkey, abs(a - b) > 0.2 * greatest(a, b) OR h > 24 AS disagree FROM o")
def _disagree(spark, d):
    n = lambda k: F.count_if(F.col("o_orderstatus") == k)
    g = B.table(spark, d, "orders").groupBy("o_custkey").agg(n("F").alias("a"), n("O").alias("b"), ((F.unix_timestamp(F.max("o_orderdate")) - F.unix_timestamp(F.min("o_orderdate"))) / 3600).alias("h"))
    return g.select("o_custkey", R.roles_disagree(F.col("a"), F.col("b"), F.col("h")).alias("disagree"))


_BOOLEAN = '("apache license" OR mit) NOT gnu OR licens* general'


# --- an index that is kept: made of a part of the documents, changed, reduced and merged; each search reads its terms


def kept_index(spark: SparkSession, d: str) -> K.Index:
    """The documents' index after four steps: two thirds of the documents, one third of which with other texts; then all as they are; those divisible by 7 deleted; and merged."""
    docs, root = B.table(spark, d, "documents").select("doc_id", "text"), new_folder(spark, "index")
    i = F.col("doc_id") % 3
    first = docs.filter(i > 0).withColumn("text", F.when(i == 1, F.concat(F.lit("an older mit license text "), "text")).otherwise(F.col("text")))
    at = K.update(spark, root, 0, first, "doc_id", "text")
    at = K.update(spark, root, at, docs, "doc_id", "text")
    at = K.delete(spark, root, at, docs.filter("doc_id % 7 = 0").select("doc_id"))
    return K.open_index(spark, root, K.merge(spark, root, at))


_KEPT = _TOKENS.replace("FROM documents", "FROM documents WHERE doc_id % 7 <> 0")
_KEPT_BOOLEAN = '(("apache license" OR mit) NOT gnu) OR (licens* AND NEAR(general public, 2))'


@query("kept_index_search", f"""WITH {_KEPT} SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM tokens WHERE ((({_phrase_sql("apache license")} > 0 OR list_contains(w, 'mit')) AND NOT list_contains(w, 'gnu'))
    OR (len(list_filter(w, lambda x: starts_with(x, 'licens'))) > 0 AND len(list_filter(range(1, len(w) + 1), lambda i: w[i] = 'general' AND list_contains(w[greatest(1, i - 3) : i + 3], 'public'))) > 0))""")
def _kept_search(spark, d):
    return K.matched(kept_index(spark, d), H.parse(_KEPT_BOOLEAN))


@query("kept_index_bm25", _bm25_sql(["released", "mit license"]).replace(f"WITH {_TOKENS}", f"WITH {_KEPT}").replace("SELECT doc_id, round", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, round"))
def _kept_bm25(spark, d):
    return K.bm25(kept_index(spark, d), ["released", "mit license"]).select("doc_id", F.round("rank", 9).alias("rank"))


@query("kept_index_top", _bm25_sql(["released", "license"]).replace(f"WITH {_TOKENS}", f"WITH {_KEPT}").replace("SELECT doc_id, round", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, round").replace("tf0 > 0 AND tf1 > 0", "tf0 > 0 OR tf1 > 0") + " ORDER BY rank, doc_id LIMIT 10")
def _kept_top(spark, d):
    return K.top(kept_index(spark, d), ["released", "license"], 10)[0].select("doc_id", F.round("rank", 9).alias("rank"))


@query("kept_index_differences", "SELECT CAST(0 AS BIGINT) AS stale, CAST(0 AS BIGINT) AS missing, count(*) AS docs FROM documents WHERE doc_id % 7 <> 0")
def _kept_differences(spark, d):
    """What the kept index and one made anew don't share (FTS-7), and how many documents live."""
    index = kept_index(spark, d)
    found = K.differences(index, B.table(spark, d, "documents").filter("doc_id % 7 <> 0"), "doc_id", "text")
    return found.agg(F.count_if(F.col("side") == "stale").alias("stale"), F.count_if(F.col("side") == "missing").alias("missing")).withColumn("docs", F.lit(index.docs).cast("long"))


@query("boolean_search", f"""WITH {_TOKENS} SELECT doc_id FROM tokens WHERE ((({_phrase_sql("apache license")} > 0 OR list_contains(w, 'mit')) AND NOT list_contains(w, 'gnu')) OR (len(list_filter(w, lambda x: starts_with(x, 'licens'))) > 0 AND list_contains(w, 'general')))""")
def _boolean(spark, d):
    return H.with_tokens(B.table(spark, d, "documents"), "text").filter(H.boolean(F.col("_words"), H.parse(_BOOLEAN))).select("doc_id")


#: A phrase of two words, the first of which also stands alone: the window lies around the whole phrase, and only matches are in brackets.
@query("snippets", f"""WITH {_TOKENS}, m AS (SELECT doc_id, w, list_filter(range(1, len(w)), lambda i: w[i] = 'mit' AND w[i + 1] = 'license') AS places FROM tokens WHERE list_contains(w, 'license')),
    f AS (SELECT *, greatest(1, places[1] - 12) AS p FROM m WHERE len(places) > 0)
    SELECT doc_id, CASE WHEN p > 1 THEN '... ' ELSE '' END || array_to_string(list_transform(range(p, least(p + 23, len(w)) + 1), lambda i: CASE WHEN list_contains(places, i) THEN '[' || w[i] WHEN list_contains(places, i - 1) THEN w[i] || ']' ELSE w[i] END), ' ') || CASE WHEN p + 23 < len(w) THEN ' ...' ELSE '' END AS snippet FROM f""")
def _snippets(spark, d):
    docs = H.match_phrase(B.table(spark, d, "documents"), "text", "MIT license")
    return docs.select("doc_id", H.snippet(F.col("_words"), H.fold_text("MIT license")).alias("snippet"))


# --- samples

_SEED = "a fixed seed"
_KEYED = f"u AS (SELECT prompt_id, session_id, role, substr(sha256(CAST(prompt_id AS VARCHAR)), 1, 16) AS sample_key, substr(sha256('{_SEED}'), 1, 16) AS start_key FROM prompts)"


@query("random_sample", f"WITH {Q}, {_KEYED} SELECT prompt_id, sample_key FROM u ORDER BY sample_key < start_key, sample_key, prompt_id LIMIT 25")
def _random(spark, d):
    return M.random_sample(B.prompts(spark, d).select("prompt_id"), "prompt_id", 25, _SEED)


@query("stratified_sample", f"""WITH {Q}, {_KEYED}, k AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY sample_key < start_key, sample_key, prompt_id) AS turn, substr(sha256(role), 1, 16) AS gk FROM u)
    SELECT prompt_id, role, sample_key FROM k ORDER BY turn, gk < start_key, gk, role LIMIT 25""")
def _stratified(spark, d):
    return M.stratified_sample(B.prompts(spark, d).select("prompt_id", "role"), "prompt_id", "role", 25, _SEED).select("prompt_id", "role", "sample_key")


@query("one_per_session", f"WITH {Q}, {_KEYED}, k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY sample_key < start_key, sample_key, prompt_id) AS n FROM u) SELECT session_id, prompt_id FROM k WHERE n = 1")
def _one_per_session(spark, d):
    return M.one_per_session(B.prompts(spark, d).select("prompt_id", "session_id"), "prompt_id", "session_id", _SEED).select("session_id", "prompt_id")


@query("folded_strata", "WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), g AS (SELECT source || '/' || lang AS k, n FROM n) SELECT CASE WHEN n < 8 THEN 'other' ELSE k END AS stratum, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY 1")
def _strata(spark, d):
    docs = B.table(spark, d, "documents").select(F.concat("source", F.lit("/"), "lang").alias("stratum"))
    return M.group_sizes(M.fold_small(docs, "stratum", 8), ["stratum"])


@query("session_representatives", f"WITH {Q}, {_KEYED} SELECT u.session_id, arg_min(text, (sample_key < start_key, sample_key, u.prompt_id)) AS text FROM u JOIN prompts p USING (prompt_id) GROUP BY u.session_id")
def _representatives(spark, d):
    return M.representative(B.prompts(spark, d).select("prompt_id", "session_id", "text"), "session_id", "prompt_id", "text", _SEED)


@query("coverage_of_a_sample", f"WITH {Q}, {_KEYED}, i AS (SELECT prompt_id FROM u ORDER BY sample_key < start_key, sample_key, prompt_id LIMIT 25) SELECT min(p.ts) AS first_ts, max(p.ts) AS last_ts, count(DISTINCT session_id) AS sessions, count(DISTINCT CASE WHEN coalesce(repository, '') <> '' THEN session_id END) AS repository_known, count(DISTINCT CASE WHEN coalesce(branch, '') <> '' THEN session_id END) AS branch_known FROM prompts p JOIN i USING (prompt_id) JOIN sessions USING (session_id)")
def _sample_coverage(spark, d):
    return Z.sample_coverage(Z.sample(B.prompts(spark, d), "prompt_id", "random", 25, _SEED), B.sessions(spark, d))


# --- graph


@query("resolved_edges", f"""WITH {Q}, e AS (SELECT session_id AS child, parent_native, 'subagent' AS kind, provider FROM sessions WHERE thread_kind = 'subagent' AND coalesce(parent_native, '') <> '' UNION SELECT session_id, forked_from, 'fork', provider FROM sessions WHERE coalesce(forked_from, '') <> '')
    SELECT child, kind, e.parent_native, min(s.session_id) AS parent FROM e LEFT JOIN sessions s ON s.provider = e.provider AND s.native_id = e.parent_native AND s.session_id <> child GROUP BY ALL""")
def _edges(spark, d):
    s = B.sessions(spark, d)
    return G.resolve(G.edges(s), s)


def _tree(spark, d):
    s = B.sessions(spark, d).select("session_id")
    links = s.filter("session_id > 0").select(F.floor(F.col("session_id") / 2).alias("parent"), F.col("session_id").alias("child"))
    return G.tree(links, s.filter("session_id = 1").select(F.col("session_id").alias("node")), -F.col("child"))


@query("session_tree", f"""WITH RECURSIVE {Q}, t(node, depth, path) AS (SELECT session_id, 0, [CAST(0 AS BIGINT)] FROM sessions WHERE session_id = 1 UNION ALL SELECT s.session_id, depth + 1, list_append(path, -s.session_id) FROM t JOIN sessions s ON s.session_id // 2 = t.node AND s.session_id > 1 WHERE depth < 16)
    SELECT node, depth, row_number() OVER (ORDER BY path) - 1 AS place FROM t""")
def _session_tree(spark, d):
    return G.preorder(_tree(spark, d)).select("node", "depth", F.col("place").cast("long").alias("place"))


@query("canonical_ids", "SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 5 THEN c_custkey - 1 ELSE c_custkey END AS canonical FROM customer")
def _canonical_ids(spark, d):
    ids = B.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    aliases = ids.filter("id % 6 = 5").select(F.col("id").alias("alias"), (F.col("id") - 1).alias("canonical"))
    return G.canonical_ids(ids, aliases)


# --- archive


@query("latest_versions", f"WITH {B.MANIFEST_SQL} SELECT * FROM manifest m WHERE version = (SELECT max(version) FROM manifest n WHERE n.source_path = m.source_path)")
def _latest(spark, d):
    return V.latest(B.manifest(spark, d))


@query("vault_overlap", f"WITH {B.MANIFEST_SQL} SELECT source_path, version FROM manifest WHERE (last_ts IS NULL OR last_ts >= '1997-03-01') AND (first_ts IS NULL OR first_ts <= '1997-04-15')")
def _vault_overlap(spark, d):
    return V.overlapping(B.manifest(spark, d), "1997-03-01", "1997-04-15").select("source_path", "version")


@query("vault_status", f"WITH {B.MANIFEST_SQL} SELECT provider, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, count(DISTINCT archive) AS archives FROM manifest GROUP BY GROUPING SETS ((provider), ())")
def _vault_status(spark, d):
    return V.status(B.manifest(spark, d))


@query("vault_bundles", f"WITH {B.MANIFEST_SQL} SELECT archive, count(*) AS members, CAST(sum(size) AS BIGINT) AS bytes, min(first_ts) AS first_ts, max(last_ts) AS last_ts FROM manifest GROUP BY archive")
def _bundles(spark, d):
    return V.bundles(B.manifest(spark, d))


@query("vault_readiness", f"""WITH {B.MANIFEST_SQL}, l AS (SELECT 'c' || c_custkey AS path, CASE WHEN c_custkey % 3 = 0 THEN CAST(floor(c_acctbal) AS BIGINT) END AS changed, DATE '2001-01-01' - CAST(c_custkey % 4 AS INTEGER) AS mtime FROM customer),
    latest AS (SELECT * FROM manifest m WHERE version = (SELECT max(version) FROM manifest n WHERE n.source_path = m.source_path))
    SELECT path, CASE WHEN size IS NULL AND DATE '2001-01-01' - mtime < 1 THEN 'recent' WHEN size IS NULL THEN 'missing' WHEN coalesce(changed, size) = size THEN 'archived' ELSE 'changed' END AS state FROM l LEFT JOIN latest ON path = source_path""")
def _readiness(spark, d):
    m = B.manifest(spark, d)
    sizes = V.latest(m).select(F.col("source_path").alias("path"), "size")
    c = B.table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("path"), F.when(F.col("c_custkey") % 3 == 0, F.floor("c_acctbal")).alias("changed"), F.date_format(F.date_sub(F.lit("2001-01-01").cast("date"), (F.col("c_custkey") % 4).cast("int")), "yyyy-MM-dd").alias("mtime"))
    return V.readiness(c.join(sizes, "path", "left").select("path", F.coalesce("changed", "size").alias("size"), "mtime"), m, "2001-01-01")


# --- pages


@query("vault_page", f"WITH {B.MANIFEST_SQL} SELECT source_path, version, last_ts FROM manifest WHERE last_ts IS NULL OR last_ts < '1998-05-01' OR (last_ts = '1998-05-01' AND source_path > 'c5') ORDER BY last_ts IS NULL, last_ts DESC, source_path, version LIMIT 101")
def _vault_page(spark, d):
    return Z.vault_page(B.manifest(spark, d), "last_ts", every_version=True, size=100, last=["1998-05-01", "c5", 10**9]).select("source_path", "version", "last_ts")


@query("prompt_page", f"WITH {Q} SELECT prompt_id, ts FROM prompts WHERE ts IS NULL OR ts < '2024-01-20T00:00:00.000000000Z' ORDER BY ts IS NULL, ts DESC, prompt_id LIMIT 51")
def _prompt_page(spark, d):
    return N.page(B.prompts(spark, d), [("ts", True), ("prompt_id", False)], 50, ["2024-01-20T00:00:00.000000000Z", 10**15]).select("prompt_id", "ts")


@query("catalog_page", f"WITH {Q} SELECT session_id, coalesce(last_ts, first_ts) AS \"at\" FROM sessions ORDER BY coalesce(last_ts, first_ts) IS NULL, coalesce(last_ts, first_ts) DESC, session_id LIMIT 21")
def _catalog_page(spark, d):
    return Z.catalog(B.sessions(spark, d), size=20)[0].select("session_id", "at")


@query("search_page", _bm25_sql(["license"]) + " ORDER BY rank, doc_id LIMIT 11")
def _search_page(spark, d):
    ranked = H.bm25(B.table(spark, d, "documents"), "doc_id", "text", ["license"]).select("doc_id", F.round("rank", 9).alias("rank"))
    return N.page(ranked, [("rank", False), ("doc_id", False)], 10)


@query("newest_kept", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC OFFSET 100")
def _offset(spark, d):
    return N.beyond(B.table(spark, d, "events").select("ts", "event_id"), [("ts", True), ("event_id", True)], 100).select("event_id")


# --- costs of sessions and comparisons


def _session_events(spark, d) -> DataFrame:
    """A line item is an event of the session of its order's customer."""

    # only what an event needs goes through the joins
    li = B.table(spark, d, "lineitem").select("l_partkey", "l_orderkey", F.when(F.col("l_linenumber") != 7, F.col("l_shipdate")).alias("ts"), F.floor("l_extendedprice").alias("input"), F.floor("l_quantity").alias("output"))
    li = li.join(B.table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(B.table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    zero = F.lit(0).cast("long")
    return li.select(
        F.col("o_custkey").alias("session_id"), "ts", F.lit("codex").alias("provider"), F.col("p_brand").alias("model"),
        "input", zero.alias("cache_read"), zero.alias("cache_write_5m"), zero.alias("cache_write_1h"), zero.alias("cache_write_unclassified"), "output", zero.alias("reasoning"),
    )


_SESSION_USAGE = """li AS (SELECT o_custkey AS session_id, CASE WHEN l_linenumber <> 7 THEN l_shipdate END AS ts, p_brand AS model, CAST(floor(l_extendedprice) AS BIGINT) AS input, CAST(floor(l_quantity) AS BIGINT) AS output
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
    su AS (SELECT session_id, coalesce(strftime(ts, '%Y-%m-%d'), 'unknown') AS date, model, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output FROM li GROUP BY ALL)"""
_SESSION_PRICED = f"""{_SESSION_USAGE}, {B.RATES_SQL}, sp AS (SELECT su.*, coalesce(input * base_input, 0) + coalesce(output * r_output, 0) AS cost, CASE WHEN base_input IS NULL THEN input + output ELSE 0 END AS unpriced
    FROM su LEFT JOIN rates r ON su.model = r.model AND (effective_from IS NULL OR date >= effective_from) AND (effective_until IS NULL OR date <= effective_until))"""


@query("session_usage", f"WITH {_SESSION_USAGE} SELECT session_id, date, model, input, output FROM su")
def _session_usage(spark, d):
    return A.session_usage(_session_events(spark, d)).select("session_id", "date", "model", "input", "output")


@query("session_costs", f"""WITH {_SESSION_PRICED}, s AS (SELECT session_id, CAST(sum(cost) AS BIGINT) AS cost, CAST(sum(unpriced) AS BIGINT) AS unpriced_tokens, CAST(sum(input + output) AS BIGINT) AS tokens FROM sp GROUP BY session_id)
    SELECT c_custkey AS session_id, coalesce(cost, 0) AS cost, coalesce(unpriced_tokens, 0) AS unpriced_tokens, coalesce(tokens, 0) AS tokens, CASE WHEN tokens IS NULL THEN 'no_usage_events' WHEN unpriced_tokens <> 0 THEN 'incomplete' ELSE 'complete' END AS attribution_status FROM customer LEFT JOIN s ON c_custkey = session_id""")
def _session_costs(spark, d):
    sessions = B.table(spark, d, "customer").select(F.col("c_custkey").alias("session_id"))
    return A.session_costs(_session_events(spark, d), B.rates(spark), sessions).drop("priced_tokens")


@query("cached_costs", f"""WITH {_SESSION_PRICED}, s AS (SELECT session_id, CAST(sum(cost) AS BIGINT) AS cost, CAST(sum(unpriced) AS BIGINT) AS unpriced_tokens, CAST(sum(input + output) AS BIGINT) AS tokens FROM sp GROUP BY session_id)
    SELECT c_custkey AS session_id, coalesce(cost, 0) AS cost, coalesce(unpriced_tokens, 0) AS unpriced_tokens, coalesce(tokens, 0) AS tokens, CASE WHEN tokens IS NULL THEN 'no_usage_events' WHEN unpriced_tokens <> 0 THEN 'incomplete' ELSE 'complete' END AS attribution_status, (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0) AS priced FROM customer LEFT JOIN s ON c_custkey = session_id""")
def _cached_costs(spark, d):
    """Costs of the odd sessions are made first; a second call for all of them prices the even ones only."""
    sessions, store = B.table(spark, d, "customer").select(F.col("c_custkey").alias("session_id")), new_folder(spark, "costs")
    events, prints = cost_cache.by_session(_session_events(spark, d)), P.fingerprint(B.rate_entries())
    at, _, _ = cost_cache.session_costs(spark, store, 0, events, B.rates(spark), prints, sessions.filter("session_id % 2 = 1"))
    _, found, counts = cost_cache.session_costs(spark, store, at, events, B.rates(spark), prints, sessions)
    return found.drop("priced_tokens").withColumn("priced", F.lit(counts["priced"]).cast("long"))


# --- tables in the order of their keys; counts that are maintained; sessions that turn out to be one


_AT = ["1995-06-17 12:00:00", 0]


@query("sorted_page", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice FROM orders WHERE o_orderdate < '1995-06-17 12:00:00' ORDER BY orders.o_orderdate DESC, o_orderkey LIMIT 51")
def _sorted_page(spark, d):
    """A page in the middle of a table that lies in the page's order: only the files from the seek on are read."""
    keys, path = [("o_orderdate", True), ("o_orderkey", False)], new_folder(spark, "sorted")
    seekable.write(B.table(spark, d, "orders").select("o_orderdate", "o_orderkey", "o_totalprice"), keys, path, 1000)
    at = [F.lit(_AT[0]).cast("timestamp"), _AT[1]]
    return seekable.open_sorted(spark, path, keys).page(50, at).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_totalprice")


@query("sample_walk", f"WITH {Q}, {_KEYED} SELECT prompt_id, sample_key FROM u ORDER BY sample_key < start_key, sample_key, prompt_id LIMIT 25")
def _sample_walk(spark, d):
    path = new_folder(spark, "sampled")
    seekable.write_sampled(B.prompts(spark, d).select("prompt_id"), "prompt_id", path, 100)
    return seekable.walk(spark, path, "prompt_id", 25, _SEED)[0]


@query("maintained_counts", "SELECT lang, source, count(*) AS n FROM documents WHERE doc_id % 11 <> 0 GROUP BY lang, source")
def _maintained_counts(spark, d):
    """Counts of three generations: two thirds of the documents, some under another language; all; and those divisible by 11 removed."""
    docs, root, group = B.table(spark, d, "documents").select("doc_id", "lang", "source"), new_folder(spark, "counts"), ["lang", "source"]
    first = docs.filter("doc_id % 3 <> 0").withColumn("lang", F.when(F.col("doc_id") % 5 == 0, "xx").otherwise(F.col("lang")))
    at, before = 0, docs.limit(0)
    for after in (first, docs, docs.filter("doc_id % 11 <> 0")):
        at = buckets.add_counts(spark, root, at, buckets.signed_changes(before, after, "doc_id", group), group, "lang string, source string")
        before = after
    return buckets.read(spark, root, at, "lang string, source string, n long")


#: Of four sessions that follow one another the last three go to the one before them: chains of up to three merges.
@query("merged_identities", """WITH c AS (SELECT DISTINCT conv_id FROM conversations), m AS (SELECT conv_id, CASE WHEN conv_id % 4 >= 1 AND conv_id - 1 IN (SELECT conv_id FROM c) THEN CASE WHEN conv_id % 4 >= 2 AND conv_id - 2 IN (SELECT conv_id FROM c) THEN CASE WHEN conv_id % 4 = 3 AND conv_id - 3 IN (SELECT conv_id FROM c) THEN conv_id - 3 ELSE conv_id - 2 END ELSE conv_id - 1 END ELSE conv_id END AS session_id FROM c),
    p AS (SELECT session_id, turn, conv_id FROM conversations JOIN m USING (conv_id)),
    e AS (SELECT DISTINCT a.session_id AS child, b.session_id AS parent FROM (SELECT conv_id AS child, conv_id - 2 AS parent FROM c WHERE conv_id % 3 = 0) JOIN m a ON a.conv_id = child JOIN m b ON b.conv_id = parent WHERE a.session_id <> b.session_id)
    SELECT session_id, count(DISTINCT turn) AS prompts, count(*) AS occurrences, count(*) - count(DISTINCT turn) AS prompt_aliases, count(DISTINCT conv_id) - 1 AS session_aliases, (SELECT count(*) FROM e WHERE e.child = p.session_id) AS parents FROM p GROUP BY session_id""")
def _merged(spark, d):
    c = B.table(spark, d, "conversations")
    sessions = c.select(F.col("conv_id").alias("session_id"), F.lit("2024").alias("first_ts"), F.lit("2025").alias("last_ts")).distinct()
    ids = sessions.select("session_id")
    merges = ids.filter("session_id % 4 > 0").select(F.col("session_id").alias("donor"), (F.col("session_id") - 1).alias("recipient")).join(ids.withColumnRenamed("session_id", "recipient"), "recipient", "left_semi")
    prompts = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("prompt_id"), F.col("conv_id").alias("session_id"), F.col("turn").alias("logical_key"))
    occurrences = prompts.select("prompt_id", (F.col("prompt_id") + 7).alias("location_id"))
    edges = ids.filter("session_id % 3 = 0").select(F.col("session_id").alias("child"), (F.col("session_id") - 2).alias("parent"), F.lit("fork").alias("kind")).join(ids.withColumnRenamed("session_id", "parent"), "parent", "left_semi").select("child", "parent", "kind")
    m = MG.merge_sessions(merges, sessions, prompts, occurrences, edges, edges.withColumn("location_id", F.lit(1)), spark.createDataFrame([], "alias long, canonical long, kind string"))
    count = lambda rows, key, name: rows.groupBy(F.col(key).alias("session_id")).agg(F.count(F.lit(1)).alias(name))
    at = m.prompts.select("prompt_id", "session_id")
    parts = [count(m.prompts, "session_id", "prompts"), count(m.occurrences.join(at, "prompt_id"), "session_id", "occurrences"), count(m.aliases.filter("kind = 'prompt'").join(at, F.col("canonical") == F.col("prompt_id")), "session_id", "prompt_aliases"), count(m.aliases.filter("kind = 'session'"), "canonical", "session_aliases"), count(m.edges, "child", "parents")]
    out = m.sessions.select("session_id")
    for part in parts:
        out = out.join(part, "session_id", "left")
    return out.fillna(0)


@query("preferred_locations", f"""WITH {Q}, k AS (SELECT prompt_id, location_id, row_number() OVER (PARTITION BY prompt_id ORDER BY list_position(['provider_live', 'provider_archive', 'vault'], kind), location_id DESC) AS choice FROM occurrences WHERE available) SELECT prompt_id, location_id, choice FROM k WHERE choice <= 2""")
def _preferred(spark, d):
    o = B.occurrences(spark, d).withColumn("recency", F.col("location_id"))
    return A.preferred_locations(o, "prompt_id", 2).select("prompt_id", "location_id", F.col("choice").cast("long").alias("choice"))


@query("provider_mix", f"WITH {B.PRICED_SQL} SELECT provider, CAST(sum(cost) AS BIGINT) AS cost, round(sum(cost) / sum(sum(cost)) OVER () * 100, 6) AS share FROM priced GROUP BY provider")
def _mix(spark, d):
    return A.provider_mix(B.priced(spark, d))


@query("average_and_peak", f"WITH {B.PRICED_SQL}, days AS (SELECT date, CAST(sum(cost) AS BIGINT) AS cost FROM priced GROUP BY date) SELECT CAST(sum(cost) // count(*) AS BIGINT) AS average, arg_min(date, (-cost, date)) AS peak_day FROM days WHERE cost > 0")
def _average(spark, d):
    return A.averages(B.priced(spark, d).groupBy("date").agg(F.sum("cost").alias("cost")))


@query("parity_of_stores", """WITH a AS (SELECT o_custkey AS k, count(*) AS want FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS got FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS k, want, got, CASE WHEN got IS NULL THEN 'missing' WHEN want IS NULL THEN 'extra' WHEN want = got THEN 'equal' ELSE 'different' END AS state FROM a FULL JOIN b ON a.k = b.k""")
def _parity(spark, d):
    o = B.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    want = o.filter("o_orderstatus <> 'F'").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = o.filter("o_orderstatus <> 'P'").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return A.differences(want, got, ["k"], "n")


@query("project_statistics", f"WITH {Q} SELECT project, count(*) AS sessions FROM sessions WHERE coalesce(project, '') <> '' GROUP BY project ORDER BY sessions DESC, lower(project), project LIMIT 20")
def _project_statistics(spark, d):
    return A.project_statistics(B.sessions(spark, d))


@query("units_of_both_kinds", f"WITH {Q} SELECT 'session' AS unit, session_id AS id, provider FROM sessions UNION ALL SELECT 'prompt', prompt_id, provider FROM prompts")
def _units(spark, d):
    return R.units(B.sessions(spark, d), B.prompts(spark, d))


@query("run_counters", """WITH c AS (SELECT c_custkey AS k, CAST(floor(c_acctbal) AS BIGINT) AS size FROM customer WHERE c_mktsegment <> 'BUILDING'), o AS (SELECT o_custkey AS k, CAST(floor(max(o_totalprice)) AS BIGINT) AS size FROM orders GROUP BY 1)
    SELECT count(*) AS scanned, count(*) FILTER (WHERE c.k IS NULL) AS new, count(*) FILTER (WHERE o.size = c.size) AS unchanged, CAST(0 AS BIGINT) AS appended, count(*) FILTER (WHERE o.size <> c.size) AS rewritten, count(*) FILTER (WHERE o.k IS NULL) AS missing FROM o FULL JOIN c ON o.k = c.k""")
def _run_counters(spark, d):
    return A.run_counters(_freshness(spark, d))


# --- reports and upkeep


@query("session_population", f"WITH {Q} SELECT session_id FROM sessions s WHERE EXISTS (SELECT 1 FROM prompts p JOIN occurrences o USING (prompt_id) WHERE p.session_id = s.session_id AND available AND searchable AND role = 'user' AND p.kind = 'human')")
def _population(spark, d):
    return Z.session_population(B.sessions(spark, d), B.prompts(spark, d), B.occurrences(spark, d)).select("session_id")


@query("model_page", f"""WITH {B.PRICED_SQL}, m AS (SELECT provider, model, CAST(sum(cost) AS BIGINT) AS cost, CAST(sum(input + output) AS BIGINT) AS tokens, max(date) AS last_date FROM priced GROUP BY ALL), s AS (SELECT provider, model, count(DISTINCT path) AS sessions FROM usage_rows WHERE model <> 'Brand#2' GROUP BY ALL)
    SELECT provider, model, cost, tokens, coalesce(sessions, 0) AS sessions, round(cost / sum(cost) OVER () * 1000) / 10 AS cost_share, greatest(0, CAST(DATE '2001-10-01' - CAST(last_date AS DATE) AS INTEGER)) AS recency_days, CASE WHEN coalesce(sessions, 0) = 0 THEN 0 ELSE tokens // sessions END AS tokens_per_session FROM m LEFT JOIN s USING (provider, model)""")
def _model_page(spark, d):
    s = R.model_sessions(B.usage_rows(spark, d).filter("model <> 'Brand#2'").withColumnRenamed("path", "session_id"))
    return Z.model_page(B.priced(spark, d), s, "2001-10-01")


@query("project_costs", f"""WITH {_SESSION_PRICED}, s AS (SELECT session_id, CAST(sum(cost) AS BIGINT) AS cost, CAST(sum(unpriced) AS BIGINT) AS unpriced, CAST(sum(input + output) AS BIGINT) AS tokens FROM sp GROUP BY session_id)
    SELECT CASE WHEN c_nationkey % 5 = 0 THEN 'unknown' ELSE 'nation' || c_nationkey END AS project, CAST(sum(coalesce(tokens, 0)) AS BIGINT) AS tokens, CAST(coalesce(sum(CASE WHEN tokens IS NOT NULL AND unpriced = 0 THEN cost END), 0) AS BIGINT) AS cost, count(*) AS sessions FROM customer LEFT JOIN s ON c_custkey = session_id GROUP BY 1""")
def _project_costs(spark, d):
    c = B.table(spark, d, "customer").select(F.col("c_custkey").alias("session_id"), F.when(F.col("c_nationkey") % 5 == 0, "").otherwise(F.concat(F.lit("nation"), F.col("c_nationkey").cast("string"))).alias("project"))
    return Z.project_day(A.session_costs(_session_events(spark, d), B.rates(spark), c), c)


@query("daily_average", f"WITH {B.PRICED_SQL}, days AS (SELECT date, CAST(sum(cost) AS BIGINT) AS cost FROM priced GROUP BY date), n AS (SELECT CAST(max(CAST(date AS DATE)) - min(CAST(date AS DATE)) + 1 AS BIGINT) AS days FROM days) SELECT any_value(n.days) AS days, CAST(sum(cost) // any_value(n.days) AS BIGINT) AS average FROM days, n")
def _daily_average(spark, d):
    return Z.daily_averages(B.priced(spark, d).groupBy("date").agg(F.sum("cost").alias("cost")), "cost")


@query("session_cost_page", f"""WITH {_SESSION_PRICED}, page AS (SELECT o_custkey AS session_id, strftime(max(o_orderdate), '%Y-%m-%d') AS "at" FROM orders GROUP BY 1 ORDER BY 2 DESC, session_id LIMIT 21), s AS (SELECT session_id, CAST(sum(cost) AS BIGINT) AS cost, CAST(sum(unpriced) AS BIGINT) AS unpriced_tokens, CAST(sum(input + output) AS BIGINT) AS tokens FROM sp GROUP BY session_id)
    SELECT session_id, "at", coalesce(cost, 0) AS cost, coalesce(unpriced_tokens, 0) AS unpriced_tokens, coalesce(tokens, 0) AS tokens, CASE WHEN tokens IS NULL THEN 'no_usage_events' WHEN unpriced_tokens <> 0 THEN 'incomplete' ELSE 'complete' END AS attribution_status FROM page LEFT JOIN s USING (session_id)""")
def _session_cost_page(spark, d):
    s = B.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("session_id")).agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_ts")).withColumn("first_ts", F.col("last_ts"))
    return Z.costs(_session_events(spark, d), B.rates(spark), s, 20).drop("priced_tokens")


@query("marked_missing", "SELECT 'p' || c_custkey AS path, NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS missing, c_custkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS settled FROM customer")
def _marked(spark, d):
    path = lambda c: F.concat(F.lit("p"), F.col(c).cast("string")).alias("path")
    c = B.table(spark, d, "customer").select(path("c_custkey"), F.lit(False).alias("missing"), (F.col("c_custkey") % 2 == 0).alias("settled"))
    return D.mark_missing(c, B.table(spark, d, "orders").select(path("o_custkey")))


@query("replaced_source", "SELECT o_orderkey AS id, o_orderstatus AS source, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, 'P', CAST(0 AS BIGINT) FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 2 = 0")
def _replaced(spark, d):
    rows = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("source"), F.floor("o_totalprice").alias("v"))
    return D.apply_source(rows, "source", rows.filter("source = 'P' and id % 2 = 0").withColumn("v", F.lit(0).cast("long")))


@query("archive_counters", "SELECT o_orderstatus AS provider, count(*) FILTER (WHERE o_orderkey % 4 = 0) AS archived, count(*) FILTER (WHERE o_orderkey % 4 = 1) AS deduplicated, count(*) FILTER (WHERE o_orderkey % 4 = 2) AS skipped, count(*) FILTER (WHERE o_orderkey % 4 = 3) AS changed, CAST(coalesce(sum(CASE WHEN o_orderkey % 4 = 0 THEN floor(o_totalprice) END), 0) AS BIGINT) AS bytes FROM orders GROUP BY 1")
def _archive_counters(spark, d):
    kinds = F.array(*[F.lit(k) for k in ("archived", "deduplicated", "skipped", "changed")])
    rows = B.table(spark, d, "orders").select(F.col("o_orderstatus").alias("provider"), F.get(kinds, (F.col("o_orderkey") % 4).cast("int")).alias("outcome"), F.floor("o_totalprice").alias("size"))
    return D.archive_counters(rows)


@query("bounded_issues", "SELECT 'u' || user_id AS path, CAST(event_id AS VARCHAR) AS message, (SELECT count(*) FROM events WHERE event_type = 'error') AS total FROM events WHERE event_type = 'error' ORDER BY path, message LIMIT 20")
def _issues(spark, d):
    e = B.table(spark, d, "events").filter("event_type = 'error'")
    return D.bounded_issues(e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").cast("string").alias("message")))


@query("search_hits", f"""WITH {Q}, b AS (SELECT p.* FROM prompts p WHERE searchable AND role = 'user' AND p.kind = 'human' AND EXISTS (SELECT 1 FROM occurrences o WHERE o.prompt_id = p.prompt_id AND available)), tokens AS (SELECT prompt_id, ts, {_WORDS} AS w FROM b),
    c AS (SELECT *, len(w) AS size, {_phrase_sql("the")} AS tf FROM tokens), s AS (SELECT count(*) AS n, avg(size) AS mean, count(*) FILTER (WHERE tf > 0) AS df FROM c)
    SELECT prompt_id, round(-(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 9) AS rank FROM c, s WHERE tf > 0""")
def _search_hits(spark, d):
    return Z.search_hits(B.prompts(spark, d), B.occurrences(spark, d), "the").select("prompt_id", F.round("rank", 9).alias("rank"))


@query("indexed_search_page", ORACLES["search_hits"] + " ORDER BY rank, ts DESC NULLS LAST, prompt_id LIMIT 51")
def _indexed_search_page(spark, d):
    """The same hits from a kept index of the prompts, a page of them by rank and time (SRT-5, FTS-6)."""
    prompts, occurrences, root = B.prompts(spark, d), B.occurrences(spark, d), new_folder(spark, "index")
    at = K.update(spark, root, 0, R.available_prompts(prompts.filter(R.prompt_filter()), occurrences), "prompt_id", "text")
    return Z.search(prompts, occurrences, "the", index=K.open_index(spark, root, at)).select("prompt_id", F.round("rank", 9).alias("rank"))
