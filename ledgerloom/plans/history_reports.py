"""Reports on sessions and prompts: catalog, listing, search, samples, statistics, costs, archive (RPT-10..18, FTS-6, SMP-1, SMP-8..9, SRT-5..8, AGG-25..26, AGG-42)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import div
from ledgerloom.operators import attribution as A
from ledgerloom.operators import corpus as R
from ledgerloom.operators import fulltext as K
from ledgerloom.operators import pagination as N
from ledgerloom.operators import pricing as P
from ledgerloom.operators import sampling as M
from ledgerloom.operators import search as H
from ledgerloom.operators import vault as V
from ledgerloom.operators.calendar import dense_days

PROMPT_KEYS = [("ts", True), ("prompt_id", False)]
SEARCH_KEYS = [("rank", False), ("ts", True), ("prompt_id", False)]
CATALOG_KEYS = [("at", True), ("session_id", False)]
VAULT_KEYS = {"last_ts": [("last_ts", True), ("source_path", False), ("version", False)], "first_ts": [("first_ts", True), ("source_path", False), ("version", False)], "size": [("size", True), ("source_path", False), ("version", False)], "path": [("source_path", False), ("version", False)]}


def catalog(sessions: DataFrame, since: str | None = None, until: str | None = None, size: int = 100, last: list | None = None) -> tuple[DataFrame, DataFrame]:
    """A page of sessions, newest first, and the coverage of all of them (RPT-11, SRT-7)."""
    found = R.overlapping(sessions, since, until).withColumn("at", F.coalesce("last_ts", "first_ts"))
    return N.page(found, CATALOG_KEYS, size, last), R.catalog_coverage(sessions)


def listing(prompts: DataFrame, occurrences: DataFrame, condition: Column | None = None, size: int = 100, last: list | None = None) -> DataFrame:
    """A page of prompts that a search could find (RPT-13, SRT-4, SRT-6 with a session in the condition)."""
    found = R.available_prompts(prompts.filter(R.prompt_filter() if condition is None else condition), occurrences)
    return N.page(found, PROMPT_KEYS, size, last)


def _parsed(query: str, raw: bool) -> tuple[tuple, list[str]]:
    """The query's tree, and the words and phrases that its rank counts."""
    tree = H.parse(query) if raw else ("phrase", query)

    def terms(q: tuple) -> list[str]:
        kind, *args = q
        if kind in ("term", "phrase"):
            return [args[0]]
        return [t for x in (args[:1] if kind == "not" else args) if isinstance(x, tuple) for t in terms(x)]

    return tree, [w for w in terms(tree) if H.fold_text(w)]


def search_hits(prompts: DataFrame, occurrences: DataFrame, query: str, raw: bool = False, condition: Column | None = None, index: K.Index | None = None) -> DataFrame:
    """Every hit: prompts that may be searched and match, each with its rank and a snippet (FTS-6, RPT-12).

    The words of a plain query stand together; a raw one may use the grammar of `search.parse`, and its rank counts
    each of its plain words and phrases. With an index (operators.fulltext, of prompts by prompt_id) only the terms'
    rows of the index are read, and the texts of the hits; ranks are then those of all that is indexed.
    """
    base = R.available_prompts(prompts.filter(R.prompt_filter() if condition is None else condition), occurrences)
    tree, words = _parsed(query, raw)
    if not words:
        return base.withColumns({"rank": F.lit(0.0), "snippet": F.lit("")}).limit(0)
    if index is not None:
        found = K.hits(index, tree, words)
        hits = H.with_tokens(base.join(found, F.col("prompt_id").cast("string") == F.col("doc_id")).drop("doc_id"), "text")
    else:
        scored = H.bm25(base, "prompt_id", "text", words) if not raw else H.bm25_any(base, "prompt_id", "text", words)
        hits = H.with_tokens(base, "text").filter(H.boolean(F.col("_words"), tree)).join(scored.withColumnRenamed("doc_id", "prompt_id"), "prompt_id")
    return hits.withColumn("snippet", H.snippet(F.col("_words"), *map(H.fold_text, words))).drop("_words")


def search(prompts: DataFrame, occurrences: DataFrame, query: str, raw: bool = False, condition: Column | None = None, size: int = 50, last: list | None = None, index: K.Index | None = None) -> DataFrame:
    """A page of hits by rank, then time (SRT-5)."""
    return N.page(search_hits(prompts, occurrences, query, raw, condition, index), SEARCH_KEYS, size, last)


def sample(units: DataFrame, unit_id: str, strategy: str, count: int, seed: str, group: str | None = None, session: str | None = None, least: int = 1) -> DataFrame:
    """A random or stratified sample of 1 to 100 units (SMP-1, RPT-14)."""
    if not 1 <= count <= 100:
        raise ValueError("a sample has 1 to 100 units")
    rows = M.one_per_session(units, unit_id, session, seed).drop("sample_key") if session else units
    if strategy == "random":
        return M.random_sample(rows, unit_id, count, seed)
    if strategy != "stratified" or group is None:
        raise ValueError("strategies are random, and stratified with a group")
    return M.stratified_sample(M.fold_small(rows, group, least), unit_id, group, count, seed)


def session_population(sessions: DataFrame, prompts: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Sessions with a human prompt that can be found (SMP-8)."""
    human = R.available_prompts(prompts.filter(R.prompt_filter()), occurrences)
    return sessions.join(human.select("session_id"), "session_id", "left_semi")


def sample_coverage(items: DataFrame, sessions: DataFrame) -> DataFrame:
    """Bounds and known metadata of a sample (SMP-9)."""
    return R.prompt_coverage(items, sessions)


def statistics(sessions: DataFrame, prompts: DataFrame, occurrences: DataFrame, dims: list[str], top: int = 20) -> tuple[DataFrame, DataFrame]:
    """The scalars, and the largest groups by sessions (RPT-15)."""
    if not 1 <= top <= 100:
        raise ValueError("top is 1 to 100")
    groups = R.grouped_statistics(R.fold_rare(sessions, sessions), prompts, R.occurrence_counts(prompts, occurrences), dims)
    return R.corpus_statistics(sessions, prompts, occurrences), groups.orderBy(F.desc("sessions"), *dims).limit(top)


def costs(events: DataFrame, rates: DataFrame, sessions: DataFrame, size: int = 20, last: list | None = None) -> DataFrame:
    """A page of sessions with what they cost (RPT-16); only the page's sessions are priced."""
    if not 1 <= size <= 100:
        raise ValueError("a page of costs has 1 to 100 sessions")
    page = N.page(sessions.withColumn("at", F.coalesce("last_ts", "first_ts")), CATALOG_KEYS, size, last)
    wanted = page.select("session_id", "at")
    own = events.join(F.broadcast(wanted.select("session_id")), "session_id", "left_semi")  # at most 101 ids
    return A.session_costs(own, rates, wanted).join(wanted, "session_id")


def vault_page(manifest: DataFrame, sort: str = "last_ts", provider: str | None = None, since: str | None = None, until: str | None = None, every_version: bool = False, size: int = 100, last: list | None = None) -> DataFrame:
    """A page of the manifest in one of four orders (RPT-18, SRT-8)."""
    rows = manifest if every_version else V.latest(manifest)
    rows = rows.filter(F.col("provider") == provider) if provider else rows
    return N.page(V.overlapping(rows, since, until), VAULT_KEYS[sort], size, last)


def model_page(priced: DataFrame, model_sessions: DataFrame, report_date: str) -> DataFrame:
    """provider, model, cost, share of cost, recency, tokens a session (AGG-25, AGG-39)."""
    m = priced.groupBy("provider", "model").agg(P.checked_sum(F.col("cost")).alias("cost"), F.sum(F.col("input") + F.col("output")).alias("tokens"), F.max("date").alias("last_date"))
    whole = m.agg(P.checked_sum(F.col("cost")).alias("_whole"))
    rows = m.join(model_sessions, ["provider", "model"], "left").fillna(0, ["sessions"]).join(F.broadcast(whole))
    share = F.when(F.col("_whole") > 0, F.round(F.col("cost") / F.col("_whole") * 1000) / 10)
    recency = F.greatest(F.lit(0), F.datediff(F.to_date(F.lit(report_date)), F.to_date("last_date")))
    return rows.select("provider", "model", "cost", "tokens", "sessions", share.alias("cost_share"), recency.alias("recency_days"), F.coalesce(div(F.col("tokens"), F.col("sessions")), F.lit(0)).alias("tokens_per_session"))


def project_day(session_costs: DataFrame, sessions: DataFrame) -> DataFrame:
    """tokens, cost of complete sessions, and sessions of each project (AGG-26)."""
    both = session_costs.join(sessions.select("session_id", F.coalesce(F.nullif("project", F.lit("")), F.lit("unknown")).alias("project")), "session_id")
    return both.groupBy("project").agg(F.sum("tokens").alias("tokens"), F.coalesce(P.checked_sum(F.when(F.col("attribution_status") == "complete", F.col("cost"))), F.lit(0)).alias("cost"), F.count(F.lit(1)).alias("sessions"))


def daily_averages(days: DataFrame, value: str) -> DataFrame:
    """Integer mean over all days of the range, empty ones too (AGG-42)."""
    return dense_days(days, value).agg(F.count(F.lit(1)).alias("days"), div(F.sum(value), F.count(F.lit(1))).alias("average"))
