"""Queries on sessions and prompts: predicates, catalog, coverage, statistics (FLT-5..18, JN-1..9, AGG-10..21, WIN-12..15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import label_or_unknown

SESSION_DIMENSIONS = ("provider", "repository", "project", "cwd", "thread_kind")
PROMPT_DIMENSIONS = ("weekday", "hour", "role")
FOLD_BELOW = 2


def available_prompts(prompts: DataFrame, occurrences: DataFrame, kind: str | None = None) -> DataFrame:
    """Prompts with an available occurrence, of one kind of place if named: a semi-join (JN-3, FLT-11)."""
    places = occurrences.filter("available")
    places = places.filter(F.col("kind") == kind) if kind else places
    return prompts.join(places.select("prompt_id"), "prompt_id", "left_semi")


def prompt_filter(role: str | None = "user", kinds: list[str] | None = None, exclude_control: bool = False, consented: list[str] | None = None) -> Column:
    """Searchable prompts of a role: user ones of kind human unless kinds are named; assistant ones only of consenting providers (FLT-5..7, DML-10)."""
    c = F.col("searchable")
    if role:
        c = c & (F.col("role") == role)
    c = c & (F.col("kind").isin(kinds) if kinds else (F.col("role") != "user") | (F.col("kind") == "human"))
    if exclude_control:
        c = c & (F.col("kind") != "control")
    return c & ((F.col("role") != "assistant") | (F.col("provider").isin(consented) if consented else F.lit(False)))


def in_time(ts: str, since: str | None, until: str | None) -> Column:
    """Inclusive bounds on instant keys; an unknown time is left out only where there is a bound (FLT-8)."""
    c = F.lit(True)
    if since:
        c = c & (F.col(ts) >= since)
    if until:
        c = c & (F.col(ts) <= until)
    return F.coalesce(c, F.lit(False))


def overlapping(sessions: DataFrame, since: str | None, until: str | None) -> DataFrame:
    """Sessions whose [first_ts, last_ts] meets [since, until] (FLT-9)."""
    c = F.lit(True)
    if since:
        c = c & (F.col("last_ts") >= since)
    if until:
        c = c & (F.col("first_ts") <= until)
    return sessions.filter(c)


def active_sessions(sessions: DataFrame, prompts: DataFrame, since: str, until: str) -> DataFrame:
    """Sessions with a prompt inside a window (FLT-10)."""
    return sessions.join(prompts.filter(in_time("ts", since, until)).select("session_id"), "session_id", "left_semi")


def catalog_coverage(sessions: DataFrame) -> DataFrame:
    """Known and unknown metadata of all sessions, in one row (AGG-10)."""
    known = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return sessions.agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count_if(known("repository")).alias("repository_known"), F.count_if(~known("repository")).alias("repository_unknown"),
        F.count_if(F.col("project_source") == "git").alias("project_git"), F.count_if(F.col("project_source") == "cwd").alias("project_cwd"), F.count_if(~known("project")).alias("project_unknown"),
        F.count_if(known("branch")).alias("branch_known"), F.count_if(~known("branch")).alias("branch_unknown"),
        F.count_if(F.col("thread_kind") == "root").alias("root"), F.count_if(F.col("thread_kind") == "subagent").alias("subagent"), F.count_if(F.col("thread_kind") == "unknown").alias("thread_unknown"),
    )


def prompt_coverage(prompts: DataFrame, sessions: DataFrame) -> DataFrame:
    """Bounds, and distinct sessions with known metadata (AGG-11)."""
    both = prompts.join(sessions.select("session_id", "repository", "branch"), "session_id")
    known = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return both.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_distinct("session_id").alias("sessions"), F.count_distinct(F.when(known("repository"), F.col("session_id"))).alias("repository_known"), F.count_distinct(F.when(known("branch"), F.col("session_id"))).alias("branch_known"))


def role_statistics(prompts: DataFrame) -> DataFrame:
    return prompts.groupBy("role").agg(F.count(F.lit(1)).alias("prompts"), F.count_distinct("session_id").alias("sessions"), F.sum(F.octet_length("text")).alias("bytes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def corpus_statistics(sessions: DataFrame, prompts: DataFrame, occurrences: DataFrame) -> DataFrame:
    """One row of scalars: each a single aggregate; one-row tables are then put side by side (AGG-12, AGG-13)."""
    p = prompts.agg(
        F.count(F.lit(1)).alias("prompts"), F.count_distinct(F.substring("ts", 1, 10)).alias("active_days"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"),
        F.coalesce(F.median(F.octet_length("text")), F.lit(0.0)).alias("median_bytes"), F.count_if(~F.col("searchable")).alias("not_searchable"),
    )
    o = occurrences.agg(F.count(F.lit(1)).alias("occurrences"), *[F.count_if(F.col("available") & (F.col("kind") == k)).alias(k) for k in ("provider_live", "provider_archive", "vault")])
    s = sessions.agg(F.count(F.lit(1)).alias("sessions"))
    return s.join(F.broadcast(p)).join(F.broadcast(o))  # one row each


def occurrence_counts(prompts: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Available occurrences by prompt and kind of place (AGG-18); 0 where there is none."""
    n = occurrences.filter("available").groupBy("prompt_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "vault").alias("vault"))
    return prompts.select("prompt_id").join(n, "prompt_id", "left").fillna(0, ["n", "vault"])


def fold_rare(sessions: DataFrame, all_sessions: DataFrame, below: int = FOLD_BELOW) -> DataFrame:
    """project with fewer than `below` sessions in the whole corpus, filters aside, shows as 'other'; a blank one as 'unknown' (AGG-16, SMP-6)."""
    usual = all_sessions.groupBy("project").agg(F.count(F.lit(1)).alias("_n"))
    label = F.when(F.coalesce(F.trim("project"), F.lit("")) == "", "unknown").when(F.coalesce("_n", F.lit(0)) < below, "other").otherwise(F.col("project"))
    return sessions.join(usual, "project", "left").withColumn("project_label", label).drop("_n")


def dimension(name: str) -> Column:
    """A group's label for one dimension (FN-9..11, FN-28)."""
    if name == "weekday":
        return F.coalesce(F.date_format(F.try_to_timestamp("ts"), "EEEE"), F.lit("unknown"))
    if name == "hour":
        return F.coalesce(F.date_format(F.try_to_timestamp("ts"), "HH"), F.lit("unknown"))
    if name == "project":
        return F.col("project_label")
    return label_or_unknown(F.col(name)) if name == "repository" else F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("unknown"))


def grouped_statistics(sessions: DataFrame, prompts: DataFrame, counts: DataFrame, dims: list[str]) -> DataFrame:
    """sessions, prompts, occurrences, bytes of each group; session-level groups keep sessions without prompts (AGG-15, JN-7)."""
    if bad := [d for d in dims if d not in SESSION_DIMENSIONS + PROMPT_DIMENSIONS]:
        raise ValueError(f"unknown dimensions: {bad}")
    facts = prompts.join(counts.select("prompt_id", "n"), "prompt_id", "left").withColumn("_bytes", F.octet_length("text")).drop("provider")
    how = "inner" if any(d in PROMPT_DIMENSIONS for d in dims) else "left"
    both = sessions.join(facts, "session_id", how)
    return both.groupBy(*[dimension(d).alias(d) for d in dims]).agg(F.count_distinct("session_id").alias("sessions"), F.count_distinct("prompt_id").alias("prompts"), F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences"), F.coalesce(F.sum("_bytes"), F.lit(0)).alias("bytes"))


def top_and_other(rows: DataFrame, key: str, session: str, top: int, protected: tuple[str, ...] = ("unknown",)) -> DataFrame:
    """The top groups by distinct sessions, `unknown` kept in sight in place of the last, and the rest as 'other' with its sessions counted anew (AGG-17, SET-7)."""
    sizes = rows.groupBy(key).agg(F.count_distinct(session).alias("sessions"))
    kept = sizes.orderBy(F.desc(F.col(key).isin(*protected)), F.desc("sessions"), F.lower(key), key).limit(top).select(key)  # at most `top` rows
    label = F.when(F.col("_kept"), F.col(key)).otherwise("other")
    marked = rows.join(F.broadcast(kept.withColumn("_kept", F.lit(True))), key, "left").withColumn("_kept", F.coalesce("_kept", F.lit(False))).withColumn("label", label)
    return marked.groupBy("label").agg(F.count_distinct(session).alias("sessions"), F.count(F.lit(1)).alias("rows"))


def sessions_by_day(prompts: DataFrame) -> DataFrame:
    """Distinct sessions of each day, by provider too (AGG-20)."""
    day = F.substring("ts", 1, 10)
    return prompts.filter("ts is not null").groupBy(day.alias("date")).agg(F.count_distinct("session_id").alias("sessions"), F.count_distinct("provider").alias("providers"), F.min("ts").alias("first_ts"))


def activity_endpoints(prompts: DataFrame) -> DataFrame:
    """First and last time of each session and day, one row if they are the same (AGG-19)."""
    ends = prompts.filter("ts is not null").groupBy("session_id", F.substring("ts", 1, 10).alias("date")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return ends.select("session_id", "date", F.explode(F.array_distinct(F.array("a", "b"))).alias("ts"))


def model_sessions(rows: DataFrame) -> DataFrame:
    """Distinct sessions of each provider and model (AGG-21)."""
    return rows.select("session_id", "provider", "model").distinct().groupBy("provider", "model").agg(F.count(F.lit(1)).alias("sessions"))


def canonical(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The best row of each key (WIN-12..14, WIN-4 with k = 1)."""
    return top_k(rows, key, order, 1)


def top_k(rows: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    """The k best rows of each key (WIN-4, SRT-17)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def merged(rows: DataFrame, key: str, fields: list[str], rank: list[Column]) -> DataFrame:
    """Per key, each field's value from its best row that has one (WIN-15, GR-5)."""
    return rows.groupBy(key).agg(*[F.max_by(f, F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) != "", F.struct(*rank))).alias(f) for f in fields])


def provenance_list(occurrences: DataFrame, most: int = 100) -> DataFrame:
    """A prompt's first places as ordered text; duplicates once (AGG-35). At most `most` are kept while collecting."""
    few = top_k(occurrences.select("prompt_id", "location_id").distinct(), ["prompt_id"], [F.col("location_id")], most)
    return few.groupBy("prompt_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("location_id")), lambda x: x.cast("string")), ",").alias("locations"))


def around(prompts: DataFrame, session: str, order: list[Column], target: Column, radius: int) -> DataFrame:
    """Rows up to `radius` places from the target row of their session (WIN-3)."""
    w = Window.partitionBy(session).orderBy(*order)
    numbered = prompts.withColumn("_n", F.row_number().over(w))
    at = numbered.filter(target).select(F.col(session).alias("_s"), F.col("_n").alias("_at"))
    near = numbered.join(F.broadcast(at.limit(1)), F.col(session) == F.col("_s"))
    return near.filter(F.abs(F.col("_n") - F.col("_at")) <= radius).withColumn("offset", (F.col("_n") - F.col("_at")).cast("long")).drop("_n", "_s", "_at")


def long_enough(rows: DataFrame, text: str, least: int) -> DataFrame:
    """Rows whose text has at least so many characters (FLT-18)."""
    return rows.filter(F.length(text) >= least)


def labels(rows: DataFrame, name: str) -> DataFrame:
    """Distinct names that aren't blank with the key that they are listed by, in its order (SRT-12)."""
    return rows.filter(F.coalesce(F.trim(name), F.lit("")) != "").select(name, F.lower(name).alias("k")).distinct().orderBy("k", name)


def units(sessions: DataFrame, prompts: DataFrame) -> DataFrame:
    """unit, id, provider of both kinds of units that can be sampled (SET-1)."""
    one = lambda rows, unit: rows.select(F.lit(unit).alias("unit"), F.col(f"{unit}_id").alias("id"), "provider")
    return one(sessions, "session").unionByName(one(prompts, "prompt"))


def roles_disagree(a: Column, b: Column, hours: Column) -> Column:
    """Counts more than a fifth apart or bounds more than a day apart (AGG-33)."""
    return (F.abs(a - b) > 0.2 * F.greatest(a, b)) | (hours > 24)
