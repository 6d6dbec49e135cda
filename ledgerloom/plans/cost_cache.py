"""Costs of sessions that are kept: results by content, rates and window; only what isn't there is priced (PRC-12, SRT-10, RPT-16)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators import attribution as A
from ledgerloom.operators.pagination import beyond
from ledgerloom.sources.scratch import new_folder

KEY = ["session_id", "content_hash", "rates", "since", "until"]
#: Results kept of one session, and of all; the newest stay.
MOST_OF_SESSION, MOST = 8, 50_000


def by_session(events: DataFrame) -> DataFrame:
    """events as a table in buckets by session, written once: what reads it by session, any number of times, doesn't shuffle it."""
    spark, at = events.sparkSession, new_folder(events.sparkSession, "session_events")
    name, n = at.rpartition("/")[2].replace("-", "_"), int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    events.repartition(n, "session_id").write.format("parquet").option("compression", "zstd").bucketBy(n, "session_id").option("path", at).saveAsTable(name)
    return spark.table(name)


def content_hashes(events: DataFrame) -> DataFrame:
    """session_id, content_hash: of a session's events in any order; equal events count as often as they come."""
    each = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(events.columns)])
    parts = events.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.sum(each.cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64(each).cast("decimal(38,0)")).alias("b"))
    return parts.select("session_id", F.sha2(F.concat_ws(":", "n", "a", "b"), 256).alias("content_hash"))


def session_costs(spark: SparkSession, store: str, generation: int, events: DataFrame, rates: DataFrame, fingerprint: str, sessions: DataFrame, since: str | None = None, until: str | None = None) -> tuple[int, DataFrame, dict[str, int]]:
    """(next generation, attribution.session_costs of the sessions, how many were found and priced).

    A result is found if the session's events, the rates' fingerprint and the window are those it was made of. Events of
    sessions that are found aren't priced. Results of sessions that aren't in `sessions` any more are dropped; of one
    session the newest few stay, of all the newest MOST.
    """
    at = f"{store}/generation={generation + 1}"
    wanted = sessions.select("session_id").distinct().join(content_hashes(events), "session_id", "left").withColumns({"content_hash": F.coalesce("content_hash", F.lit("")), "rates": F.lit(fingerprint), "since": F.lit(since or ""), "until": F.lit(until or "")})
    wanted.write.mode("overwrite").parquet(f"{at}/wanted")
    wanted = spark.read.parquet(f"{at}/wanted")
    known = spark.read.parquet(f"{store}/generation={generation}/costs") if generation else None
    missing = wanted if known is None else wanted.join(known.select(*KEY), KEY, "left_anti")
    missing.select("session_id").write.mode("overwrite").parquet(f"{at}/missing")
    missing = spark.read.parquet(f"{at}/missing")
    own = A.in_window(events.join(missing, "session_id", "left_semi"), since, until)[0] if since or until else events.join(missing, "session_id", "left_semi")
    made = A.session_costs(own, rates, missing).join(wanted, "session_id").withColumn("made", F.lit(generation + 1).cast("long"))
    every = made if known is None else known.unionByName(made)
    every = every.join(sessions.select("session_id").distinct(), "session_id", "left_semi")
    newest = Window.partitionBy("session_id").orderBy(F.desc("made"), *KEY[1:])
    every = every.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= MOST_OF_SESSION).drop("_n")
    every.write.mode("overwrite").parquet(f"{at}/all")
    every = spark.read.parquet(f"{at}/all")
    old = beyond(every.select("made", *KEY), [("made", True), *[(c, False) for c in KEY]], MOST).select(*KEY)
    found = wanted.join(every, KEY)  # also what the bound will drop
    every.join(old, KEY, "left_anti").write.mode("overwrite").parquet(f"{at}/costs")
    counts = {"wanted": wanted.count(), "priced": missing.count()}
    return generation + 1, found.drop(*KEY[1:], "made"), counts
