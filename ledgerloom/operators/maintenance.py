"""Upkeep of tables that have no MERGE: replace a source, mark and settle what is missing, errors, backfills, checks (DML-3..9, ING-14, ING-21, SRT-18, FTS-7, STR-8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import extraction as X


def apply_source(rows: DataFrame, source: str, fresh: DataFrame, append: bool = False) -> DataFrame:
    """A table with the rows of some sources replaced, or added to (DML-3). Ids are hashes of what they stand for, so a row that returns has its old id (DML-5)."""
    kept = rows if append else rows.join(fresh.select(source).distinct(), source, "left_anti")
    return kept.unionByName(fresh)


def stable_id(*columns: str):
    """An id that the same row gets again (DML-5)."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)


def mark_missing(checkpoints: DataFrame, listing: DataFrame) -> DataFrame:
    """missing and settled of every checkpoint: a vanished file keeps its contribution and its settled mark, one that is back loses both (ING-21, DML-7, SET-6)."""
    seen = listing.select("path").distinct().withColumn("_seen", F.lit(True))
    both = checkpoints.join(seen, "path", "left").withColumn("_seen", F.coalesce("_seen", F.lit(False)))
    return both.withColumns({"missing": ~F.col("_seen"), "settled": ~F.col("_seen") & F.col("settled")}).drop("_seen")


def settle(checkpoints: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Missing files acknowledged: all of them, or those of paths (DML-7)."""
    if paths is None:
        return checkpoints.withColumn("settled", F.col("settled") | F.col("missing"))
    chosen = paths.select("path").distinct().withColumn("_chosen", F.lit(True))
    return checkpoints.join(chosen, "path", "left").withColumn("settled", F.col("settled") | (F.col("missing") & F.coalesce("_chosen", F.lit(False)))).drop("_chosen")


def freshness(listing: DataFrame, checkpoints: DataFrame, now: str, active_minutes: int = 10) -> DataFrame:
    """One row: new, changed and missing files, and how many changed so lately that they may be in use (STR-8)."""
    a, b = listing.alias("a"), checkpoints.alias("b")
    both = a.join(b, F.col("a.path") == F.col("b.path"), "full_outer")
    changed = F.col("a.path").isNotNull() & F.col("b.path").isNotNull() & ((F.col("a.size") != F.col("b.size")) | (F.col("a.mtime") != F.col("b.mtime")))
    lately = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("a.mtime") < active_minutes * 60
    new = F.col("b.path").isNull()
    return both.agg(F.count_if(new).alias("new"), F.count_if(changed).alias("changed"), F.count_if(F.col("a.path").isNull()).alias("missing"), F.count_if((new | changed) & lately).alias("active"))


def bounded_issues(errors: DataFrame, most: int = 20) -> DataFrame:
    """The first issues in order, each with the number of all of them (SRT-18, DML-8)."""
    total = errors.agg(F.count(F.lit(1)).alias("total"))
    return errors.orderBy("path", "message").limit(most).join(F.broadcast(total))


def backfill(sessions: DataFrame, version: int) -> DataFrame:
    """Sessions whose metadata an older rule made, derived again (DML-9)."""
    old = F.coalesce(F.col("rule_version"), F.lit(0)) < version
    project = T.project_of(F.col("repository"), F.col("cwd"))
    return sessions.withColumns({"project": F.when(old, project["project"]).otherwise(F.col("project")), "project_source": F.when(old, project["source"]).otherwise(F.col("project_source")), "rule_version": F.when(old, version).otherwise(F.col("rule_version"))})


def resumed_events_a(lines: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Provider A's events of lines past a checkpoint, which brings the model that was current there (ING-14).

    Events from before the first model aren't booked until one is known: they carry `buffered`, and the next run reads
    their file from the start.
    """
    carried = checkpoints.filter("model is not null").select("path", F.lit(0).cast("long").alias("line_no"), F.to_json(F.struct(F.lit("turn_context").alias("type"), F.struct("model").alias("payload"))).alias("raw"))
    return X.events_a(lines.select("path", "line_no", "raw").unionByName(carried.join(lines.select("path").distinct(), "path", "left_semi")))


def index_differences(postings: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Postings that only one of the index and its rebuilding has (FTS-7): empty if the index is sound."""
    columns = postings.columns
    both = postings.withColumn("_side", F.lit(1)).unionByName(rebuilt.select(*columns).withColumn("_side", F.lit(-1)))
    # one sum for each different row; what is there as often on either side is gone before anything is told apart
    left = both.groupBy(*columns).agg(F.sum("_side").alias("_n")).filter("_n <> 0")
    return left.select(*columns, F.when(F.col("_n") > 0, "stale").otherwise("missing").alias("side"), F.explode(F.array_repeat(F.lit(0), F.abs("_n").cast("int"))).alias("_k")).drop("_k")


def archive_counters(members: DataFrame) -> DataFrame:
    """Per provider: archived, deduplicated, skipped, changed while read, and bytes (AGG-49)."""
    return members.groupBy("provider").agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in ("archived", "deduplicated", "skipped", "changed")], F.coalesce(F.sum(F.when(F.col("outcome") == "archived", F.col("size"))), F.lit(0)).alias("bytes"))


def newest_tombstones(rows: DataFrame, keep: int = 256) -> DataFrame:
    """The newest tombstones of each source (SRT-17)."""
    w = Window.partitionBy("source").orderBy(F.desc("deleted_at"), F.desc("id"))
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep).drop("_n")
