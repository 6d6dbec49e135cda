"""The archive's manifest: versions, latest rows, pages, status, readiness, verification (FLT-13..15, AGG-31, AGG-44, WIN-11, DML-12..13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def versioned(rows: DataFrame, path: str, order: list) -> DataFrame:
    """version from 1 in the order of each path (WIN-11, SRC-20)."""
    w = Window.partitionBy(path).orderBy(*order)
    return rows.withColumn("version", F.row_number().over(w).cast("long"))


def latest(manifest: DataFrame, path: str = "source_path") -> DataFrame:
    """The newest version of every path (FLT-15)."""
    newest = manifest.groupBy(path).agg(F.max("version").alias("version"))
    return manifest.join(newest, [path, "version"])


def overlapping(manifest: DataFrame, since: str | None, until: str | None) -> DataFrame:
    """Rows whose times meet the bounds; unknown times stay (FLT-13, FLT-14)."""
    c = F.lit(True)
    if since:
        c = c & (F.col("last_ts").isNull() | (F.col("last_ts") >= since))
    if until:
        c = c & (F.col("first_ts").isNull() | (F.col("first_ts") <= until))
    return manifest.filter(c)


def status(manifest: DataFrame) -> DataFrame:
    """Files, bytes, distinct archives of every provider and of all (provider null), in one pass (AGG-31)."""
    p = F.col("provider")
    return manifest.groupingSets([[p], []], p).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.count_distinct("archive").alias("archives"))


def bundles(manifest: DataFrame) -> DataFrame:
    """Members, bytes and times of every archive (AGG-44)."""
    return manifest.groupBy("archive").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("bytes"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def readiness(listing: DataFrame, manifest: DataFrame, now: str, settle_days: int = 1) -> DataFrame:
    """path, state: archived, changed since, missing from the archive, or too recent to tell (JN-14, FLT-24)."""
    m = latest(manifest).select(F.col("source_path").alias("path"), F.col("size").alias("_size"))
    young = F.datediff(F.to_date(F.lit(now)), F.to_date("mtime")) < settle_days
    state = F.when(F.col("_size").isNull() & young, "recent").when(F.col("_size").isNull(), "missing").when(F.col("size") == F.col("_size"), "archived").otherwise("changed")
    return listing.join(m, "path", "left").select("path", state.alias("state"))


def deduplicated(contents: DataFrame) -> DataFrame:
    """One row for each provider and content (DML-4)."""
    return contents.dropDuplicates(["provider", "content_sha256"])


def verify(manifest: DataFrame, members: DataFrame) -> DataFrame:
    """source_path, version, state: ok, corrupt or absent, from the members' bytes hashed again (DML-12)."""
    m = members.select("source_path", "version", F.sha2("content", 256).alias("_sha"))
    state = F.when(F.col("_sha").isNull(), "absent").when(F.col("_sha") == F.col("content_sha256"), "ok").otherwise("corrupt")
    return manifest.join(m, ["source_path", "version"], "left").select("source_path", "version", state.alias("state"))


def resolve(manifest: DataFrame, name: str, version: int | None = None) -> DataFrame:
    """The member of an absolute or relative path, its newest version unless one is named; two sources of one relative path are an error (DML-13)."""
    found = manifest.filter((F.col("source_path") == name) | (F.col("rel_path") == name))
    found = found.filter(F.col("version") == version) if version else latest(found)
    rows = found.limit(2).collect()
    if len(rows) != 1:
        raise LookupError(f"{name}: {'no such member' if not rows else 'more than one member'}")
    return found
