"""The archive as a job: settled files go into bundles of their provider and month, in versions (SRC-20, DML-4, DML-12, DML-13, AGG-49, RPT-18).

A run reads a generation of the manifest and writes the next one. Files that are too young, or whose size and time the
manifest knows, are skipped; the others are read once, into a staging table, and hashed. Equal contents of one path
only renew its size and time; others are its next version. Only bundles that get a member are written, with their old
members carried over. A bundle that is missing is made again if the sources have all that it held; else the run ends.

Bundles are replaced before the manifest is written: an interrupted run leaves a manifest whose members all are there,
and members that no manifest names are not carried over by the next one. Empty files aren't listed by Spark's reader
and aren't archived.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import maintenance as M
from ledgerloom.operators import vault as V
from ledgerloom.sources import bundles as S
from ledgerloom.sources import jsonl as J

MANIFEST = "provider string, source_path string, rel_path string, version long, archive string, size long, mtime timestamp, content_sha256 string, first_ts timestamp, last_ts timestamp, line_count long"


def manifest(spark: SparkSession, store: str, generation: int) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{store}/generation={generation}/manifest") if generation else spark.createDataFrame([], MANIFEST)


def archive(spark: SparkSession, roots: dict[str, str], vault: str, store: str, generation: int, now: str, settle_seconds: int = 86400, every: bool = False, pattern: str = "*.jsonl") -> tuple[int, list[dict]]:
    """(next generation, counts of each provider). roots: provider -> folder; every: young and unchanged files too."""
    out = f"{store}/generation={generation + 1}"

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        return spark.read.schema(df.schema).parquet(f"{out}/{name}")

    known = manifest(spark, store, generation)
    # which bundles are gone: of those the manifest names
    there = S.bundle_list(spark, vault).select("archive") if known.head(1) else known.select("archive").limit(0)
    broken = known.select("archive").distinct().join(there, "archive", "left_anti").withColumn("broken", F.lit(True))
    last = V.latest(known).select("source_path", F.col("version").alias("old_version"), F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), F.col("content_sha256").alias("old_sha"), F.col("archive").alias("old_archive"))
    listed = None
    for provider, root in roots.items():
        one = J.listing(spark, root, pattern).withColumns({"provider": F.lit(provider), "root": F.lit(root.removeprefix("file://").removeprefix("file:").rstrip("/"))})
        listed = one if listed is None else listed.unionByName(one)
    plain = F.regexp_replace("path", "^file:/+", "/")
    listed = listed.withColumn("rel_path", F.expr("substring(regexp_replace(path, '^file:/+', '/'), length(root) + 2)")).withColumn("source_path", plain)
    met = listed.join(last, "source_path", "left").join(broken.withColumnRenamed("archive", "old_archive"), "old_archive", "left")
    repair = F.coalesce(F.col("broken"), F.lit(False))
    young = F.col("mtime") > F.timestamp_seconds(F.unix_timestamp(F.lit(now).cast("timestamp")) - settle_seconds)
    same = (F.col("size") == F.col("old_size")) & (F.col("mtime") == F.col("old_mtime")) & ~repair
    due = F.lit(True) if every else ~(young | F.coalesce(same, F.lit(False)))
    met = keep(met.withColumns({"repair": repair, "due": due}).drop("broken", "root"), "listed")

    staged = keep(S.contents_at(met.filter("due")), "staging")  # each file is read once
    lines = J.line_statistics(J.positioned_lines(staged, complete_only=False))
    facts = staged.select("path", F.octet_length("content").cast("long").alias("read"), F.sha2("content", 256).alias("sha")).join(lines, "path", "left")
    found = met.filter("due").join(facts, "path", "left")
    unlike = F.col("old_sha").isNull() | (F.col("sha") != F.col("old_sha"))
    outcome = F.when(F.col("sha").isNull(), "skipped").when(F.col("read") != F.col("size"), "changed").when(unlike, "archived").when(F.col("repair"), "restored").otherwise("deduplicated")
    found = keep(found.withColumns({
        "outcome": outcome,
        "archive": F.when(~unlike, F.col("old_archive")).otherwise(F.concat("provider", F.lit("/"), F.date_format("mtime", "yyyy-MM"), F.lit(".tar.zst"))),
        "version": F.when(unlike, F.coalesce("old_version", F.lit(0)) + 1).otherwise(F.col("old_version")),
    }), "found")
    new = found.filter("outcome in ('archived', 'restored')")

    # bundles that get a member: what the manifest says they hold is carried over, in its order
    touched = new.select("archive").distinct()
    wanted = known.join(touched, "archive", "left_semi").select("archive", F.col("rel_path").alias("name"), F.col("content_sha256").alias("sha256"), F.col("mtime").alias("_mtime")).dropDuplicates(["archive", "name", "sha256"])
    lost = wanted.join(broken, "archive").join(new.select("archive", F.col("rel_path").alias("name"), F.col("sha").alias("sha256")), ["archive", "name", "sha256"], "left_anti")
    if lost.head(1):
        raise ValueError("a bundle is missing and not every version that it held is among the sources")
    held = S.bundle_members(touched.join(there, "archive", "left_semi"), vault).dropDuplicates(["archive", "name", "sha256"]).join(wanted, ["archive", "name", "sha256"])
    old = held.select("archive", "place", "name", F.col("_mtime").alias("mtime"), "content")
    fresh = new.join(staged, "path").select("archive", (F.lit(1 << 40) + F.xxhash64("source_path") % (1 << 30) + (1 << 30)).alias("place"), F.col("rel_path").alias("name"), "mtime", "content")
    if new.head(1):
        S.write_bundles(old.unionByName(fresh), vault)

    renewed = found.filter("outcome = 'deduplicated'").select("source_path", F.col("old_version").alias("version"), F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    stay = known.join(renewed, ["source_path", "version"], "left").withColumns({"size": F.coalesce("_size", "size"), "mtime": F.coalesce("_mtime", "mtime")})
    added = found.filter("outcome = 'archived'").select("provider", "source_path", "rel_path", "version", "archive", F.col("size"), "mtime", F.col("sha").alias("content_sha256"), "first_ts", "last_ts", F.coalesce("line_count", F.lit(0)).alias("line_count"))
    columns = added.columns
    keep(stay.select(*columns).unionByName(added), "manifest")
    every_file = met.select("path", "provider", "size", "due").join(found.select("path", "outcome"), "path", "left").withColumn("outcome", F.when(~F.col("due"), "skipped").when(F.col("outcome") == "restored", "archived").otherwise(F.col("outcome")))
    return generation + 1, [r.asDict() for r in M.archive_counters(every_file).orderBy("provider").collect()]  # a row a provider


def verified(rows: DataFrame, vault: str, deep: bool = True) -> DataFrame:
    """source_path, version, state of manifest rows: ok, corrupt or absent; not deep: whether the bundle is there (DML-12, RPT-18)."""
    spark = rows.sparkSession
    if not deep:
        there = S.bundle_list(spark, vault).select("archive", F.lit("ok").alias("_s"))
        return rows.join(there, "archive", "left").select("source_path", "version", F.coalesce("_s", F.lit("absent")).alias("state"))
    there = S.bundle_list(spark, vault).select("archive")
    found = S.bundle_members(rows.select("archive").join(there, "archive", "left_semi"), vault, content=False)
    exact = found.select("archive", F.col("name").alias("rel_path"), F.col("sha256").alias("content_sha256"), F.lit(True).alias("_ok")).distinct()
    named = found.select("archive", F.col("name").alias("rel_path"), F.lit(True).alias("_there")).distinct()
    both = rows.join(exact, ["archive", "rel_path", "content_sha256"], "left").join(named, ["archive", "rel_path"], "left")
    return both.select("source_path", "version", F.when(F.col("_ok"), "ok").when(F.col("_there"), "corrupt").otherwise("absent").alias("state"))


def member(rows: DataFrame, vault: str, name: str, version: int | None = None) -> DataFrame:
    """One row: source_path, version, content of the member that a path and version name (DML-13)."""
    one = V.resolve(rows, name, version)
    held = S.bundle_members(one.select("archive"), vault).dropDuplicates(["archive", "name", "sha256"])
    same = (one["archive"] == held["archive"]) & (one["rel_path"] == held["name"]) & (one["content_sha256"] == held["sha256"])
    return one.join(held, same).select("source_path", "version", "content")
