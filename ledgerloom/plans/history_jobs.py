"""The index of sessions and prompts over a store of generations: logs of both providers and archive bundles (ING-24, ING-25, RPT-10).

A run lists, reads only what differs from what it knows (or what an older rule extracted), exchanges the rows of those
sources, marks what is missing and records what it met. Rows of a vanished source stay, as not available.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import history as Y
from ledgerloom.operators import maintenance as M
from ledgerloom.operators.adapters import adapter
from ledgerloom.plans.jobs import _table
from ledgerloom.sources import jsonl as J
from ledgerloom.sources import tail as L
from ledgerloom.sources.bundles import members_at
from ledgerloom.sources.scratch import kept
from ledgerloom.sources import sinks as S

RULE = 1  # the version of what is extracted; a source of an older one is read again
SOURCES = "path string, provider string, size long, mtime timestamp, content_sha string, rule int, missing boolean"
SESSIONS = "path string, provider string, native_id string, parent_native string, forked_from string, cwd string, branch string, repository string, project string, project_source string, thread_kind string, first_ts timestamp, last_ts timestamp, line_count long"
PROMPTS = "path string, provider string, line_no long, ts string, role string, text string, classification string, kind string, searchable boolean, oversized boolean, prompt_id string"
BUNDLES = "archive string, size long, mtime timestamp, fingerprint string"
MEMBERS = "archive string, name string, size long, sha256 string"


def _sessions(lines: DataFrame, provider: str) -> DataFrame:
    return J.line_statistics(lines).join(adapter(provider).sessions(lines), "path", "left").withColumn("provider", F.lit(provider))


def _prompts(lines: DataFrame, provider: str, assistant: bool) -> DataFrame:
    made = adapter(provider).prompts(lines, assistant).withColumn("provider", F.lit(provider))
    return made.withColumn("prompt_id", M.stable_id("path", "line_no"))


def index_history(spark: SparkSession, roots: dict[str, str], store: str, generation: int, assistant: bool = False, pattern: str = "*.jsonl") -> tuple[int, dict]:
    """Reads generation `generation` of sources, sessions and prompts (0: none), writes the next, and counts what it met: new, moved, changed, unchanged, missing, failed."""
    out = f"{store}/generation={generation + 1}"

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        return spark.read.schema(df.schema).parquet(f"{out}/{name}")

    known = _table(spark, store, generation, "sources", SOURCES)
    listed = None
    for provider, root in roots.items():
        one = J.listing(spark, root, pattern).withColumn("provider", F.lit(provider))
        listed = one if listed is None else listed.unionByName(one)
    met = listed.join(known.select("path", *[F.col(c).alias(f"old_{c}") for c in known.columns if c != "path"]), "path", "full_outer")
    same = (F.col("size") == F.col("old_size")) & (F.col("mtime") == F.col("old_mtime")) & (F.col("old_rule") == RULE) & ~F.col("old_missing")
    kind = F.when(F.col("size").isNull(), "missing").when(F.col("old_size").isNull(), "new").when(same, "unchanged").otherwise("changed")
    met = keep(met.withColumn("kind", kind), "met")
    read = met.filter("kind in ('new', 'changed')")
    none = {"offsets": F.array().cast("array<long>"), **{f"old_{c}": F.lit(None).cast("long" if c in ("byte_offset", "lines") else "string") for c in ("byte_offset", "lines", "complete_sha", "head_hash", "chain")}}
    facts = keep(L.facts_at(read.select("path").withColumns(none)).select("path", "content_sha"), "facts")

    # a new path with the content of exactly one vanished source is that source, moved
    gone = met.filter("kind = 'missing'").groupBy(F.col("old_content_sha").alias("content_sha")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("moved_from")).filter("n = 1").drop("n")
    fresh = facts.join(met.filter("kind = 'new'").select("path"), "path", "left_semi")
    moves = keep(fresh.join(gone, "content_sha").groupBy("moved_from").agg(F.min("path").alias("path")), "moves")
    state = met.join(facts, "path", "left").join(moves, "path", "left").join(moves.select(F.col("moved_from").alias("path"), F.lit(True).alias("left_here")), "path", "left").filter("left_here is null")
    failed = F.col("kind").isin("new", "changed") & F.col("content_sha").isNull()
    state = keep(state.withColumn("kind", F.when(failed, "failed").when(F.col("moved_from").isNotNull(), "moved").otherwise(F.col("kind"))), "state")

    sources = state.filter("not (kind = 'failed' and old_size is null)").select(
        "path", F.coalesce("provider", "old_provider").alias("provider"), *[F.when(F.col("kind").isin("failed", "missing"), F.col(f"old_{c}")).otherwise(F.col(c)).alias(c) for c in ("size", "mtime")],
        F.coalesce("content_sha", "old_content_sha").alias("content_sha"), F.when(F.col("kind").isin("failed", "missing"), F.col("old_rule")).otherwise(RULE).alias("rule"), (F.col("kind") == "missing").alias("missing"),
    )
    keep(sources, "sources")
    changed = state.filter("kind in ('new', 'changed', 'moved')").select("path", "provider")
    replaced = keep(changed.select("path").union(moves.select("moved_from")), "replaced")
    whole = changed.select("path", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("lines"), F.lit(None).cast("long").alias("stop"))
    lines = kept(L.lines_at(whole), "lines")  # read once, used for sessions and prompts
    for name, schema, made in (("sessions", SESSIONS, _sessions), ("prompts", PROMPTS, lambda x, p: _prompts(x, p, assistant))):
        before = _table(spark, store, generation, name, schema)
        rows = before.join(replaced, "path", "left_anti")
        for provider in roots:
            own = lines.join(changed.filter(F.col("provider") == provider).select("path"), "path", "left_semi")
            rows = rows.unionByName(made(own, provider).select(*before.columns))
        keep(rows, name)
    counts = {r["kind"]: r["n"] for r in state.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    keep(spark.createDataFrame([(generation + 1, RULE, k, n) for k, n in sorted(counts.items())], "generation int, rule int, kind string, n long"), "run")
    return generation + 1, counts


def prompts_with_state(spark: SparkSession, store: str, generation: int) -> DataFrame:
    """Prompts with `available`: whether their source is there."""
    missing = _table(spark, store, generation, "sources", SOURCES).filter("missing").select("path", F.lit(True).alias("_gone"))
    return _table(spark, store, generation, "prompts", PROMPTS).join(missing, "path", "left").withColumn("available", F.col("_gone").isNull()).drop("_gone")


def excluded(spark: SparkSession, store: str, generation: int) -> DataFrame:
    """What can't be searched, by classification and reason (ING-28)."""
    return Y.exclusions(_table(spark, store, generation, "prompts", PROMPTS))


def index_bundles(spark: SparkSession, root: str, store: str, generation: int) -> tuple[int, dict]:
    """Members of the archive bundles below a root; a bundle of known size and time is skipped, and one whose members' hashes are the same changes nothing (ING-25)."""
    out = f"{store}/generation={generation + 1}"

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        return spark.read.schema(df.schema).parquet(f"{out}/{name}")

    known, members = _table(spark, store, generation, "bundles", BUNDLES), _table(spark, store, generation, "members", MEMBERS)
    listed = S.list_bundles(spark, root)
    met = listed.join(known.toDF("archive", "old_size", "old_mtime", "old_fingerprint"), "archive", "full_outer")
    first = F.when(F.col("size").isNull(), "missing").when(F.col("old_size").isNull(), "new").when((F.col("size") == F.col("old_size")) & (F.col("mtime") == F.col("old_mtime")), "unchanged").otherwise("changed")
    met = keep(met.withColumn("kind", first), "met-bundles")
    differ = met.filter("kind in ('new', 'changed')").select(F.col("archive").alias("path"))
    found = keep(members_at(differ, content=False).drop("content", "place"), "read-members")
    prints = found.groupBy("archive").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("name", "sha256")))), 256).alias("fingerprint"))  # of one bundle's members
    met = met.join(prints, "archive", "left")
    kind = F.when((F.col("kind") == "changed") & (F.col("fingerprint") == F.col("old_fingerprint")), "unchanged").otherwise(F.col("kind"))
    met = keep(met.withColumn("kind", kind), "state-bundles")
    keep(met.filter("size is not null").select("archive", "size", "mtime", F.coalesce("fingerprint", "old_fingerprint").alias("fingerprint")), "bundles")
    fresh = met.filter("kind in ('new', 'changed')").select("archive")
    keep(members.join(fresh, "archive", "left_anti").unionByName(found.join(fresh, "archive", "left_semi").select(*members.columns)), "members")
    return generation + 1, {r["kind"]: r["n"] for r in met.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
