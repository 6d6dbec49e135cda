"""Batch jobs over a store of generations: each run reads one, writes the next (ING-13..18, ING-22, STR-1..2, STR-6, STR-9, DML-8, DML-11, RPT-8).

A run lists the files and compares sizes and times with what it knows; only files that differ are read, by the tasks
themselves, and of one that has only grown only what comes after its last hashed block is read and the new lines are
booked. Who owns a contribution is derived anew in each run from content hashes:

* of files with equal content the first path contributes, and a present one before a vanished one;
* a new path whose first bytes are those of exactly one vanished file is that file, moved;
* a file that goes on from the whole of another one contributes what comes after that;
* a vanished file keeps its contribution.

Ledger and messages lie in buckets (sources.buckets): a run writes those that its changes fall in.

So nothing has to be handed over: a file that comes to own its content is booked then, and one that no longer does isn't
part of the ledger. Provider B's messages are kept by id, whatever file brought them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators import extraction as X
from ledgerloom.operators import maintenance as M
from ledgerloom.operators.cube import KEY, cube, sums
from ledgerloom.sources import buckets as K
from ledgerloom.sources import jsonl as J
from ledgerloom.sources import tail as L

LEDGER = "path string, date string, provider string, model string, input long, cache_read long, cache_write_5m long, cache_write_1h long, cache_write_unclassified long, output long, reasoning long"
FILES = "path string, provider string, size long, mtime timestamp, byte_offset long, lines long, content_sha string, complete_sha string, head_hash string, chain string, model string, owner string, base string, base_lines long, missing boolean, settled boolean"
MESSAGES = "message_id string, generation long, path string, line_no long, ts timestamp, iterations array<struct<model: string, raw_input: long, cache_read: long, cache_creation: long, w5m: long, w1h: long, unclassified: long, output: long>>, score long"
PROVIDERS = ("codex", "claude")


def _table(spark: SparkSession, store: str, generation: int, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{store}/generation={generation}/{name}") if generation else spark.createDataFrame([], schema)


def sync(spark: SparkSession, roots: str | dict[str, str], store: str, generation: int, zone: str = "UTC", pattern: str = "*.jsonl") -> tuple[int, dict]:
    """Reads generation `generation` (0: none), writes the next one whole, and counts what it met.

    roots: provider -> folder, or provider A's folder alone. A generation is never changed, so a run that fails leaves
    the last one as it was and can be run again; two writers can't mix. A file that can't be read is counted as failed
    and keeps what is known of it.
    """
    roots = {PROVIDERS[0]: roots} if isinstance(roots, str) else roots
    out, schemas = f"{store}/generation={generation + 1}", {}

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        schemas[name] = df.schema
        return spark.read.schema(df.schema).parquet(f"{out}/{name}")

    known = _table(spark, store, generation, "files", FILES)
    listed = None
    for provider, root in roots.items():
        one = J.listing(spark, root, pattern).withColumn("provider", F.lit(provider))
        listed = one if listed is None else listed.unionByName(one)
    listed = keep(listed, "listed")

    # what is new or differs in size or time is read; what is known of it goes with it
    old = known.select("path", *[F.col(c).alias(f"old_{c}") for c in known.columns if c != "path"])
    met = listed.join(old, "path", "full_outer")
    same = (F.col("size") == F.col("old_size")) & (F.col("mtime") == F.col("old_mtime")) & ~F.col("old_missing")
    first = F.when(F.col("size").isNull(), "missing").when(F.col("old_size").isNull(), "new").when(same, "unchanged").otherwise("changed")
    met = keep(met.withColumn("first", first), "met")
    changed = met.filter("first in ('new', 'changed')")
    # of a file that has grown the bytes after its last whole block are read and hashed, of others all
    facts = keep(L.facts_at(changed.withColumn("offsets", F.array().cast("array<long>"))), "facts")
    names = ("byte_offset", "lines", "content_sha", "complete_sha", "head_hash", "chain")
    now = met.join(facts.select("path", *[F.col(c).alias(f"new_{c}") for c in names], "resumed"), "path", "left")
    kind = F.when(F.col("first") != "changed", F.col("first")).when(F.col("resumed"), "appended").otherwise("rewritten")
    kind = F.when(F.col("first").isin("new", "changed") & F.col("new_byte_offset").isNull(), "failed").otherwise(kind)
    now = now.withColumn("kind", kind).filter("not (kind = 'failed' and old_size is null)")
    now = now.withColumns({c: F.coalesce(F.col(f"new_{c}"), F.col(f"old_{c}")) for c in names}).withColumn("provider", F.coalesce("provider", "old_provider"))
    now = keep(now.drop("resumed", *[f"new_{c}" for c in names]), "now")

    # new files of provider A against files with the same first record: moved from a vanished one, or going on from one
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    fresh = now.filter((F.col("kind") == "new") & (F.col("provider") == PROVIDERS[0])).select("path", "head_hash", last("path").alias("under"), "byte_offset")
    other = now.filter((F.col("provider") == PROVIDERS[0]) & (F.col("kind") != "rewritten") & (F.col("byte_offset") > 0))
    gone, own = F.col("kind") == "missing", F.struct(F.col("path").alias("other"), F.col("lines").alias("other_lines"))
    # of two new files one goes on from the other only under the same name; files of one end and hash are a row, so many files of one first record don't meet in pairs
    other = other.groupBy("head_hash", F.when(F.col("kind") == "new", last("path")).alias("under"), F.col("byte_offset").alias("other_offset"), F.col("complete_sha").alias("other_sha")).agg(
        F.count_if(gone).alias("n"), F.max(F.when(gone, F.col("path"))).alias("moved_from"), F.max(F.when(~gone, own)).alias("on")
    )
    other = keep(other, "others")
    held, new = other.filter("under is null").drop("under"), other.filter("under is not null")
    ends = lambda rows, name, *key: rows.groupBy(*key).agg(F.collect_set("other_offset").alias(name))  # noqa: E731  an offset for each length of files of one first record
    wanted = fresh.join(ends(held, "a", "head_hash"), "head_hash", "left").join(ends(new, "b", "head_hash", "under"), ["head_hash", "under"], "left")
    none = F.array().cast("array<long>")
    shorter = F.concat(F.filter(F.coalesce("a", none), lambda x: x <= F.col("byte_offset")), F.filter(F.coalesce("b", none), lambda x: x < F.col("byte_offset")))
    wanted = keep(wanted.select("path", "head_hash", "under", "byte_offset", F.array_sort(F.array_distinct(shorter)).alias("offsets")).filter(F.size("offsets") > 0), "near")
    none = {f"old_{c}": F.lit(None).cast("long" if c in ("byte_offset", "lines") else "string") for c in ("byte_offset", "lines", "complete_sha", "head_hash", "chain")}
    prefixes = L.facts_at(wanted.select("path", "offsets").withColumns(none)).select("path", "prefixes").join(wanted, "path")
    prefixes = prefixes.select("path", "head_hash", "under", "byte_offset", F.explode(F.arrays_zip("offsets", "prefixes")).alias("z")).select("path", "head_hash", "under", "byte_offset", F.col("z.offsets").alias("other_offset"), F.col("z.prefixes").alias("other_sha"))
    at = ["head_hash", "other_offset", "other_sha"]
    begun = prefixes.drop("under").join(held, at).unionByName(prefixes.join(new, [*at, "under"]).filter("other_offset < byte_offset").drop("under"))
    near = keep(begun.select("path", "byte_offset", "other_offset", "n", "moved_from", "on"), "prefixes")
    gone = near.groupBy("path").agg(F.sum("n").alias("n"), F.max("moved_from").alias("moved_from")).filter("n = 1").drop("n")
    # one vanished file moves to one path, the first; further copies of it are copies
    gone = keep(gone.groupBy("moved_from").agg(F.min("path").alias("path")), "moves")
    base = near.filter("on is not null and other_offset < byte_offset").groupBy("path").agg(F.max_by("on", F.struct("other_offset", "on.other")).alias("b"))
    now = now.join(gone, "path", "left").join(base, "path", "left")
    # a moved file goes on where the vanished one ended
    before = known.select(F.col("path").alias("moved_from"), *[F.col(c).alias(f"was_{c}") for c in ("byte_offset", "lines", "model", "base", "base_lines")])
    now = now.join(before, "moved_from", "left").join(gone.select(F.col("moved_from").alias("path"), F.lit(True).alias("left_here")), "path", "left").filter("left_here is null")
    moved = F.col("moved_from").isNotNull()
    now = now.withColumns({"kind": F.when(moved, "moved").otherwise(F.col("kind")), **{f"old_{c}": F.when(moved, F.col(f"was_{c}")).otherwise(F.col(f"old_{c}")) for c in ("byte_offset", "lines", "model", "base", "base_lines")}})
    gone_to = gone.select(F.col("moved_from").alias("old_base"), F.col("path").alias("base_now"))
    rewritten = now.filter("kind = 'rewritten'").select(F.col("path").alias("old_base"), F.lit(True).alias("base_gone"))
    now = now.join(gone_to, "old_base", "left").join(rewritten, "old_base", "left")
    kept_base = F.when(F.col("base_gone").isNull() & (F.col("kind") != "rewritten"), F.coalesce("base_now", "old_base"))
    now = now.withColumn("base", F.coalesce("b.other", kept_base)).withColumn("base_lines", F.when(F.col("base").isNotNull(), F.coalesce("b.other_lines", "old_base_lines")))
    now = keep(now.drop("b", "left_here", "base_now", "base_gone", *[f"was_{c}" for c in ("byte_offset", "lines", "model", "base", "base_lines")]), "owned")
    owners = now.groupBy("provider", "content_sha").agg(F.min_by("path", F.struct(F.col("size").isNull(), "path")).alias("owner"))
    now = keep(now.join(owners, ["provider", "content_sha"]), "roles")

    # provider A: what has to be booked, whole or from where it was
    owned = (F.col("provider") == PROVIDERS[0]) & (F.col("owner") == F.col("path"))
    held = F.coalesce(F.when(moved, True).otherwise(F.col("old_owner") == F.col("path")), F.lit(False))
    goes_on = held & F.col("kind").isin("appended", "moved") & F.col("old_model").isNotNull() & F.col("base").eqNullSafe(F.col("old_base"))
    turned = (~held | ~F.col("base").eqNullSafe(F.col("old_base"))) & F.col("size").isNotNull() & (F.col("kind") != "failed")
    stale = F.col("kind").isin("new", "rewritten") | turned | (F.col("kind").isin("appended", "moved") & ~goes_on)
    plan = now.withColumn("booking", F.when(owned & goes_on & (F.col("byte_offset") > F.col("old_byte_offset")), "more").when(owned & stale, "whole"))
    plan = keep(plan.select("path", "booking", "byte_offset", "old_byte_offset", "old_lines", "old_model", "base_lines"), "plan")
    todo = plan.filter("booking is not null")
    at = F.when(F.col("booking") == "more", F.col("old_byte_offset"))
    lines = keep(X.of_interest_a(L.lines_at(todo.select("path", at.alias("start"), F.when(at.isNotNull(), F.col("old_lines")).alias("lines"), F.col("byte_offset").alias("stop")))), "lines")  # read once, used twice
    marks = todo.filter("booking = 'more'").select("path", F.col("old_model").alias("model"))
    events = M.resumed_events_a(lines, marks).join(todo.select("path", "base_lines"), "path").filter("line_no > coalesce(base_lines, 0)")
    booked = keep(X.to_cube_rows(events, zone).groupBy("path", *KEY).agg(*sums()), "booked")
    models = X.decode_a(lines).groupBy("path").agg(F.max_by("context_model", F.when(F.col("context_model").isNotNull(), F.col("line_no"))).alias("now_model"))
    models = keep(models, "models")

    # the ledger lies in buckets by path; only those of paths that are booked, moved or lost are read and written
    staying = now.filter(owned).select("path").join(plan.filter("booking = 'whole'").select("path"), "path", "left_anti")
    lost = known.filter("owner = path").select("path").join(staying, "path", "left_anti")
    paths = lost.unionByName(todo.select("path")).unionByName(gone.select("path"))
    parts = K.touched(paths, "path")
    ledger = K.read(spark, f"{store}/ledger", generation, LEDGER, parts)
    ledger = ledger.join(gone.select(F.col("moved_from").alias("path"), F.col("path").alias("moved_to")), "path", "left").withColumn("path", F.coalesce("moved_to", "path")).drop("moved_to")
    K.replace(f"{store}/ledger", generation, parts, ledger.join(staying, "path", "left_semi").unionByName(booked), "path")

    # provider B: messages by id
    from_b = now.filter((F.col("provider") == PROVIDERS[1]) & F.col("kind").isin("new", "appended", "rewritten", "moved")).select("path", F.when(F.col("kind") == "appended", F.col("old_byte_offset")).alias("start"), F.when(F.col("kind") == "appended", F.col("old_lines")).alias("lines"), F.col("byte_offset").alias("stop"))
    snapshots = X.candidates_b(L.lines_at(keep(from_b, "changed-b"))).withColumn("generation", F.lit(generation + 1).cast("long"))
    columns = [f.name for f in T.StructType.fromDDL(MESSAGES)]
    snapshots = keep(snapshots.select(*columns), "snapshots")
    parts = K.touched(snapshots, "message_id")
    every = K.read(spark, f"{store}/messages", generation, MESSAGES, parts).unionByName(snapshots)
    K.replace(f"{store}/messages", generation, parts, X.progressive(every, "message_id", ["generation", "path", "line_no"]), "message_id")

    settled = F.col("size").isNull() & F.coalesce("old_settled", F.lit(False))
    unread = F.col("kind") == "failed"
    state = now.join(models, "path", "left").select(
        "path", "provider", F.when(unread | F.col("size").isNull(), F.col("old_size")).otherwise(F.col("size")).alias("size"), F.when(unread | F.col("size").isNull(), F.col("old_mtime")).otherwise(F.col("mtime")).alias("mtime"),
        "byte_offset", "lines", "content_sha", "complete_sha", "head_hash", "chain", F.coalesce("now_model", F.when(F.col("kind") != "rewritten", F.col("old_model"))).alias("model"), "owner", "base", "base_lines", F.col("size").isNull().alias("missing"), settled.alias("settled"),
    )
    keep(state, "files")
    counts = {r["kind"]: r["n"] for r in now.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    return generation + 1, counts


def usage(spark: SparkSession, store: str, generation: int, zone: str = "UTC") -> DataFrame:
    """The cube of a generation, of both providers (SRC-12)."""
    messages = X.to_cube_rows(X.events_b(K.read(spark, f"{store}/messages", generation, MESSAGES)), zone)
    rows = K.read(spark, f"{store}/ledger", generation, LEDGER).drop("path")
    return cube(rows.unionByName(messages.select(*rows.columns)))


def issues(spark: SparkSession, store: str, generation: int) -> DataFrame:
    """Files of a run that couldn't be read, as path and message (DML-8)."""
    now = spark.read.parquet(f"{store}/generation={generation}/roles")
    return now.filter("kind = 'failed'").select("path", F.lit("the file couldn't be read").alias("message"))
