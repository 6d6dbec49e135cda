"""Incremental ingestion with Structured Streaming (STR-1..7, ING-19, ING-22)."""

from __future__ import annotations

import json
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom.operators import extraction as X
from ledgerloom.operators.cube import BUCKETS, KEY, cube, sums


def read_new_files(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """path and content of log files as they come; each path is read once, the checkpoint remembers which. For logs that grow in place see plans.jobs.sync (STR-1)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root).select("path", "content")


def ledger_writer(out: str, zone: str = "UTC", provider: str = "codex"):
    """For foreachBatch: the batch's files, their contributions and their messages, in folders named by provider and batch, so that a batch that runs again replaces itself (STR-6). A file without events is among the files too, so that what it held before no longer counts."""

    def write(batch: DataFrame, batch_id: int) -> None:
        from ledgerloom.sources.jsonl import positioned_lines

        batch = batch.persist()
        at = f"provider_of={provider}/batch={batch_id}"
        try:
            batch.select("path").write.mode("overwrite").parquet(f"{out}/files/{at}")
            lines = positioned_lines(batch)
            if provider == "codex":
                rows = X.to_cube_rows(X.events_a(lines), zone)
                rows.groupBy("path", *KEY).agg(*sums()).write.mode("overwrite").parquet(f"{out}/ledger/{at}")
            else:
                X.candidates_b(lines).write.mode("overwrite").parquet(f"{out}/messages/{at}")
        finally:
            batch.unpersist()

    return write


def ingest(spark: SparkSession, root: str, out: str, checkpoint: str, zone: str = "UTC", provider: str = "codex", pattern: str = "*.jsonl") -> StreamingQuery:
    """All files of a provider that are new since the last call, then an end (ING-22, RPT-8)."""
    return read_new_files(spark, root, pattern).writeStream.foreachBatch(ledger_writer(out, zone, provider)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cube_of(spark: SparkSession, out: str, zone: str = "UTC", providers: tuple[str, ...] = ("codex",)) -> DataFrame:
    """The cube of what the named providers' streams have written: a file seen again counts as it was last, a message as its best snapshot; a vanished file stays (ING-18, ING-19, ING-21)."""
    rows = None
    for provider in providers:
        if provider == "codex":
            last = spark.read.parquet(f"{out}/files").filter(F.col("provider_of") == provider).groupBy("path").agg(F.max("batch").alias("batch"))
            found = spark.read.parquet(f"{out}/ledger").join(last, ["path", "batch"])
        else:
            found = X.to_cube_rows(X.events_b(X.progressive(spark.read.parquet(f"{out}/messages"), "message_id", ["batch", "path", "line_no"])), zone)
        found = found.select(*KEY, *BUCKETS)
        rows = found if rows is None else rows.unionByName(found)
    return cube(rows)


MESSAGE_STATE = "best long, first timestamp"
MESSAGE_OUT = "message_id string, score long, ts timestamp, old_score long, old_ts timestamp"
#: Groups of messages, each of which is one value of the state store. A checkpoint goes on with the number that it began with.
MESSAGE_GROUPS = 4096
#: Snapshots in an Arrow batch.
BATCH_ROWS = 10_000
#: Of a group its messages, each as id, best score and first time in microseconds, as JSON.
GROUP_STATE = "records string"
GROUP_OUT = MESSAGE_OUT.replace("timestamp", "long")


def _beat(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    best, first = state.get if state.exists else (None, None)
    old = best, first
    rows = [r for frame in frames for r in zip(*(frame[c].tolist() for c in ("line_no", "score", "ts")))]  # a message may lie in several frames
    for _, score, ts in sorted(rows, key=itemgetter(0)):
        if score > (-1 if best is None else best):
            best, first = int(score), ts if first is None else min(first, ts)
    if (best, first) != old:
        state.update((best, first))
        yield pd.DataFrame({"message_id": [key[0]], "score": [best], "ts": [first], "old_score": [old[0]], "old_ts": [old[1]]}, dtype=object)


def _beat_group(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """As _beat for all messages of a group (times in microseconds), whose records are read once and written once."""
    held = {message: (best, first) for message, best, first in json.loads(state.get[0])} if state.exists else {}
    rows = [r for frame in frames for r in zip(*(frame[c].tolist() for c in ("line_no", "message_id", "score", "ts")))]
    old = {}
    for _, message, score, ts in sorted(rows, key=itemgetter(0)):
        best, first = held.get(message, (None, None))
        if score > (-1 if best is None else best):
            old.setdefault(message, (best, first))
            if ts == ts:  # a time that is there
                first = int(ts) if first is None else min(first, int(ts))
            held[message] = int(score), first
    if old:
        state.update((json.dumps([(message, *record) for message, record in held.items()]),))
        yield pd.DataFrame([(message, *held[message], *before) for message, before in old.items()], columns=[c.split()[0] for c in GROUP_OUT.split(", ")], dtype=object)


def message_updates(snapshots: DataFrame, groups: int | None = MESSAGE_GROUPS) -> DataFrame:
    """Stream of snapshots (message_id, line_no, ts, score) -> every change of a message's record with what it replaces (STR-3, STR-4).

    The state of a message never expires: late and better snapshots always count. It grows with the messages. Messages
    share a state in groups by their hash, since each state is a call and two round trips; a batch writes the groups
    that it changes. groups=None: a state for each message.
    """
    snapshots.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))  # readers of whole files leave few
    if groups is None:
        return snapshots.groupBy("message_id").applyInPandasWithState(_beat, MESSAGE_OUT, MESSAGE_STATE, "update", GroupStateTimeout.NoTimeout)
    rows = snapshots.select(F.pmod(F.xxhash64("message_id"), F.lit(groups)).alias("group"), "message_id", "line_no", "score", F.unix_micros("ts").alias("ts"))
    found = rows.groupBy("group").applyInPandasWithState(_beat_group, GROUP_OUT, GROUP_STATE, "update", GroupStateTimeout.NoTimeout)
    return found.withColumns({c: F.timestamp_micros(c) for c in ("ts", "old_ts")})


def daily_windows(events: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Tumbling days of a stream of events in UTC, with bounded state (STR-7)."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day"), "provider", "model").agg(*sums()).select(F.col("window.start").alias("day"), "provider", "model", *[c for c in ("input", "output")])
