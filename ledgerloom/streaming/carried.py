"""A keyed parser of provider A's logs: what a file's next lines need is kept as state (STR-2, STR-5, ING-14, AGG-37).

The state of a file is its current model, its last cumulative snapshot, the events that wait for a first model, and the
sums that were booked for it by day and model. Events before the first model are booked as unknown at once; when the
model comes, their negation and the events under that model follow. A file that begins anew (the next life) takes back
all that it was booked for. So the signed sums of all output are the cube of the files as they are, however the lines
were cut into batches.

All of it is one value, read once and written once for a file in a batch: each call of the state store is a round trip.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ledgerloom.operators import extraction as X
from ledgerloom.operators.cube import BUCKETS, KEY, cube
from ledgerloom.sources.tail import tail_lines

UNKNOWN = "unknown"
#: Of a decoded record: the order in its file, the model it sets, whether it counts, its day (null: not booked), its tokens, its cumulative snapshot.
_TOKENS = ("input", "cache_read", "cache_write_5m", "output", "reasoning")
_TOTALS = tuple(c.split()[0] for c in X.COUNTS.split(", "))
DECODED = ("path", "life", "start_offset", "context_model", "is_count", "date", *_TOKENS, *[f"t_{c}" for c in _TOTALS])
DELTAS = "path string, date string, model string, " + ", ".join(f"{c} long" for c in _TOKENS) + ", events long, resets long, repeats long"
PROVIDER_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def decoded(lines: DataFrame, zone: str = "UTC") -> DataFrame:
    """The records of lines (path, life, start_offset, raw) that matter to the parser, decoded by built-in functions (DECODED)."""
    r = X.decode_a(lines.select(F.struct("path", "life").alias("path"), F.col("start_offset").alias("line_no"), "raw")).filter("context_model is not null or is_count")
    n = lambda s, c: F.coalesce(F.col(f"{s}.{c}"), F.lit(0))
    booked = F.col("is_count") & (n("u", "input_tokens") + n("u", "output_tokens") > 0) & F.col("ts").isNotNull()
    date = F.when(booked, F.date_format(F.from_utc_timestamp("ts", zone), "yyyy-MM-dd"))
    tokens = [n("u", c).alias(name) for c, name in zip(("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens"), _TOKENS)]
    return r.select("path.path", "path.life", F.col("line_no").alias("start_offset"), "context_model", "is_count", date.alias("date"), *tokens, *[n("total", c).alias(f"t_{c}") for c in _TOTALS])


def _add(sums: dict[tuple[str, str], list[int]], key: tuple[str, str], more: list[int]) -> None:
    held = sums.setdefault(key, [0] * len(more))
    for k, n in enumerate(more):
        held[k] += n


class UsageParser(StatefulProcessor):
    """Rows of one file in any order within a batch -> what its sums by day and model change by (DELTAS)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        # pending: events (date, tokens); booked: sums (date, model, tokens, events); both as JSON
        self.context = handle.getValueState("context", "life long, model string, " + ", ".join(f"{c} long" for c in _TOTALS) + ", seen boolean, pending string, booked string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = [r for frame in rows for r in zip(*(frame[c].tolist() for c in DECODED))]  # of one file's new lines, those that matter
        life, model, last, waiting, booked = -1, None, None, [], {}
        if (held := self.context.get()) is not None:
            life, model, *totals, seen, pending, sums = held
            last = tuple(totals) if seen else None
            waiting = json.loads(pending)
            booked = {(date, under): tokens for date, under, *tokens in json.loads(sums)}
        changes: dict[tuple[str, str], list[int]] = {}  # what is handed on
        resets = repeats = 0

        def book(date: str, under: str, tokens: tuple, sign: int) -> None:
            for sums in (changes, booked):
                _add(sums, (date, under), [sign * n for n in (*tokens, 1)])

        for r in (dict(zip(DECODED, r)) for r in sorted(found, key=lambda r: r[1:3])):
            if r["life"] != life:
                if life >= 0:  # the file began anew: all that it was booked for goes
                    for k, sums in booked.items():
                        _add(changes, k, [-n for n in sums])
                    waiting, model, last, booked = [], None, None, {}
                life = int(r["life"])
            if not r["is_count"]:
                model = r["context_model"]
                for date, *tokens in waiting:
                    book(date, UNKNOWN, tokens, -1)
                    book(date, model, tokens, 1)
                waiting = []
                continue
            now = tuple(int(r[f"t_{c}"]) for c in _TOTALS)
            if last is not None:
                resets += any(a < b for a, b in zip(now, last))
                repeats += now == last
            last = now
            if isinstance(r["date"], str):
                tokens = tuple(int(r[c]) for c in _TOKENS)
                book(r["date"], model or UNKNOWN, tokens, 1)
                if model is None:
                    waiting.append((r["date"], *tokens))

        kept = [(*k, *sums) for k, sums in booked.items() if any(sums)]
        self.context.update((life, model, *(last or [0] * len(_TOTALS)), last is not None, json.dumps(waiting), json.dumps(kept)))
        out = [(key[0], *k, *sums) for k, sums in changes.items() if any(sums)]
        if out or resets or repeats:
            out = out or [(key[0], None, None, *[0] * (len(_TOKENS) + 1))]
            made = pd.DataFrame(out, columns=["path", "date", "model", *_TOKENS, "events"])
            yield made.assign(resets=[resets] + [0] * (len(out) - 1), repeats=[repeats] + [0] * (len(out) - 1))

    def close(self) -> None:
        pass


def parsed(lines: DataFrame, zone: str = "UTC") -> DataFrame:
    """Stream of lines (path, life, start_offset, raw) -> signed changes of each file's sums (DELTAS). The session needs the state store that PROVIDER_STATE names."""
    rows = decoded(lines, zone).select(*DECODED)
    return rows.groupBy("path").transformWithStateInPandas(UsageParser(), outputStructType=DELTAS, outputMode="Update", timeMode="None")


def follow_logs(spark: SparkSession, root: str, out: str, checkpoint: str, zone: str = "UTC", pattern: str = "*.jsonl") -> StreamingQuery:
    """What has been added to the logs below a root since the last call, then an end: only new bytes are read, and changes of the sums go to a folder for each batch, so that a batch that runs again replaces itself (ING-22, STR-6, RPT-8)."""
    own = spark.newSession()  # the state store is this stream's choice and nobody else's
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER_STATE)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/deltas/batch={batch_id}")

    lines = tail_lines(own, root, f"{checkpoint}-positions", pattern)
    return parsed(lines, zone).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cube_of_changes(spark: SparkSession, out: str, provider: str = "codex") -> DataFrame:
    """The cube as the sum of all changes; what sums to nothing is left out."""
    deltas = spark.read.parquet(f"{out}/deltas").filter("date is not null").withColumn("provider", F.lit(provider))
    rows = deltas.withColumns({c: F.lit(0).cast("long") for c in BUCKETS if c not in _TOKENS})
    return cube(rows.select(*KEY, *BUCKETS)).filter(" or ".join(f"{c} <> 0" for c in BUCKETS))
