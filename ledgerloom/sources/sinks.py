"""Sinks: guarded CSV, JSON lines and envelopes, transcripts, atomic files, archive bundles (SRC-8, SRC-14..21, ING-29, FLT-21)."""

from __future__ import annotations

import hashlib
import io
import json
import os
import re
import secrets
import tarfile
import tempfile
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from itertools import batched, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import csv_guard
from ledgerloom.sources.bundles import members_at
from ledgerloom.sources.tail import file_system

#: The columns of the export, in order.
EXPORT_COLUMNS = ("date", "month", "month_name", "year", "provider", "model", "input", "cache_read", "cache_write_5m", "cache_write_1h", "cache_write_unclassified", "output", "reasoning", "total", "cost", "provenance")


def write_csv(rows: DataFrame, path: str) -> None:
    """Export rows with a header; the model can't be taken for a formula (SRC-14)."""
    rows.select(*[csv_guard(F.col(c)).alias(c) if c == "model" else c for c in EXPORT_COLUMNS]).write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def envelope(command: str, data: object, filters: dict | None = None, warnings: list[str] | None = None, zone: str = "UTC", now: datetime | None = None) -> dict:
    """A report as one document; warnings once each, in order of first sight (SET-8)."""
    return {
        "schema": 1, "command": command, "generated_at": (now or datetime.now(timezone.utc)).isoformat(), "timezone": zone, "filters": filters or {},
        "disclaimer": "Costs are estimates from list prices.", "warnings": list(dict.fromkeys(warnings or [])), "data": data,
    }


def atomic_write(path: str, content: bytes) -> None:
    """A driver-side file that is whole or not there (SRC-16)."""
    folder = os.path.dirname(os.path.abspath(path))
    fd, name = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def prune(path: str, keep: int) -> list[str]:
    """Snapshots beyond the newest `keep` by name, which the caller may remove (SRC-21, AGG-45)."""
    return sorted(os.listdir(path), reverse=True)[keep:]


def volume_policy(records: DataFrame, tools: bool = False, thinking: bool = False) -> DataFrame:
    """Records without the text of kinds that aren't asked for; which ones lost it (FLT-21)."""
    hidden = F.lit(False)
    if not tools:
        hidden = hidden | F.col("kind").isin("tool_call", "tool_result")
    if not thinking:
        hidden = hidden | (F.col("kind") == "thinking")
    return records.withColumn("omitted", hidden & F.col("text").isNotNull()).withColumn("text", F.when(~hidden, F.col("text")))


def with_tool_names(records: DataFrame) -> DataFrame:
    """Results carry the name of the call with their id, in any order (ING-29)."""
    w = Window.partitionBy("session_id", "call_id")
    name = F.max(F.when(F.col("kind") == "tool_call", F.col("tool"))).over(w)
    return records.withColumn("tool", F.when(F.col("kind") == "tool_result", F.coalesce("tool", name)).otherwise(F.col("tool")))


def write_lines(lines: DataFrame, key: str, out: str, name: Callable[[str | None], str], share: float = 1) -> None:
    """A file below `out` for each key, named by it, with that key's lines (key, line_no, raw) in order; `share`: the first bytes of each file alone.

    The tasks put each file in its place themselves, under its name only when it is whole, so the driver has nothing to
    do for a file. A task that runs again writes the same bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(out)
        mark, made, n = uuid.uuid4().hex, set(), 0
        rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for n, (k, own) in enumerate(groupby(rows, key=lambda row: row[0]), 1):
            parent, _, leaf = f"{folder}/{name(k)}".rpartition("/")
            if parent not in made:
                fs.create_dir(parent)
                made.add(parent)
            part = f"{parent}/.{leaf}.{mark}"
            pieces = ("".join(f"{raw or ''}\n" for _, raw in some).encode() for some in batched(own, 10_000))
            with fs.open_output_stream(part) as f:
                if share < 1:
                    content = b"".join(pieces)
                    f.write(content[: int(share * len(content))])
                else:
                    for piece in pieces:
                        f.write(piece)
            fs.move(part, f"{parent}/{leaf}")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["files"])

    lines.repartition(key).sortWithinPartitions(key, "line_no").select(key, "raw").mapInArrow(run, "files long").write.format("noop").mode("overwrite").save()


def partition_folder(column: str, value: str | None) -> str:
    """The folder of a partition's value as Spark names it."""
    escaped = re.sub(r"[\x00-\x1f\"#%'*/:=?\\\x7f{\[\]^]", lambda m: f"%{ord(m[0]):02X}", value or "") or "__HIVE_DEFAULT_PARTITION__"
    return f"{column}={escaped}"


def write_transcripts(records: DataFrame, path: str) -> None:
    """Provider-neutral JSON lines, a folder for each session, in place of what was there (SRC-17)."""
    fs, folder = file_system(path)
    if fs.get_file_info(folder).type == pa.fs.FileType.Directory:
        fs.delete_dir_contents(folder)
    raw = F.to_json(F.struct(*[c for c in records.columns if c != "session_id"]))
    write_lines(records.select(F.col("session_id").cast("string").alias("session_id"), "line_no", raw.alias("raw")), "session_id", path, lambda s: f"{partition_folder('session_id', s)}/records.json")


def markdown(records: list[dict], title: str, nonce: str | None = None) -> str:
    """One session's transcript; structural lines carry a nonce that no text can foretell, fences are longer than any in the text (SRC-18)."""
    nonce = nonce or secrets.token_hex(4)
    lines = ["---", f"title: {json.dumps(title)}", f"records: {len(records)}", "---", ""]
    for r in records:
        text = r.get("text") or ""
        longest = max((len(run) for run in "".join(c if c == "`" else " " for c in text).split()), default=0)
        fence = "`" * max(3, longest + 1)
        lines += [f"## {r['role']} [{nonce}]", "", fence, text, fence, ""]
    return "\n".join(lines)


def write_bundle(path: str, members: dict[str, bytes]) -> dict[str, str]:
    """A zstd tar of one archive's members; their hashes (SRC-20)."""
    import zstandard

    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as tar:
        for name in sorted(members):
            info = tarfile.TarInfo(name)
            info.size = len(members[name])
            tar.addfile(info, io.BytesIO(members[name]))
    atomic_write(path, zstandard.ZstdCompressor().compress(raw.getvalue()))
    return {name: hashlib.sha256(content).hexdigest() for name, content in members.items()}


def list_bundles(spark: SparkSession, root: str) -> DataFrame:
    """archive, size, mtime of the .tar.zst bundles below a root. Contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.tar.zst").load(root)
    return found.select(F.col("path").alias("archive"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def read_bundles(spark: SparkSession, root: str) -> DataFrame:
    """Members of all .tar.zst bundles below a root, hashed as they are read, a bundle a task (SRC-8, SRC-9)."""
    return members_at(list_bundles(spark, root).select(F.col("archive").alias("path"))).drop("place")


def archive(rows: DataFrame, path: str) -> None:
    """The archive as a table by provider and month, for contents that no bundle format binds (SRC-20)."""
    rows.write.mode("append").partitionBy("provider", "month").option("compression", "zstd").parquet(path)
