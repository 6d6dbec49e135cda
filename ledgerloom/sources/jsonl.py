"""Logs of JSON lines: roots, listings, positioned records, file fingerprints (SRC-1..5, ING-13, ING-16, ING-30, FN-24)."""

from __future__ import annotations

import os
from collections.abc import Iterator
from fnmatch import fnmatchcase
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import FINGERPRINT_BYTES, tail_fingerprint
from ledgerloom.sources.tail import file_system

LINES = "path string, line_no long, start_offset long, end_offset long, raw string"


def resolve_root(provider: str, flag: str | None = None, env: tuple[str, ...] = (), default: str = "") -> dict[str, str | bool]:
    """A provider's root: an explicit flag, else the first environment variable that is set, else the default; and which won (SRC-1)."""
    for origin, value in [("flag", flag), *((f"env:{name}", os.environ.get(name)) for name in env), ("default", os.path.expanduser(default))]:
        if value:
            return {"provider": provider, "path": value, "origin": origin}
    raise ValueError(f"no root for {provider}")


def listing(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """path, size, mtime of the files of this pattern below a root (SRC-2). Contents aren't read; each folder of the root is listed by a task, and no file is a task's split of its own. Names that Spark takes for hidden are left out."""
    fs, top = file_system(root)
    prefix = "file:" if isinstance(fs, pa.fs.LocalFileSystem) else root[: root.index("://") + 3] + (urlsplit(root).netloc if root.startswith(("hdfs:", "viewfs:")) else "")
    hidden = lambda name: name.startswith(".") or name.startswith("_") and "=" not in name
    folders = [f.path for f in fs.get_file_info(pa.fs.FileSelector(top)) if f.type == pa.fs.FileType.Directory and not hidden(f.base_name)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(root)
        for batch in batches:
            for folder, deep in zip(*(c.to_pylist() for c in batch.columns)):
                todo, found = [folder], []
                while todo:
                    for f in fs.get_file_info(pa.fs.FileSelector(todo.pop())):
                        if hidden(f.base_name):
                            continue
                        if f.is_file and fnmatchcase(f.base_name, pattern):
                            found.append((prefix + f.path, f.size, f.mtime_ns // 1_000_000 * 1000))
                        elif deep and f.type == pa.fs.FileType.Directory:
                            todo.append(f.path)
                for k in range(0, len(found), 10_000):
                    path, size, mtime = zip(*found[k : k + 10_000])
                    yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(size, pa.int64()), pa.array(mtime, pa.timestamp("us", "UTC"))], names=["path", "size", "mtime"])

    rows = spark.createDataFrame([(top, False), *[(f, True) for f in folders]], "folder string, deep boolean")
    tasks = min(len(folders) + 1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    return rows.repartition(tasks).mapInArrow(run, "path string, size long, mtime timestamp")


def contents(spark: SparkSession, root: str) -> DataFrame:
    """path, size, mtime, content of the .jsonl files below a root."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(root)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")


def positioned_lines(files: DataFrame, complete_only: bool = True, bounds: str | None = None, start: str | None = None, lines: str | None = None) -> DataFrame:
    """Every record of files (path, content) with its line number and byte range.

    complete_only leaves out a last record without a line end (a live log's next read brings it); otherwise it counts,
    as in an archive (SRC-5). `bounds` names a column past whose offset nothing is read (SRC-4), `start` one before
    which nothing is, and `lines` one with the number of lines before that, from which the numbers go on (SRC-3).
    Carriage returns before a line end aren't part of a record.
    """
    spark = files.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")  # whole files
    columns = ["path", "content", *[c for c in (bounds, start, lines) if c]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                content = row["content"]
                end = len(content) if not bounds or row[bounds] is None else min(len(content), row[bounds])
                at, line, out = (row[start] or 0) if start else 0, (row[lines] or 0) if lines else 0, []
                while at < end:
                    stop = content.find(b"\n", at, end)
                    whole = stop >= 0
                    stop = stop + 1 if whole else end
                    line += 1
                    if whole or not complete_only:
                        out.append((row["path"], line, at, stop, content[at:stop].rstrip(b"\r\n").decode("utf-8", "replace")))
                    at = stop
                for k in range(0, len(out), 10_000):
                    columns_ = list(zip(*out[k : k + 10_000]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns_, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["path", "line_no", "start_offset", "end_offset", "raw"])

    return files.select(*columns).mapInArrow(run, LINES)


def fingerprints(files: DataFrame) -> DataFrame:
    """path, size, mtime, content_sha256, prefix and tail fingerprints (ING-23, FN-24)."""
    return files.select(
        "path", "size", "mtime",
        F.sha2("content", 256).alias("content_sha256"),
        F.sha2(F.substring("content", 1, FINGERPRINT_BYTES), 256).alias("prefix_hash"),
        tail_fingerprint(F.col("content"), F.col("size")).alias("tail_hash"),
    )


def classify_files(seen: DataFrame, checkpoints: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """path, kind of every file listed or known: new, unchanged, appended, rewritten, missing (ING-13, JN-13).

    seen (path, size, mtime), checkpoints (path, size, mtime, byte_offset, tail_hash). A grown file is appended if the
    bytes before its old offset still have the old fingerprint, for which files (path, content) are needed.
    """
    a, b = seen.alias("a"), checkpoints.alias("b")
    both = a.join(b, F.col("a.path") == F.col("b.path"), "full_outer")
    same_tail = F.lit(False)
    if files is not None:
        both = both.join(files.select(F.col("path").alias("_path"), "content"), F.col("a.path") == F.col("_path"), "left")
        same_tail = F.coalesce(tail_fingerprint(F.col("content"), F.col("b.byte_offset")) == F.col("b.tail_hash"), F.lit(False))
    kind = (
        F.when(F.col("a.path").isNull(), "missing")
        .when(F.col("b.path").isNull(), "new")
        .when((F.col("a.size") == F.col("b.size")) & (F.col("a.mtime") == F.col("b.mtime")), "unchanged")
        .when((F.col("a.size") > F.col("b.size")) & same_tail, "appended")
        .otherwise("rewritten")
    )
    return both.select(F.coalesce("a.path", "b.path").alias("path"), kind.alias("kind"))


def content_owners(files: DataFrame) -> DataFrame:
    """path, owner: of files with equal content the first path owns the contribution; the others are its aliases (ING-16, ING-17, DML-11)."""
    hashed = files.select("path", F.sha2("content", 256).alias("_hash"))
    owners = hashed.groupBy("_hash").agg(F.min("path").alias("owner"))
    return hashed.join(owners, "_hash").select("path", "owner")


def line_statistics(lines: DataFrame, longest: int = 1 << 20) -> DataFrame:
    """path, first_ts, last_ts, line_count; a longer line counts but isn't parsed, and an unreadable time is ignored (ING-30, AGG-28)."""
    at = F.when(F.octet_length("raw") <= longest, F.try_to_timestamp(F.get_json_object("raw", "$.timestamp")))
    return lines.groupBy("path").agg(F.min(at).alias("first_ts"), F.max(at).alias("last_ts"), F.count(F.lit(1)).alias("line_count"))
