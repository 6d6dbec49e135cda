"""Bundles of an archive, .tar.zst files of one provider and month, written and read by tasks (SRC-8, SRC-9, SRC-20).

The sink is a data source: each task writes its bundles to a staging folder, a member at a time; the driver moves them
to their places when all tasks are done, and an abort removes the staging folder, so that a failed run leaves the old
bundles. Readers stream: no more than one member is held.
"""

from __future__ import annotations

import hashlib
import io
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ledgerloom.sources.tail import file_system, spread

MEMBERS = "archive string, name string, place long, size long, content binary, sha256 string"
ROWS = "archive string, place long, name string, mtime timestamp, content binary"
STAGING = ".staging"


@dataclass
class Written(WriterCommitMessage):
    bundles: list[tuple[str, int]]  # name below the root, bytes


class BundleWriter(DataSourceArrowWriter):
    """Rows (ROWS) come sorted by archive and place, all of an archive in one task."""

    def __init__(self, root: str) -> None:
        self.root, self.run = root, uuid.uuid4().hex

    def _at(self, name: str = "") -> tuple[pa.fs.FileSystem, str]:
        fs, root = file_system(self.root)
        return fs, f"{root}/{STAGING}/{self.run}/{name}".rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import zstandard
        from pyspark import TaskContext

        # attempts of a task write side by side; the one that is committed is named
        attempt, bundles, now, layers = f"{TaskContext.get().partitionId()}-{TaskContext.get().attemptNumber()}", [], None, []

        def close() -> None:
            for layer in reversed(layers):
                layer.close()
            if now:
                fs, path = self._at(bundles[-1][0])
                bundles[-1] = (bundles[-1][0], fs.get_file_info(path).size)

        for batch in iterator:
            for row in batch.to_pylist():
                if row["archive"] != now:
                    close()
                    now = row["archive"]
                    bundles.append((f"{attempt}/{now}", 0))
                    fs, path = self._at(bundles[-1][0])
                    fs.create_dir(path.rpartition("/")[0])
                    raw = fs.open_output_stream(path, compression=None)
                    packed = zstandard.ZstdCompressor(level=9).stream_writer(raw, closefd=False)
                    layers = [raw, packed, tarfile.open(fileobj=packed, mode="w|")]
                info = tarfile.TarInfo(row["name"])
                info.size, info.mode, info.mtime = len(row["content"]), 0o600, row["mtime"].timestamp() if row["mtime"] else 0
                layers[2].addfile(info, io.BytesIO(row["content"]))
        close()
        return Written(bundles)

    def commit(self, messages: list[Written | None]) -> None:
        fs, staging = self._at()
        _, root = file_system(self.root)
        for name, _ in (b for m in messages if m for b in m.bundles):
            target = f"{root}/{name.partition('/')[2]}"
            fs.create_dir(target.rpartition("/")[0])
            fs.move(f"{staging}/{name}", target)
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        fs, staging = self._at()
        if fs.get_file_info(staging).type != pa.fs.FileType.NotFound:
            fs.delete_dir(staging)


class Bundles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tarbundles"

    def schema(self) -> str:
        return ROWS

    def writer(self, schema, overwrite: bool) -> BundleWriter:
        return BundleWriter(self.options["path"])


def write_bundles(rows: DataFrame, root: str) -> None:
    """Writes each archive of rows (ROWS) whole, in place of the bundle of that name."""
    spark = rows.sparkSession
    try:
        spark.dataSource.register(Bundles)
    except AnalysisException as found:
        if found.getCondition() != "DATA_SOURCE_ALREADY_EXISTS":
            raise
    dealt = rows.select("archive", "place", "name", "mtime", "content").repartition("archive").sortWithinPartitions("archive", "place")
    dealt.write.format("tarbundles").mode("append").option("path", root).save()


def bundle_list(spark: SparkSession, root: str) -> DataFrame:
    """archive (its name below the root), size, mtime. Contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.tar.zst").load(root)
    return found.select(F.regexp_extract("path", r"([^/]+/[^/]+\.tar\.zst)$", 1).alias("archive"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def members_at(files: DataFrame, content: bool = True) -> DataFrame:
    """Members (MEMBERS; archive is the bundle's path) of bundles (path), hashed as they are read, one held at a time; a bundle that can't be read ends with what could be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    fs, at = file_system(path)
                    with fs.open_input_stream(at, compression=None) as raw, tarfile.open(fileobj=zstandard.ZstdDecompressor().stream_reader(raw), mode="r|") as tar:
                        for place, member in enumerate(m for m in tar if m.isfile()):
                            data = tar.extractfile(member).read()
                            row = ([path], [member.name], [place], [len(data)], [data if content else None], [hashlib.sha256(data).hexdigest()])
                            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()))], names=["archive", "name", "place", "size", "content", "sha256"])
                except (OSError, EOFError, tarfile.TarError, zstandard.ZstdError):
                    continue

    return spread(files.select("path").distinct()).mapInArrow(run, MEMBERS)


def bundle_members(archives: DataFrame, root: str, content: bool = True) -> DataFrame:
    """Members of the bundles named in archives (archive, below the root)."""
    found = members_at(archives.select(F.concat(F.lit(f"{root}/"), "archive").alias("path")), content)
    return found.withColumn("archive", F.expr(f"substring(archive, {len(root) + 2})"))


def contents_at(files: DataFrame) -> DataFrame:
    """path, content of files (path), opened by the tasks that the rows lie in; one that can't be read has no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    fs, at = file_system(path)
                    with fs.open_input_stream(at, compression=None) as f:
                        data = f.read()
                except OSError:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([data], pa.binary())], names=["path", "content"])

    return spread(files.select("path")).mapInArrow(run, "path string, content binary")


def copy_raw(files: DataFrame, out: str) -> DataFrame:
    """Byte-exact copies of files (path, name) below a folder, made by the tasks, and the manifest (name, size, sha256) of what was copied, as a table beside them (SRC-19).

    A copy appears under its name when it is whole; a task that runs again replaces it. A file that can't be read is
    missing in the manifest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, folder = file_system(out)
        for batch in batches:
            done = []
            for path, name in zip(*(c.to_pylist() for c in batch.columns)):
                target, hashed, size = f"{folder}/raw/{name}", hashlib.sha256(), 0
                try:
                    fs, at = file_system(path)
                    with fs.open_input_stream(at, compression=None) as source:
                        to.create_dir(target.rpartition("/")[0])
                        part = f"{target}.{uuid.uuid4().hex}.part"
                        with to.open_output_stream(part, compression=None) as f:
                            while data := source.read(1 << 20):
                                hashed.update(data)
                                size += len(data)
                                f.write(data)
                        to.move(part, target)
                except OSError:
                    continue
                done.append((name, size, hashed.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*done)) or [()] * 3, (pa.string(), pa.int64(), pa.string()))], names=["name", "size", "sha256"])

    spread(files.select("path", "name")).mapInArrow(run, "name string, size long, sha256 string").write.mode("overwrite").parquet(f"{out}/manifest")
    return files.sparkSession.read.parquet(f"{out}/manifest")
