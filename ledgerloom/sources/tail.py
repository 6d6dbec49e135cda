"""Logs read by byte range: a data source whose batch reader parts large files, and whose stream follows files that grow (SRC-3, SRC-4, STR-1, ING-13, ING-15).

    spark.dataSource.register(LogRanges)
    spark.read.format("logranges").option("path", root).load()
    spark.readStream.format("logranges").option("path", root).option("state", folder).load()

Both give path, life, start_offset, end_offset, raw of every complete line: where a line starts orders a file's lines and
names a line for good. A file is parted into ranges of `rangeBytes`, each one a task's; a line belongs to the range in
which it starts. What stands after the last line end of a file waits for the rest of its line.

The stream keeps the end of each file's complete lines, with a hash of its first bytes, in a manifest for each offset
in the folder `state`; an offset is the manifest's number. From a file that has only grown the new bytes are read and
nothing else. A file that got shorter, or whose first bytes differ, begins anew with the next `life`; one that vanished
keeps what it gave.

Folders are reached by pyarrow's file systems (local, hdfs, s3, gs), by the driver and the executors alike.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
import pyarrow.fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

LINES = "path string, life long, start_offset long, end_offset long, raw string"
_NAMES = ["path", "life", "start_offset", "end_offset", "raw"]
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
RANGE_BYTES = 64 << 20
#: Bytes read at a time, and of a file's beginning that tell it from another one.
CHUNK, HEAD = 1 << 20, 4096
#: Bytes read at first past the end of a range, to find the end of its last line.
BEYOND = 4096
#: Tasks of a read, at most, whatever the number of files and ranges.
MOST_TASKS = 512
_BATCH_LINES = 5000


@dataclass
class Range(InputPartition):
    """Lines of a file that start in [begin, end) and are complete before `limit`; `at_line`: a line starts at `begin`; `open_end`: where the last complete line before `limit` ends is for the task to find."""

    path: str
    life: int
    begin: int
    end: int
    limit: int
    at_line: bool
    open_end: bool = False


@dataclass
class Task(InputPartition):
    """Spans of files, each of one or more ranges that follow each other."""

    spans: list[Range]


@dataclass
class Known:
    """What a manifest says of a file: where its complete lines end, its life, size and time, and its first bytes' length and hash."""

    end: int
    life: int
    size: int
    mtime: int
    head: int
    head_hash: str


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder and the path in it; file: may have one slash or three."""
    if uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri else (pa.fs.LocalFileSystem(), uri)


def listed(fs: pa.fs.FileSystem, root: str, pattern: str) -> list[pa.fs.FileInfo]:
    found = fs.get_file_info(pa.fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((f for f in found if f.is_file and fnmatchcase(f.base_name, pattern)), key=lambda f: f.path)


def complete_end(source: pa.NativeFile, size: int, least: int = 0) -> int:
    """Where the last complete line ends, at `least` or beyond; looks back from the end, a chunk at a time."""
    stop = size
    while stop > least:
        start = max(least, stop - CHUNK)
        source.seek(start)
        at = source.read(stop - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        stop = start
    return least


def head_hash(source: pa.NativeFile, length: int) -> str:
    source.seek(0)
    return hashlib.sha256(source.read(length)).hexdigest()


def dealt(spans: list[Range], size: int) -> list[Task]:
    """The spans cut into ranges of `size` bytes, a task for each, or for runs of as many as leave MOST_TASKS tasks."""
    ranges = [-(-(s.end - s.begin) // size) for s in spans]
    most = max(1, -(-sum(ranges) // MOST_TASKS))
    tasks, held, room = [], [], most
    for s, n in zip(spans, ranges):
        at = 0
        while at < n:
            some = min(room, n - at)
            held.append(Range(s.path, s.life, s.begin + at * size, min(s.end, s.begin + (at + some) * size), s.limit, s.at_line and not at, s.open_end))
            at, room = at + some, room - some
            if not room:
                tasks.append(Task(held))
                held, room = [], most
    return [*tasks, Task(held)] if held or not tasks else tasks


def lines_of(source: pa.NativeFile, part: Range) -> Iterator[tuple[int, int, bytes]]:
    """start, end, bytes of the range's lines; reads from the byte before it to its end, and on by little until the last line that starts in it ends."""
    at = part.begin if part.at_line else part.begin - 1
    source.seek(at)
    held, skipping = b"", not part.at_line
    while at < part.end or held:
        here = at + len(held)
        chunk = source.read(min(CHUNK, part.limit - here, max(part.end - here, BEYOND, len(held))))
        held += chunk
        begin = 0
        if skipping:
            begin = held.find(b"\n") + 1
            if not begin:
                at += len(held)
                held = b""
                if at >= part.end or not chunk:
                    return
                continue
            skipping = False
        while at + begin < part.end:
            stop = held.find(b"\n", begin)
            if stop < 0:
                break
            yield at + begin, at + stop + 1, held[begin : stop + 1]
            begin = stop + 1
        at += begin
        held = held[begin:]
        if at >= part.end or not chunk:
            return


def read_task(task: Task) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for span in task.spans:
        fs, path = file_system(span.path)
        with fs.open_input_file(path) as source:
            if span.open_end:
                limit = complete_end(source, span.limit)
                span = Range(span.path, span.life, span.begin, min(span.end, limit), limit, span.at_line)
            for start, end, raw in lines_of(source, span):
                out.append((span.path, span.life, start, end, raw.rstrip(b"\r\n").decode("utf-8", "replace")))
                if len(out) == _BATCH_LINES:
                    yield _batch(out)
                    out = []
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)], names=_NAMES)


#: Hashes go on from here: what comes before is one chained value.
BLOCK = 1 << 20
FACTS = "path string, byte_offset long, lines long, content_sha string, complete_sha string, head_hash string, chain string, resumed boolean, prefixes array<string>, read long"
NUMBERED = "path string, line_no long, start_offset long, end_offset long, raw string"


class Chain:
    """The hash of a file's first n bytes for any n on the way: whole blocks are chained into one value, to which the rest of the last block is added."""

    def __init__(self, chain: str = "", at: int = 0) -> None:
        self.chain, self.at, self.rest = chain, at, hashlib.sha256()

    def feed(self, data: bytes) -> None:
        view = memoryview(data)
        while len(view):
            piece = view[: BLOCK - self.at % BLOCK]
            self.rest.update(piece)
            self.at += len(piece)
            view = view[len(piece) :]
            if self.at % BLOCK == 0:
                self.chain, self.rest = hashlib.sha256(f"{self.chain}{self.rest.hexdigest()}".encode()).hexdigest(), hashlib.sha256()

    def digest(self) -> str:
        return hashlib.sha256(f"{self.chain}:{self.rest.hexdigest()}".encode()).hexdigest()


def first_record_hash(source: pa.NativeFile) -> str:
    """Of the first complete line with its end; of nothing if there is none."""
    source.seek(0)
    found = hashlib.sha256()
    while chunk := source.read(CHUNK):
        end = chunk.find(b"\n") + 1
        found.update(chunk[: end or len(chunk)])
        if end:
            return found.hexdigest()
    return hashlib.sha256().hexdigest()


def file_facts(source: pa.NativeFile, offsets: list[int] | None = None, known: tuple | None = None) -> tuple:
    """byte_offset, lines, content_sha, complete_sha, head_hash, chain, resumed, prefixes, bytes read (FACTS).

    known: (byte_offset, lines, complete_sha, head_hash, chain) of an earlier read. If the first record and the bytes
    from the last block before that offset on are the same, only what comes after is read; else all of it. prefixes:
    hashes of the bytes before each of `offsets`, null beyond the end.
    """
    head, read, resumed = first_record_hash(source), 0, False
    hashed, end, lines, last_hash, last_chain = Chain(), 0, 0, Chain().digest(), ""
    if known and known[0] and head == known[3]:
        begin = known[0] // BLOCK * BLOCK
        source.seek(begin)
        before = source.read(known[0] - begin)
        read += len(before)
        tried = Chain(known[4], begin)
        tried.feed(before)
        if len(before) == known[0] - begin and tried.digest() == known[2]:
            resumed, hashed = True, tried
            end, lines, last_hash, last_chain = known[0], known[1], known[2], tried.chain
    source.seek(hashed.at)
    wanted, found = sorted(set(offsets or [])), {0: Chain().digest()}
    while chunk := source.read(CHUNK):
        read += len(chunk)
        stop = chunk.rfind(b"\n") + 1
        base = hashed.at
        cuts = sorted({n - base for n in wanted if base < n <= base + len(chunk)} | ({stop} if stop else set()) | {len(chunk)})
        for a, b in zip([0, *cuts], cuts):
            hashed.feed(chunk[a:b])
            if base + b in wanted:
                found[base + b] = hashed.digest()
            if b == stop:
                end, last_hash, last_chain = base + b, hashed.digest(), hashed.chain
        lines += chunk.count(b"\n")
    return end, lines, hashed.digest(), last_hash, head, last_chain, resumed, [found.get(n) for n in offsets or []], read


def spread(files: DataFrame) -> DataFrame:
    """Rows that stand for files, dealt out to tasks by number: they are too small for Spark to see the work in them."""
    return files.repartition(max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))), "path")


def facts_at(files: DataFrame) -> DataFrame:
    """Facts (FACTS) of files (path, offsets, and of an earlier read old_byte_offset, old_lines, old_complete_sha, old_head_hash, old_chain), opened by the tasks; a file that can't be read has no row."""
    columns = ["path", "offsets", "old_byte_offset", "old_lines", "old_complete_sha", "old_head_hash", "old_chain"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.int64()]
    names = [c.split()[0] for c in FACTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, offsets, *known in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    fs, at = file_system(path)
                    with fs.open_input_file(at) as source:
                        out.append((path, *file_facts(source, offsets, tuple(known) if known[4] is not None else None)))
                except OSError:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * len(kinds), kinds)], names=names)

    return spread(files.select(*columns)).mapInArrow(run, FACTS)


def lines_at(files: DataFrame) -> DataFrame:
    """Complete lines (NUMBERED) of files (path, start, lines, stop): from byte `start`, which ends a line, on, with numbers after `lines` (null: from the beginning), and before `stop` (null: the end of the last complete line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, line, stop in zip(*(c.to_pylist() for c in batch.columns)):
                out: list[tuple] = []
                try:
                    fs, at = file_system(path)
                    with fs.open_input_file(at) as source:
                        begin, line = start or 0, line or 0
                        end = complete_end(source, source.size(), begin) if stop is None else stop
                        for a, b, raw in lines_of(source, Range(path, 0, begin, end, end, True)):
                            line += 1
                            out.append((path, line, a, b, raw.rstrip(b"\r\n").decode("utf-8", "replace")))
                            if len(out) == _BATCH_LINES:
                                yield _numbered(out)
                                out = []
                except OSError:
                    continue
                if out:
                    yield _numbered(out)

    return spread(files.select("path", "start", "lines", "stop")).mapInArrow(run, NUMBERED)


def _numbered(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["path", "line_no", "start_offset", "end_offset", "raw"])


def _uri(root: str, path: str) -> str:
    """The file's path as the root is given."""
    scheme = root.partition("://")[0] + "://" if "://" in root else "file:" if root.startswith("file:") else ""
    return f"{scheme}{path}" if not scheme.startswith("file") else f"file://{path}"


class _Options:
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.pattern = options["path"], options.get("pattern", "*.jsonl")
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))
        self.state = options.get("state")

    def scan(self, known: dict[str, Known]) -> dict[str, Known]:
        """The manifest of now. Files whose size and time are as known aren't opened; of the others the first bytes and the end are read."""
        fs, root = file_system(self.root)

        def look(info: pa.fs.FileInfo) -> tuple[str, Known]:
            path = _uri(self.root, info.path)
            old = known.get(path)
            if old and (old.size, old.mtime) == (info.size, info.mtime_ns):
                return path, old
            with fs.open_input_file(info.path) as source:
                life, begin = (old.life, old.end) if old else (0, 0)
                if old and (info.size < old.end or head_hash(source, old.head) != old.head_hash):
                    life, begin = old.life + 1, 0
                end = complete_end(source, info.size, begin)
                head = min(HEAD, end)
                return path, Known(end, life, info.size, info.mtime_ns, head, head_hash(source, head))

        found = listed(fs, root, self.pattern)
        if isinstance(fs, pa.fs.LocalFileSystem):  # nothing to wait for: threads only get in each other's way
            return known | dict(map(look, found))
        with ThreadPoolExecutor(16) as pool:
            return known | dict(pool.map(look, found))


class LogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = _Options(options)

    def partitions(self) -> list[Task]:
        """Files are listed here and opened by the tasks alone."""
        fs, root = file_system(self.options.root)
        found = [(_uri(self.options.root, f.path), f.size) for f in listed(fs, root, self.options.pattern)]
        return dealt([Range(path, 0, 0, size, size, True, True) for path, size in found if size], self.options.range_bytes)

    def read(self, partition: Task) -> Iterator[pa.RecordBatch]:
        return read_task(partition)


class LogStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = _Options(options)
        if not self.options.state:
            raise ValueError("a stream of logs needs the option state, a folder for its manifests")

    def _file(self, number: int) -> tuple[pa.fs.FileSystem, str]:
        fs, folder = file_system(self.options.state)
        return fs, f"{folder}/positions-{number:012d}.json"

    def _manifest(self, number: int) -> dict[str, Known]:
        if not number:
            return {}
        fs, path = self._file(number)
        with fs.open_input_stream(path) as f:
            return {k: Known(*v) for k, v in json.loads(f.read()).items()}

    def _numbers(self) -> list[int]:
        fs, folder = file_system(self.options.state)
        return sorted(int(f.base_name[10:22]) for f in fs.get_file_info(pa.fs.FileSelector(folder, allow_not_found=True)) if fnmatchcase(f.base_name, "positions-*.json"))

    def initialOffset(self) -> dict:
        return {"manifest": 0}

    def latestOffset(self) -> dict:
        """The last manifest, or a next one if a file has changed. One that was written and never used does no harm: ranges are differences of two manifests."""
        number = max(self._numbers(), default=0)
        known = self._manifest(number)
        now = self.options.scan(known)
        if now == known:
            return {"manifest": number}
        fs, path = self._file(number + 1)
        fs.create_dir(path.rpartition("/")[0])
        with fs.open_output_stream(path + ".part") as f:
            f.write(json.dumps({k: [v.end, v.life, v.size, v.mtime, v.head, v.head_hash] for k, v in now.items()}).encode())
        fs.move(path + ".part", path)
        return {"manifest": number + 1}

    def partitions(self, start: dict, end: dict) -> list[Task]:
        old, new = self._manifest(start["manifest"]), self._manifest(end["manifest"])
        found = []
        for path, f in new.items():
            before = old.get(path)
            begin = before.end if before and before.life == f.life else 0
            found += [Range(path, f.life, begin, f.end, f.end, True)] if f.end > begin else []
        return dealt(found, self.options.range_bytes)

    def read(self, partition: Task) -> Iterator[pa.RecordBatch]:
        return read_task(partition)

    def commit(self, end: dict) -> None:
        """Manifests long before the committed one aren't needed any more."""
        for number in self._numbers():
            if number < end["manifest"] - 10:
                fs, path = self._file(number)
                fs.delete_file(path)


class LogRanges(DataSource):
    """Options: path, pattern (*.jsonl), rangeBytes, and state for a stream."""

    @classmethod
    def name(cls) -> str:
        return "logranges"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> LogStream:
        return LogStream(self.options)


def _registered(spark: SparkSession) -> None:
    """The source under its name; sessions of one application may share the registration."""
    try:
        spark.dataSource.register(LogRanges)
    except AnalysisException as found:
        if found.getCondition() != "DATA_SOURCE_ALREADY_EXISTS":
            raise


def read_lines(spark: SparkSession, root: str, pattern: str = "*.jsonl", range_bytes: int = RANGE_BYTES):
    """All complete lines below a root now, several tasks to a large file."""
    _registered(spark)
    return spark.read.format("logranges").option("path", root).option("pattern", pattern).option("rangeBytes", range_bytes).load()


def tail_lines(spark: SparkSession, root: str, state: str, pattern: str = "*.jsonl", range_bytes: int = RANGE_BYTES):
    """A stream of the complete lines below a root, of those that exist and those to come."""
    _registered(spark)
    return spark.readStream.format("logranges").option("path", root).option("pattern", pattern).option("rangeBytes", range_bytes).option("state", state).load()
