"""Repeated byte strings by a radix sort of suffixes that ends at a given depth.

Every suffix is put in order by its first `depth` bytes only, most significant digits first: a pass puts suffixes that
agree so far into groups, groups of one leave, and at the full depth the groups of equal suffixes are the repeated
windows. Suffixes that start close together are carried as one row for as long as they stay in one group: a window's
anchor is its least hash of `FIRST` bytes, so equal windows have their anchor in the same place, and a row stands for
the run of windows of an anchor. The first digit is the anchor's bytes, at which nearly all runs leave. If all bytes of
two runs agree, the later one is repeated as a whole. What is still open is parted into cells of eight windows (the
bytes that they share are the second digit) and then into single windows (the last).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialise, partitions, scratch_root, small_batches
from ledgerloom.llm.fingerprints import as_longs, bit_map, column_bytes, in_map, mixed, polynomial

#: Bytes of the first digit, and windows of a cell in each later pass.
FIRST, CELLS = 40, (8, 1)
#: Windows are worked on so many at a time, however long a text is.
SEGMENT = 2 << 20
_HASH_BITS = np.uint64(40)
_RUNS = "core long, whole long, doc long, key binary, span long"


class Runs:
    """Windows of `depth` bytes of some texts that lie one after another in `data`, and their anchors."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int) -> None:
        """starts, ends: of each text; a text without a whole window has no runs."""
        self.data, self.depth = data, depth
        poly = polynomial(21)
        self.prefix = (poly, poly.prefixes(data))
        count = len(data) - FIRST + 1
        self.second = None
        if count < 1 or not len(starts):
            self.first = self.many = self.anchor = np.zeros(0, np.int64)
            return
        hashes = mixed(poly.runs(self.prefix[1], slice(0, count), slice(FIRST, count + FIRST)))
        # a hash's upper bits and the place: the least is the leftmost of the least hashes
        least = (hashes & ~np.uint64((1 << 24) - 1)) | np.arange(count, dtype=np.uint64)
        span = self.depth - FIRST + 1
        width = 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if span > width:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        windows = np.zeros(len(data) + 1, np.int8)
        some = ends - starts >= depth
        np.add.at(windows, starts[some], 1)
        np.add.at(windows, ends[some] - depth + 1, -1)
        at = np.flatnonzero(np.cumsum(windows[:-1], dtype=np.int8))
        anchors = (least[at] & np.uint64((1 << 24) - 1)).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (anchors[1:] != anchors[:-1])
        edges = np.flatnonzero(new)
        self.first, self.anchor, self.many = at[edges], anchors[edges], np.diff(np.append(edges, len(at)))

    def core(self, first: np.ndarray, ends: np.ndarray, place: np.ndarray) -> np.ndarray:
        poly, prefix = self.prefix
        return mixed(mixed(poly.runs(prefix, first, ends)) + place.astype(np.uint64))

    def anchor_digit(self) -> np.ndarray:
        return self.core(self.anchor, self.anchor + FIRST, np.zeros(len(self.anchor), np.int64))

    def whole(self, first: np.ndarray, many: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Of all bytes of a run and where its anchor stands in it, independent of the digits."""
        if self.second is None:
            poly = polynomial(22)
            self.second = (poly, poly.prefixes(self.data))
        poly, prefix = self.second
        return mixed(mixed(poly.runs(prefix, first, first + many - 1 + self.depth)) + (anchor - first).astype(np.uint64) * np.uint64(257) + many.astype(np.uint64))

    def cells(self, first: np.ndarray, many: np.ndarray, anchor: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
        """index of the run, first, many, core of its parts: cells of `size` windows by their distance from the anchor."""
        high, low = (anchor - first) // size, (anchor - (first + many - 1)) // size
        each = high - low + 1
        run = np.repeat(np.arange(len(first)), each)
        cell = high[run] - (np.arange(len(run)) - np.repeat(np.cumsum(each) - each, each))
        begin = np.maximum(first[run], anchor[run] - cell * size - size + 1)
        end = np.minimum(first[run] + many[run] - 1, anchor[run] - cell * size)
        shared = anchor[run] - cell * size
        return run, begin, end - begin + 1, self.core(shared, shared - size + 1 + self.depth, cell)


def _segments(lengths: np.ndarray, depth: int, most: int = SEGMENT) -> Iterator[tuple[int, int, int]]:
    """(text, from, to): every window of every text is in just one part."""
    for k, n in enumerate(lengths.tolist()):
        if n >= depth:
            for at in range(0, n - depth + 1, most):
                yield k, at, min(n, at + most + depth - 1)


def _loads(batch: pa.RecordBatch, column: int, depth: int, most: int = SEGMENT) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """data, text, shift, length of parts of texts, as many at a time as `most` bytes hold; shift: from a place in data to one in the text."""
    data, offsets = column_bytes(batch.column(column))
    held: list[tuple[int, int, int]] = []
    size = 0

    def load() -> tuple[np.ndarray, ...]:
        lengths = np.array([b - a for _, a, b in held])
        starts = np.cumsum(lengths) - lengths
        return np.concatenate([data[offsets[k] + a : offsets[k] + b] for k, a, b in held]), np.array([k for k, _, _ in held]), np.array([a for _, a, _ in held]) - starts, lengths

    for part in _segments(np.diff(offsets), depth, most):
        if held and size + part[2] - part[1] > most + depth:
            yield load()
            held, size = [], 0
        held.append(part)
        size += part[2] - part[1]
    if held:
        yield load()


def _runs_of(batch: pa.RecordBatch, column: int, depth: int, most: int) -> Iterator[tuple[Runs, np.ndarray, np.ndarray]]:
    """Runs, and for each of its runs the text and the shift."""
    for data, text, shift, lengths in _loads(batch, column, depth, most):
        starts = np.cumsum(lengths) - lengths
        runs = Runs(data, starts, starts + lengths, depth)
        owner = np.searchsorted(starts, runs.first, "right") - 1
        yield runs, text[owner], shift[owner]


def _packed(first: np.ndarray, many: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """A run in one number: where it starts, its windows, and how far on its anchor is (both under 128)."""
    return first << 14 | many << 7 | (anchor - first)


def merged(spans: np.ndarray, depth: int) -> list[tuple[int, int]]:
    """The bytes that runs of windows cover, as maximal stretches (from, to)."""
    spans = np.sort(spans)
    start, end = spans >> 14, np.maximum.accumulate((spans >> 14) + (spans >> 7 & 127) - 1 + depth)
    new = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
    return list(zip(start[new].tolist(), end[np.append(new[1:], len(end)) - 1].tolist()))


def distinct_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """key, doc, text: every text once, under the smallest id of its rows, as a table bucketed by key; joins by key don't move the texts again.

    Copies are put together before the shuffle. The key is half of a SHA-256.
    """
    spark = docs.sparkSession
    rows = docs.select(text_key(F.coalesce(F.col(text), F.lit(""))).alias("key"), F.col(doc_id).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    once = rows.groupBy("key").agg(F.min("doc").alias("doc"), F.first("text").alias("text"))  # a minimum is null only if no row has an id
    name = f"texts_{uuid.uuid4().hex}"
    once.write.format("parquet").option("compression", "zstd").bucketBy(partitions(spark), "key").option("path", f"{scratch_root(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def text_key(text: F.Column) -> F.Column:
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def _all_runs(texts: DataFrame, depth: int, segment: int) -> tuple[DataFrame, int]:
    """Runs whose first digit occurs more than once, after a pass that only counts digits."""
    spark = texts.sparkSession

    def digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for runs, _, _ in _runs_of(batch, 0, depth, segment):
                values, counts = np.unique(runs.anchor_digit(), return_counts=True)
                if len(values):
                    yield pa.RecordBatch.from_arrays([as_longs(values), pa.array(counts.astype(np.int64))], names=["core", "f"])

    counted = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(digits, "core long, f long")
    common = materialise(counted.repartition(partitions(spark), "core").groupBy("core").agg(F.sum("f").alias("f")).filter("f > 1").select("core"), "digits")
    many = common.count()
    shared = spark.sparkContext.broadcast(bit_map(common, "core", many))  # 32 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for runs, text, shift in _runs_of(batch, 2, depth, segment):
                core = runs.anchor_digit()
                at = np.flatnonzero(in_map(shared.value, core))
                if len(at):
                    first, number, anchor = runs.first[at], runs.many[at], runs.anchor[at]
                    yield _rows(batch, text[at], core[at], runs.whole(first, number, anchor), _packed(first + shift[at], number, anchor + shift[at]))

    return texts.select("key", "doc", F.col("text").cast("binary").alias("text")).mapInArrow(run, _RUNS), many


def _rows(batch: pa.RecordBatch, text: np.ndarray, core: np.ndarray, whole: np.ndarray, span: np.ndarray) -> pa.RecordBatch:
    at = pa.array(text)
    return pa.RecordBatch.from_arrays([as_longs(core), as_longs(whole), batch.column(1).take(at), batch.column(0).take(at), pa.array(span)], names=["core", "whole", "doc", "key", "span"])


def _parted(texts: DataFrame, open_runs: DataFrame, size: int, depth: int, segment: int) -> DataFrame:
    """The next pass: cells of the runs that are still open."""
    lists = open_runs.groupBy(F.col("key").alias("_key")).agg(F.collect_list("span").alias("spans"))  # of one text
    wanted = texts.join(lists, texts["key"] == lists["_key"]).select("key", "doc", F.col("text").cast("binary").alias("text"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(2))
            for k in range(batch.num_rows):
                spans = np.sort(batch.column(3)[k].values.to_numpy())
                first, many, anchor = spans >> 14, spans >> 7 & 127, (spans >> 14) + (spans & 127)
                body = data[offsets[k] : offsets[k + 1]]
                for at in range(0, len(spans), segment // 64):
                    a, m, q = (x[at : at + segment // 64] for x in (first, many, anchor))
                    for low in range(int(a[0]) // segment, int(a[-1]) // segment + 1):  # a part of a long text at a time
                        here = a // segment == low
                        if here.any():
                            base = int(a[here][0])
                            part = Runs(body[base : int((a[here] + m[here]).max()) + 2 * depth], np.zeros(0, np.int64), np.zeros(0, np.int64), depth)
                            index, begin, count, core = part.cells(a[here] - base, m[here], q[here] - base, size)
                            near = q[here][index] - base
                            yield _rows(batch, np.full(len(begin), k), core, part.whole(begin, count, near), _packed(begin + base, count, near + base))

    return wanted.mapInArrow(run, _RUNS)


def _settled(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repeated, open) of one pass: runs that stand whole somewhere earlier, and the first of each where another run has the same digit."""
    place = F.struct(F.coalesce("doc", F.lit((1 << 63) - 1)).alias("doc"), "key", "span")  # rows without an id come last
    firsts = runs.groupBy(F.col("core").alias("_core"), F.col("whole").alias("_whole")).agg(F.min(place).alias("p"), F.count(F.lit(1)).alias("f"))
    firsts = materialise(firsts, "firsts")
    again = firsts.filter("f > 1")
    repeated = runs.join(again, (F.col("core") == F.col("_core")) & (F.col("whole") == F.col("_whole"))).filter("key <> p.key or span <> p.span").select("key", "span")
    several = firsts.groupBy(F.col("_core").alias("core")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("core")
    still = firsts.join(several, F.col("_core") == F.col("core")).select("p.key", "p.span")
    return repeated, still


def repeated_runs(texts: DataFrame, depth: int = 100, segment: int = SEGMENT) -> DataFrame:
    """key, span (see _packed) of the runs of windows that start earlier too, of texts (key, doc, text) as distinct_texts gives them."""
    runs = materialise(_all_runs(texts, depth, segment)[0], "runs")
    found = []
    for size in CELLS:
        repeated, still = _settled(runs)
        found.append(repeated)
        runs = materialise(_parted(texts, still, size, depth, segment), "runs")
    # single windows of one digit: all but the first are repeated
    found.append(_settled(runs)[0])
    return materialise(reduce(DataFrame.union, found), "repeated")


def remove_repeats(docs: DataFrame, depth: int = 100, doc_id: str = "doc_id", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: what is left of each text without the bytes that a string of `depth` bytes covers which also starts earlier.

    Earlier: in a row with a smaller id, or further up in the text. Rows without an id come last; rows of one id with
    different texts are ordered by their key; of equal rows one is the first. A null or empty text is empty and a text
    shorter than `depth` stays whole. Texts of any length are worked on in segments. An empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    if not FIRST < depth < FIRST + 127:
        raise ValueError(f"depth must lie between {FIRST} and {FIRST + 127}")
    small_batches(docs.sparkSession)
    texts = distinct_texts(docs, doc_id, text)
    marks = repeated_runs(texts, depth, segment).groupBy(F.col("key").alias("_key")).agg(F.collect_list("span").alias("spans"))  # of one text
    marked = texts.join(marks, texts["key"] == marks["_key"], "left").select("key", "doc", F.col("text").cast("binary").alias("text"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, doc, raw, spans in zip(*(batch.column(c) for c in range(4))):
                body, left = raw.as_py(), hashlib.sha256()
                gone = merged(spans.values.to_numpy(), depth) if spans.is_valid else []
                at = 0
                for start, end in gone:
                    left.update(body[at:start])
                    at = end
                left.update(body[at:])
                out.append((key.as_py(), doc.as_py(), sum(b - a for a, b in gone), len(gone), left.hexdigest()))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["key", "doc", "n_removed", "n_spans", "kept_sha256"])

    first = materialise(marked.mapInArrow(run, "key binary, doc long, n_removed long, n_spans long, kept_sha256 string"), "kept")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("doc_id", text_key(F.col("text")).alias("key"), F.octet_length("text").cast("long").alias("n_bytes")).groupBy("doc_id", "key", "n_bytes").agg(F.count(F.lit(1)).alias("rows"))
    held = rows.join(first, "key")
    # one row of the smallest id keeps what the text's result is; all others are copies of it
    held = held.withColumn("_first", F.col("doc_id").eqNullSafe(F.col("doc"))).select("*", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("_copy"))
    own, all_gone = F.col("_first") & (F.col("_copy") == 1), F.col("n_bytes") >= depth
    return held.select(
        "doc_id",
        "n_bytes",
        F.when(own, F.col("n_removed")).when(all_gone, F.col("n_bytes")).otherwise(0).cast("long").alias("n_removed"),
        F.when(own, F.col("n_spans")).when(all_gone, 1).otherwise(0).cast("long").alias("n_spans"),
        F.when(~own & all_gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
