"""Best-fit packing of token sequences in bulk-synchronous rounds.

Pieces are range-sorted by length, longest first, and numbered by Spark; gaps are sorted likewise. A round sweeps the
lengths once: every length finds its successor, the smallest gap that holds it; where more pieces want a gap than there
are such gaps, the ones of lower rank get it and the others go on to the next successor; a length that a gap updated in
this round fits better waits, and with it what ranks below it. Then the gaps are updated and the next round begins. Pieces of one length are interchangeable and so are equal gaps, so the state of the
sweeps is one count for each length and gap (at most `capacity` of each, whatever the input), kept as runs of ranks
and runs of sequence numbers; every piece then reads its place from its own rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.bpe import codec, default_vocabulary
from ledgerloom.llm.common import materialise, number_rows, small_batches

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece: a document's ids and end_id, cut into pieces of `capacity` only if longer, where the first piece takes the rest.

    A null or empty text is the end id alone. Rows without an id and repeated rows each have their own pieces. An empty
    table gives an empty result; other columns are ignored, whatever their names.
    """
    path = vocabulary or default_vocabulary()
    small_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            out: list[tuple] = []
            for key, ids in zip(batch.column(0).to_pylist(), tool.encode_batch([t or "" for t in batch.column(1).to_pylist()])):
                ids += end
                total = len(ids) // 4
                first = total % capacity or capacity
                cuts = [0, *range(first, total + 1, capacity)] if total > capacity else [0, total]
                out += [(key, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        tool.cache.clear()  # a worker that goes on to other work keeps nothing of this

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, PIECE_SCHEMA)


def best_fit_rounds(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """counts of pieces by length -> runs (first rank, pieces, length, first sequence, pieces a sequence, offset), ranks from the longest piece on."""
    lengths = sorted((n for n in counts if counts[n]), reverse=True)
    left, rank, at = {}, {}, 0
    for n in lengths:
        left[n], rank[n] = counts[n], at
        at += counts[n]
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, sequences)
    runs: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0
    while lengths:
        sizes = sorted(gaps)
        updated: list[int] = []
        moved: list[tuple[int, int, int]] = []
        for n in lengths:
            k, wait = bisect_left(sizes, n), False
            while left[n]:
                while k < len(sizes) and not gaps[sizes[k]]:
                    k += 1
                next_round = bisect_left(updated, n)
                if next_round < len(updated) and (k == len(sizes) or updated[next_round] < sizes[k]):
                    wait = True  # a gap that this round has updated fits better
                    break
                if k == len(sizes):
                    fresh = -(-left[n] // (capacity // n))
                    gaps[capacity] = [(sequences, fresh)]
                    sequences += fresh
                    sizes.append(capacity)
                gap = sizes[k]
                each = gap // n
                first, many = gaps[gap].pop()
                full = min(many, left[n] // each)
                for take, used in ((full * each, full), (left[n] % each, 1)) if full < many else ((full * each, full),):
                    if take:
                        runs.append((rank[n], take, n, first, each, capacity - gap))
                        rest = gap - min(take, each) * n
                        moved.append((rest, first, used))
                        if rest:
                            insort(updated, rest)
                        left[n], rank[n], first, many = left[n] - take, rank[n] + take, first + used, many - used
                if many:
                    gaps[gap].append((first, many))
            if wait:
                break
        gaps = {g: r for g, r in gaps.items() if r}
        for gap, first, many in moved:
            if gap:
                gaps.setdefault(gap, []).append((first, many))
        lengths = [n for n in lengths if left[n]]
    return sorted(runs)


def best_fit_pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """pieces (PIECE_SCHEMA, lengths 1 to capacity) with sequence_id and offset. Ties are broken by doc_id, piece and start; equal rows are interchangeable. An empty table gives an empty result."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError("a piece is empty or longer than a sequence")
    runs = np.array(best_fit_rounds(counts, capacity) or np.zeros((0, 6)), dtype=np.int64)
    ranked = number_rows(pieces.withColumn("_shorter", -F.col("length")), ["_shorter", "doc_id", "piece", "start"], name="_rank", label="pieces").drop("_shorter")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rank = batch.column(5).to_numpy()
                run = runs[np.searchsorted(runs[:, 0], rank, "right") - 1]
                inside = rank - run[:, 0]
                held = [pa.array(run[:, 3] + inside // run[:, 4]), pa.array(run[:, 5] + inside % run[:, 4] * run[:, 2])]
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], *held], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "_rank").mapInArrow(place, PIECE_SCHEMA + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, **columns: str) -> DataFrame:
    """Every document's pieces with their places.

    A null or empty text is one piece, the end id alone; a long text has as many pieces as it needs. Rows without an id
    and repeated rows each have their own pieces. An empty table gives an empty result; other columns are ignored.
    """
    return best_fit_pack(materialise(token_pieces(docs, capacity, end_id, **columns), "token-pieces"), capacity)
