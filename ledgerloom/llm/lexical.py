"""Ranked lexical search, a term at a time with a limited number of accumulators.

One pass over the documents keeps the postings of the query terms, in blocks of documents, and counts what the weights
need. Then every task goes through its blocks. For each query it takes the terms from the rarest on, and every document
of a term's list gets an accumulator, until the bounds of the terms to come can't reach the k-th partial score; from
then on only the documents that have an accumulator are looked up in the lists, and those that can't reach the k-th
score any more leave. The k-th score is carried on from block to block. Only the best of each task meet in a shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialise, small_batches

#: Queries are taken in blocks of so many bytes of text, which bounds what the driver and a task hold of them.
QUERY_BYTES = 8 << 20
#: A block of postings has so many documents at most, or is closed after so many postings.
BLOCK_DOCS, BLOCK_POSTINGS = 4096, 2_000_000
SALTS = 64
#: Term characters are ASCII letters and digits and all beyond ASCII; A-Z become small, all else separates.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_POSTINGS = "n_docs long, n_terms long, terms array<int>, df array<long>, doc_ids array<long>, sizes array<long>, ends binary, places binary, counts binary"


def terms_of(text: str | bytes | None) -> list[bytes]:
    """The text's terms in order, as UTF-8."""
    raw = (text or b"") if not isinstance(text, str) else text.encode("utf-8", "surrogatepass")
    return raw.translate(_FOLD).split()


class _Block:
    """Postings of some documents, gathered and then ordered by term."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.terms, self.places, self.counts = [], [], []

    def add(self, doc_id: int | None, size: int, held: list[tuple[int, int]]) -> None:
        self.terms += [t for t, _ in held]
        self.counts += [c for _, c in held]
        self.places += [len(self.ids)] * len(held)
        self.ids.append(doc_id)
        self.sizes.append(size)

    def batch(self) -> pa.RecordBatch:
        terms, places, counts = np.array(self.terms, np.int32), np.array(self.places, np.int32), np.array(self.counts, np.int64)
        order = np.argsort(terms, kind="stable")
        kept, df = np.unique(terms, return_counts=True)
        columns = [
            pa.array([len(self.ids)], pa.int64()), pa.array([sum(self.sizes)], pa.int64()), pa.array([kept.tolist()], pa.list_(pa.int32())), pa.array([df.tolist()], pa.list_(pa.int64())),
            pa.array([self.ids], pa.list_(pa.int64())), pa.array([self.sizes], pa.list_(pa.int64())), pa.array([np.cumsum(df).astype(np.int64).tobytes()]), pa.array([places[order].tobytes()]), pa.array([counts[order].tobytes()]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["n_docs", "n_terms", "terms", "df", "doc_ids", "sizes", "ends", "places", "counts"])


def postings(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of postings of the terms in `vocabulary`. Documents without any term aren't there; every row is a document of its own, with or without an id."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of queries of QUERY_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, block = shared.value, _Block()
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms_of(raw.as_py())
                if words:
                    block.add(key, len(words), [(known[w], c) for w, c in Counter(words).items() if w in known])
                if len(block.ids) >= BLOCK_DOCS or len(block.terms) >= BLOCK_POSTINGS:
                    yield block.batch()
                    block = _Block()
        if block.ids:
            yield block.batch()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, _POSTINGS)


class Best:
    """The k best (score, id) of a query so far: higher scores first, then smaller ids, rows without an id last."""

    def __init__(self, k: int) -> None:
        self.k, self.floor = k, 0
        self.scores, self.ids, self.missing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        scores, ids, missing = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids]), np.concatenate([self.missing, missing])
        order = np.lexsort((ids, missing, -scores))[: self.k]
        self.scores, self.ids, self.missing = scores[order], ids[order], missing[order]
        self.floor = int(self.scores[-1]) if len(order) == self.k else 0


def accumulate(query: list[tuple[int, int]], lists: dict[int, tuple[np.ndarray, np.ndarray, int]], docs: int, k: int, floor: int, count: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of the documents of one block that may be among the k best.

    query: (term, factor) from the rarest term on; lists: term -> places, gains of one unit of the factor, largest gain.
    floor: a k-th score that is known already. `count` takes how many accumulators were made. A document whose score
    equals the k-th is never given up, as its id decides.
    """
    held = [(factor, *lists[t]) for t, factor in query if t in lists and factor]
    to_come = [0]
    for factor, _, _, most in reversed(held):
        to_come.append(to_come[-1] + factor * most)
    to_come.reverse()
    sums, kth = np.zeros(docs, np.int64), floor
    alive: np.ndarray | None = None
    for j, (factor, places, gains, _) in enumerate(held):
        if alive is None and to_come[j] < (kth := max(kth, _kth(sums, k) if j else 0)):
            alive = np.flatnonzero(sums)
        if alive is None:
            sums[places] += factor * gains
            continue
        kth = max(kth, _kth(sums[alive], k))
        alive = alive[sums[alive] + to_come[j] >= kth]
        if not len(alive):
            break
        at = np.searchsorted(places, alive)
        at[at == len(places)] = 0
        hit = places[at] == alive
        sums[alive[hit]] += factor * gains[at[hit]]
    if alive is None:
        alive = np.flatnonzero(sums)
    if count is not None:
        count.append(len(alive))
    kth = max(floor, _kth(sums[alive], k), 1)
    alive = alive[sums[alive] >= kth]
    return alive, sums[alive]


def _kth(sums: np.ndarray, k: int) -> int:
    return int(np.partition(sums, len(sums) - k)[len(sums) - k]) if len(sums) >= k else 0


def _ranked_tasks(index: DataFrame, queries: list[list[tuple[int, int]]], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """query, doc_id, score, salt: the best of each task for every query."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        best = [Best(k) for _ in asked]
        for batch in batches:
            for row in range(batch.num_rows):
                terms, ids, sizes = (batch.column(c)[row].values for c in (0, 1, 2))
                ends, places, counts = (np.frombuffer(batch.column(c)[row].as_py(), t) for c, t in ((3, np.int64), (4, np.int32), (5, np.int64)))
                norms = np.array([25 + 75 * n * n_docs // n_terms for n in sizes.to_pylist()], np.int64)  # whole numbers of any length
                gains = 1_000_000_000 * counts // (1000 * counts + 8 * norms[places])
                lists, at = {}, 0
                for t, end in zip(terms.to_pylist(), ends.tolist()):
                    lists[t] = (places[at:end], gains[at:end], int(gains[at:end].max()))
                    at = end
                missing = np.array(ids.is_null())
                ids = ids.fill_null(0).to_numpy()
                for query, top in zip(asked, best):
                    found, scores = accumulate(query, lists, len(ids), k, top.floor)
                    if len(found):
                        top.add(scores, ids[found], missing[found])
        salt = TaskContext.get().partitionId() % SALTS
        for q, top in enumerate(best):
            if len(top.scores):
                n = len(top.scores)
                columns = [pa.array([q] * n, pa.int32()), pa.array(top.ids, pa.int64(), mask=top.missing), pa.array(top.scores), pa.array([salt] * n, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["query", "doc_id", "score", "salt"])

    return index.select("terms", "doc_ids", "sizes", "ends", "places", "counts").mapInArrow(run, "query int, doc_id long, score long, salt int")


def _search(docs: DataFrame, texts: list[str | None], k: int, doc_id: str, text: str) -> DataFrame | None:
    """query (its place in `texts`), rank, doc_id, score; None where no query has a term or no document has one."""
    vocabulary: dict[bytes, int] = {}
    asked = [Counter(vocabulary.setdefault(w, len(vocabulary)) for w in terms_of(t)) for t in texts]
    if not vocabulary:
        return None
    index = materialise(postings(docs, vocabulary, doc_id, text), "postings")
    n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not n_docs:
        return None
    each = index.select(F.explode(F.arrays_zip("terms", "df")).alias("t"))
    df = {r["term"]: r["df"] for r in each.groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.df").alias("df")).collect()}  # no more rows than terms asked for
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    queries = [[(t, weight[t] * many) for t, many in sorted(((t, many) for t, many in q.items() if t in df), key=lambda x: (df[x[0]], x[0]))] for q in asked]
    found = _ranked_tasks(index, queries, n_docs, n_terms, k)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for by in (["query", "salt"], ["query"]):  # so that the best of many tasks don't meet in one at once
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
    return found.select("query", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, item_id: str = "item_id", item_text: str = "text", doc_id: str = "doc_id", text: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k highest scores of every item among all documents.

    Items come in blocks of `query_bytes`, each of which is one pass over the documents. A null or empty text has no
    terms: such items have no rows and such documents count nowhere. Each row is an item or a document of its own, also
    where an id is repeated or null; of equal scores smaller ids come first and rows without an id last. Whole texts
    count, however long. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    kind = items.schema[item_id].dataType.simpleString()
    parts: list[DataFrame] = []
    ids: list = []
    texts: list[str | None] = []

    def close() -> None:
        found = _search(docs, texts, k, doc_id, text)
        if found is not None:
            names = spark.createDataFrame([(q, i) for q, i in enumerate(ids)], f"query int, item_id {kind}")
            parts.append(found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))  # of a block of items

    held = 0
    for row in items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).toLocalIterator():
        ids.append(row["i"])
        texts.append(row["t"])
        held += len(row["t"] or "") + 64
        if held >= query_bytes:
            close()
            ids, texts, held = [], [], 0
    if ids:
        close()
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
