"""Exact top-k search of a stated set of query vectors against all vectors by norm-sorted inner products.

Candidates are dealt out in blocks and queries in chunks; a (chunk, block) pair is one group of a shuffle, of bounded
size, and hands on at most k rows a query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialise, number_rows

BLOCK_ROWS = 4096
MOST_BLOCKS = 65_536
CHUNK_QUERIES = 4096
PART = 1024  # queries and candidates compared together in a task
SAMPLE_ROWS = 20_000  # rows from which a rotation or centre is fitted; results don't depend on it
FOUND = "query_id long, vec_id long, score {}"


def _usable(vectors: DataFrame, vec_id: str, embedding: str, kind: str = "array<double>") -> DataFrame:
    """vec_id, v (of the type `kind`) of the rows that take part: an id, no null, NaN or infinite component, and the table's most frequent length (ties: the smaller)."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(kind).alias("v")).filter("vec_id is not null and size(v) > 0").filter(finite)
    usual = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.filter(F.size("v") == (usual["d"] if usual else 0))


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    flat = table.column(column).combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray | pa.LargeListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _sample(rows: DataFrame, n: int) -> np.ndarray:
    """About SAMPLE_ROWS vectors, chosen by a hash of their id."""
    some = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // SAMPLE_ROWS))) == 0) if n > SAMPLE_ROWS else rows
    return np.array([r["v"] for r in some.select("v").limit(2 * SAMPLE_ROWS).collect()], dtype=np.float64)


def _best(k: int, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Places of the k best of each query: highest score, then smallest id."""
    order = np.lexsort((ids, -scores, query))
    q = query[order]
    starts = np.flatnonzero(np.diff(q, prepend=q[0] - 1)) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    return order[rank < k]


class _Top:
    """The k best so far of each of a part's queries."""

    def __init__(self, k: int, query_ids: np.ndarray, least: np.ndarray):
        self.k, self.query_ids, self.least = k, query_ids, least.copy()
        self.q, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float64)

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        good = (self.query_ids[q] != ids) & (scores >= self.least[q])
        q, ids, scores = (np.concatenate([a, b[good]]) for a, b in ((self.q, q), (self.ids, ids), (self.scores, scores)))
        keep = _best(self.k, q, ids, scores)
        self.q, self.ids, self.scores = q[keep], ids[keep], scores[keep]
        full = np.bincount(self.q, minlength=len(self.query_ids)) == self.k
        last = np.full(len(self.query_ids), np.inf)
        np.minimum.at(last, self.q, self.scores)
        self.least = np.where(full, np.maximum(self.least, last), self.least)

    def table(self, kind: pa.DataType) -> pa.Table:
        return pa.table({"query_id": pa.array(self.query_ids[self.q]), "vec_id": pa.array(self.ids), "score": pa.array(self.scores if kind == pa.float64() else np.clip(self.scores, -(2.0**63), 2.0**63 - 1024)).cast(kind)})


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _chunks(queries: DataFrame, n: int) -> tuple[DataFrame, int]:
    chunks = max(1, -(-n // CHUNK_QUERIES))
    return queries.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int")), chunks


def _pair(queries: DataFrame, candidates: DataFrame, run, schema: str) -> DataFrame:
    queries, candidates = queries.toDF(*queries.columns), candidates.toDF(*candidates.columns)  # both may come from one table
    return queries.groupBy("chunk", "block").cogroup(candidates.groupBy("chunk", "block")).applyInArrow(run, schema)


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (long): each query's k highest inner products of floor(scale * x), ties to the smaller id.

    Candidates are sorted by length, longest first. The block of the longest gives each query a first k-th best score;
    a later block meets only the queries for which the product of lengths can reach it. In a block, coordinates are
    rotated by a singular value decomposition, products of the leading ones are summed in steps, and a pair is dropped
    once the sum and the product of the residual lengths (Cauchy-Schwarz) stay below the k-th best. Results are exact
    as long as sums stay below 2^53; a sum beyond 63 bits counts as the largest or smallest number of them.

    Rows with a null id or a null, NaN or infinite component, and of another length than most, take no part. A row
    repeated under one id counts each time as a candidate and once as a query (of different vectors the smallest asks). An empty table, or one without queries,
    gives an empty result; fewer candidates than k give as many rows as there are. Other columns are ignored.
    """
    usable = _usable(vectors, vec_id, embedding)
    whole = usable.select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))
    whole = whole.withColumn("shorter", -F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = number_rows(whole, ["shorter", "vec_id"], name="place", label="norm-sorted")
    rows = materialise(rows, "norm-blocks")
    n = rows.count()
    if not n:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
    block = max(BLOCK_ROWS, -(-n // MOST_BLOCKS))
    rows = rows.withColumn("block", F.floor(F.col("place") / block).cast("int"))
    picked = materialise(rows.filter(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "shorter")).alias("q")).select("vec_id", "q.*"), "queries")
    queries, chunks = _chunks(picked, picked.count())
    some = _sample(rows, n)
    # the right singular vectors, from the d x d matrix of products; the left ones would have a row and column for each vector
    d = len(rows.first()["v"])
    rotation = np.linalg.eigh(some.T @ some)[1][:, ::-1] if len(some) else np.eye(d)
    steps = sorted({max(1, d // 4), max(1, d // 2), max(1, 3 * d // 4)})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("shorter").to_numpy(), kind="stable")
        ids, c, qs = right.column("vec_id").to_numpy()[order], _matrix(right, "v")[order] if right.num_rows else np.zeros((0, d)), left.column("vec_id").to_numpy()
        q, least = _matrix(left, "v") if left.num_rows else np.zeros((0, d)), left.column("least").to_numpy()
        zc, zq = c @ rotation, q @ rotation
        rest = [(np.sqrt((zc[:, h:] ** 2).sum(1)), np.sqrt((zq[:, h:] ** 2).sum(1))) for h in steps]
        length_c, length_q = np.sqrt((c * c).sum(1)), np.sqrt((q * q).sum(1))
        out = []
        for a in range(0, len(qs), PART):
            part = slice(a, a + PART)
            top = _Top(k, qs[part], least[part])
            for b in range(0, len(ids), PART):
                near = slice(b, b + PART)
                slack = 1e-6 * (1 + length_q[part] * length_c[near].max(initial=0.0))
                reach = top.least - slack
                live = np.flatnonzero(length_q[part] * length_c[near].max(initial=0.0) >= reach)
                if not len(live):
                    break  # the candidates that follow are shorter still
                at, reach = np.arange(a, min(a + PART, len(qs)))[live], reach[live, None]
                total, h0, mask = 0.0, 0, None
                for h, (rc, rq) in zip(steps, rest):
                    total = total + zq[at, h0:h] @ zc[near, h0:h].T
                    mask = total + np.outer(rq[at], rc[near]) >= reach
                    h0 = h
                    if mask.mean() < 0.02:
                        break
                if mask.mean() < 0.02:
                    i, j = np.nonzero(mask)
                    scores = np.einsum("ij,ij->i", q[at[i]], c[near][j])
                else:
                    dense = q[at] @ c[near].T
                    i, j = np.nonzero(mask & (dense >= reach))
                    scores = dense[i, j]
                top.add(live[i], ids[near][j], np.rint(scores))
            out.append(top.table(pa.int64()))
        return pa.concat_tables(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})

    candidates = rows.filter("block = 0").select("vec_id", "v", "shorter", "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    longest = queries.withColumns({"block": F.lit(0), "least": F.lit(-math.inf)})
    first = materialise(_pair(longest, candidates, run, FOUND.format("long")), "top-first")
    reached = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).drop("n")
    again = queries.join(reached, "vec_id", "left").withColumn("least", F.coalesce(F.col("least").cast("double"), F.lit(-math.inf)))
    # blocks are sorted by length, so a query reaches the first few: how many, by a search in the lengths of their longest (at most MOST_BLOCKS)
    limits = rows.groupBy("block").agg(F.min("shorter").alias("longest")).orderBy("block").collect()
    shortest_first = np.sqrt([-r["longest"] for r in limits])[::-1]

    def reach(batches):
        for batch in batches:
            length, least = np.sqrt(-batch.column(2).to_numpy()), batch.column(4).to_numpy()
            with np.errstate(divide="ignore", invalid="ignore"):
                needed = np.where(length > 0, (least - 1) / length * (1 - 1e-9), np.where(least > 1, np.inf, -np.inf))
            last = len(shortest_first) - np.searchsorted(shortest_first, needed, "left")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(last.astype(np.int32))], names=[*batch.schema.names, "blocks"])

    told = again.select("vec_id", "v", "shorter", "chunk", "least").mapInArrow(reach, "vec_id long, v array<double>, shorter double, chunk int, least double, blocks int")
    told = materialise(told.filter("blocks > 1"), "top-reach")
    met = told.withColumn("block", F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)))
    # a candidate goes to those chunks only of which a query reaches its block
    wanted = told.groupBy("chunk").agg(F.max("blocks").alias("blocks")).select("chunk", F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)).alias("block"))
    far = rows.filter("block > 0").select("vec_id", "v", "shorter", "block").join(materialise(wanted, "top-chunks"), "block")
    later = _pair(met.drop("blocks"), far, run, FOUND.format("long"))
    return _ranked(first.union(later), k)
