"""Approximate nearest neighbours by randomly rotated one-bit codes.

Every vector is scaled to length 1 and belongs to the nearest of a few centroids; the signs of its rotated residual are
its code, one bit a coordinate, packed into words. A query's rotated coordinates are kept to four bits, as four bit
planes, so an inner product is estimated by counting bits of words; two scalars of the vector correct it. A pair is
computed in full where the estimate and the bound of its error reach the k-th best product that the query has so far.

Vectors lie in blocks of one cell, queries in chunks; a (chunk, block) pair is one group of a shuffle. First each query
meets a block of each of its nearest cells; the k-th best of those is its bound everywhere, and a block that can't
reach the bound (by its centroid, radius and largest length) isn't met at all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ledgerloom.llm.common import materialise
from ledgerloom.llm.search import SAMPLE_ROWS, _matrix, _ranked, _sample, _Top, _usable

BLOCK_ROWS = 4096
CHUNK_QUERIES = 4096
MOST_CELLS = 256
MOST_BLOCKS = 65_536
FIRST_CELLS = 4
CODE_BITS = 256  # at least; a shorter vector is rotated into so many coordinates, which makes its estimates sharper
PLANES = 4
QUERY_PART, PART = 128, 1024  # queries and vectors compared together in a task
FOUND = "query_id long, vec_id long, score double"


def random_rotation(d: int, bits: int, seed: int) -> np.ndarray:
    """d orthonormal rows of `bits` coordinates."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, d)))
    return (q * np.sign(np.diag(r))).T


def _unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors scaled to length 1, and their lengths; no overflow on the way."""
    most = np.abs(v).max(axis=1)
    scaled = v / most[:, None]
    length = np.sqrt((scaled**2).sum(1))
    with np.errstate(over="ignore"):
        return scaled / length[:, None], most * length


def _centroids(sample: np.ndarray, cells: int, rounds: int = 6) -> np.ndarray:
    """Centroids of unit vectors by a few rounds of k-means from evenly chosen rows."""
    unit = _unit(sample)[0]
    centres = unit[np.linspace(0, len(unit) - 1, min(cells, len(unit))).astype(int)]
    for _ in range(rounds):
        near = (unit @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, unit)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def one_bit_index(rows: DataFrame, centres: np.ndarray, rotation: np.ndarray) -> DataFrame:
    """rows (vec_id, v) with length, cell, code (packed signs of the rotated residual of the unit vector), radius (the residual's length) and met (the code's inner product with the residual's direction)."""
    bits = rotation.shape[1]
    kind = rows.schema["v"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                v = _matrix(pa.Table.from_batches([batch]), "v").astype(np.float64)
                unit, length = _unit(v)
                cell = (unit @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
                turned = (unit - centres[cell]) @ rotation
                radius = np.sqrt((turned**2).sum(1))
                met = np.where(radius > 0, np.abs(turned).sum(1) / np.sqrt(bits) / np.where(radius > 0, radius, 1), 1.0)
                code = np.packbits(turned > 0, axis=1, bitorder="little")
                made = [pa.array(length), pa.array(cell.astype(np.int32)), pa.array([b.tobytes() for b in code], pa.binary()), pa.array(radius), pa.array(met)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["vec_id", "v", "length", "cell", "code", "radius", "met"])

    return rows.mapInArrow(run, f"vec_id long, v {kind}, length double, cell int, code binary, radius double, met double")


def _planes(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated queries as lowest value, step and bit planes (queries x planes x words) of the rounded multiples of the step."""
    low = turned.min(1)
    step = (turned.max(1) - low) / (2**PLANES - 1)
    step = np.where(step > 0, step, 1.0)
    level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    planes = [np.packbits((level >> np.uint8(j)) & np.uint8(1), axis=1, bitorder="little").view(np.uint64) for j in range(PLANES)]
    return low, step, np.stack(planes, axis=1)


def _counts(planes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Sums of the queries' levels over the set bits of the codes, by counting bits of words."""
    total = np.zeros((len(planes), len(codes)), np.uint16)
    for j in range(planes.shape[1]):
        for w in range(codes.shape[1]):
            total += np.bitwise_count(planes[:, j, w, None] & codes[None, :, w]).astype(np.uint16) << np.uint16(j)
    return total


def _products(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of x[i] and y[j], in double precision and in order of the coordinates. One that isn't a number (of components beyond 1e150) counts as the least."""
    out = np.zeros(len(i))
    with np.errstate(over="ignore", invalid="ignore"):
        for a, b in zip(x.T, y.T):
            out += a[i] * b[j]
    return np.where(np.isnan(out), -np.inf, out)


def nearest_by_codes(vectors: DataFrame, is_query: Column, k: int = 20, error: float = 2.0, seed: int = 42, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (double): each query's k nearest found by inner product, ties to the smaller id.

    `error` is the number of standard deviations of an estimate that a pair may lie under the bound and still be
    computed in full. Centroids are fitted on at most 2 * SAMPLE_ROWS rows chosen by a hash; all rows are indexed. A
    product whose estimate isn't finite is computed in full, so large components lose nothing.

    Vectors that are null, zero or hold a null or non-finite component, have no id or another length than most, take no
    part. A row repeated under one id counts each time as a candidate and once as a query (of different vectors the smallest asks). An empty table gives an
    empty result; fewer candidates than k give as many rows as there are. Other columns are ignored.
    """
    short = isinstance(getattr(vectors.schema[embedding].dataType, "elementType", None), FloatType)
    rows = materialise(_usable(vectors, vec_id, embedding, "array<float>" if short else "array<double>").filter(F.exists("v", lambda x: x != 0)), "vectors")
    n = rows.count()
    if not n:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    sample = _sample(rows, n)
    sample = sample if len(sample) else np.array([rows.first()["v"]], np.float64)
    d = sample.shape[1]
    centres = _centroids(sample, max(1, min(MOST_CELLS, n // BLOCK_ROWS)))
    bits = -(-max(d, CODE_BITS) // 64) * 64
    rotation = random_rotation(d, bits, seed)
    block_rows = max(BLOCK_ROWS, -(-2 * n // MOST_BLOCKS))
    index = materialise(one_bit_index(rows, centres, rotation), "one-bit-index")
    sizes = {r["cell"]: r["n"] for r in index.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most MOST_CELLS rows
    # a cell of many rows is dealt out in blocks of about block_rows; blocks are numbered through
    parts = np.array([-(-sizes.get(c, 0) // block_rows) for c in range(len(centres))])
    begin = np.concatenate([[0], np.cumsum(parts)])
    place = F.create_map(*[x for c in sizes for x in (F.lit(c), F.array(F.lit(int(begin[c])), F.lit(int(parts[c]))))])
    mine = F.element_at(place, F.col("cell"))
    index = index.withColumn("block", (mine[0] + F.pmod(F.xxhash64("vec_id", F.lit(seed)), mine[1])).cast("int"))
    blocks = index.groupBy("block").agg(F.max("radius").alias("radius"), F.max("length").alias("longest"), F.min("length").alias("shortest")).collect()  # at most MOST_BLOCKS rows
    number = np.array([r["block"] for r in blocks])
    cell_of = np.searchsorted(begin, number, "right") - 1
    reach_of = [np.array([r[c] for r in blocks]) for c in ("radius", "longest", "shortest")]
    opening = {c: int(number[cell_of == c].min()) for c in set(cell_of.tolist())}

    # queries of one cell stay together, so that a chunk of them reaches few blocks; a cell of many queries is split
    picked = materialise(index.filter(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "length", "cell")).alias("q")).select("vec_id", "q.*"), "queries")
    asked = {r["cell"]: r["n"] for r in picked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most MOST_CELLS rows
    if not asked:
        return rows.filter("false").select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    chunk, held, spread = 0, 0, {}
    for c in sorted(asked):
        if held and held + asked[c] > CHUNK_QUERIES:
            chunk, held = chunk + 1, 0
        pieces = -(-asked[c] // CHUNK_QUERIES)
        spread[c] = chunk, pieces
        chunk, held = chunk + pieces - 1, held + asked[c] if pieces == 1 else CHUNK_QUERIES
    dealt = F.element_at(F.create_map(*[x for c, p in spread.items() for x in (F.lit(c), F.array(F.lit(p[0]), F.lit(p[1])))]), F.col("cell"))
    queries = picked.withColumn("chunk", (dealt[0] + F.pmod(F.xxhash64("vec_id"), dealt[1])).cast("int"))

    def met(first: bool):
        """Each query with the blocks that it meets: of its nearest cells one each, or all others that can reach its bound."""

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                v, length, least = _matrix(pa.Table.from_batches([batch]), "v").astype(np.float64), batch.column(2).to_numpy(), batch.column(4).to_numpy()
                near = _unit(v)[0] @ centres.T
                usual = np.argsort(-near[:, sorted(opening)], axis=1, kind="stable")[:, :FIRST_CELLS]
                starts = np.array([opening[c] for c in sorted(opening)])[usual]
                for a in range(0, len(v), QUERY_PART):
                    part = slice(a, a + QUERY_PART)
                    own = (starts[part, :, None] == number).any(1)
                    if not first:
                        best = near[part][:, cell_of] + reach_of[0]
                        with np.errstate(over="ignore", invalid="ignore"):
                            most = length[part, None] * np.where(best > 0, best * reach_of[1], best * reach_of[2])
                            own = ~own & ~(most * (1 + np.sign(most) * 1e-9) < least[part, None])
                    i, j = np.nonzero(own)
                    yield pa.RecordBatch.from_arrays([c.take(pa.array(i + a)) for c in batch.columns] + [pa.array(number[j].astype(np.int32))], names=[*batch.schema.names, "block"])

        return run

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            order = np.argsort(right.column("vec_id").to_numpy(), kind="stable")
            ids, c = right.column("vec_id").to_numpy()[order], _matrix(right, "v").astype(np.float64)[order]
            length, radius, met_by = (right.column(x).to_numpy()[order] for x in ("length", "radius", "met"))
            codes = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint64).reshape(len(ids), -1)[order]
            ones = np.bitwise_count(codes).sum(1, dtype=np.int64).astype(np.float32)
            qs, q, size, least = left.column("vec_id").to_numpy(), _matrix(left, "v").astype(np.float64), left.column("length").to_numpy(), left.column("least").to_numpy()
            unit = _unit(q)[0]
            turned = unit @ rotation
            low, step, planes = _planes(turned)
            whole = turned.sum(1)
            base = unit @ centres[int(right.column("cell")[0].as_py())]
            gain = (radius / met_by / np.sqrt(bits)).astype(np.float32)
            doubt = (error * radius * np.sqrt(np.maximum(0, 1 - met_by**2)) / met_by / np.sqrt(max(1, bits - 1)) + 1e-5).astype(np.float32)
            for a in range(0, len(qs), QUERY_PART):
                part = slice(a, min(a + QUERY_PART, len(qs)))
                top = _Top(k, qs[part], least[part])
                for b in range(0, len(ids), PART):
                    near = slice(b, b + PART)
                    sums = _counts(planes[part], codes[near]).astype(np.float32) * (2 * step[part, None]).astype(np.float32)
                    sums += ones[near] * (2 * low[part, None]).astype(np.float32)
                    sums -= whole[part, None].astype(np.float32)
                    sums *= gain[near]
                    sums += base[part, None].astype(np.float32)  # the cosines, estimated
                    with np.errstate(all="ignore"):
                        if np.isneginf(top.least).any() and sums.shape[1] > k + 1:
                            # one place more, since a query's own row doesn't count
                            sure = (sums - doubt[near]) * length[near] * size[part, None]
                            bound = np.maximum(top.least, np.partition(sure, -(k + 1), axis=1)[:, -(k + 1)])
                        else:
                            bound = top.least
                        worth = ~(sums + doubt[near] < (bound / size[part])[:, None] / length[near])  # what isn't a number is computed in full
                    i, j = np.nonzero(worth)
                    top.add(i, ids[near][j], _products(q[part], c[near], i, j))
                out.append(top.table(pa.float64()))
        return pa.concat_tables(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    kind = rows.schema["v"].dataType.simpleString()
    fields = f"vec_id long, v {kind}, length double, chunk int, least double, block int"

    def pairs(asking: DataFrame, first: bool) -> DataFrame:
        left = materialise(asking.select("vec_id", "v", "length", "chunk", "least").mapInArrow(met(first), fields), "met-blocks")
        wanted = materialise(left.select("chunk", "block").distinct(), "met-pairs")  # a row for each chunk and block that meet
        right = index.join(wanted, "block")
        return left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInArrow(compare, FOUND)

    found = materialise(pairs(queries.withColumn("least", F.lit(float("-inf"))), True), "nearest-first")
    best = _ranked(found, k)
    bounds = best.groupBy(F.col("query_id").alias("vec_id")).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).drop("n")
    again = queries.join(bounds, "vec_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    return _ranked(found.union(pairs(again, False)), k)
