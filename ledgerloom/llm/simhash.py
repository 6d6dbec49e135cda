"""Near duplicates by SimHash: fingerprints of word shingles, linked by a binary trie joined with itself.

The trie is walked in pairs of nodes: a pair keeps the number of bits in which its two prefixes differ and is given
up as soon as that exceeds the budget. The top of the trie is walked on counts alone: a node of many fingerprints is
parted into its two halves, and so are they, until each leaf is small enough for a task; each pair of leaves within the
budget is one group of a shuffle. The rest is walked inside the tasks, whole frontiers of node pairs at a time. There,
pairs of nodes that are wholly in one component already are given up as well, so a dense cluster is not compared all
against all, and what leaves a task is a forest of its closest links.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialise, small_batches
from ledgerloom.llm.components import connected_components

SEED = 42
NODE_ROWS = 65_536  # fingerprints that a leaf of the dealt trie holds, at most, unless they share DEEPEST bits
DEEPEST = 16
LEAST_LEAVES = 8  # so that few fingerprints are dealt out too; shared by all tries
PAIR_BLOCK = 1 << 18  # fingerprint pairs or node pairs looked at together in a task
LEAF = 64  # a node pair of at most so many fingerprint pairs is compared directly
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _word_blocks(raw: bytes, size: int = 1 << 22) -> Iterator[list[bytes]]:
    start = 0
    while start < len(raw):
        end = min(len(raw), start + size)
        if end < len(raw):
            found = _SPACE.search(raw, end)
            end = found.start() if found else len(raw)
        yield raw[start:end].split()
        start = end


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of the text's word shingles as a signed 64-bit integer; null or without words: 0. Long texts go in blocks."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    ones, total, carry = np.zeros(64, np.int64), 0, []

    def count(hashes: np.ndarray) -> None:
        nonlocal ones
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)

    for block in _word_blocks((text or "").encode("utf-8", "surrogatepass").lower()):
        run = carry + block
        if len(run) >= words:
            joined = b" ".join(run)
            ends = list(accumulate(len(w) + 1 for w in run))
            starts = [0, *ends]
            hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[words - 1 :])], dtype="<u8")
            count(hashes)
            total += len(hashes)
            run = run[len(run) - words + 1 :] if words > 1 else []
        carry = run
    if not total:
        if not carry:
            return 0
        count(np.array([digest(b" ".join(carry), SEED)], dtype="<u8"))
        total = 1
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """doc_id, text_hash, fp (long). Null and empty texts have fingerprint 0; every row has its own output row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t.as_py(), words) for t in batch.column(2)], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made)], names=["doc_id", "text_hash", "fp"])

    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _labels(n: int, x: np.ndarray, y: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Merge the classes of x[i] and y[i]; labels are smallest members."""
    while True:
        a, b = labels[x], labels[y]
        apart = a != b
        if not apart.any():
            return labels
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            down = labels[labels]
            if (down == labels).all():
                break
            labels = down


def _closest(x: np.ndarray, y: np.ndarray, differ: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs x[i], y[i] those of a spanning forest of the fewest differing bits over the classes `labels`, and the classes merged by them."""
    order = np.argsort(differ, kind="stable")
    x, y = x[order], y[order]
    xs, ys = [x[:0]], [y[:0]]
    while True:
        a, b = labels[x], labels[y]
        apart = a != b
        if not apart.any():
            return np.concatenate(xs), np.concatenate(ys), labels
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        best = np.full(len(labels), len(x))
        place = np.arange(len(x))
        np.minimum.at(best, a, place)
        np.minimum.at(best, b, place)
        pick = np.unique(best[best < len(x)])
        xs.append(x[pick])
        ys.append(y[pick])
        labels = _labels(len(labels), x[pick], y[pick], labels)


def trie_links(keys: np.ndarray, split: int | None, prefix_bits: int = 64, prefix_budget: int = 3, budget: int = 3, checks: np.ndarray | None = None, labels: np.ndarray | None = None, every: bool = False, sift: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of linked keys (uint64): of keys[:split] with keys[split:], each part sorted, or of all with each other (split None).

    Two are linked if at most prefix_budget of their first prefix_bits bits differ and at most budget of all bits, those
    of `checks` included where given. What is returned is a spanning forest of the closest links, over the classes
    `labels` (default: each key its own); or with `every` all links between different classes that `sift` lets through.
    """
    own = split is None
    left, b = (keys, keys) if own else (keys[:split], keys[split:])
    shift = 0 if own else split
    none = np.zeros(0, np.int64)
    if not len(left) or not len(b):
        return none, none
    labels = np.arange(len(keys)) if labels is None else labels
    turns = np.concatenate([[0], np.cumsum(labels[1:] != labels[:-1])])  # number of label changes before each place
    ones: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    xs, ys = [none], [none]

    def bits(values: np.ndarray, t: int) -> np.ndarray:
        return np.concatenate([[0], np.cumsum((values >> np.uint64(63 - t)) & np.uint64(1), dtype=np.int64)])

    stack = [(0, *(np.array([v]) for v in (0, len(left), 0, len(b), 0)))]
    while stack:
        t, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > PAIR_BLOCK:
            half = len(alo) // 2
            stack += [(t, *(v[:half] for v in (alo, ahi, blo, bhi, err))), (t, *(v[half:] for v in (alo, ahi, blo, bhi, err)))]
            continue
        joined = (turns[ahi - 1] == turns[alo]) & (turns[bhi - 1 + shift] == turns[blo + shift]) & (labels[alo] == labels[blo + shift])
        small = ((ahi - alo) * (bhi - blo) <= LEAF) | (t == prefix_bits)
        ripe = small & ~joined
        if ripe.any():
            for x, y, differ in _compare(keys, shift, alo[ripe], ahi[ripe], blo[ripe], bhi[ripe], own, prefix_bits, prefix_budget, budget, checks):
                if every:
                    apart = labels[x] != labels[y]
                    x, y = x[apart], y[apart]
                    good = sift(x, y) if sift else slice(None)
                    xs.append(x[good])
                    ys.append(y[good])
                elif len(x):
                    x, y, labels = _closest(x, y, differ, labels)
                    xs.append(x)
                    ys.append(y)
            if not every:
                turns = np.concatenate([[0], np.cumsum(labels[1:] != labels[:-1])])
        more = ~small & ~joined
        if not more.any():
            continue
        alo, ahi, blo, bhi, err = (v[more] for v in (alo, ahi, blo, bhi, err))
        if t not in ones:
            ones[t] = (bits(left, t), bits(b, t))
        ca, cb = ones[t]
        amid, bmid = ahi - (ca[ahi] - ca[alo]), bhi - (cb[bhi] - cb[blo])
        same = (alo == blo) & (ahi == bhi) & own
        parts = [(alo, amid, blo, bmid, err, ...), (amid, ahi, bmid, bhi, err, ...), (alo, amid, bmid, bhi, err + 1, ...), (amid, ahi, blo, bmid, err + 1, ~same)]
        found = []
        for al, ah, bl, bh, e, keep in parts:
            good = (al < ah) & (bl < bh) & (e <= prefix_budget)
            if keep is not ...:
                good &= keep
            found.append([v[good] for v in (al, ah, bl, bh, e)])
        stack.append((t + 1, *(np.concatenate(v) for v in zip(*found))))
    return np.concatenate(xs), np.concatenate(ys)


def _compare(keys, shift, alo, ahi, blo, bhi, own, prefix_bits, prefix_budget, budget, checks):
    """Places of the linked keys in pairs of ranges and the bits in which they differ, compared directly in blocks of bounded size."""
    na, nb = ahi - alo, bhi - blo
    size = np.cumsum(na * nb)
    cuts = [0, *np.searchsorted(size, np.arange(PAIR_BLOCK, int(size[-1]), PAIR_BLOCK), "right").tolist(), len(na)]
    for lo, hi in zip(cuts, cuts[1:]):
        if lo == hi:
            continue
        rows_of = np.repeat(np.arange(lo, hi), na[lo:hi])
        before = np.repeat(np.cumsum(na[lo:hi]) - na[lo:hi], na[lo:hi])
        i = np.arange(len(rows_of)) - before + alo[rows_of]
        # a pair of ranges can be large where the prefix ends before its values do: then rows go in blocks
        step = max(1, PAIR_BLOCK // max(1, int(nb[lo:hi].max())))
        for at in range(0, len(i), step) if len(i) * int(nb[lo:hi].max()) > 4 * PAIR_BLOCK else [0]:
            part = slice(at, at + step) if len(i) * int(nb[lo:hi].max()) > 4 * PAIR_BLOCK else slice(None)
            ii, wide, base = i[part], nb[rows_of[part]], blo[rows_of[part]] + shift
            ends = np.cumsum(wide)
            j = np.arange(int(ends[-1])) + np.repeat(base - (ends - wide), wide)
            both = np.repeat(keys[ii], wide) ^ keys[j]
            hit = np.bitwise_count(both >> np.uint64(64 - prefix_bits)) <= prefix_budget
            at_hit = np.flatnonzero(hit)
            x, y = ii[np.searchsorted(ends, at_hit, "right")], j[at_hit]
            differ = np.bitwise_count(both[at_hit]).astype(np.int64)
            if checks is not None:
                differ += np.bitwise_count(checks[x] ^ checks[y])
            good = differ <= budget
            if own:
                good &= x < y
            yield x[good], y[good], differ[good]


def trie_leaves(counts: dict[int, int], depth: int, least: int = LEAST_LEAVES) -> list[tuple[int, int]]:
    """Leaves (prefix, bits) of the trie over prefixes of `depth` bits: a node is parted while it holds more than NODE_ROWS or there are few leaves."""
    per_node = max(1, min(NODE_ROWS, sum(counts.values()) // least))
    nodes, leaves = [(0, 0, sorted(counts.items()))], []
    while nodes:
        prefix, bits, held = nodes.pop()
        if not held:
            continue
        if bits == depth or sum(n for _, n in held) <= per_node:
            leaves += [(prefix, bits)]
            continue
        for bit in (0, 1):
            nodes.append((prefix * 2 + bit, bits + 1, [(p, n) for p, n in held if p >> (depth - bits - 1) & 1 == bit]))
    return sorted(leaves, key=lambda v: v[0] << (depth - v[1]))


def leaf_pairs(leaves: list[tuple[int, int]], budget: int) -> list[tuple[int, int]]:
    """Pairs of leaves whose common prefix lengths differ in at most `budget` bits, each with itself too."""
    prefix, bits = (np.array(v, np.int64) for v in zip(*leaves))
    out = []
    for i in range(len(leaves)):
        common = np.minimum(bits[i], bits[i:])
        differ = (prefix[i] >> (bits[i] - common)) ^ (prefix[i:] >> (bits[i:] - common))
        out += [(i, int(j)) for j in i + np.flatnonzero(np.bitwise_count(differ) <= budget)]
    return out


def linked_rows(entries: DataFrame, prefix_bits: int, prefix_budget: int, budget: int, every: bool = False, sift: Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Links (u, v) of the rows of entries (trie int, key long, check long, id long, and label long if classes are given), each trie by itself.

    Two ids are linked as in trie_links, the key's bits first. A forest of each pair of leaves, so all forests together
    connect what the links connect; or with `every` all links between different labels. There, `sift` may choose among
    the links of a trie by a column sketch (array of long, one length) that entries then have: it gets the trie, the
    sketches of a block (unsigned) and the places there of each link's two ends.
    """
    spark = entries.sparkSession
    tries = {r["trie"]: r["n"] for r in entries.groupBy("trie").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a trie
    if not tries:
        return spark.createDataFrame([], "u long, v long")
    depth = max(4, min(DEEPEST, int(np.ceil(np.log2(max(tries.values()) / NODE_ROWS + 1))) + 4))
    top = F.shiftrightunsigned("key", 64 - depth)
    held: dict[int, dict[int, int]] = {}
    for r in entries.groupBy("trie", top.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect():  # at most 2^depth rows a trie
        held.setdefault(r["trie"], {})[r["p"]] = r["n"]
    starts, first_leaf, met, trie_of = {}, 0, [], []
    for k, counts in sorted(held.items()):
        leaves = trie_leaves(counts, depth, max(2, LEAST_LEAVES // len(held)))  # several tries are dealt out together
        starts[k] = np.array([p << (depth - b) for p, b in leaves]), first_leaf
        for i, j in leaf_pairs(leaves, prefix_budget):
            met += [(first_leaf + i, len(trie_of), 0), (first_leaf + j, len(trie_of), 1)][: 1 + (i != j)]
            trie_of.append(k)
        first_leaf += len(leaves)
    names = ["key", "check", "id", *(c for c in ("label", "sketch") if c in entries.columns)]
    words = entries.select(F.size("sketch")).first()[0] if "sketch" in names else 1
    order = np.dtype([(c, "<u8" if c in ("key", "check", "sketch") else "<i8", *([(words,)] if c == "sketch" else [])) for c in names])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each leaf that a task holds: its entries in a string of bytes."""

        def rows(tables: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie = np.concatenate([t.column(0).to_numpy() for t in tables])
            made = np.zeros(len(trie), order)
            for k, name in enumerate(names, 1):
                flat = [t.column(k).flatten() if name == "sketch" else t.column(k) for t in tables]
                made[name] = np.concatenate([c.to_numpy(zero_copy_only=False) for c in flat]).view("<u8" if name in ("key", "check", "sketch") else "<i8").reshape(made[name].shape)
            leaf = np.zeros(len(trie), np.int64)
            for k in np.unique(trie):
                own = trie == k
                low, first = starts[k]
                leaf[own] = first + np.searchsorted(low, (made["key"][own] >> np.uint64(64 - depth)).astype(np.int64), "right") - 1
            by = np.argsort(leaf, kind="stable")
            cut = np.flatnonzero(np.diff(leaf[by], prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array(leaf[by][cut]), pa.array([v.tobytes() for v in np.split(made[by], cut[1:])], pa.binary())], names=["leaf", "packed"])

        kept, n = [], 0
        for batch in batches:
            if batch.num_rows:
                kept.append(batch)
                n += batch.num_rows
            if n >= 1 << 18:
                yield from rows(kept)
                kept, n = [], 0
        if n:
            yield from rows(kept)

    def links(block: pa.Table) -> pa.Table:
        side = block.column("side").to_numpy()
        parts = []
        for k in (0, 1):
            raw = [v for v, s in zip(block.column("packed").to_pylist(), side) if s == k]
            parts.append(np.sort(np.frombuffer(b"".join(raw), order), order=("key", "id")))
        one = np.concatenate(parts)
        labels = None
        if "label" in names:
            # labels are smallest places, so that a merged class keeps its smallest
            _, first, labels = np.unique(one["label"], return_index=True, return_inverse=True)
            labels = first[labels]
        trie = trie_of[block.column("pair")[0].as_py()]
        chosen = (lambda x, y: sift(trie, one["sketch"], x, y)) if sift else None
        i, j = trie_links(np.ascontiguousarray(one["key"]), len(parts[0]) if len(parts[1]) else None, prefix_bits, prefix_budget, budget, np.ascontiguousarray(one["check"]), labels, every, chosen)
        u, v = one["id"][i], one["id"][j]
        apart = u != v
        return pa.table({"u": pa.array(u[apart]), "v": pa.array(v[apart])})

    pairs = spark.createDataFrame(met, "leaf long, pair int, side int")  # bounded by the leaves, which are at most 2^depth a trie
    dealt = entries.select("trie", *names).mapInArrow(packed, "leaf long, packed binary")
    return dealt.join(F.broadcast(pairs), "leaf").select("pair", "side", "packed").groupBy("pair").applyInArrow(links, "u long, v long")


def fingerprint_links(distinct: DataFrame, budget: int) -> DataFrame:
    """Links (u, v) that connect exactly the fingerprints (column fp, distinct) with at most `budget` differing bits, directly or in turn. One trie over all 64 bits."""
    if not 0 <= budget <= 64:
        raise ValueError("budget must be 0 to 64")
    entries = distinct.select(F.lit(0).alias("trie"), F.col("fp").alias("key"), F.lit(0).cast("long").alias("check"), F.col("fp").alias("id"))
    return linked_rows(entries, 64, budget, budget)


def near_duplicate_groups(marked: DataFrame, budget: int = 3) -> DataFrame:
    """marked (doc_id, fp, ...) with component_id: the smallest doc_id that links of at most `budget` bits reach.

    A row with a null doc_id links like any other and takes its component's id, which is null only where no row of the
    component has an id. Repeated rows each keep a row. An empty table gives an empty result.
    """
    first = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "simhash-distinct")
    root = connected_components(fingerprint_links(first, budget))
    first = first.join(root, first.fp == root.node, "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    first = materialise(first, "simhash-roots")
    # tables of their own on both sides of a join, so that the rows of a large component or fingerprint can be split
    least = materialise(first.groupBy("root").agg(F.min("doc_id").alias("component_id")), "simhash-components")
    named = materialise(first.join(least, "root").select("fp", "component_id"), "simhash-named")
    return marked.join(named, "fp")


def simhash_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, budget: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row.

    A null, empty or blank text has fingerprint zero and links like any other; a text of fewer words than a shingle is
    one shingle; a long text goes in blocks. Repeated rows each keep a row, and so do rows without an id, which link
    too. An empty table gives an empty result. Other columns of docs are ignored, whatever their names.
    """
    marked = materialise(fingerprints(docs, doc_id, text, words), "simhash")
    found = near_duplicate_groups(marked, budget)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
