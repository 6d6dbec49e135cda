"""Shards of near equal bytes that keep equal texts together: minimax contiguous partition of ordered atomic groups.

The groups are the distinct texts, ordered by a 64-bit hash. The smallest feasible capacity is found by binary search,
each candidate checked greedily over prefix sums. The sums are first those of 65,536 hash ranges; only ranges in which
a greedy cut can fall for some capacity still possible are then resolved, down to single groups, so that what reaches
the driver is bounded by the shards and not by the groups, and the capacity found is still the exact one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialise, number_rows

RANGE_BITS = 16  # of the first level
NEXT_BITS = 8  # of each further one
FETCH_GROUPS = 100_000  # so many single groups may be looked at by the driver


def _greedy(sums: np.ndarray, shards: int, capacity: int) -> list[int] | None:
    """Cut places (indices into sums) if `shards` runs of at most `capacity` hold all, else None; sums starts with 0."""
    at, cuts = 0, []
    for _ in range(shards):
        at = int(np.searchsorted(sums, sums[at] + capacity, "right")) - 1
        cuts.append(at)
    return cuts if at == len(sums) - 1 else None


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """The least capacity for which the groups, in order, fit `shards` runs."""
    sums = np.concatenate([[0], np.cumsum(sizes)])
    low, high = max(int(sizes.max(initial=0)), -(-int(sums[-1]) // shards)), max(1, int(sums[-1]))
    while low < high:
        mid = (low + high) // 2
        if _greedy(sums, shards, mid) is None:
            low = mid + 1
        else:
            high = mid
    return low


def balanced_cuts(sizes: np.ndarray, shards: int, capacity: int) -> list[int]:
    """Cuts for runs of at most `capacity`, each as near to an equal share of what is left as that allows (one large group doesn't leave other shards empty)."""
    sums = np.concatenate([[0], np.cumsum(sizes)])
    latest = [int(sums[-1])]  # the least sum at which the j-th last cut may stand
    for _ in range(shards - 1):
        latest.append(int(sums[np.searchsorted(sums, latest[-1] - capacity, "left")]))
    cuts, at = [], 0
    for j in range(1, shards):
        want = sums[at] + (sums[-1] - sums[at]) / (shards - j + 1)
        low = max(at, int(np.searchsorted(sums, latest[shards - j], "left")))
        high = int(np.searchsorted(sums, sums[at] + capacity, "right")) - 1
        near = int(np.searchsorted(sums, want))
        near = min((k for k in (near - 1, near) if 0 <= k < len(sums)), key=lambda k: abs(sums[k] - want))
        at = min(max(near, low), high)
        cuts.append(at)
    return cuts


def _ranges_of(groups: DataFrame, bits: int) -> DataFrame:
    return groups.groupBy(F.shiftright("key", 64 - bits).alias("prefix")).agg(F.sum("size").alias("size"), F.max("size").alias("most"), F.count(F.lit(1)).alias("n"))


def cut_keys(groups: DataFrame, shards: int) -> tuple[int, list[int | None]]:
    """groups (key, size; keys distinct) -> the smallest feasible capacity and the first key of shards 1, 2, ... (None: no row is that far)."""
    # a segment: (first key, bits of its prefix or 64 for a single group, size, largest group, groups)
    segments = [(r["prefix"] << (64 - RANGE_BITS), RANGE_BITS, r["size"], r["most"], r["n"]) for r in _ranges_of(groups, RANGE_BITS).collect()]
    while True:
        segments.sort()
        sizes = np.array([s[2] for s in segments], dtype=np.int64)
        if not len(sizes):
            return 0, [None] * (shards - 1)
        sums = np.concatenate([[0], np.cumsum(sizes)])
        high = smallest_capacity(sizes, shards)
        low = min(high, max(max(s[3] for s in segments), -(-int(sums[-1]) // shards)))
        near, far, mixed = 0, 0, set()
        for _ in range(shards - 1):
            near = int(sums[np.searchsorted(sums, near + low, "right") - 1])
            far = min(int(sums[-1]), far + high)
            first, last = int(np.searchsorted(sums, near, "right")) - 1, int(np.searchsorted(sums, far, "left"))
            mixed.update(k for k in range(first, min(last, len(segments))) if segments[k][4] > 1 and segments[k][1] < 64)
        if low == high or not mixed:
            break
        chosen = [segments[k] for k in sorted(mixed)]
        spark = groups.sparkSession
        found = []
        for bits in sorted({s[1] for s in chosen}):
            part = [s for s in chosen if s[1] == bits]
            # bounded: at most the segments that the driver holds
            wanted = F.broadcast(spark.createDataFrame([(s[0] >> (64 - bits),) for s in part], "prefix long"))
            inside = groups.withColumn("prefix", F.shiftright("key", 64 - bits)).join(wanted, "prefix", "left_semi")
            if sum(s[4] for s in part) <= FETCH_GROUPS or bits + NEXT_BITS >= 64:
                found += [(r["key"], 64, r["size"], r["size"], 1) for r in inside.select("key", "size").collect()]
            else:
                wider = bits + NEXT_BITS
                found += [(r["prefix"] << (64 - wider), wider, r["size"], r["most"], r["n"]) for r in _ranges_of(inside, wider).collect()]
        segments = [s for k, s in enumerate(segments) if k not in mixed] + found
    capacity = smallest_capacity(sizes, shards)
    cuts = balanced_cuts(sizes, shards, capacity)
    return capacity, [segments[k][0] if k < len(segments) else None for k in cuts]


def shard_by_bytes(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null: the law has no growth rule).

    A null text has no bytes, size 1 and the group and checksum of the empty text. Rows of equal texts share a shard;
    slots number the rows of a shard by doc_id without gaps (null ids first; repeated rows in any order). With fewer
    groups than shards some shards are empty. Long texts count whole; an empty table gives an empty result. Other columns
    are ignored, whatever their names.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.octet_length(content) + 1).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        F.xxhash64(content).alias("key"),
    )
    rows = materialise(rows, "shard-rows")
    groups = materialise(rows.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    _, firsts = cut_keys(groups, shards)
    shard = sum((F.when(F.col("key") >= F.lit(k).cast("long"), 1).otherwise(0) for k in firsts if k is not None), F.lit(0))
    placed = number_rows(rows.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard")), ["doc_id"], group="shard", label="shards")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
