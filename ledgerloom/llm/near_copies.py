"""Near copies by SimHash on word shingles, for similarities that one fingerprint of 64 bits can't tell apart.

A text has several independent fingerprints over its set of shingles. Each half of each leads a trie that is joined
with itself (see simhash); two texts are candidates if one of the halves differs in few bits, and its whole fingerprint
and the next one in no more than similar texts do. Over all bits of all fingerprints a pair is then a sure copy, none,
or one for the shingles themselves to decide: copies have a Jaccard similarity of at least that asked for. Texts with
the same set of shingles are one class, compared once.

First the tries give a forest of the closest candidates. Where all of its links hold, its classes are one group. Only
among classes that a failed link keeps apart are all candidates of different groups compared. There, a task that finds
two of them first counts the bits in which the parities of their shingles differ: never more than the shingles that one
of them lacks. Texts that are too far apart for copies by that, most of those just less similar, don't become a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import accumulate
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialise, small_batches
from ledgerloom.llm.components import connected_components, joined_components
from ledgerloom.llm.simhash import SEED, _word_blocks, linked_rows

FINGERPRINTS = 8
#: A half of 32 bits may differ in 3: at a similarity of 0.8 one bit in 6.6 differs, so one of the 16 halves does so in 993 cases of 1000; at 0.85 in 9999 of 10000.
HALF_BUDGET = 3
#: Of the 128 bits of two fingerprints about 19 differ at a similarity of 0.8; so many are 3.6 standard deviations more.
BUDGET = 34
#: Of all 512 bits 77 differ at a similarity of 0.8, give or take 8: four standard deviations less are a copy for sure (1 in 30,000 such pairs is less similar), three more are none (of measured pairs of 0.80 to 0.805, 999 of 1000 have fewer).
SURE, FAR = 45, 100
#: Where groups stay apart, closer candidates are compared first: what they join needs no more comparing.
STEPS = (85, FAR)
#: Bits of a text's parities: twice its shingles, so that pairs of a similarity up to 0.75 are told apart; by the longest but a few texts, in these limits.
LEAST_PARITIES, MOST_PARITIES = 512, 1 << 14
SIFT_BLOCK = 1 << 14  # pairs whose parities are looked at together in a task
_LANES = np.array([sum(1 << 8 * b for b in range(8) if v >> b & 1) for v in range(256)], np.uint64)  # a byte's bits, a lane of 8 bits each


def shingle_hashes(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; of a shorter text, the one of all its words; none without words. Long texts go in blocks."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    found, carry = [], []
    for block in _word_blocks((text or "").encode("utf-8", "surrogatepass").lower()):
        run = carry + block
        if len(run) >= words:
            joined = b" ".join(run)
            ends = list(accumulate(len(w) + 1 for w in run))
            found.append(np.unique(np.array([digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[words - 1 :])], dtype="<u8")))
            run = run[len(run) - words + 1 :] if words > 1 else []
        carry = run
    if not found:
        return np.array([digest(b" ".join(carry), SEED)] if carry else [], dtype="<u8")
    return np.unique(np.concatenate(found)) if len(found) > 1 else found[0]


def sketch(hashes: np.ndarray) -> list[int]:
    """FINGERPRINTS independent SimHashes of a set of hashes: a bit is 1 if set in over half of the mixed hashes. Bits are counted in lanes of 8 bits, 255 hashes at a time."""
    ones = np.zeros(64 * FINGERPRINTS, np.int64)
    steps = np.arange(1, FINGERPRINTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 255 * 32):
        z = hashes[at : at + 255 * 32, None] + steps
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        lanes = _LANES[(z ^ (z >> np.uint64(31))).view(np.uint8).reshape(len(z), -1)]
        for k in range(0, len(z), 255):
            ones += lanes[k : k + 255].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64).tolist()


def signatures(docs: DataFrame, words: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, text_hash, class (of the set of shingles), sketch, shingles (sorted 32-bit hashes, packed) of every row. A text without words has an empty sketch and no shingles; repeated rows and rows without an id have a row each."""
    import xxhash

    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t.as_py(), words) for t in batch.column(3)]
            kinds = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], np.uint64).view(np.int64)
            small = [np.unique((h >> np.uint64(32)).astype("<u4")).tobytes() for h in sets]
            made = pa.array([sketch(h) if len(h) else [] for h in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(kinds), made, pa.array(small, pa.binary())], names=["row", "doc_id", "text_hash", "class", "sketch", "shingles"])

    return rows.mapInArrow(run, "row long, doc_id long, text_hash long, class long, sketch array<long>, shingles binary")


def parities(shingles: np.ndarray, bits: int) -> np.ndarray:
    """Of a set of hashes, dealt by their value to so many bits (a power of two of at least 64): whether each bit has an odd number of them; as unsigned words of 64 bits."""
    return np.packbits(np.bincount(shingles & np.uint32(bits - 1), minlength=bits).astype(np.uint8) & 1, bitorder="little").view("<u8")


def may_be_alike(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Whether sets can have a Jaccard similarity of `least`, by rows of their number of members and their parities.

    Sets of similarity s differ in (1 - s) / (1 + s) of both their members. Each member that one set alone has turns one
    bit, so the bits that differ are at most so many: none that is alike is ever lost.
    """
    differ = np.bitwise_count(x[:, 1:] ^ y[:, 1:]).sum(axis=1, dtype=np.int64)
    one, two = x[:, 0].astype(np.int64), y[:, 0].astype(np.int64)
    return differ * (1 + least) <= (one + two) * (1 - least) + 1e-6  # a share more, for rounded products


def _with_parities(bits: int):
    """Adds to the sketches of rows (class, sketch, shingles) the number of shingles and their parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for own, raw in zip(batch.column(1).to_pylist(), batch.column(2)):
                shingles = np.frombuffer(raw.as_buffer(), "<u4")
                made.append([*own, len(shingles), *parities(shingles, bits).view(np.int64).tolist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], names=["class", "sketch"])

    return run


def _first_met(trie: int, sketch: np.ndarray, x: np.ndarray, y: np.ndarray, above: int, most: int, least: float) -> np.ndarray:
    """Of a trie's links x[i], y[i] those of so many differing bits that no trie before it has, so every pair comes once, and whose parities don't rule out that they are alike."""
    differ = sketch[x, :FINGERPRINTS] ^ sketch[y, :FINGERPRINTS]
    low = np.bitwise_count(differ & np.uint64(0xFFFFFFFF)).astype(np.int64)
    whole = np.bitwise_count(differ).astype(np.int64)
    lead, pair = (whole - low, low), whole + np.roll(whole, -1, axis=1)
    total = whole.sum(axis=1)
    good = (total > above) & (total <= most)
    for t in range(trie):
        good &= ~((lead[t % 2][:, t // 2] <= HALF_BUDGET) & (pair[:, t // 2] <= BUDGET))
    open_ = np.flatnonzero(good)
    for at in range(0, len(open_), SIFT_BLOCK):
        part = open_[at : at + SIFT_BLOCK]
        good[part] = may_be_alike(sketch[x[part], FINGERPRINTS:], sketch[y[part], FINGERPRINTS:], least)
    return good


def _alike(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                one, two = (np.frombuffer(x.as_buffer(), "<u4") for x in (a, b))
                good = least * max(len(one), len(two)) <= min(len(one), len(two))
                if good:
                    both = np.concatenate([one, two])
                    both.sort()
                    met = int((both[1:] == both[:-1]).sum())
                    good = met >= least * (len(both) - met)
                keep.append(good)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(keep, pa.bool_())], names=["u", "v", "alike"])

    return run


def near_copy_places(marked: DataFrame, least: float = 0.8) -> DataFrame:
    """marked (a table of signatures) with place: rows have the same one if links of similarity `least` or more lead from one's class to the other's.

    Texts without words are one class. Rows are told apart by their number, so repeated ones and those without an id have
    a place like any other. An empty table gives an empty result.
    """
    classes = materialise(marked.groupBy("class").agg(F.min("row").alias("row")), "copies-classes")
    of_class = marked.join(classes.select("row"), "row", "left_semi").filter(F.size("sketch") > 0)
    sketches = materialise(of_class.select("class", "sketch"), "copies-sketches")

    def entries(rows: DataFrame) -> DataFrame:
        """Each class once in each trie: half of a fingerprint leads its key, the next fingerprint is its check."""
        one = [F.element_at("sketch", k % FINGERPRINTS + 1) for k in range(FINGERPRINTS + 1)]
        turned = [F.shiftleft(x, 32).bitwiseOR(F.shiftrightunsigned(x, 32)) for x in one]
        tries = [F.struct(F.lit(2 * k + h).alias("trie"), (one, turned)[h][k].alias("key"), one[k + 1].alias("check")) for k in range(FINGERPRINTS) for h in (0, 1)]
        label = ["label", "sketch"] if "label" in rows.columns else []
        return rows.select(F.explode(F.array(*tries)).alias("t"), "class", *label).select("t.trie", "t.key", "t.check", F.col("class").alias("id"), *label)

    def measured(pairs: DataFrame) -> DataFrame:
        """Distinct pairs and the bits in which all their fingerprints differ, as far as they can be copies."""
        pairs = materialise(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "copies-pairs")
        both = pairs.join(sketches.toDF("u", "one"), "u").join(sketches.toDF("v", "two"), "v")
        differ = reduce(add, [F.bit_count(F.element_at("one", k).bitwiseXOR(F.element_at("two", k))) for k in range(1, FINGERPRINTS + 1)])
        return materialise(both.select("u", "v", differ.alias("differ")).filter(F.col("differ") <= FAR), "copies-measured")

    def judged(pairs: DataFrame) -> DataFrame:
        """Pairs with alike, by their shingles."""
        pairs = materialise(pairs.select("u", "v"), "copies-open")
        near = of_class.select("class", "shingles").join(pairs.select("u").union(pairs.select("v")).toDF("class").distinct(), "class", "left_semi")
        near = materialise(near, "copies-shingles")
        both = pairs.join(near.toDF("u", "one"), "u").join(near.toDF("v", "two"), "v").select("u", "v", "one", "two")
        return materialise(both.mapInArrow(_alike(least), "u long, v long, alike boolean"), "copies-judged")

    def apart(pairs: DataFrame, root: DataFrame) -> DataFrame:
        """Pairs of different groups, with these."""
        met = pairs.join(root.toDF("u", "ru"), "u", "left").join(root.toDF("v", "rv"), "v", "left")
        return met.withColumns({"ru": F.coalesce("ru", "u"), "rv": F.coalesce("rv", "v")}).filter("ru <> rv")

    def groups(links: DataFrame, root: DataFrame | None = None) -> DataFrame:
        """Roots of the links, or with them of the groups that there are."""
        return materialise(connected_components(links) if root is None else joined_components(root, links), "copies-roots")

    first = measured(linked_rows(entries(sketches), 32, HALF_BUDGET, BUDGET))
    root = groups(first.filter(F.col("differ") <= SURE).select("u", "v"))
    open_ = judged(apart(first.filter(F.col("differ") > SURE), root))
    root = groups(open_.filter("alike").select("u", "v"), root)

    # groups that a link which didn't hold would have joined: only there can another candidate still do so
    failed = open_.filter("not alike").select("u", "v")
    parted = materialise(apart(failed, root).select("ru", "rv").distinct(), "copies-apart")
    still = materialise(parted.select("ru").union(parted.select("rv")).distinct().toDF("label"), "copies-still")
    held = sketches.join(root.toDF("class", "root"), "class", "left").withColumn("label", F.coalesce("root", "class"))
    held = of_class.select("class", "sketch", "shingles").join(held.join(still, "label", "left_semi").select("class"), "class", "left_semi")
    held = materialise(held, "copies-held")
    size = held.agg(F.percentile_approx(F.length("shingles") / 4, 0.95)).first()[0] or 0
    bits = min(MOST_PARITIES, max(LEAST_PARITIES, 1 << int(2 * size).bit_length()))
    held = materialise(held.mapInArrow(_with_parities(bits), "class long, sketch array<long>"), "copies-parities")
    above = 0
    for most in STEPS:
        grouped = held.join(root.toDF("class", "root"), "class", "left").select("class", "sketch", F.coalesce("root", "class").alias("label"))
        more = linked_rows(entries(materialise(grouped, "copies-grouped")), 32, HALF_BUDGET, BUDGET, every=True, sift=partial(_first_met, above=above, most=most, least=least))
        more = more.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).join(failed, ["u", "v"], "left_anti")
        root, above = groups(judged(more).filter("alike").select("u", "v"), root), most
    places = materialise(classes.select("class").join(root.toDF("class", "root"), "class", "left").select("class", F.coalesce("root", "class").alias("place")), "copies-places")
    return marked.join(places, "class")
