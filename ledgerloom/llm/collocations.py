"""Phrase collocations of each language from Rabin-Karp fingerprints of word n-grams.

The texts are written once as blocks of one language. Prefix polynomials give every n-gram's fingerprint; each task sums
its own, and a shuffle sums the fingerprints of all, each with a pointer to an occurrence and a second, independent
fingerprint. Longer n-grams are made only where the bit map of the frequent shorter ones allows it. Pointers of
frequent fingerprints are then followed to the text. Where the second fingerprints of one fingerprint differ, two
phrases collide: those are counted anew by their texts.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialise, partitions, small_batches
from ledgerloom.llm.fingerprints import as_longs, bit_map, in_map, mixed, polynomial

#: A block is closed at so many bytes; a piece that is longer goes on in another block.
BLOCK_BYTES = 1 << 19
#: A task holds sums of so many fingerprints before it hands them on.
TALLY = 500_000
#: Pointers are broadcast up to so many (24 MB); beyond, they and the blocks meet in a shuffle.
BROADCAST_POINTERS = 1_000_000
#: A pointer is a block's number and a byte in it.
_PLACE_BITS = 26
LONGEST = 4
SALTS = 64
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
_FOLLOWING = re.compile(rb"(?: *[^ ]+){0,%d}" % (LONGEST - 1))
_BLOCKS = "block long, lang string, own long, words binary"


def blocks_of(docs: DataFrame, lang: str = "lang", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Texts with A-Z made small, a line feed after every piece and blanks between words, as blocks of one language; n-grams that start before byte `own` are a block's own, the rest is there to end them."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = defaultdict(list)
        sizes: dict[str, int] = defaultdict(int)
        number = TaskContext.get().partitionId() << 16

        def row(key: str, words: bytes, own: int) -> pa.RecordBatch:
            nonlocal number
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([key]), pa.array([own], pa.int64()), pa.array([words])], names=["block", "lang", "own", "words"])

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                rest = value.as_py().translate(_FOLD)
                while len(rest) > block_bytes:
                    cut = rest.rfind(b"\n", 0, block_bytes) + 1
                    end = cut
                    if not cut:  # one long piece: a word that begins at the cut starts the next block
                        cut = rest.rfind(b" ", 0, block_bytes) + 1 or rest.find(b" ", block_bytes) + 1 or len(rest)
                        after = rest.find(b"\n", cut)
                        end = _FOLLOWING.match(rest, cut, len(rest) if after < 0 else after).end()
                    yield row(key, rest[:end], cut)
                    rest = rest[cut:]
                held[key].append(rest)
                sizes[key] += len(rest) + 1
                if sizes[key] >= block_bytes or sum(sizes.values()) >= 8 * block_bytes:
                    for k in [key] if sizes[key] >= block_bytes else list(held):
                        words = b"\n".join(held.pop(k))
                        sizes.pop(k)
                        yield row(k, words, len(words))
        for k, texts in held.items():
            words = b"\n".join(texts)
            yield row(k, words, len(words))

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, _BLOCKS)


class Words:
    """The words of a block: where they start and end, which of them go on in the same piece, and their fingerprints."""

    def __init__(self, raw: bytes, lang: str, own: int, bits: int = 64) -> None:
        self.raw = raw
        data = np.frombuffer(raw, np.uint8)
        line = data == 10
        inside = np.concatenate([[False], ~(line | (data == 32)), [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        lines = np.concatenate([[0], np.cumsum(line, dtype=np.int32)])
        self.joined = lines[self.starts[1:]] == lines[self.ends[:-1]]  # word j and j + 1 are of one piece
        self.own = int(np.searchsorted(self.starts, own))
        self.mask = np.uint64((1 << bits) - 1)
        self.salt = mixed(np.array([sum(c << 8 * (k % 7) for k, c in enumerate(lang.encode()))], np.uint64))[0]
        self.sums = []
        for seed in (1, 2):
            poly, words = polynomial(seed), polynomial(seed + 10)
            each = mixed(poly.runs(poly.prefixes(data), self.starts, self.ends))
            self.sums.append((words, words.prefixes(each)))

    def grams(self, n: int, at: np.ndarray | None = None) -> np.ndarray:
        """First words of the block's own n-grams (of those in `at`)."""
        last = min(self.own, len(self.starts) - n + 1)
        fits = np.ones(max(0, last), bool)
        for j in range(n - 1):
            fits &= self.joined[j : j + len(fits)]
        return np.flatnonzero(fits) if at is None else at[fits[at]]

    def values(self, n: int, at: np.ndarray, which: int = 0) -> np.ndarray:
        """Fingerprints of the n-grams that start at these words; the second kind is independent of the first."""
        words, prefixes = self.sums[which]
        found = mixed(words.runs(prefixes, at, at + n) + self.salt + np.uint64(n))
        return found & self.mask if which == 0 else found

    def text(self, n: int, at: int) -> str:
        return b" ".join(self.raw[self.starts[at + j] : self.ends[at + j]] for j in range(n)).decode("utf-8", "replace")


class _Tally:
    """Sums by fingerprint, each with a pointer and its second fingerprint; those that disagree with it stand in rows of their own."""

    def __init__(self) -> None:
        self.parts: list[list[np.ndarray]] = []
        self.rows = 0

    def add(self, part: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        self.parts.append(_summed(part))
        self.rows += len(self.parts[-1][0])
        if self.rows > TALLY:
            self._merge()
            if self.rows > TALLY // 2:
                yield from self.close()

    def _merge(self) -> None:
        self.parts = [_summed([np.concatenate(x) for x in zip(*self.parts)])] if self.parts else []
        self.rows = len(self.parts[0][0]) if self.parts else 0

    def close(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        for part in self.parts:
            for k in range(0, len(part[0]), 100_000):
                yield pa.RecordBatch.from_arrays([as_longs(x[k : k + 100_000]) for x in part], names=["fp", "second", "pointer", "f"])
        self.parts, self.rows = [], 0


def _summed(part: list[np.ndarray]) -> list[np.ndarray]:
    """[fingerprint, second, pointer, count] with one row for each fingerprint and second fingerprint."""
    order = np.argsort(part[0], kind="stable")
    fp, second, pointer, count = (x[order] for x in part)
    new = np.ones(len(fp), bool)
    new[1:] = (fp[1:] != fp[:-1]) | (second[1:] != second[:-1])
    at = np.flatnonzero(new)
    return [fp[at], second[at], pointer[at], np.add.reduceat(count, at)] if len(at) else [fp, second, pointer, count]


def _likely(words: Words, n: int, maps: dict[int, np.ndarray]) -> np.ndarray:
    """Starts of n-grams whose parts, as long as a bit map is there for, may all be frequent."""
    at = words.grams(n)
    shorter = max((m for m in maps if m < n), default=0)
    for j in range(n - shorter + 1) if shorter else ():
        at = at[in_map(maps[shorter], words.values(shorter, at + j))]
    return at


def fingerprint_counts(blocks: DataFrame, sizes: tuple[int, ...], maps: dict[int, np.ndarray], least: int, bits: int = 64) -> DataFrame:
    """fp, n, f, pointer, clash of the n-grams of these sizes whose fingerprint occurs at least so often; clash: its second fingerprints differ."""
    shared = blocks.sparkSession.sparkContext.broadcast(maps)  # bit maps of 32 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = {n: _Tally() for n in sizes}

        def named(n: int, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in rows:
                yield r.append_column("n", pa.array(np.full(r.num_rows, n, np.int32)))

        for batch in batches:
            for number, lang, own, raw in zip(*(batch.column(c) for c in range(4))):
                words = Words(raw.as_py(), lang.as_py(), own.as_py(), bits)
                for n in sizes:
                    at = _likely(words, n, shared.value)
                    if len(at):
                        pointer = (np.uint64(number.as_py() << _PLACE_BITS) + words.starts[at].astype(np.uint64)) if len(at) else at
                        yield from named(n, tallies[n].add([words.values(n, at), words.values(n, at, 1), pointer, np.ones(len(at), np.uint64)]))
        for n, tally in tallies.items():
            yield from named(n, tally.close())

    found = blocks.select("block", "lang", "own", "words").mapInArrow(run, "fp long, second long, pointer long, f long, n int")
    # tasks have summed what they could: a shuffle by fingerprint, then one sum
    dealt = found.repartition(partitions(blocks.sparkSession), "fp", "n")
    return dealt.groupBy("fp", "n").agg(F.sum("f").alias("f"), F.first("pointer").alias("pointer"), (F.min("second") != F.max("second")).alias("clash")).filter(F.col("f") >= least)


def follow(blocks: DataFrame, found: DataFrame, count: int) -> DataFrame:
    """lang, n, phrase, f: the pointers' texts."""
    lists = found.select(F.shiftright("pointer", _PLACE_BITS).alias("_block"), F.struct(F.col("pointer").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).alias("at"), "n", "f").alias("p"))
    lists = lists.groupBy("_block").agg(F.collect_list("p").alias("p"))  # of one block's words
    lists = F.broadcast(lists) if count <= BROADCAST_POINTERS else lists
    wanted = blocks.join(lists, blocks["block"] == lists["_block"]).select("lang", "own", "words", "p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, own, raw, lists in zip(*(batch.column(c) for c in range(4))):
                raw, p = raw.as_py(), lists.values.flatten()
                words = Words(raw, lang.as_py(), own.as_py())
                at, n = np.searchsorted(words.starts, p[0].to_numpy()), p[1].to_numpy()
                phrases = [words.text(m, a) for m, a in zip(n.tolist(), at.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(n)), p[1], pa.array(phrases), p[2]], names=["lang", "n", "phrase", "f"])

    return wanted.mapInArrow(run, "lang string, n int, phrase string, f long")


def recount(blocks: DataFrame, wanted: np.ndarray, least: int, bits: int = 64) -> DataFrame:
    """lang, n, phrase, f of the n-grams whose fingerprint may be one of `wanted` (a bit map), counted by their texts."""
    shared = blocks.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, own, raw in zip(*(batch.column(c) for c in range(3))):
                words = Words(raw.as_py(), lang.as_py(), own.as_py(), bits)
                for n in range(1, LONGEST + 1):
                    at = words.grams(n)
                    at = at[in_map(shared.value, words.values(n, at))]
                    for k in range(0, len(at), 50_000):
                        phrases = pa.array([words.text(n, a) for a in at[k : k + 50_000].tolist()])
                        yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(phrases)), pa.array(np.full(len(phrases), n, np.int32)), phrases], names=["lang", "n", "phrase"])

    found = blocks.select("lang", "own", "words").mapInArrow(run, "lang string, n int, phrase string")
    return found.groupBy("lang", "n", "phrase").agg(F.count(F.lit(1)).alias("f")).filter(F.col("f") >= least)


def frequent_phrases(blocks: DataFrame, least: int = 30, bits: int = 64) -> DataFrame:
    """lang, n, phrase, f of all phrases of 1 to 4 words that occur at least so often. `bits` shortens the fingerprints, for tests of collisions."""
    maps: dict[int, np.ndarray] = {}
    found = []
    for sizes in ((1,), (2,), (3, 4)):
        part = materialise(fingerprint_counts(blocks, sizes, dict(maps), least, bits), "frequent")
        found.append(part)
        if len(sizes) == 1:
            maps[sizes[0]] = bit_map(part, "fp", part.count())
    found = reduce(DataFrame.union, found)
    count, clashes = found.agg(F.count(F.lit(1)), F.coalesce(F.count_if("clash"), F.lit(0))).first()
    if not clashes:
        return follow(blocks, found, count)
    clear = follow(blocks, found.filter("not clash"), count)
    anew = recount(blocks, bit_map(found.filter("clash"), "fp", clashes), least, bits)
    return clear.union(anew).dropDuplicates(["lang", "n", "phrase"])  # a bit may stand for a fingerprint without a clash too


def score_phrases(phrases: DataFrame, totals: DataFrame, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score from frequent phrases (lang, n, phrase, f) and words of each language (lang, total)."""
    words = F.split("phrase", " ")
    long = phrases.filter("n > 1").select("lang", "phrase", F.col("n").alias("size"), F.col("f").alias("a"), words.alias("w"))

    def joined(start: F.Column, length: F.Column) -> F.Column:
        return F.array_join(F.slice("w", start, length), " ")

    each = F.col("k")
    cuts = long.select("lang", "phrase", "a", "size", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), each).alias("first"), joined(each + 1, F.col("size") - each).alias("rest"))
    parts = phrases.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("f").alias("_f"))
    for side, name in (("first", "l"), ("rest", "r")):  # every part of a frequent phrase is frequent
        cuts = cuts.join(parts, (F.col("lang") == F.col("_lang")) & (F.col(side) == F.col("_part"))).withColumnRenamed("_f", name).drop("_lang", "_part", side)
    cuts = cuts.withColumn("score", F.expr("cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0)) div cast(l + r as decimal(20,0))"))
    least = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    scored = least.select("lang", "phrase", "a", "m.l", "m.r", "m.score")

    places = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda s: F.array_join(F.slice("w", s, n), " "))))
    inner = long.filter("size > 2").select("lang", F.explode(F.array_distinct(places)).alias("phrase"), "a")
    holder = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(holder, ["lang", "phrase"], "left").filter("longer is null or cast(longer as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * 80").withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    for by in (["lang", "_salt"], ["lang"]):  # a language's phrases don't meet in one task before they are few
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= top)
    return kept.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def word_totals(blocks: DataFrame) -> DataFrame:
    """lang, total: how many words each language has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [raw.as_py()[: own.as_py()] for own, raw in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(re.findall(rb"[^ \n]+", c)) for c in counts], pa.int64())], names=["lang", "total"])

    return blocks.select("lang", "own", "words").mapInArrow(run, "lang string, total long").groupBy("lang").agg(F.sum("total").alias("total"))


def mine_collocations(docs: DataFrame, least: int = 30, top: int = 2000, lang: str = "lang", text: str = "text", bits: int = 64, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each language's first `top` phrases of 2 to 4 words: lang, rank, phrase, a, l, r, n, score.

    A null language is `und`, a null text is empty. Every row counts, repeated ones too, whatever its id. Whole texts
    count: a piece longer than a block goes on in another one, and no phrase is lost there. Equal scores and counts are
    ordered by the phrase's bytes. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    blocks = materialise(blocks_of(docs, lang, text, block_bytes), "blocks")
    small_batches(docs.sparkSession, 4)  # whole blocks
    phrases = materialise(frequent_phrases(blocks, least, bits), "phrases")
    return score_phrases(phrases, materialise(word_totals(blocks), "totals"), top)
