"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary of byte strings. A word's probability is
the sum over all its segmentations into pieces, found by a forward pass; a text's is the product over its words. The
probabilities are learnt by expectation-maximisation over the same sums, from a bounded sample of labelled documents.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialise, small_batches

SAMPLE_DOCS = 2_000  # of each language, about; the bound of what the model is fitted on
ROUNDS = 3
SMOOTHING = 0.05
SHIFT = 3.0  # nats a byte that keep products of probabilities within range
BLOCK_LANGS = 256  # languages that are learnt and scored together: a bound of what is broadcast (pieces x languages); further ones come in further blocks
STEP = 32  # bytes of a run of letters after which its sums are rescaled
LONG_RUN = 1 << 14  # bytes of a run of letters that are looked at together; a longer one goes on from the sums so far
CACHE_WORDS = 150_000
_LETTERS = re.compile(r"[^\W\d_]+").findall


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class Pieces:
    """The vocabulary as a trie of bytes, walked from all starts together."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            known = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
        every = {bytes([b]) for b in range(256)}
        every |= {p for p in known if all(b > 127 or 97 <= b <= 122 for b in p[1:]) and (p[0] in b" " or p[0] > 127 or 97 <= p[0] <= 122)}
        self.pieces = sorted(every)
        nodes: dict[tuple[int, int], int] = {}
        piece_at, count = {0: -1}, 1
        for k, p in enumerate(self.pieces):
            node = 0
            for b in p:
                if (node, b) not in nodes:
                    nodes[node, b] = count
                    count += 1
                node = nodes[node, b]
            piece_at[node] = k
        keys = np.array([n * 256 + b for n, b in nodes], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.array(list(nodes.values()), dtype=np.int64)[order]
        self.piece_at = np.array([piece_at.get(n, -1) for n in range(count)], dtype=np.int64)
        self.length = np.array([len(p) for p in self.pieces])
        self.longest = int(self.length.max())

    def matches(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bounds of the words in their concatenation; start, piece and end offset in the word of every piece that stands anywhere in a word), by end offset."""
        raw = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        stop = np.repeat(bounds[1:], np.diff(bounds))
        at, node, depth = np.arange(len(raw)), np.zeros(len(raw), np.int64), 0
        starts, found = [], []
        while len(at):
            key = node * 256 + raw[at + depth]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            good = self.keys[place] == key
            at, node = at[good], self.next[place[good]]
            depth += 1
            piece = self.piece_at[node]
            whole = piece >= 0
            starts.append(at[whole])
            found.append(piece[whole])
            more = at + depth < stop[at]
            at, node = at[more], node[more]
        start, piece = np.concatenate(starts), np.concatenate(found)
        offset = start - np.repeat(bounds[:-1], np.diff(bounds))[start] + self.length[piece]
        order = np.argsort(offset, kind="stable")
        return bounds, start[order], piece[order], offset[order]

    def forward(self, bounds, start, piece, offset, p: np.ndarray, first_sums: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Sums over the segmentations of every word's first bytes, and the logarithms by which they are scaled (None: all 0).

        There is one more place than bytes for each word: word w's are bounds[w] + w and on. first_sums are what the
        first places of a single word hold already.
        """
        size, words = np.diff(bounds), len(bounds) - 1
        word = np.searchsorted(bounds, start, "right") - 1
        alpha = np.zeros((int(bounds[-1]) + words, p.shape[1]))
        begin = bounds[:-1] + np.arange(words)
        alpha[begin] = 1.0
        if first_sums is not None:
            alpha[: len(first_sums)] = first_sums[: len(alpha)]
        scale = np.zeros_like(alpha) if (size > STEP).any() else None
        now = np.zeros((words, p.shape[1]))
        word_at = np.repeat(np.arange(words), size + 1)
        a, b = start + word, start + word + self.length[piece]
        cuts = np.searchsorted(offset, np.arange(1, int(offset[-1]) + 2)) if len(offset) else []
        for t, (lo, hi) in enumerate(zip(cuts, cuts[1:]), 1):
            order = lo + np.argsort(b[lo:hi], kind="stable")
            ends = b[order]
            heads = np.flatnonzero(np.diff(ends, prepend=-1))
            if len(heads):
                alpha[ends[heads]] += np.add.reduceat(alpha[a[order]] * p[piece[order]], heads, axis=0)
                if scale is not None:
                    scale[ends[heads]] = now[word_at[ends[heads]]]
            if scale is not None and t % STEP == 0:
                self._rescale(alpha, scale, now, np.flatnonzero(size > t), begin, size, t - self.longest + 1, t + self.longest)
        return alpha, scale

    @staticmethod
    def _rescale(sums: np.ndarray, scale: np.ndarray, now: np.ndarray, words: np.ndarray, begin: np.ndarray, size: np.ndarray, lo: int, hi: int) -> None:
        """Divide what these words' places lo to hi hold by the largest of it: no piece reaches from before lo to behind it."""
        if len(words):
            at = begin[words, None] + np.clip(np.arange(lo, hi + 1), 0, size[words, None])
            most = sums[at].max(axis=1)
            sums[at] = sums[at] / most[:, None]
            now[words] += np.log(most)
            scale[at] = now[words][:, None]

    def log_probabilities(self, words: list[bytes], p: np.ndarray) -> np.ndarray:
        """The logarithm of the sum over all segmentations of each word into pieces, whatever its length."""
        out = np.zeros((len(words), p.shape[1]))
        short = [k for k, w in enumerate(words) if len(w) <= LONG_RUN]
        if short:
            some = [words[k] for k in short]
            bounds, *found = self.matches(some)
            alpha, scale = self.forward(bounds, *found, p)
            last = bounds[1:] + np.arange(len(some))
            out[short] = np.log(alpha[last]) + (0 if scale is None else scale[last]) - SHIFT * np.diff(bounds)[:, None]
        for k, w in enumerate(words):
            if len(w) > LONG_RUN:
                out[k] = self._long_log_probability(w, p) - SHIFT * len(w)
        return out

    def _long_log_probability(self, word: bytes, p: np.ndarray) -> np.ndarray:
        """A block of starts at a time; the places that pieces of a block reach behind its end go on to the next one."""
        sums, total = np.ones((1, p.shape[1])), np.zeros(p.shape[1])
        for s in range(0, len(word), LONG_RUN):
            n = min(LONG_RUN, len(word) - s)
            bounds, start, piece, offset = self.matches([word[s : s + n + self.longest]])
            own = start < n
            alpha, scale = self.forward(bounds, start[own], piece[own], offset[own], p, sums)
            behind = slice(n, n + self.longest + 1)
            ahead = np.zeros_like(alpha[behind]) if scale is None else scale[behind]
            sums = np.where(alpha[behind] > 0, alpha[behind] * np.exp(ahead - ahead[0]), 0.0)
            total += ahead[0]
        return np.log(sums[0]) + total

    def expected(self, words: list[bytes], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected number of times each piece is used, over all segmentations of the words (p: one language)."""
        bounds, start, piece, offset = self.matches(words)
        alpha, scale = self.forward(bounds, start, piece, offset, p[:, None])
        alpha, size = alpha[:, 0], np.diff(bounds)
        word = np.searchsorted(bounds, start, "right") - 1
        a = start + word
        b = a + self.length[piece]
        beta = np.zeros((len(alpha), 1))
        first, last = bounds[:-1] + np.arange(len(words)), bounds[1:] + np.arange(len(words))
        beta[last] = 1.0
        back, now = np.zeros_like(beta), np.zeros((len(words), 1))
        begin = start - bounds[word]
        order = np.argsort(-begin, kind="stable")
        most = int(begin.max(initial=0))
        cuts = np.searchsorted(-begin[order], np.arange(-most, 2))
        for s, (lo, hi) in zip(range(most, -1, -1), zip(cuts, cuts[1:])):
            part = order[lo:hi]
            if len(part):
                np.add.at(beta[:, 0], a[part], beta[b[part], 0] * p[piece[part]])
                back[a[part]] = now[word[part]]
            if scale is not None and s and s % STEP == 0:
                self._rescale(beta, back, now, np.flatnonzero(size > s), first, size, s - self.longest, s + self.longest - 1)
        share = alpha[a] * p[piece] * beta[b, 0] / alpha[last][word] * counts[word]
        if scale is not None:
            share = share * np.exp(scale[a, 0] + back[b, 0] - scale[last, 0][word])
        return np.bincount(piece, share, len(self.pieces))


@lru_cache(maxsize=1)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def letter_words(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; digits, marks and signs are left out."""
    return _LETTERS(text.lower()) if text else []


def _bytes_of(word: str) -> bytes:
    return b" " + word.encode("utf-8", "surrogatepass")


def _letters_only(word: str) -> str:
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def is_held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5 is 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def languages(labelled: DataFrame, lang: str = "lang", text: str = "text") -> dict[str, int]:
    """Documents of each language to learn from."""
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    return {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language


def train(labelled: DataFrame, path: str, sizes: dict[str, int], lang: str = "lang", text: str = "text", doc_id: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray]:
    """The languages of `sizes` (see languages) in order of name and their piece probabilities (pieces x languages), from about sample_docs documents of each. A run of letters of over LONG_RUN bytes is learnt from by its stretches of that length."""
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((0, 0))
    rows = labelled.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text")).filter(F.col("lang").isin(langs) & F.col("text").isNotNull())
    small_batches(rows.sparkSession)
    rate = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, sample_docs / sizes[k])))])
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.element_at(rate, F.col("lang")) * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, Counter] = {}
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.setdefault(k, Counter()).update(letter_words(t))
            out = [(k, w, n) for k, c in seen.items() for w, n in c.items()]
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["lang", "word", "n"])

    words = materialise(chosen.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang-words")
    size = len(pieces_of(path).pieces)
    p = np.full((size, len(langs)), 1.0 / size)
    spark = rows.sparkSession
    rows_a_batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for _ in range(ROUNDS):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
        shared = spark.sparkContext.broadcast(p * np.exp(SHIFT * pieces_of(path).length)[:, None])

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tool, total = pieces_of(path), {}
            for batch in batches:
                own = {}
                for k, w, n in zip(*(c.to_pylist() for c in batch.columns)):
                    own.setdefault(k, []).append((w, n))
                for k, pairs in own.items():
                    # to learn from, a run of letters of many kilobytes counts by its stretches
                    cut = [(raw[at : at + LONG_RUN], n) for w, n in pairs if (only := _letters_only(w)) for raw in [_bytes_of(only)] for at in range(0, len(raw), LONG_RUN)]
                    if cut:
                        found = tool.expected([s for s, _ in cut], np.array([n for _, n in cut], float), shared.value[:, langs.index(k)])
                        total[k] = total.get(k, 0.0) + found
            for k, found in total.items():
                used = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(used), pa.string()), pa.array(used), pa.array(found[used])], names=["lang", "piece", "n"])

        try:
            found = words.mapInArrow(expect, "lang string, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()  # at most pieces x languages
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
        p = np.full((size, len(langs)), SMOOTHING)
        if found.num_rows:
            of = np.array([langs.index(k) for k in found["lang"].to_pylist()])
            p[found["piece"].to_numpy(), of] += found["n"].to_numpy()
        p /= p.sum(0)
        shared.unpersist()
    return langs, p


_worker: dict = {}


def identify(docs: DataFrame, langs: list[str], p: np.ndarray, path: str, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, text_hash, lang (as labelled), lang_pred, score, n_bytes, fit of every row; of the languages given.

    The most probable language (equal: the first by name), its posterior under equal priors, the bytes that it is told
    by and its log likelihood a byte; `und`, 0, 0 and null for a null text or one without letters.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(p * np.exp(SHIFT * pieces_of(path).length)[:, None] if langs else p)
    pieces_of.cache_clear()  # the driver needs no more of the pieces
    model = uuid.uuid4().hex  # a worker's cache is of one model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = pieces_of(path)
        if _worker.get("of") != model:
            _worker.update(of=model, place={}, logs=[], size=[])
        for batch in batches:
            if len(_worker["place"]) > CACHE_WORDS:
                _worker.update(place={}, logs=[], size=[])
            place = _worker["place"]
            cut = [letter_words(t) for t in batch.column(1).to_pylist()]
            fresh = [w for w in set().union(*cut).difference(place)] if langs else []
            if fresh:
                raws = [_bytes_of(only) if (only := _letters_only(w)) else b"" for w in fresh]
                some = [k for k, r in enumerate(raws) if r]
                logs = np.zeros((len(fresh), len(langs)))
                if some:
                    logs[some] = tool.log_probabilities([raws[k] for k in some], shared.value)
                base = sum(map(len, _worker["logs"]))
                _worker["logs"].append(logs)
                _worker["size"] += [len(r) for r in raws]
                for k, (w, r) in enumerate(zip(fresh, raws)):
                    place[w] = base + k if r else -1
                if len(_worker["logs"]) > 1:
                    _worker["logs"] = [np.concatenate(_worker["logs"])]
            predicted, scores, sizes, fits = [], [], [], []
            lengths = np.array(_worker["size"], dtype=np.int64)
            for words in cut:
                at = np.array([place[w] for w in words], dtype=np.int64) if langs else np.zeros(0, np.int64)
                at = at[at >= 0]
                if not len(at):
                    predicted.append("und")
                    scores.append(0.0)
                    sizes.append(0)
                    fits.append(None)
                    continue
                total = _worker["logs"][0][at].sum(0)
                best = int(total.argmax())
                predicted.append(langs[best])
                scores.append(float(1 / np.exp(total - total[best]).sum()))
                sizes.append(int(lengths[at].sum()))
                fits.append(float(total[best]) / sizes[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(predicted, pa.string()), pa.array(scores, pa.float64()), pa.array(sizes, pa.int64()), pa.array(fits, pa.float64())], names=["doc_id", "text_hash", "lang", "lang_pred", "score", "n_bytes", "fit"]
            )
        _worker.clear()  # a worker that goes on to other work keeps nothing of this

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(lang).alias("lang"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, lang string, lang_pred string, score double, n_bytes long, fit double")


def _in_blocks(docs: DataFrame, labelled: DataFrame, blocks: list[dict[str, int]], path: str, doc_id: str, text: str, lang: str) -> DataFrame:
    """As identify, for more languages than are scored together: a pass for each block of them, and each row's best of all blocks. A language's probabilities don't depend on the others; the posterior of the best one is put together from those of the blocks."""
    rows = materialise(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).withColumn("row", F.monotonically_increasing_id()), "language-rows")
    parts = []
    for k, sizes in enumerate(blocks):
        # the row's number goes along in place of its id
        part = identify(rows, *train(labelled, path, sizes, lang, text, doc_id), path, "row", "text", "lang")
        parts.append(materialise(part.select(F.col("doc_id").alias("row"), "text_hash", "lang", F.lit(-k).alias("block"), "lang_pred", "score", "n_bytes", "fit"), "language-block"))
    every = reduce(DataFrame.union, parts)
    logp = F.col("fit") * F.col("n_bytes")  # of the block's best; score: its share of the block
    best = every.groupBy("row", "text_hash", "lang").agg(F.max(F.struct(logp.alias("logp"), "block", "lang_pred", "n_bytes", "fit")).alias("best"), F.collect_list(F.struct(logp.alias("logp"), "score")).alias("each"))  # one of each block
    share = F.aggregate("each", F.lit(0.0), lambda a, x: a + F.exp(x["logp"] - F.col("best.logp")) / x["score"])
    told = F.col("best.logp").isNotNull()
    found = best.select("row", "text_hash", "lang", "best.lang_pred", F.when(told, 1 / share).otherwise(0.0).alias("score"), "best.n_bytes", "best.fit")
    return rows.select("row", F.col("id").alias("doc_id")).join(found, "row").drop("row")


def identify_languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", pieces: str | None = None) -> DataFrame:
    """Learns from the documents that aren't held out and have a language, and predicts every row: doc_id, text_hash, held_out, lang, lang_pred, score, n_bytes, fit.

    A text that is null, empty or without letters is `und` with score 0; a run of letters of any length counts whole,
    by the sum over all its segmentations. Repeated rows each keep a row. An empty table gives an empty result; without
    anything to learn from all is `und`. Other columns are ignored.
    """
    path = pieces or default_pieces()
    labelled = docs.filter(~is_held_out(F.col(doc_id)))
    sizes = languages(labelled, lang, text)
    names = sorted(sizes)
    if len(names) <= BLOCK_LANGS:
        found = identify(docs, *train(labelled, path, sizes, lang, text, doc_id), path, doc_id, text, lang)
    else:
        found = _in_blocks(docs, labelled, [{k: sizes[k] for k in names[at : at + BLOCK_LANGS]} for at in range(0, len(names), BLOCK_LANGS)], path, doc_id, text, lang)
    return found.select("doc_id", "text_hash", is_held_out(F.col("doc_id")).alias("held_out"), "lang", "lang_pred", "score", "n_bytes", "fit")
