"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of characters.

The model is trained on all trusted text. Words are separated by one blank, and n-grams run across them, so repeated or
shuffled words count as well as odd ones. Counts, context totals and continuation counts are tables dealt out by
n-gram; joined order by order with the n-grams that the corpus holds they give every such n-gram its log probability.
A document's perplexity comes from the sum over its n-grams: the most frequent n-grams (a fixed number) are looked up
where the text is read; of all others a row for each document and n-gram is joined with the log probabilities by a
shuffle. Frequent n-grams are among the first, so no key of the join is hot. A document is rejected if its perplexity
is above a quantile of trusted documents of its language and length that took no part in the training.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialise, small_batches

ORDER = 5
BROADCAST_TRUSTED = 1_000_000  # ids of trusted documents are broadcast up to so many; beyond, they and the texts meet in a shuffle
HELD_OUT = 5  # one in so many trusted documents sets the thresholds
QUANTILE = 0.99
SHORT = 400  # characters at which a document's mean log probability varies by chance as much as from document to document
SMALL_SAMPLE = 20  # a quantile of m held-out documents is raised by the share SMALL_SAMPLE / m: few of them say little of the tail
HEAD_GRAMS = 200_000  # 16 bytes each where texts are read
BLOCK_CHARS = 1 << 20  # characters whose n-grams are looked at together
HELD_GRAMS = 1 << 20  # distinct n-grams that a task counts before it hands them on
START, END = "\x02", "\x03"
_TIMES, _BY = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _blocks(texts: list[str | None], order: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(characters, places, hash of the n-gram at each place, text of each place) in blocks of about `size`.

    A text's words are joined by blanks, padded with START and closed by END; a text without words has no n-grams. A
    long text goes in blocks that share the characters of one n-gram less one.
    """
    held, owner, n = [], [], 0

    def made():
        codes = np.concatenate(held)
        lengths = np.array([len(c) for c in held])
        inside = np.ones(len(codes), bool)
        ends = np.cumsum(lengths)
        for k in range(1, order):
            inside[ends - k] = False
        h = np.zeros(len(codes) - order + 1, np.uint64)
        for k in range(order):
            h = h * _TIMES + codes[k : len(codes) - order + 1 + k] * _BY
        at = np.flatnonzero(inside[: len(h)])
        h = h[at]
        return codes, at, h ^ (h >> np.uint64(29)), np.repeat(np.array(owner), lengths)[at]

    for k, t in enumerate(texts):
        words = t.split() if t else []
        if not words:
            continue
        codes = np.frombuffer((START * (order - 1) + " ".join(words) + END).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        for a in range(0, len(codes) - order + 1, size):
            part = codes[a : a + size + order - 1]
            held.append(part)
            owner.append(k)
            n += len(part)
            if n >= size:
                yield made()
                held, owner, n = [], [], 0
    if held:
        yield made()


def _strings(codes: np.ndarray, at: np.ndarray, order: int) -> pa.Array:
    """The n-grams that begin at these places, as text; a NUL in it is written as U+FFFD."""
    grams = codes[at[:, None] + np.arange(order)].astype("<u4")
    grams[grams == 0] = 0xFFFD
    raw = grams.tobytes().decode("utf-32-le", "surrogatepass")
    return pa.array([raw[k : k + order] for k in range(0, len(raw), order)], pa.string())


def _gram_hashes(grams: list[str], order: int) -> np.ndarray:
    """The hash of each of these n-grams, as _blocks makes it."""
    codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64).reshape(-1, order)
    h = np.zeros(len(codes), np.uint64)
    for k in range(order):
        h = h * _TIMES + codes[:, k] * _BY
    return h ^ (h >> np.uint64(29))


def gram_counts(docs: DataFrame, order: int = ORDER, text: str = "text") -> DataFrame:
    """gram, n: every n-gram of all whole texts, counted within tasks first."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, grams = np.zeros(0, np.uint64), np.zeros(0, np.int64), pa.array([], pa.string())

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([grams, pa.array(counts)], names=["gram", "n"])

        for batch in batches:
            for codes, at, h, _ in _blocks(batch.column(0).to_pylist(), order, BLOCK_CHARS):
                u, first, n = np.unique(h, return_index=True, return_counts=True)
                place = np.searchsorted(hashes, u)
                known = place < len(hashes)
                known[known] = hashes[place[known]] == u[known]
                counts[place[known]] += n[known]
                fresh = ~known
                every = np.concatenate([hashes, u[fresh]])
                by = np.argsort(every, kind="stable")
                grams = pa.concat_arrays([grams, _strings(codes, at[first[fresh]], order)]).take(pa.array(by))
                hashes, counts = every[by], np.concatenate([counts, n[fresh]])[by]
                if len(hashes) > HELD_GRAMS:
                    yield rows()
                    hashes, counts, grams = np.zeros(0, np.uint64), np.zeros(0, np.int64), pa.array([], pa.string())
        if len(hashes):
            yield rows()

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more."""
    have = counts.filter("c <= 4").groupBy("c").agg(F.count(F.lit(1)).alias("k")).collect()  # at most four rows
    n = {r["c"]: r["k"] for r in have}
    y = n.get(1, 0) / max(1, n.get(1, 0) + 2 * n.get(2, 0))
    return [min(float(k), max(0.1, k - (k + 1) * y * n.get(k + 1, 0) / n[k])) if n.get(k) else 0.5 * k for k in (1, 2, 3)]


def log_probabilities(grams: DataFrame, trained: DataFrame, order: int = ORDER) -> DataFrame:
    """grams (gram, n) with logp under the model of the counts `trained` (gram, n): sharded joins by n-gram and by context, from the lowest order up."""
    counts = {order: materialise(trained.select("gram", F.col("n").alias("c")), "kn-counts")}
    for k in range(order - 1, 0, -1):
        # how many characters an n-gram continues; one at the start of a text continues none, and its plain count stands
        met = counts[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("plain"))
        counts[k] = materialise(met.select("gram", F.when(F.col("gram").startswith(START), F.col("plain")).otherwise(F.col("n")).alias("c")), "kn-continuations")
    symbols = counts[1].count() + 1  # one for characters never seen
    wanted = {order: grams}
    for k in range(order - 1, 0, -1):
        wanted[k] = wanted[k + 1].select(F.substring("gram", 2, k).alias("gram")).distinct()
    lower = None
    for k in range(1, order + 1):
        d1, d2, d3 = _discounts(counts[k])
        less = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        context = F.substring("gram", 1, k - 1)
        contexts = counts[k].groupBy(context.alias("context")).agg(F.sum("c").alias("total"), F.sum(less).alias("spared"))
        rows = wanted[k].join(counts[k], "gram", "left").withColumn("context", context).join(contexts, "context", "left")
        if lower is None:
            rows = rows.withColumn("base", F.lit(1.0 / symbols))
        else:
            rows = rows.withColumn("suffix", F.substring("gram", 2, k - 1)).join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("base")), "suffix")
        own = F.greatest(F.col("c") - less, F.lit(0.0)) / F.col("total")
        p = F.when(F.col("total").isNull(), F.col("base")).otherwise(F.coalesce(own, F.lit(0.0)) + F.col("spared") / F.col("total") * F.col("base"))
        keep = ["gram", p.alias("p")] + (["n"] if k == order else [])
        lower = materialise(rows.select(*keep), "kn-probabilities")
    return lower.select("gram", "n", F.log("p").alias("logp"))


def perplexities(docs: DataFrame, grams: DataFrame, order: int = ORDER, head: int = HEAD_GRAMS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, text_hash, lang, n_grams, perplexity of every row; a text without words has no n-grams and a null perplexity."""
    spark = docs.sparkSession
    small_batches(spark)
    # the most frequent ones are those from some count on, which a histogram of counts tells (16 steps for each doubling)
    step = F.floor(F.log2("n") * 16)
    steps = sorted(((r["s"], r["k"]) for r in grams.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)  # at most 16 * 63 rows
    enough = np.cumsum([k for _, k in steps]) <= head
    least = steps[int(enough.sum()) - 1][0] if enough.any() else None
    chosen = grams.filter(step >= least) if least is not None else grams.filter("false")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_gram_hashes(batch.column(0).to_pylist(), order).view(np.int64)), batch.column(1)], names=["hash", "logp"])

    top = chosen.select("gram", "logp").mapInArrow(hashed, "hash long, logp double").toArrow()  # at most `head` rows of 16 bytes
    known, logs = top["hash"].to_numpy().view(np.uint64), top["logp"].to_numpy()
    by = np.argsort(known)
    shared = spark.sparkContext.broadcast((known[by], logs[by]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, logp = shared.value
        for batch in batches:
            n, total, rest = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), []
            for codes, at, h, owner in _blocks(batch.column(3).to_pylist(), order, BLOCK_CHARS):
                place = np.minimum(np.searchsorted(hashes, h), max(0, len(hashes) - 1))
                found = hashes[place] == h if len(hashes) else np.zeros(len(h), bool)
                n += np.bincount(owner, minlength=len(n))
                total += np.bincount(owner[found], logp[place[found]], len(n)) if found.any() else 0
                if not found.all():
                    other = np.flatnonzero(~found)
                    order_of = other[np.lexsort((h[other], owner[other]))]
                    new = np.flatnonzero((np.diff(h[order_of], prepend=h[order_of[0]]) != 0) | (np.diff(owner[order_of], prepend=-1) != 0))
                    times = np.diff(np.append(new, len(order_of)))
                    one = order_of[new]
                    rest.append((owner[one], _strings(codes, at[one], order), times))
            none, plain = pa.nulls(batch.num_rows, pa.string()), batch.columns[:3]
            yield pa.RecordBatch.from_arrays([*plain, none, pa.array(n), pa.array(total)], names=["row", "key", "lang", "gram", "n", "total"])
            for own, gram, times in rest:
                row = batch.column(0).take(pa.array(own))
                yield pa.RecordBatch.from_arrays([row, pa.nulls(len(own), plain[1].type), pa.nulls(len(own), pa.string()), gram, pa.array(times), pa.nulls(len(own), pa.float64())], names=["row", "key", "lang", "gram", "n", "total"])

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.struct(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash")).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")
    )
    made = materialise(rows.mapInArrow(run, "row long, key struct<doc_id: long, text_hash: long>, lang string, gram string, n long, total double"), "perplexity-parts")
    rest = made.filter("gram is not null").select("row", "gram", "n").join(grams.select("gram", "logp"), "gram").groupBy("row").agg(F.sum(F.col("n") * F.col("logp")).alias("more"))
    whole = made.filter("gram is null").join(rest, "row", "left")
    summed = F.col("total") + F.coalesce("more", F.lit(0.0))
    return whole.select("key.doc_id", "key.text_hash", "lang", F.col("n").alias("n_grams"), F.when(F.col("n") > 0, F.exp(-summed / F.col("n"))).alias("perplexity"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id, held_out of all documents that every label calls good and none toxic."""
    good = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).filter("q = 1 and coalesce(t, 0) = 0")
    return materialise(good.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT == 0).alias("held_out")), "trusted")


def classify_quality(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, short: int = SHORT, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, text_hash, lang, n_grams, perplexity, threshold, keep of every row.

    The shorter a text, the more its log perplexity varies by chance: a deviation from the language's median is divided
    by sqrt(1 + short / n), n being the text's length. The threshold is the `quantile` of the deviations of the
    language's held-out trusted documents (a little more where those are few), carried back to the text's own length.

    A language without trusted documents (null too) takes the largest threshold of all languages; without any trusted
    document the threshold is null and all rows stay. A text without words (null, empty, blank) is rejected; a long
    text goes whole, in blocks. Repeated rows each keep a row; an empty table gives an empty result; other columns are
    ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    trusted = trusted_ids(labels)
    trusted = F.broadcast(trusted) if trusted.count() <= BROADCAST_TRUSTED else trusted
    trained = gram_counts(rows.join(trusted.filter("not held_out"), "doc_id", "left_semi"), order)
    grams = materialise(log_probabilities(materialise(gram_counts(rows, order), "grams"), trained, order), "gram-scores")
    scored = materialise(perplexities(rows, grams, order), "perplexities")
    calm = scored.filter("n_grams > 0").join(trusted.filter("held_out"), "doc_id", "left_semi").select("lang", "n_grams", F.log("perplexity").alias("l"))
    calm = materialise(calm, "held-out")
    spread = F.sqrt(1 + F.lit(float(short)) / F.col("n_grams"))
    usual = materialise(calm.groupBy("lang").agg(F.percentile_approx("l", 0.5, 10_000).alias("usual")), "usual")  # a row for each language of the held-out documents
    far = calm.join(F.broadcast(usual), calm.lang.eqNullSafe(usual.lang)).select(usual.lang, "usual", ((F.col("l") - F.col("usual")) / spread).alias("far"))
    limits = materialise(far.groupBy("lang", "usual").agg((F.percentile_approx("far", quantile, 10_000) * (1 + SMALL_SAMPLE / F.count(F.lit(1)))).alias("far")), "thresholds")
    top = limits.agg(F.max_by("usual", F.col("usual") + F.col("far")), F.max_by("far", F.col("usual") + F.col("far"))).first()
    judged = scored.join(F.broadcast(limits.filter("lang is not null")), "lang", "left")
    line = F.coalesce("usual", F.lit(top[0]).cast("double")) + F.coalesce("far", F.lit(top[1]).cast("double")) * spread
    judged = judged.withColumn("threshold", F.when(F.col("n_grams") > 0, F.exp(line)))
    keep = (F.col("n_grams") > 0) & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return judged.select("doc_id", "text_hash", "lang", "n_grams", "perplexity", "threshold", keep.alias("keep"))
