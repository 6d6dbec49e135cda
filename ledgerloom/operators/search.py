"""Full-text search: tokens, phrases, boolean terms, BM25, snippets (FTS-1..6)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
SNIPPET_TOKENS = 24


def _accents() -> tuple[str, str]:
    """Latin letters with marks, and what they are without: built from Unicode's decompositions."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(a, b.lower()) for a, b in pairs if unicodedata.normalize("NFD", a) != a and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(F.translate(text, *_accents())), *_accents())


def tokens(text: Column) -> Column:
    """Runs of letters and digits, folded (FTS-1)."""
    return F.regexp_extract_all(folded(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def fold_text(text: str) -> list[str]:
    """The tokens of a query, as `tokens` makes them."""
    import re

    table = dict(zip(map(ord, _accents()[0]), _accents()[1]))
    return re.findall(r"[^\W_]+", text.translate(table).lower().translate(table))


def postings(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """term, doc_id, tf: the inverted index as a table."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(tokens(F.col(text))).alias("term")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def positions(docs: DataFrame, doc_id: str, text: str, buckets: int = 64) -> DataFrame:
    """term, doc_id, positions, length, bucket: the inverted index with the places of each term, its document's number of tokens, and a bucket of the term (FTS-1); fulltext keeps such an index as a table."""
    words = with_tokens(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "_text")
    each = words.select("doc_id", F.size("_words").cast("long").alias("length"), F.posexplode("_words").alias("at", "term"))
    found = each.groupBy("term", "doc_id", "length").agg(F.array_sort(F.collect_list("at")).alias("positions"))  # of one document's term
    return found.withColumn("bucket", bucket_of(F.col("term"), buckets))


def bucket_of(term: Column, buckets: int = 64) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def corpus_size(docs: DataFrame, text: str) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size(tokens(F.col(text)))).alias("mean_length"))


def rows_of_terms(index: DataFrame, terms: list[str], buckets: int = 64) -> DataFrame:
    """The rows of an index that searches for these words and phrases read."""
    words = sorted({w for t in terms for w in fold_text(t)})
    if not words:
        return index.limit(0)
    hashes = index.sparkSession.range(1).select(*[bucket_of(F.lit(w), buckets).alias(f"b{k}") for k, w in enumerate(words)]).first()
    return index.filter(F.col("bucket").isin(sorted(set(hashes))) & F.col("term").isin(words))


def indexed_phrase(index: DataFrame, phrase: str, buckets: int = 64) -> DataFrame:
    """doc_id, length, tf of the documents that hold the phrase, from the index alone: the places of its k-th word less k meet where it begins (FTS-2)."""
    words = fold_text(phrase)
    if not words:
        return index.select("doc_id", "length", F.lit(0).cast("long").alias("tf")).limit(0)
    own = rows_of_terms(index, [phrase], buckets)
    places = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in enumerate(words)])
    starts = own.select("doc_id", "length", "term", "positions", F.explode(places).alias("p")).filter("term = p.w").select("doc_id", "length", F.explode(F.transform("positions", lambda x: x - F.col("p.k"))).alias("start"))
    whole = starts.groupBy("doc_id", "length", "start").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(words))
    return whole.groupBy("doc_id", "length").agg(F.count(F.lit(1)).alias("tf"))


def indexed_bm25(index: DataFrame, size: DataFrame, terms: list[str], buckets: int = 64) -> DataFrame:
    """As bm25 for the documents that hold all terms, from the index and the corpus's size (one row)."""
    held = None
    for k, t in enumerate(terms):
        one = indexed_phrase(index, t, buckets).withColumnRenamed("tf", f"tf{k}")
        counted = one.join(F.broadcast(one.agg(F.count(F.lit(1)).alias(f"df{k}"))))  # one row
        held = counted if held is None else held.join(counted.drop("length"), "doc_id")
    return ranked_rows(held.join(F.broadcast(size)), len(terms))


def let(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it and wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), f), 0)


def phrase_count(words: Column, phrase: list[str]) -> Column:
    """How often the words stand one after another (FTS-2)."""
    return let(words, lambda w: _phrase_count(w, phrase))


def _phrase_count(words: Column, phrase: list[str]) -> Column:
    return F.size(_places(words, phrase)).cast("long")


def _places(words: Column, phrase: list[str]) -> Column:
    """0-based places at which the phrase begins."""
    last = F.size(words) - len(phrase)
    here = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

    def stands(i: Column) -> Column:
        out = F.get(words, i) == phrase[0]
        for k, w in enumerate(phrase[1:], 1):
            out = out & (F.get(words, i + k) == w)
        return out

    return F.filter(here, stands)


def with_tokens(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn("_words", tokens(F.col(text)))


def match_phrase(docs: DataFrame, text: str, query: str) -> DataFrame:
    """Documents with the query as a phrase, and how often (tf). A plain substring test comes first, so that only likely documents are tokenised."""
    words = fold_text(query)
    if not words:
        return docs.withColumns({"tf": F.lit(0).cast("long"), "_words": tokens(F.col(text))}).limit(0)
    likely = docs.filter(folded(F.col(text)).contains(words[0]))
    found = with_tokens(likely, text).withColumn("tf", phrase_count(F.col("_words"), words))
    return found.filter("tf > 0")


def bm25_any(docs: DataFrame, doc_id: str, text: str, terms: list[str]) -> DataFrame:
    """As bm25, for the documents that hold any of the terms."""
    return bm25(docs, doc_id, text, terms, every=False)


def bm25(docs: DataFrame, doc_id: str, text: str, terms: list[str], every: bool = True) -> DataFrame:
    """doc_id, rank (lower is better) of the documents that hold all terms, each a word or a phrase (FTS-4).

    One pass counts documents and tokens, one finds the matches; term statistics are as many rows as the query has terms.
    """
    lengths = corpus_size(docs, text)
    words = with_tokens(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "_text")
    counts = words.select("doc_id", F.size("_words").alias("length"), *[phrase_count(F.col("_words"), fold_text(t)).alias(f"tf{k}") for k, t in enumerate(terms)])
    any_ = counts.filter(" or ".join(f"tf{k} > 0" for k in range(len(terms))))
    df = any_.agg(*[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(terms))])
    held = any_.filter(" and ".join(f"tf{k} > 0" for k in range(len(terms)))) if every else any_
    rows = held.join(F.broadcast(df)).join(F.broadcast(lengths))  # one row each
    return ranked_rows(rows, len(terms))


def ranked_rows(rows: DataFrame, terms: int) -> DataFrame:
    """doc_id, rank of rows with tf and df of each term, length, n_docs and mean_length."""
    total = F.lit(0.0)
    for k in range(terms):
        tf, n = F.col(f"tf{k}"), F.col(f"df{k}")
        idf = F.greatest(F.log((F.col("n_docs") - n + 0.5) / (n + 0.5)), F.lit(LEAST_IDF))
        total = total + idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    return rows.select("doc_id", (-total).alias("rank"))


def boolean(words: Column, query: tuple) -> Column:
    """`query` (see _boolean) over an array of tokens, which is worked out once."""
    return let(words, lambda w: _boolean(w, query))


def _boolean(words: Column, query: tuple) -> Column:
    """('term', w) | ('prefix', w) | ('phrase', text) | ('near', a, b, distance) | ('and' | 'or', q, q, ...) | ('not', q, without) over an array of tokens (FTS-3)."""
    kind, *args = query
    if kind == "term":
        return F.array_contains(words, fold_text(args[0])[0])
    if kind == "prefix":
        return F.exists(words, lambda w: w.startswith(fold_text(args[0])[0]))
    if kind == "phrase":
        return _phrase_count(words, fold_text(args[0])) > 0
    if kind == "near":
        a, b, distance = fold_text(args[0])[0], fold_text(args[1])[0], args[2]
        at = lambda w: F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: F.coalesce(F.get(words, i) == w, F.lit(False)))
        return F.exists(at(a), lambda i: F.exists(at(b), lambda j: F.abs(i - j) - 1 <= distance))
    if kind == "not":
        return _boolean(words, args[0]) & ~_boolean(words, args[1])
    out = _boolean(words, args[0])
    for q in args[1:]:
        out = (out & _boolean(words, q)) if kind == "and" else (out | _boolean(words, q))
    return out


def parse(query: str) -> tuple:
    """Terms, "phrases", prefix*, AND, OR, NOT, NEAR(a b, n) and brackets as the tuples of `boolean`; AND binds closer than OR, NOT closest (FTS-3)."""
    import re

    parts = re.findall(r'"[^"]*"|NEAR\([^)]*\)|\(|\)|[^\s()"]+', query)
    at = 0

    def peek() -> str | None:
        return parts[at] if at < len(parts) else None

    def take() -> str:
        nonlocal at
        at += 1
        if at > len(parts):
            raise ValueError("the query ends early")
        return parts[at - 1]

    def atom() -> tuple:
        t = take()
        if t == "(":
            inner = either()
            if take() != ")":
                raise ValueError("a bracket is open")
            return inner
        if t in (")", "AND", "OR", "NOT"):
            raise ValueError(f"unexpected {t}")
        if t.startswith("NEAR("):
            words, _, n = t[5:-1].partition(",")
            a, b = words.split()
            return ("near", a, b, int(n or 10))
        if t.startswith('"'):
            return ("phrase", t[1:-1])
        return ("prefix", t[:-1]) if t.endswith("*") else ("term", t)

    def without() -> tuple:
        left = atom()
        while peek() == "NOT":
            take()
            left = ("not", left, atom())
        return left

    def both() -> tuple:
        left = without()
        while peek() not in (None, "OR", ")"):
            if peek() == "AND":
                take()
            left = ("and", left, without())
        return left

    def either() -> tuple:
        left = both()
        while peek() == "OR":
            take()
            left = ("or", left, both())
        return left

    made = either()
    if at != len(parts):
        raise ValueError(f"unexpected {parts[at]}")
    return made


def snippet(words: Column, *phrases: list[str], size: int = SNIPPET_TOKENS) -> Column:
    """At most `size` tokens around the first match of any of the phrases; each match stands in brackets, and dots where tokens are left out (FTS-5)."""
    return let(words, lambda w: let(_starts(w, list(phrases)), lambda found: _snippet(w, found, size)))


def _starts(words: Column, phrases: list[list[str]]) -> Column:
    """(at, end): the 0-based first and last places of every match, in order."""

    def spans(p: list[str]) -> Column:
        return F.transform(_places(words, p), lambda i: F.struct(i.alias("at"), (i + (len(p) - 1)).alias("end")))

    found = [spans(p) for p in phrases if p]
    return F.array_sort(F.concat(*found)) if found else F.array().cast("array<struct<at: int, end: int>>")


def _snippet(words: Column, found: Column, size: int) -> Column:
    first, n = F.get(found, 0), F.size(words)
    before = F.least(F.lit(size // 2), F.greatest(F.lit(0), size - 1 - (first["end"] - first["at"])))
    start = F.greatest(F.lit(0), F.coalesce(first["at"] - before, F.lit(0)))

    def shown(w: Column, k: Column) -> Column:
        i = start + k
        opens = F.exists(found, lambda m: m["at"] == i) & ~F.exists(found, lambda m: (m["at"] < i) & (m["end"] >= i))  # matches that overlap stand in one bracket
        closes = F.exists(found, lambda m: m["end"] == i) & ~F.exists(found, lambda m: (m["at"] <= i) & (m["end"] > i))
        return F.concat(F.when(opens, "[").otherwise(""), w, F.when(closes, "]").otherwise(""))

    text = F.array_join(F.transform(F.slice(words, start + 1, size), shown), " ")
    return F.concat(F.when(start > 0, "... ").otherwise(""), text, F.when(start + size < n, " ...").otherwise(""))
