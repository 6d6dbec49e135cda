"""The thin opN_ queries: each reads its table, applies its operator with production parameters and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import licences, urls
from ledgerloom.llm.bpe import encode_decode
from ledgerloom.llm.collocations import mine_collocations
from ledgerloom.llm.common import table
from ledgerloom.llm.langid import identify_languages
from ledgerloom.llm.lexical import rank_documents
from ledgerloom.llm.packing import pack_documents
from ledgerloom.llm.quality import classify_quality
from ledgerloom.llm.neighbours import nearest_by_codes
from ledgerloom.llm.search import exact_top_k
from ledgerloom.llm.sharding import shard_by_bytes
from ledgerloom.llm.simhash import simhash_near_duplicates
from ledgerloom.llm.suffixes import remove_repeats


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_duplicates(table(spark, sf_dir, "documents"), words=3, budget=3)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "lang", "n_grams", "perplexity", "threshold", "keep")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"), shards=8)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"), wider=licences.WIDER)


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(table(spark, sf_dir, "documents"))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), capacity=1024, end_id=2)


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_by_codes(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(table(spark, sf_dir, "documents"), least=30, top=2000)


def op13_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), depth=100)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_quality": op2_quality,
    "op3_topk": op3_topk,
    "op4_sharding": op4_sharding,
    "op5_language": op5_language,
    "op6_licences": op6_licences,
    "op7_urls": op7_urls,
    "op8_bpe": op8_bpe,
    "op9_packing": op9_packing,
    "op10_neighbours": op10_neighbours,
    "op11_lexical": op11_lexical,
    "op12_collocations": op12_collocations,
    "op13_suffixes": op13_suffixes,
}

#: Every query's 20 highest integer products, compared with all vectors.
OP3_ORACLE = """
    WITH usable AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
                    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    usual AS (SELECT len(v) AS d FROM usable GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    kept AS (SELECT * FROM usable WHERE len(v) = (SELECT d FROM usual)),
    scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM kept q JOIN kept c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20"""

#: Every score of every document, from all terms of all texts.
OP11_ORACLE = """
    WITH words AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    sized AS (SELECT d, doc_id, w, len(w) AS n FROM words WHERE len(w) > 0),
    corpus AS (SELECT count(*) AS N_all, sum(n) AS L_all FROM sized),
    tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(w) AS term FROM sized) GROUP BY ALL),
    weight AS (SELECT term, CAST(floor(1000 * ln((2 * N_all + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), corpus),
    items AS (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
    asked AS (SELECT i, item_id, term, count(*) AS many FROM items GROUP BY ALL),
    normed AS (SELECT d, doc_id, 25 + (75 * n * N_all) // L_all AS m FROM sized, corpus),
    scored AS (SELECT i, item_id, d, doc_id, CAST(sum(many * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
               FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN normed USING (d) GROUP BY ALL)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10"""

#: Every phrase of 1 to 4 words of every piece, counted by its text.
OP12_ORACLE = """
    WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w FROM documents),
    total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY 1),
    grams AS (SELECT lang, s.k AS size, array_to_string(w[p : p + s.k - 1], ' ') AS phrase
              FROM (SELECT lang, w, s, unnest(range(1, len(w) - s.k + 2)) AS p FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS k) s)),
    counted AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
    cuts AS (SELECT lang, phrase, size, f AS a, k, array_to_string(string_split(phrase, ' ')[1 : k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1 : size], ' ') AS rest
             FROM (SELECT *, unnest(range(1, size)) AS k FROM counted WHERE size > 1)),
    scored AS (SELECT c.lang, c.phrase, c.size, c.a, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (x.f + y.f) AS BIGINT) AS score, c.k
               FROM cuts c JOIN counted x ON c.lang = x.lang AND c.head = x.phrase JOIN counted y ON c.lang = y.lang AND c.rest = y.phrase),
    least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    kept AS (SELECT * FROM least s WHERE NOT EXISTS (SELECT 1 FROM counted h WHERE h.lang = s.lang AND h.size > s.size AND contains(' ' || h.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * h.f >= 80 * s.a))
    SELECT lang, rank, phrase, a, l, r, n, score
    FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept JOIN total USING (lang)) WHERE rank <= 2000"""

#: Every window of 100 bytes of every text, as hexadecimal digits, and the first place of each.
OP13_ORACLE = """
    WITH rows_ AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS d, hex(encode(coalesce(text, ''))) AS h FROM documents),
    windows AS (SELECT d, s, substr(h, 2 * s + 1, 200) AS w FROM (SELECT d, h, unnest(range(0, len(h) // 2 - 99)) AS s FROM rows_)),
    again AS (SELECT d, s FROM (SELECT d, s, row_number() OVER (PARTITION BY w ORDER BY d, s) AS k FROM windows) WHERE k > 1),
    steps AS (SELECT d, s, s - lag(s) OVER (PARTITION BY d ORDER BY s) AS step FROM again),
    spans AS (SELECT d, g, min(s) AS a, max(s) + 100 AS b FROM (SELECT d, s, count_if(step IS NULL OR step > 100) OVER (PARTITION BY d ORDER BY s) AS g FROM steps) GROUP BY ALL),
    parts AS (SELECT d, a, b, lag(b, 1, 0) OVER (PARTITION BY d ORDER BY a) AS since FROM spans),
    held AS (SELECT d, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
             FROM parts JOIN rows_ USING (d) GROUP BY d)
    SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
    FROM rows_ LEFT JOIN held USING (d)"""

ORACLES: dict[str, str] = {
    "op11_lexical": OP11_ORACLE,
    "op12_collocations": OP12_ORACLE,
    "op13_suffixes": OP13_ORACLE,
    "op3_topk": OP3_ORACLE,
    "op6_licences": licences.oracle(),
    "op7_urls": urls.oracle(),
}
