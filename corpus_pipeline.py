"""A training corpus from raw documents: quality, language, near duplicates, packed sequences.

Each stage takes (spark, docs, sf_dir), works on everything that its predecessor kept and returns a DataFrame; all but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialise, table, without
from ledgerloom.llm.langid import identify_languages
from ledgerloom.llm.near_copies import near_copy_places, signatures
from ledgerloom.llm.packing import pack_documents
from ledgerloom.llm.quality import classify_quality

#: A document stays if its language is known at least so well.
LEAST_LANGUAGE_SCORE = 0.5
#: The score only tells which learnt language is the least bad: a document goes also if its log likelihood a byte is by so
#: many nats under the median of the documents that its language was learnt from.
FIT_BELOW = 0.8
#: Documents are copies if they share so much of their five-word shingles (Jaccard).
NEAR, SHINGLE_WORDS = 0.8, 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is ordinary for trusted text of their language.

    Texts without words (null, empty, blank) go. Repeated rows go or stay together; rows without an id are judged like
    any other. Long texts count whole; without labels nothing but texts without words goes.
    """
    judged = materialise(classify_quality(docs, table(spark, sf_dir, "labels")), "quality")
    return without(docs, judged.filter("not keep"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language is recognised and that fit it about as well as the texts it was learnt from.

    Texts without letters go. Repeated rows go or stay together; rows without an id are judged like any other. Long
    texts count whole. Where no document has a language nothing can be learnt, and all go.
    """
    named = materialise(identify_languages(docs), "languages")
    limits = named.filter("not held_out and lang = lang_pred").groupBy("lang_pred").agg((F.percentile_approx("fit", 0.5, 10_000) - FIT_BELOW).alias("least"))
    named = named.join(F.broadcast(materialise(limits, "language-limits")), "lang_pred", "left")  # a row for each language
    unfit = F.coalesce(F.col("fit") < F.col("least"), F.lit(False))
    return without(docs, named.filter((F.col("lang_pred") == "und") | (F.col("score") < LEAST_LANGUAGE_SCORE) | unfit))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id (then text hash); of repeated rows, one.

    Texts without words (null, empty, blank) are copies of one another. A row without an id stays only where no row of
    its group has one. Long texts count whole. An empty table gives an empty result.
    """
    marked = materialise(signatures(docs, SHINGLE_WORDS), "pipeline-signatures")
    groups = materialise(near_copy_places(marked, NEAR).select("doc_id", "text_hash", "place"), "pipeline-groups")
    # sums and minima of plain numbers, kept as a table, so that a large group is gathered within tasks and its join can be split
    first = materialise(groups.groupBy("place").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "pipeline-places")
    met = materialise(groups.join(first, "place").withColumn("least", F.col("doc_id").eqNullSafe(F.col("first_id"))), "pipeline-copies")
    hashes = met.filter("least").groupBy("place").agg(F.min("text_hash").alias("first_hash"))  # one row a group
    met = met.join(materialise(hashes, "pipeline-firsts"), "place")
    kept = F.col("least") & (F.col("text_hash") == F.col("first_hash"))
    out = without(docs, met.filter(~kept).select("doc_id", "text_hash"))
    repeated = met.filter(kept).groupBy("place").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    return out.dropDuplicates(["doc_id", "text"]) if repeated else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences of 1024 tokens; a null or empty text is its end id alone, repeated rows have their own pieces, a long text has as many as it needs. An empty table gives an empty result."""
    return pack_documents(docs, capacity=1024, end_id=2)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("packing", packing)]

#: SQL can express none of the stages (a trained model, a hash that SQL lacks, a tokenizer); tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
