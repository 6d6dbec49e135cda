"""Licence scans: phrases that stand word by word, and an exact set-similarity join of text blocks with licence templates.

A block is any run of consecutive words, across lines, of the template's length and a quarter more. The templates' words
are ordered by their global frequency, rarest first. A block that holds at least `threshold` of a template's words must
hold one of the template's first words in that order (prefix filter): the places of those words fetch the templates.
The words around such a place must hold enough of the template (length filter), counting only words from that one on
in the order, since a rarer one fetches the template itself (positional filter); only then are the blocks through the
place compared one by one. Built-in functions only.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import ascii_lower, materialise

THRESHOLD = 0.8
#: The phrases of the contract and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: Phrases of the method's own: the grant without the contract's first word.
WIDER = [("the mit license", "mit"), *PHRASES[1:]]
#: Grants as licences print them, with the words that a block must hold because they tell the licence from others.
TEMPLATES = [
    ("mit", "released under the mit license", "mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ""),
    ("apache-2", "licensed under the apache license version 2 0", "apache 2"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "compliance"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ""),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc nc"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "noncommercial"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu 3"),
    ("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu"),
]
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of lower-cased text
_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), _GAP), lambda w: w != "")


def _places(words: Column, phrase: list[str]) -> Column:
    """Where the phrase's words stand one after another, from 0."""
    last = F.size(words) - len(phrase)
    here = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

    def stands(i: Column) -> Column:
        out = F.get(words, i) == phrase[0]
        for k, w in enumerate(phrase[1:], 1):
            out = out & (F.get(words, i + k) == w)
        return out

    return F.filter(here, stands)


def _phrase_regex(phrases: list[tuple[str, str]]) -> str:
    return "(?i)" + "|".join(_GAP.replace("\\x60", "\\x40\\x5B-\\x60").join(p.split()) for p, _ in phrases)


def _block(template: str, threshold: float) -> int:
    """Words of a block that is compared with the template."""
    return math.ceil(len(template.split()) / threshold - 1e-9)


def scan_licences(docs: DataFrame, threshold: float = THRESHOLD, templates: list[tuple[str, str, str]] | None = None, phrases: list[tuple[str, str]] | None = None, doc_id: str = "doc_id", text: str = "text", wider: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; with `wider` n_wider, first_wider, last_wider too.

    n_base counts all places of all phrases; labels adds those of templates (label, words, words that must be there) of
    which a block holds at least `threshold` of the distinct words; score is 1 with a phrase, else the largest share of
    a template that a block holds, if at least the threshold, else 0. A null text is an empty one: no words, empty
    labels. A long text is read whole. Repeated rows each keep a row; other columns are ignored. An empty table gives
    an empty result. `wider`: phrases that aren't base ones; their places have columns of their own, their labels are
    among labels, and they make the score 1.
    """
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    own = list(dict.fromkeys([*phrases, *(wider or [])]))  # each is looked for once
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sets = [(k, label, sorted(set(t.split())), sorted(must.split()), _block(t, threshold)) for k, (label, t, must) in enumerate(templates)]
    need = {k: max(1, math.ceil(threshold * len(s) - 1e-9)) for k, _, s, _, _ in sets}

    # global frequency: the texts that hold each of the templates' words
    vocabulary = sorted({w for _, _, s, _, _ in sets for w in s})
    held = rows.select(F.explode(F.array_intersect(words_of(F.col("text")), F.array(*map(F.lit, vocabulary)))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    frequency = {r["word"]: r["n"] for r in held.collect()}  # at most the templates' words
    order = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
    ranked = [(k, label, sorted(s, key=order.get), must, width) for k, label, s, must, width in sets]
    firsts = [(w, k, label, s[at:], must, need[k], width, len(s)) for k, label, s, must, width in ranked for at, w in enumerate(s[: len(s) - need[k] + 1])]

    # one pass over the texts: the phrases, and the words around each word of some template's prefix
    marks = sorted({f[0] for f in firsts})
    marker = "(?i)(?<![0-9A-Za-z\\x{80}-\\x{10FFFF}])(?:" + "|".join(map(re.escape, marks)) + ")(?![0-9A-Za-z\\x{80}-\\x{10FFFF}])"
    reach = max(f[6] for f in firsts)
    suspect = F.when(F.rlike("text", F.lit(marker)) | F.rlike("text", F.lit(_phrase_regex(own))), words_of(F.col("text")))
    places = [F.coalesce(_places(F.col("_words"), p.split()), F.array().cast("array<int>")) for p, _ in own]
    seen = rows.select("doc_id", F.xxhash64("text").alias("_hash"), F.regexp_count("text", F.lit(_WORD)).cast("long").alias("n_words"), suspect.alias("_words"))
    every_place = F.when(F.size("_words") > 0, F.sequence(F.lit(0), F.size("_words") - 1)).otherwise(F.array().cast("array<int>"))
    anchors = F.filter(every_place, lambda i: F.get(F.col("_words"), i).isin(marks))
    before = F.lit(reach - 1)
    near = F.transform(
        anchors,
        lambda i: F.struct(F.get(F.col("_words"), i).alias("word"), F.least(i, before).alias("at"), F.slice(F.col("_words"), F.greatest(i - before, F.lit(0)) + 1, F.least(i, before) + reach).alias("around")),
    )
    seen = materialise(seen.select("doc_id", "_hash", "n_words", near.alias("_near"), F.array(*places).alias("_places")), "licence-marks")

    def of(some: list[tuple[str, str]]) -> tuple[Column, Column]:
        """All places of some phrases, and the labels of those that have one."""
        at = [(F.col("_places")[own.index(p)], p[1]) for p in some]
        return F.flatten(F.array(*[places for places, _ in at])), F.array_compact(F.array(*[F.when(F.size(places) > 0, F.lit(label)) for places, label in at]))

    every, base = of(phrases)
    also, more = of(own)

    # the join: places of prefix words, met with the templates by word; equal surroundings count once
    index = spark.createDataFrame(firsts, "word string, template int, label string, tokens array<string>, must array<string>, need int, width int, size int")
    spots = seen.filter(F.size("_near") > 0).select("_hash", F.explode("_near").alias("_n")).select("_hash", "_n.word", "_n.at", "_n.around").distinct()
    met = spots.join(F.broadcast(index), "word")  # a row for each word of a template's prefix
    low = F.greatest(F.col("at") - F.col("width") + 1, F.lit(0))
    around = F.slice("around", low + 1, F.col("at") - low + F.col("width"))
    met = met.select("_hash", "label", "tokens", "must", "need", "width", "size", around.alias("around"), (F.col("at") - low).alias("at"))
    met = met.filter((F.size(F.array_intersect("around", "tokens")) >= F.col("need")) & (F.size(F.array_intersect("around", "must")) == F.size("must")))
    held_by = F.transform(F.sequence(F.lit(1), F.col("at") + 1), lambda i: F.slice(F.col("around"), i, F.col("width")))
    held_by = F.transform(held_by, lambda b: F.when(F.size(F.array_intersect(b, F.col("must"))) == F.size("must"), F.size(F.array_intersect(b, F.col("tokens")))).otherwise(0))
    met = met.withColumn("shared", F.array_max(held_by)).filter("shared >= need")
    found = met.groupBy("_hash").agg(F.array_sort(F.collect_set("label")).alias("_found"), F.max(F.col("shared") / F.col("size")).alias("_share"))
    out = seen.join(found, "_hash", "left")
    added = F.coalesce("_found", F.array().cast("array<string>"))
    n = F.size(every)
    places_of = lambda x, name: [F.size(x).cast("long").alias(f"n_{name}"), F.array_min(x).cast("long").alias(f"first_{name}"), F.array_max(x).cast("long").alias(f"last_{name}")]
    return out.select(
        "doc_id",
        "n_words",
        n.cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(more, added)), ",").alias("labels"),
        F.when(F.size(also) > 0, 1.0).otherwise(F.coalesce("_share", F.lit(0.0))).cast("double").alias("score"),
        *(places_of(of(wider)[0], "wider") if wider else []),
    )


def oracle() -> str:
    """DuckDB SQL for scan_licences over the table documents with the wider phrases, comparing the blocks from every word of a template on with that template."""
    sets = [(label, sorted(set(t.split())), sorted(must.split()), _block(t, THRESHOLD)) for label, t, must in TEMPLATES]
    templates = ", ".join(f"('{label}', {s}, {must or 'CAST([] AS VARCHAR[])'}, {width}, {max(1, math.ceil(THRESHOLD * len(s) - 1e-9))})" for label, s, must, width in sets)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    stands = "list_filter(range(0, len(w)), lambda i: {})"
    places = lambda phrases: ", ".join(stands.format(" AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split()))) for p, _ in phrases)
    labels = lambda phrases, p: ", ".join(f"CASE WHEN len({p}[{k + 1}]) > 0 THEN '{label}' END" for k, (_, label) in enumerate(phrases))
    return f"""
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS k FROM documents),
    words AS (SELECT doc_id, k, regexp_extract_all({lower.format("text")}, '{word}') AS w FROM docs),
    places AS (SELECT doc_id, k, len(w) AS n_words, [{places(PHRASES)}] AS p, [{places(WIDER)}] AS q FROM words),
    base AS (SELECT doc_id, k, n_words, flatten(p) AS f, flatten(q) AS g, list_filter([{labels(PHRASES, "p")}], lambda x: x IS NOT NULL) AS b, list_filter([{labels(WIDER, "q")}], lambda x: x IS NOT NULL) AS c FROM places),
    templates(label, t, must, width, need) AS (VALUES {templates}),
    likely AS (SELECT k, w, label, t, must, width, need FROM words JOIN templates ON len(list_intersect(w, t)) >= need AND len(list_intersect(w, must)) = len(must)),
    blocks AS (SELECT k, label, t, must, need, w[i:i + width - 1] AS b FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM likely) WHERE list_contains(t, w[i])),
    shares AS (SELECT k, label, len(list_intersect(b, t)) / len(t) AS share FROM blocks WHERE len(list_intersect(b, t)) >= need AND len(list_intersect(b, must)) = len(must)),
    found AS (SELECT k, list(DISTINCT label) AS l, max(share) AS share FROM shares GROUP BY k)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(f) AS BIGINT) AS n_base, CAST(list_min(f) AS BIGINT) AS first_word, CAST(list_max(f) AS BIGINT) AS last_word,
           array_to_string(list_sort(list_distinct(b)), ',') AS base_labels,
           array_to_string(list_sort(list_distinct(list_concat(list_concat(b, c), coalesce(l, [])))), ',') AS labels,
           CASE WHEN len(f) + len(g) > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score,
           CAST(len(g) AS BIGINT) AS n_wider, CAST(list_min(g) AS BIGINT) AS first_wider, CAST(list_max(g) AS BIGINT) AS last_wider
    FROM base LEFT JOIN found USING (k)"""
