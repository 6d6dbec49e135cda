"""Lexical search, collocations and suffix dedup against brute force, on small tables with nulls, ties, repeated rows, long texts and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerloom.llm import collocations, fingerprints, lexical, suffixes

DOC = "doc_id long, text string, lang string, source string, n_chars long, key string, rank int, score string, term string, block long, spans string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, rows):
    return spark.createDataFrame([(k, t, lang, None, None, "x", 1, "y", "z", 2, "w") for k, t, lang in rows], DOC)


def words(rng, n, size=40):
    return " ".join(rng.choice([f"w{i}" for i in range(size)], n))


# lexical search


def brute_ranks(docs, items, k=10):
    def terms(t):
        return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(LOW))

    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m, score = 25 + 75 * sum(c.values()) * n_docs // n_terms, 0
            for w in terms(text):
                if w in c:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, rank, None if missing else i, -s) for rank, (s, missing, i) in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.mark.parametrize(("block_docs", "query_bytes"), [(7, 200), (4096, 8 << 20)])
def test_lexical_matches_brute_force(spark, monkeypatch, block_docs, query_bytes):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block_docs)
    rng = np.random.default_rng(1)
    docs = [(k, words(rng, int(rng.integers(1, 60)))) for k in range(150)]
    docs += [(200, None), (201, ""), (202, " .,; "), (None, "W1 w2 w3"), (None, "w1 w2 w3"), (7, "w1 w2 w3"), (7, "w1 w2 w3"), (203, "É é ß w1 日本 w2"), (204, "rare " + "w5 " * 20_000)]
    items = [(k, words(rng, 8)) for k in range(12)] + [(50, None), (51, "  "), (52, "RARE w5 w5 É"), (53, "unheard of"), (None, "w1"), (52, "w9-w8/w7")]
    found = lexical.rank_documents(docs_of(spark, [(i, t, "en") for i, t in docs]), spark.createDataFrame(items, "item_id long, text string"), query_bytes=query_bytes)
    assert Counter(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect())) == Counter(brute_ranks(docs, items))


def test_lexical_makes_few_accumulators():
    rng = np.random.default_rng(2)
    rare, common = np.sort(rng.choice(5000, 30, replace=False)), np.arange(5000)
    lists = {0: (rare.astype(np.int32), np.full(30, 900_000), 900_000), 1: (common.astype(np.int32), rng.integers(1, 900, 5000), 900)}
    made: list[int] = []
    at, scores = lexical.accumulate([(0, 50), (1, 3)], lists, 5000, 10, 0, made)
    assert made == [30] and set(at) <= set(rare)
    want = sorted((50 * 900_000 + 3 * int(lists[1][1][r]) for r in rare), reverse=True)[:10]
    assert sorted(scores.tolist(), reverse=True)[:10] == want
    at, _ = lexical.accumulate([(0, 50), (1, 3)], lists, 5000, 10, 10**12, made)  # a k-th score that none reaches
    assert made[1] == 0 and not len(at)


def test_lexical_empty_tables(spark):
    none, some = docs_of(spark, []), docs_of(spark, [(1, "a b", "en")])
    items = spark.createDataFrame([("q", "a")], "item_id string, text string")
    assert lexical.rank_documents(none, items).collect() == []
    assert lexical.rank_documents(some, items.limit(0)).collect() == []
    assert [tuple(r) for r in lexical.rank_documents(docs_of(spark, [(1, "a b", "en"), (2, "c", "en")]), items).select("item_id", "rank", "doc_id").collect()] == [("q", 1, 1)]


# collocations


def brute_phrases(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOW)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cand.items():
            score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            inside = any(100 * b >= 80 * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items())
            if not inside:
                kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return out


@pytest.mark.parametrize(("bits", "block_bytes", "tally"), [(64, 4 << 20, 3_000_000), (64, 60, 50), (7, 300, 40), (3, 4 << 20, 3_000_000)])
def test_collocations_match_brute_force(spark, monkeypatch, bits, block_bytes, tally):
    """Short fingerprints collide; small blocks cut pieces; small tallies are handed on early."""
    monkeypatch.setattr(collocations, "TALLY", tally)
    rng = np.random.default_rng(4)
    rows = [(k, words(rng, int(rng.integers(1, 30)), 9).replace("w1 ", "w1, ").replace("w2 w3", "W2 \t w3"), ["en", "de", None, "und"][k % 4]) for k in range(160)]
    rows += [(1, "new york city  hall. New York City hall!", "en")] * 12 + [(2, None, "en"), (3, "", None), (4, " \t . ; \n", "fr"), (5, "é ü 日本 " * 40, "de"), (None, "x " * 3000, "long"), (6, "y" * 5000, "long")]
    found = collocations.mine_collocations(docs_of(spark, rows), least=8, top=40, bits=bits, block_bytes=block_bytes)
    got = [tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert sorted(got) == sorted(brute_phrases(rows, 8, 40))


def test_collocations_by_broadcast_or_shuffle_and_empty(spark, monkeypatch):
    rows = [(1, "a b c. a b d", "en")] * 10
    want = sorted(brute_phrases(rows, 8, 40))
    for most in (0, 1_000_000):
        monkeypatch.setattr(collocations, "BROADCAST_POINTERS", most)
        assert sorted(tuple(r) for r in collocations.mine_collocations(docs_of(spark, rows), least=8).collect()) == want
    assert collocations.mine_collocations(docs_of(spark, [])).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    a = 5 * 10**12
    phrases = spark.createDataFrame([("en", 1, "x", a + 1), ("en", 1, "y", a + 7), ("en", 2, "x y", a)], "lang string, n int, phrase string, f long")
    row = collocations.score_phrases(phrases, spark.createDataFrame([("en", 3 * a)], "lang string, total long")).first()
    assert row["score"] == 2_000_000 * a // (2 * a + 8)


# suffixes


def brute_repeats(rows, depth=100):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, suffix_key(rows[k][1])))
    seen, out = set(), [None] * len(rows)
    for k in order:
        raw = (rows[k][1] or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - depth + 1):
            w = raw[s : s + depth]
            if w in seen:
                gone[s : s + depth] = b"\1" * depth
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[k] = (rows[k][0], len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def suffix_key(text):
    return hashlib.sha256((text or "").encode()).digest()[:16]


def edited(rng, text, edits):
    parts = list(text)
    for _ in range(edits):
        at = int(rng.integers(len(parts)))
        parts[at : at + int(rng.integers(3))] = [chr(97 + int(rng.integers(26)))] * int(rng.integers(3))
    return "".join(parts)


@pytest.mark.parametrize("segment", [2 << 20, 300])
def test_suffixes_match_brute_force(spark, segment):
    rng = np.random.default_rng(5)
    base = [words(rng, int(rng.integers(30, 200)), 400) for _ in range(12)]
    rows = [(k, t, "en") for k, t in enumerate(base)]
    rows += [(50 + 10 * k + j, edited(rng, t, j), "en") for k, t in enumerate(base) for j in range(4)]
    rows += [(300 + k, words(rng, 20, 400) + base[k][50:260] + words(rng, 20, 400) + base[k][:120], "en") for k in range(12)]
    rows += [(400, "x" * 900, "en"), (401, "xy" * 300, "en"), (402, "z" + "x" * 250, "en"), (403, (base[0][:70] + " ") * 9, "en"), (404, base[1] * 5, "en"), (405, "é" * 120 + "日本" * 60, "en"), (406, "q" + "é" * 120, "en")]
    rows += [(407, None, "en"), (408, "", "en"), (409, "y" * 99, "en"), (410, "y" * 99, "en"), (411, "y" * 100, "en"), (412, "y" * 101, "en"), (413, base[2][:99] + "\0", "en")]
    rows += [(None, base[3], "en"), (None, base[3] + " tail", "en"), (None, None, "en"), (7, base[7], "en"), (7, base[7], "en"), (8, "other " + base[4], "en"), (8, base[4] + " other", "en")]
    rng.shuffle(rows)
    rows = [(None if r[0] is None else int(r[0]), r[1], r[2]) for r in rows]
    found = suffixes.remove_repeats(docs_of(spark, rows).repartition(3), segment=segment)
    got = [tuple(r) for r in found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert Counter(got) == Counter(brute_repeats(rows))


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh"])
def test_suffixes_of_few_letters(spark, alphabet):
    """Anchors occur often and runs are cut in many ways."""
    random.seed(6)
    base = "".join(random.choices(alphabet, k=3000))
    rows = []
    for k in range(60):
        a, b = sorted(random.sample(range(3000), 2))
        rows.append((k, base[a : min(b, a + 400)] + "".join(random.choices(alphabet, k=random.randrange(60))) + base[b : b + random.randrange(90, 180)], "en"))
    found = suffixes.remove_repeats(docs_of(spark, rows), segment=400)
    assert Counter(tuple(r) for r in found.collect()) == Counter(brute_repeats(rows))


def test_suffixes_empty_table_and_depth(spark):
    assert suffixes.remove_repeats(docs_of(spark, [])).collect() == []
    with pytest.raises(ValueError):
        suffixes.remove_repeats(docs_of(spark, []), depth=30)
    rows = [(1, "abcdefghij" * 12 + "k", "en"), (2, "z" + "abcdefghij" * 12, "en")]
    assert Counter(tuple(r) for r in suffixes.remove_repeats(docs_of(spark, rows), depth=64).collect()) == Counter(brute_repeats(rows, 64))


# fingerprints


def test_prefix_polynomials_and_bit_maps(spark):
    poly = fingerprints.polynomial(21)
    data = np.frombuffer(b"abcabcabd" * 50, np.uint8)
    prefix = poly.prefixes(data)
    values = poly.runs(prefix, np.arange(400), np.arange(400) + 9)
    assert len(np.unique(values)) == 9 and values[0] == values[9]
    found = spark.createDataFrame([(v,) for v in values.view(np.int64).tolist()], "fp long")
    bits = fingerprints.bit_map(found, "fp", 400)
    assert fingerprints.in_map(bits, values).all()
    others = fingerprints.mixed(np.arange(100_000, dtype=np.uint64))
    assert fingerprints.in_map(bits, others).mean() < 0.01
