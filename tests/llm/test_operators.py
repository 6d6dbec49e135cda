"""The training-data operators against brute force, on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, langid, licences, neighbours, packing, quality, search, sharding, simhash, urls

DOC = "doc_id long, text string, lang string, source string, n_chars long, fp long, component_id string, word string, key int, shard string"


def docs_of(spark, texts, lang="en"):
    return spark.createDataFrame([(k, t, lang, None, None, 7, "x", "y", 1, "z") for k, t in texts], DOC)


MIXED = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "The quick brown fox jumps over the lazy dog again and again"), (7, "The quick brown fox jumps over the lazy dog again and again"),
    (8, "the QUICK brown fox jumps over the lazy dog again and again"), (9, "ÀÉ îö   x  y"), (10, "word " * 5000), (11, "x" * 50_000), (12, "日本語 テキスト <|endoftext|> ok"), (None, "one"), (7, "The quick brown fox jumps over the lazy dog again and again"),
]


def brute_fingerprint(text, n=3):
    words = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, linked):
    root = list(range(len(values)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(values)):
        for b in range(a):
            if linked(values[a], values[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(a) for a in range(len(values))]


def test_simhash_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice([f"w{i}" for i in range(300)], 60)) for _ in range(12)]
    texts = list(MIXED) + [(100 + k, t) for k, t in enumerate(base)]
    for k, t in enumerate(base):
        w = t.split()
        for j in range(3):
            w[int(rng.integers(60))] = "changed"
            texts.append((200 + 10 * k + j, " ".join(w)))
    got = simhash.simhash_near_duplicates(docs_of(spark, texts)).collect()
    fps = [brute_fingerprint(t) for _, t in texts]
    assert sorted((r.doc_id or -1, r.fingerprint) for r in got) == sorted((k or -1, f"{f:016x}") for (k, _), f in zip(texts, fps))
    roots = components(fps, lambda a, b: bin(a ^ b).count("1") <= 3)
    least = {}
    for (k, _), r in zip(texts, roots):
        if k is not None:
            least[r] = min(k, least.get(r, k))
    assert {(r.doc_id, r.component_id) for r in got} == {(k, least[r]) for (k, _), r in zip(texts, roots)}


def test_skewed_prefixes_are_parted(spark, monkeypatch):
    """Nearly all fingerprints share their first bits: their node is parted further, and links across leaves of unlike depth are found."""
    monkeypatch.setattr(simhash, "NODE_ROWS", 40)
    rng = np.random.default_rng(8)
    base = [int(v) >> 7 for v in rng.integers(0, 2**63, 250)] + [int(v) for v in rng.integers(0, 2**62, 20)]
    values = set(base)
    for v in base:
        for b in rng.integers(0, 63, 2):
            v ^= 1 << int(b)
        values.add(v)
    values = sorted(values)
    from ledgerloom.llm.components import connected_components

    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in values], "fp long"), 3)
    assert all(bin(r.u ^ r.v).count("1") <= 3 for r in links.collect())
    found = {r.node: r.root for r in connected_components(links).collect()}
    want = components(values, lambda a, b: bin(a ^ b).count("1") <= 3)
    assert [found.get(v, v) for v in values] == [values[r] for r in want]
    leaves = simhash.trie_leaves({0: 1000, 1: 5, 14: 30}, 4)
    assert {b for _, b in leaves} >= {1, 4} and (0, 4) in leaves


def test_rows_without_an_id_link(spark):
    rows = [(5, 0), (None, 0b111), (3, 0b111111), (8, 1 << 40 | 2**30 - 1), (None, -1)]
    got = simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, fp long"), 3).collect()
    assert {(r.doc_id, r.fp): r.component_id for r in got} == {(5, 0): 3, (None, 0b111): 3, (3, 0b111111): 3, (8, 1 << 40 | 2**30 - 1): 8, (None, -1): None}


@pytest.mark.parametrize("budget", [0, 3, 7])
def test_fingerprint_links(spark, budget):
    rng = np.random.default_rng(budget)
    base = rng.integers(-(2**63), 2**63, 150)
    values = {int(v) for v in base}
    for _ in range(3):
        for v in base:
            for b in rng.integers(0, 64, int(rng.integers(1, 9))):
                v ^= np.int64(np.uint64(1) << np.uint64(b)) if b < 63 else np.int64(-(2**63))
            values.add(int(v))
    values = sorted(values)
    from ledgerloom.llm.components import connected_components

    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in values], "fp long"), budget)
    assert all(bin((r.u ^ r.v) & (2**64 - 1)).count("1") <= budget for r in links.collect())
    found = {r.node: r.root for r in connected_components(links).collect()}
    want = components(values, lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= budget)
    assert [found.get(v, v) for v in values] == [values[r] for r in want]


def test_long_text_in_blocks():
    text = " ".join(f"w{i % 977}" for i in range(4000))
    blocks = list(simhash._word_blocks(text.encode(), 100))
    assert [w for b in blocks for w in b] == text.encode().split() and len(blocks) > 10
    assert simhash.fingerprint(text) & (2**64 - 1) == brute_fingerprint(text)


def test_bpe_is_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_vocabulary())
    extra = ["it's 'll\t\tfoo \r\n", "à la carte à  b", "a  b 　c", "\x1c a\x1c b\x85 c", "  lead", "trail  ", "<|endoftext|>", "a <|endoftext|>b", "😀 😀  x", "½ ² ٣ x١"]
    texts = list(MIXED) + [(50 + k, t) for k, t in enumerate(extra)]
    got = bpe.encode_decode(docs_of(spark, texts)).collect()
    want = []
    for k, t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((k or -1, np.array(ids, "<u4").tobytes(), tok.decode(ids, skip_special_tokens=False)))
    assert sorted((r.doc_id or -1, bytes(r.ids), r.decoded) for r in got) == sorted(want)


def test_packing(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_vocabulary())
    got = packing.pack_documents(docs_of(spark, MIXED), capacity=64).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    for k, t in dict(MIXED).items():
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        pieces = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[k])
        first = len(ids) if len(ids) <= 64 else (len(ids) % 64 or 64)
        cuts = [0, *range(first, len(ids) + 1, 64)] if len(ids) > 64 else [0, len(ids)]
        want = [(i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted(set(pieces)) == want
    rows = {}
    for r in got:
        rows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in rows.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in got)
    assert len(rows) <= -(-total // 64) + 2


def test_best_fit_rounds_are_best_fit_decreasing():
    rng = np.random.default_rng(0)
    for _ in range(40):
        sizes = rng.integers(1, 65, int(rng.integers(1, 300))).tolist()
        counts = {n: sizes.count(n) for n in set(sizes)}
        runs = packing.best_fit_rounds(counts, 64)
        used = max(first + (many - 1) // each for _, many, _, first, each, _ in runs) + 1
        gaps = []
        for n in sorted(sizes, reverse=True):
            fit = [g for g in gaps if g >= n]
            if fit:
                gaps.remove(min(fit))
            gaps.append((min(fit) if fit else 64) - n)
        assert used == len(gaps) and sum(r[1] for r in runs) == len(sizes)


def test_sharding(spark):
    got = sharding.shard_by_bytes(docs_of(spark, MIXED), shards=3).collect()
    text = {k: t or "" for k, t in MIXED}
    for r in got:
        raw = text[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    by_text = {}
    for r in got:
        by_text.setdefault(text[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_capacity_is_minimal_with_refinement(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FETCH_GROUPS", 3)
    rng = np.random.default_rng(5)
    for hot in (False, True):
        keys = sorted({int(k) >> 44 << 44 | int(k) & 0xFFFFF for k in rng.integers(-(2**63), 2**63, 400)} | {(7 << 48) + k for k in range(200)})
        sizes = rng.integers(1, 50, len(keys))
        if hot:
            sizes[len(keys) // 2] = sizes.sum() // 2
        groups = spark.createDataFrame([(k, int(s)) for k, s in zip(keys, sizes)], "key long, size long")
        capacity, firsts = sharding.cut_keys(groups, 5)
        assert capacity == sharding.smallest_capacity(sizes, 5)
        load = {}
        for k, s in zip(keys, sizes):
            shard = sum(f is not None and k >= f for f in firsts)
            load[shard] = load.get(shard, 0) + int(s)
        assert max(load.values()) <= capacity


VECTORS = "vec_id long, embedding array<float>, label int, v string, block string, place int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(k, v, 0, "a", "b", 3) for k, v in rows], VECTORS)


def some_vectors():
    rng = np.random.default_rng(1)
    rows = [(k, [float(np.float32(x)) for x in rng.standard_normal(16) * (1 + k % 3) / 4]) for k in range(300)]
    rows += [(400 + k, list(rows[k][1])) for k in range(30)]  # copies: ties
    return rows + [(20_000, None), (20_020, [None] * 16), (20_040, [float("nan")] * 16), (20_060, [float("inf")] * 16), (20_080, [1.0]), (20_100, []), (None, [1.0] * 16), (20_120, [0.0] * 16)]


def test_exact_top_k(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_ROWS", 64)
    monkeypatch.setattr(search, "PART", 16)
    monkeypatch.setattr(search, "CHUNK_QUERIES", 8)
    rows = some_vectors() + [(41, [0.5] * 16), (41, [0.5] * 16)]
    plan = search.exact_top_k(vectors_of(spark, rows), F.col("vec_id") % 20 == 0, k=7)
    assert "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()
    got = plan.collect()
    good = [(k, np.floor(np.array(v, np.float64) * 64).astype(int)) for k, v in rows if k is not None and v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, x in good:
        if q % 20 == 0:
            scored = sorted((-int(x @ y), k) for k, y in good if k != q)[:7]
            want += [(q, n + 1, k, -s) for n, (s, k) in enumerate(scored)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)


def recall_of(got, rows, k, d):
    """Recall at k against brute force; every score and order is checked."""
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and len(v) == d and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, m = np.array([i for i, _ in good]), np.array([v for _, v in good])
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    queries = sorted({int(i) for i in ids if i % 20 == 0})
    assert sorted(found) == queries
    hits = total = 0
    for q in queries:
        scores = m @ m[np.flatnonzero(ids == q)[0]]
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != q][:k]
        own = sorted(found[q])
        assert [r for r, _, _ in own] == list(range(1, len(order) + 1))
        assert [(-s, i) for _, i, s in own] == sorted((-s, i) for _, i, s in own)
        assert all(any(np.isclose(s, x, rtol=1e-9, atol=1e-9 * max(1, abs(scores).max())) for x in scores[ids == i]) for _, i, s in own)
        least = scores[order[-1]]
        hits += sum(s >= least - 1e-9 * abs(least) for _, _, s in own)
        total += len(order)
    return hits / total


@pytest.mark.parametrize("cells", [1, 6])
def test_nearest_by_codes(spark, monkeypatch, cells):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 64)
    monkeypatch.setattr(neighbours, "MOST_CELLS", cells)
    monkeypatch.setattr(neighbours, "CHUNK_QUERIES", 8)
    monkeypatch.setattr(neighbours, "QUERY_PART", 4)
    monkeypatch.setattr(neighbours, "PART", 32)
    rows = some_vectors()
    rows += [(20, [float(np.float32(x * 1e22)) for x in rows[20][1]]), (21, rows[21][1]), (21, rows[21][1])]  # an id with two vectors, and a repeated row
    rows = [(k, v) for k, v in rows if not (k == 20 and max(v) < 1e3)]
    got = neighbours.nearest_by_codes(vectors_of(spark, rows), F.col("vec_id") % 20 == 0, k=10).collect()
    assert recall_of(got, rows, 10, 16) >= 0.9


def test_nearest_on_clusters(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 32))
    points = centres[rng.integers(0, 12, 3000)] + 0.3 * rng.standard_normal((3000, 32))
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(points)]
    got = neighbours.nearest_by_codes(vectors_of(spark, rows), F.col("vec_id") % 20 == 0, k=20).collect()
    assert recall_of(got, rows, 20, 32) >= 0.9


def test_counts_of_bits():
    rng = np.random.default_rng(2)
    turned = rng.standard_normal((5, 128))
    low, step, planes = neighbours._planes(turned)
    codes = rng.integers(0, 2**64, (7, 2), np.uint64)
    signs = np.unpackbits(codes.view(np.uint8), axis=1, bitorder="little")
    level = np.rint((turned - low[:, None]) / step[:, None])
    assert (neighbours._counts(planes, codes) == level @ signs.T).all()


@pytest.mark.parametrize("f", [search.exact_top_k, neighbours.nearest_by_codes])
def test_search_of_few(spark, f):
    assert f(vectors_of(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert f(vectors_of(spark, [(0, [1.0, 2.0])]), F.col("vec_id") % 20 == 0).count() == 0
    assert [r.vec_id for r in f(vectors_of(spark, [(0, [1.0, 2.0]), (3, [1.0, 0.5])]), F.col("vec_id") % 20 == 0).collect()] == [3]


def test_segmentations_are_summed():
    tool = langid.pieces_of(langid.default_pieces())
    p = np.random.default_rng(0).random((len(tool.pieces), 2))
    p /= p.sum(0)
    number = {b: k for k, b in enumerate(tool.pieces)}

    def brute(word, l):
        if not word:
            return 1.0
        return sum(p[number[word[:n]], l] * brute(word[n:], l) for n in range(1, len(word) + 1) if word[:n] in number)

    words = [b" the", b" tion", "é".encode(), b" a", b"zq"]
    got = tool.log_probabilities(words, p * np.exp(langid.SHIFT * tool.length)[:, None])
    assert np.allclose(np.exp(got), [[brute(w, l) for l in (0, 1)] for w in words])
    # expected counts: every byte is covered once by every segmentation
    found = tool.expected(words, np.ones(len(words)), (p * np.exp(langid.SHIFT * tool.length)[:, None])[:, 0])
    assert np.isclose((found * tool.length).sum(), sum(map(len, words)))


def test_long_runs_of_letters_count_whole(monkeypatch):
    tool = langid.pieces_of(langid.default_pieces())
    rng = np.random.default_rng(1)
    p = rng.random((len(tool.pieces), 2)) ** 3
    p /= p.sum(0)
    number = {b: k for k, b in enumerate(tool.pieces)}

    def brute(word):
        """The logarithm of the sum over all segmentations, with big exponents kept apart."""
        sums = [np.zeros(2)] + [None] * len(word)
        for end in range(1, len(word) + 1):
            terms = [sums[a] + np.log(p[number[word[a:end]]]) for a in range(max(0, end - tool.longest), end) if word[a:end] in number]
            sums[end] = np.logaddexp.reduce(terms)
        return sums[-1]

    words = [b" " + b"internationalization" * 20, b" the", ("\u6771\u4eac\u90fd" * 60).encode(), b" " + bytes(rng.integers(97, 123, 300).tolist()), b" a"]
    weights = p * np.exp(langid.SHIFT * tool.length)[:, None]
    want = np.array([brute(w) for w in words])
    assert np.allclose(tool.log_probabilities(words, weights), want, rtol=1e-9)
    # pieces cover every byte once, in words of every length
    found = tool.expected(words, np.array([1.0, 2, 1, 1, 3]), weights[:, 0])
    assert np.isclose((found * tool.length).sum(), np.array([1.0, 2, 1, 1, 3]) @ [len(w) for w in words])
    monkeypatch.setattr(langid, "LONG_RUN", 70)
    assert np.allclose(tool.log_probabilities(words, weights), want, rtol=1e-9)


def test_language(spark):
    english = "the house and the garden are where they were when we came with those who know this"
    german = "das haus und der garten sind dort wo sie waren als wir mit denen kamen die das wissen"
    rng = np.random.default_rng(0)
    rows = []
    for k in range(120):
        words = (english if k % 2 else german).split()
        rows.append((k, " ".join(rng.choice(words, 30)), "en" if k % 2 else "de", None, None, 7, "x", "y", 1, "z"))
    rows += [(900, None, "en", *[None] * 7), (901, "12 34 !!", "en", *[None] * 7), (902, "", None, *[None] * 7), (None, english, None, *[None] * 7), (903, german.upper() * 400, None, *[None] * 7), (904, "²½", None, *[None] * 7)]
    got = langid.identify_languages(spark.createDataFrame(rows, DOC)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[k].lang_pred == ("en" if k % 2 else "de") for k in range(120))
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (900, 901, 902, 904)) and by[903].lang_pred == "de" and by[None].lang_pred == "en"
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.identify_languages(docs_of(spark, [])).count() == 0
    assert {r.lang_pred for r in langid.identify_languages(docs_of(spark, [(1, "hello there")], None)).collect()} == {"und"}


def test_languages_in_blocks(spark, monkeypatch):
    """More languages than are scored together: the same predictions and posteriors as with all at once."""
    rng = np.random.default_rng(1)
    letters = ["abcde", "fghij", "klmno", "pqrst", "uvwxy", "acegi", "bdfhj"]
    rows = [(k, " ".join("".join(rng.choice(list(letters[k % 7]), 4)) for _ in range(12)), f"l{k % 7}", *[None] * 7) for k in range(140)]
    rows += [(900, None, "l1", *[None] * 7), (901, "12", None, *[None] * 7), (None, "abcde", None, *[None] * 7), (5, rows[5][1], "l5", *[None] * 7), (902, "ace bdf", None, *[None] * 7)]
    docs = spark.createDataFrame(rows, DOC)

    def found():
        return sorted(((r.doc_id is None, r.doc_id or 0, r.lang_pred, r.n_bytes, r.held_out, round(r.score, 6), None if r.fit is None else round(r.fit, 6)) for r in langid.identify_languages(docs).collect()), key=str)

    whole = found()
    for size in (3, 1):
        monkeypatch.setattr(langid, "BLOCK_LANGS", size)
        assert found() == whole
    assert len(whole) == len(rows) and {r[2] for r in whole} == {f"l{k}" for k in range(7)} | {"und"}


def brute_kn(grams, trained, order):
    """Log probabilities by the textbook recursion."""
    counts = {order: dict(trained)}
    for k in range(order - 1, 0, -1):
        counts[k] = {}
        for g in counts[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + (counts[k + 1][g] if g[1] == "\x02" else 1)

    def discounts(c):
        n = {k: sum(1 for v in c.values() if v == k) for k in (1, 2, 3, 4)}
        y = n[1] / max(1, n[1] + 2 * n[2])
        return [min(k, max(0.1, k - (k + 1) * y * n[k + 1] / n[k])) if n[k] else 0.5 * k for k in (1, 2, 3)]

    d = {k: discounts(c) for k, c in counts.items()}

    def p(g):
        k = len(g)
        base = 1 / (len(counts[1]) + 1) if k == 1 else p(g[1:])
        own = [c for h, c in counts[k].items() if h[:-1] == g[:-1]]
        if not own:
            return base
        less = lambda c: d[k][min(c, 3) - 1]
        c = counts[k].get(g, 0)
        return (max(0, c - less(c)) if c else 0) / sum(own) + sum(map(less, own)) / sum(own) * base

    return {g: np.log(p(g)) for g in grams}


def test_kneser_ney(spark):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcd"), int(rng.integers(1, 6)))) for _ in range(200)]
    texts = [(1, "  ".join(words)), (2, None), (3, ""), (4, "ab"), (5, "ab")]
    trained = quality.gram_counts(docs_of(spark, texts), 3)
    counts = {r.gram: r.n for r in trained.collect()}
    padded = ["\x02\x02" + " ".join(t.split()) + "\x03" for _, t in texts if t]
    want = {}
    for w in padded:
        for i in range(len(w) - 2):
            want[w[i : i + 3]] = want.get(w[i : i + 3], 0) + 1
    assert counts == want
    asked = [*counts, "zzz", "abz", "\x02\x02z"]
    got = quality.log_probabilities(spark.createDataFrame([(g, 1) for g in asked], "gram string, n long"), trained, 3)
    brute = brute_kn(asked, counts, 3)
    found = {r.gram: r.logp for r in got.collect()}
    assert found.keys() == brute.keys() and all(abs(found[g] - brute[g]) < 1e-9 for g in asked)


@pytest.mark.parametrize("head", [0, 2, 100])
def test_perplexities_with_and_without_head(spark, monkeypatch, head):
    monkeypatch.setattr(quality, "BLOCK_CHARS", 7)
    grams = {"\x02\x02a": -1.0, "\x02a ": -2.0, "a a": -3.0, " ab": -4.0, "ab\x03": -5.0, "\x02ab": -6.0, "a\x03": -9.0, " a ": -0.5, "\ufffda ": -7.0, "\x02\x02\ufffd": -8.0, "\x02\ufffda": -1.5, "a\x03\x03": -9.0}
    grams = {g: v for g, v in grams.items() if len(g) == 3}
    table = spark.createDataFrame([(g, k, v) for k, (g, v) in enumerate(grams.items(), 1)], "gram string, n long, logp double")
    texts = [(1, "a  a a ab\n"), (2, None), (3, " "), (None, "ab"), (1, "a  a a ab\n")]

    def brute(t):
        p = "\x02\x02" + " ".join(t.split()) + "\x03"
        return len(p) - 2, float(np.exp(-np.mean([grams[p[i : i + 3]] for i in range(len(p) - 2)])))

    got = quality.perplexities(docs_of(spark, texts), table, 3, head=head).collect()
    want = [(k or -1, *((0, None) if not (t or "").strip() else brute(t))) for k, t in texts]
    key = lambda v: (v[0], v[1])
    assert [(a, n, p and round(p, 9)) for a, n, p in sorted([(r.doc_id or -1, r.n_grams, r.perplexity) for r in got], key=key)] == [(a, n, p and round(p, 9)) for a, n, p in sorted(want, key=key)]


def test_quality_keeps_clean_and_rejects_noise(spark):
    rng = np.random.default_rng(0)
    words = "the river runs along old stone walls and under bridges where people stand in rain to watch boats pass".split()
    clean = [(k, " ".join(rng.choice(words, 40))) for k in range(80)]
    noise = [(500 + k, " ".join(w.upper() + "$%#" for w in rng.choice(words, 40))) for k in range(5)]
    labels = spark.createDataFrame([(k, 1, 0, "x") for k in range(60)] + [(500, 0, 0, "x"), (None, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    got = quality.classify_quality(docs_of(spark, clean + noise + [(900, None), (901, "  ")]), labels).collect()
    assert {r.doc_id for r in got if not r.keep} == {k for k, _ in noise} | {900, 901}
    nothing = quality.classify_quality(docs_of(spark, clean[:3]), labels.limit(0)).collect()
    assert all(r.keep and r.threshold is None for r in nothing) and len(nothing) == 3
    assert quality.classify_quality(docs_of(spark, []), labels).count() == 0


LICENCE_DOCS = [
    (1, None), (2, ""), (3, "Released under the MIT License.\nthe mit license, the MIT-license"), (4, "THE\nMIT license"), (5, "Licensed under the Apache License, Version 2.0."), (6, "cc by-nc 4.0 and Licensed under CC BY-NC 4.0."),
    (7, "mit license"), (8, "This work is licensed under the GNU General Public License, version 3."), (9, "work licensed under the GNU General Public License, version"), (10, "ithe mit licenses the éMIT license"), (11, "a b c " * 20_000 + "the mit license"),
    (12, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"), (3, "Released under the MIT License.\nthe mit license, the MIT-license"), (None, "the mit license"),
    (13, "Copyright 2020\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software"),
    (14, " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:"), (15, "released under the BSD license"), (16, "Licensed under CC BY 4.0"),
    (17, "you may not use this file except in " + "filler " * 40 + "compliance with the License. You may obtain a copy of the License at"), (18, "x " * 300 + "released\nunder\nthe\nMIT\n\nterms and license " + "y " * 300), (19, "licensed by apache and under version 2, by license 0 of the tribe"),
]


def test_licences(spark):
    got = licences.scan_licences(docs_of(spark, LICENCE_DOCS)).collect()
    want = []
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for k, t in LICENCE_DOCS:
        t = (t or "").encode().translate(lower).decode()
        words = word.findall(t)
        base = [(i, label) for phrase, label in licences.PHRASES for p in [phrase.split()] for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        share = {}
        for label, template, must in licences.TEMPLATES:
            held, width = set(template.split()), int(np.ceil(len(template.split()) / licences.THRESHOLD - 1e-9))
            for at in range(max(1, len(words) - width + 1) if len(words) < 5000 else 0):
                block = set(words[at : at + width])
                x = len(block & held) / len(held)
                if x >= licences.THRESHOLD and set(must.split()) <= block:
                    share[label] = max(x, share.get(label, 0))
        own = sorted({label for _, label in base})
        want.append((k or -1, len(words), len(base), min((i for i, _ in base), default=None), max((i for i, _ in base), default=None), ",".join(own), ",".join(sorted({*own, *share})), 1.0 if base else max(share.values(), default=0.0)))
    assert sorted(map(str, want)) == sorted(str((r.doc_id or -1, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)) for r in got)
    by = {k: v[6] for k, *v in [(w[0], *w) for w in want]}
    assert by[13] == "mit" and by[14] == "bsd-3" and by[15] == by[16] == by[17] == "" and by[18] == "mit"
    assert licences.scan_licences(docs_of(spark, [])).count() == 0


def test_licences_of_the_contract(spark):
    """The contract's phrases with their first words, and what stands next to them."""
    texts = [
        (1, "the MIT license"), (2, "Released UNDER the MIT license, under\x00the mit license"), (3, "\u00e9under the mit license"), (4, "under the mit licenses"), (5, "under under the mit license the mit license"),
        (6, "use Apache-License, VERSION 2.0; CC-BY-NC"), (7, "apache license version 20"), (8, "under\u00a0the mit license"), (9, "\u212a under the m\u0130t license cc by nc"), (10, None),
    ]
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licences.scan_licences(docs_of(spark, texts)).collect()}
    none = (0, None, None, "")
    assert got == {
        1: (3, *none), 2: (9, 2, 1, 5, "mit"), 3: (4, *none), 4: (4, *none), 5: (8, 1, 1, 1, "mit"), 6: (9, 2, 1, 6, "apache-2,cc-by-nc"), 7: (4, *none), 8: (3, *none), 9: (8, 1, 5, 5, "cc-by-nc"), 10: (0, *none),
    }


def test_op6_keeps_the_grants_that_the_contract_leaves_out(spark, tmp_path):
    """"the mit license" without the word before: no base phrase, but labelled, scored and placed by the query as by its SQL."""
    import duckdb

    from ledgerloom.llm.queries import ORACLES, QUERIES

    texts = [
        (1, "see the MIT\nlicense"), (2, "released under the MIT license, as is the mit license of x"), (3, "a b c " * 20_000 + "the mit license"), (4, "the bsd license"), (5, "the mit license; cc by nc"), (6, None),
    ]
    docs_of(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, QUERIES["op6_licences"](spark, str(tmp_path)).select("doc_id", "n_base", "first_word", "base_labels", "labels", "score", "n_wider", "first_wider", "last_wider").collect()))
    assert got == [
        (1, 0, None, "", "mit", 1.0, 1, 1, 1), (2, 1, 1, "mit", "mit", 1.0, 2, 2, 7), (3, 0, None, "", "mit", 1.0, 1, 60_000, 60_000), (4, 0, None, "", "", 0.0, 0, None, None),
        (5, 1, 3, "cc-by-nc", "cc-by-nc,mit", 1.0, 2, 0, 3), (6, 0, None, "", "", 0.0, 0, None, None),
    ]
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(duck.execute(ORACLES["op6_licences"]).fetchall(), key=str) == sorted((tuple(r) for r in QUERIES["op6_licences"](spark, str(tmp_path)).collect()), key=str)


def test_urls(spark):
    pages = [
        (1, None), (2, ""), (3, "no scheme example.org/es/"), (4, "https://EXAMPLE.org/es/x?y#z"), (5, "http://a.example.org/en/1"), (6, "http://a.example.org/en/123"), (7, "http://example.org"), (8, "http://shop.com/fr/2"), (9, "http://shop.com/de/2"),
        (10, "http://org/es/"), (11, "http://notorg/"), (12, "http://example.orgs/"), (13, "http://cheap-pills.example.com/en/1"), (14, "http://www.spam-farm.net/"), (15, "ftp://x.com/FR/"), (16, "http://h?x/y"), (17, "http://com/fr/#a"), (4, "https://EXAMPLE.org/es/x?y#z"), (None, "http://a.org/"), (18, "http://a.example.org/es/" + "x" * 5000),
        (19, "http://best-casino.net/x"), (20, "http://www.casino-city.museum.net/x"), (21, "http://casinos.net/"), (22, "http://adult-education.net/a"), (23, "http://casino.net"),
    ]
    frame = spark.createDataFrame([(k, u, "h", "t", "r") for k, u in pages], "page_id long, url string, host string, target string, rule string")
    got = urls.judge_urls(frame).collect()
    want = []
    for k, u in pages:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)

        def fits(rule):
            h, _, p = rule.partition("/")
            return (host == h or host.endswith("." + h)) and path.startswith("/" + p)

        own = max(((len(r), r, v) for v, r in urls.LISTED_RULES if fits(r)), default=None)
        held = re.split("[^a-z0-9]+", host)
        spam = path and set(held) & set(urls.HOST_WORDS) and not any(a in held and b in held[held.index(a) + 1 :] for a, b in [re.findall("[a-z]+", r) for r in urls.EXCEPTIONS])
        want.append((k or -1, host, path, own and own[1], own[2] if own else "block" if spam else "allow"))
    assert sorted(map(str, want)) == sorted(str((r.page_id or -1, r.host, r.path, r.rule, r.verdict)) for r in got)
    with pytest.raises(ValueError):
        urls.judge_urls(frame, listed=[("block", "*x*")])
    assert {r.verdict for r in urls.judge_urls(frame, listed=[], patterns=[]).collect()} == {"allow"}
    assert urls.judge_urls(frame.limit(0)).count() == 0


@pytest.mark.parametrize("rule,good,bad", [
    ("example.org/a*z/", ["example.org/abcz/", "x.example.org/az/q"], ["example.org/abc/", "example.orgs/az/"]), ("shop.*.net/", ["shop.x.net/", "a.shop.b.c.net/y"], ["shops.x.net/", "shop.x.org/net/"]),
    ("*^ads^*/", ["ads.x/", "my-ads.x/", "x.ads/q"], ["loads.x/", "x.org/ads/"]), ("x.org/a/^id^", ["x.org/a/id", "x.org/a/id=3", "x.org/a/id/"], ["x.org/a/ids"]), ("x.org/end|", ["x.org/end", "y.x.org/end"], ["x.org/ending", "x.org/end/"]),
])
def test_rule_language(rule, good, bad):
    assert all(re.match(urls.rule_pattern(rule), g) for g in good) and not any(re.match(urls.rule_pattern(rule), b) for b in bad)


def test_index_fetches_few_candidates(spark):
    rng = np.random.default_rng(3)
    rules = [("block" if k % 2 else "allow", f"host{k % 700}.com/p{k}/") for k in range(3000)] + [("block", f"*^word{k}^*/") for k in range(1000)]
    targets = [f"{'www.' * (k % 2)}host{rng.integers(800)}.com/p{rng.integers(3500)}/x" for k in range(300)] + [f"a-word{k * 7}.net/" for k in range(100)]
    frame = spark.createDataFrame([(k, "http://" + t) for k, t in enumerate(targets)], "page_id long, url string")
    found = urls.candidate_rules(frame.select(F.substring("url", 8, 1000).alias("target")).distinct(), [(v, r, 1) for v, r in rules])
    assert found.count() <= 2 * len(targets)  # of 4000 rules
    got = {r.page_id: r.verdict for r in urls.judge_urls(frame, listed=rules[:3000], patterns=rules[3000:]).collect()}
    compiled = [(len(r), r, v, re.compile(urls.rule_pattern(r))) for v, r in rules]
    for k, t in enumerate(targets):
        own = max(((n, r, v) for n, r, v, p in compiled if p.match(t)), default=None)
        assert got[k] == (own[2] if own else "allow")


@pytest.mark.parametrize("f", [simhash.simhash_near_duplicates, bpe.encode_decode, packing.pack_documents, sharding.shard_by_bytes])
def test_empty_tables(spark, f):
    assert f(docs_of(spark, [])).count() == 0


def test_sha_of_ids(spark):
    row = bpe.encode_decode(docs_of(spark, [(1, "hello world")])).select(F.sha2("ids", 256).alias("h"), "ids").first()
    assert row.h == hashlib.sha256(bytes(row.ids)).hexdigest()


def test_quality_learns_from_every_trusted_document(spark):
    """All good documents of the labels take part, however many there are; one id in five is held out."""
    n = 60_000
    labels = spark.range(n + 10).select(F.col("id").alias("doc_id"), (F.col("id") < n).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    labels = labels.unionByName(spark.createDataFrame([(0, 1, 1), (1, 0, 0), (2, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int"))
    got = quality.trusted_ids(labels)
    held = {r.held_out: r.n for r in got.groupBy("held_out").agg(F.count("*").alias("n")).collect()}
    assert held[True] + held[False] == n - 2 and got.select("doc_id").distinct().count() == n - 2
    assert 0.15 < held[True] / n < 0.25 and got.filter("doc_id in (0, 1)").count() == 0
