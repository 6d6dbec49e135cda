"""The pipeline's stages on a small corpus with planted copies and noise."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import bpe


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    rng = np.random.default_rng(0)
    words = [f"{a}{b}" for a in ("river", "stone", "wall", "bridge", "rain", "boat", "hill") for b in ("", "s", "side", "way", "land", "er", "ing")]
    texts = {k: " ".join(rng.choice(words, 200)) for k in range(60)}
    near = texts[3].split()
    near[50] = "changed"
    rows = [(k, t, "en", "s", len(t)) for k, t in texts.items()]
    rows += [(100, texts[5], "en", "s", 1), (101, " ".join(near), "en", "s", 1), (102, " ".join(w.upper() + "%$#!" for w in rng.choice(words, 90)), "en", "s", 1), (103, None, "en", "s", None), (104, "12 34", None, "s", 5), (105, texts[7], None, None, None)]
    rows += [(20, texts[20], "en", "s", 1), (None, texts[9], "en", "s", 1)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path + "/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(50)] + [(102, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(path + "/labels.parquet")
    return path


def test_stages(spark, corpus):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "packing"] and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(corpus + "/documents.parquet")
    columns = docs.columns
    quality = corpus_pipeline.quality(spark, docs, corpus)
    assert quality.columns == columns and {r.doc_id for r in docs.select("doc_id").subtract(quality.select("doc_id")).collect()} <= {102, 103, 104} and quality.filter("doc_id in (102, 103)").count() == 0
    language = corpus_pipeline.language(spark, docs, corpus)
    assert language.columns == columns and {r.doc_id for r in docs.select("doc_id").subtract(language.select("doc_id")).collect()} == {103, 104}
    single = corpus_pipeline.near_duplicates(spark, docs, corpus)
    assert single.columns == columns
    kept = [r.doc_id for r in single.collect()]
    assert len(kept) == len(set(kept)) and set(range(60)) <= set(kept) and not {100, 101, 105, None} & set(kept)


def test_run(spark, corpus):
    from tokenizers import Tokenizer

    got = corpus_pipeline.run(spark, corpus).collect()
    assert {r.doc_id for r in got} == set(range(60))
    tok = Tokenizer.from_file(bpe.default_vocabulary())
    docs = {r.doc_id: r.text for r in spark.read.parquet(corpus + "/documents.parquet").filter(F.col("doc_id") < 60).collect()}
    want = sum(len(tok.encode(t, add_special_tokens=False).ids) + 1 for t in docs.values())
    assert sum(r.length for r in got) == want


def test_empty(spark, corpus, tmp_path):
    docs = spark.read.parquet(corpus + "/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, corpus).count() == 0, name


def _shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_copies_of_every_kind(spark, tmp_path):
    rng = np.random.default_rng(5)
    words = np.array([f"w{k}" for k in range(3000)])
    rows, want = [], set()
    for k in range(0, 600, 2):
        base = list(rng.choice(words, int(rng.integers(60, 400))))
        n, kind = len(base), k // 2 % 4
        extra = list(rng.choice(words, n))
        share = rng.uniform(0.8, 0.9)
        if kind == 0:  # a tail added
            copy = base + extra[: int((n - 4) / share) - n + 4]
        elif kind == 1:  # a tail cut off
            copy = base[: int(np.ceil((n - 4) * share)) + 4]
        elif kind == 2:  # words replaced
            copy = list(base)
            for at in rng.choice(n, max(1, int(n * (1 - share) / 10)), replace=False):
                copy[at] = "other"
        else:  # too little in common
            copy = base[: n // 2] + extra[: n // 2]
        a, b = " ".join(base), " ".join(copy)
        rows += [(k, a), (k + 1, b)]
        x, y = _shingles(a), _shingles(b)
        if len(x & y) >= 0.8 * len(x | y):
            want.add(k + 1)
    assert len(want) > 200
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()}
    assert set(range(600)) - kept == want


def test_copies_of_one_text_that_are_no_copies_of_each_other(spark, tmp_path):
    """The forest's links between edited copies don't hold; the original, which joins them, is found all the same."""
    rng = np.random.default_rng(9)
    words = np.array([f"w{k}" for k in range(5000)])
    rows = []
    for g in range(3):
        base = rng.choice(words, 200)
        rows.append((100 * g, " ".join(base)))
        for k in range(30):
            copy = base.copy()
            copy[rng.choice(np.arange(5, 195), 4, replace=False)] = rng.choice(words, 4)
            rows.append((100 * g + 1 + k, " ".join(copy)))
    sets = {k: _shingles(t) for k, t in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    spokes = sum(alike(a, b) for a in range(1, 31) for b in range(1, a))
    assert spokes < 60 and all(alike(100 * g, 100 * g + k) for g in range(3) for k in range(1, 31))
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).collect()}
    assert kept == {0, 100, 200}


def test_language_rejects_what_fits_no_learnt_language(spark, corpus, tmp_path):
    rng = np.random.default_rng(6)
    docs = spark.read.parquet(corpus + "/documents.parquet")
    unlearnt = ["la mattina il vecchio pescatore usciva con la sua barca e tornava quando il sole era alto sopra le colline", "nessuno sapeva perché avesse scelto di vivere lontano dalla città dove erano nati i suoi figli"]
    letters = [" ".join("".join(rng.choice(list(alphabet), 6)) for _ in range(40)) for alphabet in ("abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя") for _ in range(5)]
    rows = [(1000 + k, t, None, "s", len(t)) for k, t in enumerate(unlearnt + letters)]
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs.union(spark.createDataFrame(rows, docs.schema)), corpus).collect()}
    assert set(range(60)) <= kept and not kept & set(range(1000, 1012))


def test_components_go_on_from_those_there_are(spark, monkeypatch):
    from ledgerloom.llm import components as C

    first = [(k, k - 1) for k in range(1, 60) if k % 10] + [(70, 71), (80, 81)]
    more = [(9, 10), (19, 71), (90, 91), (5, 3), (81, 90)]
    links = lambda rows: spark.createDataFrame(rows, "u long, v long")
    want = sorted(map(tuple, C.connected_components(links(first + more)).collect()))
    root = spark.createDataFrame(C.connected_components(links(first)).collect(), "node long, root long")
    met, star = [], C._star
    monkeypatch.setattr(C, "_star", lambda directed, least: met.append(directed.count()) or star(directed, least))
    assert sorted(map(tuple, C.joined_components(root, links(more)).collect())) == want
    assert max(met) <= len(more)  # the links within the groups that there were aren't walked again


def test_texts_just_too_far_apart_are_told_apart_before_they_are_rows(spark, tmp_path, monkeypatch):
    """Edited copies of one text, of which two share about 0.68: the candidates that are judged grow no faster than the texts."""
    from ledgerloom.llm import near_copies as N

    rng = np.random.default_rng(1)
    words = np.array([f"w{k}" for k in range(5000)])
    base, texts = rng.choice(words, 200), []
    for _ in range(300):
        copy = base.copy()
        copy[rng.choice(np.arange(5, 195), 5, replace=False)] = rng.choice(words, 5)
        texts.append(" ".join(copy))
    texts[150] = texts[20].rsplit(" ", 3)[0]  # and a copy among them
    opened, real = [], N.materialise
    monkeypatch.setattr(N, "materialise", lambda df, label: (out := real(df, label), label == "copies-open" and opened.append(out.count()))[0])
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), str(tmp_path)).collect()}
    assert kept == set(range(300)) - {150}
    assert len(opened) == 3 and sum(opened[1:]) < 300


def test_parities_rule_out_no_copy():
    from ledgerloom.llm.near_copies import may_be_alike, parities

    rng = np.random.default_rng(2)
    rows, alike = [], []
    for k in range(4000):
        n, bits = int(rng.integers(1, 400)), 512
        both = int(rng.integers(0, n + 1)) if k % 4 == 0 else int(n * rng.uniform(0.85, 0.95)) if k % 4 < 3 else 8 * (n // 10)
        made = rng.choice(1 << 32, 2 * n, replace=False).astype("<u4")
        extra = 10 * (n // 10) - both if k % 4 == 3 else n - both  # every fourth pair shares 0.8 to the number
        one, two = made[: both + extra - extra // 2 if k % 4 == 3 else n], np.concatenate([made[:both], made[n : n + (extra // 2 if k % 4 == 3 else extra)]])
        met, total = len(np.intersect1d(one, two)), len(np.union1d(one, two))
        rows.append([np.concatenate([[np.uint64(len(v))], parities(v, bits)]) for v in (one, two)])
        alike.append(total > 0 and met >= 0.8 * total)
    x, y = (np.stack([r[k] for r in rows]).astype(np.uint64) for k in (0, 1))
    may, alike = may_be_alike(x, y, 0.8), np.array(alike)
    assert alike.sum() > 1000 and may[alike].all() and may[~alike].mean() < 0.4
