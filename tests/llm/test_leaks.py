"""Leaked test passages against a plain search for eight words in a row."""

import numpy as np
import pytest

from placewright.llm import leaks
from placewright.llm import queries as q


def _plain(docs, items):
    read = leaks._reader()
    grams = lambda t: {tuple(w[k : k + 8]) for w in read(t or "") for k in range(len(w) - 7)}
    held = [(i, grams(t)) for i, t in items]
    return {(d, i) for d, t in docs for g in [grams(t)] for i, h in held if g & h}


def test_found_equals_plain_search(spark, root):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{root}/eval_items.parquet").select("item_id", "text").collect()]
    got = [tuple(r) for r in q.p8_found(spark, root).collect()]
    assert len(got) == len(set(got)) and set(got) == _plain(docs, items) and got


ITEM = "Quel vieux sentier relie l’étang perdu de Vougaril au pressoir fermé de Trelmisk en hiver ?"
OTHER = "Which of the seven silent bridges over the river Dumask was painted twice by Olvund?"


@pytest.mark.parametrize("rank", [1, 64])
def test_cases(spark, monkeypatch, rank):
    monkeypatch.setattr(leaks.latent_terms, "__defaults__", (rank, 2, 1))
    docs = [
        (1, "Avant. Quel vieux sentier relie l'etang perdu de Vougaril au moulin."),
        (2, "QUEL vieux sen-\r\ntier re­lie l&rsquo;&eacute;tang per​du de Vougaril"),
        (3, "Quel vieux sentier relie l’étang perdu"),
        (4, "perdu étang l’ relie sentier vieux Quel de Vougaril au pressoir"),
        (5, None), (6, ""), (7, "  \n "), (8, "mot " * 60_000 + ITEM),
        (9, OTHER), (9, OTHER), (10, f"{ITEM} {OTHER}"),
    ]
    items = [(1, ITEM), (2, OTHER), (3, "trop court"), (4, None), (1, ITEM), (5, "Or, " + OTHER)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    t = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in leaks.leaks(d, "doc_id", "text", t, "item_id", "text").collect())
    assert got == [(1, 1), (2, 1), (8, 1), (9, 2), (9, 5), (10, 1), (10, 2), (10, 5)]
    assert leaks.leaks(d.limit(0), "doc_id", "text", t, "item_id", "text").count() == 0
    assert leaks.leaks(d, "doc_id", "text", t.limit(0), "item_id", "text").count() == 0


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_PASSAGES", 3)
    d = spark.createDataFrame([(1, ITEM), (2, OTHER), (3, "x")], "doc_id long, text string")
    t = spark.createDataFrame([(1, ITEM), (2, OTHER)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in leaks.leaks(d, "doc_id", "text", t, "item_id", "text").collect()) == [(1, 1), (2, 2)]


def test_paraphrase(spark):
    changed = "Quel vieux sentier relie donc l’étang perdu de Vougaril"
    d = spark.createDataFrame([(1, changed), (2, OTHER)], "doc_id long, text string")
    t = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert leaks.leaks(d, "doc_id", "text", t, "item_id", "text").count() == 0
    assert [(r.doc_id, r.item_id) for r in leaks.leaks(d, "doc_id", "text", t, "item_id", "text", cosine=0.7, least=6).collect()] == [(1, 1)]


@pytest.mark.parametrize(("size", "latent"), [(5, 200_000), (500_000, 200_000), (7, 12)])
def test_paraphrase_with_foreign_words(spark, monkeypatch, size, latent):
    monkeypatch.setattr(leaks, "BLOCK_PASSAGES", size)
    monkeypatch.setattr(leaks, "LATENT_WORDS", latent)
    if latent < 100:  # few rows of latent words: leaks are still exact
        d = spark.createDataFrame([(1, "Avant tout, " + ITEM), (2, OTHER[:30])], "doc_id long, text string")
        t = spark.createDataFrame([(1, ITEM), (2, OTHER)], "item_id long, text string")
        assert [(r.doc_id, r.item_id) for r in leaks.leaks(d, "doc_id", "text", t, "item_id", "text").collect()] == [(1, 1)]
        return
    docs = [
        (1, "Avant tout, quel vieux sentier relie donc l’étang perdu de Vougaril"),  # put in
        (2, "Quel ancien sentier relie l’étang perdu de Vougaril"),  # put in the place of another
        (3, "Quel xa vieux xb sentier xc relie xd étang xe perdu xf Vougaril xg pressoir"),  # too far apart
        (4, "perdu étang xa l’ relie sentier xb vieux Quel de Vougaril au"),
        (5, "Quel vieux sentier relie l’étang"), (6, None), (7, OTHER), *((k, "un vieux mot") for k in range(8, 20)),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    t = spark.createDataFrame([(1, ITEM), (2, OTHER)], "item_id long, text string")
    got = leaks.leaks(d, "doc_id", "text", t, "item_id", "text", cosine=0.7, least=6)
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(1, 1), (2, 1), (7, 2)]
    assert leaks.leaks(d, "doc_id", "text", t, "item_id", "text").select("doc_id").collect() == [(7,)]


def test_stretches_hold_all_windows():
    rng = np.random.default_rng(3)
    for size in (0, 5, 7, 8, 9, 60):
        for _ in range(50):
            words = [int(n) if n else None for n in rng.integers(0, 4, size)]
            want = [[9 if w is None else w for w in words[k : k + 8]] for k in range(size - 7) if sum(w is not None for w in words[k : k + 8]) >= 6]
            assert [s[k : k + 8] for s in leaks.stretches(words, 6, 9) for k in range(len(s) - 7)] == want


def _stored(spark, words):
    return spark.createDataFrame([(k, [], [list(map(int, w))]) for k, w in enumerate(words)], "k long, terms array<int>, runs array<array<int>>")


def test_latent_terms_are_leading_vectors(spark):
    rng = np.random.default_rng(1)
    words, own = rng.integers(0, 30, (400, leaks.SPAN)).astype(np.int32), rng.integers(0, 30, (50, leaks.SPAN)).astype(np.int32)
    idf = rng.uniform(1, 3, 30)
    a = np.zeros((450, 30))
    for g in range(leaks.SPAN):
        np.add.at(a, (np.arange(450), np.concatenate([words, own])[:, g]), 1)
    a *= idf
    got = leaks.latent_terms(_stored(spark, words).repartition(3), own, idf, rank=30, extra=0) / idf[:, None]
    assert np.allclose(got @ got.T, np.eye(30), atol=1e-3)
    ten = leaks.latent_terms(_stored(spark, words), own, idf, rank=10, extra=15, powers=6) / idf[:, None]
    best = np.linalg.svd(a)[2][:10]
    assert np.linalg.norm(a @ ten) ** 2 > 0.99 * np.linalg.norm(a @ best.T) ** 2


def test_common_subsequences():
    assert leaks._common(np.array([[1, 2, 3, 4, 5, 6, 7, 8]]), np.array([[1, 9, 2, 3, 9, 5, 7, 8]])).tolist() == [6]


def test_buckets_find_what_brute_force_finds(spark):
    rng = np.random.default_rng(2)
    n, words = 400, rng.integers(0, 400, (3000, leaks.SPAN)).astype(np.int32)
    theirs = words[rng.integers(0, 3000, 2000)].copy()
    for row in theirs:  # one or two words are others, or the same in another order
        row[rng.integers(0, leaks.SPAN, rng.integers(0, 3))] = rng.integers(0, n, 1)
    terms = rng.standard_normal((n, 32)).astype(np.float32)
    for cosine in (0.8, leaks.EXACT):
        x, y = leaks._project(theirs, terms)[0], leaks._project(words, terms)[0]
        p, m, _ = leaks.Index(words, terms, cosine).near(theirs)
        want = np.argwhere(x @ y.T >= cosine)
        found = set(zip(p.tolist(), m.tolist(), strict=True))
        assert found <= set(map(tuple, want.tolist())) and len(found) == len(p)
        assert len(found) >= 0.95 * len(want) > 500
        same = {(i, j) for i, j in map(tuple, want.tolist()) if (theirs[i] == words[j]).all()}
        assert same <= found and same


def test_paraphrases_on_the_table_equal_brute_force(spark, root):
    docs, items = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/eval_items.parquet")
    mine = leaks.Items([(r.item_id, r.text) for r in items.collect()])
    n = len(mine.vocabulary) + 1
    found = leaks.cut(leaks.runs(docs, "doc_id", "text", mine.vocabulary, 6))
    df = np.zeros(n)
    for r in found.collect():
        df[list(set(r.terms))] += 1
    idf = np.log((1 + docs.count()) / (1 + df)) + 1
    idf[-1] = 0
    terms = leaks.latent_terms(found, mine.words, idf)
    y, _ = leaks._project(mine.words, terms)
    telling = mine.words[np.arange(len(y)), np.argmax(idf[mine.words], axis=1)]
    want = set()
    for r in found.collect():
        for run in r.runs:
            theirs = np.lib.stride_tricks.sliding_window_view(np.array(run, dtype=np.int32), leaks.SPAN)
            p, m = np.nonzero(leaks._project(theirs, terms)[0] @ y.T >= 0.8)
            ok = (leaks._common(theirs[p], mine.words[m]) >= 6) & (theirs[p] == telling[m][:, None]).any(axis=1)
            want |= {(r.k, i) for q in m[ok] for i in mine.item[mine.first[q] : mine.first[q + 1]].tolist()}
    got = {(r.doc_id, r.item_id) for r in q.p8_paraphrases(spark, root).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and want
    assert {(r.doc_id, r.item_id) for r in q.p8_found(spark, root).collect()} <= got
