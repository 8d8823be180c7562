"""Token ids against the library, reading levels on held-out ratings."""

import json

import pytest
from pyspark.sql import functions as F

from placewright.llm import reading, tokens
from placewright.llm import queries as q

TRICKY = ["", " ", "a", "a 's b", "x  y", " a", "a ", "a  b", "it 's", "don't <|endoftext|> do", "a \n b", "é à ü b", "   ", "a 9 9a b1 c", "日本 語 x", "x !y ?z ' q", "a ́b", "9 ² 3", "x" * 30_000, "ab " * 20_000, "a b ​ c", "👨‍👩 ok 'll we 'll"]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_library(spark, root, library):
    rows = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], library([r.text or "" for r in rows]), strict=True))
    got = {r.doc_id: r.ids for r in q.p7_ids(spark, root).collect()}
    assert got == want


def test_ids_of_tricky_texts(spark, library):
    df = spark.createDataFrame([*enumerate(TRICKY), (-1, None), (-1, None)], "k int, t string").withColumn("ids", F.lit("clash"))
    got = tokens.encode(df, "k", "t", tokens.vocabulary_path("byte_bpe_50k.tiktoken")).collect()
    assert sorted((r.k, r.ids) for r in got) == sorted([*enumerate(library(TRICKY)), (-1, []), (-1, [])])
    assert tokens.encode(df.limit(0), "k", "t", tokens.vocabulary_path("byte_bpe_50k.tiktoken")).count() == 0


def test_cuts_are_forced():
    import numpy as np

    _, bridged, _ = tokens.load(tokens.vocabulary_path("byte_bpe_50k.tiktoken"))
    data = np.frombuffer(b"le petit 'chat 9 vu", dtype=np.uint8)
    cuts = tokens.forced_cuts(data, bridged)
    assert cuts.tolist() == [2, 14, 16]
    assert not bridged[data[cuts - 1], data[cuts]].any()


def test_levels_on_held_out_ratings(spark):
    root = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/level_labels.parquet")
    even = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    found = reading.reading_levels(docs, labels.where(even)).select("doc_id", F.col("reading_level").alias("found"))
    truth = labels.where(~even).groupBy("doc_id").agg(F.mode("reading_level").alias("level"))
    r = found.join(truth, "doc_id").agg(F.avg((F.col("found") == F.col("level")).cast("double")).alias("right"), F.count("*").alias("n")).first()
    assert r.n > 400 and r.right > 0.97


def test_levels_of_odd_texts(spark):
    easy, hard = "Le chat est là. Il va au lac. " * 10, "L’internationalisation institutionnelle intercommunale contemporaine, indépendamment considérée, " * 12
    rows = [(1, easy, "fr"), (2, hard, None), (3, None, "fr"), (4, "", "en"), (5, "mot " * 44, "fr"), (6, "mot " * 45, "fr-FR"), (7, "x" * 100_000, "en"), (1, easy, "fr"), (8, "&eacute;t&eacute; " * 45, "FR"), (9, "- Va là\n- Tu es là\nIl dort\n" * 9, "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("grade", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, rater string, reading_level int")
    got = sorted((r.doc_id, r.reading_level) for r in reading.reading_levels(df, none).select("doc_id", "reading_level").collect())
    assert [g for g in got if g[0] in (1, 2, 9)] == [(1, 1), (1, 1), (2, 3), (9, 1)]
    assert {g[0] for g in got} == {1, 2, 6, 8, 9}
    assert reading.reading_levels(df.limit(0), none).count() == 0


def test_syllables():
    french, english = reading.breaker(reading.FRENCH_PATTERNS), reading.breaker(reading.ENGLISH_PATTERNS)
    told = {"le": 1, "les": 1, "place": 1, "tables": 1, "parlent": 1, "moment": 2, "été": 2, "musée": 2, "montagne": 2, "peuple": 1, "poète": 2, "naïf": 2, "aéroport": 4, "théâtre": 2, "instrument": 3, "internationalisation": 8, "km": 1, "splendide": 2}
    assert {w: french(w) for w in told} == told
    told = {"the": 1, "table": 2, "made": 1, "places": 2, "boxes": 2, "walked": 1, "wanted": 2, "nation": 2, "radio": 3, "people": 2, "strength": 1, "institutional": 5, "museum": 3, "splendid": 2}
    assert {w: english(w) for w in told} == told


def test_counts_of_marked_up_texts(spark):
    rows = [(1, "&#233;t&#xE9; c&oelig;ur", "fr"), (2, "<a href='" + "x" * 5_000 + "'>un</a> mot", "fr"), (3, "Ã©tÃ© â€™ fÃªte", "fr"), (4, "e\u0301te\u0301 cen-\r\ntre co\u00adeur", "fr"), (5, "3.5 km. M. Le 12,4 %", "fr"), (6, "œ" * 10_000, "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.n_words, r.n_letters, r.n_syllables, r.n_sentences) for r in reading.measures(df, "doc_id", "text", "lang").collect()}
    assert got == {1: (2, 7, 3, 1), 2: (2, 5, 2, 1), 3: (2, 7, 3, 1), 4: (3, 14, 4, 1), 5: (5, 5, 3, 2), 6: (1, 10_000, 1, 1)}


def test_cuts_agree_with_most_ratings():
    low, high = reading.best_cuts({(100, 1): 5, (120, 2): 6, (110, 2): 1, (150, 3): 4, (149, 2): 1})
    level = lambda b: 1 + ((b * reading.BIN - 10) >= low) + ((b * reading.BIN - 10) >= high)
    assert [level(b) for b in (100, 110.5, 120, 150.5)] == [1, 2, 2, 3]
    assert json.dumps([low, high])
