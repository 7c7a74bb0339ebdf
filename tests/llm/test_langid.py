"""Profiles against a literal bind and bundle, and what the rejection keeps."""

import numpy as np
from pyspark.sql import functions as F

from evidentia.llm import langid


def literal(text):
    """Letter by letter: rotate by place, multiply, add."""
    _, _, letters = langid._item_memory()
    table = langid._symbols()
    codes = [0]
    for c in text.lower():
        code = int(table[ord(c)])
        if code or codes[-1]:
            codes.append(code)
    codes.append(0)
    total = np.zeros(langid.DIMENSIONS)
    for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
        if b:
            total += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
    return total


def test_profiles_bind_and_bundle():
    texts = ["", "a", "The quiet  harbour, woke!", "Ünïcödé ß ﬁ İstanbul", "12 34", "мојот роман", "x" * 5, " lead and trail "]
    found = langid.encode(texts)
    for text, vector in zip(texts, found, strict=True):
        assert np.array_equal(vector, literal(text)), text


def test_long_texts_are_bundled_piece_by_piece():
    text = "the long story of a quiet harbour " * 40000
    assert np.abs(langid.encode([text])[0] - literal("the long story of a quiet harbour " * 10) * 4000).max() < 20000


def test_rejection(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = [(90001, "Съешь же ещё этих мягких французских булок да выпей чаю", None), (90002, "これは日本語の文章です。とても長い文章です。もう少し続きます", None), (90003, "x" * 60, None), (90004, None, "en"), (90005, "12345", "en"), (90006, "A.", "en"), (None, "The boats and the harbour that are in the town", "en")]
    mixed = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string")).withColumns({c: F.lit(1) for c in ("_guess", "score", "lang_pred", "place", "value")})
    kept = langid.keep_identified(mixed)
    assert kept.columns == mixed.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids >= {r.doc_id for r in docs.where("text rlike '[a-z]'").collect()} | {90006, None}
    assert ids.isdisjoint({90001, 90002, 90003, 90004, 90005})
    german = langid.keep_identified(mixed, languages=["de"])
    truth = {r.doc_id for r in docs.where("lang = 'de'").collect()}
    found = {r.doc_id for r in german.collect()}
    assert len(found & truth) >= 0.95 * len(truth) and len(found - truth) <= 3


def test_ties_go_to_the_first_language_by_name(spark):
    rows = [(i, "same words in both of them", lang) for i in range(40) for lang in ("zz", "aa")] + [(1000 + i, "same words", None) for i in range(5)]
    found = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in found.collect()} == {"aa"}


def test_a_corpus_without_languages_is_kept_whole(spark):
    rows = [(1, "The quiet harbour woke before the bell.", None), (2, None, None), (3, "12 34", None), (3, "12 34", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(map(repr, langid.keep_identified(docs).collect())) == sorted(map(repr, docs.collect()))
