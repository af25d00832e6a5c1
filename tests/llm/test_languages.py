"""Language identification: held-out accuracy and the n-gram counts."""

import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import languages
from tidemark.llm.languages import identify, identify_languages, learn_languages, learnable, ngram_shares


def test_shares_do_not_depend_on_slices_or_neighbours(monkeypatch):
    rng = random.Random(1)
    texts = ["", " ", "12 -", "a", "É", "Ab c", "日本 x"] + ["".join(rng.choices("abcé ,.1\nÄ", k=rng.randint(0, 60))) for _ in range(60)]
    whole = ngram_shares(texts, 512)
    assert np.allclose(whole, np.vstack([ngram_shares([t], 512) for t in texts]))
    monkeypatch.setattr(languages, "_SLICE", 17)
    assert np.allclose(whole, ngram_shares(texts, 512))
    norms = (whole**2).sum(axis=1)
    assert all(np.isclose(n, float(any(map(str.isalpha, t))), atol=1e-5) for n, t in zip(norms, texts, strict=True))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = learn_languages(docs.where(learnable(docs)), per_language=60)
    found = identify(docs.where(~learnable(docs)), model).select("lang", "lang_pred", "lang_score", "n_chars").collect()
    right = Counter(r.lang == r.lang_pred for r in found)
    assert right[True] / len(found) > 0.97
    assert all(0 <= r.lang_score <= 1 for r in found)


def test_defined_cases(spark):
    rows = [(1, "en", "the house and the dog"), (2, "de", "das Haus und der Hund"), (3, None, "x"), (4, "fr", None), (None, "en", "12"), (1, "en", "the house and the dog")]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string").withColumn("lang_pred", languages.F.lit(1))
    found = identify_languages(docs).collect()
    assert Counter(r.lang_pred == "und" for r in found)[True] == 2
    assert len(found) == len(rows) and set(found[0].asDict()) == {"doc_id", "lang", "text", "lang_pred", "lang_score"}
    assert learn_languages(docs.where("lang is null")) is None
    assert {r.lang_pred for r in identify(docs, None).collect()} == {"und"}
    assert identify_languages(docs.limit(0)).count() == 0
    one = learn_languages(docs.where("lang = 'en'"))
    assert {r.lang_pred for r in identify(docs, one).collect()} == {"en", "und"}


def test_families_come_first():
    langs = ["en", "de", "fr", "xx"]
    machines = languages.duels(langs)
    assert machines == [(None, "germanic", "romance"), (None, "germanic", "xx"), (None, "romance", "xx"), ("germanic", "de", "en")]
    model = languages.LanguageModel.of(8, langs, {m: np.zeros(9, np.float32) for m in machines})
    assert model.families.classes == ["germanic", "romance", "xx"]
    assert model.within["germanic"].classes == ["de", "en"]


@pytest.fixture
def learned_from(monkeypatch):
    """How many vectors of each language are handed to the duels."""
    seen = {}
    plain = languages._vectors

    def vectors(texts, buckets):
        seen.update(Counter(r.lang for r in texts.collect()))
        return plain(texts, buckets)

    monkeypatch.setattr(languages, "_vectors", vectors)
    return seen


def test_copies_do_not_crowd_out_the_texts_to_learn_from(spark, learned_from):
    rows = [("en", f"text number {chr(97 + i)} {'abc' * i}") for i in range(30)] + [("en", "the same house again")] * 6000 + [("de", f"ein Text {'xy' * i}") for i in range(12)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert learn_languages(docs, per_language=20).families.classes == ["germanic"]
    assert learned_from == {"en": 20, "de": 12}


def test_number_of_languages_is_bounded(spark, learned_from):
    rows = [(f"l{i:03d}", f"{chr(0x400 + i)}{'ab' * j}") for i in range(80) for j in range(2 if i % 2 else 1)]
    model = learn_languages(spark.createDataFrame(rows, "lang string, text string"), most_languages=50, buckets=64)
    odd, even = [f"l{i:03d}" for i in range(1, 80, 2)], [f"l{i:03d}" for i in range(0, 80, 2)]
    assert sorted(learned_from) == sorted([*odd, *even[:10]]) == model.families.classes
