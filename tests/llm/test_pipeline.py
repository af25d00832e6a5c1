"""The stages of the pipeline against plain Python on a small corpus."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import test_fuzzy_lines as lines_test
from tests.llm import test_near_copies as near_test

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    words = [rng.choice("klmnprst") + rng.choice("aeiou") + str(i) + rng.choice(["th", "er", "ing"]) for i in range(900)]
    line = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, line(rng.choice([12, 30, 50]))) for i in range(8)]
    docs = []
    for i in range(90):
        body = [line(rng.randint(5, 40)) for _ in range(rng.randint(1, 6))]
        if i % 9 == 0:
            body.append("A very common closing line, all rights reserved.")
        if i % 13 == 5:
            body.insert(0, f"intro {items[i % 8][1]} outro")
        docs.append([i, "\n".join(body)])
    docs += [[100, docs[3][1]], [101, docs[4][1].upper()], [102, None], [103, "12 -- 34"], [104, "x"], [105, ""]]
    base = line(60).split()
    for k in range(6):
        own = list(base)
        for _ in range(k):
            own[rng.randrange(60)] = f"new{rng.random()}"
        docs.append([110 + k, " ".join(own)])
    rows = [(i, t, rng.choice(["en", None]) if i % 3 else "en", None, len(t or "")) for i, t in docs]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {i: t for i, t in docs}, items


def test_stages_in_order(corpus, spark):
    folder, texts, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "benchmark_leaks", "packing"]

    known = corpus_pipeline.freeze(stages["language_id"](spark, docs, folder), "t")
    want = {i: t for i, t in texts.items() if any(map(str.isalpha, t or ""))}
    assert {r.doc_id: r.text for r in known.collect()} == want and {r.lang for r in known.collect()} == {"en"}

    cut = corpus_pipeline.freeze(stages["line_dedup"](spark, known, folder), "t")
    decisions, _ = lines_test.expected(spark, list(want.items()), 80)
    gone = {(d, no) for d, no, _, _, kept in decisions if not kept}
    alive = {d for d, *_, kept in decisions if kept}
    want = {i: "\n".join(x for no, x in enumerate(t.split("\n")) if (i, no) not in gone) for i, t in want.items() if i in alive}
    assert {r.doc_id: r.text for r in cut.collect()} == want and 100 not in want and 101 not in want
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    single = corpus_pipeline.freeze(stages["near_dedup"](spark, cut, folder), "t")
    kept = {i for i, _, _, stays in near_test.expected(list(want.items()), 5, 80) if stays}
    want = {i: t for i, t in want.items() if i in kept}
    assert {r.doc_id: r.text for r in single.collect()} == want

    clean = corpus_pipeline.freeze(stages["benchmark_leaks"](spark, single, folder), "t")
    leaked = {d for d, *_ in near_test.leaked(list(want.items()), items)}
    assert leaked
    want = {i: t for i, t in want.items() if i not in leaked}
    assert {r.doc_id: r.text for r in clean.collect()} == want and clean.columns == columns

    pieces = stages["packing"](spark, clean, folder).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in pieces} == {i: plain.encode(t, add_special_tokens=False).ids + [2] for i, t in want.items()}

    whole = corpus_pipeline.run(spark, folder).collect()
    key = lambda r: (r.doc_id, r.start, r.length, bytes(r.ids))
    assert sorted(map(key, whole)) == sorted(map(key, pieces))


def test_empty_and_unlabelled(spark, corpus):
    folder = corpus[0]
    docs = spark.createDataFrame([(1, "some words", None, None, 9), (None, None, None, None, None)], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
        assert stage(spark, docs, folder).count() in (1, 2), name


def test_rows_with_null_or_repeated_ids_are_cut_by_themselves(spark, corpus):
    folder, _, items = corpus
    rng = random.Random(4)
    line = lambda: " ".join(f"{rng.choice('klmnprst')}{rng.randrange(10**6)}" for _ in range(25))
    common, own, mine, other, more, base, twice = (line() for _ in range(7))
    leak, w = f"{line()} {items[0][1]} {line()}", f"{base} {line()}".split()
    rows = [
        (1, common), (None, f"{common}\n{own}"), (None, f"{mine}\n{common}"), (None, leak), (5, twice), (5, twice), (6, f"{common}\n{other}"), (6, f"{more}\n{common}"),
        (3, " ".join(w[:25]) + "\n" + " ".join(w[25:])), (None, " ".join(w[:12]) + "\n" + " ".join(w[12:37]) + "\n" + " ".join(w[37:])),
    ]
    docs = spark.createDataFrame([(i, t, "en", None, len(t)) for i, t in rows], COLUMNS)
    stages = dict(corpus_pipeline.STAGES)
    found = [docs]
    for name in ("line_dedup", "near_dedup", "benchmark_leaks"):
        found.append(corpus_pipeline.freeze(stages[name](spark, found[-1], folder), "t"))
        assert found[-1].columns == docs.columns
    texts = [[(r.doc_id, r.text) for r in f.collect()] for f in found[1:]]
    lines = [x for _, t in texts[0] for x in t.split("\n")]
    assert all(lines.count(x) == 1 for x in (common, own, mine, other, more, twice, leak))
    assert len(texts[0]) == 9 and len(texts[1]) == 8 and len(texts[2]) == 7
    assert [i for i, t in texts[1] if t.split() == w] == [3]
    assert sorted((i or 0, t) for i, t in texts[2] if i not in (1, 3)) == sorted([(0, own), (0, mine), (5, twice), (6, other), (6, more)])
