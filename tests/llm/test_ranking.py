"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import ranking
from tidemark.llm.ranking import Segment, ranked_search, search_segment, terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def expected(docs, items, top):
    bags = [(i, cut(t)) for i, t in docs]
    bags = [(i, len(b), Counter(b)) for i, b in bags if b]
    total, count = sum(n for _, n, _ in bags), len(bags)
    holding = Counter(t for *_, bag in bags for t in bag)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, n, bag in bags:
            m = 75 + 25 * n * count // total
            score = 0
            for term in cut(text):
                if bag[term]:
                    w = math.floor(1000 * math.log((2 * count + 2) / (2 * holding[term] + 1)))
                    score += w * (10**9 * bag[term] // (1000 * bag[term] + 12 * m))
            if score > 0:
                scores.append((-score, doc_id is not None, doc_id or 0, doc_id))
        out += [(item_id, rank, own, -score) for rank, (score, _, _, own) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def corpus(rng):
    words = [f"t{i}" for i in range(120)] + ["Straße", "ÉTÉ", "été", "x²"]
    odds = [1 / (i + 1) for i in range(len(words))]
    text = lambda n: rng.choice([" ", ", ", "-", "\n"]).join(rng.choices(words, odds, k=n))
    docs = [(i, text(rng.choice([1, 5, 40, 40, 200]))) for i in range(700)]
    docs += [(800 + i, docs[3][1]) for i in range(60)]
    docs += [(None, docs[3][1]), (None, "t1 t1"), (5000, None), (5001, ""), (5002, "--"), (5003, "t0 " * 40_000), (5004, "T5"), (5004, "t5 t6")]
    items = [(i, text(rng.choice([1, 3, 12, 50]))) for i in range(25)]
    items += [(25, "t3 t3 T3"), (26, None), (27, ""), (28, "nowhere"), (1, "t9 t8"), (None, "t2 nowhere"), (29, docs[3][1])]
    return docs, items


@pytest.mark.parametrize("top, segment, block", [(20, 4096, 200_000), (3, 256, 20)])
def test_ranks_equal_scoring_all(spark, monkeypatch, top, segment, block):
    monkeypatch.setattr(ranking, "SEGMENT_DOCS", segment)
    docs, items = corpus(random.Random(top))
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, term string, n int")
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id int, text string, item int")
    got = sorted((tuple(r) for r in ranked_search(frame, asked, top=top, block_terms=block).collect()), key=repr)
    assert got == expected(docs, items, top)


def test_floor_leaves_exact_scores():
    rng = np.random.default_rng(4)
    owner, term = np.nonzero(rng.random((300, 20)) < np.linspace(0.01, 0.9, 20))
    tf = rng.integers(1, 5, len(owner)).astype(np.int64)
    segment = Segment(np.full(300, 30), owner, term.astype(np.int32), tf, 300, 9000)
    for _ in range(50):
        wanted = np.sort(rng.choice(25, 8, replace=False)).astype(np.int32)
        factors = rng.integers(0, 9, 8)
        full = np.zeros(300, np.int64)
        for t, f in zip(wanted, factors, strict=True):
            hit = term == t
            impact = 10**9 * tf[hit] // (1000 * tf[hit] + 12 * (75 + 25 * 30 * 300 // 9000))
            np.add.at(full, owner[hit], impact * f)
        for floor in (0, int(np.median(full)), int(full.max()) - 1, int(full.max())):
            docs, scores = search_segment(segment, wanted, factors, floor)
            assert docs.tolist() == np.flatnonzero(full > floor).tolist()
            assert scores.tolist() == full[full > floor].tolist()


def test_terms():
    for text in ("Ab-c_d 12\x0012 É\x85x  \x7fz", "", "..", "`a{b~C@9:"):
        assert [t.decode() for t in terms(text.encode())] == cut(text)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert ranked_search(docs.limit(0), items).collect() == []
    assert ranked_search(docs, items.limit(0)).collect() == []
    # the one document holds every term: weight 1000*ln(4/3)
    assert [tuple(r) for r in ranked_search(docs, items).collect()] == [(1, 1, 1, 287 * (10**9 // (1000 + 12 * 100)))]
