"""Repeated passages: chaining against quadratic search, planted passages, clean documents."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import passages
from tidemark.llm.passages import GAP_COST, MAX_GAP, SEED, _long_runs, align, all_minimizers, chains, good_parts, minimizers, repeated_passages, word_hashes


def quadratic_best(left, right):
    score = []
    for i in range(len(left)):
        best = SEED
        for j in range(i):
            if left[j] < left[i] and right[j] < right[i] and max(left[i] - left[j], right[i] - right[j]) <= MAX_GAP + SEED:
                best = max(best, SEED + score[j] - GAP_COST * (left[i] - left[j] + right[i] - right[j]))
        score.append(best)
    return max(score)


def chain_score(left, right, way):
    a, b = left[way], right[way]
    return SEED * len(way) - GAP_COST * (int(a[-1] - a[0]) + int(b[-1] - b[0]))


@pytest.mark.parametrize("seed", range(15))
def test_best_chain_equals_quadratic_search(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(3, 60))
    points = sorted({(int(a), int(b)) for a, b in rng.integers(0, 40, (n, 2))})
    left, right = np.array([p[0] for p in points]), np.array([p[1] for p in points])
    found = chains(left, right, least=1)
    assert sorted(k for way in found for k in way.tolist()) == list(range(len(points)))
    for way in found:
        assert (np.diff(left[way]) > 0).all() and (np.diff(right[way]) > 0).all()
    assert np.isclose(chain_score(left, right, found[0]), quadratic_best(left.tolist(), right.tolist()))


@pytest.mark.parametrize("seed", range(15))
def test_best_chain_equals_quadratic_search_far_beyond_the_gap(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(50, 200))
    at = np.sort(rng.integers(0, 1500, n))
    points = sorted({(int(a), int(max(0, a + d))) for a, d in zip(at, rng.choice([0, 0, 1, 60, -80], n), strict=True)})
    left, right = np.array([p[0] for p in points]), np.array([p[1] for p in points])
    found = chains(left, right, least=1)
    assert sorted(k for way in found for k in way.tolist()) == list(range(len(points)))
    for way in found:
        assert (np.diff(left[way]) <= MAX_GAP + SEED).all() and (np.diff(right[way]) <= MAX_GAP + SEED).all()
    assert np.isclose(chain_score(left, right, found[0]), quadratic_best(left.tolist(), right.tolist()))


@pytest.mark.parametrize("first, own, second", [(60, 100, 80), (1000, 60, 2000)])
def test_a_long_chain_does_not_hide_the_next_passage(first, own, second):
    at = np.concatenate([np.arange(0, first - SEED, 5), np.arange(first + own, first + own + second - SEED, 5)])
    later = at >= first + own
    found = chains(at, at)
    assert sorted(len(way) for way in found) == sorted([int((~later).sum()), int(later.sum())])


def test_shared_runs_share_a_seed():
    rng = np.random.default_rng(2)
    for _ in range(50):
        run = rng.integers(0, 2**63, 14).astype(np.uint64)
        a = np.concatenate([rng.integers(0, 2**63, rng.integers(0, 30)).astype(np.uint64), run, rng.integers(0, 2**63, 9).astype(np.uint64)])
        b = np.concatenate([rng.integers(0, 2**63, rng.integers(0, 30)).astype(np.uint64), run])
        assert set(minimizers(a)[0].tolist()) & set(minimizers(b)[0].tolist())


def test_alignment_counts_edits():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**63, 100).astype(np.uint64)
    b = np.concatenate([a[:30], a[32:60], [np.uint64(5)], a[60:]])
    left, right = np.array([4, 10, 40, 70]), np.array([4, 10, 38, 69])
    assert align(a, b, left, right) == (0, 100, 0, 99, 3)
    assert align(a, b, np.array([4, 41]), np.array([4, 38])) is None


def words(rng, n):
    return [rng.choice("bcdfgklmnprst") + rng.choice("aeiou") + str(rng.randrange(500)) for _ in range(n)]


def test_planted_passages_are_found_and_clean_documents_left(spark):
    rng = random.Random(9)
    exact, fuzzy, short = words(rng, 60), words(rng, 80), words(rng, 30)
    docs, planted = [], {}
    for i in range(120):
        body = words(rng, rng.randint(60, 400))
        if i % 10 in (1, 2, 3):
            piece = {1: exact, 2: list(fuzzy), 3: short}[i % 10]
            if i % 10 == 2:
                for k in rng.sample(range(80), 4):
                    piece[k] = "edit" + str(rng.random())
            at = rng.randint(0, len(body))
            body[at:at] = piece
            if i % 10 < 3 and i > 10:
                planted[i] = (at, len(piece))
        docs.append((i, rng.choice([" ", "\n"]).join(body)))
    docs += [(500, None), (501, ""), (502, "few words only"), (None, " ".join(exact)), (503, docs[5][1]), (504, docs[5][1].upper())]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id bigint, text string, pos int, words string")
    found = {r.doc_id: r for r in repeated_passages(frame).collect()}
    assert set(found) == set(planted) | {503, 504}
    for i, (at, n) in planted.items():
        r = found[i]
        assert abs(r.start_word - at) <= 8 and abs(r.n_words - n) <= 12, (i, r, at, n)
        assert r.ref_doc_id < i and r.ref_doc_id % 10 == i % 10
        assert r.identity >= 0.8
    assert found[503].ref_doc_id == 5 and found[503].n_words == len(docs[5][1].split()) and found[503].identity == 1.0


def test_a_passage_first_seen_in_parts_is_found_whole(spark):
    rng = random.Random(3)
    passage = words(rng, 70)
    docs = [
        (1, words(rng, 50) + passage[:35] + words(rng, 50)), (2, words(rng, 40) + passage[35:] + words(rng, 30)),
        (3, words(rng, 90) + passage + words(rng, 10)),
    ]
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id bigint, text string")
    (row,) = repeated_passages(frame).collect()
    assert (row.doc_id, row.ref_doc_ids) == (3, [1, 2]) and row.start_word == 90 and row.n_words == 70
    assert repeated_passages(frame.limit(0)).count() == 0


def test_longest_good_runs_equal_all_pairs():
    rng = np.random.default_rng(6)
    for _ in range(60):
        n = int(rng.integers(1, 25))
        starts = np.cumsum(rng.integers(1, 30, n))
        ends = starts + SEED
        costs = np.concatenate([[0], np.cumsum(rng.integers(0, 9, n))])[:n]
        good = {(i, j) for i in range(n) for j in range(i, n) if 100 * (costs[j] - costs[i]) <= 20 * (ends[j] - starts[i])}
        longest = {(i, j) for i, j in good if not any((k, m) != (i, j) and k <= i and m >= j for k, m in good)}
        assert set(_long_runs(starts, ends, costs, 80)) == longest


@pytest.mark.parametrize("first, own, second", [(60, 35, 60), (50, 22, 25)])
def test_exact_passages_around_a_costly_gap_are_kept(spark, first, own, second):
    rng = np.random.default_rng(first)
    some = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    one, two = some(first), some(second)
    a, b = np.concatenate([one, some(own), two]), np.concatenate([one, some(own), two])
    at = np.concatenate([np.arange(0, first - SEED + 1, 5), np.arange(first + own, len(a) - SEED + 1, 5)])
    assert [s[:2] for s in good_parts(a, b, at, at, 20, 80)] == [(0, first), (first + own, len(a))]

    rng = random.Random(first)
    one, two = words(rng, first), words(rng, second)
    docs = [(i, " ".join(words(rng, 40) + one + words(rng, own) + two + words(rng, 30))) for i in (1, 2)]
    found = repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string"), min_words=25).collect()
    assert sorted((r.doc_id, r.start_word, r.n_words) for r in found) == [(2, 40, first), (2, 40 + first + own, second)]


def test_a_passage_of_lines_first_seen_elsewhere(spark):
    rng = random.Random(21)
    lines = [words(rng, 10) for _ in range(8)]
    docs = [(i, words(rng, 30) + line + words(rng, 30)) for i, line in enumerate(lines)]
    whole = sum(lines, [])
    docs += [(20, words(rng, 15) + whole + words(rng, 12)), (21, words(rng, 25) + whole + words(rng, 9)), (21, words(rng, 50))]
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id bigint, text string")
    (row,) = [r for r in repeated_passages(frame).collect() if r.doc_id == 21]
    assert (row.start_word, row.n_words, row.ref_doc_id, row.ref_start, row.identity) == (25, 80, 20, 15, 1.0)


def test_overlapping_phrases_first_seen_elsewhere(spark):
    rng = random.Random(22)
    whole = words(rng, 90)
    docs = [(i, words(rng, 30) + whole[at : at + 18] + words(rng, 30)) for i, at in enumerate(range(0, 90, 5))]
    docs += [(30, words(rng, 15) + whole + words(rng, 12)), (31, words(rng, 25) + whole + words(rng, 9))]
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id bigint, text string")
    (row,) = [r for r in repeated_passages(frame).collect() if r.doc_id == 31]
    assert abs(row.start_word - 25) <= 2 and abs(row.n_words - 90) <= 4 and 30 in row.ref_doc_ids


def test_seeds_of_many_texts_are_those_of_each():
    rng = random.Random(11)
    texts = ["", "  ", " One\ttwo ", "É é\x1cx\xa0y İ"]
    texts += [" ".join(rng.choice("abcAB") * rng.randint(1, 2) for _ in range(rng.choice([3, 4, 5, 13, 14, 15, 40, 300]))) for _ in range(200)]
    rng.shuffle(texts)
    words, starts = word_hashes(pa.array(["left out", *texts]).slice(1))
    of, seeds, places = all_minimizers(words, starts)
    for i, text in enumerate(texts):
        own = words[starts[i] : starts[i + 1]]
        assert len(own) == len(text.encode().lower().split())
        want = zip(*(v.tolist() for v in minimizers(own)), strict=True)
        assert sorted(zip(seeds[of == i].tolist(), places[of == i].tolist(), strict=True)) == sorted(want)


def test_few_and_many_matches_give_the_same_chains(monkeypatch):
    rng = random.Random(12)
    for _ in range(300):
        matches = sorted({(rng.randint(0, 120), rng.randint(0, 90)) for _ in range(rng.randint(0, 60))})
        left, right = np.array(matches, np.int64).reshape(-1, 2).T
        monkeypatch.setattr(passages, "FEW", 10_000)
        few = [way.tolist() for way in chains(left, right)]
        monkeypatch.setattr(passages, "FEW", -1)
        assert few == [way.tolist() for way in chains(left, right)]


def test_texts_are_copied_once_for_windows_that_lie_together(spark, monkeypatch):
    """A lot for each window had the whole text joined and cut anew for each."""
    kept, whole = {}, passages.freeze
    monkeypatch.setattr(passages, "freeze", lambda df, label, **more: kept.setdefault(label, whole(df, label, **more)))
    monkeypatch.setattr(passages, "discard", lambda *tables: None)
    rng = random.Random(13)
    parts = [[f"p{i}w{rng.getrandbits(40)}" for _ in range(70)] for i in range(8)]
    data = [(i, " ".join(p)) for i, p in enumerate(parts)] + [(99, " ".join(f"{' '.join(p)} own{i}x own{i}y own{i}z" for i, p in enumerate(parts)))]
    found = repeated_passages(spark.createDataFrame(data, "doc_id bigint, text string")).collect()
    assert {r.doc_id for r in found} == {99}
    asked = [r for r in kept["asked-windows"].collect() if r.doc_id == 99]
    assert len(asked) == 1 < len(asked[0].cuts)


def test_documents_are_shuffled_at_any_size(spark, monkeypatch):
    """Small tables had the windows broadcast, so that a larger table's shuffle grew faster than its rows."""
    joins, whole = {}, passages.freeze

    def freeze(df, label, **more):
        joins[label] = df._jdf.queryExecution().executedPlan().toString().replace("\n", " ")
        return whole(df, label, **more)

    monkeypatch.setattr(passages, "freeze", freeze)
    shared = " ".join(f"s{i}" for i in range(80))
    found = repeated_passages(spark.createDataFrame([(1, shared), (2, f"own {shared}")], "doc_id bigint, text string")).collect()
    assert [(r.doc_id, r.start_word, r.n_words, r.ref_doc_id) for r in found] == [(2, 1, 80, 1)]
    assert "SortMergeJoin" in joins["windows"] and "BroadcastHashJoin" not in joins["windows"]


def test_edit_distance_equals_the_table():
    rng = np.random.default_rng(14)
    for _ in range(400):
        a, b = (rng.integers(0, rng.integers(1, 9), rng.integers(0, 80)).astype(np.uint32) for _ in "ab")
        row = list(range(len(b) + 1))
        for i, x in enumerate(a.tolist(), 1):
            new = [i]
            for j, y in enumerate(b.tolist(), 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        assert passages._edit_distance(a, b) == row[-1]


def test_chains_on_one_diagonal_walk_alike():
    """Chains equal from end to end are not walked match by match; seeds out of place still are none."""
    words = np.arange(60, dtype=np.uint32)
    left = np.array([2, 5, 20, 41])
    assert passages._walk(words, words[1:], left, left - 1, SEED) == ([7, 10, 25, 46], [6, 9, 24, 45], [0] * 4)
    assert passages._walk(words, words[1:], left, left, SEED) is None
    assert passages._walk(words, words, np.array([2, 58]), np.array([2, 58]), SEED) is None
    assert good_parts(words, words, left, left, 20, 80) == [(0, 60, 0, 60, 0)]
