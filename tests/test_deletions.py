"""Pairs of short texts by what is left when characters are deleted."""

import math

import pytest

from tests.test_fuzzy import brute_groups, brute_pairs, noisy, table
from tidemark.plans import blocks, deletions, pairs
from tidemark.plans.deletions import Deletions
from tidemark.plans.greedy import greedy_leaders
from tidemark.plans.pairs import Matcher, Scheme


@pytest.fixture(autouse=True)
def small_tables_are_no_exception(monkeypatch):
    monkeypatch.setattr(pairs, "AT_ONCE", -1)


def customers(n):
    return [f"customer#{i:09d} user{i % 7}@example.com" for i in range(n)]


@pytest.mark.parametrize("seed,alphabet,length,edits,threshold", [(31, "abcé日", 18, 3, 80), (32, "ab", 14, 2, 85), (33, "abcdefghij", 40, 3, 95), (34, "abc", 16, 4, 78)])
def test_remainders_miss_no_pair_of_the_lengths_they_cover(spark, seed, alphabet, length, edits, threshold):
    texts = noisy(seed, 150, alphabet, length, edits)
    rows, scheme = table(spark, texts), Scheme(threshold)
    near = Deletions.of(rows, rows, scheme, always=True)
    found = {tuple(sorted(r)) for r in near.pairs(rows, rows).collect()}
    expected = {p for p in brute_pairs(texts, threshold) if max(len(texts[p[0]]), len(texts[p[1]])) in near.longer}
    assert expected and expected <= found
    assert all(max(len(texts[a]), len(texts[b])) in near.longer for a, b in found)
    assert max(e[0] for es in near.longer.values() for e in es) > 1


def test_texts_of_one_form_are_not_compared_in_full(spark, monkeypatch):
    def no(*_):
        raise AssertionError("neither grams nor tiles")

    texts = customers(400)
    for name in ("candidate_ids", "_tile_pairs"):
        monkeypatch.setattr(pairs, name, no)
    found = {(r.a, r.b): r.score for r in Matcher(97).pairs(table(spark, texts)).collect()}
    expected = brute_pairs(texts, 97)
    assert expected and found == expected


def test_candidates_of_one_form_are_hardly_more_than_the_pairs(spark):
    rows, scheme = table(spark, customers(1200)), Scheme(97)
    near = Deletions.of(rows, rows, scheme)
    assert near.longer and near.others(rows).isEmpty()
    candidates, found = near.pairs(rows, rows).count(), Matcher(97).pairs(rows).count()
    assert 0 < found <= candidates < 1.1 * found
    # every text meets itself too
    assert pairs.candidate_load(rows, scheme) < 100 * 1200


def test_the_load_is_counted_from_a_sample(spark, monkeypatch):
    rows = table(spark, customers(300))
    near = Deletions.of(rows, rows, Scheme(97))
    guess = near.load(rows)
    monkeypatch.setattr(deletions, "SAMPLED", 1)
    assert near.load(rows) / 2 < guess < near.load(rows) * 2


@pytest.mark.parametrize("first_batch", [40, 1000])
def test_removal_of_one_form(spark, first_batch):
    texts = customers(250)
    found = {r.id: r.leader for r in greedy_leaders(table(spark, texts), Matcher(97), first_batch).collect()}
    groups, removed = brute_groups(texts, 97, True)
    assert set(found) == removed and removed
    assert all(i in groups[leader][0] for i, leader in found.items())


def test_hashes_of_remainders_are_those_of_the_texts(spark):
    import numpy as np

    points = lambda *texts: np.array([list(map(ord, t)) for t in texts], np.uint32)
    left = deletions._remainders(points("abcde", "bxcdd"), 2)
    assert left.shape == (2, math.comb(5, 2))
    whole = deletions._remainders(points("bcd", "abe", "bdd"), 0)[:, 0]
    assert whole[0] in left[0] and whole[1] in left[0] and whole[2] in left[1] and whole[1] not in left[1]


def bands_of(spark, texts, threshold):
    rows = blocks.minhash_bands(table(spark, texts), 1 - threshold / 100).collect()
    return {r["id"]: set(r["bands"]) for r in rows}


@pytest.mark.parametrize("ways", [0, 4000])
def test_crowded_bands_lose_no_pair_that_shares_one(spark, monkeypatch, ways):
    # no way to delete: all texts are long ones
    monkeypatch.setattr(deletions, "MOST_WAYS", ways)
    monkeypatch.setattr(blocks, "CROWDED", 3)
    monkeypatch.setattr(blocks, "TILE", 16)
    texts = customers(200) + [f"{t} and a tail that is far too long to delete from, on and on, as it is of many characters {i % 3}" * 3 for i, t in enumerate(customers(12))]
    bands = bands_of(spark, texts, 97)
    expected = {p: s for p, s in brute_pairs(texts, 97).items() if bands[p[0]] & bands[p[1]]}
    found = {(r.a, r.b): r.score for r in Matcher(97, approximate=True).pairs(table(spark, texts)).collect()}
    assert found == expected and any(a >= 200 for a, _ in expected) and any(b < 200 for _, b in expected)
    if ways:
        visited = banded_candidates(spark, texts[:200])
        assert visited < 2 * sum(b < 200 for _, b in expected) + 200
    left, right = table(spark, texts).where("id % 2 = 0"), table(spark, texts).where("id % 2 = 1")
    between = {(r.a, r.b) for r in Matcher(97, approximate=True).between(left, right).collect()}
    assert between == {(a, b) for a, b in expected if (a + b) % 2}


def banded_candidates(spark, texts):
    return blocks.banded_pairs(table(spark, texts), Scheme(97)).count()
