"""Near copies against all pairs of shingle sets, and leaks against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from tidemark.llm import near_copies as module
from tidemark.llm.components import components
from tidemark.llm.leaks import leaks
from tidemark.llm.near_copies import CirculantMinHash, bands_for, near_copies


def shingles(text, size):
    words = (text or "").encode().lower().split()
    n = min(size, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def groups(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def expected(data, size, percent):
    sets = {}
    for i, text in data:
        sets.setdefault(i, []).append(shingles(text, size))
    links = []
    for a, b in combinations([i for i in sets if i is not None], 2):
        for x in sets[a]:
            for y in sets[b]:
                if x and y and 100 * len(x & y) >= percent * len(x | y):
                    links.append((a, b))
    component = groups([i for i in sets if i is not None], links)
    plain = lambda v: -1 if v is None else v
    return sorted((plain(i), len(shingles(t, size)), plain(component.get(i)), component.get(i) == i) for i, t in data)


def copies(rng, n, words):
    """Near copies by edits and cuts, so that pairs lie on both sides of the threshold."""
    base = [rng.choice("abcdefgh") + str(rng.randrange(300)) for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(rng.choice(out)) if out and rng.random() < 0.3 else list(base)
        for _ in range(rng.randrange(0, 9)):
            k = rng.randrange(len(own))
            rng.choice([lambda: own.pop(k), lambda: own.insert(k, "n" + str(rng.random())), lambda: own.__setitem__(k, "x")])()
        out.append(own)
    return [" ".join(o) for o in out]


@pytest.mark.parametrize("size, percent, blocks", [(3, 85, 200), (5, 80, 3), (3, 85, 7), (2, 60, 5)])
def test_groups_equal_all_pairs(spark, monkeypatch, size, percent, blocks):
    monkeypatch.setattr(module, "_BLOCK_NODES", blocks)
    monkeypatch.setattr(module, "_BLOCK_COLUMNS", 64)
    rng = random.Random(size * blocks)
    texts = copies(rng, 60, 100) + copies(rng, 30, 40) + copies(rng, 12, 14) + ["one", "ONE", "one two", "two one", None, "", " \n", "　"] * 2
    rng.shuffle(texts)
    texts += rng.sample(texts, 6)
    data = [(i * 3 % 331 if i < 118 else 3 * i - 340, t) for i, t in enumerate(texts)] + [(None, "one"), (None, texts[0])]
    frame = spark.createDataFrame([(i, t, 1, "c") for i, t in data], "doc_id bigint, text string, n int, set_key string")
    found = near_copies(frame, shingle=size, percent=percent).collect()
    plain = lambda v: -1 if v is None else v
    assert sorted((plain(r.doc_id), r.n_shingles, plain(r.component_id), r.kept) for r in found) == expected(data, size, percent)
    assert len({r.component_id for r in found}) < len(data) - 20


def test_defined_cases(spark):
    frame = spark.createDataFrame([(5, "a b c d"), (2, "a b c d"), (5, "x y z w v"), (9, "x y z w v")], "doc_id bigint, text string")
    assert {(r.doc_id, r.component_id) for r in near_copies(frame, shingle=3).collect()} == {(5, 2), (2, 2), (9, 2)}
    assert near_copies(frame.limit(0)).count() == 0


def test_circulant_estimates():
    rng = np.random.default_rng(0)
    minhash = CirculantMinHash(400)
    for share in (0.5, 0.8, 0.9):
        both = rng.integers(0, 2**63, int(600 * share)).astype(np.uint64)
        rest = rng.integers(0, 2**63, 600 - len(both)).astype(np.uint64)
        a, b = np.concatenate([both, rest[::2]]), np.concatenate([both, rest[1::2]])
        assert abs((minhash.signature(a) == minhash.signature(b)).mean() - share) < 0.08
    assert (1 - 0.85**5) ** bands_for(0.85) <= 1e-7


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7)]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    links = [(a, b) for a, b in links if a != b]
    want = groups({n for pair in links for n in pair}, links)
    assert {r.node: r.component for r in found} == want and len(found) == len(want)


def leaked(docs, items, size=5, percent=80):
    cut = lambda text: [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    runs = lambda words, k: {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}
    out = set()
    for item_id, text in items:
        words = cut(text)
        if item_id is None or not words:
            continue
        k = min(size, len(words))
        own = runs(words, k)
        for doc_id, body in docs:
            n = len(own & runs(cut(body), k))
            if doc_id is not None and 100 * n >= percent * len(own):
                out.add((doc_id, item_id, len(own), n))
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(8)
    words = [rng.choice("pqrst") + str(i) for i in range(400)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 3, 4, 5, 6, 9, 20, 40, 57])))) for i in range(60)]
    items += [(70, None), (71, "--"), (None, items[0][1]), (72, items[9][1])]
    docs = []
    for i in range(150):
        body = rng.choices(words, k=rng.choice([0, 3, 30, 300, 3000]))
        for _ in range(rng.randrange(3)):
            piece = items[rng.randrange(60)][1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                piece[rng.randrange(len(piece))] = "zz"
            at = rng.randint(0, len(body))
            body[at:at] = piece
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(body).title()))
    docs += [(200, None), (None, items[3][1]), (5, items[8][1])]
    by_id = spark.createDataFrame([(*d, 1) for d in docs if d[0] != 5 or d[1] == items[8][1]], "doc_id bigint, text string, item_id int")
    asked = spark.createDataFrame([(*i, 2) for i in items], "item_id bigint, text string, doc_id int")
    want = leaked([d for d in docs if d[0] != 5 or d[1] == items[8][1]], items)
    assert len(want) > 60
    assert {tuple(r) for r in leaks(by_id, asked).collect()} == want
    assert leaks(by_id.limit(0), asked).count() == 0 and leaks(by_id, asked.limit(0)).count() == 0


def test_items_of_one_id_are_looked_for_each_by_itself(spark):
    first, second = "one two three four five six seven", "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(1, f"so {first} it is"), (2, f"and {second} too"), (3, f"{second} {first}"), (4, "none")], "doc_id bigint, text string")
    items = spark.createDataFrame([(9, first), (9, second), (9, first.upper()), (8, "none of it")], "item_id bigint, text string")
    assert sorted(map(tuple, leaks(docs, items).collect())) == [(1, 9, 3, 3), (2, 9, 6, 6), (3, 9, 3, 3), (3, 9, 6, 6)]
