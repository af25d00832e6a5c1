"""Line classes against all pairs of lines."""

import random
import re
from itertools import combinations

import pytest

from tidemark.llm import fuzzy_lines as module
from tidemark.llm.fuzzy_lines import block_simhash, drop_lines, fuzzy_lines, line_keys


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def normal(line):
    return re.sub(r"[\W_]+", " ", line.lower()).strip()


def similar(a, b, percent):
    return 100 * levenshtein(a, b) <= (100 - percent) * max(len(a), len(b))


def expected(spark, data, percent, keyed=True):
    """Classes by all pairs of lines; with ``keyed``, of those alone that agree on a key."""
    lines = [(d, no, normal(line)) for d, text in data for no, line in enumerate((text or "").split("\n")) if normal(line)]
    kinds = sorted({n for *_, n in lines})
    frame = spark.createDataFrame([(n,) for n in kinds], "norm string")
    keys = {r["norm"]: set(r["keys"]) for r in line_keys(frame).collect()}
    parent = {n: n for n in kinds}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    links = 0
    for a, b in combinations(kinds, 2):
        if keyed:
            x, y = set(a.split(" ")), set(b.split(" "))
            if not keys[a] & keys[b] or 3 * len(x & y) < max(len(x), len(y)):
                continue
        if abs(len(a) - len(b)) * 100 <= (100 - percent) * max(len(a), len(b)) and similar(a, b, percent):
            parent[find(a)] = find(b)
            links += 1
    first = {}
    for doc_id, no, norm in sorted(lines):
        first.setdefault(find(norm), (doc_id, no))
    return {(d, no, *first[find(n)], (d, no) == first[find(n)]) for d, no, n in lines}, links


def near_lines(rng, n):
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa"]
    bases = [[rng.choice(words) + str(rng.randint(0, 40)) for _ in range(rng.choice([1, 5, 30, 60, 80]))] for _ in range(8)]
    out = []
    for _ in range(n):
        line = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            line[rng.randrange(len(line))] += rng.choice(["", "x", "s"])
        out.append(rng.choice([" ", ", ", "  "]).join(line).capitalize() if rng.random() < 0.9 else rng.choice(["", "--", "x", "12"]))
    return out


@pytest.mark.parametrize("percent", [80, 92])
def test_classes_equal_all_pairs(spark, percent):
    rng = random.Random(percent)
    lines = near_lines(rng, 260)
    wide = " ".join(f"w{i * 7919 % 1000}" for i in range(600))
    data = [(i, "\n".join(lines[10 * i : 10 * i + 10])) for i in range(26)] + [(90, None), (91, ""), (92, "solo"), (93, "word " * 3000), (94, wide), (95, wide.upper() + " more"), (96, wide[:-9])]
    frame = spark.createDataFrame([(i, t, "clash", 1) for i, t in data], "doc_id bigint, text string, h string, line_no int")
    want, links = expected(spark, data, percent)
    got = {tuple(r) for r in fuzzy_lines(frame, percent=percent).collect()}
    assert links > 20
    assert got == want
    assert sum(r[2:4] == (94, 0) for r in got) == 3


def test_lines_found_of_all_similar_ones(spark):
    """Recall against plain edit similarity, without keys in the expectation."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghiklmnoprstuvw", k=rng.randint(2, 9))) for _ in range(3000)]
    pairs = []
    while len(pairs) < 300:
        line = rng.choices(vocabulary, k=rng.randint(5, 50))
        other = list(line)
        for _ in range(rng.randint(1, max(1, len(line) // 10))):
            at = rng.randrange(len(other))
            other[at : at + 1] = rng.choice([[rng.choice(vocabulary)], [other[at] + "x"], [other[at][1:] or "q"], [], [other[at], "new"]])
        a, b = " ".join(line), " ".join(other)
        if a != b and similar(a, b, 80):
            pairs.append((a, b))
    frame = spark.createDataFrame([(i, f"{a}\n{b}") for i, (a, b) in enumerate(pairs)], "doc_id bigint, text string")
    got = fuzzy_lines(frame).collect()
    assert all(r.class_doc_id == r.doc_id for r in got)  # unrelated lines stay apart
    assert sum(not r.kept for r in got) >= 0.9 * len(pairs)


def test_blocks_are_simhashes_and_pigeonholes(spark):
    rng = random.Random(1)
    for size in (1, 2, 5, 9, 30):
        words = [rng.getrandbits(64) - 2**63 for _ in range(size)]
        got = spark.createDataFrame([(words,)], "w array<bigint>").selectExpr(f"{block_simhash('w')} as s").first().s
        assert got % 2**64 == sum(1 << k for k in range(64) if 2 * sum(w >> k & 1 for w in words) > size)
    lines = [" ".join(f"w{rng.getrandbits(30)}" for _ in range(n)) for n in (5, 7, 9, 14, 22)]
    rows = [(i, line if j is None else " ".join(w if k != j else "other" for k, w in enumerate(line.split(" "))))
            for i, line in enumerate(lines) for j in (None, *range(len(line.split(" "))))]
    keys = {}
    for r in line_keys(spark.createDataFrame(rows, "i int, norm string")).collect():
        keys.setdefault(r.i, {})[r.norm] = set(r["keys"])
        assert len(r["keys"]) <= 32
    agree = [bool(of[lines[i]] & found) for i, of in keys.items() for found in of.values()]
    assert sum(agree) >= 0.97 * len(agree)  # one changed word; keys of too few words are left out


def test_words_in_other_order_are_one_bucket(spark):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(12)]
    data = [(i, " ".join(rng.sample(words, 12))) for i in range(60)]
    want, _ = expected(spark, data, 80)
    assert {tuple(r) for r in fuzzy_lines(spark.createDataFrame(data, "doc_id bigint, text string")).collect()} == want


def test_dropped_lines_and_documents(spark):
    data = [(1, "Keep this line.\n\nsecond line here"), (2, "keep this line\nfresh words"), (3, "KEEP THIS LINE!"), (4, "--\n"), (5, None), (None, "second line here\nown")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in data], "doc_id bigint, text string, lang string")
    out = {r.doc_id: r.text for r in drop_lines(frame, fuzzy_lines(frame)).collect()}
    assert out == {None: "second line here\nown", 1: "Keep this line.\n", 2: "fresh words", 4: "--\n", 5: None}
    assert fuzzy_lines(frame.limit(0)).count() == 0


def test_equal_lines_given_twice(spark):
    frame = spark.createDataFrame([(1, "one two\nthree"), (1, "one two\nthree")], "doc_id bigint, text string")
    assert sorted(map(tuple, fuzzy_lines(frame).distinct().collect())) == [(1, 0, 1, 0, True), (1, 1, 1, 1, True)]


def test_keys_and_documents_are_shuffled_once(spark, monkeypatch):
    """Buckets were joined with their keys again, and documents first with ids and then line by line."""
    joins, whole = {}, module.freeze

    def freeze(df, label, **more):
        joins[label] = df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
        return whole(df, label, **more)

    monkeypatch.setattr(module, "freeze", freeze)
    rng = random.Random(3)
    lines = near_lines(rng, 60)
    data = [(i, "\n".join(lines[10 * i : 10 * i + 10])) for i in range(6)]
    want, links = expected(spark, data, 80)
    assert {tuple(r) for r in fuzzy_lines(spark.createDataFrame(data, "doc_id bigint, text string")).collect()} == want
    assert links and joins["block-members"] == 0 and joins["candidate-texts"] == 1


def test_lines_of_a_pair_are_cut_into_words_once(spark):
    """The filter stood below the columns of words, so that lines were cut again wherever words were named."""
    rng = random.Random(4)
    kinds = sorted({normal(line) for line in near_lines(rng, 60)} - {""})
    texts = spark.createDataFrame(list(enumerate(kinds)), "id bigint, norm string")
    both = [(i, j) for i, j in combinations(range(len(kinds)), 2)]
    found = module._similar(texts, spark.createDataFrame(both, "a bigint, b bigint"), 80)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2

    def linked(x, y):
        v, w = set(x.split(" ")), set(y.split(" "))
        return similar(x, y, 80) and 3 * len(v & w) >= max(len(v), len(w))

    assert {tuple(r) for r in found.collect()} == {(i, j) for i, j in both if linked(kinds[i], kinds[j])}
