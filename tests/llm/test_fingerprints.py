"""Fingerprint groups against all pairs of fingerprints."""

import random
from itertools import combinations

import pytest
import xxhash

from tidemark.llm.fingerprints import _by_midpoints, fingerprint, near_fingerprints, segments
from tidemark.sources.scratch import freeze


def plain_fingerprint(text, size=4):
    words = []
    for w in (text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" "):
        if w:
            words.append("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w))
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(rows, distance):
    parent = {fp: fp for _, fp in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for a, b in combinations(list(parent), 2):
        if (a ^ b).bit_count() <= distance:
            parent[find(a)] = find(b)
            links += 1
    least = {}
    for doc_id, fp in rows:
        least.setdefault(find(fp), []).append(doc_id)
    ids = {root: min((i for i in found if i is not None), default=None) for root, found in least.items()}
    return {(doc_id, fp): ids[find(fp)] for doc_id, fp in rows}, links


def corpus(rng):
    words = [f"w{i}" for i in range(400)] + ["Größe", "naïve", "x y", "K"]
    bases = [[rng.choice(words) for _ in range(rng.choice([3, 8, 60, 200, 400]))] for _ in range(12)]
    data = []
    for i in range(220):
        own = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            own[rng.randrange(len(own))] = rng.choice(words)
        data.append((i + 10, rng.choice([" ", "\n", " \t "]).join(own)))
    hot = [f"h{i}" for i in range(900)]
    for i in range(120):
        own = list(hot)
        own[7 * i % 900] = f"changed{i}"
        data.append((1000 + i, " ".join(own)))
    data += [(1, None), (2, ""), (3, " \n\t"), (None, "w1 w2"), (None, " ".join(hot)), (4, "w1 W2"), (5, "solo"), (5, "solo"), (6, "word " * 70_000), (7, "WORD\n" * 69_999)]
    return data


@pytest.mark.parametrize("distance, crowd", [(4, 512), (4, 2), (3, 2), (2, 512), (1, 3)])
def test_components_equal_all_pairs(spark, distance, crowd):
    data = corpus(random.Random(distance))
    frame = spark.createDataFrame([(i, t, 0, "x") for i, t in data], "doc_id bigint, text string, fp int, n string")
    rows = [(i, plain_fingerprint(t)) for i, t in data]
    want, links = groups(rows, distance)
    got = near_fingerprints(frame, distance=distance, crowd=crowd).collect()
    assert links > 80
    assert sorted((r.doc_id or 0, r.fp % 2**64) for r in got) == sorted((i or 0, fp) for i, fp in rows)
    assert {(r.doc_id, r.fp % 2**64): r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_midpoints_are_not_broadcast_nor_made_in_one_task(spark):
    """A small table of fingerprints names 2,081 points each, which the planner does not know of."""
    rng = random.Random(11)
    bases = [rng.getrandbits(64) for _ in range(6)]
    fps = {b ^ sum(1 << bit for bit in rng.sample(range(64), rng.choice([0, 1, 2, 3, 6]))) for b in bases for _ in range(200)}
    signed = [(fp - (1 << 64) if fp >> 63 else fp,) for fp in sorted(fps)]
    links = _by_midpoints(freeze(spark.createDataFrame(signed, "fp bigint").coalesce(1), "crowded"), 4)
    found = {(r.a % 2**64, r.b % 2**64) for r in links.collect()}
    assert all((a ^ b).bit_count() <= 4 for a, b in found)

    def groups_of(pairs):
        parent = {fp: fp for fp in fps}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[find(a)] = find(b)
        return sorted(sorted(x for x in fps if find(x) == root) for root in {find(x) for x in fps})

    assert groups_of(found) == groups_of((a, b) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 4)
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert len(fps) > 900 and "REPARTITION_BY_NUM" in plan


def test_fingerprints_are_as_defined():
    for text in ("", " \x0b", "one", "One two THREE", "a b c d", "a b c d e f g ä Ä", "x\x85y \x1c z"):
        assert fingerprint(text.encode(), 4) % 2**64 == plain_fingerprint(text)


def test_segments_leave_one_with_at_most_one_bit():
    rng = random.Random(3)
    for distance in (1, 2, 3, 4):
        parts = segments(distance)
        assert parts[0][0] == 0 and parts[-1][1] == 64
        for _ in range(300):
            bits = rng.sample(range(64), distance)
            assert any(sum(low <= b < high for b in bits) <= 1 for low, high in parts)


def test_empty_table_and_bad_distance(spark):
    frame = spark.createDataFrame([], "doc_id bigint, text string")
    assert near_fingerprints(frame).collect() == []
    with pytest.raises(ValueError):
        near_fingerprints(frame, distance=5)


def test_registered_query(spark, tmp_path):
    from tidemark.llm.queries import QUERIES

    data = corpus(random.Random(9))
    data = [row for row in data if row[0] is not None]
    spark.createDataFrame(data, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = [(i, plain_fingerprint(t)) for i, t in data]
    want, _ = groups(rows, 4)
    got = QUERIES["op11_fingerprints"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{fp:016x}", want[i, fp]) for i, fp in rows)
