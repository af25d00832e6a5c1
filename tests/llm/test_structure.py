"""Structure repairs against trying every repair."""

import hashlib
import random
import re
import zlib

import pytest

from tidemark.llm import structure
from tidemark.llm.structure import Costs, repair_rows, repair_structure, repaired_digests


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def every_repair(rows, most_inserts):
    """All edit sequences that lead to a legal order: (cost, audit, repaired lines)."""
    marks, found = faults(rows), []

    def go(i, audit, lines, cost, made):
        initials = "".join(r[:1] or "?" for r, _ in lines)  # an empty role has no legal place
        if not re.fullmatch("s?(ua)*u?", initials):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            found.append((cost, audit, lines))
        if made < most_inserts:
            for role in ("user", "assistant"):
                go(i, audit + "I", [*lines, (role, "")], cost + 5, made + 1)
        if i < len(rows):
            role, text = rows[i]
            go(i + 1, audit + "D", lines, cost + 2, made)
            if marks[i] not in ("blank", "duplicate"):
                more = 5 if marks[i] == "truncated" else 0
                go(i + 1, audit + "K", [*lines, (role, text)], cost + more, made)
                for new in ("user", "assistant"):
                    go(i + 1, audit + "R", [*lines, (new, text)], cost + 1 + more, made)

    go(0, "", [], 0, 0)
    return min(found, key=lambda f: f[:2])


def summary(turns, most_inserts=2):
    """The contract's columns for one conversation given as (turn, role, text) in order."""
    rows = [(r, t) for _, r, t in turns]
    marks = faults(rows)
    numbers = {t for t, *_ in turns if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    pairs = [a[:1] + b[:1] for (a, _), (b, _) in zip(rows, rows[1:], strict=False)]
    cost, audit, lines = every_repair(rows, most_inserts)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    return (gaps, *(marks.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)


def some_turns(rng, n):
    texts = ["Yes.", "Why?", "no end", "", " \t", "Fine!  ", "Yes.", "ends.\x0b", "a ", ". x"]
    return [(rng.choice(["system", "user", "user", "assistant", "assistant", "tool", ""]), rng.choice(texts) + rng.choice(["", "", f"{rng.randint(0, 9)}."])) for _ in range(n)]


def test_search_equals_every_repair():
    rng = random.Random(5)
    for _ in range(250):
        rows = some_turns(rng, rng.randint(0, 5))
        marks = faults(rows)
        tasks = [("sua".find(r[:1]) if r[:1] in set("sua") else 3, m in ("blank", "duplicate"), m == "truncated") for (r, _), m in zip(rows, marks, strict=True)]
        assert repair_rows(tasks, Costs()) == every_repair(rows, 2)[:2]


def test_other_costs():
    # cheap inserts are preferred to deleting
    assert repair_rows([(1, False, False), (1, False, False)], Costs(insert=1, rerole=9, delete=9)) == (2, "KIKI")
    assert repair_rows([(1, False, False), (1, False, False)], Costs(insert=9, rerole=9, delete=1)) == (2, "DD")


@pytest.mark.parametrize("chunk, fan", [(128, 16), (3, 2), (2, 3)])
def test_tables_equal_plain_python(spark, monkeypatch, chunk, fan):
    monkeypatch.setattr(structure, "CHUNK", chunk)
    monkeypatch.setattr(structure, "FAN", fan)
    rng = random.Random(chunk)
    data, want = [], {}
    for conv in [*range(30), None]:
        turns = [(None if i == 0 and rng.random() < 0.2 else 2 * i + rng.randint(0, 1), r, t) for i, (r, t) in enumerate(some_turns(rng, rng.randint(1, 5)))]
        want[conv] = summary(turns)
        data += [(conv, *t, "clash", 7) for t in turns]
    rng.shuffle(data)
    frame = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string, audit string, n int")
    repaired = repair_structure(frame)
    digests = {r.conv_id: r.sha256 for r in repaired_digests(repaired.edits).collect()}
    none = hashlib.sha256(b"").hexdigest()
    got = {
        r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digests.get(r.conv_id, none))
        for r in repaired.conversations.collect()
    }
    assert got == want


def test_long_conversation_over_many_tasks(spark):
    """A third of the rows in one conversation, with a very long turn; chunks agree with one search."""
    rng = random.Random(8)
    texts = [f"{i}." if rng.random() < 0.8 else rng.choice(["", "open", "1."]) for i in range(1500)]
    texts[700] = "long " * 60_000 + "."
    turns = [(1, i, rng.choice(["user", "assistant", "assistant", "system"]), t) for i, t in enumerate(texts)]
    others = [(2 + i // 3, i % 3, ["user", "assistant", "user"][i % 3], f"t{i}!") for i in range(3000)]
    frame = spark.createDataFrame(turns + others, "conv_id bigint, turn bigint, role string, text string").repartition(6)
    found = {r.conv_id: r for r in repair_structure(frame).conversations.collect()}
    rows = [(r, t) for *_, r, t in turns]
    marks = faults(rows)
    tasks = [("sua".find(r[:1]), m in ("blank", "duplicate"), m == "truncated") for (r, _), m in zip(rows, marks, strict=True)]
    assert (found[1].cost, found[1].audit) == repair_rows(tasks, Costs())
    assert len(found) == 1001 and found[5].audit == "KKD" and found[5].cost == 2


def test_edits_and_empty_table(spark):
    frame = spark.createDataFrame([(1, 1, "assistant", "Hi."), (1, 2, "assistant", "You?"), (1, 3, None, None)], "conv_id bigint, turn bigint, role string, text string")
    repaired = repair_structure(frame)
    rows = sorted((r.at, r.edit, r.n, r.turn, r.role, r.new_role, r.text) for r in repaired.edits.collect())
    assert rows == [(0, "R", 0, 1, "assistant", "user", "Hi."), (1, "K", 1, 2, "assistant", "assistant", "You?"), (2, "D", 2, 3, " ", None, " ")]
    empty = repair_structure(frame.limit(0))
    assert empty.conversations.collect() == [] and empty.edits.collect() == []


def test_registered_query(spark, tmp_path):
    from tidemark.llm.queries import QUERIES

    rng = random.Random(12)
    data = []
    for conv in [*range(60), None]:
        for turn, (role, text) in enumerate(some_turns(rng, rng.randint(1, 5))):
            data.append((conv, turn + rng.choice([0, 0, 100]), role if rng.random() < 0.95 else None, text if rng.random() < 0.95 else None))
    data += [(500, None, "user", "Lone."), (501, 3, "user", "gone?")]
    data = list({(c, t): (c, t, r, x) for c, t, r, x in data}.values())
    spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    want = {}
    for conv in {c for c, *_ in data}:
        own = sorted((d for d in data if d[0] == conv), key=lambda d: (d[1] is not None, d[1] or 0))
        turns = []
        for c, turn, role, text in own:
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            turns += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        want[conv] = summary(turns)
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in QUERIES["op12_structure_repair"](spark, str(tmp_path)).collect()}
    assert got == want
