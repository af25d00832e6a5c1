"""Role repair against a search over all repairs."""

import random
from functools import cache

import pytest

from tidemark.llm import chat
from tidemark.llm.chat import Format, render, repair_roles

LEGAL = {"start": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]}


def least_cost(roles):
    """By trying every choice for every turn, an inserted turn at a time."""

    @cache
    def best(i, state, budget):
        if budget < 0:
            return None
        options = []
        if i == len(roles):
            if state == "assistant":
                return 0
        else:
            for new in ("system", "user", "assistant"):
                change = 1 if roles[i] not in LEGAL or roles[i] == "start" else 0 if roles[i] == new else 2
                if new in LEGAL[state]:
                    options.append((change, best(i + 1, new, budget - change)))
                if new == state:
                    options.append((change + 1, best(i + 1, new, budget - change - 1)))
        for new in LEGAL[state]:
            options.append((3, best(i, new, budget - 3)))
        found = [a + b for a, b in options if b is not None]
        return min(found, default=None)

    return next(c for c in range(200) if best(0, "start", c) == c)


def legal(text):
    last = "start"
    for part in text.split("\n<|end|>\n")[:-1]:
        role = part.split("\n")[0].strip("<|>")
        assert role in LEGAL[last], (last, role)
        last = role
    return last == "assistant"


@pytest.mark.parametrize("chunk", [3, 512])
def test_cost_is_least_and_result_legal(spark, monkeypatch, chunk):
    monkeypatch.setattr(chat, "CHUNK", chunk)
    rng = random.Random(chunk)
    roles = ["user", "assistant", "system", " User ", "tool", None, "assistant", "user"]
    data, convs = [], {}
    for conv in range(60):
        turns = [(conv, t, rng.choice(roles), rng.choice([f"c{conv}t{t}", "", None])) for t in range(rng.randint(1, 14))]
        convs[conv] = turns
        data += turns
    rng.shuffle(data)
    frame = spark.createDataFrame([(*r, 1, "x") for r in data], "conv_id bigint, turn bigint, role string, text string, part int, way string")
    repaired = repair_roles(frame)
    found = {r.conv_id: r for r in render(repaired).collect()}
    for conv, turns in convs.items():
        assert found[conv].cost == least_cost(tuple((r or "?").strip().lower() for _, _, r, _ in turns)), turns
        assert legal(found[conv].text)
        assert [p for p in found[conv].text.split() if p.startswith("c")] == [t for *_, t in turns if t]
    rows = repaired.where("conv_id = 0").orderBy("position").collect()
    assert [r.turn for r in rows] == [t for _, t, *_ in convs[0]] and [r.position for r in rows] == list(range(len(rows)))


def test_a_long_conversation_spreads_over_tasks(spark):
    roles = ["user", "assistant", "assistant", "user"]
    data = [(7, t, roles[t % 4], str(t)) for t in range(6000)] + [(c, 0, "user", "hi") for c in range(20) if c != 7]
    frame = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string").repartition(8)
    repaired = repair_roles(frame)
    rows = repaired.where("conv_id = 7").orderBy("position").collect()
    assert [r.turn for r in rows] == list(range(6000))
    text = "".join(r.rendered for r in rows)
    assert legal(text)
    assert sum(r.cost for r in rows) == least(roles, 6000)


def least(roles, n):
    rules = Format()
    value = [0] + [float("inf")] * 3
    for t in range(n):
        step = rules.steps[rules.code(roles[t % 4])]
        value = [min(value[q] + step[q][s] for q in range(4)) for s in range(4)]
    return min(v + 3 * len(c) for v, c in zip(value, rules.closing, strict=True))


def test_defined_cases(spark):
    data = [(None, 1, "user", "a"), (None, None, "system", "s"), (None, 2, "assistant", "b"), (1, 0, "assistant", "x"), (1, 0, "assistant", "x")]
    frame = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string")
    found = {r.conv_id: (r.cost, r.text) for r in render(repair_roles(frame)).collect()}
    assert found[None] == (0, "<|system|>\ns\n<|end|>\n<|user|>\na\n<|end|>\n<|assistant|>\nb\n<|end|>\n")
    assert found[1] == (2, "<|user|>\nx\n<|end|>\n<|assistant|>\nx\n<|end|>\n")
    assert repair_roles(frame.limit(0)).count() == 0
