"""JSON arrays cut by many tasks, against the standard library's parser."""

import json
import random

import pytest

from tidemark import read_table
from tidemark.sources.arrays import moves, read_arrays

from .test_records import small_ranges  # noqa: F401


def value(rng, deep=0):
    kind = rng.random()
    if kind < 0.5:
        return "".join(rng.choice(["a", "}", "{", "[", "]", ",", '"', "\\", "\\\\", "\n", "ü", "}]", '"}', " "]) for _ in range(rng.choice([0, 1, 4, 30])))
    if kind < 0.7 or deep > 3:
        return rng.choice([None, True, 12, -1.5])
    if kind < 0.85:
        return [value(rng, deep + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(["k", "}", "x y"]): value(rng, deep + 1) for _ in range(rng.randint(0, 2))}


@pytest.mark.parametrize("layout", [{}, {"indent": 2}, {"separators": (",", ":"), "ensure_ascii": False}])
def test_records_equal_the_parser(spark, tmp_path, small_ranges, layout):  # noqa: F811
    rng = random.Random(len(layout) + len(layout.get("separators", "")))
    want = []
    for name in ("a.json", "b.json", "c.json"):
        rows = [{"id": i, "v": value(rng), "w": value(rng)} for i in range(rng.choice([0, 300, 600]))]
        if name == "b.json":  # one record over many ranges
            rows += [{"id": 0, "v": [value(rng) for _ in range(900)], "w": "x" * 9000}, {}]
        (tmp_path / name).write_text(("\ufeff " if name == "a.json" else "") + json.dumps(rows, **layout) + "\n", encoding="utf-8")
        want += rows
    found = read_arrays(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() > 10
    got = sorted(found.collect())
    assert [r["id"] for r in got] == list(range(len(want)))
    assert [json.loads(r["record"]) for r in got] == want


def test_every_cut_gives_the_same_records(spark, tmp_path, small_ranges):  # noqa: F811
    want = [{"a": "}{\\\"", "b": {"c": [{"d": {}}, "]"]}}, {}, {"a": "\\\\", "b": None}]
    text = json.dumps(want)
    (tmp_path / "a.json").write_text(text)
    for size in (1, 2, 3, 5, 7, 11, 200):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        assert [json.loads(r["record"]) for r in sorted(read_arrays(spark, str(tmp_path / "a.json")).collect())] == want


def test_arrays_as_tables(spark, tmp_path, small_ranges):  # noqa: F811
    rows = [{"z": i, "a": f"}}{i}", "m": None if i % 2 else {"q": i}} for i in range(500)]
    path = tmp_path / "a.json"
    path.write_text(json.dumps(rows, indent=1))
    table = read_table(spark, str(path), row_id=True)
    assert table.columns == ["_row_id", "z", "a", "m"]
    assert [(r[0], r.z, r.a, r.m and r.m.q) for r in table.orderBy("_row_id").collect()] == [(i, r["z"], r["a"], r["m"] and r["m"]["q"]) for i, r in enumerate(rows)]
    typed = read_table(spark, str(path), schema="a string, z string")
    assert typed.dtypes == [("a", "string"), ("z", "string")] and typed.where("a = concat('}', z)").count() == 500
    for empty in ("[]", " [ ]\n"):
        path.write_text(empty)
        assert read_table(spark, str(path)).count() == 0
    path.write_text("[{}, {}]")
    assert read_table(spark, str(path)).count() == 2


@pytest.mark.parametrize("text", ['[{"a": 1}, 2]', '[[{"a": 1}]]', '[{"a": 1}', '[{"a": "1}]', '[{"a": 1},]', '[{"a": 1} {"a": 2}]', '[{"a": 1}] x', '[{"a": b}]'])
def test_other_arrays_are_errors(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception):
        read_table(spark, str(tmp_path / "a.json")).collect()


def test_moves():
    assert moves('{"a": [{') == (False, 3, 0)
    assert moves('x", "b": "\\"{"') == (True, 1, 0)  # entered outside, the brace is outside too
    assert moves('"a": ["{') == (True, 1, 1)
    assert moves("") == (False, 0, 0)
