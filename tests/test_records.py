"""CSV records cut by many tasks, against Spark's reader of whole files."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark import read_table
from tidemark.sources.records import ends_inside, read_records


@pytest.fixture
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for name in names:
        spark.conf.set(name, "2000")
    yield
    for name, value in zip(names, before, strict=True):
        spark.conf.set(name, value)


def whole(spark, path, width):
    """Spark's reader, which finds out the line ends of a file by itself."""
    schema = ", ".join(f"c{i} string" for i in range(width))
    return spark.read.options(escape='"', multiLine=True, header=True).schema(schema).csv(str(path))


def cell(rng):
    plain = "".join(rng.choice(["a", "b", " ", "ü", "x y"]) for _ in range(rng.randint(0, 4)))
    kind = rng.random()
    if kind < 0.5:
        return plain
    if kind < 0.6:
        return plain + 'in"ch ' + rng.choice(["", '"'])
    body = "".join(rng.choice(["a", ",", "\n", "\r\n", '""', " ", "\n\n", "word "]) for _ in range(rng.choice([0, 1, 3, 40])))
    return f'"{body}"' + (rng.choice(["", " ", "tail"]) if kind > 0.95 else "")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_equal_whole_file_reader(spark, tmp_path, small_ranges, end):
    rng = random.Random(len(end))
    rows = [",".join([str(i), cell(rng), cell(rng)]) for i in range(1500)]
    rows = [r + rng.choice(["", "", "", end]) for r in rows]
    path = tmp_path / "a.csv"
    path.write_bytes((end.join(["id,one, two ", *rows]) + end).encode())
    table = read_table(spark, str(path), na_tokens=("",), row_id=True)
    assert table.rdd.getNumPartitions() > 10
    want = [tuple(c or None for c in r) for r in whole(spark, path, 3).collect()]
    got = [tuple(r)[1:] for r in sorted(table.collect())]
    assert len(got) == 1500 and sorted(r[0] for r in table.collect()) == list(range(1500))
    if end == "\r\n":  # cells keep their line breaks as written; Spark's reader rewrites them in such files
        got = [tuple(c and c.replace("\r\n", "\n") for c in r) for r in got]
    assert got == want


def test_every_cut_gives_the_same_records(spark, tmp_path, small_ranges):
    text = 'a,b\n1,"x\ny"\n2,z\n"3 ""q""","\n\n,"\n\n4,\n5,"open\n'
    (tmp_path / "a.csv").write_text(text)
    want = [("1", "x\ny"), ("2", "z"), ('3 "q"', "\n\n,"), ("4", None), ("5", "open\n")]
    for size in range(3, len(text) + 7, 6):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        rows = read_records(spark, str(tmp_path / "a.csv")).rows
        cells = rows.select("id", F.from_csv("record", "a string, b string", {"escape": '"', "multiLine": "true", "lineSep": "\n"}).alias("r"))
        assert [tuple(r["r"]) for r in sorted(cells.collect(), key=lambda r: r["id"])][:4] == want[:4], size
        assert [r["id"] for r in sorted(cells.collect())] == list(range(5))


def test_quote_states():
    for line, inside, after in (
        ("a,b", False, False), ('"a', False, True), ('a"', False, False), ('a,"b""', False, True), ('a,"b""",', False, False),
        ("x", True, True), ('x"', True, False), ('x",y,"', True, True), ('x"y",z', True, False), ('""', False, False), ('""', True, True),
    ):
        assert ends_inside(line, inside) is after, line


def test_columns_go_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text('"Y" ,x\n20,10\n"3\n0",\n')
    (tmp_path / "c.csv").write_text("y\n7\n")
    table = read_table(spark, str(tmp_path), "csv", row_id=True)
    assert table.columns == ["_row_id", "x", "y"]
    assert sorted(map(tuple, table.collect())) == [(0, "1", "2"), (1, "10", "20"), (2, None, "3\n0"), (3, None, "7")]
    assert [tuple(r) for r in table.select("x").where("x = '10'").collect()] == [("10",)]
    (tmp_path / "d.csv").write_text("y\n7,8\n")
    with pytest.raises(Exception, match="more cells"):
        read_table(spark, str(tmp_path), "csv").collect()
    (tmp_path / "d.csv").write_text("y,z\n7,8\n")
    with pytest.raises(ValueError, match="z"):
        read_table(spark, str(tmp_path), "csv")
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "old.csv").write_bytes(b"a,b\r1,2\r3,4\r")
    assert sorted(map(tuple, read_table(spark, str(tmp_path / "e" / "old.csv")).collect())) == [("1", "2"), ("3", "4")]
