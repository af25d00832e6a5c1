"""Sources, sinks, reports and streams."""

import io
import json
import zipfile

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark import (
    AllowedValues, Cleaner, ExactDedup, NormalizeText, Required, convert, manifest, read_report, read_table, write_report,
    write_table,
)
from tidemark.sources.rowid import with_row_id
from tidemark.sources.tables import UnsupportedFormat, detect_format
from tidemark.streaming import clean_stream, dedup_stream, issue_rates


def test_formats_are_detected():
    assert detect_format("a/b.CSV") == "csv"
    assert detect_format("a/b.txt", "json") == "json"
    assert detect_format("/x/y.parquet/") == "parquet"
    for path, fmt in (("a/b.txt", None), ("a.b/c", None), ("x.csv", "html")):
        with pytest.raises(UnsupportedFormat):
            detect_format(path, fmt)


def test_csv_tokens_headers_and_order(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(' id , note\n1,"x, ""y"""\n2,N/A\n3,\n4, pad \n')
    table = read_table(spark, str(path), row_id=True)
    assert table.columns == ["_row_id", "id", "note"]
    assert [tuple(r) for r in table.orderBy("_row_id").collect()] == [
        (0, "1", 'x, "y"'), (1, "2", None), (2, "3", None), (3, "4", " pad "),
    ]
    assert read_table(spark, str(path), na_tokens=()).where("note = 'N/A'").count() == 1
    assert dict(read_table(spark, str(path), infer=True).dtypes)["id"] == "int"
    (tmp_path / "b.csv").write_text("a, a\n1,2\n")
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path / "b.csv"))
    with pytest.raises(AnalysisException):
        read_table(spark, str(tmp_path / "absent.csv"))


def test_csv_keeps_line_breaks_and_refuses_surplus_cells(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('k,note\n1,"two\nlines"\n2\n"3 ","x, y"\n')
    table = read_table(spark, str(path))
    assert sorted(map(tuple, table.collect()), key=str) == [("1", "two\nlines"), ("2", None), ("3 ", "x, y")]
    back = read_table(spark, write_table(table, str(tmp_path / "b.csv")))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, table.collect()), key=str)
    (tmp_path / "c.csv").write_text("a,b\n1,2\n3,4,5\n")
    for ask in (lambda t: t.collect(), lambda t: t.select("a").collect(), lambda t: t.count()):
        with pytest.raises(Exception, match="more cells"):
            ask(read_table(spark, str(tmp_path / "c.csv")))
    for header in ("a,b,a", "a,b,", "a, A"):
        (tmp_path / "d.csv").write_text(f"{header}\n1,2,3\n")
        with pytest.raises(ValueError):
            read_table(spark, str(tmp_path / "d.csv"))


def test_types_are_inferred_after_tokens(spark, tmp_path):
    (tmp_path / "a.csv").write_text("i,l,d,t,s,n,b\n5,5000000000,1.5,2026-01-02,x,NA,true\nN/A,NA,2,,7,,false\n")
    table = read_table(spark, str(tmp_path / "a.csv"), infer=True)
    assert [t for _, t in table.dtypes] == ["int", "bigint", "double", "date", "string", "string", "boolean"]
    typed = read_table(spark, str(tmp_path / "a.csv"), schema="i bigint, l bigint, d double, t date, s string, n int, b boolean")
    assert typed.agg({"i": "sum", "d": "sum"}).first()[:] in ((5, 3.5), (3.5, 5))


def test_json_is_told_by_its_first_character(spark, tmp_path):
    table = spark.range(100).select(F.col("id").alias("z"), F.lit("m").alias("a"), F.lit(None).cast("string").alias("m"))
    path = write_table(table.repartition(3), str(tmp_path / "lines.json"))
    back = read_table(spark, path)
    assert back.columns == ["z", "a", "m"] and back.count() == 100
    (tmp_path / "array.json").write_text('\n [{"z": 1, "b": 2,\n "a": 3}, {"c": 4}]')
    assert read_table(spark, str(tmp_path / "array.json")).columns == ["z", "b", "a", "c"]
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path / "array.json"), lines=True)
    with pytest.raises(ValueError):
        read_table(spark, path, lines=False)
    (tmp_path / "both").mkdir()
    (tmp_path / "both" / "a.json").write_text("[{}]")
    (tmp_path / "both" / "b.json").write_text("{}")
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path / "both"), "json")


def test_row_ids_are_contiguous_over_files(spark, tmp_path):
    for i, n in enumerate((5, 200, 1, 40)):
        (tmp_path / f"part{i}.csv").write_text("v\n" + "\n".join(f"{i}-{j:03d}" for j in range(n)) + "\n")
    table = read_table(spark, str(tmp_path), "csv", row_id=True)
    found = [r.v for r in table.orderBy("_row_id").collect()]
    assert found == [f"{i}-{j:03d}" for i, n in enumerate((5, 200, 1, 40)) for j in range(n)]
    assert [r[0] for r in table.select("_row_id").orderBy("_row_id").collect()] == list(range(246))
    shuffled = with_row_id(table.drop("_row_id").repartition(7, "v"))
    assert sorted(r[0] for r in shuffled.select("_row_id").collect()) == list(range(246))


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet", "orc"])
def test_round_trip(spark, tmp_path, fmt):
    source = spark.createDataFrame([("Ünï", None, 1), ("  b ", "q\"x", 2)], "name string, note string, n int")
    path = write_table(source, str(tmp_path / f"out.{fmt}"))
    back = read_table(spark, path, schema=source.schema if fmt in ("csv", "json") else None)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, source.collect()))
    if fmt == "json":
        text = "".join(p.read_text() for p in (tmp_path / "out.json").glob("part-*"))
        assert '"note":null' in text and "Ünï" in text


def test_json_array_and_conversion(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps([{"a": "001", "d": "2026-01-02"}, {"a": None, "d": "x"}], indent=2))
    convert(spark, str(path), str(tmp_path / "b.csv"))
    back = read_table(spark, str(tmp_path / "b.csv"))
    assert sorted(map(tuple, back.collect()), key=str) == [("001", "2026-01-02"), (None, "x")]


def workbook(rows):
    """A minimal workbook with shared strings, numbers and gaps."""
    strings, body = [], []
    for i, row in enumerate(rows, 1):
        cells = []
        for j, value in enumerate(row):
            ref = f"{chr(65 + j)}{i}"
            if isinstance(value, str):
                strings.append(value)
                cells.append(f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>')
            elif value is not None:
                cells.append(f'<c r="{ref}"><v>{value}</v></c>')
        body.append(f'<row r="{i}">{"".join(cells)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId7" Target="worksheets/first.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t xml:space='preserve'>{s}</t></si>" for s in strings) + "</sst>")
        z.writestr("xl/worksheets/first.xml", f"<worksheet {ns}><sheetData>{''.join(body)}</sheetData></worksheet>")
    return out.getvalue()


def test_workbook_folder(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook([["id", " name "], ["C1", " Ann "], ["C2", None], [3, "Bo"]]))
    (tmp_path / "b.xlsx").write_bytes(workbook([["id", "name"], ["C9", "Zed"]]))
    table = read_table(spark, str(tmp_path), "xlsx")
    assert table.columns == ["id", "name"]
    assert sorted(map(tuple, table.collect()), key=str) == [("3", "Bo"), ("C1", " Ann "), ("C2", None), ("C9", "Zed")]
    numbered = read_table(spark, str(tmp_path), "xlsx", row_id=True, na_tokens=("Bo",))
    assert sorted(r["_row_id"] for r in numbered.collect()) == [0, 1, 2, 3] and numbered.where("name = 'Bo'").isEmpty()
    single = read_table(spark, str(tmp_path / "b.xlsx"))
    assert [tuple(r) for r in single.collect()] == [("C9", "Zed")]


def test_workbooks_match_columns_by_name(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook([["id", "name"], ["1", "Ann"], [], [None, None], ["2", "Ben"], [None]]))
    (tmp_path / "b.xlsx").write_bytes(workbook([["name", "id", "extra"], ["Bo", "3", "e"]]))
    table = read_table(spark, str(tmp_path), "xlsx")
    assert table.columns == ["id", "name", "extra"]
    blank = (None, None, None)
    assert sorted(map(tuple, table.collect()), key=str) == sorted([("1", "Ann", None), blank, blank, ("2", "Ben", None), ("3", "Bo", "e")], key=str)
    (tmp_path / "c.xlsx").write_bytes(workbook([["id"], ["4", "surplus"]]))
    with pytest.raises(Exception, match="more cells"):
        read_table(spark, str(tmp_path), "xlsx").collect()


def test_workbook_dates_are_iso_text(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    styles = (
        f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd hh:mm"/><numFmt numFmtId="171" formatCode="0.00&quot;m&quot;"/></numFmts>'
        '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>'
    )
    source = zipfile.ZipFile(io.BytesIO(workbook([["d", "t", "m"], [46024, 46024.75, 1.5]])))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as target:
        for name in source.namelist():
            text = source.read(name).decode()
            for style, ref in enumerate(("A2", "B2", "C2"), 1):
                text = text.replace(f'<c r="{ref}">', f'<c r="{ref}" s="{style}">')
            target.writestr(name, text)
        target.writestr("xl/styles.xml", styles)
    (tmp_path / "a.xlsx").write_bytes(out.getvalue())
    assert [tuple(r) for r in read_table(spark, str(tmp_path / "a.xlsx")).collect()] == [("2026-01-02 00:00:00", "2026-01-02 18:00:00", "1.5")]


def test_report_round_trip_and_manifest(spark, tmp_path, cells):
    run = Cleaner([NormalizeText(["a"]), Required(["a"]), ExactDedup()]).run(cells(["a"], [(" x ",), ("x",), (None,)]))
    tables = read_report(spark, write_report(run, str(tmp_path / "report")))
    for name in ("summary", "report", "changes", "issues", "duplicates", "suggestions"):
        expected = getattr(run, name)
        assert tables[name].columns == expected.columns
        assert sorted(map(str, tables[name].collect())) == sorted(map(str, expected.collect()))
    assert [tuple(r) for r in manifest(spark, "d/clean.csv", "d/report").collect()] == [
        ("Clean output", "clean.csv", "csv"), ("Audit report", "report", "report"),
    ]


def drain(writer, path):
    writer.option("checkpointLocation", str(path)).trigger(availableNow=True).start().awaitTermination()


def test_stream_steps_match_batch(spark, tmp_path):
    source = spark.range(60).select("id", F.concat(F.lit(" n "), F.col("id") % 7).alias("name"), F.lit("ok").alias("status"))
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    plan = Cleaner([NormalizeText(["name"]), AllowedValues(["name"], ["n 1"])])
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drain(clean_stream(stream, plan, str(tmp_path / "out"), key="id"), tmp_path / "ck")
    batch = plan.run(source, key="id")
    got = spark.read.parquet(str(tmp_path / "out" / "data")).select("id", "name")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.data.select("id", "name").collect()))
    got = spark.read.parquet(str(tmp_path / "out" / "issues")).select("row_id", "value")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.issues.select("row_id", "value").collect()))
    with pytest.raises(ValueError):
        clean_stream(stream, Cleaner([ExactDedup()]), str(tmp_path / "no"), key="id")


def test_stream_dedup_and_rates(spark, tmp_path):
    source = spark.range(40).select(
        "id", F.timestamp_seconds(F.col("id") * 600).alias("ts"), F.concat(F.lit("U "), F.col("id") % 5).alias("name")
    )
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    kept = dedup_stream(stream, ["name"], "ts", "1 day").select("name")
    drain(kept.writeStream.format("parquet").option("path", str(tmp_path / "out")), tmp_path / "ck")
    assert sorted(r.name for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [f"U {i}" for i in range(5)]
    rates = issue_rates(source, [AllowedValues(["name"], ["u 0"])], "ts", "id", "1 hour")
    assert sum(r.issues for r in rates.collect()) == 32 and rates.count() == 7
