"""Reading and writing tables as CSV, JSON, XLSX folders, Parquet or ORC."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import array_lines
from .records import read_records
from .rowid import ROW_ID, number_files, with_row_id
from .workbooks import read_workbooks

READ_FORMATS = ("csv", "json", "xlsx", "parquet", "orc")
WRITE_FORMATS = ("csv", "json", "parquet", "orc")

# Cell texts that mean "no value" in a CSV file.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


class UnsupportedFormat(ValueError):
    pass


def detect_format(path: str, fmt: str | None = None, allowed=READ_FORMATS) -> str:
    """An explicit format wins; otherwise the suffix decides, in any case."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    found = (fmt or (name.rsplit(".", 1)[1] if "." in name else "")).strip().lower()
    if found not in allowed:
        raise UnsupportedFormat(f"No reader or writer for {found or name!r}")
    return found


def clean_header(df: DataFrame) -> DataFrame:
    """Strip header names; empty or repeated ones are errors."""
    stripped = [c.strip() for c in df.columns]
    if not all(stripped):
        raise ValueError("The header has a column without a name")
    exact = (df.sparkSession.conf.get("spark.sql.caseSensitive", "false") or "").lower() == "true"
    seen = stripped if exact else [c.lower() for c in stripped]
    if len(set(seen)) != len(seen):
        raise ValueError("The header names a column twice")
    return df if stripped == df.columns else df.toDF(*stripped)


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    schema: T.StructType | str | None = None,
    infer: bool = False,
    lines: bool | None = None,
    na_tokens=NA_TOKENS,
    row_id: bool = False,
    multi_line: bool = True,
) -> DataFrame:
    """Read a file, folder or glob.

    CSV and workbook cells are text unless ``schema`` or ``infer`` says otherwise, so
    ledgers show them as written; any of ``na_tokens`` becomes null before types
    are inferred.  A row with fewer cells than the header ends in nulls, a row
    with more is an error.  CSV cells go by the names in the header of their own file:
    the first file (by path) gives the columns, the others may have them in any order and lack
    some, but have no others.  Large files are split, also where cells hold line
    breaks; ``multi_line=False`` takes every line for a row, whatever its quotes.

    JSON files hold an array of records, or a record per line; ``lines`` says which, or
    else the first character of every file does, and a folder with both kinds is an
    error.  Large files of either kind are split; arrays are written once as lines.  Elements of
    an array other than records are an error.  Columns keep the order of the first record.
    ``row_id`` adds contiguous ids in file order.
    """
    kind = detect_format(path, fmt)
    if kind == "csv":
        df = _read_csv(spark, path, multi_line, row_id)
    elif kind == "json":
        df = _read_json(spark, path, schema, lines, row_id)
    elif kind == "xlsx":
        df = read_workbooks(spark, path)
    else:
        reader = spark.read if schema is None else spark.read.schema(schema)
        df = reader.format(kind).load(path)
    if row_id and ROW_ID not in df.columns:
        df = number_files(df) if kind not in ("csv", "xlsx") else with_row_id(df)
    df = clean_header(df)
    if kind in ("csv", "xlsx"):
        if na_tokens:
            df = df.select(*[_without_tokens(f, na_tokens) for f in df.schema.fields])
        if schema is not None:
            df = _typed(df, schema)
        elif infer:
            df = _inferred(df)
    return df


def _name(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


_CSV = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "lineSep": "\n"}


def _read_csv(spark: SparkSession, path: str, multi_line: bool, row_id: bool) -> DataFrame:
    """Text cells by the names in each file's own header; a cell without a name is an error."""
    cut = read_records(spark, path, multi_line)
    if not cut.headers:
        raise ValueError(f"No header in {path}")
    kinds = {text: number for number, text in enumerate(dict.fromkeys(cut.headers[f] for f in sorted(cut.headers)))}
    if any("\r" in text for text in kinds):
        return _read_whole_csv(spark, path)
    names = [_checked(spark, _cells(spark, text)) for text in kinds]
    columns, exact = names[0], (spark.conf.get("spark.sql.caseSensitive", "false") or "").lower() == "true"
    same = (lambda n: n) if exact else str.lower
    places = {same(n): i for i, n in enumerate(columns)}
    for other in names[1:]:
        if strange := [n for n in other if same(n) not in places]:
            raise ValueError(f"Files differ: {strange} not in the first header {columns}")
    width = max(map(len, names))
    cells = F.from_csv("record", ", ".join(f"c{i} string" for i in range(width + 1)), _CSV)
    rows = cut.rows.withColumn("cells", cells)
    surplus, value = F.col(f"cells.c{width}"), lambda i: F.col(f"cells.c{i}")
    if len(names) > 1:
        # a file with a header of its own: where it has which column, and how many
        numbers = {file: kinds[text] for file, text in cut.headers.items() if kinds[text]}
        kind = F.coalesce(F.from_json(F.lit(json.dumps(numbers)), "map<string,int>")[F.col("file")], F.lit(0))
        at = [[next((j for j, n in enumerate(own) if same(n) == same(c)), -1) for c in columns] for own in names]
        rows = rows.withColumns({"at": F.get(F.lit(at), kind), "width": F.get(F.lit([len(own) for own in names]), kind)})
        rows = rows.withColumn("cells", F.array(*[F.col(f"cells.c{i}") for i in range(width + 1)]))
        surplus = F.get("cells", F.col("width"))
        value = lambda i: F.get("cells", F.get("at", F.lit(i)))
    rows = rows.where(F.when(surplus.isNull(), True).otherwise(F.raise_error(F.lit("A row has more cells than the header"))))
    ids = [F.col("id").alias(ROW_ID)] if row_id else []
    return rows.select(*ids, *[value(i).alias(c) for i, c in enumerate(columns)])


def _cells(spark: SparkSession, record: str) -> list[str]:
    """The cells of a header; there cannot be more than commas."""
    schema = ", ".join(f"c{i} string" for i in range(record.count(",") + 1))
    cells = spark.range(1).select(F.from_csv(F.lit(record), schema, _CSV).alias("r")).first()["r"]
    given = [(c or "").strip() for c in cells]
    while len(given) > 1 and not given[-1] and not record.rstrip().endswith(","):
        given.pop()  # commas inside quotes
    return given


def _read_whole_csv(spark: SparkSession, path: str) -> DataFrame:
    """Files whose lines end in carriage returns alone, one task each, all under the header of one of them."""
    options = {"escape": '"', "multiLine": True, "mode": "PERMISSIVE"}
    first = spark.read.options(**options, header=False).csv(path).first()
    header = [(cell or "").strip() for cell in first]
    names = [f"c{i}" for i in range(len(header))] + ["more"]
    places = T.StructType([T.StructField(n, T.StringType()) for n in names])
    cells = spark.read.options(**options, header=True).schema(places).csv(path)
    tidy = cells.where(F.expr("if(more is null, true, raise_error('A row has more cells than the header'))"))
    return tidy.select(*names[:-1]).toDF(*_checked(spark, header))


def _checked(spark: SparkSession, header: list[str]) -> list[str]:
    """The header names, if each is there and there once."""
    return clean_header(spark.createDataFrame([], T.StructType([T.StructField(h, T.StringType()) for h in header]))).columns


def _read_json(spark: SparkSession, path: str, schema, lines: bool | None, row_id: bool) -> DataFrame:
    text = spark.read.text(path).select(
        F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("n"), F.trim("value").alias("line")
    ).where("line <> ''")
    starts = text.groupBy("file").agg(F.min_by(F.left("line", F.lit(1)), "n").alias("c"))
    kinds = {r["array"] for r in starts.select((F.col("c") == "[").alias("array")).distinct().collect()}
    if len(kinds) > 1 or (lines is not None and kinds == {lines}):
        raise ValueError(f"{path} holds {'both arrays and lines of records' if len(kinds) > 1 else 'an array' if lines else 'lines of records'}")
    reader = spark.read.option("mode", "FAILFAST")
    if True in kinds:
        return _read_arrays(spark, path, schema, row_id)
    if schema is not None:
        return reader.schema(schema).json(path)
    df = reader.json(path)
    # inference sorts the names; the first record knows their order
    return _in_order(df, text.select(F.col("line").alias("record")))


def _in_order(df: DataFrame, records: DataFrame) -> DataFrame:
    """Columns in the order of the first of ``records``, the others behind them."""
    first = records.select(F.json_object_keys("record").alias("keys")).first()
    keys = [k for k in (first["keys"] if first and first["keys"] else []) if k in df.columns]
    return df.select(*map(_name, keys), *[_name(c) for c in df.columns if c not in keys])


def _read_arrays(spark: SparkSession, path: str, schema: T.StructType | str | None, row_id: bool) -> DataFrame:
    """The records of arrays, cut by many tasks and written once as lines, which are typed and pruned like any others."""
    target, reader = array_lines(spark, path), spark.read.option("mode", "FAILFAST")
    if schema is not None:
        row = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        reader = reader.schema(T.StructType([T.StructField("id", T.LongType()), T.StructField("row", row)]))
    df = reader.json(target)
    if "row" not in df.columns:  # no record has a key
        return df.select(*[F.col("id").alias(ROW_ID)] * (row_id and "id" in df.columns))
    cells = df.select("row.*")
    if schema is None:
        zero = spark.read.text(target).where(F.col("value").startswith('{"id":0,'))
        cells = _in_order(cells, zero.select(F.get_json_object("value", "$.row").alias("record")))
    ids = [F.col("id").alias(ROW_ID)] if row_id and ROW_ID not in cells.columns else []
    return df.select(*ids, *[F.col("row")[c].alias(c) for c in cells.columns])


def _typed(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Cells cast to the schema's types, by position; a cell that is no such value is an error."""
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    ids = [c for c in df.columns if c == ROW_ID]
    cells = [c for c in df.columns if c != ROW_ID]
    if len(cells) != len(wanted):
        raise ValueError(f"The schema has {len(wanted)} columns, the table {len(cells)}")
    return df.select(*ids, *[_name(c).cast(f.dataType).alias(f.name) for c, f in zip(cells, wanted, strict=True)])


def _inferred(df: DataFrame) -> DataFrame:
    """Text columns in the narrowest type that all their cells have; one pass over the table."""
    kinds = ("int", "bigint", "double", "date", "timestamp", "boolean")
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    fits = [
        F.every(_name(c).isNull() | _name(c).try_cast(k).isNotNull()).alias(f"f{i}_{k}") for i, c in enumerate(texts) for k in kinds
    ]
    some = [F.count(_name(c)).alias(f"n{i}") for i, c in enumerate(texts)]
    if not texts:
        return df
    found = df.agg(*fits, *some).first()
    types = {}
    for i, c in enumerate(texts):
        types[c] = next((k for k in kinds if found[f"n{i}"] and found[f"f{i}_{k}"]), "string")
    return df.select(*[_name(c).cast(types[c]).alias(c) if c in types else _name(c) for c in df.columns])


def _without_tokens(field: T.StructField, tokens):
    c = _name(field.name)
    if not isinstance(field.dataType, T.StringType):
        return c
    return F.when(~c.isin(*tokens), c).alias(field.name)


def write_table(df: DataFrame, path: str, fmt: str | None = None, mode: str = "errorifexists") -> str:
    """Write a table as a folder of files; nulls stay explicit in JSON."""
    kind = detect_format(path, fmt, WRITE_FORMATS)
    writer = df.write.mode(mode)
    if kind == "csv":
        # the writer trims cells unless told otherwise
        writer.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
            "ignoreTrailingWhiteSpace", False
        ).csv(path)
    elif kind == "json":
        writer.option("ignoreNullFields", False).json(path)
    else:
        writer.format(kind).save(path)
    return path


def convert(spark: SparkSession, source: str, target: str, **read_options) -> str:
    """Change the format of a table without cleaning it."""
    return write_table(read_table(spark, source, **read_options), target)
