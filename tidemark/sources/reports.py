"""The audit report: ledgers as partitioned tables, counts and details as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.base import COUNTS, LEDGERS, union_all
from ..plans.cleaning import CleanRun

REPORT = (
    "rows_before bigint, rows_after bigint, rows_removed bigint, cells_changed bigint, "
    "validation_issue_count bigint, duplicate_group_count bigint"
)
# Rows of the table whose details share one JSON line.
LINE_ROWS = 4_096

MANIFEST = "label string, location string, kind string"


def manifest(spark: SparkSession, out: str, report_path: str) -> DataFrame:
    """The files a run produced: label, file name and kind by suffix."""
    rows = []
    for label, path, fallback in (("Clean output", out, "file"), ("Audit report", report_path, "report")):
        name = path.rstrip("/").rsplit("/", 1)[-1]
        suffix = name.rsplit(".", 1)[1] if "." in name.lstrip(".") else ""
        rows.append((label, name, suffix or fallback))
    return spark.createDataFrame(rows, MANIFEST)


def write_report(run: CleanRun, path: str, mode: str = "errorifexists", lines: bool = False, out: str | None = None) -> str:
    """Write summary, totals and every ledger under ``path``; with ``lines`` the JSON form as well.

    All of them come from one evaluation of each stage, which is written first.
    ``out`` is where the cleaned rows are; the report then names both in its manifest.
    """
    if run.again and not run.staged:
        run = run.again(True)
    run.summary.coalesce(1).write.mode(mode).parquet(f"{path}/summary")
    run.report.write.mode(mode).parquet(f"{path}/report")
    for kind in LEDGERS:
        run.ledger(kind).write.mode(mode).partitionBy("operation").parquet(f"{path}/{kind}")
    if out is not None:
        manifest(run.source.sparkSession, out, path).coalesce(1).write.mode(mode).json(f"{path}/manifest")
    if lines:
        report_lines(run).write.mode(mode).json(f"{path}/lines")
    return path


def read_report(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a written report, as they were."""
    out = {
        "summary": spark.read.schema(COUNTS).parquet(f"{path}/summary"),
        "report": spark.read.schema(REPORT).parquet(f"{path}/report"),
    }
    for kind, schema in LEDGERS.items():
        names = [field.split()[0] for field in schema.split(", ")]
        # the partition column comes back last
        out[kind] = spark.read.schema(schema).parquet(f"{path}/{kind}").select(*names)
    return out


def report_lines(run: CleanRun) -> DataFrame:
    """The whole report as JSON lines: ``step, section, part, json``.

    A step with many details continues over parts by row-id range, so no line,
    task or driver ever holds a whole ledger.
    """
    totals = run.report.select(
        F.lit(-1).alias("step"), F.lit("report").alias("section"), F.lit(0).cast("long").alias("part"),
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"),
    )
    operations = run.summary.select(
        "step", F.lit("operation").alias("section"), F.lit(0).cast("long").alias("part"),
        F.to_json(F.struct(F.col("operation").alias("name"), "rows_removed", "cells_changed", "validation_issues",
                           "duplicate_groups")).alias("json"),
    )
    explicit = {"ignoreNullFields": "false"}
    sections = []
    for section, ledger, order, fields in (
        ("type_suggestions", run.suggestions, F.lit(0), ("column", "suggested_type", "confidence", "reason")),
        ("cell_changes", run.changes, F.col("row_id"), ("row_id", "column", "before", "after", "reason")),
        ("issues", run.issues, F.col("row_id"), ("row_id", "column", "rule", "value", "message")),
    ):
        entry = F.struct(order.alias("_order"), F.struct(*[F.col(f) for f in fields]).alias("e"))
        parts = ledger.groupBy("step", F.floor(order / LINE_ROWS).cast("long").alias("part")).agg(
            F.sort_array(F.collect_list(entry)).alias("entries")
        )
        sections.append(
            parts.select(
                "step", F.lit(section).alias("section"), "part",
                F.to_json(F.transform("entries", lambda x: x["e"]), explicit).alias("json"),
            )
        )
    # a duplicate entry can already be long, so each is a line of its own
    group = F.struct("kept_row", "part", "matched_rows", "score", "reason")
    sections.append(
        run.duplicates.select(
            "step", F.lit("duplicates").alias("section"), F.col("kept_row").alias("part"),
            F.to_json(F.array(group), explicit).alias("json"),
        )
    )
    return union_all([totals, operations, *sections], "", run.source)
