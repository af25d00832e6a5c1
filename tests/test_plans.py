"""Plans: what runs when, ledgers of any shape, streams with late rows."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark import AllowedValues, Cleaner, ExactDedup, NormalizeText, Required, read_report, write_report
from tidemark.operators import exact
from tidemark.plans import skew
from tidemark.streaming import dedup_stream, issue_rates
from workload.queries import QUERIES, dirty

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["dup_exact_groups", "dup_exact_orders", "aud_dups", "aud_roundtrip", "rpt_sections"])
def test_results_do_not_depend_on_the_length_of_parts(spark, monkeypatch, name):
    whole = sorted(map(str, QUERIES[name](spark, FOLDER).collect()))
    monkeypatch.setattr(skew, "PART_ROWS", 16)
    assert sorted(map(str, QUERIES[name](spark, FOLDER).collect())) == whole


def test_deduplication_waits_until_it_is_asked_for(spark, cells, monkeypatch):
    calls = []
    pairs = exact.exact_pairs
    monkeypatch.setattr(exact, "exact_pairs", lambda *a: calls.append(1) or pairs(*a))
    table = cells(["a"], [(" x ",), ("x",), (None,)])
    run = Cleaner([NormalizeText(["a"]), Required(["a"]), ExactDedup()]).run(table)
    assert run.changes.count() == 1 and run.issues.count() == 1 and run.suggestions.count() == 0
    assert not calls
    assert run.data.count() == 2 and run.duplicates.count() == 1 and run.report.first().rows_removed == 1
    assert len(calls) == 1
    run = Cleaner([ExactDedup(), Required(["a"])]).run(table)
    assert run.issues.count() == 1 and len(calls) == 2  # the rule sees what the step before it left


def test_report_names_its_files(spark, cells, tmp_path):
    run = Cleaner([NormalizeText(["a"])]).run(cells(["a"], [(" x ",)]))
    path = write_report(run, str(tmp_path / "report"), out="somewhere/clean.parquet")
    assert read_report(spark, path)["changes"].count() == 1
    found = {(r.label, r.location, r.kind) for r in spark.read.json(f"{path}/manifest").collect()}
    assert found == {("Clean output", "clean.parquet", "parquet"), ("Audit report", "report", "report")}


def batches(spark, folder, minutes):
    """A stream whose batches hold one event each, at these minutes."""
    schema = "id bigint, ts timestamp, name string"
    for i, minute in enumerate(minutes):
        row = spark.range(1).select(F.lit(i).cast("bigint").alias("id"), F.timestamp_seconds(F.lit(minute * 60)).alias("ts"), F.lit("k").alias("name"))
        row.coalesce(1).write.parquet(f"{folder}/{i:03d}")
        for file in Path(folder, f"{i:03d}").iterdir():  # the source goes by age
            os.utime(file, (1_700_000_000 + 60 * i,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def drain(writer, path):
    writer.option("checkpointLocation", str(path)).trigger(availableNow=True).start().awaitTermination()


def test_a_key_may_come_again_after_the_delay(spark, tmp_path):
    stream = batches(spark, tmp_path / "in", [1000, 1005, 1100, 1104, 1230])
    drain(dedup_stream(stream, ["name"], "ts", "30 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")), tmp_path / "ck")
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 4]  # the watermark must have passed it


def test_rates_are_final_and_late_rows_left_out(spark, tmp_path):
    stream = batches(spark, tmp_path / "in", [10, 70, 200, 210, 20, 400])
    rates = issue_rates(stream, [AllowedValues(["name"], ["ok"])], "ts", "id", "1 hour", delay="30 minutes")
    drain(rates.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")), tmp_path / "ck")
    got = {r.window_start.hour: r.issues for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: 1, 1: 1, 3: 2}  # minute 20 came after its window was closed


def test_dirty_rows_are_made_on_every_core(spark, tmp_path):
    """One row group is one task; the rows made of it cost far more than moving them."""
    rows = spark.sql("select id c_custkey, concat('Customer#', id) c_name, cast(id as double) c_acctbal from range(4000)")
    rows.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    made = dirty(spark, str(tmp_path))
    counts = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert len(counts) == spark.sparkContext.defaultParallelism
    assert sum(counts) == 4000
