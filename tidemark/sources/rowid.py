"""Stable, contiguous, 0-based row ids without a global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import freeze

ROW_ID = "_row_id"
# Scan units whose starts are broadcast: about 150 bytes each.
BROADCAST_UNITS = 500_000


def _named(df: DataFrame) -> list:
    return [F.col("`" + name.replace("`", "``") + "`") for name in df.columns]


def _number(df: DataFrame, key: list) -> DataFrame:
    """Number rows by (key, position); ``key`` names the scan unit of a row.

    Rows of one scan unit are contiguous within a task, so the running task
    counter minus the unit's first counter is the position inside the unit.
    The running total is over one row per scan unit, never over data rows.
    """
    names = [f"_unit{i}" for i in range(len(key))]
    base = df.select("*", *[k.alias(n) for k, n in zip(key, names)], F.monotonically_increasing_id().alias("_mono"))
    units = base.groupBy(*names).agg(F.min("_mono").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    # A long difference, so that a join key and one number per unit are all a reader needs.
    starts = units.select(
        *names, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    # One row per scan unit, frozen, so its exact size is known before it is sent out.
    starts = freeze(starts, "starts")
    if starts.count() <= BROADCAST_UNITS:
        starts = F.broadcast(starts)
    out = base.join(starts, names)
    return out.select((F.col("_mono") + F.col("_shift")).alias(ROW_ID), *_named(df))


def number_files(df: DataFrame) -> DataFrame:
    """Row ids for a plain file scan: file order, then position in the file."""
    return _number(df, [F.col("_metadata.file_path"), F.col("_metadata.file_block_start")])


def with_row_id(df: DataFrame, key: str | None = None) -> DataFrame:
    """Attach ``_row_id``: a unique integer column of the data, or a fresh number.

    Fresh numbers are given to a frozen copy, because the order of rows coming
    out of a shuffle is not repeatable.
    """
    if ROW_ID in df.columns:
        return df
    if key is not None:
        return df.select(F.col(key).cast("long").alias(ROW_ID), *_named(df))
    ordered = df.select("*", F.monotonically_increasing_id().alias("_order"))
    frozen = freeze(ordered, "rows")
    units = frozen.groupBy(F.shiftright("_order", 33).alias("_unit0")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_unit0").rowsBetween(Window.unboundedPreceding, -1)
    starts = units.select("_unit0", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # at most one row per task of the write, two numbers each
    out = frozen.withColumn("_unit0", F.shiftright("_order", 33)).join(F.broadcast(starts), "_unit0")
    position = F.col("_order") - F.shiftleft(F.col("_unit0"), 33)
    return out.select((F.col("_start") + position).alias(ROW_ID), *_named(df))
