"""Attach per-group facts to rows when one group may hold much of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is heavy when it holds more than one row in HEAVY_SHARE of the table,
# so there can never be more than HEAVY_SHARE heavy keys: the broadcast side
# has that bound whatever the data.
HEAVY_SHARE = 100_000
HEAVY_FLOOR = 100_000

# Duplicate ledgers hold the row ids of a group in arrays by id range of this length.
PART_ROWS = 65_536


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of ``rows`` with one row per group, safe for heavy groups.

    Light groups take an ordinary shuffle join.  The few heavy ones are matched
    against a bounded broadcast, so their rows never meet in one task.  Both
    inputs are read more than once and should be scans or frozen tables.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n"))
    limit = F.greatest(F.col("n") / HEAVY_SHARE, F.lit(HEAVY_FLOOR))
    cut = total.select(limit.alias("cut")).scalar()
    heavy = groups.where(F.col(size) > cut)
    light = groups.where(F.col(size) <= cut)
    heavy_keys = F.broadcast(heavy.select(key))
    return rows.join(heavy_keys, key, "left_anti").join(light, key).unionByName(
        rows.join(F.broadcast(heavy), key)
    )


def part_of(row: str):
    """Which part of its group's list a row id belongs to; the same rule at every size."""
    return F.floor(F.col(row) / PART_ROWS).cast("long")
