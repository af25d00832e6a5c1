"""Exact deduplication on normalized keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import key_digest
from ..plans.groups import grouped
from ..plans.skew import attach_groups
from ..sources.rowid import ROW_ID
from ..sources.scratch import freeze
from .base import Outcome, Step, col, column_types, user_columns


@dataclass
class ExactPairs:
    """(kept, matched) pairs of equal keys."""

    pairs: DataFrame

    @property
    def removed(self) -> DataFrame:
        return self.pairs.select(F.col("matched_row").alias(ROW_ID))

    @property
    def groups(self) -> DataFrame:
        return grouped(self.pairs, "exact duplicate")


def exact_pairs(df: DataFrame, columns=()) -> ExactPairs:
    """Every later row of a key with the first row of that key.

    Ids and 32-byte digests are written once and only they are shuffled.  The
    first row and size per key are combined map-side; a key holding much of the
    table is matched by a bounded broadcast instead of meeting in one task.
    """
    types = column_types(df, columns or user_columns(df))
    keys = df.select(F.col(ROW_ID).alias("row_id"), key_digest([(col(c), t) for c, t in types.items()]).alias("key"))
    keys = freeze(keys, "keys")
    firsts = keys.groupBy("key").agg(F.min("row_id").alias("kept_row"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = freeze(firsts, "first-rows")
    matched = attach_groups(keys, firsts, "key", "n").where("row_id <> kept_row")
    return ExactPairs(
        matched.select(
            "kept_row", F.col("row_id").alias("matched_row"), F.lit(100.0).alias("score"),
            (F.col("n") - 1).alias("size"), F.lit(100.0).alias("group_score"),
        )
    )


def survivors(df: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows of ``df`` whose id is not in ``removed`` (ids are unique on both sides)."""
    return df.join(removed, ROW_ID, "left_anti")


class ExactDedup(Step):
    """Keep the first row of every key, drop the rest; no columns means all."""

    def __init__(self, columns=(), name: str = "exact-deduplication") -> None:
        self.columns = tuple(columns)
        self.name = name

    def apply(self, df: DataFrame, step: int) -> Outcome:
        found = ExactPairs(freeze(exact_pairs(df, self.columns).pairs, "exact-pairs"))
        return Outcome(data=survivors(df, found.removed), duplicates=found.groups, removed=found.removed)
