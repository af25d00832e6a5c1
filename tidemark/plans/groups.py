"""Duplicate ledgers from (kept, matched) pairs, in parts of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import part_of


def grouped(pairs: DataFrame, reason: str) -> DataFrame:
    """Ledger rows from ``kept_row, matched_row, group_score`` pairs.

    A group has one row per range of row ids that its matches lie in, each
    carrying the score of the whole group; groups are counted by ``kept_row``.
    """
    parts = (
        pairs.withColumn("part", part_of("matched_row"))
        .groupBy("kept_row", "part")
        .agg(
            F.sort_array(F.collect_list("matched_row")).alias("matched_rows"),
            F.min("group_score").alias("score"),
        )
    )
    return parts.select("kept_row", "part", "matched_rows", "score", F.lit(reason).alias("reason"))


def long_form(ledger: DataFrame) -> DataFrame:
    """A duplicate ledger with one row per matched row."""
    return ledger.withColumn("matched_row", F.explode("matched_rows")).drop("matched_rows", "part")
