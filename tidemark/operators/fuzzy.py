"""Fuzzy deduplication on token-sort similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import comparable_text, token_sort
from ..plans.greedy import greedy_leaders
from ..plans.groups import grouped
from ..plans.pairs import Matcher
from ..plans.skew import attach_groups
from ..sources.rowid import ROW_ID
from ..sources.scratch import freeze
from .base import Outcome, Step, col, column_types, require_columns
from .exact import survivors

MODES = ("suggest", "remove_strict")


class FuzzyText:
    """Comparison texts of a table, with equal texts collapsed.

    ``rows`` maps every row to the digest of its text; ``texts`` has one row per
    distinct text: its digest, the id of its first row, and its number of rows.
    """

    def __init__(self, df: DataFrame, columns) -> None:
        types = column_types(df, columns)
        text = token_sort(comparable_text([(col(c), t) for c, t in types.items()]))
        keyed = df.select(F.col(ROW_ID).alias("row_id"), text.alias("text")).select(
            "row_id", "text", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key")
        )
        self.rows = freeze(keyed.select("row_id", "key"), "text-keys")
        counted = keyed.groupBy("key", "text").agg(F.min("row_id").alias("id"), F.count(F.lit(1)).alias("n"))
        self.texts = freeze(counted, "texts")

    def pairs(self, matcher: Matcher) -> DataFrame:
        """Similar distinct texts: first row of each, and their score."""
        return matcher.pairs(self.texts.select("id", "text"))

    def copies(self) -> DataFrame:
        """Later rows with the same text as an earlier one."""
        shared = self.texts.where("n > 1").select("key", "id", "n")
        return attach_groups(self.rows, shared, "key", "n").where("row_id <> id").select(
            F.col("id").alias("kept_row"), F.col("row_id").alias("matched_row"), F.lit(100.0).alias("score")
        )

    def suggested(self, matcher: Matcher) -> DataFrame:
        """Pairs between first rows of texts, plus every copy of a text."""
        similar = self.pairs(matcher).select(F.col("a").alias("kept_row"), F.col("b").alias("matched_row"), "score")
        return _sized(freeze(similar.unionByName(self.copies()), "suggested"))

    def suggested_rows(self, matcher: Matcher) -> DataFrame:
        """Every later match of every row.  As large as its output: a text with
        ``n`` copies alone makes ``n(n-1)/2`` of these pairs."""
        one_way = freeze(self.pairs(matcher), "pairs")
        links = (
            one_way.select("a", "b", "score")
            .union(one_way.select("b", "a", "score"))
            .union(self.texts.select("id", "id", F.lit(100.0)))
            .toDF("id", "other", "score")
        )
        members = attach_groups(self.rows, self.texts.select("key", "id", "n"), "key", "n").select("id", "row_id")
        left = members.withColumnRenamed("row_id", "kept_row")
        right = members.select(F.col("id").alias("other"), F.col("row_id").alias("matched_row"))
        found = left.join(links, "id").join(right, "other").where("matched_row > kept_row")
        return _sized(freeze(found.select("kept_row", "matched_row", "score"), "suggested"))

    def removals(self, matcher: Matcher) -> DataFrame:
        """Every removed row with the kept row that removed it."""
        leaders = greedy_leaders(self.texts.select("id", "text"), matcher)
        fates = freeze(
            self.texts.select("key", "id", "n")
            .join(leaders, "id", "left")
            .select(
                "key", "n", F.col("leader").isNotNull().alias("gone"),
                F.coalesce("leader", "id").alias("kept_row"), F.coalesce("score", F.lit(100.0)).alias("score"),
            )
            .where("gone or n > 1"),
            "fates",
        )
        sizes = fates.groupBy("kept_row").agg(
            (F.sum(F.when(F.col("gone"), F.col("n")).otherwise(F.col("n") - 1))).alias("size"),
            F.min("score").alias("group_score"),
            F.count(F.lit(1)).alias("members"),
        )
        sized = attach_groups(fates, freeze(sizes, "sizes"), "kept_row", "members").select("key", "n", "kept_row", "score", "size", "group_score")
        matched = attach_groups(self.rows, freeze(sized, "sized-fates"), "key", "n").where("row_id <> kept_row")
        return matched.select("kept_row", F.col("row_id").alias("matched_row"), "score", "size", "group_score")


def _sized(pairs: DataFrame) -> DataFrame:
    sizes = pairs.groupBy("kept_row").agg(F.count(F.lit(1)).alias("size"), F.min("score").alias("group_score"))
    return attach_groups(pairs, freeze(sizes, "sizes"), "kept_row", "size")


class FuzzyDedup(Step):
    """Suggest or remove rows whose text is similar to an earlier one.

    ``suggest`` reports one group per distinct text that has later matches: its
    later copies and the first row of every later similar text.  With
    ``expand=True`` every row gets its own full group.  ``similarity`` with
    ``candidates_at`` or ``block_key`` plugs in a score of your own, ``approximate`` finds pairs
    by MinHash and says so in the reason, see ``Matcher``.
    """

    def __init__(self, columns, threshold: float, mode: str = "suggest", expand: bool = False, similarity=None,
                 candidates_at: float | None = None, block_key=None, approximate: bool = False, name: str = "fuzzy-deduplication") -> None:
        self.columns = require_columns(columns, "Name the columns to compare")
        self.matcher = Matcher(threshold, similarity, candidates_at, block_key, approximate)
        if mode not in MODES:
            raise ValueError(f"Unknown fuzzy deduplication mode: {mode}")
        self.mode, self.expand, self.name = mode, expand, name

    @property
    def reason(self) -> str:
        kind = "approximate fuzzy duplicate" if self.matcher.approximate else "fuzzy duplicate"
        return f"{kind} above threshold {self.matcher.threshold:g}"

    def apply(self, df: DataFrame, step: int) -> Outcome:
        text = FuzzyText(df, self.columns)
        if self.mode == "suggest":
            pairs = text.suggested_rows(self.matcher) if self.expand else text.suggested(self.matcher)
            return Outcome(data=df, duplicates=grouped(pairs, self.reason))
        pairs = freeze(text.removals(self.matcher), "removals")
        removed = pairs.select(F.col("matched_row").alias(ROW_ID))
        return Outcome(data=survivors(df, removed), duplicates=grouped(pairs, self.reason), removed=removed)
