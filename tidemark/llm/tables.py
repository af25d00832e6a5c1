"""Small helpers shared by the operators: input columns, size checks, word hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A broadcast side may hold this many rows of a few plain columns (about 20 MB).
BROADCAST_ROWS = 200_000


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, as ``doc_id`` and ``text``; a null text is empty.

    Every other column is left behind, so their names cannot clash with an operator's own.
    """
    return docs.select(
        docs[id_col].cast("bigint").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a frozen table has at most ``rows`` rows, so that it may be broadcast."""
    return df.limit(rows + 1).count() <= rows


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character untouched."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
