"""Column profiles: shape and suggested types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.text import is_blank, render, trim_ws
from ..functions.values import is_boolean, parse_number
from .base import Outcome, Step, col, column_types, user_columns

COLUMN_TYPES = ("text", "number", "date", "boolean", "empty")
DATE_FORMATS = ("%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y")

# Fixed value: below this share of matching values a column is text.
MIN_CONFIDENCE = 0.6


def shape(df: DataFrame) -> DataFrame:
    """One row: number of rows, number of columns, column names."""
    names = user_columns(df)
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(names)).alias("columns"), F.array(*[F.lit(n) for n in names]).alias("column_names")
    )


class InferTypes(Step):
    """Suggest boolean, number, date or text per column; data is untouched."""

    def __init__(self, columns=(), overrides: dict[str, str] | None = None, date_formats=DATE_FORMATS,
                 name: str = "type-inference") -> None:
        self.columns = tuple(columns)
        self.overrides = dict(overrides or {})
        self.date_formats = tuple(date_formats)
        self.name = name
        if not self.date_formats:
            raise ValueError("Give the formats that count as dates")
        for kind in self.overrides.values():
            if kind not in COLUMN_TYPES:
                raise ValueError(f"{kind!r} is none of the types {', '.join(COLUMN_TYPES)}")

    def suggestions(self, df: DataFrame) -> DataFrame:
        """One scan and one aggregation for all columns, then one row per column."""
        names = self.columns or tuple(user_columns(df))
        measured = [n for n in names if n not in self.overrides]
        aggs, rows = [F.lit(0).alias("_none")], []
        for i, (name, dtype) in enumerate(column_types(df, measured).items()):
            c = col(name)
            present = ~is_blank(c, dtype)
            tests = {
                "b": is_boolean(c, dtype),
                "n": parse_number(c, dtype).isNotNull(),
                "d": parse_date(trim_ws(render(c, dtype)), self.date_formats).isNotNull(),
            }
            aggs.append(F.count_if(present).alias(f"p{i}"))
            aggs += [F.count_if(present & test).alias(f"{key}{i}") for key, test in tests.items()]
        for name in names:
            if name in self.overrides:
                rows.append(_row(name, F.lit(self.overrides[name]), F.lit(1.0), F.lit("explicit override")))
                continue
            i = measured.index(name)
            total = F.col(f"p{i}")
            share = {k: F.try_divide(F.col(f"{k}{i}"), total) for k in "bnd"}
            best = F.greatest(*share.values())
            kind = (
                F.when(total == 0, "empty")
                .when(best < MIN_CONFIDENCE, "text")
                .when(share["b"] == best, "boolean")
                .when(share["n"] == best, "number")
                .otherwise("date")
            )
            confidence = F.when((total == 0) | (best < MIN_CONFIDENCE), F.lit(1.0)).otherwise(F.bround(best, 2))
            reason = F.when(total == 0, F.lit("all values are blank")).otherwise(
                F.concat(total.cast("string"), F.lit(" non-blank values sampled"))
            )
            rows.append(_row(name, kind, confidence, reason))
        return df.agg(*aggs).select(F.inline(F.array(*rows)))

    def apply(self, df: DataFrame, step: int) -> Outcome:
        return Outcome(data=df, suggestions=self.suggestions(df))


def _row(name, kind, confidence, reason):
    return F.struct(
        F.lit(name).alias("column"), kind.alias("suggested_type"), confidence.alias("confidence"), reason.alias("reason")
    )
