"""Missing-value policies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_blank
from ..functions.values import parse_number
from ..plans.stats import exact_median
from ..sources.rowid import ROW_ID
from ..sources.scratch import freeze
from .base import Cell, Outcome, RowStep, Step, col, column_types, require_columns

POLICIES = ("keep", "drop_rows", "fill", "mean", "median", "mode")

_DEFAULT_NAME = "missing-value-handling"


class FillBlanks(RowStep):
    """Write a fixed value, per column, into blank cells.

    With ``widen`` integer columns become DOUBLE, so that any number fits.
    """

    rewrites = True

    def __init__(self, values: dict[str, object], name: str = _DEFAULT_NAME, widen: bool = False) -> None:
        self.values = dict(values)
        self.columns = tuple(values)
        self.name = name
        self.widen = widen

    def result_type(self, dtype: T.DataType) -> T.DataType:
        return T.DoubleType() if self.widen and isinstance(dtype, T.IntegralType) else dtype

    def _literal(self, column: str, dtype: T.DataType) -> Column:
        value = self.values[column]
        text = repr(value) if isinstance(value, float) else str(value)
        if isinstance(dtype, T.StringType):
            return F.lit(text)
        try:
            if isinstance(dtype, T.IntegralType):
                number = float(value)
                if number != int(number):
                    raise ValueError(text)
                return F.lit(int(number)).cast(dtype)
            if isinstance(dtype, T.BooleanType):
                return F.lit({"true": True, "false": False}[text.lower()])
            return F.lit(float(value)).cast(dtype)
        except (ValueError, KeyError, OverflowError):
            raise ValueError(f"Cannot fill {dtype.simpleString()} column {column} with {text!r}") from None

    def after(self, cell: Cell) -> Column:
        dtype = self.result_type(cell.dtype)
        return F.when(is_blank(cell.before, cell.dtype), self._literal(cell.column, dtype)).otherwise(cell.before.cast(dtype))

    def changed(self, cell: Cell) -> Column:
        return is_blank(cell.before, cell.dtype)


class MissingValues(Step):
    """Keep, drop or fill rows with blank cells in the given columns.

    Filling with the mean or median turns integer columns into DOUBLE.

    Fill values that depend on the data are one-row aggregates, computed when
    the step is planned; applying them is then an ordinary row-wise step.
    """

    def __init__(self, columns, policy: str = "keep", fill_value=None, name: str = _DEFAULT_NAME) -> None:
        self.columns = require_columns(columns, "Name the columns whose blanks are to be handled")
        if policy not in POLICIES:
            raise ValueError(f"{policy!r} is none of the policies {', '.join(POLICIES)}")
        if policy == "fill" and fill_value is None:
            raise ValueError("Give the fill_value to write into blanks")
        self.policy = policy
        self.fill_value = fill_value
        self.name = name

    def row_step(self, df: DataFrame) -> FillBlanks | None:
        """The fill to apply, its values taken from ``df`` where the policy asks."""
        if self.policy == "fill":
            return FillBlanks({c: self.fill_value for c in self.columns}, self.name)
        if self.policy == "mode":
            return FillBlanks(self._modes(df), self.name)
        if self.policy in ("mean", "median"):
            return FillBlanks(self._centres(df), self.name, widen=True)
        return None

    def apply(self, df: DataFrame, step: int) -> Outcome:
        fill = self.row_step(df)
        if fill is not None:
            return fill.apply(df, step)
        if self.policy == "keep":
            return Outcome(data=df)
        return self._drop(df)

    def _drop(self, df: DataFrame) -> Outcome:
        types = column_types(df, self.columns)
        blank = reduce(lambda a, b: a | b, [is_blank(col(c), t) for c, t in types.items()])
        return Outcome(data=df.where(~blank), removed=df.where(blank).select(ROW_ID))

    def _centres(self, df: DataFrame) -> dict[str, float]:
        types = column_types(df, self.columns, rewrites=True)
        cells = []
        for i, (name, dtype) in enumerate(types.items()):
            cells += [(~is_blank(col(name), dtype)).alias(f"p{i}"), parse_number(col(name), dtype).alias(f"v{i}")]
        numbers = df.select(*cells)
        if self.policy == "median":
            numbers = freeze(numbers, "numbers")  # a median takes several passes, the source is read once
        checks = []
        for i in range(len(types)):
            present, number = F.col(f"p{i}"), F.col(f"v{i}")
            checks += [
                F.count_if(present & number.isNull()).alias(f"bad{i}"), F.count_if(present).alias(f"n{i}"),
                F.avg(F.when(present, number)).alias(f"mean{i}"),
            ]
        row = numbers.agg(*checks).first()
        values = {}
        for i, name in enumerate(types):
            if row[f"bad{i}"] or not row[f"n{i}"]:
                raise ValueError(f"Column {name} has cells that are no numbers, or none at all: there is no {self.policy}")
            values[name] = row[f"mean{i}"]
            if self.policy == "median":
                values[name] = exact_median(numbers.where(f"p{i}").select(F.col(f"v{i}").alias("v")), row[f"n{i}"])
        return values

    def _modes(self, df: DataFrame) -> dict[str, object]:
        """Most frequent text per column; the earliest row wins a tie."""
        values = {}
        for name, dtype in column_types(df, self.columns).items():
            counted = (
                df.where(~is_blank(col(name), dtype))
                .groupBy(col(name).alias("value"))
                .agg(F.count(F.lit(1)).alias("n"), F.min(ROW_ID).alias("first"))
            )
            best = F.max_by("value", F.struct(F.col("n"), -F.col("first")))
            row = counted.agg(best.alias("best")).first()
            if row["best"] is not None:
                values[name] = row["best"]
        return values
