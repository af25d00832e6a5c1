"""Steps, ledgers and the fused evaluation of row-wise steps.

A row-wise step says, per target column, what the new value is and which
message (if any) the cell earns.  ``RowSegment`` stacks consecutive row-wise
steps as projections over one scan; every version of a cell stays addressable,
so data, ledgers and counts are all plain projections of the same plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import render
from ..sources.rowid import ROW_ID
from ..sources.scratch import freeze

CHANGES = (
    "step int, operation string, row_id bigint, column string, before string, after string, "
    "value_type string, reason string"
)
ISSUES = (
    "step int, operation string, row_id bigint, column string, rule string, value string, "
    "value_type string, message string"
)
DUPLICATES = (
    "step int, operation string, kept_row bigint, part bigint, matched_rows array<bigint>, "
    "score double, reason string"
)
SUGGESTIONS = (
    "step int, operation string, column string, suggested_type string, confidence double, reason string"
)
COUNTS = (
    "step int, operation string, rows_removed bigint, cells_changed bigint, "
    "validation_issues bigint, duplicate_groups bigint"
)
LEDGERS = {"changes": CHANGES, "issues": ISSUES, "duplicates": DUPLICATES, "suggestions": SUGGESTIONS}

_SCALARS = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def col(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def require_columns(columns, message: str) -> tuple[str, ...]:
    columns = tuple(columns)
    if not columns:
        raise ValueError(message)
    if len(set(columns)) != len(columns):
        raise ValueError(f"A column is listed twice: {', '.join(columns)}")
    return columns


def column_types(df: DataFrame, columns, rewrites: bool = False) -> dict[str, T.DataType]:
    """Types of the target columns; an unknown one is an error.

    Values of any type can be read, as text; only scalars can be rewritten.
    """
    return picked_types({f.name: f.dataType for f in df.schema.fields}, columns, rewrites)


def picked_types(known: dict[str, T.DataType], columns, rewrites: bool) -> dict[str, T.DataType]:
    for name in columns:
        if name not in known:
            raise ValueError(f"Unknown column: {name}")
        if rewrites and not isinstance(known[name], _SCALARS):
            raise ValueError(f"Column {name} is {known[name].simpleString()}, not a scalar that can be rewritten")
    return {name: known[name] for name in columns}


def user_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW_ID]


@dataclass
class Outcome:
    """What one step (or segment) did: the next table and its ledgers."""

    data: DataFrame
    counts: DataFrame | None = None
    changes: DataFrame | None = None
    issues: DataFrame | None = None
    duplicates: DataFrame | None = None
    suggestions: DataFrame | None = None
    removed: DataFrame | None = None


class Step:
    """One named operation.  Subclass and override ``apply`` to plug in your own."""

    name = "step"

    def apply(self, df: DataFrame, step: int) -> Outcome:
        """Return the next table and any ledgers.

        Ledgers may leave out ``step`` and ``operation``; they are filled in.
        A ``removed`` table (one row per removed row) feeds the row count.
        """
        raise NotImplementedError


@dataclass
class Cell:
    """Expressions of one target cell, as a row-wise step sees them."""

    column: str
    before: Column
    dtype: T.DataType
    prepared: Column | None = None
    work: Column | None = None
    after: Column | None = None


class RowStep(Step):
    """A step that looks at one row at a time."""

    columns: tuple[str, ...] = ()
    rule = ""
    rewrites = False
    needs_text = False

    def prepare(self, cell: Cell) -> Column | None:
        """A value that ``work`` uses several times, computed once."""
        return None

    def work(self, cell: Cell) -> Column | None:
        """A value that ``after`` and ``message`` both need, computed once."""
        return None

    def after(self, cell: Cell) -> Column:
        return cell.before

    def result_type(self, dtype: T.DataType) -> T.DataType:
        """The type of ``after`` for a column of type ``dtype``."""
        return dtype

    def changed(self, cell: Cell) -> Column:
        return ~cell.before.eqNullSafe(cell.after)

    def message(self, cell: Cell) -> Column | None:
        """Issue text, null where the cell is fine; ``None`` if the step never complains."""
        return None

    def apply(self, df: DataFrame, step: int) -> Outcome:
        return RowSegment([(step, self)]).apply(df)


@dataclass
class _Target:
    step: int
    operation: str
    rule: str
    column: str
    dtype: T.DataType
    before: str
    after: str | None = None
    after_type: T.DataType | None = None
    changed: str | None = None
    message: str | None = None


@dataclass
class RowSegment:
    """Consecutive row-wise steps evaluated as one stage."""

    steps: list[tuple[int, RowStep]]
    cells: list[_Target] = field(default_factory=list)

    def layer(self, df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
        """Add a column per cell version, change flag and message."""
        names = user_columns(df)
        current = {name: name for name in names}
        known = {f.name: f.dataType for f in df.schema.fields}
        self.cells = []
        for step, op in self.steps:
            types = picked_types(known, op.columns, op.rewrites)
            fresh = []
            for i, (name, dtype) in enumerate(types.items()):
                if op.needs_text and not isinstance(dtype, T.StringType):
                    raise ValueError(f"{op.name} needs a text column, {name} is {dtype.simpleString()}")
                cell = _Target(step, op.name, op.rule, name, dtype, current[name])
                if op.rewrites:
                    cell.after = f"_after_{step}_{i}"
                    cell.after_type = known[name] = op.result_type(dtype)
                    current[name] = cell.after
                fresh.append(cell)
            views = [Cell(c.column, col(c.before), c.dtype) for c in fresh]
            for stage, make in (("prepared", op.prepare), ("work", op.work)):
                shared = [make(view) for view in views]
                if any(value is not None for value in shared):
                    df = df.select("*", *[value.alias(f"_{stage}_{step}_{i}") for i, value in enumerate(shared)])
                    for i, view in enumerate(views):
                        setattr(view, stage, col(f"_{stage}_{step}_{i}"))
            if op.rewrites:
                df = df.select("*", *[op.after(view).alias(c.after) for c, view in zip(fresh, views)])
            extra = []
            for i, (c, view) in enumerate(zip(fresh, views)):
                view.after = col(c.after or c.before)
                if op.rewrites:
                    c.changed = f"_changed_{step}_{i}"
                    extra.append(op.changed(view).alias(c.changed))
                message = op.message(view)
                if message is not None:
                    c.message = f"_message_{step}_{i}"
                    extra.append(message.alias(c.message))
            if extra:
                df = df.select("*", *extra)
            self.cells += fresh
        return df, current

    def apply(self, df: DataFrame) -> Outcome:
        layered, current = self.layer(df)
        return self._outcome(layered, current)

    def _outcome(self, layered: DataFrame, current: dict[str, str]) -> Outcome:
        keep = [ROW_ID] if ROW_ID in layered.columns else []
        data = layered.select(*keep, *[col(v).alias(k) for k, v in current.items()])
        return Outcome(
            data=data,
            counts=self._counts(layered),
            changes=self._changes(layered),
            issues=self._issues(layered),
        )

    def staged(self, df: DataFrame) -> Outcome:
        """The same outcome, with the stage written once and shared by its readers."""
        layered, current = self.layer(df)
        needed = {ROW_ID, *current.values()}
        for c in self.cells:
            needed |= {x for x in (c.before, c.after, c.changed, c.message) if x}
        frozen = freeze(layered.select(*[col(n) for n in layered.columns if n in needed]), "stage")
        return self._outcome(frozen, current)

    def _explode(self, layered: DataFrame, entries: list[Column]) -> DataFrame | None:
        if not entries:
            return None
        return layered.select(F.col(ROW_ID).alias("row_id"), F.explode(F.array_compact(F.array(*entries))).alias("e"))

    def _changes(self, layered: DataFrame) -> DataFrame | None:
        entries = [
            F.when(
                col(c.changed),
                F.struct(
                    F.lit(c.step).alias("step"), F.lit(c.operation).alias("operation"),
                    F.lit(c.column).alias("column"), render(col(c.before), c.dtype).alias("before"),
                    render(col(c.after), c.after_type).alias("after"),
                    F.lit(c.dtype.simpleString()).alias("value_type"),
                ),
            )
            for c in self.cells
            if c.changed
        ]
        out = self._explode(layered, entries)
        return out and out.select(
            "e.step", "e.operation", "row_id", "e.column", "e.before", "e.after", "e.value_type",
            F.col("e.operation").alias("reason"),
        )

    def _issues(self, layered: DataFrame) -> DataFrame | None:
        entries = [
            F.when(
                col(c.message).isNotNull(),
                F.struct(
                    F.lit(c.step).alias("step"), F.lit(c.operation).alias("operation"),
                    F.lit(c.column).alias("column"), F.lit(c.rule).alias("rule"),
                    render(col(c.after or c.before), c.after_type or c.dtype).alias("value"),
                    F.lit(c.dtype.simpleString()).alias("value_type"), col(c.message).alias("message"),
                ),
            )
            for c in self.cells
            if c.message
        ]
        out = self._explode(layered, entries)
        return out and out.select(
            "e.step", "e.operation", "row_id", "e.column", "e.rule", "e.value", "e.value_type", "e.message"
        )

    def _counts(self, layered: DataFrame) -> DataFrame:
        """Counts of every step in one aggregation, without building the ledgers."""
        aggs, rows = [], []
        for step, op in self.steps:
            mine = [c for c in self.cells if c.step == step]
            changed = [F.count_if(col(c.changed)) for c in mine if c.changed]
            issues = [F.count(col(c.message)) for c in mine if c.message]
            for kind, counts in (("c", changed), ("i", issues)):
                total = reduce(lambda a, b: a + b, counts, F.lit(0))
                aggs.append(total.cast("long").alias(f"{kind}{step}"))
            rows.append(
                F.struct(
                    F.lit(step).alias("step"), F.lit(op.name).alias("operation"),
                    F.lit(0).cast("long").alias("rows_removed"), F.col(f"c{step}").alias("cells_changed"),
                    F.col(f"i{step}").alias("validation_issues"), F.lit(0).cast("long").alias("duplicate_groups"),
                )
            )
        return layered.agg(*aggs).select(F.inline(F.array(*rows)))


def union_all(frames: list[DataFrame | None], schema: str, like: DataFrame) -> DataFrame:
    """Union of ledgers, or an empty one of the same shape."""
    found = [f for f in frames if f is not None]
    if not found:
        return like.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, found)
