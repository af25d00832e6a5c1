"""Ordered cleaning plans: one lazy table plus audit ledgers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.base import COUNTS, LEDGERS, Outcome, RowSegment, RowStep, Step, column_types, union_all
from ..operators.exact import ExactDedup
from ..operators.fuzzy import FuzzyDedup
from ..operators.missing import MissingValues
from ..sources.rowid import ROW_ID, with_row_id
from .options import steps_from_options

PREVIEW_ROWS = 20
PREVIEW_MAX = 100


@dataclass
class CleanRun:
    """The planned result.

    Everything is a DataFrame and no table is collected.  Deduplication runs jobs
    of its own when a result that needs it is first asked for, and once.
    """

    source: DataFrame
    planned: DataFrame
    steps: list[tuple[int, str]]
    ledgers: dict[str, list[DataFrame]] = field(default_factory=dict)
    counts: list[DataFrame] = field(default_factory=list)
    staged: bool = False
    again: Callable[[bool], CleanRun] | None = None
    # what is left to plan, and whether it can write more than duplicates
    rest: Callable[[], None] | None = None
    rest_writes: bool = False

    def finish(self) -> None:
        """Plan the steps that were put off."""
        rest, self.rest = self.rest, None
        if rest:
            rest()

    @property
    def numbered(self) -> DataFrame:
        """The cleaned rows with their row ids."""
        self.finish()
        return self.planned

    @property
    def data(self) -> DataFrame:
        return self.numbered.drop(ROW_ID)

    def ledger(self, kind: str) -> DataFrame:
        if kind == "duplicates" or self.rest_writes:
            self.finish()
        return union_all(self.ledgers.get(kind, []), LEDGERS[kind], self.source)

    @property
    def changes(self) -> DataFrame:
        return self.ledger("changes")

    @property
    def issues(self) -> DataFrame:
        return self.ledger("issues")

    @property
    def duplicates(self) -> DataFrame:
        return self.ledger("duplicates")

    @property
    def suggestions(self) -> DataFrame:
        return self.ledger("suggestions")

    @property
    def summary(self) -> DataFrame:
        """One row of counts per step, zero rows included."""
        self.finish()
        return union_all(self.counts, COUNTS, self.source)

    @property
    def report(self) -> DataFrame:
        """One row of totals.  Rows after follow from what each step removed."""
        before = self.source.agg(F.count(F.lit(1)).alias("n")).scalar()
        totals = self.summary.agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c)
              for c in ("rows_removed", "cells_changed", "validation_issues", "duplicate_groups")]
        )
        return totals.select(
            before.alias("rows_before"), (before - F.col("rows_removed")).alias("rows_after"), "rows_removed",
            "cells_changed", F.col("validation_issues").alias("validation_issue_count"),
            F.col("duplicate_groups").alias("duplicate_group_count"),
        )

    def preview(self, limit: int = PREVIEW_ROWS) -> DataFrame:
        """The first cleaned rows in row order, without sorting the rest."""
        if not 1 <= limit <= PREVIEW_MAX:
            raise ValueError(f"A preview has 1 to {PREVIEW_MAX} rows")
        return self.numbered.orderBy(ROW_ID).limit(limit)


class Cleaner:
    """An ordered list of steps with unique names."""

    def __init__(self, steps) -> None:
        self.steps: list[Step] = list(steps)
        if not self.steps:
            raise ValueError("Give the steps of the plan")
        names = [s.name.strip() for s in self.steps]
        if not all(names):
            raise ValueError("A step has no name")
        if len(set(names)) != len(names):
            raise ValueError("Two steps have one name")

    def run(self, df: DataFrame, key: str | None = None, staged: bool = False) -> CleanRun:
        """Plan the steps over ``df``.

        Row ids come from ``_row_id``, from the unique column ``key``, or are
        assigned.  Consecutive row-wise steps become one stage.  With ``staged``
        each such stage is written once and shared by data and ledgers; without
        it every output re-reads the source, pruned to the columns it needs.
        """
        current = with_row_id(df, key)
        run = CleanRun(source=df, planned=current, steps=[(i, s.name) for i, s in enumerate(self.steps)], staged=staged)
        run.again = lambda anew: self.run(df, key, anew)
        whole = [isinstance(s, (ExactDedup, FuzzyDedup)) for s in self.steps]
        until = whole.index(True) if any(whole) else len(whole)
        self._plan(run, range(until))
        if until < len(whole):
            column_types(run.planned, self.steps[until].columns)  # a wrong column shows now
            run.rest = lambda: self._plan(run, range(until, len(whole)))
            run.rest_writes = not all(whole[until:])
        return run

    def _plan(self, run: CleanRun, which: range) -> None:
        pending: list[tuple[int, RowStep]] = []

        def flush() -> None:
            if pending:
                segment = RowSegment(list(pending))
                outcome = segment.staged(run.planned) if run.staged else segment.apply(run.planned)
                run.planned = _record(run, None, outcome)
                pending.clear()

        for i in which:
            step = self.steps[i]
            if isinstance(step, MissingValues):
                if step.policy == "fill":
                    step = step.row_step(run.planned)
                elif step.policy in ("mean", "median", "mode"):
                    flush()  # the statistic is taken from the table at this point
                    step = step.row_step(run.planned)
            if isinstance(step, RowStep):
                pending.append((i, step))
                continue
            flush()
            run.planned = _record(run, (i, step.name), step.apply(run.planned, i))
        flush()


def _record(run: CleanRun, label: tuple[int, str] | None, outcome: Outcome) -> DataFrame:
    """Add an outcome's ledgers and counts to the run."""
    found = {}
    for kind in LEDGERS:
        ledger = getattr(outcome, kind)
        if ledger is None:
            continue
        if label is not None and "step" not in ledger.columns:
            ledger = ledger.select(F.lit(label[0]).alias("step"), F.lit(label[1]).alias("operation"), "*")
        found[kind] = ledger
        run.ledgers.setdefault(kind, []).append(ledger)
    counts = outcome.counts
    if counts is None and label is not None:
        counts = _count(run, label, found, outcome.removed)
    if counts is not None:
        run.counts.append(counts)
    return outcome.data


def _count(run: CleanRun, label: tuple[int, str], found: dict[str, DataFrame], removed: DataFrame | None) -> DataFrame:
    zero = F.lit(0).cast("long")

    def rows(df: DataFrame | None, what=None):
        return zero if df is None else df.agg((F.count(F.lit(1)) if what is None else what).alias("n")).scalar()

    one = run.source.sparkSession.range(1)
    return one.select(
        F.lit(label[0]).alias("step"), F.lit(label[1]).alias("operation"),
        rows(removed).alias("rows_removed"), rows(found.get("changes")).alias("cells_changed"),
        rows(found.get("issues")).alias("validation_issues"),
        rows(found.get("duplicates"), F.count_distinct("kept_row")).alias("duplicate_groups"),
    )


def clean(df: DataFrame, options: dict | None = None, key: str | None = None, staged: bool = False, **more) -> CleanRun:
    """Clean by flat options; without any operation the run reports zero steps."""
    steps = steps_from_options(options, **more)
    if not steps:
        return CleanRun(source=df, planned=with_row_id(df, key), steps=[])
    return Cleaner(steps).run(df, key, staged)
