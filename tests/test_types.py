"""Columns of every type through profiling, keys, required checks and fills."""

from datetime import date, datetime
from decimal import Decimal

import pytest

from tidemark import Cleaner, ExactDedup, FuzzyDedup, InferTypes, MissingValues, NormalizeText, Required

SCHEMA = "_row_id bigint, day date, at timestamp_ntz, price decimal(9,2), tags array<string>, n bigint"


@pytest.fixture(scope="module")
def typed(spark):
    return spark.createDataFrame([
        (0, date(2026, 1, 2), datetime(2026, 1, 2, 3), Decimal("1.50"), ["a"], 1), (1, date(2026, 1, 2), datetime(2026, 1, 2, 3), Decimal("1.50"), ["a"], 1),
        (2, None, None, None, None, None), (3, date(2026, 1, 3), datetime(2026, 1, 2, 3), Decimal("1.50"), ["a"], 4),
    ], SCHEMA)


def test_profiles_keys_and_required(typed):
    found = {r.column: r.suggested_type for r in Cleaner([InferTypes()]).run(typed).suggestions.collect()}
    assert found == {"day": "date", "at": "text", "price": "number", "tags": "text", "n": "number"}
    run = Cleaner([ExactDedup()]).run(typed)
    assert [(r.kept_row, r.matched_rows) for r in run.duplicates.collect()] == [(0, [1])]
    issues = Cleaner([Required(["day", "at", "price", "tags"])]).run(typed).issues.collect()
    assert {(r.row_id, r.column, r.value) for r in issues} == {(2, c, None) for c in ("day", "at", "price", "tags")}
    run = Cleaner([FuzzyDedup(["day", "at"], 90, "remove_strict")]).run(typed)
    assert {(r.kept_row, tuple(r.matched_rows)) for r in run.duplicates.collect()} == {(0, (1, 3))}
    with pytest.raises(ValueError):
        Cleaner([NormalizeText(["at"])]).run(typed)


@pytest.mark.parametrize("policy, value", [("mean", 2.0), ("median", 1.0)])
def test_integers_are_filled_with_any_number(spark, typed, policy, value):
    run = Cleaner([MissingValues(["n"], policy), Required(["n"])]).run(typed)
    assert dict(run.data.dtypes)["n"] == "double"
    assert [r.n for r in run.numbered.orderBy("_row_id").collect()] == [1.0, 1.0, value, 4.0]
    assert [(r.row_id, r.before, r.after) for r in run.changes.collect()] == [(2, None, str(value))]
    half = spark.createDataFrame([(1,), (2,), (None,)], "n int")
    assert sorted(r.n for r in Cleaner([MissingValues(["n"], policy)]).run(half).data.collect()) == [1.0, 1.5, 2.0]
