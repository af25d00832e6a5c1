"""Row-wise steps, missing values, inference and exact deduplication."""

import pytest
from pyspark.sql import functions as F

from tidemark import (
    AllowedValues, Cleaner, ExactDedup, FillBlanks, InferTypes, InRange, MissingValues, NormalizeDate, NormalizeEmail,
    NormalizePhone, NormalizeText, Outcome, ParseableDate, Positive, Required, Step, ValidEmail, shape,
    clean, columns_by_name, steps_from_options,
)
from tidemark.plans import skew
from tidemark.plans.stats import exact_median


def rows(run, *columns):
    return [tuple(r) for r in run.numbered.orderBy("_row_id").select(*columns).collect()]


def changes(run):
    return [tuple(r) for r in run.changes.orderBy("step", "row_id", "column").select("row_id", "column", "before", "after").collect()]


def issues(run):
    found = run.issues.orderBy("step", "row_id", "column").select("row_id", "column", "rule", "value", "message")
    return [tuple(r) for r in found.collect()]


def test_blank_cells_become_null_and_are_logged(spark, cells):
    table = cells(["email", "day"], [("  ", ""), (" A@B.c ", " 1/2/2026 "), (None, None), ("bad", "x")])
    run = Cleaner([NormalizeEmail(["email"]), NormalizeDate(["day"], ["%m/%d/%Y"])]).run(table)
    assert rows(run, "email", "day") == [(None, None), ("a@b.c", "2026-01-02"), (None, None), ("bad", "x")]
    assert changes(run) == [
        (0, "email", "  ", None), (1, "email", " A@B.c ", "a@b.c"), (0, "day", "", None), (1, "day", " 1/2/2026 ", "2026-01-02"),
    ]
    assert issues(run) == [
        (3, "email", "valid_email", "bad", "Email is invalid"), (3, "day", "parseable_date", "x", "Date could not be parsed"),
    ]


def test_text_keeps_blanks_as_empty_and_skips_numbers(spark):
    table = spark.createDataFrame([(0, "  ", 5), (1, None, None), (2, "a  B", 7)], "_row_id bigint, t string, n int")
    run = Cleaner([NormalizeText(["t", "n"], "upper")]).run(table)
    assert rows(run, "t", "n") == [("", 5), (None, None), ("A B", 7)]
    assert changes(run) == [(0, "t", "  ", ""), (2, "t", "a  B", "A B")]


def test_steps_on_one_column_see_each_other(spark, cells):
    run = Cleaner([NormalizeText(["t"]), NormalizeText(["t"], "title", name="titles"), Required(["t"])]).run(
        cells(["t"], [(" a  b ",), ("c",)])
    )
    assert changes(run) == [(0, "t", " a  b ", "a b"), (0, "t", "a b", "A B"), (1, "t", "c", "C")]
    assert {r.reason for r in run.changes.collect()} == {"text-normalization", "titles"}


def test_custom_phone_normalizer(spark, cells):
    fixed = NormalizePhone(["p"], "US", normalizer=lambda c, region: F.when(c.startswith("1"), F.concat(F.lit(region), c)))
    run = Cleaner([fixed]).run(cells(["p"], [("12",), ("9",)]))
    assert rows(run, "p") == [("US12",), ("9",)]
    assert issues(run) == [(1, "p", "valid_phone", "9", "Phone number is invalid")]


def test_rules(spark, cells):
    table = cells(["amount"], [("5",), ("-1",), ("broken",), ("  ",), (None,), ("nan",), ("0",), ("1_000",)])
    run = Cleaner([InRange(["amount"], 0, 10.5), Positive(["amount"])]).run(table)
    assert [(i[0], i[4]) for i in issues(run)] == [
        (1, "Value is below minimum 0"), (2, "Value is not numeric"), (7, "Value is above maximum 10.5"),
        (1, "Value must be positive"), (2, "Value is not numeric"), (6, "Value must be positive"),
    ]
    table = cells(["s"], [("ACTIVE",), (" active",), ("Straße",), ("",), ("no",)])
    run = Cleaner([AllowedValues(["s"], ["active", "STRASSE"])]).run(table)
    assert [i[0] for i in issues(run)] == [1, 4]
    table = cells(["e", "d"], [("a@b.c", "2026-01-02"), ("a@b", "02/30/2026"), (" ", None)])
    run = Cleaner([ValidEmail(["e"]), ParseableDate(["d"], ["%Y-%m-%d", "%m/%d/%Y"])]).run(table)
    assert [(i[0], i[2]) for i in issues(run)] == [(1, "valid_email"), (1, "parseable_date")]


def test_rules_on_typed_columns(spark):
    table = spark.createDataFrame(
        [(0, 1.5, True, 3), (1, float("nan"), False, None), (2, -2.0, None, 9)], "_row_id bigint, x double, b boolean, n int"
    )
    run = Cleaner([InRange(["x", "n"], 0, 5), Positive(["b"]), Required(["x", "n"])]).run(table)
    assert [(i[0], i[1], i[3], i[4]) for i in issues(run)] == [
        (2, "n", "9", "Value is above maximum 5"), (2, "x", "-2.0", "Value is below minimum 0"),
        (0, "b", "True", "Value is not numeric"), (1, "b", "False", "Value is not numeric"),
        (1, "n", None, "Required value is missing"), (1, "x", "nan", "Required value is missing"),
    ]


def test_missing_policies(spark, cells):
    table = cells(["a", "b"], [("1", "x"), ("  ", "y"), ("4", None), ("3", "y"), (None, "x")])
    run = Cleaner([MissingValues(["a"], "mean")]).run(table)
    assert [r[0] for r in rows(run, "a")] == ["1", str(8 / 3), "4", "3", str(8 / 3)]
    run = Cleaner([MissingValues(["a"], "median")]).run(table)
    assert [r[0] for r in rows(run, "a")] == ["1", "3.0", "4", "3", "3.0"]
    run = Cleaner([MissingValues(["b"], "mode")]).run(table)
    assert [r[0] for r in rows(run, "b")] == ["x", "y", "x", "y", "x"]
    run = Cleaner([MissingValues(["a", "b"], "drop_rows"), Required(["a"])]).run(table)
    assert rows(run, "a") == [("1",), ("3",)] and run.report.first().rows_after == 2
    run = Cleaner([MissingValues(["a", "b"], "fill", "0")]).run(table)
    assert changes(run) == [(1, "a", "  ", "0"), (2, "b", None, "0"), (4, "a", None, "0")]
    run = Cleaner([MissingValues(["a"])]).run(table)
    assert run.report.first().cells_changed == 0 and run.data.count() == 5


def test_missing_errors(spark, cells):
    table = cells(["a"], [("1",), ("x",), (None,)])
    for policy in ("mean", "median"):
        with pytest.raises(ValueError):
            Cleaner([MissingValues(["a"], policy)]).run(table)
        with pytest.raises(ValueError):
            Cleaner([MissingValues(["a"], policy)]).run(cells(["a"], [(None,)]))
    assert changes(Cleaner([MissingValues(["a"], "mode")]).run(cells(["a"], [(None,), (" ",)]))) == []
    for bad in (dict(columns=[]), dict(columns=["a"], policy="fill"), dict(columns=["a"], policy="odd")):
        with pytest.raises(ValueError):
            MissingValues(**bad)
    typed = spark.createDataFrame([(0, None)], "_row_id bigint, n int")
    with pytest.raises(ValueError):
        Cleaner([FillBlanks({"n": "x"})]).run(typed)
    assert rows(Cleaner([FillBlanks({"n": "7"})]).run(typed), "n") == [(7,)]


def test_median_narrows_to_the_exact_value(spark):
    import random
    import statistics

    rng = random.Random(1)
    for values in (
        [rng.gauss(0, 1) for _ in range(4001)], [rng.randint(0, 3) * 1.0 for _ in range(3000)],
        [1.0] * 1500 + [2.0] * 1500, [float(i) for i in range(2500)],
    ):
        frame = spark.createDataFrame([(v,) for v in values], "v double")
        assert exact_median(frame, len(values), small_rows=50) == statistics.median(values)


def test_inference(spark, cells):
    table = cells(
        ["age", "day", "name", "flag", "none", "id"],
        [("10", "2026-01-02", "Al", "yes", " ", "001"), ("x", "01/02/2026", "Bo", "0", None, "002"), ("30", "", "Cy", "No", "", "003")],
    )
    found = {r.column: (r.suggested_type, r.confidence, r.reason) for r in InferTypes(overrides={"id": "text"}).suggestions(table).collect()}
    assert found == {
        "age": ("number", 0.67, "3 non-blank values sampled"), "day": ("date", 1.0, "2 non-blank values sampled"),
        "name": ("text", 1.0, "3 non-blank values sampled"), "flag": ("boolean", 1.0, "3 non-blank values sampled"),
        "none": ("empty", 1.0, "all values are blank"), "id": ("text", 1.0, "explicit override"),
    }
    with pytest.raises(ValueError):
        InferTypes(date_formats=())
    assert tuple(shape(table).first()) == (3, 6, ["age", "day", "name", "flag", "none", "id"])


THINGS = [(" Oak   Bench ", "shed-4", "north"), ("oak bench", "SHED-4", "north"), ("Lantern", "loft-1", "south"),
          ("Lantern", "loft-9", "south"), (None, None, None), (None, None, None)]


def duplicates(run):
    return sorted((r.kept_row, r.matched_rows, r.score, r.reason) for r in run.duplicates.collect())


def test_exact_dedup(spark, cells):
    table = cells(["item", "place", "side"], THINGS)
    run = Cleaner([ExactDedup()]).run(table)
    assert duplicates(run) == [(0, [1], 100.0, "exact duplicate"), (4, [5], 100.0, "exact duplicate")]
    assert [r[0] for r in rows(run, "_row_id")] == [0, 2, 3, 4]
    run = Cleaner([ExactDedup(["item", "side"])]).run(table)
    assert [d[:2] for d in duplicates(run)] == [(0, [1]), (2, [3]), (4, [5])]
    assert run.report.first().rows_removed == 3
    with pytest.raises(ValueError):
        Cleaner([ExactDedup(["nope"])]).run(table)


def test_exact_dedup_keys_do_not_run_together(spark, cells):
    table = cells(["a", "b"], [("1:x", ""), ("1", "x"), ("", "1:x"), (None, "x"), ("", "x"), ("-", "x")])
    assert Cleaner([ExactDedup()]).run(table).data.count() == 6


def test_exact_dedup_of_a_heavy_key(spark, cells, monkeypatch):
    monkeypatch.setattr(skew, "HEAVY_FLOOR", 5)
    monkeypatch.setattr(skew, "HEAVY_SHARE", 3)
    monkeypatch.setattr(skew, "PART_ROWS", 10)
    run = Cleaner([ExactDedup(["k"])]).run(cells(["k"], [("hot",)] * 40 + [("a",), ("b",), ("a",)]))
    assert run.data.count() == 3
    summary = run.summary.first()
    assert (summary.rows_removed, summary.duplicate_groups) == (38 + 2, 2)
    hot = sorted((r.part, r.matched_rows) for r in run.duplicates.collect() if r.kept_row == 0)
    assert [m for _, part in hot for m in part] == list(range(1, 40))


class DropShort(Step):
    name = "drop-short"

    def apply(self, df, step):
        short = F.length("t") < 2
        found = df.where(short).select(
            F.col("_row_id").alias("row_id"), F.lit("t").alias("column"), F.lit("short").alias("rule"),
            F.col("t").alias("value"), F.lit("string").alias("value_type"), F.lit("Too short").alias("message"),
        )
        return Outcome(data=df.where(~short), issues=found, removed=df.where(short))


def test_custom_step_and_preview(spark, cells):
    run = Cleaner([DropShort(), NormalizeText(["t"], "upper")]).run(cells(["t"], [("a",), ("bb",), ("cc",)]))
    assert rows(run, "t") == [("BB",), ("CC",)]
    assert issues(run) == [(0, "t", "short", "a", "Too short")]
    assert [tuple(r) for r in run.summary.orderBy("step").collect()] == [
        (0, "drop-short", 1, 0, 1, 0), (1, "text-normalization", 0, 2, 0, 0),
    ]
    assert [r.t for r in run.preview(1).collect()] == ["BB"]
    for limit in (0, 101):
        with pytest.raises(ValueError):
            run.preview(limit)


def test_cleaning_by_options(spark, cells):
    table = cells(["a"], [(" x ",), ("y",)])
    run = clean(table, normalize="text", text_columns="a")
    assert rows(run, "a") == [("x",), ("y",)]
    nothing = clean(table)
    assert tuple(nothing.report.first()) == (2, 2, 0, 0, 0, 0)
    assert nothing.summary.count() == 0 and rows(nothing, "a") == [(" x ",), ("y",)]


def test_bad_plans(spark, cells):
    table = cells(["a b", "c.d"], [("x", "y")])
    with pytest.raises(ValueError):
        Cleaner([])
    with pytest.raises(ValueError):
        Cleaner([Required(["a"]), Required(["b"])])
    with pytest.raises(ValueError):
        Cleaner([Required(["a"], name=" ")])
    with pytest.raises(ValueError):
        Cleaner([Required(["missing"])]).run(table)
    for make in (NormalizeText, NormalizeEmail, Required, Positive, ValidEmail):
        with pytest.raises(ValueError):
            make([])
    for make in (lambda: InRange(["a"]), lambda: InRange(["a"], 2, 1), lambda: AllowedValues(["a"], []),
                 lambda: ParseableDate(["a"], []), lambda: NormalizeDate(["a"], []), lambda: NormalizeDate(["a"], ["%Y"], " "),
                 lambda: NormalizePhone(["a"], " "), lambda: Required(["a", "a"])):
        with pytest.raises(ValueError):
            make()
    run = Cleaner([NormalizeText(["a b", "c.d"], "upper")]).run(table)
    assert rows(run, "`a b`", "`c.d`") == [("X", "Y")]
    with pytest.raises(ValueError):
        Cleaner([NormalizeEmail(["n"])]).run(spark.createDataFrame([(0, 1)], "_row_id bigint, n int"))


def test_options():
    steps = steps_from_options(
        normalize="date, text", normalize_columns="a,b", date_columns="d", validate="range,allowed", range_columns="x",
        min_value=1, allowed_columns="s", allowed_values="p, q", dedup="Exact", missing_policy="FILL", missing_columns="x",
        fill_value="0", infer_types=True, type_overrides="x:NUMBER",
    )
    assert [s.name for s in steps] == [
        "type-inference", "missing-value-handling", "range-validation", "allowed-values-validation", "date-normalization",
        "text-normalization", "exact-deduplication",
    ]
    assert steps[0].overrides == {"x": "number"} and steps[4].columns == ("d",) and steps[5].columns == ("a", "b")
    assert steps[3].allowed_values == ("p", "q") and steps[6].columns == ()
    assert steps_from_options() == []
    for bad in (
        dict(dedup="other"), dict(dedup="fuzzy"), dict(validate="odd"), dict(normalize="text"), dict(type_overrides="x", infer_types=True),
        dict(missing_policy="mean"), dict(nothing=1), dict(validate="required"), dict(missing_policy="fill", missing_columns="a"),
    ):
        with pytest.raises(ValueError):
            steps_from_options(bad)
    hints = columns_by_name(["Customer_Email", "signup", "amount", "x"])
    assert hints == {
        "text_columns": ["Customer_Email"], "email_columns": ["Customer_Email"], "date_columns": ["signup"],
        "missing_columns": ["Customer_Email", "amount"], "dedup_columns": ["Customer_Email"],
    }
