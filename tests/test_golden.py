"""One table through a plan that uses every kind of step, checked cell by cell."""

import json

from tidemark import Cleaner, read_table, report_lines, steps_from_options

TABLE = """card,reader,mail,joined,fee,tier,mobile
K7,"  marta\u00a0 VOGT",Marta.Vogt@Lib.example,05.11.2025,12.5,gold,(212) 555-0147
K8,Ole Brandt,ole@lib.example,2025-12-24,,silver,+1 646 555 0102
K9,"marta vogt", marta.vogt@lib.example,2025-11-05,12.5,gold,+12125550147
L1,Pia Roth,pia(at)lib.example,31.02.2025,0,bronze,call me
L2,,nils@lib.example,07.01.2026,-3,gold,
L3,Ole  Brandt,OLE@lib.example,24.12.2025,20,silver,646-555-0102
L4,Uma Sand,uma@lib.example,,seven,Gold,+1 917 555 0188
"""

OPTIONS = dict(
    infer_types=True, type_columns="fee,joined",
    missing_policy="fill", missing_columns="fee", fill_value="10",
    normalize="text,email,date,phone", text_columns="reader", email_columns="mail",
    date_columns="joined", date_input_format="%Y-%m-%d,%d.%m.%Y", phone_columns="mobile",
    validate="required,email,date,positive,allowed",
    required_columns="card,reader,joined", valid_email_columns="mail",
    parseable_date_columns="joined", validation_date_format="%Y-%m-%d,%d.%m.%Y",
    positive_columns="fee", allowed_columns="tier", allowed_values="gold,silver",
    dedup="fuzzy", dedup_columns="reader,mail", fuzzy_threshold=94, fuzzy_mode="remove_strict",
)

CLEANED = [
    (0, "K7", "marta VOGT", "marta.vogt@lib.example", "2025-11-05", "12.5", "gold", "+12125550147"),
    (1, "K8", "Ole Brandt", "ole@lib.example", "2025-12-24", "10", "silver", "+16465550102"),
    (3, "L1", "Pia Roth", "pia(at)lib.example", "31.02.2025", "0", "bronze", "call me"),
    (4, "L2", None, "nils@lib.example", "2026-01-07", "-3", "gold", None),
    (6, "L4", "Uma Sand", "uma@lib.example", None, "seven", "Gold", "+19175550188"),
]

CHANGES = {
    "missing-value-handling": {(1, "fee", None, "10")},
    "text-normalization": {(0, "reader", "  marta\u00a0 VOGT", "marta VOGT"), (5, "reader", "Ole  Brandt", "Ole Brandt")},
    "email-normalization": {
        (0, "mail", "Marta.Vogt@Lib.example", "marta.vogt@lib.example"), (2, "mail", " marta.vogt@lib.example", "marta.vogt@lib.example"),
        (5, "mail", "OLE@lib.example", "ole@lib.example"),
    },
    "date-normalization": {
        (0, "joined", "05.11.2025", "2025-11-05"), (4, "joined", "07.01.2026", "2026-01-07"), (5, "joined", "24.12.2025", "2025-12-24"),
    },
    "phone-normalization": {
        (0, "mobile", "(212) 555-0147", "+12125550147"), (1, "mobile", "+1 646 555 0102", "+16465550102"),
        (5, "mobile", "646-555-0102", "+16465550102"), (6, "mobile", "+1 917 555 0188", "+19175550188"),
    },
}

ISSUES = {
    ("required-value-validation", 4, "reader", "required", None), ("required-value-validation", 6, "joined", "required", None),
    ("email-validation", 3, "mail", "valid_email", "pia(at)lib.example"),
    ("date-parseability-validation", 3, "joined", "parseable_date", "31.02.2025"),
    ("positive-number-validation", 3, "fee", "positive_number", "0"), ("positive-number-validation", 4, "fee", "positive_number", "-3"),
    ("positive-number-validation", 6, "fee", "positive_number", "seven"),
    ("allowed-values-validation", 3, "tier", "allowed_values", "bronze"),
    ("email-normalization", 3, "mail", "valid_email", "pia(at)lib.example"),
    ("date-normalization", 3, "joined", "parseable_date", "31.02.2025"), ("phone-normalization", 3, "mobile", "valid_phone", "call me"),
}


def run(spark, tmp_path, staged):
    path = tmp_path / "readers.csv"
    path.write_text(TABLE)
    return Cleaner(steps_from_options(OPTIONS)).run(read_table(spark, str(path), row_id=True), staged=staged)


def check(result):
    assert [tuple(r) for r in result.numbered.orderBy("_row_id").collect()] == CLEANED
    changes = {}
    for r in result.changes.collect():
        changes.setdefault(r.operation, set()).add((r.row_id, r.column, r.before, r.after))
    assert changes == CHANGES
    assert {(r.operation, r.row_id, r.column, r.rule, r.value) for r in result.issues.collect()} == ISSUES
    groups = {(r.kept_row, tuple(r.matched_rows), r.score, r.reason) for r in result.duplicates.collect()}
    assert groups == {(0, (2,), 100.0, "fuzzy duplicate above threshold 94"), (1, (5,), 100.0, "fuzzy duplicate above threshold 94")}
    n_changes, n_issues = sum(map(len, CHANGES.values())), len(ISSUES)
    assert tuple(result.report.first()) == (7, 5, 2, n_changes, n_issues, 2)
    for r in result.summary.collect():
        assert r.cells_changed == len(CHANGES.get(r.operation, ())) and r.validation_issues == sum(i[0] == r.operation for i in ISSUES)
        assert (r.rows_removed, r.duplicate_groups) == ((2, 2) if r.operation == "fuzzy-deduplication" else (0, 0))
    types = {(r.column, r.suggested_type, r.confidence) for r in result.suggestions.collect()}
    assert types == {("fee", "number", 0.83), ("joined", "text", 1.0)}


def test_full_plan(spark, tmp_path):
    check(run(spark, tmp_path, staged=False))


def test_full_plan_staged(spark, tmp_path):
    check(run(spark, tmp_path, staged=True))


def test_report_lines_hold_the_whole_report(spark, tmp_path):
    sections = {}
    for r in report_lines(run(spark, tmp_path, staged=False)).collect():
        sections.setdefault(r.section, []).append((r.step, json.loads(r.json)))
    assert sections["report"][0][1]["rows_removed"] == 2
    assert sum(len(v) for _, v in sections["cell_changes"]) == sum(map(len, CHANGES.values()))
    assert sum(len(v) for _, v in sections["issues"]) == len(ISSUES)
    assert {g["kept_row"] for _, v in sections["duplicates"] for g in v} == {0, 1}
