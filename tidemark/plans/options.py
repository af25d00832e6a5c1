"""Cleaning plans from flat options: comma lists, names and defaults."""

from __future__ import annotations

from ..operators.base import Step
from ..operators.exact import ExactDedup
from ..operators.fuzzy import FuzzyDedup
from ..operators.infer import InferTypes
from ..operators.missing import MissingValues
from ..operators.normalize import NormalizeDate, NormalizeEmail, NormalizePhone, NormalizeText
from ..operators.validate import AllowedValues, InRange, ParseableDate, Positive, Required, ValidEmail

# Option names and their defaults.
DEFAULTS = {
    "dedup": "none", "dedup_columns": "", "fuzzy_threshold": 92, "fuzzy_mode": "suggest",
    "infer_types": False, "type_columns": "", "type_overrides": "",
    "missing_policy": "keep", "missing_columns": "", "fill_value": "",
    "validate": "", "required_columns": "", "range_columns": "", "min_value": None, "max_value": None,
    "positive_columns": "", "allowed_columns": "", "allowed_values": "", "valid_email_columns": "",
    "parseable_date_columns": "", "validation_date_format": "%Y-%m-%d,%m/%d/%Y",
    "normalize": "", "normalize_columns": "", "text_columns": "", "email_columns": "", "date_columns": "",
    "phone_columns": "", "text_case": "keep", "date_input_format": "%m/%d/%Y",
    "date_output_format": "%Y-%m-%d", "phone_region": "US",
}


def names(value: str) -> list[str]:
    return [part.strip() for part in value.split(",") if part.strip()]


def type_overrides(value: str) -> dict[str, str]:
    out = {}
    for item in names(value):
        column, colon, kind = item.partition(":")
        if not colon or not column.strip():
            raise ValueError("Write each type as column:type")
        out[column.strip()] = kind.strip().casefold()
    return out


def steps_from_options(options: dict | None = None, **more) -> list[Step]:
    """Steps in their fixed order: infer, missing, validate, normalize, deduplicate."""
    given = {**(options or {}), **more}
    unknown = sorted(set(given) - set(DEFAULTS))
    if unknown:
        raise ValueError(f"Unknown options: {', '.join(unknown)}")
    o = {**DEFAULTS, **given}

    def columns(option: str, what: str, fallback: str = "") -> list[str]:
        found = names(o[option]) or (names(o[fallback]) if fallback else [])
        if not found:
            raise ValueError(f"{what} requires {option}")
        return found

    validations = {
        "required": lambda: Required(columns("required_columns", "Required value validation")),
        "range": lambda: InRange(columns("range_columns", "Range validation"), o["min_value"], o["max_value"]),
        "positive": lambda: Positive(columns("positive_columns", "Positive validation")),
        "allowed": lambda: AllowedValues(
            columns("allowed_columns", "Allowed values validation"), names(o["allowed_values"])
        ),
        "email": lambda: ValidEmail(columns("valid_email_columns", "Email validation")),
        "date": lambda: ParseableDate(
            columns("parseable_date_columns", "Date validation"), names(o["validation_date_format"])
        ),
    }
    shared = "normalize_columns"
    normalizations = {
        "text": lambda: NormalizeText(columns("text_columns", "text normalization", shared), o["text_case"]),
        "email": lambda: NormalizeEmail(columns("email_columns", "email normalization", shared)),
        "date": lambda: NormalizeDate(
            columns("date_columns", "date normalization", shared), names(o["date_input_format"]), o["date_output_format"]
        ),
        "phone": lambda: NormalizePhone(columns("phone_columns", "phone normalization", shared), o["phone_region"]),
    }

    steps: list[Step] = []
    if o["infer_types"]:
        steps.append(InferTypes(names(o["type_columns"]), type_overrides(o["type_overrides"])))
    policy = o["missing_policy"].strip().casefold()
    if policy != "keep":
        steps.append(
            MissingValues(
                columns("missing_columns", f"{policy} missing value policy"), policy,
                None if o["fill_value"] == "" else o["fill_value"],
            )
        )
    for option, builders in (("validate", validations), ("normalize", normalizations)):
        for name in names(o[option]):
            if name not in builders:
                raise ValueError(f"Unsupported {option} operation: {name}")
            steps.append(builders[name]())
    dedup = o["dedup"].strip().casefold()
    if dedup == "exact":
        steps.append(ExactDedup(names(o["dedup_columns"])))
    elif dedup == "fuzzy":
        steps.append(
            FuzzyDedup(columns("dedup_columns", "Fuzzy deduplication"), o["fuzzy_threshold"], o["fuzzy_mode"])
        )
    elif dedup != "none":
        raise ValueError(f"Unsupported deduplication mode: {o['dedup']}")
    return steps


# Parts of a column name that suggest what the column holds.
_NAME_HINTS = {
    "text_columns": ("name", "status", "customer"),
    "email_columns": ("email",),
    "date_columns": ("date", "signup"),
    "missing_columns": ("amount", "name", "email"),
    "dedup_columns": ("name", "email"),
}


def columns_by_name(columns) -> dict[str, list[str]]:
    """Suggested target columns per option, from the column names alone."""
    return {
        option: [c for c in columns if any(hint in c.lower() for hint in hints)]
        for option, hints in _NAME_HINTS.items()
    }
