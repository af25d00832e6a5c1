"""Auditable data cleaning on Spark."""

from .operators import (
    AllowedValues, ExactDedup, FillBlanks, FuzzyDedup, InRange, InferTypes, MissingValues, NormalizeDate,
    NormalizeEmail, NormalizePhone, NormalizeText, Outcome, ParseableDate, Positive, Required, RowStep, Step,
    ValidEmail, shape,
)
from .plans.cleaning import Cleaner, CleanRun, clean
from .plans.options import columns_by_name, steps_from_options
from .sources.reports import manifest, read_report, report_lines, write_report
from .sources.scratch import drop_scratch
from .sources.tables import convert, read_table, write_table

__all__ = [
    "AllowedValues", "CleanRun", "Cleaner", "ExactDedup", "FillBlanks", "FuzzyDedup", "InRange", "InferTypes",
    "MissingValues", "NormalizeDate", "NormalizeEmail", "NormalizePhone", "NormalizeText", "Outcome",
    "ParseableDate", "Positive", "Required", "RowStep", "Step", "ValidEmail", "clean", "columns_by_name", "convert",
    "drop_scratch",    "manifest", "read_report", "read_table", "report_lines", "shape", "steps_from_options", "write_report",
    "write_table",
]
