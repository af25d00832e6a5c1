from .base import Outcome, RowStep, Step
from .exact import ExactDedup
from .fuzzy import FuzzyDedup
from .infer import InferTypes, shape
from .missing import FillBlanks, MissingValues
from .normalize import NormalizeDate, NormalizeEmail, NormalizePhone, NormalizeText
from .validate import AllowedValues, InRange, ParseableDate, Positive, Required, ValidEmail

__all__ = [
    "AllowedValues", "ExactDedup", "FillBlanks", "FuzzyDedup", "InRange", "InferTypes", "MissingValues",
    "NormalizeDate", "NormalizeEmail", "NormalizePhone", "NormalizeText", "Outcome", "ParseableDate",
    "Positive", "Required", "RowStep", "Step", "ValidEmail", "shape",
]
