from .dates import format_date, parse_date
from .similarity import ratio_sorted, token_sort_ratio
from .text import (
    casefold,
    collapse_ws,
    comparable_text,
    exact_key,
    is_blank,
    key_digest,
    render,
    title_case,
    token_sort,
    trim_ws,
)
from .values import is_boolean, is_email, normal_email, normal_phone, parse_number

__all__ = [
    "casefold", "collapse_ws", "comparable_text", "exact_key", "format_date", "is_blank", "is_boolean",
    "is_email", "key_digest", "normal_email", "normal_phone", "parse_date", "parse_number", "ratio_sorted",
    "render", "title_case", "token_sort", "token_sort_ratio", "trim_ws",
]
