"""Dates by ``strptime``/``strftime`` format codes, without leaving the JVM.

Each input format becomes one anchored pattern.  A single ``regexp_replace``
rewrites a matching cell into ISO order (and anything else into text that no
cast accepts), after which ``try_cast`` does the calendar check.  A cell that
does not fit costs one pattern test instead of a parse exception.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# English month names.
_MONTHS = (
    "January February March April May June July August September October November December"
).split()

# What each input code accepts.
_ACCEPTS = {
    "Y": r"[0-9]{4}",
    "y": r"[0-9]{2}",
    "m": r"1[0-2]|0[1-9]|[1-9]",
    "d": r"3[01]|[12][0-9]|0[1-9]|[1-9]| [1-9]",
    "H": r"2[0-3]|[01][0-9]|[0-9]",
    "M": r"[0-5][0-9]|[0-9]",
    "S": r"6[01]|[0-5][0-9]|[0-9]",
    "b": "(?i:" + "|".join(name[:3] for name in _MONTHS) + ")",
    "B": "(?i:" + "|".join(_MONTHS) + ")",
}
def _codes(fmt: str):
    """Yield ('code', letter) and ('text', characters) pieces of a format."""
    for piece in re.findall(r"%.|%|[^%]+", fmt, flags=re.S):
        if piece == "%%":
            yield "text", "%"
        elif piece.startswith("%"):
            if piece[1:] not in _ACCEPTS:
                raise ValueError(f"Unsupported date format code {piece!r} in {fmt!r}")
            yield "code", piece[1:]
        else:
            yield "text", piece


def _quote(text: str) -> str:
    out = []
    for chunk in re.findall(r"\s+|\S", text):
        out.append(r"\s+" if chunk.isspace() else re.escape(chunk))
    return "".join(out)


def _parse_one(c: Column, fmt: str) -> Column:
    pattern, group = [], {}
    for kind, value in _codes(fmt):
        if kind == "text":
            pattern.append(_quote(value))
            continue
        if value in group:
            raise ValueError(f"Date format {fmt!r} repeats %{value}")
        group[value] = len(group) + 1
        pattern.append(f"({_ACCEPTS[value]})")
    if {"Y", "y"} <= set(group) or len({"m", "b", "B"} & set(group)) > 1:
        raise ValueError(f"Date format {fmt!r} names one field twice")

    def part(letters: str, default: str) -> str:
        return next((f"${group[letter]}" for letter in letters if letter in group), default)

    month = part("mbB", "1")
    layout = f"{part('Y', '20' + part('y', '') if 'y' in group else '1900')}-{month}-{part('d', '1')}"
    timed = bool({"H", "M", "S"} & set(group))
    if timed:
        layout += f" {part('H', '0')}:{part('M', '0')}:{part('S', '0')}"
    iso = F.regexp_replace(c, rf"\A{''.join(pattern)}\z|\A[\s\S]*\z", layout)
    if "d" in group:
        iso = F.replace(iso, F.lit("- "), F.lit("-"))  # a blank-padded day
    for number, name in enumerate(_MONTHS, start=1):
        if {"b", "B"} & set(group):
            iso = F.regexp_replace(iso, rf"(?i)-{name if 'B' in group else name[:3]}-", f"-{number}-")
    moment = iso.try_cast("timestamp_ntz")
    if "y" in group:  # two-digit years 69..99 are in the 1900s
        moment = F.when(F.year(moment) >= 2069, moment - F.expr("interval 100 year")).otherwise(moment)
    return moment


def parse_date(c: Column, formats: tuple[str, ...]) -> Column:
    """TIMESTAMP_NTZ by the first format that fits, else null."""
    return F.coalesce(*[_parse_one(c, fmt) for fmt in formats])


def _padded(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def format_date(moment: Column, fmt: str) -> Column:
    """Text of a TIMESTAMP_NTZ, independent of the session time zone."""
    day = moment.cast("date")
    prints = {
        "Y": lambda: F.year(moment).cast("string"),
        "y": lambda: _padded(F.pmod(F.year(moment), F.lit(100))),
        "m": lambda: _padded(F.month(moment)),
        "d": lambda: _padded(F.day(moment)),
        "H": lambda: _padded(F.hour(moment)),
        "M": lambda: _padded(F.minute(moment)),
        "S": lambda: _padded(F.second(moment)),
        "b": lambda: F.date_format(day, "MMM"),
        "B": lambda: F.date_format(day, "MMMM"),
    }
    return F.concat(*[prints[value]() if kind == "code" else F.lit(value) for kind, value in _codes(fmt)])
