"""Number, boolean, email and phone expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import WS, trim_ws

_DIGITS = r"[0-9]+(?:_[0-9]+)*"
_DECIMAL = rf"\A[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?\z"
_SPECIAL = r"(?i)\A[+-]?(?:inf|infinity|nan)\z"

EMAIL_PATTERN = rf"\A[^@{WS}]+@[^@{WS}]+\.[^@{WS}]+\z"

# Strings that read as booleans.
BOOLEAN_WORDS = ("true", "false", "yes", "no", "1", "0")


def parse_number(c: Column, dtype: T.DataType = T.StringType()) -> Column:
    """DOUBLE value of a cell, null where it is not a number.

    Text is guarded by a pattern first: the engine's own cast also takes type
    suffixes and hexadecimal floats and refuses digit separators.
    """
    if isinstance(dtype, T.NumericType):
        return c.cast("double")
    if not isinstance(dtype, T.StringType):
        return F.lit(None).cast("double")
    text = trim_ws(c)
    word = F.lower(text)
    special = (
        F.when(word.endswith("nan"), F.lit(float("nan")))
        .when(word.startswith("-"), F.lit(float("-inf")))
        .otherwise(F.lit(float("inf")))
    )
    return F.when(text.rlike(_DECIMAL), F.replace(text, F.lit("_"), F.lit("")).try_cast("double")).when(
        text.rlike(_SPECIAL), special
    )


def is_boolean(c: Column, dtype: T.DataType = T.StringType()) -> Column:
    """Boolean columns, or text spelling one; the numbers 1 and 0 do not count."""
    if isinstance(dtype, T.BooleanType):
        return c.isNotNull()
    if isinstance(dtype, T.StringType):
        # the long s is the only other letter that folds into one of these words
        return F.coalesce(F.translate(F.lower(trim_ws(c)), "\u017f", "s").isin(*BOOLEAN_WORDS), F.lit(False))
    return F.lit(False)


def normal_email(c: Column) -> Column:
    return F.lower(trim_ws(c))


def is_email(c: Column) -> Column:
    """``c`` must already be trimmed and lower-cased."""
    return c.rlike(EMAIL_PATTERN)


# Fixed values of public numbering plans:
# region -> (country code, trunk prefix, pattern of the national number).
PHONE_REGIONS = {
    "AE": ("971", "0", "[2-9][0-9]{7,8}"),
    "AR": ("54", "0", "[1-9][0-9]{9,10}"),
    "AT": ("43", "0", "[1-9][0-9]{3,12}"),
    "AU": ("61", "0", "[2-478][0-9]{8}"),
    "BE": ("32", "0", "[1-9][0-9]{7,8}"),
    "BR": ("55", "0", "[1-9]{2}(?:9[0-9]{8}|[2-5][0-9]{7})"),
    "CA": ("1", "1", "[2-9][0-9]{2}[2-9][0-9]{6}"),
    "CH": ("41", "0", "[2-9][0-9]{8}"),
    "CN": ("86", "0", "1[3-9][0-9]{9}|[2-9][0-9]{8,10}|10[0-9]{8}"),
    "CZ": ("420", "", "[2-79][0-9]{8}"),
    "DE": ("49", "0", "[1-9][0-9]{5,11}"),
    "DK": ("45", "", "[2-9][0-9]{7}"),
    "ES": ("34", "", "[5-9][0-9]{8}"),
    "FI": ("358", "0", "[1-9][0-9]{4,10}"),
    "FR": ("33", "0", "[1-9][0-9]{8}"),
    "GB": ("44", "0", "[1-357-9][0-9]{8,9}"),
    "GR": ("30", "", "[26-9][0-9]{9}"),
    "HK": ("852", "", "[235-9][0-9]{7}"),
    "IE": ("353", "0", "[1-9][0-9]{6,8}"),
    "IL": ("972", "0", "[2-57-9][0-9]{7,8}"),
    "IN": ("91", "0", "[6-9][0-9]{9}|[1-5][0-9]{9}"),
    "IT": ("39", "", "0[0-9]{5,10}|3[0-9]{8,9}"),
    "JP": ("81", "0", "[1-9][0-9]{8,9}"),
    "KR": ("82", "0", "[1-9][0-9]{7,9}"),
    "KZ": ("7", "8", "[3-9][0-9]{9}"),
    "MX": ("52", "01", "[2-9][0-9]{9}"),
    "NL": ("31", "0", "[1-9][0-9]{8}"),
    "NO": ("47", "", "[2-9][0-9]{7}"),
    "NZ": ("64", "0", "[2-9][0-9]{7,9}"),
    "PL": ("48", "", "[1-9][0-9]{8}"),
    "PT": ("351", "", "[2-9][0-9]{8}"),
    "RU": ("7", "8", "[3-9][0-9]{9}"),
    "SE": ("46", "0", "[1-9][0-9]{6,8}"),
    "SG": ("65", "", "[3689][0-9]{7}"),
    "TR": ("90", "0", "[2-58][0-9]{9}"),
    "UA": ("380", "0", "[3-9][0-9]{8}"),
    "US": ("1", "1", "[2-9][0-9]{2}[2-9][0-9]{6}"),
    "ZA": ("27", "0", "[1-8][0-9]{8}"),
}

# The country codes in use beside those above, of two and of three digits.
_TWO_DIGIT_CODES = "20|36|40|51|53|5[6-8]|60|62|63|66|84|9[2-5]|98"
_THREE_DIGIT_CODES = (
    "21[12368]|22[0-9]|23[0-9]|24[0-9]|25[0-8]|26[0-9]|29[01789]|35[0-9]|37[0-8]|38[0-35-79]|42[013]|50[0-9]|59[0-9]|"
    "67[02-9]|68[0-35-9]|69[0-2]|80[08]|85[02-6]|87[08]|88[0268]|96[0-8]|97[0-79]|99[2-68]"
)
# A number of one of these: five digits at least, and fifteen with the code at most.
_OTHER_PLANS = f"(?:{_TWO_DIGIT_CODES})[0-9]{{5,13}}|(?:{_THREE_DIGIT_CODES})[0-9]{{5,12}}"

# How numbers are dialled abroad from the regions above.
_EXIT_CODES = {"US": "011", "CA": "011", "AU": "0011", "JP": "010", "BR": "00", "SG": "0[0-3][0-9]", "RU": "810", "KZ": "810"}
_EXTENSION = r"(?i)[ \t]*(?:;ext=|ext(?:ension|n)?\.?|x|#)[ \t]*[0-9]{1,7}\z"
_VIABLE = r"\A[+\x{ff0b}]?[0-9(\[][0-9 ()\[\].\-/\x{a0}\x{2010}-\x{2015}\x{2212}~]*\z"


def phone_parts(c: Column) -> Column:
    """A trimmed phone number without extension, and its digits."""
    bare = F.regexp_replace(c, _EXTENSION, "")
    return F.struct(bare.alias("bare"), F.regexp_replace(bare, "[^0-9]", "").alias("digits"))


def normal_phone(c: Column, default_region: str) -> Column:
    """E.164 text of a trimmed phone number, null where it is not valid.

    Validity is structural: the pattern of the number's own plan must match.  For
    countries without a pattern in the table it is a known country code and a
    number of possible length.  ``default_region`` is a region of the table, or a
    country code such as ``+66``.
    """
    return phone_of_parts(phone_parts(c), default_region)


def phone_of_parts(parts: Column, default_region: str) -> Column:
    """The same from ``phone_parts``, for callers that compute those once."""
    region = default_region.strip().upper()
    if region in PHONE_REGIONS:
        code, trunk, pattern = PHONE_REGIONS[region]
    elif re.fullmatch(rf"\+(?:{_OTHER_PLANS})", f"{region}00000"):
        code, trunk, pattern = region[1:], "0", rf"[1-9][0-9]{{4,{14 - len(region[1:])}}}"
    else:
        raise ValueError(f"{default_region!r} is neither a region of the phone table nor a country code without one")

    bare, digits = parts["bare"], parts["digits"]
    abroad = F.regexp_replace(digits, rf"\A{_EXIT_CODES.get(region, '00')}", "")
    has_plus = bare.rlike(r"\A[+\x{ff0b}]")

    plans = sorted({(cc, prefix, shape) for cc, prefix, shape in PHONE_REGIONS.values()})
    shapes: dict[str, list[str]] = {}
    for cc, prefix, shape in plans:
        # a trunk prefix written after the country code is dropped: +44 (0)20 ...
        shapes.setdefault(cc, []).append(f"(?:{prefix})?(?:{shape})" if prefix == "0" else f"(?:{shape})")
    full = r"\A(?:" + "|".join(f"{cc}(?:{'|'.join(found)})" for cc, found in shapes.items()) + r")\z"
    covered = "|".join(sorted(shapes))
    other = rf"\A(?!(?:{covered}))(?:{_OTHER_PLANS})\z"
    zero_trunk = "|".join(sorted({cc for cc, prefix, _ in plans if prefix == "0"}))

    def world(text: Column) -> Column:
        return F.when(
            text.rlike(full),
            F.concat(F.lit("+"), F.regexp_replace(text, rf"\A({zero_trunk})0", "$1")),
        ).when(text.rlike(other), F.concat(F.lit("+"), text))

    stripped = F.regexp_replace(digits, rf"\A{trunk}", "") if trunk else digits
    whole = rf"\A(?:{pattern})\z"
    national = (
        F.when(stripped.rlike(whole), F.concat(F.lit("+" + code), stripped))
        .when(digits.rlike(whole), F.concat(F.lit("+" + code), digits))
        .when(digits.rlike(rf"\A{code}(?:{pattern})\z"), F.concat(F.lit("+"), digits))
    )
    result = F.when(has_plus, world(digits)).otherwise(
        F.coalesce(national, F.when(abroad != digits, world(abroad)))
    )
    return F.when(bare.rlike(_VIABLE), result)
