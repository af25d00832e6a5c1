"""Text expressions with Unicode-aware whitespace and case rules.

Everything here is a ``Column -> Column`` function built from JVM-side
functions, so a chain of them stays inside one code-generated stage.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The code points that count as whitespace.
_WHITESPACE_POINTS = (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
    *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
WHITESPACE = "".join(map(chr, _WHITESPACE_POINTS))

# The same set as the inside of a regex character class.
WS = r"\s\x0b\x1c-\x1f\x85\p{Z}"

# A run of them; the Unicode flag makes \s cover all but the four separators.
_RUN = r"(?U)[\s\x1c-\x1f]+"

_CASED = r"\p{IsLowercase}\p{IsUppercase}\p{Lt}"


def trim_ws(c: Column) -> Column:
    """Strip every Unicode whitespace character from both ends."""
    return F.trim(c, F.lit(WHITESPACE))


def collapse_ws(c: Column) -> Column:
    """Strip, then turn each inner run of whitespace into one blank."""
    return F.regexp_replace(trim_ws(c), _RUN, " ")


def is_blank(c: Column, dtype: T.DataType = T.StringType()) -> Column:
    """Null, a whitespace-only string, or NaN."""
    if isinstance(dtype, T.StringType):
        return c.isNull() | (trim_ws(c) == "")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


@lru_cache(maxsize=1)
def _fold_rules() -> tuple[str, str, dict[str, str]]:
    """Where case folding differs from lower-casing, derived from Unicode data."""
    single, several = {}, {}
    for code in range(0x80, 0x110000):
        ch = chr(code)
        folded, lowered = ch.casefold(), ch.lower()
        if folded != lowered and len(lowered) == 1:
            (single if len(folded) == 1 else several)[lowered] = folded
    return "".join(single), "".join(single.values()), several


def _ranges(characters: str, gap: int) -> str:
    """A character class over the given characters, closing small gaps."""
    spans: list[list[int]] = []
    for code in sorted(map(ord, characters)):
        if spans and code - spans[-1][1] <= gap:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "[" + "".join(rf"\x{{{low:x}}}-\x{{{high:x}}}" for low, high in spans) + "]"


def casefold(c: Column) -> Column:
    """Full Unicode case folding; most text only needs ``lower``.

    The guards may cover more characters than have a rule: they only decide
    which of three equivalent ways is taken.
    """
    low = F.lower(c)
    one_from, one_to, several = _fold_rules()
    sharp_s = F.replace(low, F.lit("\xdf"), F.lit("ss"))
    rare = "".join(ch for ch in several if ch != "\xdf")
    folded = F.translate(sharp_s, one_from, one_to)
    table = F.str_to_map(F.lit(",".join(f"{k}={v}" for k, v in several.items())), F.lit(","), F.lit("="))
    spelled = F.array_join(F.transform(F.split(folded, ""), lambda ch: F.coalesce(table[ch], ch)), "")
    # most Western text has nothing outside the first class, which is quick to test
    plain = ~low.rlike(r"[^\x00-\xb4\xb6-\x{148}]") | ~low.rlike(_ranges(one_from + rare, 48))
    return (
        F.when(plain, sharp_s)
        .when(~low.rlike(_ranges(rare, 8)), folded)
        .otherwise(spelled)
    )


def title_case(c: Column) -> Column:
    """Capitalise the first letter of every run of cased letters (``O'Neil-X``).

    ``initcap`` only starts words at blanks, so a marked blank is set in front
    of every other run and taken out again.  A NUL in the text is spelled
    differently meanwhile, so the mark cannot be mistaken for text.
    """
    nul, spelled, mark = F.lit("\x00"), F.lit("\x00\x02"), "\x00\x01 "
    marked = F.regexp_replace(F.replace(c, nul, spelled), rf"[^ {_CASED}](?=[{_CASED}])", "$0" + mark)
    general = F.replace(F.replace(F.initcap(marked), F.lit(mark), F.lit("")), spelled, nul)
    return F.when(c.rlike(r"\A[A-Za-z ]*\z"), F.initcap(c)).otherwise(general)


def render(c: Column, dtype: T.DataType) -> Column:
    """Text of a cell the way a scripting user would print it; dates and nested values in SQL's text form."""
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        whole = (c == F.floor(c)) & (F.abs(c) < F.lit(1e16))
        return (
            F.when(F.isnan(c), F.lit("nan"))
            .when(whole, F.concat(c.cast("decimal(38,0)").cast("string"), F.lit(".0")))
            .otherwise(c.cast("string"))
        )
    return c.cast("string")


def exact_key(c: Column, dtype: T.DataType) -> Column:
    """Comparison form of one cell for exact matching; non-text is unchanged."""
    if isinstance(dtype, T.StringType):
        return casefold(collapse_ws(c))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return c + F.lit(0.0)  # -0.0 and 0.0 are one key
    return c


def key_digest(columns: list[tuple[Column, T.DataType]]) -> Column:
    """Null-safe 256-bit digest of several cells.

    Every part carries its length, so no two different keys share an encoding,
    and a key of any width shuffles as 32 bytes.
    """
    parts = []
    for c, dtype in columns:
        text = exact_key(c, dtype).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def comparable_text(columns: list[tuple[Column, T.DataType]]) -> Column:
    """Folded, collapsed text of several cells; falsy cells count as empty."""
    parts = []
    for c, dtype in columns:
        if isinstance(dtype, T.StringType):
            text = casefold(collapse_ws(c))
        elif isinstance(dtype, T.BooleanType):
            text = F.when(c, F.lit("true"))
        elif isinstance(dtype, T.NumericType):
            text = F.when(c != 0, F.lower(render(c, dtype)))
        else:
            text = F.lower(render(c, dtype))
        parts.append(F.coalesce(text, F.lit("")))
    return F.trim(F.concat_ws(" ", *parts))


def token_sort(c: Column) -> Column:
    """Whitespace tokens in code-point order, joined by one blank."""
    tokens = F.filter(F.split(c, rf"[{WS}]+"), lambda t: t != "")
    return F.array_join(F.array_sort(tokens), " ")
