"""String, number, date and phone rules against plain Python on awkward values."""

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import (
    casefold, collapse_ws, exact_key, format_date, is_blank, is_boolean, is_email, normal_email, normal_phone,
    parse_date, parse_number, render, title_case, token_sort, trim_ws,
)

ODD = [
    "", " ", " ", "\x1c\x1d", "\x85 a　b \t c\n", "o'neil-x", "McDONALD 3rd", "straße ẞ", "ΌΔΟΣ ς ΣΑΣ",
    "Иван  ПЕТРОВ", "ﬁne ŉ ǰ", "ſhort µ", "日本 語a", "emoji 😀x", "a  b", "x\x00 y", "İstanbul", "ꭰᏸ",
    "é-É.été", "tab\tend\t", "A", "zß", "__init__ x2y",
]


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def results(spark, values, *exprs):
    rows = column(spark, values).select("i", *[e.alias(f"c{n}") for n, e in enumerate(exprs)]).collect()
    return [tuple(r)[1:] for r in sorted(rows)]


def random_strings(n):
    rng = random.Random(3)
    pool = "aBß \t ÉςΣ'-9.Ꮳﬁ日😀\x1f"
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_strings_match_python(spark):
    values = ODD + random_strings(300)
    c = F.col("v")
    got = results(spark, values, trim_ws(c), collapse_ws(c), casefold(c), is_blank(c), token_sort(c))
    for value, (trimmed, collapsed, folded, blank, tokens) in zip(values, got):
        assert trimmed == value.strip(), repr(value)
        assert collapsed == " ".join(value.split()), repr(value)
        assert folded == value.casefold(), repr(value)
        assert blank == (not value.strip())
        assert tokens == " ".join(sorted(value.split()))


def test_title_matches_python(spark):
    # left out: ligatures, and a sigma with only punctuation before the next letter
    values = [v for v in ODD + random_strings(200) if "ﬁ" not in v and "Σ" not in v and "ς" not in v]
    for value, (titled,) in zip(values, results(spark, values, title_case(F.col("v")))):
        assert titled == value.title(), repr(value)


def test_numbers(spark):
    values = [
        "5", " 5 ", ".5", "5.", "1e3", "-1E-2", "1_000", "1__0", "_1", "1_", "1d", "1f", "0x1p3", "inf", "-Infinity", "NaN",
        "-nan", "+.5e+1_0", "", "  ", "abc", "1 2", "true", "٣x", "1e400",
    ]

    def expected(text):
        try:
            return float(text.strip())
        except ValueError:
            return None

    for value, (number,) in zip(values, results(spark, values, parse_number(F.col("v")))):
        assert str(number) == str(expected(value)), value


def test_booleans(spark):
    values = ["true", " FALSE ", "yes", "No", "1", "0", "2", "", "t", None]
    got = [r[0] for r in results(spark, values, is_boolean(F.col("v")))]
    assert got == [True] * 6 + [False] * 4
    assert not column(spark, [1], "int").select(is_boolean(F.col("v"), T.IntegerType())).first()[0]
    assert column(spark, [False], "boolean").select(is_boolean(F.col("v"), T.BooleanType())).first()[0]


DATES = [
    "2026-01-02", "1/2/2026", "01/02/2026", "02/30/2026", "29/02/2024", "2026-1-2", " 2026-01-02", "2026-01-02 ",
    "02/03/26", "02/03/12026", "12/31/1999", "Jan 5 2024", "january 5 2024", "5 MAR 69", "5 mar 68", "29 feb 72",
    "20260102", "2026-01-02 03:04:05", "2026-01-02 24:00:00", "2026-01-02 3:4:60", "", "x", "2023-02-29", "13/13/2020",
]
FORMATS = ["%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%b %d %Y", "%B %d %Y", "%d %b %y", "%Y%m%d", "%Y-%m-%d %H:%M:%S", "%m/%d/%y"]


@pytest.mark.parametrize("fmt", FORMATS)
def test_dates_match_strptime(spark, fmt):
    got = results(spark, DATES, format_date(parse_date(F.col("v"), (fmt,)), "%Y-%m-%d %H:%M:%S"))
    for value, (text,) in zip(DATES, got):
        try:
            expected = datetime.strptime(value, fmt).strftime("%Y-%m-%d %H:%M:%S")
        except ValueError:
            expected = None
        assert text == expected, (value, fmt)


def test_first_format_wins_and_output_formats(spark):
    formats = ("%d/%m/%Y", "%m/%d/%Y")
    values = ["01/02/2026", "12/25/2026"]
    got = results(spark, values, format_date(parse_date(F.col("v"), formats), "%d %B '%y, %b%%"))
    assert [g[0] for g in got] == ["01 February '26, Feb%", "25 December '26, Dec%"]
    with pytest.raises(ValueError):
        parse_date(F.col("v"), ("%j",))


def test_emails(spark):
    values = ["a@b.c", " A@B.Co ", "a@b", "a b@c.d", "@b.c", "a@b.c.", "a@@b.c", "a@b.c d", "ü@ö.de"]
    got = results(spark, values, normal_email(F.col("v")), is_email(normal_email(F.col("v"))))
    shape = r"[^@\s]+@[^@\s]+\.[^@\s]+"
    assert [g[1] for g in got] == [re.fullmatch(shape, v.strip().lower()) is not None for v in values]
    assert got[1][0] == "a@b.co"


@pytest.mark.parametrize(
    "region,value,expected",
    [
        ("US", "(415) 555-2671", "+14155552671"), ("US", "+1 415 555 2671", "+14155552671"),
        ("US", "1-212-555-0199", "+12125550199"), ("US", "123", None), ("US", "abc", None),
        ("US", "415-555-2671 x22", "+14155552671"), ("US", "115-555-2671", None), ("US", "+44 20 7946 0958", "+442079460958"),
        ("US", "011 44 20 7946 0958", "+442079460958"), ("GB", "020 7946 0958", "+442079460958"),
        ("GB", "+44 (0)20 7946 0958", "+442079460958"), ("DE", "030 123456", "+4930123456"), ("IT", "06 1234 5678", "+390612345678"),
        ("FR", "01 23 45 67 89", "+33123456789"), ("US", "+999 12345", None), ("RU", "8 (912) 345-67-89", "+79123456789"),
        ("US", "+66 2 123 4567", "+6621234567"), ("US", "011 234 803 123 4567", "+2348031234567"), ("US", "+20 12", None),
        ("US", "+62 1234567890123456", None), ("+66", "02 123 4567", "+6621234567"), ("+234", "0803 123 4567", "+2348031234567"),
        ("US", "415.555.2671", "+14155552671"), ("US", "call 4155552671", None),
    ],
)
def test_phones(spark, region, value, expected):
    assert results(spark, [value], normal_phone(F.col("v"), region)) == [(expected,)]


def test_unknown_region():
    with pytest.raises(ValueError):
        normal_phone(F.col("v"), "XX")


def test_rendered_numbers(spark):
    frame = column(spark, [1.0, 1e7, -0.5, 1e15, None], "double")
    got = [r[0] for r in frame.orderBy("i").select(render(F.col("v"), T.DoubleType())).collect()]
    assert got == ["1.0", "10000000.0", "-0.5", "1000000000000000.0", None]


def test_exact_keys_keep_types(spark):
    assert column(spark, [-0.0], "double").select(exact_key(F.col("v"), T.DoubleType()).cast("string")).first()[0] == "0.0"


def test_common_length_of_many_pairs(spark):
    """All lengths around the word of 64 characters, against the textbook table."""
    import random

    from tidemark.functions.similarity import common_length, common_lengths

    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], max(row[j], row[j - 1], last + (x == y))
        return row[-1]

    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abé😀 ￿\x00") for _ in range(n))
    pairs = [(text(rng.choice([0, 1, 5, 30, 63, 64, 65, 90])), text(rng.choice([0, 1, 9, 40, 64, 66, 130]))) for _ in range(200)]
    pairs += [("x" * 64, "x" * 64), ("ab" * 40, "ba" * 300), ("q", "p" * 600 + "q"), (None, "a"), ("a", None)]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").coalesce(1)
    got = dict(frame.select("i", common_length("a", "b")).collect())
    assert got == {i: None if a is None or b is None else table(a, b) for i, (a, b) in enumerate(pairs)}
    some = [p for p in pairs if None not in p and len(p[0]) < 100 and len(p[1]) < 200][:40]
    left, right = [a for a, _ in some], [b for _, b in some]
    assert common_lengths(left, right).tolist() == [[table(a, b) for b in right] for a in left]
