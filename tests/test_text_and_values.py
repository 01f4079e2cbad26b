"""Cell rules against Python's own text, decimal and ISO-8601 behaviour."""

from datetime import date, datetime, time
from decimal import Decimal, InvalidOperation

import pytest

from tidyledger.functions import numbers, temporal, text, values
from tidyledger.functions.celltype import cell_type

DATES = [
    "2024-01-01", "20240101", "2024-W01", "2024-W01-1", "2024W01", "2024W011", "2024-W53-1", "2020-W53-7",
    "2024-W00-1", "2024-W01-8", "2024-01-01T", "2024-01-01T10", "2024-01-01 10:00", "2024-01-01+00:00",
    "2024-01-01Z", "20240101T1000", "2024-W01-1T10:00", "2024-W01T10", "2024W01T10", "2024W011T10",
    "2024-W01-05", "2024-0101", "202401-01", "0000-01-01", "0001-01-01", "2024-02-30", "2023-02-29",
    "2024-01-01T24:00:00", "2024-01-01x10", "2024-01-01é10:00", "2024-01", "2024", "2024-1-1",
    "2024-01-01  10:00", "2024-W01-1 10:00:00+05:30", "2024-06-15T01:02:03Z", "2024-06-15T01:02:03.5Z",
    "2024-06-15T01:02:03,123456789-0730", "2024-06-15 23:59:59.000000", "2024-06-15T235959.25+01",
    "2024-06-15T10:00-00:00", "2024-06-15T10:60", "2024-06-15T10:00+24:00", "2024-06-15T10:00+05:30:15",
    "2024-06-15T10:0000", "2024-06-15T1000:00", "not-a-date", "", "12345", "2024-06-15T", "1999-12-31 00:00:00",
]
TIMES = [
    "10:00:00.", "24:00", "1000", "10", "T10:00", "10:00:00,5", "10:00:00.1234567", "10:00+05", "10:00-0530",
    "10:00+05:30:15", "10:00+24:00", "10:00+23:59", "100000.5", "10:0000", "1000:00", "10:00:60", "10:00Z",
    "10:00z", "t10:00", "10:00-00:00", "9:30", "9:30 AM", "0930", "09", "T09:30", "09 30", "abc", "", "1",
]
NUMBERS = [
    "42.0", "1e3", "+5", "007", "007.50", "3.140", "3.14", "1E-3", "-0", "-0.00", ".5", "12.", "100", "1_000",
    "NaN", "Infinity", "-inf", "12.5e-3", "1.5e2", "0e0", "0.000", "-.5", "+.50", "1e", "e5", "1.2.3", "--1", "",
    "abc", "1,000", "1e+2", "1.e2", "-1e-2", "00", "0.10e1", "5.0E0", "12345678901234567890.1200",
]


def _python_iso(value):
    try:
        return datetime.fromisoformat(value.replace("Z", "+00:00")).isoformat()
    except ValueError:
        return value


def test_dates_match_python(apply_rule):
    assert dict(zip(DATES, apply_rule(temporal.normalize_date, DATES))) == {v: _python_iso(v) for v in DATES}


def test_times_match_python(apply_rule):
    def expected(value):
        for candidate in (value, value.upper().replace(" ", "")):
            try:
                return time.fromisoformat(candidate).isoformat()
            except ValueError:
                continue
        return value

    assert dict(zip(TIMES, apply_rule(temporal.normalize_time, TIMES))) == {v: expected(v) for v in TIMES}


def test_date_output_format(apply_rule):
    fmt = "%m/%d/%Y %H:%M:%S %y %j %I %p %f %B %b %A %a 100%%"
    cells = ["2024-06-15", "2024-01-05T13:04:05.25", "20231231T000000", "2024-02-29 12:00"]
    expected = [datetime.fromisoformat(c).strftime(fmt) for c in cells]
    assert apply_rule(lambda c: temporal.format_date(c, fmt), cells) == expected
    with pytest.raises(ValueError):
        apply_rule(lambda c: temporal.format_date(c, "%Q"), cells)


def _decimal(value):
    try:
        return Decimal(value)
    except InvalidOperation:
        return None


def test_decimals_match_python(apply_rule):
    def expected(value):
        number = _decimal(value)
        if number is None or not number.is_finite():
            return value
        return format(number.normalize(), "f")

    assert dict(zip(NUMBERS, apply_rule(numbers.coerce_decimal, NUMBERS))) == {v: expected(v) for v in NUMBERS}


def test_integers_match_python(apply_rule):
    def expected(value):
        number = _decimal(value)
        if value.lstrip("+-").isdigit() and len(value) - len(value.lstrip("+-")) < 2:
            return value
        if number is not None and number.is_finite() and number == number.to_integral_value():
            return str(int(number))
        return value

    assert dict(zip(NUMBERS, apply_rule(numbers.coerce_integer, NUMBERS))) == {v: expected(v) for v in NUMBERS}


def test_random_decimals_match_python(apply_rule):
    import random

    rng = random.Random(7)
    cells = []
    for _ in range(400):
        digits = "".join(rng.choice("0123456789") for _ in range(rng.randint(1, 9)))
        cut = rng.randint(0, len(digits))
        cell = rng.choice(["", "+", "-"]) + digits[:cut] + rng.choice(["", "."]) + digits[cut:]
        if rng.random() < 0.4:
            cell += rng.choice("eE") + rng.choice(["", "+", "-"]) + str(rng.randint(0, 12))
        cells.append(cell)
    got = apply_rule(numbers.coerce_decimal, cells)
    for cell, result in zip(cells, got):
        number = _decimal(cell)
        assert result == (cell if number is None else format(number.normalize(), "f")), cell


def test_cell_types(apply_rule):
    def expected(value):
        if value == "":
            return "null"
        if value.lower() in {"true", "false", "yes", "no", "y", "n"}:
            return "boolean"
        if value.lstrip("+-").isdigit() and len(value) - len(value.lstrip("+-")) < 2:
            return "integer"
        if _decimal(value) is not None:
            return "decimal"
        if _python_iso(value) != value or _is_canonical_iso(value):
            if "T" in value or " " in value:
                return "datetime"
        try:
            date.fromisoformat(value)
            return "date"
        except ValueError:
            return "string"

    def _is_canonical_iso(value):
        try:
            datetime.fromisoformat(value.replace("Z", "+00:00"))
            return True
        except ValueError:
            return False

    cells = DATES + TIMES + NUMBERS + ["TRUE", "No", "y", "1", "0", "hello world", "n/a", "1_000.5", "sNaN12"]
    assert dict(zip(cells, apply_rule(cell_type, cells))) == {v: expected(v) for v in cells}


def test_squeeze_matches_python(apply_rule):
    cells = ["  a  b ", "\tx\ny\r", "\u00a0p\u2003q\u00a0", "\x1cr\x1fs", "plain", "", "   ", "\u3000k"]
    assert apply_rule(text.squeeze, cells) == [" ".join(c.split()) for c in cells]
    assert apply_rule(text.strip, cells) == [c.strip() for c in cells]


def test_title_case(apply_rule):
    cells = ["don't o'BRIEN", "mcDONALD-smith jr.", "ÉLAN vital", "a b", ""]
    expected = [" ".join(w[:1].upper() + w[1:].lower() for w in c.split(" ")) for c in cells]
    assert apply_rule(text.title_case, cells) == expected


def test_slugs(apply_rule):
    assert apply_rule(text.slugify, ["  Acme, Inc. ", "--A  B--", "Ünï x", "a--b"]) == ["acme-inc", "a-b", "n-x", "a-b"]
    assert apply_rule(text.is_valid_slug, ["acme-inc", "a--b", "-a", "a-", "A", "", "a"]) == [
        True, False, False, False, False, False, True,
    ]


def test_blank_and_boolean(apply_rule):
    assert apply_rule(values.blank, ["NULL", "n/a", "NA", "-", "None", "x", "--", ""]) == [""] * 5 + ["x", "--", ""]
    cells = ["YES", "y", "1", "True", "No", "0", "maybe", "true", ""]
    assert apply_rule(values.boolean, cells) == ["true"] * 4 + ["false", "false", "maybe", "true", ""]
    assert apply_rule(lambda c: values.boolean(c, ("Yes", "No")), ["y", "0", "Yes"]) == ["Yes", "No", "Yes"]


NUMERIC = [
    ("1,234.56", None, "1234.56"), ("1.234,56", None, "1234.56"), ("1,234", None, "1234"),
    ("1,23", None, "1,23"), ("1,23", "eu", "1.23"), ("1.234", None, "1.234"), ("1.234", "eu", "1234"),
    ("1.2345", "eu", "1.2345"), ("42", None, "42"), ("", None, ""), ("-1,234,567", None, "-1234567"),
    ("1,2345", None, "1,2345"), ("1,2345", "eu", "1,2345"), ("12.345.678,9", "us", "12345678.9"),
]


@pytest.mark.parametrize("locale", [None, "eu", "us"])
def test_numeric(apply_rule, locale):
    cases = [(v, out) for v, where, out in NUMERIC if where == locale]
    assert apply_rule(lambda c: values.numeric(c, locale), [v for v, _ in cases]) == [o for _, o in cases]


def test_currency(apply_rule):
    cells = ["€1.234,56", "£ 20", "¥1,000", "$5.00", "5.00", "20 EUR", ""]
    assert apply_rule(values.currency, cells) == ["1234.56 EUR", "20 GBP", "1000 JPY", "$5.00", "5.00", "20 EUR", ""]
    assert apply_rule(lambda c: values.currency(c, "USD"), ["$1,234.5", "€3", ""]) == ["1234.5 USD", "3 EUR", ""]


def test_row_keys_keep_cells_apart(spark):
    rows = [("a", "bc"), ("ab", "c"), ("a", "bc"), ("1:a", ""), ("", "1:a")]
    frame = spark.createDataFrame(rows, "c0 string, c1 string")
    assert frame.select(text.row_key(["c0", "c1"]).alias("k")).distinct().count() == 4


