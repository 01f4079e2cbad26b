"""ISO-8601 dates, date-times and times of day, read and written as text.

The accepted grammar is fixed by the results to match: extended, basic and week dates, any single
character between date and time, times down to the hour, fractions cut to microseconds, offsets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_H, _M = r"([01]\d|2[0-3])", r"[0-5]\d"
_CLOCK = rf"({_H}(:{_M}(:{_M}([.,]\d+)?)?)?|{_H}({_M}({_M}([.,]\d+)?)?)?)"
_TIME = rf"^{_CLOCK}([+-]{_CLOCK})?$"
_TIME_PARTS = (
    r"^(\d\d):?(\d\d)?:?(\d\d)?(?:[.,](\d{1,6})\d*)?"
    r"(?:([+-]\d\d):?(\d\d)?:?(\d\d)?(?:[.,]\d+)?)?$"
)
_DAY = r"(?:\d{4}-\d\d-\d\d|\d{8}|\d{4}-W\d\d-\d(?!\d)|\d{4}-W\d\d|\d{4}W\d{3}(?!\d)|\d{4}W\d\d)"
_WEEK = r"^(\d{4})(?:-W(\d\d)(?:-(\d)(?!\d))?|W(\d\d)(?:(\d)(?!\d))?)[\s\S]*$"
_DATE_ONLY = r"^\d{4}(-\d\d-\d\d|-W\d\d(-\d)?|W\d\d\d?|\d{4})$"
_SIMPLE_DATE = r"^\d{4}-\d{2}-\d{2}$"
_SIMPLE_STAMP = rf"^\d{{4}}-\d{{2}}-\d{{2}}[T ]{_H}:{_M}:{_M}$"


def _rewrite(text: Column, *rewrites: tuple[str, str]) -> Column:
    for pattern, replacement in rewrites:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def iso_clock(text: Column) -> Column:
    """``HH:MM:SS[.ffffff][+HH:MM[:SS]]`` of a time text, null when it is none."""
    clock = F.rpad(_rewrite(text, (_TIME_PARTS, "$1$2$3")), 6, "0")
    fraction = F.rpad(_rewrite(text, (_TIME_PARTS, "$4")), 6, "0")
    zone = _rewrite(
        text,
        (_TIME_PARTS, "$5$6$7"),
        (r"^(.{3})$", "$1:00"),
        (r"^(.{3})(\d\d)(00)?$", "$1:$2"),
        (r"^(.{3})(\d\d)(\d\d)$", "$1:$2:$3"),
        (r"^-00:00$", "+00:00"),
    )
    whole = F.concat(
        _rewrite(clock, ("^(..)(..)", "$1:$2:")),
        _rewrite(F.concat(F.lit("."), fraction), (r"^\.000000$", "")),
        zone,
    )
    return F.when(text.rlike(_TIME), whole)


def _calendar_day(value: Column) -> Column:
    """Day a calendar date starts with, as a date; null when there is no such day."""
    return _rewrite(value, (r"^(\d{4})-?(\d\d)-?(\d\d)[\s\S]*$", "$1-$2-$3")).try_cast("date")


def _week_day(value: Column) -> Column:
    """Day a week date starts with, as a date; null when there is no such week."""
    year = F.substring(value, 1, 4)
    week = _rewrite(value, (_WEEK, "$2$4")).try_cast("int")
    day = F.coalesce(_rewrite(value, (_WEEK, "$3$5")).try_cast("int"), F.lit(1))
    last_week = F.weekofyear(F.concat(year, F.lit("-12-28")).try_cast("date"))
    monday = F.to_date(F.date_trunc("week", F.concat(year, F.lit("-01-04")).try_cast("date")))
    known = week.between(1, last_week) & day.between(1, 7)
    return F.when(known, F.date_add(monday, week * 7 + day - 8))


def iso_datetime(value: Column) -> Column:
    """ISO date-time text of a date or date-time cell (a bare day becomes midnight), else null.

    The common shapes are settled by one pattern test each; only unusual ones take the general path.
    """
    text = F.replace(value, F.lit("Z"), F.lit("+00:00"))
    clock = iso_clock(_rewrite(text, (rf"^({_DAY})$", "$1 00"), (rf"^{_DAY}[\s\S]", "")))
    day = F.when(F.contains(F.substring(value, 5, 2), F.lit("W")), _week_day(value)).otherwise(_calendar_day(value))
    simple = F.substring(value, 1, 10).try_cast("date").isNotNull()
    return (
        F.when(~value.rlike(rf"^(?!0000){_DAY}"), F.lit(None).cast("string"))
        .when(value.rlike(_SIMPLE_DATE), F.when(simple, F.concat(value, F.lit("T00:00:00"))))
        .when(value.rlike(_SIMPLE_STAMP), F.when(simple, F.replace(value, F.lit(" "), F.lit("T"))))
        .otherwise(F.concat(day.cast("string"), F.lit("T"), clock))
    )


def temporal_label(value: Column) -> Column:
    """``date`` for a bare day, ``datetime`` for a date-time showing a ``T`` or a blank, else ``string``."""
    marked = F.contains(value, F.lit("T")) | F.contains(value, F.lit(" "))
    shown = F.when(marked, F.lit("datetime")).when(value.rlike(_DATE_ONLY), F.lit("date")).otherwise(F.lit("string"))
    return F.when(iso_datetime(value).isNotNull(), shown).otherwise(F.lit("string"))


def normalize_date(value: Column) -> Column:
    return F.coalesce(iso_datetime(value), value)


def _directive(letter: str, iso: Column) -> Column:
    """One output directive, read off the fixed positions of the ISO text or its calendar day."""
    day = F.substring(iso, 1, 10).try_cast("date")
    hour = F.substring(iso, 12, 2)
    hour12 = F.pmod(hour.try_cast("int") + 11, F.lit(12)) + 1
    micros = F.regexp_extract(iso, r"\.(\d{6})", 1)
    table = {
        "Y": lambda: F.substring(iso, 1, 4),
        "y": lambda: F.substring(iso, 3, 2),
        "m": lambda: F.substring(iso, 6, 2),
        "d": lambda: F.substring(iso, 9, 2),
        "H": lambda: hour,
        "M": lambda: F.substring(iso, 15, 2),
        "S": lambda: F.substring(iso, 18, 2),
        "I": lambda: F.lpad(hour12.cast("string"), 2, "0"),
        "p": lambda: F.when(hour < "12", F.lit("AM")).otherwise(F.lit("PM")),
        "f": lambda: F.when(micros == "", F.lit("000000")).otherwise(micros),
        "j": lambda: F.lpad(F.dayofyear(day).cast("string"), 3, "0"),
        "B": lambda: F.date_format(day, "MMMM"),
        "b": lambda: F.date_format(day, "MMM"),
        "A": lambda: F.date_format(day, "EEEE"),
        "a": lambda: F.date_format(day, "EEE"),
        "%": lambda: F.lit("%"),
    }
    if letter not in table:
        raise ValueError(f"unsupported date directive %{letter}")
    return table[letter]()


def format_date(value: Column, output_format: str | None) -> Column:
    """Standard form of a date cell: ISO date-time, or the given ``%``-style output format."""
    iso = iso_datetime(value)
    if not output_format:
        return F.coalesce(iso, value)
    parts: list[Column] = []
    position = 0
    while position < len(output_format):
        if output_format[position] == "%" and position + 1 < len(output_format):
            parts.append(_directive(output_format[position + 1], iso))
            position += 2
        else:
            parts.append(F.lit(output_format[position]))
            position += 1
    rendered = reduce(lambda left, right: F.concat(left, right), parts)
    return F.coalesce(F.when(iso.isNotNull(), rendered), value)


def normalize_time(value: Column) -> Column:
    """24-hour ISO time; a cell that is no ISO time stays untouched."""
    compact = F.replace(F.upper(value), F.lit(" "), F.lit(""))
    compact = F.regexp_replace(F.regexp_replace(compact, "^T", ""), "Z$", "+00:00")
    return F.coalesce(F.when(value.rlike(r"^[Tt]? ?\d"), iso_clock(compact)), value)
