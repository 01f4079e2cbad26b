"""Boolean, numeric-separator and currency expressions over squeezed cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidyledger.functions import lookups

# Words accepted as true and false, and the cells that stand for "missing".
TRUE_WORDS = ("true", "yes", "y", "1")
FALSE_WORDS = ("false", "no", "n", "0")
BLANK_WORDS = ("null", "n/a", "na", "-", "none")


def blank(value: Column) -> Column:
    return F.when(F.lower(value).isin(*BLANK_WORDS), F.lit("")).otherwise(value)


def boolean(value: Column, output: tuple[str, str] | None = None) -> Column:
    yes, no = output or ("true", "false")
    word = F.lower(value)
    return F.when(word.isin(*TRUE_WORDS), F.lit(yes)).when(word.isin(*FALSE_WORDS), F.lit(no)).otherwise(value)


def numeric(value: Column, locale: str | None = None) -> Column:
    """Digits with ``.`` as decimal point, where the separators leave no doubt; otherwise untouched."""
    comma, dot = F.contains(value, F.lit(",")), F.contains(value, F.lit("."))
    no_comma = F.translate(value, ",", "")
    dot_last = F.instr(F.reverse(value), ".") < F.instr(F.reverse(value), ",")
    swapped = F.translate(F.translate(value, ".", ""), ",", ".")
    both = F.when(dot_last, no_comma).otherwise(swapped)

    only_comma = F.when(value.rlike(r"^-?\d{1,3}(,\d{3})+$"), no_comma)
    only_dot = value
    if locale == "eu":
        only_comma = only_comma.when(value.rlike(r"^-?\d+,\d{1,2}$"), F.translate(value, ",", "."))
        grouped = value.rlike(r"^-?\d{1,3}(\.\d{3})+$")
        only_dot = F.when(grouped, F.translate(value, ".", "")).otherwise(value)
    return (
        F.when(comma & dot, both)
        .when(comma, only_comma.otherwise(value))
        .when(dot, only_dot)
        .otherwise(value)
    )


def currency(value: Column, default: str | None = None, locale: str | None = None) -> Column:
    """``<amount> <code>`` for a recognised symbol; ``$`` counts only under a default currency."""
    symbols = dict(lookups.CURRENCY_SYMBOLS)
    if default:
        symbols["$"] = default
    rendered = F
    for symbol, code in symbols.items():
        amount = F.trim(F.replace(value, F.lit(symbol), F.lit("")))
        rendered = rendered.when(
            F.contains(value, F.lit(symbol)), F.concat_ws(" ", numeric(amount, locale), F.lit(code))
        )
    return rendered.otherwise(value)
