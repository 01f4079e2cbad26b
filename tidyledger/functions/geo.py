"""Country, state, postal-code and address-word expressions over squeezed cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidyledger.functions import lookups

_NOT_ALNUM = "[^A-Za-z0-9]"


def country_code(value: Column, table: dict[str, str]) -> Column:
    """ISO code of a known country name; anything else untouched."""
    return F.coalesce(lookups.probe(F.lower(value), table), value)


def country_context(value: Column | None, table: dict[str, str], default: str | None) -> Column:
    """Country a row's phone, state and postal rules go by, null when it cannot be settled."""
    fallback = F.lit(default).cast("string")
    if value is None:
        return fallback
    known = lookups.probe(F.lower(value), table)
    two_letters = F.when(value.rlike(r"^\p{L}{2}$"), F.upper(value))
    return F.coalesce(known, two_letters, fallback)


def expand_address(value: Column, table: dict[str, str]) -> Column:
    """Each space-separated token replaced by its long form where the table has one."""
    entries = lookups.literal_map(table)
    tokens = F.transform(F.split(value, " "), lambda t: F.coalesce(F.try_element_at(entries, F.lower(t)), t))
    known = "|".join(sorted((_escape(k) for k in table), key=len, reverse=True))
    touched = F.lower(value).rlike(rf"(^| )({known})( |$)")
    return F.when(touched, F.array_join(tokens, " ")).otherwise(value)


def _escape(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and not c.isspace() and ord(c) < 128 else c for c in text)


def state_code(value: Column, country: Column) -> Column:
    name = F.lower(value)
    code = F.when(country == "US", lookups.probe(name, lookups.US_STATES)).when(
        country == "CA", lookups.probe(name, lookups.CA_PROVINCES)
    )
    return F.coalesce(code, value)


def postal_code(value: Column, country: Column) -> Column:
    compact = F.regexp_replace(value, _NOT_ALNUM, "")
    us = (
        F.when(compact.rlike(r"^\d{5}$"), compact)
        .when(compact.rlike(r"^\d{9}$"), F.concat_ws("-", F.substring(compact, 1, 5), F.substring(compact, 6, 4)))
        .otherwise(value)
    )
    upper = F.upper(compact)
    ca = F.when(
        upper.rlike(r"^[A-Z]\d[A-Z]\d[A-Z]\d$"),
        F.concat_ws(" ", F.substring(upper, 1, 3), F.substring(upper, 4, 3)),
    ).otherwise(value)
    return F.when(country == "US", us).when(country == "CA", ca).otherwise(value)
