"""Built-in lookup tables and the expressions that probe them.

Fixed values: every table below must equal the published one for results to agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADDRESS_WORDS = {
    "st": "Street", "st.": "Street",
    "ave": "Avenue", "ave.": "Avenue",
    "blvd": "Boulevard", "blvd.": "Boulevard",
    "rd": "Road", "rd.": "Road",
    "dr": "Drive", "dr.": "Drive",
    "ln": "Lane", "ln.": "Lane",
    "ct": "Court", "ct.": "Court",
    "apt": "Apartment", "apt.": "Apartment",
    "ste": "Suite", "ste.": "Suite",
    "hwy": "Highway", "hwy.": "Highway",
}

COUNTRY_CODES = {
    "us": "US", "usa": "US", "u.s.a.": "US", "u.s.": "US",
    "united states": "US", "united states of america": "US",
    "ca": "CA", "canada": "CA",
    "uk": "GB", "u.k.": "GB", "united kingdom": "GB", "great britain": "GB", "gb": "GB",
    "mx": "MX", "mexico": "MX",
    "au": "AU", "australia": "AU",
    "de": "DE", "germany": "DE",
    "fr": "FR", "france": "FR",
}

US_STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA",
    "colorado": "CO", "connecticut": "CT", "delaware": "DE", "florida": "FL", "georgia": "GA",
    "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA",
    "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD",
    "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS",
    "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH",
    "new jersey": "NJ", "new mexico": "NM", "new york": "NY", "north carolina": "NC",
    "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA",
    "rhode island": "RI", "south carolina": "SC", "south dakota": "SD", "tennessee": "TN",
    "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA",
    "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY", "district of columbia": "DC",
}

CA_PROVINCES = {
    "alberta": "AB", "british columbia": "BC", "manitoba": "MB", "new brunswick": "NB",
    "newfoundland and labrador": "NL", "northwest territories": "NT", "nova scotia": "NS",
    "nunavut": "NU", "ontario": "ON", "prince edward island": "PE", "quebec": "QC",
    "saskatchewan": "SK", "yukon": "YT",
}

CURRENCY_SYMBOLS = {"€": "EUR", "£": "GBP", "¥": "JPY"}


def literal_map(table: dict[str, str]) -> Column:
    """The table as one foldable map literal."""

    def quoted(text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    return F.expr("map(" + ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in table.items()) + ")")


def probe(key: Column, table: dict[str, str]) -> Column:
    """Value of ``key`` in a literal table, null when it is absent."""
    if not table:
        return F.lit(None).cast("string")
    return F.try_element_at(literal_map(table), key)


def overlay(builtin: dict[str, str], tenant: dict[str, str]) -> dict[str, str]:
    """Tenant entries over the built-in ones."""
    return {**builtin, **tenant}


def lookup_frame(table: dict[str, str]) -> str:
    """``VALUES`` rows of a lookup table, for use in SQL text."""
    rows = ", ".join("('{}', '{}')".format(k.replace("'", "''"), v.replace("'", "''")) for k, v in table.items())
    return f"VALUES {rows}"


def join_lookup(rows: DataFrame, value: str, lookup: DataFrame, output: str) -> DataFrame:
    """Whole-value lookup against a table too large for a literal.

    ``lookup(lookup_key, lookup_value)`` has one row per key. Spark broadcasts it when its size allows
    and shuffles both sides otherwise; unmatched values pass through.
    """
    keyed = rows.withColumn("_key", F.lower(F.trim(F.col(value))))
    table = lookup.select(F.col("lookup_key").alias("_key"), F.col("lookup_value").alias("_hit"))
    return (
        keyed.join(table, "_key", "left")
        .withColumn(output, F.when(F.col(value) == "", F.col(value)).otherwise(F.coalesce("_hit", F.col(value))))
        .drop("_key", "_hit")
    )
