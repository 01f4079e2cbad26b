"""Whitespace, case and name-normalising expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as whitespace.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                           0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_CLASS = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
# Only what has to change: a run of two or more, or a single one that is no plain space.
_UNEVEN = rf"[{_CLASS}]{{2,}}|[{_CLASS}&&[^ ]]"


def squeeze(value: Column) -> Column:
    """Strip, and turn every run of whitespace into one space."""
    return F.trim(F.regexp_replace(value, _UNEVEN, " "))


def strip(value: Column) -> Column:
    """Strip both ends only."""
    return F.btrim(value, F.lit(BLANKS))


def fold(value: Column) -> Column:
    """Comparison key of a cell: squeezed and lower-cased."""
    return F.lower(squeeze(value))


def lookup_key(value: Column) -> Column:
    return F.lower(strip(value))


def title_case(value: Column) -> Column:
    """First letter of each space-separated word upper, the rest lower; no smart casing."""
    return F.initcap(value)


def slugify(name: Column) -> Column:
    dashed = F.regexp_replace(F.lower(strip(name)), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


def is_valid_slug(slug: Column) -> Column:
    return slug.rlike("^[a-z0-9](?:[a-z0-9-]*[a-z0-9])?$") & ~F.contains(slug, F.lit("--"))


def normalize_name(name: Column) -> Column:
    return strip(name)


def normalize_email(email: Column) -> Column:
    return F.lower(strip(email))


def header_key(header: Column) -> Column:
    """Header as compared with the classification patterns: lower-case, no blanks, dashes or underscores."""
    return F.regexp_replace(F.lower(header), rf"[{_CLASS}_\-]+", "")


def row_key(cells: list[str]) -> Column:
    """32-byte digest that is equal exactly for rows equal in every cell (lengths keep cells apart)."""
    parts = [part for c in cells for part in (F.length(c).cast("string"), F.lit(":"), F.col(c))]
    return F.unhex(F.sha2(F.concat(*parts), 256))
