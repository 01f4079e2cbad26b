"""Type labels of text cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidyledger.functions import numbers, temporal

# Labels in tie-break order, the words that read as booleans, and the share of
# non-blank cells that one label must reach to name a column.
TYPE_PRIORITY = ("boolean", "integer", "decimal", "datetime", "date", "string")
BOOLEAN_WORDS = ("true", "false", "yes", "no", "y", "n")
DOMINANT_SHARE = 0.8


def cell_type(value: Column) -> Column:
    """Label of an already stripped cell."""
    return (
        F.when(value == "", F.lit("null"))
        .when(F.lower(value).isin(*BOOLEAN_WORDS), F.lit("boolean"))
        .when(numbers.is_integer_text(value), F.lit("integer"))
        .when(numbers.is_decimal_like(value), F.lit("decimal"))
        .otherwise(temporal.temporal_label(value))
    )
