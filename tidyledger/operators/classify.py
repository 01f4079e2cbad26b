"""Field type of a column, from tenant mappings first and its header otherwise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidyledger.functions.text import header_key

# The 14 field types, and the header fragments that suggest them. The first type with a
# matching fragment wins. Fragments are compared without dashes, underscores and blanks.
FIELD_TYPES = (
    "person_name", "company_name", "email", "phone", "postal_address", "city", "state_province",
    "country", "postal_code", "date", "time", "boolean", "numeric", "currency",
)
HEADER_FRAGMENTS = {
    "email": ("email", "e-mail", "e_mail", "emailaddress"),
    "phone": ("phone", "telephone", "tel", "mobile", "cell", "fax"),
    "person_name": (
        "firstname", "first_name", "lastname", "last_name", "fullname", "full_name", "contactname",
        "contact_name",
    ),
    "company_name": (
        "company", "companyname", "company_name", "organization", "org_name", "employer", "business_name",
    ),
    "postal_address": ("address", "street", "addressline", "address_line", "street_address"),
    "city": ("city", "town"),
    "state_province": ("state", "province", "state_province", "region"),
    "country": ("country", "nation"),
    "postal_code": ("zip", "zipcode", "zip_code", "postal", "postalcode", "postal_code"),
    "date": ("date", "dob", "birthdate", "birth_date"),
    "time": ("time",),
    "boolean": ("isactive", "is_active", "active", "enabled", "flag"),
    "numeric": ("amount", "quantity", "qty", "count", "number", "num"),
    "currency": ("price", "cost", "salary", "revenue", "currency"),
}


def _bare(text: str) -> str:
    return "".join(ch for ch in text.lower() if not ch.isspace() and ch not in "-_")


def patterns() -> list[tuple[int, str, str]]:
    """(rank of the field type, field type, fragment)."""
    return [
        (rank, field_type, _bare(fragment))
        for rank, (field_type, fragments) in enumerate(HEADER_FRAGMENTS.items())
        for fragment in fragments
    ]


def classify_header(header: str, overrides: Mapping[str, str] = {}) -> str | None:
    mapped = overrides.get(header.strip().lower())
    if mapped is not None:
        return mapped
    bare = _bare(header)
    return next((field_type for _, field_type, fragment in patterns() if fragment in bare), None)


def classify_headers(headers: Sequence[str], overrides: Mapping[str, str] = {}) -> list[str | None]:
    return [classify_header(h, overrides) for h in headers]


def classify_catalog(catalog: DataFrame, column: str = "column_name") -> DataFrame:
    """Classify a table of column names: adds ``field_type``, null where nothing matches.

    The patterns are literals in one expression, so the catalog is neither joined nor shuffled.
    """
    bare = header_key(F.col(column))
    chosen = F.lit(None).cast("string")
    for field_type, fragments in reversed(HEADER_FRAGMENTS.items()):
        hit = F.lit(False)
        for fragment in fragments:
            hit = hit | F.contains(F.col("_bare"), F.lit(_bare(fragment)))
        chosen = F.when(hit, F.lit(field_type)).otherwise(chosen)
    return catalog.withColumn("_bare", bare).withColumn("field_type", chosen).drop("_bare")


def resolve_scoped(config: DataFrame, data_source_id: str, key: str) -> DataFrame:
    """Of the active rows for one key, the data source's own one, else the tenant-wide one."""
    in_scope = config.where(
        F.col("is_active") & (F.col("data_source_id").isNull() | (F.col("data_source_id") == data_source_id))
    ).withColumn("_key", F.lower(F.trim(F.col(key))))
    rank = Window.partitionBy("organization_id", "_key").orderBy(F.col("data_source_id").isNull(), "id")
    return in_scope.withColumn("_rank", F.row_number().over(rank)).where("_rank = 1").drop("_rank", "_key")


def load_overrides(
    spark: SparkSession, mappings: DataFrame, organization_id: str, data_source_id: str, headers: Sequence[str]
) -> dict[str, str]:
    """Mapped field types of the given headers only, so no more rows than headers are fetched."""
    wanted = [h.strip().lower() for h in headers]
    mine = mappings.where(F.col("organization_id") == organization_id)
    resolved = resolve_scoped(mine, data_source_id, "column_name").where(
        F.lower(F.trim("column_name")).isin(wanted)
    )
    return {r["column_name"].strip().lower(): r["field_type"] for r in resolved.collect()}
