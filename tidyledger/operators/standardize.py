"""Standardization: one rule per field type, the row's country settled first; every change logged."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyledger.config import STANDARDIZATION_VERSION, AuditLimits, LookupTables, StandardizeConfig
from tidyledger.functions import contact, geo, lookups, temporal, text, values
from tidyledger.operators import clean
from tidyledger.operators.stage import RuleInfo, Trace
from tidyledger.sources.tables import CellTable

# Rule names, confidences and reasons.
RULES = {
    "trim_whitespace": clean.RULES["trim_whitespace"],
    "title_case": RuleInfo(0.95, "Value converted to title case."),
    "upper_case": RuleInfo(1.0, "Value converted to upper case."),
    "lower_case": RuleInfo(1.0, "Value converted to lower case."),
    "company_suffix_lookup": RuleInfo(0.9, "Company suffix normalized via configured lookup table."),
    "phone_e164": RuleInfo(0.85, "Phone number reformatted to E.164 using the resolved country."),
    "address_abbreviation_expansion": RuleInfo(0.85, "Address term normalized via abbreviation lookup table."),
    "state_province_abbreviation": RuleInfo(0.9, "State/province normalized to its standard abbreviation."),
    "country_iso_normalize": RuleInfo(0.9, "Country name normalized to its ISO 3166-1 alpha-2 code."),
    "postal_code_format": RuleInfo(
        0.9, "Postal/ZIP code reformatted to the resolved country's standard form."
    ),
    "date_format_normalize": RuleInfo(0.7, "Date reparsed and reformatted to the canonical/configured form."),
    "time_format_normalize": RuleInfo(0.75, "Time reparsed and reformatted to 24-hour ISO-8601 form."),
    "boolean_format_normalize": RuleInfo(0.95, "Boolean value normalized to its canonical/configured form."),
    "numeric_format_normalize": RuleInfo(
        0.85, "Numeric separators normalized to a canonical machine-readable form."
    ),
    "currency_format_normalize": RuleInfo(
        0.8, "Currency value normalized to '<amount> <ISO4217code>' form."
    ),
    "abbreviation_lookup": RuleInfo(
        0.85, "Value normalized via a configured generic abbreviation lookup table."
    ),
}
# The free-text types that also take the tenant's general lookup.
GENERAL_LOOKUP_TYPES = ("person_name", "company_name", "city", "state_province", "country")


@dataclass(frozen=True)
class Context:
    """What a field rule may look at besides its own cell."""

    config: StandardizeConfig
    lookups: LookupTables
    country: Column

    def table(self, field_type: str, builtin: dict[str, str] = {}) -> dict[str, str]:
        return lookups.overlay(builtin, self.lookups.scoped.get(field_type, {}))


def _one(name: str) -> tuple:
    return ((name, None),)


def _company(value: Column, ctx: Context) -> tuple[Column, tuple]:
    table = ctx.table("company_name")
    if not table:
        return text.title_case(value), _one("title_case")
    hit = lookups.probe(F.lower(value), table)
    names = (("company_suffix_lookup", hit.isNotNull()), ("title_case", None))
    return F.coalesce(hit, text.title_case(value)), names


# Field type -> rule: (cell, context) -> (value, rule names). Address and country have steps of their own.
FIELD_RULES = {
    "person_name": lambda v, ctx: (text.title_case(v), _one("title_case")),
    "company_name": _company,
    "city": lambda v, ctx: (text.title_case(v), _one("title_case")),
    "email": lambda v, ctx: (contact.email(v), _one("lower_case")),
    "phone": lambda v, ctx: (contact.phone(v, ctx.country), _one("phone_e164")),
    "postal_address": lambda v, ctx: (
        geo.expand_address(v, ctx.table("postal_address", lookups.ADDRESS_WORDS)),
        _one("address_abbreviation_expansion"),
    ),
    "state_province": lambda v, ctx: (geo.state_code(v, ctx.country), _one("state_province_abbreviation")),
    "postal_code": lambda v, ctx: (geo.postal_code(v, ctx.country), _one("postal_code_format")),
    "date": lambda v, ctx: (temporal.format_date(v, ctx.config.date_output_format), _one("date_format_normalize")),
    "time": lambda v, ctx: (temporal.normalize_time(v), _one("time_format_normalize")),
    "boolean": lambda v, ctx: (
        values.boolean(v, ctx.config.boolean_output_form), _one("boolean_format_normalize")
    ),
    "numeric": lambda v, ctx: (values.numeric(v, ctx.config.numeric_locale), _one("numeric_format_normalize")),
    "currency": lambda v, ctx: (
        values.currency(v, ctx.config.default_currency, ctx.config.numeric_locale),
        _one("currency_format_normalize"),
    ),
}


@dataclass(frozen=True)
class StandardizeResult:
    trace: Trace
    country_column: int | None
    limits: AuditLimits

    @property
    def table(self) -> CellTable:
        return self.trace.output()

    @property
    def changes(self) -> DataFrame:
        log = self.trace.changes(self.limits.max_changes, self.country_column)
        return log.withColumn("rule_version", F.lit(STANDARDIZATION_VERSION))

    @property
    def changes_by_rule(self) -> DataFrame:
        return self.trace.changes_by_rule().select("rule_name", "change_count")

    @property
    def summary(self) -> DataFrame:
        rows = self.trace.table.frame.agg(F.count(F.lit(1))).scalar()
        return self.trace.summary().select(
            rows.alias("row_count"), "*", F.lit(STANDARDIZATION_VERSION).alias("standardization_engine_version")
        )


def standardize(
    table: CellTable,
    field_types: Sequence[str | None],
    config: StandardizeConfig = StandardizeConfig(),
    tables: LookupTables = LookupTables(),
    limits: AuditLimits = AuditLimits(),
) -> StandardizeResult:
    """``field_types`` in header order; ``None`` leaves a column alone."""
    if len(field_types) != len(table.headers):
        raise ValueError("one field type (or None) per column is needed")
    trace = Trace.start(table, RULES, STANDARDIZATION_VERSION, "standardized_value")
    typed = [(i, t) for i, t in enumerate(field_types) if t is not None]
    country_column = next((i for i, t in typed if t == "country"), None)
    countries = lookups.overlay(lookups.COUNTRY_CODES, tables.scoped.get("country", {}))
    trace.level("t", [(i, text.squeeze(F.col(f"c{i}")), _one("trim_whitespace"), t) for i, t in typed])

    # The country level: the first country column's code, and the context of every other rule.
    settled = None
    if country_column is not None:
        code = geo.country_code(F.col(trace.latest[country_column]), countries)
        trace.level("iso", [(country_column, code, _one("country_iso_normalize"), "country")])
        settled = F.col(trace.latest[country_column])
    trace.frame = trace.frame.withColumn(
        "_country", geo.country_context(settled, countries, config.default_country)
    )
    ctx = Context(config, tables, F.col("_country"))

    ruled = []
    for i, t in typed:
        if t in FIELD_RULES:
            value, names = FIELD_RULES[t](F.col(trace.latest[i]), ctx)
            ruled.append((i, value, names, t))
    trace.level("r", ruled)

    # Last level: casing of addresses, general lookup of free text (never of the first country column).
    last = [
        (i, text.title_case(F.col(trace.latest[i])), _one("title_case"), t) for i, t in typed if t == "postal_address"
    ]
    for i, t in typed:
        if tables.general and t in GENERAL_LOOKUP_TYPES and i != country_column:
            value = F.col(trace.latest[i])
            hit = F.when(value != "", lookups.probe(F.lower(value), tables.general))
            last.append((i, F.coalesce(hit, value), _one("abbreviation_lookup"), t))
    trace.level("g", last)
    return StandardizeResult(trace, country_column, limits)
