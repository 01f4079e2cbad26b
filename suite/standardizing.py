"""Standardization of contacts and measures, header classification, lookups and scoped overrides."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.base import cells, fixture_sql, load, query, squeeze_sql
from tidyledger.config import AuditLimits, LookupTables, StandardizeConfig
from tidyledger.functions import lookups
from tidyledger.operators import classify
from tidyledger.operators.standardize import standardize
from tidyledger.plans.onerow import beside

CONTACTS = {
    "full_name": "person_name", "company": "company_name", "email": "email", "phone": "phone",
    "street": "postal_address", "city": "city", "country": "country", "state": "state_province", "zip": "postal_code",
}
MEASURES = {
    "order_date": "date", "time": "time", "flag": "boolean", "amount": "numeric", "price": "currency",
}
TABLES = LookupTables(
    scoped={"company_name": {"inc.": "Incorporated", "machinery": "Machinery Ltd"}, "country": {"jp": "JP"}},
    general={"paris": "Paris France", "bob stone": "Robert Stone", "texas": "TX"},
)
CONFIG = StandardizeConfig(default_currency="USD", numeric_locale="eu")


def _table_sql(name: str, table: dict[str, str]) -> str:
    return f"{name}(k, r) AS ({lookups.lookup_frame(table)})"


_COUNTRIES = lookups.overlay(lookups.COUNTRY_CODES, TABLES.scoped["country"])
LOOKUPS_SQL = ", ".join(
    [
        _table_sql("countries", _COUNTRIES),
        _table_sql("us", lookups.US_STATES),
        _table_sql("ca", lookups.CA_PROVINCES),
        _table_sql("companies", TABLES.scoped["company_name"]),
        _table_sql("general", TABLES.general),
    ]
)


def title_sql(value: str) -> str:
    words = f"string_split({value}, ' ')"
    return f"list_aggregate(list_transform({words}, lambda w: upper(w[1:1]) || lower(w[2:])), 'string_agg', ' ')"


_SQUEEZED = ", ".join(f"{squeeze_sql(c)} AS {c}_t" for c in CONTACTS)
_WORDS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in lookups.ADDRESS_WORDS.items()) + "}"
_NANP = "[2-9][0-9]{2}[2-9][0-9]{6}"
_DIGITS = "regexp_replace(phone_t, '[^0-9]', '', 'g')"
_ZIP = "regexp_replace(zip_t, '[^A-Za-z0-9]', '', 'g')"


def general_sql(value: str) -> str:
    return f"coalesce((SELECT g.r FROM general g WHERE g.k = lower({value})), {value})"


# raw -> squeezed -> country settled -> ruled (``_r``) -> last step (``_g``)
CONTACT_STEPS = f"""
    WITH {LOOKUPS_SQL}, raw AS ({fixture_sql("contacts")}), t AS (SELECT *, {_SQUEEZED} FROM raw),
    iso AS (SELECT t.*, coalesce(c.r, country_t) AS country_iso,
                   CASE WHEN c.r IS NOT NULL THEN c.r
                        WHEN regexp_full_match(country_t, '[A-Za-z]{{2}}') THEN upper(country_t) END AS ctx
            FROM t LEFT JOIN countries c ON c.k = lower(country_t)),
    ruled AS (SELECT *, {title_sql("full_name_t")} AS full_name_r,
        coalesce((SELECT k.r FROM companies k WHERE k.k = lower(company_t)), {title_sql("company_t")}) AS company_r,
        CASE WHEN regexp_full_match(email_t, '[^@]+@[^@]+') THEN lower(email_t) ELSE email_t END AS email_r,
        CASE WHEN ctx IS NULL OR NOT regexp_full_match(phone_t, '[+]?[0-9 ().\\-/]+') THEN phone_t
             WHEN starts_with(phone_t, '+') THEN
                 CASE WHEN regexp_full_match({_DIGITS}, '44(1[0-9]{{8,9}}|[2379][0-9]{{9}}|8[0-9]{{9}})')
                      THEN '+' || {_DIGITS} ELSE phone_t END
             WHEN ctx IN ('US', 'CA') AND regexp_full_match({_DIGITS}, '1?{_NANP}')
                 THEN '+1' || right({_DIGITS}, 10)
             ELSE phone_t END AS phone_r,
        CASE WHEN street_t = '' THEN '' ELSE array_to_string(list_transform(string_split(street_t, ' '),
             lambda w: coalesce({_WORDS}[lower(w)], w)), ' ') END AS street_r,
        {title_sql("city_t")} AS city_r,
        coalesce(CASE ctx WHEN 'US' THEN (SELECT r FROM us WHERE us.k = lower(state_t))
                          WHEN 'CA' THEN (SELECT r FROM ca WHERE ca.k = lower(state_t)) END, state_t) AS state_r,
        CASE WHEN ctx = 'US' AND regexp_full_match({_ZIP}, '[0-9]{{5}}') THEN {_ZIP}
             WHEN ctx = 'US' AND regexp_full_match({_ZIP}, '[0-9]{{9}}') THEN {_ZIP}[1:5] || '-' || {_ZIP}[6:9]
             WHEN ctx = 'CA' AND regexp_full_match(upper({_ZIP}), '[A-Z][0-9][A-Z][0-9][A-Z][0-9]')
                 THEN upper({_ZIP}[1:3]) || ' ' || upper({_ZIP}[4:6]) ELSE zip_t END AS zip_r
        FROM iso),
    done AS (SELECT *, {general_sql("full_name_r")} AS full_name_g, {general_sql("company_r")} AS company_g,
        email_r AS email_g, phone_r AS phone_g, {title_sql("street_r")} AS street_g, {general_sql("city_r")} AS city_g,
        country_iso AS country_g, {general_sql("state_r")} AS state_g, zip_r AS zip_g FROM ruled)"""

_RULES = {
    "full_name": "'title_case'", "email": "'lower_case'", "phone": "'phone_e164'", "city": "'title_case'",
    "company": "CASE WHEN lower(company_t) IN (SELECT k FROM companies) THEN 'company_suffix_lookup' ELSE 'title_case' END",
    "street": "'address_abbreviation_expansion'", "state": "'state_province_abbreviation'", "zip": "'postal_code_format'",
}


def _contact_changes() -> str:
    parts = []
    for rank, c in enumerate(CONTACTS):
        levels = [(c, f"{c}_t", "'trim_whitespace'")]
        if c == "country":
            levels.append(("country_t", "country_iso", "'country_iso_normalize'"))
        else:
            levels.append((f"{c}_t", f"{c}_r", _RULES[c]))
            last = "'title_case'" if c == "street" else "'abbreviation_lookup'"
            levels.append((f"{c}_r", f"{c}_g", last))
        column_rank = -1 if c == "country" else rank
        for step, (before, after, rule) in enumerate(levels):
            parts.append(
                f"SELECT row_index, {column_rank * 3 + step} AS ord, '{c}' AS column_name, '{CONTACTS[c]}' AS field_type,"
                f" {before} AS original_value, {after} AS standardized_value, {rule} AS rule_name FROM done"
                f" WHERE {before} <> {after}"
            )
    return f", changes AS ({' UNION ALL '.join(parts)})"


CONTACT_CHANGES = CONTACT_STEPS + _contact_changes()


def _contacts(spark, sf_dir, limits=AuditLimits(), columns=tuple(CONTACTS)):
    table = cells(spark, sf_dir, "contacts", list(columns))
    return standardize(table, [CONTACTS[c] for c in columns], CONFIG, TABLES, limits)


_ONE = {
    "std_person": "full_name", "std_company_lookup": "company", "std_email": "email", "std_address": "street",
    "std_city": "city", "std_country": "country", "std_state": "state", "std_postal": "zip", "std_phone": "phone",
}
for _name, _column in _ONE.items():

    @query(_name, f"{CONTACT_STEPS} SELECT row_index, {_column} AS before, {_column}_g AS after FROM done")
    def _single(spark, sf_dir, column=_column):
        chosen = (column,) if column == "country" else (column, "country")
        trace = _contacts(spark, sf_dir, columns=chosen).trace
        return trace.frame.select("row_index", F.col("c0").alias("before"), F.col(trace.latest[0]).alias("after"))


@query("std_contact_rows", f"{CONTACT_STEPS} SELECT row_index, {', '.join(f'{c}_g AS {c}' for c in CONTACTS)} FROM done")
def std_contact_rows(spark, sf_dir):
    return _contacts(spark, sf_dir).table.named()


@query(
    "std_changes_by_rule",
    f"{CONTACT_CHANGES} SELECT rule_name, count(*) AS change_count FROM changes GROUP BY rule_name",
)
def std_changes_by_rule(spark, sf_dir):
    return _contacts(spark, sf_dir).changes_by_rule


_LOG = "row_index, column_name, field_type, original_value, standardized_value, rule_name"


@query("std_change_log_cap", f"{CONTACT_CHANGES} SELECT {_LOG} FROM changes ORDER BY row_index, ord LIMIT 700")
def std_change_log_cap(spark, sf_dir):
    log = _contacts(spark, sf_dir, AuditLimits(max_changes=700)).changes
    return log.select(*_LOG.split(", "))


@query("std_change_log", f"{CONTACT_CHANGES} SELECT {_LOG} FROM changes")
def std_change_log(spark, sf_dir):
    """The whole log: without a limit nothing is cut."""
    return _contacts(spark, sf_dir).changes.select(*_LOG.split(", "))


@query("std_twice_changes_nothing", "SELECT count(*) AS rows, 0 AS total_changes_count FROM customer")
def std_twice_changes_nothing(spark, sf_dir):
    first = _contacts(spark, sf_dir)
    again = standardize(first.table, list(CONTACTS.values()), CONFIG, TABLES)
    rows = first.table.frame.agg(F.count(F.lit(1)).alias("rows"))
    return beside(rows, again.trace.summary().select("total_changes_count"))


_T = ", ".join(f"{squeeze_sql(c)} AS {c}_t" for c in MEASURES)


def numeric_sql(v: str) -> str:
    return f"""CASE WHEN contains({v}, ',') AND contains({v}, '.') THEN
          CASE WHEN instr(reverse({v}), '.') < instr(reverse({v}), ',') THEN replace({v}, ',', '')
               ELSE replace(replace({v}, '.', ''), ',', '.') END
        WHEN regexp_full_match({v}, '-?[0-9]{{1,3}}(,[0-9]{{3}})+') THEN replace({v}, ',', '')
        WHEN regexp_full_match({v}, '-?[0-9]+,[0-9]{{1,2}}') THEN replace({v}, ',', '.')
        WHEN regexp_full_match({v}, '-?[0-9]{{1,3}}([.][0-9]{{3}})+') THEN replace({v}, '.', '')
        ELSE {v} END"""


_PRICE = "trim(replace(price_t, symbol, ''))"
MEASURE_STEPS = f"""
    WITH raw AS ({fixture_sql("measures")}), t AS (SELECT *, {_T} FROM raw),
    s AS (SELECT *, CASE WHEN contains(price_t, '€') THEN '€' WHEN contains(price_t, '£') THEN '£'
                         WHEN contains(price_t, '¥') THEN '¥' WHEN contains(price_t, '$') THEN '$' END AS symbol FROM t),
    done AS (SELECT *,
        CASE WHEN regexp_full_match(order_date_t, '[0-9]{{8}}T0930') THEN
                  order_date_t[1:4] || '-' || order_date_t[5:6] || '-' || order_date_t[7:8] || 'T09:30:00'
             WHEN regexp_full_match(order_date_t, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN order_date_t || 'T00:00:00'
             WHEN order_date_t LIKE '%T08:15:30.5Z' THEN replace(order_date_t, '.5Z', '.500000+00:00')
             ELSE order_date_t END AS order_date_g,
        CASE time_t WHEN '0930' THEN '09:30:00' WHEN '09 30' THEN '09:30:00' WHEN '10:15:30+05' THEN '10:15:30+05:00'
             ELSE time_t END AS time_g,
        CASE lower(flag_t) WHEN 'yes' THEN 'true' WHEN 'true' THEN 'true' WHEN '0' THEN 'false' WHEN 'false' THEN 'false'
             ELSE flag_t END AS flag_g,
        {numeric_sql("amount_t")} AS amount_g,
        CASE WHEN symbol IS NULL THEN price_t ELSE {numeric_sql(_PRICE)} || ' ' ||
             CASE symbol WHEN '€' THEN 'EUR' WHEN '£' THEN 'GBP' WHEN '¥' THEN 'JPY' ELSE 'USD' END END AS price_g
        FROM s)"""


def _measures(spark, sf_dir, columns=tuple(MEASURES), config=CONFIG):
    return standardize(cells(spark, sf_dir, "measures", list(columns)), [MEASURES[c] for c in columns], config)


for _name, _column in {
    "std_date": "order_date", "std_time": "time", "std_boolean": "flag", "std_numeric": "amount", "std_currency": "price",
}.items():

    @query(_name, f"{MEASURE_STEPS} SELECT row_index, {_column} AS before, {_column}_g AS after FROM done")
    def _measure(spark, sf_dir, column=_column):
        trace = _measures(spark, sf_dir, (column,)).trace
        return trace.frame.select("row_index", F.col("c0").alias("before"), F.col(trace.latest[0]).alias("after"))


@query(
    "std_date_format",
    "SELECT o_orderkey AS row_index, strftime(o_orderdate, '%m/%d/%Y') AS o_orderdate FROM orders",
)
def std_date_format(spark, sf_dir):
    from tidyledger.sources.tables import from_frame

    table = from_frame(load(spark, sf_dir, "orders"), "o_orderkey", ["o_orderdate"])
    return standardize(table, ["date"], StandardizeConfig(date_output_format="%m/%d/%Y")).table.named()


@query(
    "std_summary",
    f"""{MEASURE_STEPS} SELECT (SELECT count(*) FROM raw) AS row_count,
        {" + ".join(f"count(*) FILTER (WHERE {c}_t <> {c}_g)" for c in MEASURES)} AS total_changes_count,
        0.7 AS confidence_score, '1.0' AS standardization_engine_version FROM done""",
)
def std_summary(spark, sf_dir):
    return _measures(spark, sf_dir).summary.drop("changes_by_rule")


# ---- classification --------------------------------------------------------------------------------


_FRAGMENTS = ", ".join(f"({rank}, '{kind}', '{fragment}')" for rank, kind, fragment in classify.patterns())


@query(
    "classify_values",
    f"""WITH pat(rank, field_type, fragment) AS (VALUES {_FRAGMENTS}),
    names AS (SELECT DISTINCT p_type || '_' || p_name AS column_name FROM part),
    hits AS (SELECT column_name, min_by(field_type, rank) AS field_type FROM names, pat
             WHERE contains(replace(replace(replace(lower(column_name), ' ', ''), '-', ''), '_', ''), fragment)
             GROUP BY column_name)
    SELECT column_name, field_type FROM names LEFT JOIN hits USING (column_name)""",
)
def classify_values(spark, sf_dir):
    names = load(spark, sf_dir, "part").select(F.concat_ws("_", "p_type", "p_name").alias("column_name")).distinct()
    return classify.classify_catalog(names)


_MAPPING = (
    "SELECT 'm' || CAST(c_custkey AS STRING) AS id, 'org' || CAST(c_custkey % 3 AS STRING) AS organization_id,"
    " CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'd1' ELSE 'd2' END AS data_source_id,"
    " CASE c_custkey % 2 WHEN 0 THEN ' Col' ELSE 'COL' END || CAST(c_custkey % 40 AS STRING) AS column_name,"
    " c_mktsegment AS field_type, c_custkey % 5 <> 0 AS is_active FROM customer"
)


@query(
    "std_override_precedence",
    f"""WITH m AS ({_MAPPING}), scoped AS (SELECT * FROM m WHERE is_active AND (data_source_id IS NULL OR data_source_id = 'd1'))
    SELECT organization_id, lower(trim(column_name)) AS column_key, id, data_source_id, field_type FROM (
      SELECT *, row_number() OVER (PARTITION BY organization_id, lower(trim(column_name))
                                   ORDER BY data_source_id IS NULL, id) AS r FROM scoped) WHERE r = 1""",
)
def std_override_precedence(spark, sf_dir):
    load(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    resolved = classify.resolve_scoped(spark.sql(_MAPPING), "d1", "column_name")
    return resolved.select(
        "organization_id", F.lower(F.trim("column_name")).alias("column_key"), "id", "data_source_id", "field_type"
    )


_BIG = "SELECT DISTINCT lower(p_name) AS lookup_key, 'P:' || lower(p_name) AS lookup_value FROM part"


@query(
    "std_lookup_join",
    f"""WITH t AS (SELECT p_partkey AS row_index, CASE p_partkey % 2 WHEN 0 THEN upper(p_name) ELSE p_brand END AS v FROM part),
    k AS ({_BIG}) SELECT row_index, v, coalesce(lookup_value, v) AS looked FROM t LEFT JOIN k ON lookup_key = lower(v)""",
)
def std_lookup_join(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    rows = part.selectExpr(
        "p_partkey AS row_index", "CASE p_partkey % 2 WHEN 0 THEN upper(p_name) ELSE p_brand END AS v"
    )
    table = part.selectExpr("lower(p_name) AS lookup_key", "concat('P:', lower(p_name)) AS lookup_value").distinct()
    return lookups.join_lookup(rows, "v", table, "looked")


@query("std_generic_abbreviation", f"{CONTACT_STEPS} SELECT row_index, city_r AS before, city_g AS after FROM done")
def std_generic_abbreviation(spark, sf_dir):
    trace = _contacts(spark, sf_dir, columns=("city",)).trace
    return trace.frame.select("row_index", F.col("c0_r").alias("before"), F.col("c0_g").alias("after"))


@query(
    "slugs",
    "SELECT DISTINCT p_type || ' -- ' || p_name AS name, trim(regexp_replace(lower(p_type || ' -- ' || p_name),"
    " '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part",
)
def slugs(spark, sf_dir):
    from tidyledger.functions.text import slugify

    names = load(spark, sf_dir, "part").select(F.concat_ws(" -- ", "p_type", "p_name").alias("name")).distinct()
    return names.withColumn("slug", slugify(F.col("name")))


