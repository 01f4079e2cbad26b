"""Profiles of whole driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from suite.base import FIXTURES, fixture_sql, cells, load, query
from tidyledger.operators import profile, sketch
from tidyledger.plans.audit import total
from tidyledger.session import ensure_checkpoint_dir
from tidyledger.sources.tables import from_frame

TABLES = {
    "customer": ("c_custkey", ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]),
    "orders": ("o_orderkey", ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]),
    "lineitem": (
        "l_orderkey * 10 + l_linenumber",
        ["l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    ),
    "part": ("p_partkey", ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]),
    "documents": ("doc_id", ["text", "lang", "source", "n_chars"]),
    "events": ("event_id", ["user_id", "event_type", "value", "props"]),
}

TYPE_SQL = (
    "CASE WHEN lower(v) IN ('true', 'false', 'yes', 'no', 'y', 'n') THEN 'boolean'"
    " WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN 'integer'"
    " WHEN regexp_full_match(v, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN 'decimal'"
    " WHEN regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?') THEN 'datetime'"
    " WHEN regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'date' ELSE 'string' END"
)
_PRIORITY = "CASE t WHEN 'boolean' THEN 0 WHEN 'integer' THEN 1 WHEN 'decimal' THEN 2 WHEN 'datetime' THEN 3 WHEN 'date' THEN 4 ELSE 5 END"


def long_sql(index: str, columns: list[str], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS name, {index} AS row_index,"
        f" trim(coalesce(CAST({c} AS VARCHAR), ''), E' \\t\\n\\r') AS v FROM {source}"
        for i, c in enumerate(columns)
    )


def profile_sql(index: str, columns: list[str], source: str) -> str:
    return f"""
    WITH cells AS ({long_sql(index, columns, source)}),
    typed AS (SELECT *, {TYPE_SQL} AS t FROM cells WHERE v <> ''),
    base AS (SELECT position, name, count(*) AS row_count, count(*) FILTER (WHERE v <> '') AS non_null_count,
                    count(DISTINCT CASE WHEN v <> '' THEN v END) AS distinct_count FROM cells GROUP BY ALL),
    hist AS (SELECT position, t, count(*) AS n FROM typed GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY n DESC, {_PRIORITY}) AS r,
                      count(*) OVER (PARTITION BY position, n) AS same FROM hist),
    top AS (SELECT position, t AS dominant, n AS top, same FROM ranked WHERE r = 1),
    texts AS (SELECT position, string_agg(t || '=' || CAST(n AS VARCHAR), ',' ORDER BY t) AS type_counts
              FROM hist GROUP BY position)
    SELECT b.name, CAST(b.position AS INTEGER) AS position,
           CASE WHEN top IS NULL THEN 'null' WHEN same > 1 OR CAST(top AS DOUBLE) / non_null_count < 0.8 THEN 'mixed'
                ELSE dominant END AS inferred_type,
           non_null_count, row_count - non_null_count AS missing_count,
           round((row_count - non_null_count) / CAST(row_count AS DOUBLE) * 100, 4) AS missing_percentage,
           distinct_count,
           CASE WHEN top IS NULL THEN 0 WHEN same > 1 OR CAST(top AS DOUBLE) / non_null_count < 0.8
                THEN non_null_count ELSE non_null_count - top END AS inconsistent_value_count,
           coalesce(type_counts, '') AS type_counts
    FROM base b LEFT JOIN top USING (position) LEFT JOIN texts USING (position)"""


def flat(profiles):
    entries = F.transform(
        F.map_entries("observed_type_counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))
    )
    return profiles.select(
        "name", "position", "inferred_type", "non_null_count", "missing_count", "missing_percentage",
        "distinct_count", "inconsistent_value_count", F.array_join(entries, ",").alias("type_counts"),
    )


def samples_sql(index: str, columns: list[str], source: str, limit: int = 100) -> str:
    return f"""
    WITH cells AS ({long_sql(index, columns, source)}),
    firsts AS (SELECT position, name, v, min(row_index) AS f FROM cells WHERE v <> '' GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY f) AS rank FROM firsts)
    SELECT CAST(position AS INTEGER) AS position, name, CAST(rank AS INTEGER) AS rank, v AS value
    FROM ranked WHERE rank <= {limit}"""


def _table(spark, sf_dir, name):
    index, columns = TABLES[name]
    frame = load(spark, sf_dir, name).withColumn("_row", F.expr(index))
    return from_frame(frame, "_row", columns)


for _name, (_index, _columns) in TABLES.items():

    @query(f"profile_{_name}", profile_sql(_index, _columns, _name))
    def _profile(spark, sf_dir, name=_name):
        return flat(profile.column_profiles(_table(spark, sf_dir, name)))


_MESSY = list(FIXTURES["messy_customer"][1])[1:]


@query("profile_messy", profile_sql("row_index", _MESSY, f"({fixture_sql('messy_customer')})"))
def profile_messy(spark, sf_dir):
    return flat(profile.column_profiles(cells(spark, sf_dir, "messy_customer")))


@query("profile_samples", samples_sql(*TABLES["part"], "part"))
def profile_samples(spark, sf_dir):
    return profile.column_samples(_table(spark, sf_dir, "part"))


@query("profile_samples_long_text", samples_sql(*TABLES["documents"], "documents"))
def profile_samples_long_text(spark, sf_dir):
    return profile.column_samples(_table(spark, sf_dir, "documents"))


# A sketch's distinct count has a standard error of 0.8 %; compared by its power of two, exactly for few values.
_ROUGH = "CASE WHEN distinct_count <= 30 THEN distinct_count ELSE -CAST(round(log2(distinct_count)) AS BIGINT) END"
_PARTS = 4  # sources that the rows of a table are taken for


def _sketched(spark, sf_dir, name, parts=_PARTS):
    """Sketches of each of some sources, stored one after the other: a later profile only reads what is new."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/sketches-{uuid.uuid4()}"
    index, columns = TABLES[name]
    frame = load(spark, sf_dir, name).withColumn("_row", F.expr(index))
    for part in range(parts):
        own = frame.where(F.pmod("_row", F.lit(parts)) == part) if parts > 1 else frame
        made = sketch.column_sketches(from_frame(own, "_row", columns), f"s{part}")
        made.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def _rough(profiles):
    return flat(profiles).withColumn("distinct_count", F.expr(_ROUGH))


def _rough_sql(name: str) -> str:
    return f"SELECT * REPLACE ({_ROUGH} AS distinct_count) FROM ({profile_sql(*TABLES[name], name)})"


@query("profile_approximate", _rough_sql("lineitem"))
def profile_approximate(spark, sf_dir):
    """A profile without moving distinct values: their number comes from a sketch of fixed size."""
    return _rough(sketch.merged_profiles(_sketched(spark, sf_dir, "lineitem", 1)))


@query("profile_merged", _rough_sql("orders"))
def profile_merged(spark, sf_dir):
    """Four sources profiled one by one and merged: the profile of everything."""
    return _rough(sketch.merged_profiles(_sketched(spark, sf_dir, "orders")))


_MERGED_SAMPLES = f"""
    WITH cells AS ({long_sql(*TABLES["part"], "part")}),
    firsts AS (SELECT position, name, v, min((row_index % {_PARTS}) * 1000000000000 + row_index) AS f FROM cells
               WHERE v <> '' GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY f) AS rank FROM firsts)
    SELECT CAST(position AS INTEGER) AS position, name, CAST(rank AS INTEGER) AS rank, v AS value
    FROM ranked WHERE rank <= 100"""


@query("profile_merged_samples", _MERGED_SAMPLES)
def profile_merged_samples(spark, sf_dir):
    """First distinct values over all sources, by source and row, from the first ones of each."""
    merged = sketch.merged_profiles(_sketched(spark, sf_dir, "part"))
    return merged.select("position", "name", F.posexplode("retained_distinct_values").alias("rank", "value")).withColumn(
        "rank", F.col("rank") + 1
    )


_ISSUES = f"""
    WITH profiles AS ({profile_sql("row_index", _MESSY, f"({fixture_sql('messy_customer')})")})
    SELECT 'inconsistent_column_type' AS type, position AS column_index, name AS column_name, inferred_type,
           inconsistent_value_count FROM profiles WHERE inconsistent_value_count > 0"""


@query("profile_type_issues", _ISSUES)
def profile_type_issues(spark, sf_dir):
    profiles = profile.column_profiles(cells(spark, sf_dir, "messy_customer"))
    return profile.type_issues(profiles).drop("dominant_type")


_O = [f"trim({c})" for c in ("customer", "status", "priority")]


@query(
    "table_profile",
    f"""WITH t AS ({fixture_sql("messy_orders")}), s AS (SELECT {", ".join(f"{c} AS k{i}" for i, c in enumerate(_O))} FROM t)
    SELECT count(*) AS row_count, 3 AS column_count,
           count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM s)) AS duplicate_row_count,
           count(*) FILTER (WHERE k0 = '') + count(*) FILTER (WHERE k1 = '') + count(*) FILTER (WHERE k2 = '')
           AS missing_value_total FROM s""",
)
def table_profile(spark, sf_dir):
    return profile.table_profile(cells(spark, sf_dir, "messy_orders"))


@query(
    "type_histogram",
    f"""WITH cells AS ({long_sql(TABLES["lineitem"][0], TABLES["lineitem"][1], "lineitem")})
    SELECT position, {TYPE_SQL} AS value_type, count(*) AS n FROM cells
    WHERE v <> '' GROUP BY ALL""",
)
def type_histogram(spark, sf_dir):
    return profile.type_counts(_table(spark, sf_dir, "lineitem"))


@query("row_total", "SELECT count(*) AS total FROM lineitem")
def row_total(spark, sf_dir):
    return total(load(spark, sf_dir, "lineitem"))
