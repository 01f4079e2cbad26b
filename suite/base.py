"""Registry, table access, and messy inputs.

The driver tables are clean and typed. Messy cells are derived from all of their rows by expressions that
read the same in Spark and in the checking engine; ``FIXTURES`` holds them once for both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidyledger.session import tune
from tidyledger.sources.tables import CellTable, from_frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query, with the SQL text of its check where there is one."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(tune(spark), sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


K = "c_custkey"
O = "o_orderkey"

# name -> (source table, {column: expression})
FIXTURES: dict[str, tuple[str, dict[str, str]]] = {
    "messy_customer": (
        "customer",
        {
            "row_index": K,
            "name": f"CASE {K} % 4 WHEN 0 THEN '  ' || c_name || ' ' WHEN 1 THEN replace(c_name, '#', '   ')"
            " ELSE c_name END",
            "balance": f"CASE {K} % 7 WHEN 0 THEN CAST(c_acctbal AS STRING) || '0' WHEN 1 THEN"
            " CASE WHEN c_acctbal >= 0 THEN '+' ELSE '' END || CAST(c_acctbal AS STRING) WHEN 2 THEN 'N/A'"
            f" WHEN 3 THEN CAST({K} AS STRING) || '.500' ELSE CAST(c_acctbal AS STRING) END",
            "nation": f"CASE {K} % 8 WHEN 0 THEN CAST(c_nationkey AS STRING) || '.0' ELSE"
            " CAST(c_nationkey AS STRING) END",
            "active": f"CASE {K} % 6 WHEN 0 THEN 'YES' WHEN 1 THEN 'no' WHEN 2 THEN ' TRUE' WHEN 3 THEN 'n'"
            " WHEN 4 THEN 'false' ELSE 'y' END",
            "joined": f"'20' || lpad(CAST({K} % 25 AS STRING), 2, '0') || '-' ||"
            f" lpad(CAST({K} % 12 + 1 AS STRING), 2, '0') || '-' || lpad(CAST({K} % 28 + 1 AS STRING), 2, '0') ||"
            f" CASE {K} % 9 WHEN 0 THEN ' 10:30:00' ELSE '' END",
            "segment": f"CASE {K} % 10 WHEN 0 THEN '-' WHEN 1 THEN 'none' WHEN 2 THEN ' NULL ' WHEN 3 THEN ''"
            " ELSE c_mktsegment END",
        },
    ),
    "messy_orders": (
        "orders",
        {
            "row_index": O,
            "customer": f"CASE {O} % 5 WHEN 0 THEN ' ' || CAST(o_custkey AS STRING) ELSE CAST(o_custkey AS STRING) END",
            "status": f"CASE {O} % 3 WHEN 0 THEN o_orderstatus || ' ' ELSE o_orderstatus END",
            "priority": f"CASE {O} % 4 WHEN 0 THEN 'n/a' ELSE substr(o_orderpriority, 1, 1) END",
        },
    ),
    "contacts": (
        "customer",
        {
            "row_index": K,
            "full_name": f"CASE {K} % 3 WHEN 0 THEN 'aNN  o''BRIEN ' WHEN 1 THEN upper(c_name) ELSE 'Bob Stone' END",
            "company": f"CASE {K} % 4 WHEN 0 THEN 'INC.' WHEN 1 THEN 'acme  widgets' WHEN 2 THEN 'Inc.' ELSE"
            " lower(c_mktsegment) END",
            "email": f"CASE {K} % 4 WHEN 0 THEN 'User' || CAST({K} AS STRING) || '@Example.COM' WHEN 1 THEN"
            f" ' a@b@c ' WHEN 2 THEN '@nobody' ELSE 'user' || CAST({K} AS STRING) || '@example.com' END",
            "phone": f"CASE {K} % 6 WHEN 0 THEN '(202) 555-' || lpad(CAST({K} % 10000 AS STRING), 4, '0')"
            f" WHEN 1 THEN '+44 20 7946 ' || lpad(CAST({K} % 10000 AS STRING), 4, '0') WHEN 2 THEN '12345'"
            f" WHEN 3 THEN '1-212-555-' || lpad(CAST({K} % 10000 AS STRING), 4, '0') WHEN 4 THEN 'call me'"
            " ELSE '' END",
            "street": f"CASE {K} % 4 WHEN 0 THEN CAST({K} AS STRING) || ' main st' WHEN 1 THEN '5 OAK ave. apt 2'"
            " WHEN 2 THEN '1  Elm Rd' ELSE 'Station Road' END",
            "city": f"CASE {K} % 3 WHEN 0 THEN 'new  york' WHEN 1 THEN 'PARIS' ELSE 'Rome' END",
            "country": f"CASE {K} % 7 WHEN 0 THEN 'USA' WHEN 1 THEN ' canada' WHEN 2 THEN 'United Kingdom' WHEN 3 THEN"
            " 'US' WHEN 4 THEN 'jp' WHEN 5 THEN '' ELSE 'Nowhere land' END",
            "state": f"CASE {K} % 5 WHEN 0 THEN 'california' WHEN 1 THEN 'Ontario' WHEN 2 THEN 'NY' WHEN 3 THEN"
            " ' new  york' ELSE 'Texas' END",
            "zip": f"CASE {K} % 4 WHEN 0 THEN lpad(CAST({K} AS STRING), 9, '1') WHEN 1 THEN 'k1a0b1' WHEN 2 THEN"
            f" lpad(CAST({K} % 100000 AS STRING), 5, '0') ELSE '12-34' END",
        },
    ),
    "measures": (
        "orders",
        {
            "row_index": O,
            "order_date": f"CASE {O} % 4 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) WHEN 1 THEN"
            " replace(CAST(CAST(o_orderdate AS DATE) AS STRING), '-', '') || 'T0930' WHEN 2 THEN"
            " CAST(CAST(o_orderdate AS DATE) AS STRING) || 'T08:15:30.5Z' ELSE 'soon' END",
            "time": f"CASE {O} % 5 WHEN 0 THEN '9:30' WHEN 1 THEN '0930' WHEN 2 THEN '09 30' WHEN 3 THEN"
            " '10:15:30+05' ELSE '23:59:59' END",
            "flag": f"CASE {O} % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN '0' WHEN 2 THEN 'TRUE' WHEN 3 THEN 'maybe' ELSE"
            " 'false' END",
            "amount": f"CASE {O} % 5 WHEN 0 THEN '1,' || lpad(CAST({O} % 1000 AS STRING), 3, '0') || '.50' WHEN 1"
            f" THEN '1.' || lpad(CAST({O} % 1000 AS STRING), 3, '0') || ',25' WHEN 2 THEN '12,' ||"
            f" lpad(CAST({O} % 1000 AS STRING), 3, '0') WHEN 3 THEN CAST({O} AS STRING) || ',5' ELSE"
            " CAST(o_totalprice AS STRING) END",
            "price": f"CASE {O} % 5 WHEN 0 THEN '€' || CAST({O} AS STRING) || ',50' WHEN 1 THEN '£ ' ||"
            f" CAST({O} AS STRING) WHEN 2 THEN '$1,' || lpad(CAST({O} % 1000 AS STRING), 3, '0') || '.5' WHEN 3 THEN"
            f" '¥1,' || lpad(CAST({O} % 1000 AS STRING), 3, '0') ELSE CAST({O} AS STRING) END",
        },
    ),
    "people": (
        "orders",
        {
            "row_index": O,
            "email": f"CASE WHEN {O} % 11 = 0 THEN '' WHEN {O} % 3 = 0 THEN ' U' || CAST(o_custkey AS STRING) ||"
            " '@X.com' ELSE 'u' || CAST(o_custkey AS STRING) || '@x.com' END",
            "name": "CASE o_orderpriority WHEN '1-URGENT' THEN 'Ann Lee' WHEN '2-HIGH' THEN 'ann  lee' WHEN"
            " '3-MEDIUM' THEN 'Bob' ELSE '' END",
            "zone": "o_orderstatus",
        },
    ),
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = FIXTURES[name]
    return load(spark, sf_dir, table).selectExpr(*[f"{e} AS {a}" for a, e in columns.items()])


def fixture_sql(name: str) -> str:
    table, columns = FIXTURES[name]
    return f"SELECT {', '.join(f'{e} AS {a}' for a, e in columns.items())} FROM {table}"


def cells(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> CellTable:
    return from_frame(fixture(spark, sf_dir, name), "row_index", columns)


def squeeze_sql(value: str) -> str:
    return f"trim(regexp_replace({value}, '[ \\t\\n\\r]+', ' ', 'g'))"


def fold_sql(value: str) -> str:
    return f"lower({squeeze_sql(value)})"
