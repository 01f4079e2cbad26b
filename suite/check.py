"""Run registered queries next to their SQL and compare: ``python -m suite.check [sf_dir] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def oracle_connection(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return connection


def _norm(value):
    import datetime
    import decimal

    if value is None:
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        return repr(round(float(value), 9))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def rows_of(columns, tuples):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(_norm(t[i]) for i in order) for t in tuples), key=lambda t: [(v is None, v or "") for v in t]
    )


def compare(spark, connection, sf_dir: str, name: str) -> str | None:
    """None when equal, else what differs. Queries without SQL only have to run."""
    from suite import ORACLES, QUERIES

    frame = QUERIES[name](spark, sf_dir)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if name not in ORACLES:
        return None
    cursor = connection.execute(ORACLES[name])
    expected = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != expected[0]:
        return f"columns {got[0]} != {expected[0]}"
    if len(got[1]) != len(expected[1]):
        return f"{len(got[1])} rows != {len(expected[1])}"
    bad = [(a, b) for a, b in zip(got[1], expected[1]) if a != b]
    if bad:
        return f"{len(bad)} rows differ, e.g. {str(bad[0][0])[:300]} != {str(bad[0][1])[:300]}"
    return "empty" if not expected[1] else None


def main(arguments: list[str]) -> int:
    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 8g pyspark-shell")
    from suite import ORACLES, QUERIES
    from tidyledger.session import build_session

    sf_dir = arguments[0] if arguments else "/root/testdata/sf0.01"
    names = [n for n in QUERIES if not arguments[1:] or any(n.startswith(a) for a in arguments[1:])]
    spark = build_session(
        "check", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, failures = oracle_connection(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, connection, sf_dir, name)
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failures += problem is not None
        kind = "" if name in ORACLES else " (rows only)"
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - start:6.2f}s {name}{kind} {problem or ''}", flush=True)
    return failures


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
