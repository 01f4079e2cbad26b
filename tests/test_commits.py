"""One result per run, however attempts meet or die."""

import threading

import pytest

from tidyledger.sources import sinks

SCHEMA = "task_run_id string, organization_id string, n int"


def stored(spark, log):
    rows = sinks.read_if_present(spark, log)
    return set() if rows is None else {(r.organization_id, r.task_run_id, r.n) for r in rows.collect()}


def rows(spark, run, n, number=6):
    return spark.createDataFrame([(run, "org", n)] * number, SCHEMA).repartition(3)


def test_two_attempts_interleaved(spark, tmp_path, monkeypatch):
    """Both have written their rows when the first one commits; the second one's rows are never seen."""
    log, put, met = str(tmp_path / "log"), sinks._Folder.put_if_absent, threading.Barrier(2, timeout=60)

    def together(self, name, content):
        met.wait()
        return put(self, name, content)

    monkeypatch.setattr(sinks._Folder, "put_if_absent", together)
    attempts = [threading.Thread(target=sinks.append_once, args=(rows(spark, "r1", n), log)) for n in (1, 2)]
    for attempt in attempts:
        attempt.start()
    for attempt in attempts:
        attempt.join()
    read = sinks.read_if_present(spark, log)
    assert read.count() == 6 and read.select("n").distinct().count() == 1
    assert spark.read.parquet(log).count() == 6


def test_death_before_and_after_the_commit(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "log")

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(sinks._Folder, "put_if_absent", die)
        with pytest.raises(RuntimeError):
            sinks.append_once(rows(spark, "r1", 1), log)
    assert stored(spark, log) == set()
    with monkeypatch.context() as patch:
        patch.setattr(sinks, "_publish", die)
        with pytest.raises(RuntimeError):
            sinks.append_once(rows(spark, "r1", 2), log)
    assert stored(spark, log) == set()
    sinks.append_once(rows(spark, "r1", 3), log)  # the second attempt is the result; this one brings it to light
    assert stored(spark, log) == {("org", "r1", 2)} and spark.read.parquet(log).count() == 6


def test_a_run_that_dies_between_two_logs(spark, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    sinks.append_once(rows(spark, "r1", 1), one)  # and dies here
    for log in (one, two):
        sinks.append_once(rows(spark, "r1", 2), log)
    assert stored(spark, one) == {("org", "r1", 1)} and stored(spark, two) == {("org", "r1", 2)}


def test_many_runs_and_tenants_in_one_call(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "log")
    first = [(f"r{i}", f"org{i % 3}", i) for i in range(8)]
    sinks.append_once(spark.createDataFrame(first[:3], SCHEMA), log)
    sinks.append_once(spark.createDataFrame([(r, o, n + 100) for r, o, n in first], SCHEMA), log)
    assert stored(spark, log) == {(o, r, n if n < 3 else n + 100) for r, o, n in first}
    monkeypatch.setattr(sinks, "MOST_RUNS", 2)
    with pytest.raises(ValueError):
        sinks.append_once(spark.createDataFrame(first, SCHEMA), log)
