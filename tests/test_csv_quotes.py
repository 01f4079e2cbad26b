"""Records and cells of the CSV scan against Python's csv module, in splits of a few bytes."""

import csv as reference
import io
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidyledger.sources import csv

SIGNS = ['"', '""', ",", ";", "\n", " ", "a", "é漢", '",', ',"', '"\n', '\n"', "\n\n", "﻿", "x" * 40, '"",']


def texts(seed, number):
    draw = random.Random(seed)
    return ["".join(draw.choice(SIGNS) for _ in range(draw.randrange(60))) for _ in range(number)]


def wanted(text, delimiter):
    return list(reference.reader(io.StringIO(text.removeprefix("﻿"), newline=""), delimiter=delimiter))


def bare(rows):
    """Where a quote is open at the end of a file, the last line end of the file is no part of the cell here."""
    return rows[:-1] + [[*rows[-1][:-1], rows[-1][-1].rstrip("\n")] if rows[-1] else []]


@pytest.mark.parametrize("delimiter,split", [(",", "48"), (";", "100"), (",", "1m")])
def test_any_text_reads_as_by_the_csv_module(spark, tmp_path, delimiter, split):
    made = {f"{i:04}.csv": t for i, t in enumerate(texts(len(split), 150)) if t.removeprefix("﻿")}
    for name, text in made.items():
        (tmp_path / name).write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        found = csv.records(spark, str(tmp_path), delimiter)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    rows = found.select("file", "record", csv._values(F.col("text"), delimiter).alias("cells")).collect()
    got = {name: {} for name in made}
    for r in rows:
        got[r.file.rsplit("/", 1)[1]][r.record] = r.cells
    for name, text in made.items():
        expected = wanted(text, delimiter)
        assert bare([got[name][n] for n in sorted(got[name])]) == bare(expected), repr(text)
        assert sorted(got[name]) == list(range(len(expected)))


@pytest.mark.parametrize("lines,blocks,tasks", [(1, 1_000_000, 3), (7, 1_000_000, 3), (10_000, 1_000_000, 3), (3, 0, 3)])
def test_any_text_in_batches_of_tasks_that_read_many_splits(spark, tmp_path, monkeypatch, lines, blocks, tasks):
    """Records that cross batches, splits and tasks; blocks whose places are not broadcast."""
    monkeypatch.setattr(csv, "BROADCAST_BLOCKS", blocks)
    conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(lines), "spark.sql.files.maxPartitionNum": str(tasks)}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        test_any_text_reads_as_by_the_csv_module(spark, tmp_path, ",", "64")
    finally:
        for name in conf:
            spark.conf.unset(name)


def test_quotes_before_a_delimiter_inside_a_cell(spark, tmp_path):
    path = tmp_path / "said.csv"
    path.write_text('id,said\n1,"He said ""hi"", then left"\n2,plain\n3,"say ""a"""\n4,5" pipe\n')
    scan = csv.read_csv(spark, str(path))
    rows = [(r.c0, r.c1) for r in scan.table.frame.orderBy("row_index").collect()]
    assert rows == [("1", 'He said "hi", then left'), ("2", "plain"), ("3", 'say "a"'), ("4", '5" pipe')]
    assert scan.issues.count() == 0


def test_very_long_records(spark, tmp_path):
    path = tmp_path / "long.csv"
    many = '""' * 100_000
    path.write_text(f'a,b\n"{many}",1\n' + "x," * 50_000 + "end\n" + '"' + "line\n" * 20_000 + '",2\n')
    scan = csv.read_csv(spark, str(path))
    rows = scan.table.frame.orderBy("row_index").collect()
    assert [(len(r.c0), r.c1) for r in rows] == [(100_000, "1"), (1, "x"), (100_000, "2")]
    assert [(r.type, r.row_number, r.field_count) for r in scan.issues.collect()] == [("too_many_fields", 3, 50_001)]


def test_a_scan_stores_its_text_once(spark, tmp_path):
    """Lines, records and cells were each stored, and lines shuffled twice; text that comes again takes no room again."""
    draw = random.Random(5)
    texts = ["".join(draw.choice('abcdefghijklmnop \n"') for _ in range(2_000)) for _ in range(300)]
    path = tmp_path / "thrice.csv"
    with path.open("w", newline="") as out:
        reference.writer(out, lineterminator="\n").writerows([["a", "b", "c"], *([t] * 3 for t in texts)])
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = set(folder.rglob("*"))
    scan = csv.read_csv(spark, str(path), delimiter=",")
    stored = sum(p.stat().st_size for p in set(folder.rglob("*")) - before if p.is_file())
    assert [tuple(r) for r in scan.table.frame.orderBy("row_index").select("c0", "c1", "c2").collect()] == [(t,) * 3 for t in texts]
    assert stored < path.stat().st_size / 2


def slow_digest(content):
    import hashlib

    lines = content.removeprefix(b"\xef\xbb\xbf").split(b"\n")
    lines = lines[:-1] if not lines[-1] else lines
    leaves = [hashlib.sha256(b"%d:" % n + line).hexdigest() for n, line in enumerate(lines)]
    parts = [sum(int(leaf[15 * n : 15 * n + 15], 16) for leaf in leaves) for n in range(4)]
    return hashlib.sha256(":".join(map(str, [len(content), len(lines), *parts])).encode()).hexdigest()


def test_fingerprints_at_any_range_size(spark, tmp_path):
    draw = random.Random(3)
    body = "".join(draw.choice(["é", "漢", "\n", "a", "\r\n", '"', "😀" * 9]) for _ in range(3_000)).encode()
    made = {
        "plain": body + b"\n", "open": body + b"x", "marked": b"\xef\xbb\xbf" + body + b"\n", "marked_open": b"\xef\xbb\xbfend",
        "cut": body + "é".encode()[:1] + b"\n" + body, "long": b"y" * 70_000, "line": b"\n",
    }
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("97", "5k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            found = csv.fingerprints(spark, str(tmp_path)).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        told = {r.path.rsplit("/", 1)[1]: (r.size_bytes, r.digest, r.encoding) for r in found}
        kinds = {"cut": None, "marked": "utf-8-sig", "marked_open": "utf-8-sig"}
        assert told == {n: (len(c), slow_digest(c), kinds.get(n, "utf-8")) for n, c in made.items()}


def test_files_too_large_for_a_row_are_listed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(csv, "WHOLE_FILE", 5)
    (tmp_path / "small").write_bytes(b"a,b\n")
    (tmp_path / "large").write_bytes(b"a,b\n1,2\n")
    sums = {r.path.rsplit("/", 1)[1]: r.sha256 is None for r in csv.manifest(spark, str(tmp_path)).collect()}
    assert sums == {"small": False, "large": True}
    assert csv.fingerprints(spark, str(tmp_path)).count() == 2
