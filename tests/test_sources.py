import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidyledger import config
from tidyledger.operators import profile
from tidyledger.plans import audit, review_actions, stages, verify
from tidyledger.sources import csv, sinks
from tidyledger.sources.tables import CellTable, from_frame, read_parquet, read_tenant
from tidyledger.streaming import rowlocal


def put(tmp_path, name, content):
    path = tmp_path / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def rows_of(table):
    return [tuple(r[c] for c in table.cells) for r in table.frame.orderBy("row_index").collect()]


def test_ragged_rows_and_headers(spark, tmp_path):
    path = put(tmp_path, "ragged.csv", "name,name,\nage,20\nshort\nextra,field,ignored,overflow\n\"a,b\",\"x\ny\",z\n")
    scan = csv.read_csv(spark, path)
    assert scan.table.headers == ("name", "name", "")
    assert rows_of(scan.table) == [
        ("age", "20", ""), ("short", "", ""), ("extra", "field", "ignored"), ("a,b", "x\ny", "z"),
    ]
    issues = {(r.type, r.column_index, r.first_column_index, r.row_number, r.field_count) for r in scan.issues.collect()}
    assert issues == {
        ("blank_header", 2, None, None, None), ("duplicate_header", 1, 0, None, None),
        ("too_few_fields", None, None, 2, 2), ("too_few_fields", None, None, 3, 1),
        ("too_many_fields", None, None, 4, 4),
    }


@pytest.mark.parametrize("delimiter", [",", ";", "\t", "|"])
def test_delimiters(spark, tmp_path, delimiter):
    lines = [["id", "name", "amount"], ["1", "Ada Lovelace", "42.0"], ["2", "Grace", ""]]
    path = put(tmp_path, "d.csv", "\n".join(delimiter.join(line) for line in lines) + "\n")
    scan = csv.read_csv(spark, path)
    assert scan.delimiter == delimiter
    assert rows_of(scan.table) == [("1", "Ada Lovelace", "42.0"), ("2", "Grace", "")]


def test_bom_and_fingerprint(spark, tmp_path):
    content = b"\xef\xbb\xbfname\nvalue\n"
    scan = csv.read_csv(spark, put(tmp_path, "bom.csv", content))
    assert scan.table.headers == ("name",) and rows_of(scan.table) == [("value",)]
    row = scan.manifest.first()
    assert (row.encoding, row.size_bytes, row.sha256) == ("utf-8-sig", len(content), hashlib.sha256(content).hexdigest())


def test_limits(spark, tmp_path):
    path = put(tmp_path, "l.csv", "a,b\n1,2\n3,444\n")
    for limits in (
        config.ScanLimits(max_file_size_bytes=5), config.ScanLimits(max_rows=1),
        config.ScanLimits(max_columns=1), config.ScanLimits(max_cell_length=2),
    ):
        with pytest.raises(csv.ScanError):
            csv.read_csv(spark, path, limits)
    with pytest.raises(csv.ScanError):
        csv.read_csv(spark, put(tmp_path, "bad.csv", b"a,b\n\xff\xfe,1\n"))
    with pytest.raises(csv.ScanError):
        csv.read_csv(spark, put(tmp_path, "none.csv", b""))


def test_rows_of_many_files_are_numbered_in_order(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    expected = []
    for i in range(4):
        values = [f"f{i}r{j}" for j in range(i + 1)]
        (folder / f"part{i}.csv").write_text("v,w\n" + "".join(f"{v},1\n" for v in values))
        expected += values
    scan = csv.read_csv(spark, str(folder))
    assert [r[0] for r in rows_of(scan.table)] == expected
    assert [r.row_index for r in scan.table.frame.orderBy("row_index").collect()] == list(range(10))


def test_parquet_rows_are_numbered_in_order(spark, sf_dir):
    table = read_parquet(spark, f"{sf_dir}/customer.parquet", ["c_custkey"])
    assert table.frame.where("cast(c0 as long) <> row_index").count() == 0
    assert table.frame.count() == spark.read.parquet(f"{sf_dir}/customer.parquet").count()


def test_profile_fixture(spark, tmp_path):
    text = "id,active,joined,amount,note\n1,true,2026-01-01,10.50,alpha\n2,false,2026-01-02,20,beta\n" \
        "2,false,2026-01-02,20,beta\n,yes,not-a-date,bad,gamma\n"
    table = csv.read_csv(spark, put(tmp_path, "p.csv", text)).table
    by_name = {r.name: r for r in profile.column_profiles(table).collect()}
    assert by_name["id"].missing_count == 1 and by_name["id"].missing_percentage == 25.0
    assert by_name["active"].inferred_type == "boolean"
    assert by_name["joined"].inferred_type == "mixed" and by_name["joined"].inconsistent_value_count == 4
    assert by_name["amount"].observed_type_counts == {"decimal": 1, "integer": 2, "string": 1}
    assert by_name["note"].sample_values == ["alpha", "beta", "gamma"]
    whole = profile.table_profile(table).first()
    assert (whole.row_count, whole.column_count, whole.duplicate_row_count, whole.missing_value_total) == (4, 5, 1, 1)
    empty = csv.read_csv(spark, put(tmp_path, "e.csv", "only\n")).table
    row = profile.column_profiles(empty).first()
    assert (row.inferred_type, row.missing_percentage, row.distinct_count, row.sample_values) == ("null", 0.0, 0, [])


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([(0, 'a"b', ""), (1, "x,y", "z")], "row_index bigint, h string, i string")
    table = from_frame(frame, "row_index")
    path = sinks.write_csv(table, str(tmp_path / "out"), "org", "run", single_file=True)
    assert rows_of(csv.read_csv(spark, path + "/part-*", delimiter=",").table) == [('a"b', ""), ("x,y", "z")]
    found = sinks.output_manifest(spark, path).first()
    assert found.file_count == 1 and found.output_file_size_bytes > 0 and len(found.output_sha256) == 64
    shuffled = table.with_frame(table.frame.orderBy(F.desc("row_index")))
    assert sinks.content_hash(table).first() == sinks.content_hash(shuffled).first()
    other = table.with_frame(table.frame.withColumn("c1", F.lit("q")))
    assert sinks.content_hash(other).first() != sinks.content_hash(table).first()

    log = str(tmp_path / "log")
    first = spark.createDataFrame([("r1", "org", 1)], "task_run_id string, organization_id string, n int")
    again = spark.createDataFrame([("r1", "org", 2), ("r2", "other", 3)], first.schema)
    sinks.append_once(first, log)
    sinks.append_once(again, log)
    assert {(r.task_run_id, r.n) for r in spark.read.parquet(log).collect()} == {("r1", 1), ("r2", 3)}
    assert sinks.read_audit(spark, log, "org").count() == 1
    assert read_tenant(spark, log, "other").first().organization_id == "other"


def test_verify_outputs(spark, tmp_path):
    good, bad = put(tmp_path, "g.csv", "a\n1\n"), put(tmp_path, "b.csv", "a\n2\n")
    files = csv.manifest(spark, str(tmp_path / "*.csv")).withColumn("path", F.regexp_replace("path", "^file:", ""))
    digest = hashlib.sha256(b"a\n1\n").hexdigest()
    runs = spark.createDataFrame(
        [
            ("1", "approved", good, digest, None), ("2", "rolled_back", bad, digest, None),
            ("3", "approved", "/none", digest, None), ("4", "approved", good, digest, "2024"),
            ("5", "pending_review", good, digest, None),
        ],
        "id string, status string, output_file_path string, output_sha256 string, output_deleted_at string",
    )
    got = {(r.run_id, r.outcome, r.failure_reason_code) for r in verify.verify_outputs(runs, files).collect()}
    assert got == {
        ("1", "completed", None), ("2", "integrity_failed", "hash_mismatch"),
        ("3", "file_missing", "file_not_found"), ("4", "purged", None),
    }


def test_all_stages_end_to_end(spark, tmp_path):
    people = put(
        tmp_path, "in.csv",
        'id,first_name,email\n1,"  jane   doe  ",Jane@Example.com\n2,bob smith,BOB@EXAMPLE.COM\n'
        "3,bob  smith,bob@example.com\n3,bob smith,bob@example.com\n",
    )
    ws = stages.Workspace(spark, str(tmp_path / "ws"), "org1")
    stages.run_profile(ws, people, "p1")
    stages.run_clean(ws, "p1", "c1")
    with pytest.raises(stages.GateError):
        stages.run_standardize(ws, "c1", "s1")
    ws.decide("cleaning_runs", "c1", "approved")
    stages.run_standardize(ws, "c1", "s1")
    ws.decide("standardization_runs", "s1", "approved")
    rules = config.MatchRules(0.9, 0.4, (config.MatchField("email"),))
    stages.run_match(ws, "s1", "m1", rules)
    ws.decide("match_runs", "m1", "approved")
    stages.run_export(ws, "m1", "e1")
    stages.run_export(ws, "m1", "e1")
    done = ws.result("export_runs", "e1")
    assert (done.source_row_count, done.row_count, done.excluded_row_count, done.output_column_count) == (4, 2, 2, 5)
    assert ws.read("export_runs").count() == 1
    rows = rows_of(ws.load_rows("exported", "e1", done.headers))
    assert rows == [("1", "Jane Doe", "jane@example.com", "True", "0"), ("2", "Bob Smith", "bob@example.com", "True", "1")]
    assert {r.rule_name for r in ws.read("cleaning_changes").collect()} == {"trim_whitespace"}
    assert ws.read("match_decisions").count() == 3 - 1
    ws.decide("match_runs", "m1", "rolled_back")
    with pytest.raises(stages.GateError):
        stages.run_export(ws, "m1", "e2")


def test_review_actions_small(spark):
    runs = spark.createDataFrame([("a", "pending_review"), ("b", "approved"), ("c", "rejected")], "id string, status string")
    acts = spark.createDataFrame(
        [
            ("1", "a", "approve", "u", 1), ("2", "a", "reject", "u", 2), ("3", "a", "rollback", "v", 3),
            ("4", "a", "rollback", "v", 4), ("5", "b", "approve", "u", 1), ("6", "c", "rollback", "u", 1),
        ],
        "action_id string, run_id string, action string, actor string, acted_at int",
    )
    updated, conflicts = review_actions.apply_actions(runs, acts)
    assert {(r.id, r.status) for r in updated.collect()} == {("a", "rolled_back"), ("b", "approved"), ("c", "rejected")}
    assert {(r.action_id, r.detail.split("'")[1]) for r in conflicts.collect()} == {
        ("2", "approved"), ("4", "rolled_back"), ("5", "approved"), ("6", "rejected"),
    }


def test_page_bounds(spark):
    with pytest.raises(ValueError):
        audit.page(spark.range(1), "events", limit=101)


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    frame = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_acctbal")
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    out = rowlocal.clean_stream(stream, "c_custkey", ["string", "decimal"])
    rowlocal.write_available(out, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    batch = rowlocal.clean_stream(frame, "c_custkey", ["string", "decimal"])
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(batch.collect())
    other = rowlocal.standardize_stream(stream, "c_custkey", ["person_name", None])
    rowlocal.write_available(other, str(tmp_path / "out2"), str(tmp_path / "ckpt2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out2")).count() == frame.count()


def test_blank_records_long_cells_and_line_breaks(spark, tmp_path):
    long = "x" * 100_000
    path = put(tmp_path, "odd.csv", f'"a\nx",b\n1,2\n\n"{long}",4\n"p\n\nq","r ""s"""\n5" pipe,6\n')
    scan = csv.read_csv(spark, path)
    assert scan.table.headers == ("a\nx", "b")
    assert rows_of(scan.table) == [("1", "2"), ("", ""), (long, "4"), ("p\n\nq", 'r "s"'), ('5" pipe', "6")]
    assert [(r.type, r.row_number, r.field_count) for r in scan.issues.collect()] == [("too_few_fields", 3, 0)]


def test_a_folder_of_differing_headers_is_refused(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "f" / "b.csv").write_text("y,x\n1,2\n")
    with pytest.raises(csv.ScanError):
        csv.read_csv(spark, str(tmp_path / "f"))


def test_delimiter_of_the_first_characters(spark, tmp_path):
    text = "a;b\n1;2\n" + "3;4\n" * 3000 + "5,6,7,8\n" * 50
    assert csv.detect_delimiter(spark, put(tmp_path, "s.csv", text)) == ";"
    assert csv.header_issues(("A", "", "a", "ß", "SS", "")) == [
        ("blank_header", 1, None), ("blank_header", 5, None), ("duplicate_header", 2, 0),
        ("duplicate_header", 4, 3), ("duplicate_header", 5, 1),
    ]


def test_written_cells_and_headers_are_exact(spark, tmp_path):
    rows = [(0, "  lead", "tail  "), (1, "", "a\nb"), (2, 'q"', ""), (3, "1", " ")]
    frame = spark.createDataFrame(rows, "row_index bigint, h string, i string")
    table = CellTable(from_frame(frame, "row_index").frame, ("h", "h"))
    for single in (True, False):
        path = sinks.write_csv(table, str(tmp_path / str(single)), "org", "run", single)
        back = csv.read_csv(spark, path + "/part-*", delimiter=",").table
        assert back.headers == ("h", "h") and rows_of(back) == [r[1:] for r in rows]
    none = CellTable(table.frame.limit(0), ("h", "h"))
    assert spark.read.text(sinks.write_csv(none, str(tmp_path / "none"), "org", "run")).collect()[0][0] == "h,h"


def test_json_of_any_depth_is_scanned(spark):
    from tidyledger.functions.jsonscan import secret_keys, secret_path

    deep = '{"a":' * 30_000 + '{"Api_Key": 1}' + "}" * 30_000
    rows = [('{"a": [{"b": 1}, {"dbPassword": 2}], "token": 3}',), ("[[]]",), (None,), ("no json token:",), (deep,),
            ('{"x": {"pw\\u0064": 1}}',), ('{"note": "secret: x"}',)]
    found = [r.p for r in secret_keys(spark.createDataFrame(rows, "j string").coalesce(1), "j", "p").collect()]
    assert found[:4] == ["a[1].dbPassword", None, None, None]
    assert found[4].endswith("Api_Key") and found[5:] == ["x.pwd", None]
    assert secret_path('{"a": {"b": 1}, "secret": {"token": 1}}') == "secret"


def test_search_text_with_a_backslash(spark, sf_dir):
    from suite.operations import _views
    from tidyledger.plans import review_queue

    tables = _views(spark, sf_dir)
    found = [review_queue.filtered(tables, "org1", review_queue.Filters(search=t)).count() for t in ("a\\m", "%a%", "mach")]
    assert found[0] == 0 and found[1] >= found[2] > 0


def test_a_task_reads_many_small_ranges(spark, tmp_path):
    """Ranges of 64 KB stay, but a task takes more than one of them."""
    from suite.files import _ranges

    (tmp_path / "a.txt").write_text("x" * 99 + "\n" + ("y" * 99 + "\n") * 40_000)
    with _ranges(spark, str(tmp_path)):
        lines = spark.read.text(str(tmp_path)).select("_metadata.file_block_start", "value")
        assert lines.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism + 1
        assert lines.select("file_block_start").distinct().count() == 62
        assert lines.count() == 40_001
    assert spark.conf.get("spark.sql.files.maxPartitionNum", None) is None


def test_round_trip_by_slices_leaves_no_files(spark, tmp_path, monkeypatch):
    """Every document comes back, whatever slice its number puts it in, and only one slice has files at a time."""
    from suite import files

    rows = [(n % 40 if n % 7 else None, f'"t{n}",\nx' * (n % 5), "en" if n % 3 else None, "web") for n in range(100)]
    made = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    made.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(files, "SLICE_BYTES", 100)
    written, seen = [], []
    write = sinks.write_csv

    def noted(table, folder, *args, **more):
        seen.extend(p for p in written if Path(p.removeprefix("file:")).exists())
        written.append(write(table, folder, *args, **more))
        return written[-1]

    monkeypatch.setattr(files.sinks, "write_csv", noted)
    got = files.csv_round_trip(spark, str(tmp_path)).collect()
    cells = made.selectExpr(*[f"sha2({e}, 256) AS {c}" if c != "doc_id" else f"{e} AS doc_id" for c, e in files._CELLS.items()])
    blank = hashlib.sha256(b"").hexdigest()
    expected = [("" if r[0] is None else r[0], *(blank if v is None else v for v in r[1:])) for r in cells.collect()]
    assert sorted(map(tuple, got)) == sorted(expected)
    assert len(written) == files.SLICES and not seen
    assert not any(Path(p.removeprefix("file:")).exists() for p in written)


@pytest.mark.parametrize("indexes", [[], [None] * 3, [5] * 9, [None, 1, 1, 1, 2, 9, 9, 9, 9]])
def test_slices_have_every_row_once(spark, indexes):
    from suite.files import _slices

    rows = spark.createDataFrame([(i,) for i in indexes], "i bigint")
    taken = [r.i for one in _slices(rows, "i", 4) for r in rows.where(one).collect()]
    assert sorted(taken, key=str) == sorted(indexes, key=str)
