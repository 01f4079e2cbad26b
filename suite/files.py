"""Queries over files that are written from whole driver tables and read again in small ranges."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from suite.base import load, query
from tidyledger.plans import order, verify
from tidyledger.session import ensure_checkpoint_dir
from tidyledger.sources import csv, sinks
from tidyledger.sources.tables import from_frame

RANGE = "64k"
PACKED = 1_024  # ranges that one task reads one after the other, once there are so many for every core
SLICES = 8  # slices of a table, at most, that are written and read back one after the other
SLICE_BYTES = 64 << 20  # of the table's files, for each further slice


def _folder(spark) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4()}"


def _bytes(spark, path: str) -> int:
    return spark.read.format("binaryFile").load(path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def _slices(rows: DataFrame, index: str, number: int) -> list[Column]:
    """Conditions that deal all rows to so many slices of about as many rows each, in order of the index.

    A row without an index is in the first one. With fewer distinct values of the index there are fewer slices.
    """
    shares = [n / number for n in range(1, number)]
    cuts = sorted(set(rows.agg(F.percentile_approx(index, shares)).first()[0] or [])) if shares else []
    slices = []
    for low, high in zip([None, *cuts], [*cuts, None]):
        above = F.lit(True) if low is None else F.col(index) > low
        upto = F.lit(True) if high is None else F.col(index) <= high
        slices.append(above & upto if low is not None else F.col(index).isNull() | upto)
    return slices


@contextmanager
def _ranges(spark, path: str, size: str = RANGE):
    """Files are cut into ranges of a size while a frame is read.

    Each range is read by itself, but a task takes many of them: tasks grow with the files' bytes far slower than ranges.
    """
    tasks = max(spark.sparkContext.defaultParallelism, _bytes(spark, path) // (PACKED * int(size.removesuffix("k")) * 1024))
    conf = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.maxPartitionNum": str(tasks)}
    before = {name: spark.conf.get(name, None) for name in conf}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


# ---- round trip of cells -------------------------------------------------------------------------

_TEXT = "replace(coalesce(text, ''), chr(13), ' ')"
_CELLS = {
    "doc_id": "CAST(doc_id AS STRING)",
    "plain": _TEXT,
    "quoted": f"'\"' || {_TEXT} || '\", \"' || source",
    "broken": f"chr(10) || {_TEXT} || chr(10) || chr(10)",
    "edges": "' ' || lang || ' '",
    "mixed": "CASE doc_id % 6 WHEN 0 THEN '\"\"' WHEN 1 THEN '\",' WHEN 2 THEN ',\"' || chr(10) || '\"' WHEN 3 THEN"
    " 'say \"hi\", ok' WHEN 4 THEN chr(10) ELSE '' END",
}
_DIGESTS = [c for c in _CELLS if c != "doc_id"]


def _round_trip_sql() -> str:
    digests = ", ".join(f"sha256({e}) AS {c}" for c, e in _CELLS.items() if c != "doc_id")
    return f"SELECT {_CELLS['doc_id']} AS doc_id, {digests} FROM documents"


@query("csv_round_trip", _round_trip_sql())
def csv_round_trip(spark, sf_dir):
    """Cells with quotes, delimiters and line breaks in every mixture, written as CSV and read back in 64 KB ranges.

    Files hold each text three times over, so a large table goes through them slice by slice: the files of one are gone
    before those of the next are written. Rows are sorted before their cells are made, which moves a text once.
    """
    documents = load(spark, sf_dir, "documents")
    number = min(SLICES, 1 + _bytes(spark, f"{sf_dir}/documents.parquet") // SLICE_BYTES)
    found = None
    for one in _slices(documents, "doc_id", number):
        rows = documents.where(one).select("doc_id", "text", "lang", "source").orderBy("doc_id")
        made = rows.selectExpr("doc_id AS row_index", *[f"{e} AS {c}" for c, e in _CELLS.items()])
        folder = _folder(spark)
        path = sinks.write_csv(from_frame(made, "row_index"), folder, "org", "run", in_order=True)
        with _ranges(spark, path + "/part-*"):
            back = csv.read_csv(spark, path + "/part-*", delimiter=",").table.named()
        told = back.select("doc_id", *[F.sha2(c, 256).alias(c) for c in _DIGESTS]).checkpoint()
        sinks.remove(spark, folder)
        found = told if found is None else found.unionByName(told)
    return found


# ---- fingerprints of files -----------------------------------------------------------------------

_PIECES = ", ".join(
    f"sum(CAST('0x' || substr(leaf, {1 + 15 * n}, 15) AS BIGINT)) AS p{n}" for n in range(csv.PIECES)
)
_LINES = """WITH lines AS (
        SELECT o_orderstatus AS status, o_orderkey % 16 AS bucket, CAST(o_orderkey AS VARCHAR) || ',' || CAST(o_custkey AS
            VARCHAR) || ',é ' || o_orderpriority AS line, row_number() OVER (PARTITION BY o_orderstatus, o_orderkey % 16
            ORDER BY o_orderkey) - 1 AS place FROM orders),
    leaves AS (SELECT *, sha256(CAST(place AS VARCHAR) || ':' || line) AS leaf FROM lines),"""
_FILES = f"""{_LINES}
    files AS (SELECT status, bucket, CAST(sum(strlen(line) + 1) AS BIGINT) AS size_bytes, count(*) AS lines, {_PIECES}
        FROM leaves GROUP BY ALL),
    told AS (SELECT status, bucket, size_bytes, lines,
        sha256(concat_ws(':', size_bytes, lines, p0, p1, p2, p3)) AS digest FROM files)"""


def _written(spark, sf_dir) -> str:
    """Orders as text, one file per status and bucket."""
    lines = load(spark, sf_dir, "orders").selectExpr(
        "o_orderstatus AS status", "o_orderkey % 16 AS bucket", "o_orderkey",
        "concat(CAST(o_orderkey AS STRING), ',', CAST(o_custkey AS STRING), ',é ', o_orderpriority) AS value",
    )
    path = _folder(spark)
    dealt = lines.repartition("status", "bucket").sortWithinPartitions("status", "bucket", "o_orderkey")
    dealt.select("status", "bucket", "value").write.partitionBy("status", "bucket").text(path)
    return path


def _placed(files):
    return files.withColumns(
        {
            "status": F.regexp_extract("path", "status=([^/]*)/", 1),
            "bucket": F.regexp_extract("path", "bucket=([0-9]+)/", 1).cast("long"),
        }
    )


@query("source_manifest", f"{_FILES} SELECT *, 'utf-8' AS encoding FROM told")
def source_manifest(spark, sf_dir):
    """Size, lines, digest and encoding of files that are read in 64 KB ranges."""
    path = _written(spark, sf_dir)
    with _ranges(spark, f"{path}/*/*/*.txt"):
        found = csv.fingerprints(spark, f"{path}/*/*/*.txt").checkpoint()
    return _placed(found).select("status", "bucket", "size_bytes", "lines", "digest", "encoding")


_OUTCOME = """CASE WHEN bucket % 7 = 3 THEN 'purged' WHEN bucket % 5 = 2 THEN 'file_missing' WHEN bucket % 3 = 1 THEN
    'integrity_failed' ELSE 'completed' END"""
_REASON = """CASE WHEN bucket % 7 = 3 THEN NULL WHEN bucket % 5 = 2 THEN 'file_not_found' WHEN bucket % 3 = 1 THEN
    'hash_mismatch' END"""


@query(
    "verify_outputs",
    f"{_FILES} SELECT status || '-' || CAST(bucket AS VARCHAR) AS run_id, {_OUTCOME} AS outcome,"
    f" {_REASON} AS failure_reason_code FROM told WHERE status <> 'P'",
)
def verify_outputs(spark, sf_dir):
    """Recorded digests of outputs, some altered, gone or deleted, against the files read again in other ranges."""
    path = _written(spark, sf_dir)
    recorded = _placed(csv.fingerprints(spark, f"{path}/*/*/*.txt").checkpoint())
    runs = recorded.select(
        F.concat_ws("-", "status", "bucket").alias("id"),
        F.when(F.col("status") == "P", "pending_review").when(F.col("status") == "F", "approved").otherwise("rolled_back")
        .alias("status"),
        F.when(F.col("bucket") % 5 == 2, F.concat("path", F.lit(".gone"))).otherwise(F.col("path")).alias("output_file_path"),
        F.when(F.col("bucket") % 3 == 1, F.sha2("digest", 256)).otherwise(F.col("digest")).alias("output_sha256"),
        F.when(F.col("bucket") % 7 == 3, F.current_timestamp()).alias("output_deleted_at"),
    )
    with _ranges(spark, f"{path}/*/*/*.txt"):
        files = csv.fingerprints(spark, f"{path}/*/*/*.txt").checkpoint()
    return verify.verify_outputs(runs, files.select("path", F.col("digest").alias("sha256")))


# ---- order under an index that is not dense --------------------------------------------------------

# Unique numbers strewn over a million million.
_SPARSE = "((l_orderkey * 10 + l_linenumber) * 2654435761) % 1000000000039"


@query(
    "number_sparse_index",
    f"SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY {_SPARSE}) - 1 AS position FROM lineitem",
)
def number_sparse_index(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{_SPARSE} AS place")
    return order.number_rows(rows, "place", "position").drop("place")


@query(
    "first_of_sparse_index",
    f"SELECT l_orderkey, l_linenumber, {_SPARSE} AS place FROM lineitem ORDER BY place LIMIT 2000",
)
def first_of_sparse_index(spark, sf_dir):
    """The head of a log in index order: the limit is the feature."""
    rows = load(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{_SPARSE} AS place")
    return order.first_rows(rows, "place", 2000)
