"""CSV and audit sinks: idempotent per run, fingerprinted after the write."""

from __future__ import annotations

import hashlib
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyledger.sources.csv import manifest
from tidyledger.sources.tables import ROW, CellTable


def write_csv(
    table: CellTable, root: str, organization_id: str, run_id: str, single_file: bool = False, in_order: bool = False
) -> str:
    """Rows in order under ``root/organization/run``; one file only on request, as it means one task.

    A frame told to be ``in_order`` is not sorted again. Cells and headers are written exactly as they are, white space and repeated names included: each part file is
    plain text that starts with the header line, and only cells that need it are quoted.
    """
    path = f"{root}/{organization_id}/{run_id}"
    ordered = table.frame if in_order else table.frame.orderBy(ROW)
    if single_file:
        ordered = ordered.coalesce(1)
    header = ",".join(map(_quoted_name, table.headers))
    cells = [_quoted(F.col(c)) for c in table.cells]
    place = F.monotonically_increasing_id()
    lines = ordered.select(place.bitwiseAND((1 << 33) - 1).alias("_at"), F.concat_ws(",", *cells).alias("value"))
    # The first row of each part brings the header line with it; an empty table is the header line alone.
    headed = lines.select(F.when(F.col("_at") == 0, F.concat(F.lit(f"{header}\n"), "value")).otherwise(F.col("value")).alias("value"))
    if table.frame.isEmpty():
        headed = table.frame.sparkSession.createDataFrame([(header,)], "value string").coalesce(1)
    headed.write.mode("overwrite").text(path)
    return path


def _quoted(cell: Column) -> Column:
    """Cell of a CSV line: in quotes where it holds a delimiter, a quote, a line break or white space at an edge."""
    needs = cell.rlike(r'[",\r\n]|^\s|\s$')
    return F.when(needs, F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)


def _quoted_name(name: str) -> str:
    return '"' + name.replace('"', '""') + '"' if re.search(r'[",\r\n]|^\s|\s$', name) else name


def output_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row: files, total bytes, and a digest over the part digests in path order."""
    parts = manifest(spark, f"{path}/part-*")
    listed = F.sort_array(F.collect_list(F.struct("path", "sha256")))
    return parts.agg(
        F.count(F.lit(1)).alias("file_count"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("output_file_size_bytes"),
        F.sha2(F.concat_ws("\n", listed["sha256"]), 256).alias("output_sha256"),
    )


def content_hash(table: CellTable) -> DataFrame:
    """Digest of rows and their positions that needs no ordering: parts of each row's SHA-256 summed over all rows."""
    row = F.sha2(F.concat_ws("\u0001", F.col(ROW).cast("string"), *table.cells), 256)
    parts = [F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 16)]
    sums = [F.coalesce(F.sum(p), F.lit(0)).cast("string") for p in parts]
    return table.frame.agg(
        F.count(F.lit(1)).alias("row_count"), sums[0].alias("content_hash"), sums[1].alias("check_hash")
    )


MOST_RUNS = 10_000  # runs of one call; each is committed by itself
ATTEMPTS, COMMITS = "_attempts", "_commits"  # below a log; Spark lists neither with the log's own rows


class _Folder:
    """A folder of any file system Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._options = spark._sc._gateway.new_array(self._hadoop.Options.Rename, 0)
        self.root = self._hadoop.Path(path)
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self.root.getFileSystem(self._conf)

    def _at(self, name: str):
        return self._hadoop.Path(self.root, name)

    def put_if_absent(self, name: str, content: str) -> bool:
        """False if the file exists already; it has its whole content from the moment it exists.

        Written under another name and renamed without overwriting, which a distributed file system does in one step.
        """
        made = self._at(f"{name}.{uuid.uuid4()}")
        out = self._fs.create(made, False)
        out.write(bytearray(content.encode()))
        out.close()
        if not self._fs.exists(self._at(name)):
            files = self._hadoop.FileContext.getFileContext(self.root.toUri(), self._conf)
            try:
                files.rename(self._fs.makeQualified(made), self._fs.makeQualified(self._at(name)), self._options)
                return True
            except Py4JJavaError as lost:
                if "FileAlreadyExists" not in lost.java_exception.getClass().getName():
                    raise
        self._fs.delete(made, False)
        return False

    def read(self, name: str) -> str | None:
        if not self._fs.exists(self._at(name)):
            return None
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def move_into(self, name: str, target: str) -> None:
        """Move the files of each folder of ``name`` into the folder of the same name below ``target``."""
        if not self._fs.exists(self._at(name)):
            return
        for folder in self._fs.listStatus(self._at(name)):
            to = self._hadoop.Path(self._at(target), folder.getPath().getName())
            self._fs.mkdirs(to)
            for file in self._fs.listStatus(folder.getPath()):
                self._fs.rename(file.getPath(), self._hadoop.Path(to, file.getPath().getName()))

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


def _place(tenant: str, run: str) -> str:
    return hashlib.sha256(f"{tenant}\n{run}".encode()).hexdigest()


def append_once(new: DataFrame, path: str, key: str = "task_run_id") -> None:
    """Append result rows of runs not stored yet; a repeated run leaves its first result in place.

    Rows go to a folder of this attempt first. One file per run, put only where there is none, makes an attempt the
    run's result, whoever else writes at the same time; its rows then move to the log, partitioned by tenant, so every
    later query prunes to one. A plain read of ``path`` sees committed rows only. Where an attempt died after its
    commit, the next one of that run moves what is left; where it died before, its rows are never seen. A run without
    rows is committed as well only if the frame has a row of it.
    """
    spark, tenant, attempt = new.sparkSession, "organization_id", str(uuid.uuid4())
    runs = new.select(tenant, key).distinct().limit(MOST_RUNS + 1).collect()
    if len(runs) > MOST_RUNS:
        raise ValueError(f"more than {MOST_RUNS} runs at once")
    log = _Folder(spark, path)
    places = {(r[0], r[1]): _place(r[0], r[1]) for r in runs}
    open_runs = []
    for run, place in places.items():
        winner = log.read(f"{COMMITS}/{place}")
        if winner is None:
            open_runs.append(run)
        else:
            _publish(log, place, winner)
    if not open_runs:
        return
    wanted = spark.createDataFrame([(*r, places[r]) for r in open_runs], f"{tenant} string, {key} string, _place string")
    mine = new.join(F.broadcast(wanted), [tenant, key])
    mine.write.partitionBy("_place", tenant).parquet(f"{path}/{ATTEMPTS}/{attempt}")
    for run in open_runs:
        place = places[run]
        if log.put_if_absent(f"{COMMITS}/{place}", attempt):
            _publish(log, place, attempt)
        else:
            _publish(log, place, log.read(f"{COMMITS}/{place}"))
    log.delete(f"{ATTEMPTS}/{attempt}")


def _publish(log: _Folder, place: str, attempt: str) -> None:
    log.move_into(f"{ATTEMPTS}/{attempt}/_place={place}", ".")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that its writer needs no longer."""
    folder = _Folder(spark, path)
    folder._fs.delete(folder.root, True)


def read_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        # A log whose first run is not committed yet has no file of its own.
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_audit(spark: SparkSession, path: str, organization_id: str) -> DataFrame:
    """One tenant's audit rows: the tenant predicate prunes partitions."""
    return spark.read.parquet(path).where(F.col("organization_id") == organization_id)
