"""CSV scan: header row, text cells, structural issues, limits, fingerprints.

Text is read in lines and put together to records, so that blank records stay, every record's true field count is
known, and files are split; rows get their position from (file, block, order inside the block). Whether a line starts
inside a quoted cell follows from what each line does to either state, composed over lines and blocks.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidyledger.config import ScanLimits
from tidyledger.plans.order import offsets
from tidyledger.session import ensure_checkpoint_dir
from tidyledger.sources.tables import ROW, CellTable

# Accepted delimiters and how much text decides between them.
DELIMITERS = (",", ";", "\t", "|")
SNIFFED_CHARS = 8192
WHOLE_FILE = 1 << 30  # bytes of a file up to which its plain SHA-256 is taken from one row
BROADCAST_BLOCKS = 1_000_000  # file blocks whose places are broadcast, some 70 bytes each
PIECES = 4  # parts of a line's digest that are summed, of 15 hexadecimal digits each


class ScanError(ValueError):
    """The source is empty, not UTF-8, or above a configured limit."""


@dataclass(frozen=True)
class CsvScan:
    table: CellTable
    issues: DataFrame
    manifest: DataFrame
    delimiter: str
    fingerprints: DataFrame


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes, sha256, encoding) per file; encoding is null where the bytes are no UTF-8.

    Files above ``WHOLE_FILE`` bytes are listed without being read: sha256 and encoding are null, see ``fingerprints``.
    """
    files = spark.read.format("binaryFile").load(path)
    bom = F.expr("startswith(content, X'EFBBBF')")
    size = F.col("length").alias("size_bytes")
    small = files.where(F.col("length") <= WHOLE_FILE).select(
        "path",
        size,
        F.sha2("content", 256).alias("sha256"),
        F.when(F.is_valid_utf8(F.col("content").cast("string")), F.when(bom, F.lit("utf-8-sig")).otherwise("utf-8"))
        .alias("encoding"),
    )
    nothing = F.lit(None).cast("string")
    large = files.where(F.col("length") > WHOLE_FILE)
    return small.unionByName(large.select("path", size, nothing.alias("sha256"), nothing.alias("encoding")))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes, lines, digest, encoding) of files of any size, read in ranges; files without a byte have no row.

    A leaf of the digest is one line: the SHA-256 of its number in the file and its bytes. Leaves are added up, so
    ranges of any size and order give the same; size and number of lines enter the digest as well. No range starts
    inside a line, so UTF-8 is told line by line: a line end is part of no other character. A first pass counts the
    lines of each range, which places the lines of the second; neither shuffles a line.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("size_bytes"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seen"),
        F.col("value").alias("line"),
    )
    ensure_checkpoint_dir(spark)
    counts = lines.groupBy("path", "block").agg(F.count(F.lit(1)).alias("count"), F.min("seen").alias("first")).checkpoint()
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "path", "block", (F.coalesce(F.sum("count").over(before), F.lit(0)) - F.col("first")).alias("shift")
    )
    number = F.encode((F.col("shift") + F.col("seen")).cast("string"), "utf-8")
    leaf = F.sha2(F.concat(number, F.encode(F.lit(":"), "utf-8"), F.col("line").cast("binary")), 256)
    part = [F.conv(F.substring(leaf, 1 + 15 * n, 15), 16, 10).cast("decimal(38,0)") for n in range(PIECES)]
    placed, _ = _beside_blocks(lines, starts, ["path", "block"])
    summed = placed.groupBy("path").agg(
        F.max("size_bytes").alias("size_bytes"),
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.octet_length("line") + 1).alias("told"),
        F.count_if(~F.is_valid_utf8("line")).alias("broken"),
        *[F.sum(p).alias(f"part{n}") for n, p in enumerate(part)],
    )
    # The reader drops a byte order mark of three bytes; a line end that is missing at the end counts as one.
    marked = F.col("told") < F.col("size_bytes")
    digest = F.sha2(F.concat_ws(":", "size_bytes", "lines", *[f"part{n}" for n in range(PIECES)]), 256)
    encoding = F.when(F.col("broken") == 0, F.when(marked, "utf-8-sig").otherwise("utf-8"))
    return summed.select("path", "size_bytes", "lines", digest.alias("digest"), encoding.alias("encoding"))


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """Delimiter splitting the first characters of the first file most evenly; a comma when none does."""
    first = spark.read.text(path).select(F.min("_metadata.file_path")).first()[0]
    # A line is one character at least, so so many lines hold all the text that decides.
    lines = spark.read.text(first).limit(SNIFFED_CHARS).select(F.substring("value", 1, SNIFFED_CHARS)).collect()
    text = re.sub('"[^"]*"', "", "\n".join(r[0] for r in lines)[:SNIFFED_CHARS])
    whole = [line for line in text.split("\n") if line]
    counts = {d: [line.count(d) for line in whole] for d in DELIMITERS}
    ranks = {d: (len(set(n)) == 1, n[0]) for d, n in counts.items() if n and n[0]}
    return max(ranks, key=ranks.get, default=",")


def _patterns(delimiter: str) -> dict[str, str]:
    """Regular expressions of the dialect. A quote opens a cell at its start only; "" inside is one quote; what
    follows the closing quote belongs to the cell as it is. Possessive throughout, so no line is gone through twice.
    """
    sep = re.escape(delimiter)
    inner = '(?:[^"]++|"")*+'
    closed = f'"{inner}"[^{sep}]*+'
    bare = f'[^"{sep}][^{sep}]*+'
    opened = f'(?:(?:{closed}|{bare})?+{sep})*+"{inner}\\z'
    return {
        "opens": f"\\A{opened}",  # from outside of a cell's quotes, the line ends inside
        "stays": f'\\A{inner}(?:\\z|"[^{sep}]*+{sep}{opened})',  # from inside, the line ends inside
        "field": f'{sep}("{inner}(?:"[^{sep}]*+|\\z)|{bare}|)',  # of a record with a delimiter put before it
        "quoted": f'(?s)\\A"({inner})(?:"(.*))?\\z',
    }


def _values(record: Column, delimiter: str) -> Column:
    """array<string> of the cells of a record; none in a blank one."""
    patterns = _patterns(delimiter)

    def value(raw: Column) -> Column:
        inner, rest = (F.regexp_extract(raw, patterns["quoted"], n) for n in (1, 2))
        return F.when(F.startswith(raw, F.lit('"')), F.concat(F.replace(inner, F.lit('""'), F.lit('"')), rest)).otherwise(raw)

    raw = F.regexp_extract_all(F.concat(F.lit(delimiter), record), F.lit(patterns["field"]), F.lit(1))
    nothing = F.expr("cast(array() as array<string>)")
    return F.when(record == "", nothing).otherwise(F.transform(raw, value))


def _running(rows: DataFrame, within: list[str], order: str) -> DataFrame:
    """Whether each piece starts inside quotes, by all pieces of its group before it, from a start outside.

    A piece maps either state to a state: it fixes it (``fixed`` has the state) or leaves or turns it (``turns``). So the
    state is that of the last piece that fixed one, turned as often as since then. Adds ``_fixed`` and ``_turns``, the
    state from the last fixing piece, null without one, and all turns, as the map of everything before the piece.
    """
    before = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    upto = before.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn("_upto", F.sum("turns").over(upto))
    mark = F.when(F.col("fixed").isNotNull(), F.struct("fixed", "_upto"))
    placed = summed.withColumn("_last", F.last(mark, ignorenulls=True).over(before))
    turns = F.col("_upto") - F.col("turns")
    state = (F.col("_last.fixed") + turns - F.col("_last._upto")) % 2
    return placed.withColumns({"_fixed": state, "_turns": turns % 2}).drop("_upto", "_last")


def _beside_blocks(lines: DataFrame, blocks: DataFrame, own: list[str]) -> tuple[DataFrame, bool]:
    """Lines with what is told of their block, and whether they are still in the order they were read in.

    Blocks are broadcast under one number each, so that a path of any length takes no room; lines are not shuffled.
    """
    numbered = blocks.withColumn("_own", F.xxhash64(*own))
    told = numbered.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_own").alias("numbers")).first()
    if told["n"] > BROADCAST_BLOCKS or told["numbers"] < told["n"]:
        return lines.join(blocks, own), False
    beside = lines.withColumn("_own", F.xxhash64(*own)).join(F.broadcast(numbered.drop(*own)), "_own").drop("_own")
    return beside, True


def _kept(frame: DataFrame) -> DataFrame:
    """The frame as written once to the shared checkpoint folder, packed column by column."""
    ensure_checkpoint_dir(frame.sparkSession)
    path = f"{frame.sparkSession.sparkContext.getCheckpointDir()}/records-{uuid.uuid4()}"
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _states(start: int, outside: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Quote states before each line and after the last one; ``outside`` and ``inside`` have the maps of the lines.

    A line's state is that of the last line that fixed one, turned as often as since then.
    """
    turns = np.cumsum(outside > inside)
    last = np.maximum.accumulate(np.where(outside == inside, np.arange(len(outside)), -1))
    fixed = last >= 0
    after = (np.where(fixed, outside[last], start) + turns - np.where(fixed, turns[last], 0)) % 2
    return np.concatenate([[start], after])


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, int]]:
    """(file and block, first line, line after the last) of the stretches of a batch that lie in one block."""
    if not batch.num_rows:
        return
    files, blocks = batch.column("file").dictionary_encode(), batch.column("block").to_numpy()
    names = files.indices.to_numpy()
    edges = np.flatnonzero((names[1:] != names[:-1]) | (blocks[1:] != blocks[:-1])) + 1
    edges = [0, *edges.tolist(), batch.num_rows]
    for begin, end in zip(edges, edges[1:]):
        yield (files.dictionary[int(names[begin])].as_py(), int(blocks[begin])), begin, end


def _block_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block of the lines of a task: its lines, and for either state it may start in, the state it ends in
    and the records that begin in it. The lines of a block follow each other in one task."""
    names = ["file", "block", "lines", "out", "in", "opens_out", "opens_in"]
    own, states, opens, lines = None, [0, 1], [0, 0], 0
    for batch in batches:
        done, maps = [], [batch.column(c).to_numpy() for c in ("out", "in")]
        for block, begin, end in _runs(batch):
            if block != own:
                if own is not None:
                    done.append((*own, lines, *states, *opens))
                own, states, opens, lines = block, [0, 1], [0, 0], 0
            for n in (0, 1):
                found = _states(states[n], maps[0][begin:end], maps[1][begin:end])
                states[n] = int(found[-1])
                opens[n] += int(np.count_nonzero(found[:-1] == 0))
            lines += end - begin
        yield from _batch(done, names)
    yield from _batch([] if own is None else [(*own, lines, *states, *opens)], names)


_MAPS = "file string, block bigint, lines bigint, out bigint, in bigint, opens_out bigint, opens_in bigint"


def _batch(rows: list[tuple], names: list[str]) -> list[pa.RecordBatch]:
    return [pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))))] if rows else []


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, record, line, whole, text) of the lines of a task, with those put together that follow each other in a record.

    ``whole`` are records that begin in a batch and end before a line that follows in it, whatever blocks they cross.
    """
    own, state, place, record = None, 0, 0, -1
    for batch in batches:
        if not batch.num_rows:
            continue
        out, into = (batch.column(c).to_numpy() for c in ("out", "in"))
        starts, firsts, ats = (batch.column(c).to_numpy() for c in ("start", "first", "at"))
        numbers, records, opens = (np.empty(batch.num_rows, np.int64) for _ in range(3))
        apart = np.zeros(batch.num_rows, bool)  # lines of another file than the line before
        for block, begin, end in _runs(batch):
            if block != own:
                apart[begin] = own is None or block[0] != own[0]
                own, state, place, record = block, int(starts[begin]), int(ats[begin]), int(firsts[begin]) - 1
            found = _states(state, out[begin:end], into[begin:end])
            opens[begin:end] = found[:-1] == 0
            records[begin:end] = record + np.cumsum(opens[begin:end])
            numbers[begin:end] = np.arange(place, place + end - begin)
            state, place, record = int(found[-1]), place + end - begin, int(records[end - 1])
        follows = np.concatenate([[False], ~apart[1:] & (np.diff(numbers) == 1)])
        heads = np.flatnonzero(~follows | (opens == 1))
        # A piece ends where the next one begins: it is whole if it opens, and a record opens on the line after it.
        ended = np.concatenate([follows[heads[1:]], [False]])
        offsets = pa.array([*heads.tolist(), batch.num_rows], pa.int32())
        text = pc.binary_join(pa.ListArray.from_arrays(offsets, batch.column("line")), "\n")
        at = pa.array(heads)
        yield pa.RecordBatch.from_arrays(
            [batch.column("file").take(at), pa.array(records[heads]), pa.array(numbers[heads]),
             pa.array(ended & (opens[heads] == 1)), text],
            ["file", "record", "line", "whole", "text"],
        )


def records(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """(file, record, text) of all records, blank ones too; record 0 of a file is its header.

    Lines are read in splits of any size. Each line is reduced to its transition function: the quote state it ends in
    for either state it may start in. A first pass composes the functions over the lines of a split, in the task that
    reads it, and leaves one row per split; those are composed over the splits of a file. No file is gone through by one
    task. A second pass knows the state, record and line that its splits start with, and puts the lines of records
    together as it reads them. Only records that tasks have parts of are shuffled. Records are stored once, and no line is.
    """
    patterns = _patterns(delimiter)
    line = F.col("line")

    def inside(text: Column, pattern: str) -> Column:
        return F.rlike(text, F.lit(patterns[pattern])).cast("int")

    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seen"),
        F.col("value").alias("line"),
    )
    # Most lines have no quote and leave either state as it is. The reader drops a file's byte order mark.
    plain = ~F.contains(line, F.lit('"'))
    lines = lines.withColumns(
        {
            "out": F.when(plain, 0).otherwise(inside(line, "opens")),
            "in": F.when(plain, 1).otherwise(inside(line, "stays")),
        }
    )
    ensure_checkpoint_dir(spark)
    blocks = lines.select("file", "block", "out", "in").mapInArrow(_block_maps, _MAPS).checkpoint()
    told = blocks.withColumns(
        {
            "fixed": F.when(F.col("out") == F.col("in"), F.col("out")),
            "turns": F.when(F.col("out") > F.col("in"), 1).otherwise(0),
        }
    )
    started = _running(told, ["file"], "block").withColumn("start", F.coalesce("_fixed", "_turns", F.lit(0)))
    opens = F.when(F.col("start") == 0, F.col("opens_out")).otherwise(F.col("opens_in"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = started.withColumn("opens", opens).select(
        "file", "block", "start", F.coalesce(F.sum("opens").over(before), F.lit(0)).alias("first"),
        F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("at"),
    )
    placed, in_order = _beside_blocks(lines, starts, ["file", "block"])
    if not in_order:
        placed = placed.sortWithinPartitions("file", "block", "seen")
    schema = "file string, record bigint, line bigint, whole boolean, text string"
    pieces = _kept(placed.drop("seen").mapInArrow(_pieces, schema))
    parts = F.sort_array(F.collect_list(F.struct("line", "text")))
    cut = pieces.where("not whole").groupBy("file", "record").agg(F.array_join(parts["text"], "\n").alias("text"))
    return pieces.where("whole").select("file", "record", "text").unionByName(_kept(cut))


def read_headers(heads: DataFrame, delimiter: str) -> tuple[str, ...]:
    """Column names of all files; those of a folder must have the same ones in the same order."""
    distinct = heads.select("text").distinct().limit(2).collect()
    if not distinct:
        raise ScanError("source is empty")
    if len(distinct) > 1:
        raise ScanError("the files of a folder differ in their headers")
    line = heads.select("text").limit(1)
    row = line.select(_values(F.col("text"), delimiter).alias("r")).first()["r"]
    return tuple(h.strip() for h in row) or ("",)


def header_issues(headers: tuple[str, ...]) -> list[tuple]:
    """Blank and repeated headers: (type, column_index, first_column_index)."""
    folded = [h.casefold() for h in headers]
    last = len(folded) - 1
    first = {key: last - i for i, key in enumerate(reversed(folded))}
    blank = [("blank_header", i, None) for i, h in enumerate(headers) if not h]
    return blank + [("duplicate_header", i, first[key]) for i, key in enumerate(folded) if first[key] != i]


def read_csv(
    spark: SparkSession, path: str, limits: ScanLimits = ScanLimits(), delimiter: str | None = None
) -> CsvScan:
    """Scan one file or a folder of like files. Short rows are filled with blanks, long ones cut."""
    told = fingerprints(spark, path).checkpoint()
    checks = told.agg(
        F.coalesce(F.max("size_bytes"), F.lit(0)).alias("largest"),
        F.count_if(F.col("encoding").isNull()).alias("undecodable"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total"),
    ).first()
    if checks["total"] == 0:
        raise ScanError("source is empty")
    if checks["undecodable"]:
        raise ScanError("source is not valid UTF-8")
    if limits.max_file_size_bytes is not None and checks["largest"] > limits.max_file_size_bytes:
        raise ScanError("file exceeds the size limit")

    delimiter = delimiter or detect_delimiter(spark, path)
    found = records(spark, path, delimiter)
    headers = read_headers(found.where("record = 0"), delimiter)
    if limits.max_columns is not None and len(headers) > limits.max_columns:
        raise ScanError("too many columns")

    cells = [f"c{i}" for i in range(len(headers))]
    body = found.where("record > 0")
    starts = offsets(body.groupBy("file").count(), ["file"]).select("file", "_start")
    placed, _ = _beside_blocks(body, starts, ["file"])
    rows = placed.select(
        (F.col("_start") + F.col("record") - 1).alias(ROW), _values(F.col("text"), delimiter).alias("_row")
    )
    values = [F.coalesce(F.get("_row", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(cells)]
    # Records are stored and cells are not: these would take their room once more, column by column.
    rows = rows.select(ROW, F.size("_row").alias("_fields"), *values)

    if limits.max_rows is not None and body.count() > limits.max_rows:
        raise ScanError("too many rows")
    if limits.max_cell_length is not None:
        longest = rows.agg(F.greatest(F.lit(0), *[F.max(F.length(c)) for c in cells])).first()[0]
        if (longest or 0) > limits.max_cell_length:
            raise ScanError("a cell exceeds the length limit")
    table, issues = CellTable(rows.select(ROW, *cells), headers), scan_issues(rows, headers)
    return CsvScan(table, issues, manifest(spark, path), delimiter, told)


def scan_issues(rows: DataFrame, headers: tuple[str, ...]) -> DataFrame:
    """(type, column_index, first_column_index, row_number, field_count); data rows count from 2."""
    width = len(headers)
    ragged = rows.where(F.col("_fields") != width).select(
        F.when(F.col("_fields") < width, F.lit("too_few_fields")).otherwise(F.lit("too_many_fields")).alias("type"),
        F.lit(None).cast("int").alias("column_index"),
        F.lit(None).cast("int").alias("first_column_index"),
        (F.col(ROW) + 2).alias("row_number"),
        F.col("_fields").cast("int").alias("field_count"),
    )
    named = rows.sparkSession.createDataFrame(
        header_issues(headers), "type string, column_index int, first_column_index int"
    ).select("*", F.lit(None).cast("bigint").alias("row_number"), F.lit(None).cast("int").alias("field_count"))
    return named.unionByName(ragged)
