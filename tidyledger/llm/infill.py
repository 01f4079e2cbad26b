"""Fill-in-the-middle forms of cells, cut between lines that word-wide bit arithmetic finds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyledger.llm.cells import CELL, KEY, ROW, keyed

# The marks before the parts, in the order prefix, suffix, middle.
MARKS = ("<P>", "<S>", "<M>")
LINE_END = 10
EACH = np.uint64(0x0101010101010101)
HIGH = np.uint64(0x8080808080808080)
LOW = np.uint64(0x7F7F7F7F7F7F7F7F)
ONE = np.uint64(1)
BLOCK = 4_000_000  # bytes of text worked on at a time; a longer text is a block of its own


def equal_to(words: np.ndarray, byte: int) -> np.ndarray:
    """The high bit of every byte of each word that equals ``byte``; exact, as no carry leaves a byte."""
    other = words ^ EACH * np.uint64(byte)
    return ~((other & LOW) + LOW | other | LOW)


def leading(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that begins a code point or is padding: all but 10xxxxxx."""
    return ~words & HIGH | words << ONE & HIGH


class Marks:
    """Rank and select over the marked bytes of a block."""

    def __init__(self, marks: np.ndarray):
        self._marks = marks
        self._upto = np.concatenate([[0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)])

    def rank(self, place: np.ndarray) -> np.ndarray:
        """Marks before each byte place."""
        word, bits = place >> 3, (place & 7).astype(np.uint64) << np.uint64(3)
        return self._upto[word] + np.bitwise_count(self._marks[word] & ((ONE << bits) - ONE))

    def select(self, nth: np.ndarray) -> np.ndarray:
        """Byte place of the nth mark, counted from 1."""
        word = np.searchsorted(self._upto, nth) - 1
        bits, left = self._marks[word], nth - self._upto[word]
        for step in range(1, 8):
            bits = np.where(left > step, bits & (bits - ONE), bits)
        lowest = bits & (~bits + ONE)
        return (word << 3) + (np.bitwise_count(lowest - ONE) >> 3)


def cut_lines(data: np.ndarray, ends: np.ndarray, one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, ...]:
    """(n_units, prefix_chars, middle_chars) of texts that lie end to end in ``data``.

    A unit is a line with its end, the last one also without. The prefix has the smaller of ``one`` and ``other``
    modulo n + 1 units, prefix and middle together the larger.
    """
    padded = np.zeros((len(data) // 8 + 1) * 8, np.uint8)
    padded[: len(data)] = data
    words = padded.view("<u8")
    lines, points = Marks(equal_to(words, LINE_END)), Marks(leading(words))
    starts = np.concatenate([[0], ends[:-1]])
    before = lines.rank(starts)
    closed = lines.rank(ends) - before
    units = closed + ((ends > starts) & (padded[ends - 1] != LINE_END))
    draws = one % (units + 1), other % (units + 1)

    def chars(cut: np.ndarray) -> np.ndarray:
        place = np.where(cut > 0, ends, starts)
        inside = (cut > 0) & (cut <= closed)
        place[inside] = lines.select((before + cut)[inside]) + 1
        return points.rank(place) - points.rank(starts)

    prefix = chars(np.minimum(*draws))
    return units, prefix, chars(np.maximum(*draws)) - prefix


CUTS = "struct<n_units long, prefix_chars long, middle_chars long>"


def _cuts(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    names = ("n_units", "prefix_chars", "middle_chars")
    for texts, one, other in batches:
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        draws = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in (one, other)]
        found, at = [[np.empty(0, np.int64)] for _ in names], 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
            block = data[offsets[at] : offsets[stop]]
            told = cut_lines(block, offsets[at + 1 : stop + 1] - offsets[at], *[d[at:stop] for d in draws])
            for column, part in zip(found, told):
                column.append(part)
            at = stop
        yield pa.StructArray.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in found], names)


def restored(output: Column | str, form: Column | str) -> Column:
    """The text that an output of a form was made of. Marks part an output only where no text had one."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, "<[PSM]>", -1)
    one, two, three = (F.get(parts, F.lit(n)) for n in (1, 2, 3))
    return F.when(form == "psm", F.concat(one, three, two)).when(form == "spm", F.concat(two, three, one)).otherwise(output)


def infilled_cells(
    rows: DataFrame,
    cell: str,
    row_index: str = ROW,
    row_key: str | None = None,
    seed: int = 7,
    rate: int = 100,
    suffix_first: int = 50,
) -> DataFrame:
    """Cells as training texts that ask for their middle, given prefix and suffix.

    Returns one row per row of the table: (row_key, row_index, n_units, form, prefix_chars, middle_chars, output).
    Two draws from the hash of ``seed`` and row_index cut a cell's lines into prefix, middle and suffix, each of which
    may be empty. ``rate`` in 100 cells are changed, of these ``suffix_first`` in 100 to the form ``spm``: <S>suffix
    <P>prefix<M>middle, the others to ``psm``: <P>prefix<S>suffix<M>middle. Empty and missing cells and those that
    hold a mark stay as they are (form ``plain``, no lengths). ``restored`` gives the cell back.

    Draws depend on row_index alone, so repeated rows come out alike and a run again gives the same; rows without
    row_index share the draw of the bare seed. An empty table gives no rows. Other columns are not read. No shuffle;
    a task holds one block of texts and their marks at a time.
    """
    cells = keyed(rows, cell, row_index, row_key)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(ROW).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * n + 1, 8), 16, 10).cast("long").alias(f"h{n + 1}") for n in range(4)]
    drawn = cells.select("*", *draws)
    cut = drawn.withColumn("cuts", F.arrow_udf(_cuts, CUTS)(F.col(CELL), F.col("h1"), F.col("h2")))
    plain = (F.col(CELL) == "") | (F.col("h3") % 100 >= rate)
    for mark in MARKS:
        plain = plain | F.contains(F.col(CELL), F.lit(mark))
    form = F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    told = cut.select(KEY, ROW, CELL, F.col("cuts.n_units"), form.alias("form"), "cuts.prefix_chars", "cuts.middle_chars")
    text, first, second = F.col(CELL), F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    prefix, suffix, middle = (
        F.concat(F.lit(mark), part)
        for mark, part in zip(
            MARKS,
            (
                F.substr(text, F.lit(1), first),
                F.substr(text, first + second + 1, F.length(text)),
                F.substr(text, first + 1, second),
            ),
        )
    )
    output = (
        F.when(F.col("form") == "psm", F.concat(prefix, suffix, middle))
        .when(F.col("form") == "spm", F.concat(suffix, prefix, middle))
        .otherwise(text)
    )
    changed = F.col("form") != "plain"
    return told.select(
        KEY, ROW, "n_units", "form", *[F.when(changed, F.col(c)).alias(c) for c in ("prefix_chars", "middle_chars")],
        output.alias("output"),
    )
