"""Passages of held-out entries inside cells: winnowed fingerprints joined, then extended word by word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidyledger.llm.cells import CELL, KEY, ROW, cut, keyed
from tidyledger.llm.words import grams, hash_memo, word_hashes, words

FILTER_BITS = 24  # of the bounded filter in front of the join: 2 MB whatever the number of entries
MARK = "gram long, before int, context string"


@dataclass(frozen=True)
class Winnow:
    """Any shared run of ``window`` words has a common fingerprint: the least of ``span`` neighbouring k-grams."""

    window: int

    @property
    def gram(self) -> int:
        return (self.window + 1) // 2

    @property
    def span(self) -> int:
        return self.window - self.gram + 1

    def positions(self, hashes: np.ndarray) -> np.ndarray:
        """Where the least k-gram hash of each span is, the last one on a tie."""
        if len(hashes) < self.span:
            return np.empty(0, np.int64)
        turned = np.lib.stride_tricks.sliding_window_view(hashes, self.span)[:, ::-1]
        return np.unique(np.arange(len(turned)) + self.span - 1 - turned.argmin(axis=1))

    def marks(self, found: list[bytes], prints: np.ndarray) -> Iterator[tuple[int, int, int, int, str]]:
        """(at, size, gram, before, context) of the fingerprints at the given places of a text of many words.

        The context is all that a window holding the gram can reach: ``before`` words, the gram, as many after it.
        """
        reach = self.window - self.gram
        at = self.positions(prints)
        for i, gram in zip(at.tolist(), prints[at].view(np.int64).tolist()):
            start = max(0, i - reach)
            yield i, self.gram, gram, i - start, _text(found[start : i + self.gram + reach])


def _text(found: list[bytes]) -> str:
    return b" ".join(found).decode("utf-8", "replace")


def _whole(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes under which a text of fewer words than a window is looked up as a whole."""
    return grams(hashes, size, seed=size)


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def _entry_marks(winnow: Winnow):
    fields = [("entry_id", pa.string()), ("need", pa.int32()), ("gram", pa.int64())]
    fields += [("before", pa.int32()), ("context", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = hash_memo()
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                found = words(text)
                hashes = word_hashes(memo, found)
                if len(found) >= winnow.window:
                    marks = winnow.marks(found, grams(hashes, winnow.gram))
                    rows += [(key, winnow.window, gram, before, context) for _, _, gram, before, context in marks]
                elif found:
                    gram = int(_whole(hashes, len(found)).view(np.int64)[0])
                    rows.append((key, len(found), gram, 0, _text(found)))
            yield _batch(rows, fields)

    return run


def _filter_places(gram: Column) -> Column:
    mask = (1 << FILTER_BITS) - 1
    return F.array(gram.bitwiseAND(mask), F.shiftrightunsigned(gram, 32).bitwiseAND(mask))


def _filter(marks: DataFrame) -> np.ndarray:
    """Bit set of the entries' grams, gathered as at most 2^18 words of 64 bits whatever the entries hold."""
    places = marks.select(F.explode(_filter_places(F.col("gram"))).alias("place"))
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    found = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return bits.view(np.uint64)


def _may_hold(bits: np.ndarray, gram: np.ndarray) -> np.ndarray:
    mask = np.uint64((1 << FILTER_BITS) - 1)
    hit = np.ones(len(gram), bool)
    for place in (gram & mask, (gram >> np.uint64(32)) & mask):
        hit &= (bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return hit


def _cell_marks(winnow: Winnow, short: list[int], bits):
    mark = pa.struct(
        [("at", pa.int32()), ("size", pa.int32()), ("gram", pa.int64()), ("before", pa.int32()), ("context", pa.string())]
    )

    def marks(found: list[bytes], hashes: np.ndarray, held: np.ndarray) -> Iterator[tuple]:
        prints = grams(hashes, winnow.gram)
        if _may_hold(held, prints).any():
            at_hand = _may_hold(held, prints)
            yield from (m for m in winnow.marks(found, prints) if at_hand[m[0]])
        for size in short:
            prints = _whole(hashes, size)
            for i in np.flatnonzero(_may_hold(held, prints)).tolist():
                yield i, size, int(prints[i].view(np.int64)), 0, _text(found[i : i + size])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = hash_memo()
        for batch in batches:
            counts, all_marks = [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                found = words(text)
                counts.append(len(found))
                own = marks(found, word_hashes(memo, found), bits.value)
                all_marks.append([dict(zip(("at", "size", "gram", "before", "context"), m)) for m in own])
            columns = [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(all_marks, pa.list_(mark))]
            yield pa.RecordBatch.from_arrays(columns, [KEY, ROW, "n_words", "marks"])

    return run


def _extend(size: int, before: int, context: str, e_before: int, e_context: str, need: int) -> tuple | None:
    """Equal words to the left and right of a common gram; nothing if they are too few or the gram only clashed."""
    own, other = context.split(" "), e_context.split(" ")
    if own[before : before + size] != other[e_before : e_before + size]:
        return None
    left = right = 0
    while left < min(before, e_before) and own[before - left - 1] == other[e_before - left - 1]:
        left += 1
    after, e_after = before + size, e_before + size
    while after + right < len(own) and e_after + right < len(other) and own[after + right] == other[e_after + right]:
        right += 1
    return (left, right) if left + size + right >= need else None


def _extended(
    size: pd.Series, before: pd.Series, context: pd.Series, e_before: pd.Series, e_context: pd.Series, need: pd.Series
) -> pd.DataFrame:
    spans = [_extend(*x) or (None, None) for x in zip(size, before, context, e_before, e_context, need)]
    return pd.DataFrame(spans, columns=["reach_left", "reach_right"], dtype="Int32")


def _merged(intervals: DataFrame) -> DataFrame:
    """(row_key, spans): overlapping and touching word intervals of a row made one, in order."""
    order = Window.partitionBy(KEY).orderBy("start", "stop")
    reached = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reached.isNull() | (F.col("start") > reached), 1).otherwise(0)
    islands = intervals.distinct().withColumn("opens", opens).withColumn("island", F.sum("opens").over(order))
    spans = islands.groupBy(KEY, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return spans.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def contaminated_cells(
    rows: DataFrame,
    entries: DataFrame,
    cell: str,
    entry: str,
    row_index: str = ROW,
    entry_id: str = "entry_id",
    row_key: str | None = None,
    window: int = 10,
) -> DataFrame:
    """Words of cells that lie in a passage of a held-out entry, and the entries each row quotes.

    Returns one row per row of the table: (row_key, row_index, n_words, spans, entry_ids). ``spans`` are merged word
    intervals (start, stop) covered by occurrences of ``window`` consecutive entry words; an entry of fewer words
    counts as one window, one without words never occurs. ``entry_ids`` are the ids, as text in text order, of entries
    with an occurring window. Missing and empty cells have no words; a missing entry id reads as ''. Repeated rows are
    judged each on its own, repeated entries count once per id. Empty tables give no rows, or rows without spans.
    Other columns are not read.

    Every window of an entry and of a cell keeps its least k-gram hash (winnowing), so any shared window shares a
    fingerprint. A filter of fixed size over the entries' fingerprints drops nearly all others of the cells before
    they leave their task; what stays is joined and extended word by word, each distinct context once. Sides of the
    joins are left to Spark, which measures them.
    """
    winnow = Winnow(window)
    listed = entries.select(
        F.coalesce(entries[entry_id].cast("string"), F.lit("")).alias("entry_id"),
        F.coalesce(entries[entry].cast("string"), F.lit("")).alias(CELL),
    )
    held = cut(
        listed.mapInArrow(_entry_marks(winnow), "entry_id string, need int, gram long, before int, context string")
    )
    short = [r[0] for r in held.where(F.col("need") < window).select("need").distinct().collect()]
    bits = rows.sparkSession.sparkContext.broadcast(_filter(held))
    schema = f"{KEY} long, {ROW} long, n_words long, marks array<struct<at int, size int, {MARK}>>"
    marked = cut(keyed(rows, cell, row_index, row_key).mapInArrow(_cell_marks(winnow, short, bits), schema))

    hits = marked.select(KEY, F.inline("marks"))
    context = ["size", "gram", "before", "context"]
    known = held.select("gram", F.col("before").alias("e_before"), F.col("context").alias("e_context"), "need")
    met = hits.select(context).distinct().join(known.distinct(), "gram")
    reach = F.pandas_udf(_extended, "reach_left int, reach_right int")(
        "size", "before", "context", "e_before", "e_context", "need"
    )
    met = cut(met.withColumn("reach", reach).select("*", "reach.*").drop("reach").where("reach_left is not null"))

    reaches = met.groupBy(context).agg(F.max("reach_left").alias("l"), F.max("reach_right").alias("r"))
    intervals = hits.join(reaches, context).select(
        KEY, (F.col("at") - F.col("l")).alias("start"), (F.col("at") + F.col("size") + F.col("r")).alias("stop")
    )
    named = held.withColumnsRenamed({"before": "e_before", "context": "e_context"})
    quoted = met.join(named, ["gram", "e_before", "e_context", "need"]).select(*context, "entry_id").distinct()
    ids = hits.join(quoted, context).select(KEY, "entry_id").distinct()
    ids = ids.groupBy(KEY).agg(F.array_sort(F.collect_list("entry_id")).alias("entry_ids"))
    found = marked.select(KEY, ROW, "n_words").join(_merged(intervals), KEY, "left").join(ids, KEY, "left")
    nothing = F.expr("cast(array() as array<struct<start int, stop int>>)")
    return found.select(
        KEY,
        ROW,
        "n_words",
        F.coalesce("spans", nothing).alias("spans"),
        F.coalesce("entry_ids", F.expr("cast(array() as array<string>)")).alias("entry_ids"),
    )
