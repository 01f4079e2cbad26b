"""Stupid-backoff scores of cells under the n-gram counts of the whole table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyledger.llm.cells import CELL, KEY, ROW, cut, keyed
from tidyledger.llm.packing import encoder

ALPHA = 0.4  # factor of a step back
TOKENS = 3_000_000  # tokens of a chunk of cells whose n-grams travel together
BITS = 20  # of an id in an n-gram's number
START = 2**BITS - 1  # id of what stands before a cell
LONGEST = 3  # ids that fit into a number
WORD = 1  # kind of single tokens; 2 k is the kind of k-grams, 2 k + 1 that of what a k-gram starts with


def _stored(path: str, added: bool, chunk_tokens: int):
    """Ids of each cell, two bytes each where they fit, with the chunk the cell belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, chunk, size = encoder(path, added), None, 0
        for batch in batches:
            chunks, told, numbers = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                ids = np.frombuffer(encode(text), "<u4")
                if chunk is None or size + len(ids) > chunk_tokens:
                    chunk, size = key, 0
                size += len(ids) + 1
                chunks.append(chunk)
                numbers.append(len(ids))
                told.append((ids.astype("<u2") if not len(ids) or ids.max() < 2**16 else ids).tobytes())
            columns = [pa.array(chunks, pa.int64()), batch.column(0), batch.column(1), pa.array(numbers, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(told, pa.binary())], ["chunk", KEY, ROW, "n_tokens", "ids"])

    return run


def _ids(stored: bytes, number: int) -> np.ndarray:
    return np.frombuffer(stored, "<u2" if len(stored) == 2 * number else "<u4").astype(np.int64)


def grams(ids: np.ndarray, size: int) -> np.ndarray:
    """Number of the run of ``size`` ids that ends at each id; the cell's start stands before the first."""
    number = ids
    for back in range(1, size):
        before = np.concatenate([np.full(min(back, len(ids)), START, np.int64), ids[: max(len(ids) - back, 0)]])
        number = before << BITS * back | number
    return number


def _kinds(ids: np.ndarray, order: int) -> dict[int, np.ndarray]:
    """What is counted of a cell, by kind."""
    runs = {2 * size: grams(ids, size) for size in range(2, order + 1)}
    return {WORD: ids} | runs | {kind + 1: run >> BITS for kind, run in runs.items()}


def _counted(order: int):
    """(chunk, kind, key, n): distinct keys of each chunk, so a frequent n-gram is one row a chunk."""

    def summed(chunk: int, cells: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[np.ndarray]] = {}
        for ids in cells:
            for kind, keys in _kinds(ids, order).items():
                parts.setdefault(kind, []).append(keys)
        for kind, keys in parts.items():
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            columns = [np.full(len(key), chunk), np.full(len(key), kind, np.int32), key, n]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["chunk", "kind", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cells = None, []
        for batch in batches:
            for chunk, number, ids in zip(*[batch.column(n).to_pylist() for n in (0, 1, 2)]):
                if chunk != held and cells:
                    yield from summed(held, cells)
                    cells = []
                held = chunk
                cells.append(_ids(ids, number))
        if cells:
            yield from summed(held, cells)

    return run


def _others(keys: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a cell: place of each of its keys among them, own count, count in all other cells."""
    own, place, n = np.unique(keys, return_inverse=True, return_counts=True)
    known, count = table
    return place, n, count[np.searchsorted(known, own)] - n


def score(ids: np.ndarray, order: int, total: int, tables: dict[int, tuple[np.ndarray, np.ndarray]]) -> float:
    """Sum of log10 scores of a cell's tokens; ``tables`` has sorted keys and their counts in all cells, by kind."""
    if not len(ids):
        return 0.0
    kinds = _kinds(ids, order)
    place, _, others = _others(kinds[WORD], tables[WORD])
    # A token of no other cell counts as if one had it once.
    told = np.log10(np.maximum(others, 1) / max(total - len(ids), 1))[place] + (order - 1) * np.log10(ALPHA)
    for size in range(2, order + 1):
        place, _, seen = _others(kinds[2 * size], tables[2 * size])
        start, _, before = _others(kinds[2 * size + 1], tables[2 * size + 1])
        seen, before = seen[place], before[start]
        known = seen > 0  # then its start is seen as well
        steps = (order - size) * np.log10(ALPHA)
        told = np.where(known, np.log10(np.maximum(seen, 1) / np.maximum(before, 1)) + steps, told)
    return float(told.sum())


def _scored(order: int, total: int):
    def run(cells: pa.Table, counts: pa.Table) -> pa.Table:
        kind = counts.column("kind").to_numpy()
        key, n = counts.column("key").to_numpy(), counts.column("count").to_numpy()
        tables = {}
        for own in np.unique(kind):
            inside = kind == own
            by_key = np.argsort(key[inside])
            tables[int(own)] = key[inside][by_key], n[inside][by_key]
        columns = (cells.column(c).to_pylist() for c in ("ids", "n_tokens"))
        scores = [score(_ids(ids, number), order, total, tables) for ids, number in zip(*columns)]
        return pa.table([*(cells.column(c) for c in (KEY, ROW, "n_tokens")), pa.array(scores, pa.float64())],
                        names=[KEY, ROW, "n_tokens", "score"])

    return run


def backoff_scores(
    rows: DataFrame,
    cell: str,
    tokenizer: str,
    row_index: str = ROW,
    row_key: str | None = None,
    order: int = 2,
    added: bool = False,
    chunk_tokens: int = TOKENS,
) -> DataFrame:
    """Stupid-backoff log score of each cell under the counts of all other cells of the table.

    Tokens are those of the vocabulary file ``tokenizer``, added ones as in ``packing``. A token scores the share of
    its ``order``-gram (2 or 3) among all n-grams that start like it, both counted in other cells; where no other cell
    has it 0.4 times that of the next shorter one, at last 0.4 times the share of the token among all tokens of other
    cells, at least one. Returns one row per row of the table: (row_key, row_index, n_tokens, score, mean_score): the
    sum of log10 scores, and that by token. Missing and empty cells have no tokens, score 0 and no mean. A repeated
    row counts as another cell. An empty table gives no rows. Other columns are not read.

    Every text is tokenised once and stored as ids, in chunks of bounded size. A chunk's distinct n-grams are rows
    that go to their hash partition, are summed to the count table there and joined to it; a frequent n-gram is one
    row a chunk, however many cells have it. The joined counts meet the cells of their chunk, and scores are summed
    per cell. Only the total is read by the driver.
    """
    if not 2 <= order <= LONGEST:
        raise ValueError("order has to be 2 or 3")
    cells = keyed(rows, cell, row_index, row_key)
    stored = cut(cells.mapInArrow(
        _stored(tokenizer, added, chunk_tokens), f"chunk long, {KEY} long, {ROW} long, n_tokens long, ids binary"
    ))
    total = stored.agg(F.sum("n_tokens")).first()[0] or 0
    counted = stored.select("chunk", "n_tokens", "ids").where("n_tokens > 0").mapInArrow(
        _counted(order), "chunk long, kind int, key long, n long"
    )
    dealt = counted.repartition("kind", "key")
    counts = dealt.groupBy("kind", "key").agg(F.sum("n").alias("count"))
    known = dealt.drop("n").join(counts, ["kind", "key"]).select("chunk", "kind", "key", "count")
    scored = stored.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(
        _scored(order, total), f"{KEY} long, {ROW} long, n_tokens long, score double"
    )
    mean = F.when(F.col("n_tokens") > 0, F.col("score") / F.col("n_tokens"))
    return scored.withColumn("mean_score", mean)
