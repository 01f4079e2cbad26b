"""Quality of a cell: random-indexing word vectors, pooled, and a two-layer network with calibrated probabilities."""

from __future__ import annotations

import functools
import io
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyledger.llm.cells import CELL, ROW, keyed
from tidyledger.llm.words import Memo

ROWS = 2**15  # words with a vector of their own; others share one by hash
WIDTH = 48
REACH = 2  # words on either side that make up a context
NONZERO = 6
HIDDEN = 24
SEED = 7
SLICE = 65_536  # words pooled at a time
HELD = 100_000  # words whose contexts are counted at a time
PART = 32  # rows of the context sums that travel together


# Shape of a word: upper case, lower case and digits are one sign each, and a run of a sign counts once.
SIGNS = bytes(
    65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256)
)
RUNS = re.compile(rb"([Aa0])\1+")


def _numbers(word: bytes) -> int:
    """Vector numbers of a word as it is written (low half) and of its shape (high half)."""
    shape = RUNS.sub(rb"\1", word.translate(SIGNS))
    written = xxhash.xxh64_intdigest(word, SEED) % ROWS
    return xxhash.xxh64_intdigest(shape, SEED + 1) % ROWS << 32 | written


class Words:
    """Vector numbers of the words of a text: (as written, shapes)."""

    def __init__(self):
        self._memo = Memo(_numbers)

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        found = text.split()
        both = np.fromiter(map(self._memo.__getitem__, found), np.int64, len(found))
        return both & 0xFFFFFFFF, both >> 32


@functools.lru_cache(maxsize=1)
def reader() -> Words:
    """One reader per worker process, with what it remembers from task to task."""
    return Words()


def index_vectors() -> np.ndarray:
    """Sparse random vectors of +1 and -1, the same on every run."""
    random = np.random.default_rng(SEED)
    vectors = np.zeros((ROWS, WIDTH), np.float32)
    for n in range(NONZERO):
        vectors[np.arange(ROWS), random.integers(0, WIDTH, ROWS)] += random.choice([-1.0, 1.0], ROWS)
    return vectors


def _contexts(texts: list[np.ndarray], index: np.ndarray, into: np.ndarray) -> None:
    """Add to each word's row of ``into`` the index vectors of all words within reach, in each of some texts.

    ``index`` has a zero vector at ROWS, the number that keeps texts out of each other's reach.
    """
    gap = np.full(REACH, ROWS, np.uint16)
    numbers = np.concatenate([gap, *[part for own in texts for part in (own, gap)]])
    for at in range(0, len(numbers), HELD):  # a very long text comes in stretches that share their seams
        low = max(0, at - REACH)
        vectors = index[numbers[low : at + HELD + REACH]]
        near = np.zeros_like(vectors)
        for step in range(1, REACH + 1):
            near[step:] += vectors[:-step]
            near[:-step] += vectors[step:]
        near, own = near[at - low :][:HELD], numbers[at : at + HELD]
        order = np.argsort(own, kind="stable")  # 16 bits are sorted by radix; the gaps come last
        order = order[: np.count_nonzero(own < ROWS)]
        own = own[order]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else own
        if len(starts):
            into[own[starts]] += np.add.reduceat(near[order], starts, axis=0, dtype=np.int32)


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Context sums of the cells of one task, of fixed size however many cells there are, in parts of PART rows."""
    read, index = reader(), np.vstack([index_vectors(), np.zeros((1, WIDTH))]).astype(np.int8)
    into, held, size = np.zeros((ROWS, WIDTH), np.int64), [], 0
    for batch in batches:
        for text in batch.column(0).cast(pa.binary()).to_pylist():
            for column in read(text or b""):
                held.append(column.astype(np.uint16))
                size += len(column)
            if size >= HELD:
                _contexts(held, index, into)
                held, size = [], 0
    _contexts(held, index, into)
    parts = [n for n in range(ROWS // PART) if into[n * PART : (n + 1) * PART].any()]
    sums = [zlib.compress(into[n * PART : (n + 1) * PART].tobytes(), 1) for n in parts]
    yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(sums, pa.binary())], ["part", "sums"])


def _whole_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of each part over all tasks, added up as they come."""
    whole: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, sums in zip(*[c.to_pylist() for c in batch.columns]):
            own = np.frombuffer(zlib.decompress(sums), np.int64)
            whole[part] = whole[part] + own if part in whole else own
    blobs = [zlib.compress(own.tobytes(), 1) for own in whole.values()]
    yield pa.RecordBatch.from_arrays([pa.array(whole, pa.int32()), pa.array(blobs, pa.binary())], ["part", "sums"])


def context_sums(cells: DataFrame) -> list[tuple[int, bytes]]:
    """Sum of the index vectors around each word number, over the whole text of every cell of the one column.

    Parts stay packed on the driver; the task that fits unpacks them.
    """
    partial = cells.mapInArrow(_partial_sums, "part int, sums binary")
    found = partial.repartition("part").mapInArrow(_whole_sums, "part int, sums binary").collect()
    return [(part, bytes(sums)) for part, sums in found]


def unpacked(parts: list[tuple[int, bytes]]) -> np.ndarray:
    sums = np.zeros((ROWS, WIDTH), np.int64)
    for part, blob in parts:
        sums[part * PART : (part + 1) * PART] = np.frombuffer(zlib.decompress(blob), np.int64).reshape(PART, WIDTH)
    return sums


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Context vector and own index vector of each word number, so that words of few contexts differ too."""
    norm = np.linalg.norm(sums.astype(np.float64), axis=1, keepdims=True)
    return (sums / np.maximum(norm, 1) + index_vectors() / np.sqrt(NONZERO)).astype(np.float32)


@dataclass
class Model:
    """Word vectors and network weights. All sizes are fixed, whatever it was fitted on."""

    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def probability(self, features: np.ndarray) -> np.ndarray:
        z = (features - self.mean) / self.scale
        logit = np.maximum(z @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        return 1 / (1 + np.exp(-np.clip(logit / self.temperature, -500, 500)))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **self.__dict__)
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Model:
        stored = np.load(io.BytesIO(data))
        values = {k: stored[k] for k in stored.files}
        return Model(**values | {"b2": float(values["b2"]), "temperature": float(values["temperature"])})


def pooled(numbers: tuple[np.ndarray, np.ndarray], vectors: np.ndarray) -> np.ndarray:
    """Mean vector of the written words and of their shapes, and how often words repeat."""
    written = numbers[0]
    if not len(written):
        return np.zeros(2 * WIDTH + 2)
    sums = np.zeros((2, WIDTH), np.float64)
    for kind, column in enumerate(numbers):
        for at in range(0, len(column), SLICE):
            sums[kind] += vectors[column[at : at + SLICE]].sum(axis=0)
    repeats = np.count_nonzero(written[1:] == written[:-1]) / len(written)
    distinct = len(set(written.tolist())) / len(written) ** 0.8
    return np.concatenate([sums.ravel() / len(written), [repeats, distinct]])


def _train(x: np.ndarray, y: np.ndarray, rounds: int = 400) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Weights of the network by full-batch Adam on the class-weighted log loss."""
    random = np.random.default_rng(SEED)
    params = [random.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN)]
    params += [random.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) / len(y)
    for step in range(1, rounds + 1):
        hidden = np.maximum(x @ params[0] + params[1], 0)
        p = 1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3][0], -500, 500)))
        error = (p - y) * weight
        back = np.outer(error, params[2]) * (hidden > 0)
        slopes = [x.T @ back + 1e-4 * params[0], back.sum(0), hidden.T @ error + 1e-4 * params[2], [error.sum()]]
        for n, slope in enumerate(slopes):
            slope = np.asarray(slope)
            first[n] = 0.9 * first[n] + 0.1 * slope
            second[n] = 0.999 * second[n] + 0.001 * slope**2
            params[n] = params[n] - 0.02 * (first[n] / (1 - 0.9**step)) / (
                np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8
            )
    return params[0], params[1], params[2], float(params[3][0])


def _temperature(logit: np.ndarray, y: np.ndarray) -> float:
    """The one that makes the log loss of rows the network was not trained on smallest."""
    def loss(t: float) -> float:
        return float(np.mean(np.logaddexp(0, np.where(y > 0, -logit, logit) / t)))

    return min(np.geomspace(0.25, 16, 61).tolist(), key=loss)


def fitted(texts: list[bytes], labels: np.ndarray, vectors: np.ndarray) -> Model:
    """Model of a bounded set of labelled texts; every fifth one only serves to set the temperature."""
    read = reader()
    numbers = [read(t) for t in texts]
    x = np.array([pooled(own, vectors) for own in numbers], np.float64).reshape(len(texts), 2 * WIDTH + 2)
    y = labels.astype(np.float64)
    if not len(y) or y.min() == y.max():
        flat = np.zeros(2 * WIDTH + 2)
        sure = 4.0 if len(y) and y[0] > 0 else -4.0 if len(y) else 0.0
        one = np.zeros((len(flat), HIDDEN))
        return Model(vectors, flat, flat + 1, one, np.zeros(HIDDEN), np.zeros(HIDDEN), sure, 1.0)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / scale
    aside = np.arange(len(y)) % 5 == 4
    w1, b1, w2, b2 = _train(z[~aside], y[~aside])
    model = Model(vectors, mean, scale, w1, b1, w2, b2, 1.0)
    if aside.any():
        model.temperature = max(1.0, _temperature(np.maximum(z[aside] @ w1 + b1, 0) @ w2 + b2, y[aside]))
    return model


def _fit(parts: list[tuple[int, bytes]]):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["place", ROW], kind="stable")
        texts = [t.encode("utf-8", "replace") for t in group[CELL]]
        model = fitted(texts, group["label"].to_numpy(), word_vectors(unpacked(parts)))
        return pd.DataFrame({"model": [model.dump()]})

    return run


def fit(
    rows: DataFrame, decisions: DataFrame, cell: str, label: str, row_index: str = ROW, fit_rows: int = 5_000
) -> bytes:
    """Model of the cells of reviewed rows: ``decisions`` has a 0/1 ``label`` per row_index.

    Word vectors are summed over the whole texts of all ``rows``, labelled or not, each task adding to sums of fixed
    size. The network and its temperature take at most ``fit_rows`` labelled rows, those of smallest hash of
    row_index, whatever the size of the tables; one task fits on them and only the model, of fixed size, comes back.
    Rows or labels that are missing take no part in that; without any, scores are 0.5.
    """
    parts = context_sums(keyed(rows, cell, row_index).select(CELL))
    labelled = decisions.select(
        decisions[row_index].cast("long").alias(ROW), decisions[label].cast("int").alias("label")
    ).where(f"{ROW} is not null and label is not null")
    place = F.xxhash64(ROW).alias("place")
    taken = labelled.select(ROW, "label", place).orderBy("place", ROW, "label").limit(fit_rows)
    sample = keyed(rows, cell, row_index).select(ROW, CELL).join(taken, ROW)
    sample = sample.orderBy("place", ROW, "label", F.xxhash64(CELL)).limit(fit_rows)
    found = sample.groupBy().applyInPandas(_fit(parts), "model binary").collect()
    return bytes(found[0][0]) if found else fitted([], np.zeros(0), word_vectors(unpacked(parts))).dump()


def probability(cell: Column, model: bytes) -> Column:
    """Probability that a cell is good, from its whole text. A missing cell counts as empty."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        loaded, read = Model.load(model), reader()
        for texts in batches:
            found = [pooled(read(t or b""), loaded.vectors) for t in texts.cast(pa.binary()).to_pylist()]
            yield pa.array(loaded.probability(np.array(found, np.float64).reshape(len(found), 2 * WIDTH + 2)), pa.float64())

    return F.arrow_udf(run, "double")(cell)


def good_cells(rows: DataFrame, cell: str, model: bytes, row_index: str = ROW) -> DataFrame:
    """(row_key, row_index, score) of every row of a table: the probability, 0 to 1, that its cell is good text.

    Missing, empty and blank cells have the zero vector and score as it does. Repeated rows score alike; an empty
    table gives no rows. Only the cell is an input; other columns are not read. No shuffle.
    """
    return keyed(rows, cell, row_index).withColumn("score", probability(F.col(CELL), model)).drop(CELL)
