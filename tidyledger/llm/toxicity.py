"""Toxicity of a cell: how much better a dictionary of toxic text compresses its windows than one of ordinary text."""

from __future__ import annotations

import functools
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyledger.llm.cells import CELL, ROW, keyed
from tidyledger.llm.words import Memo, grams, hash_memo, mixed, word_hashes, words

ORDINARY = 1_500  # windows of ordinary text in both dictionaries
TOXIC = 2_000  # windows of toxic text in the toxic one
LEVEL = 19
STEM = 4  # bytes of the shortest beginning of a word that may tell toxic text
SHARE = 0.008  # of the toxic fit rows that must have a word or stem before it enters the toxic dictionary
LEAST = 5  # such rows at least
ODDS = 12.0  # times more frequent among toxic fit rows than among ordinary ones, for the same
WORDS = 120_000  # words whose saving a worker remembers: working one out means compressing it twice
TAIL = b"\0" * 64  # behind the windows, as the last bytes of a dictionary are not indexed
STEPS = tuple(round(0.4 + 0.05 * n, 2) for n in range(10))  # thresholds that calibration chooses from


def window(word: bytes) -> bytes:
    """What is compressed: a word between marks, three times over, so that it always is worth compressing.

    The repeats cost the same everywhere; a dictionary that holds the word spares its first appearance.
    """
    return (b"<" + word + b">") * 3


@dataclass
class Model:
    """Dictionaries of bounded size, the share of a word that must be saved to count, and the curve to probability."""

    ordinary: bytes
    toxic: bytes
    threshold: float
    slope: float
    base: float


class Scorer:
    """Probabilities of whole texts; the saving of a word is worked out once."""

    def __init__(self, model: Model):
        self.model = model
        self._ordinary = self._compressor(model.ordinary)
        self._toxic = self._compressor(model.toxic)
        self._saving = Memo(self._saved, WORDS)

    @staticmethod
    def _compressor(content: bytes):
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(
            level=LEVEL, dict_data=dictionary, write_content_size=False, write_dict_id=False
        ).compress

    def _saved(self, word: bytes) -> float:
        text = window(word)
        return (len(self._ordinary(text)) - len(self._toxic(text))) / len(word)

    def savings(self, text: bytes) -> np.ndarray:
        """Share of each window's word that the toxic dictionary saves over the ordinary one."""
        found = words(text)
        return np.fromiter(map(self._saving.__getitem__, found), np.float64, len(found))

    def __call__(self, text: bytes) -> float:
        z = self.model.slope * evidence(self.savings(text), self.model.threshold) + self.model.base
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


@functools.lru_cache(maxsize=1)
def scorer(model: bytes) -> Scorer:
    """One scorer per worker process, with what it remembers from task to task."""
    return Scorer(pickle.loads(model))


def evidence(savings: np.ndarray, threshold: float) -> float:
    return float(np.log1p(savings[savings >= threshold].sum()))


def _fresh(texts: list[bytes]) -> list[set[bytes]]:
    """Words of texts that are no copies of one before, so that a copied text counts once."""
    memo, seen, kept = hash_memo(), set(), []
    for text in texts:
        found = words(text)
        shingles = grams(word_hashes(memo, found), min(3, len(found)))
        sketch = {(n, int(mixed(shingles + np.uint64(n)).min())) for n in range(1, 5)} if len(shingles) else {(0, 0)}
        if not sketch & seen:
            kept.append(set(found))
        seen |= sketch
    return kept


def _stems(found: set[bytes]) -> set[bytes]:
    """Words and their beginnings: toxic words of one stem are known together."""
    return found | {word[:n] for word in found for n in range(STEM, min(len(word), 2 * STEM))}


def _calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and base of the logistic curve through evidence and label, fitted to softened labels."""
    n = y.sum()
    target = np.where(y > 0, (n + 1) / (n + 2), 1 / (len(y) - n + 2))
    slope, base = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * z + base, -500, 500)))
        w, e = p * (1 - p) + 1e-9, p - target
        grad = np.array([(e * z).sum() + 1e-3 * slope, e.sum()])
        hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(hess, grad), -2, 2)
        slope, base = slope - step[0], base - step[1]
    return float(slope), float(base)


def fitted(texts: list[bytes], labels: np.ndarray) -> Model:
    """Model of a bounded set of labelled texts; every fourth one only serves to calibrate."""
    aside = np.arange(len(texts)) % 4 == 3
    toxic = _fresh([t for t, y, a in zip(texts, labels, aside) if y > 0 and not a])
    plain = _fresh([t for t, y, a in zip(texts, labels, aside) if y <= 0 and not a])
    in_toxic, in_plain = (Counter(w for own in side for w in own) for side in (toxic, plain))
    stems_toxic, stems_plain = (Counter(s for own in side for s in _stems(own)) for side in (toxic, plain))
    least = max(LEAST, SHARE * len(toxic))
    telling = {
        stem: n
        for stem, n in stems_toxic.items()
        if n >= least and n / len(toxic) * max(1, len(plain)) / (stems_plain[stem] + 0.5) >= ODDS
    }
    weight = {w: max((telling.get(s, 0) for s in _stems({w})), default=0) for w in in_toxic}
    chosen = sorted((w for w, n in weight.items() if n), key=lambda w: (weight[w], in_toxic[w], w))[-TOXIC:]
    common = sorted(in_plain, key=lambda w: (in_plain[w], w))[-ORDINARY:]
    # Both dictionaries know the common ordinary windows, so only what toxic text adds makes a difference.
    ordinary = b"".join(map(window, common))
    model = Model(ordinary + TAIL, ordinary + b"".join(map(window, chosen)) + TAIL, 0.5, 0.0, 0.0)
    rest = [(t, y) for t, y, a in zip(texts, labels, aside) if a]
    y = np.array([y for _, y in rest], np.float64)
    if not len(y) or y.min() == y.max():
        share = (float((labels > 0).sum()) + 0.5) / (len(labels) + 1)
        model.base = float(np.log(share / (1 - share)))
        return model
    read = Scorer(model)
    savings = [read.savings(t) for t, _ in rest]
    hit = np.array([[bool((s >= step).any()) for s in savings] for step in STEPS])
    right = hit[:, y > 0].mean(axis=1) - 2 * hit[:, y <= 0].mean(axis=1)
    # Of thresholds that part the two about equally well the lowest one: what it lets in still weighs little alone.
    model.threshold = STEPS[int(np.flatnonzero(right >= right.max() - 0.01)[0])]
    model.slope, model.base = _calibrated(np.array([evidence(s, model.threshold) for s in savings]), y)
    return model


def _fit(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["place", ROW, CELL], kind="stable")
    model = fitted([t.encode("utf-8", "replace") for t in group[CELL]], group["label"].to_numpy())
    return pd.DataFrame({"model": [pickle.dumps(model)]})


def fit(
    rows: DataFrame, decisions: DataFrame, cell: str, label: str, row_index: str = ROW, fit_rows: int = 3_000
) -> bytes:
    """Model of the cells of reviewed rows: ``decisions`` has a 0/1 ``label`` (1: toxic) per row_index.

    At most ``fit_rows`` rows of either label are taken, those of smallest hash of row_index, whatever the size of
    the tables; one task fits on them and only the model, of bounded size, comes back. Missing rows and labels take
    no part. With labels of one kind, or none, all scores are their share.
    """
    labelled = decisions.select(
        decisions[row_index].cast("long").alias(ROW), decisions[label].cast("int").alias("label")
    ).where(f"{ROW} is not null and label in (0, 1)")
    placed = labelled.withColumn("place", F.xxhash64(ROW))
    first = [placed.where(F.col("label") == n).orderBy("place", ROW).limit(fit_rows) for n in (0, 1)]
    sample = keyed(rows, cell, row_index).select(ROW, CELL).join(first[0].unionByName(first[1]), ROW)
    sample = sample.orderBy("place", ROW, F.xxhash64(CELL)).limit(2 * fit_rows)
    found = sample.groupBy().applyInPandas(_fit, "model binary").collect()
    return bytes(found[0][0]) if found else pickle.dumps(fitted([], np.zeros(0)))


def probability(cell: Column, model: bytes) -> Column:
    """Probability that a cell is toxic, from all its windows. A missing cell counts as empty: no evidence."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = scorer(model)
        for texts in batches:
            yield pa.array([score(t or b"") for t in texts.cast(pa.binary()).to_pylist()], pa.float64())

    return F.arrow_udf(run, "double")(cell)


def toxic_cells(rows: DataFrame, cell: str, model: bytes, row_index: str = ROW) -> DataFrame:
    """(row_key, row_index, score) of every row of a table: the probability, 0 to 1, that its cell is toxic.

    Missing, empty and wordless cells have no window and score as texts without evidence. Repeated rows score alike;
    an empty table gives no rows. Only the cell is an input; other columns are not read. No shuffle.
    """
    return keyed(rows, cell, row_index).withColumn("score", probability(F.col(CELL), model)).drop(CELL)
