"""Best-fit packing of tokenized cells into sequences by the sum-of-squares rule."""

from __future__ import annotations

import functools
import json
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyledger.llm.cells import KEY, ROW, keyed
from tidyledger.llm.words import Memo

END = 2  # id that ends a cell
GROUP = 131_072  # cells packed together by one task


# How byte-level tokenizers part a text before any merge, and the bytes that stand for themselves there.
PARTS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BEYOND_LATIN = re.compile(r"[^\x00-\u024f]")  # below, Unicode versions agree on letters, numbers and spaces
CUT = re.compile(r"(?<=\S)(?= \S)")  # before a space that opens the next token
OFTEN = 16  # characters, one of which beyond Latin, that make a text be cut at every such space


def _ranks(path: str) -> dict[bytes, int] | None:
    """Byte strings of a byte-level vocabulary by id, if the ids are in the order of its merges."""
    with open(path, encoding="utf-8") as file:
        stored = json.load(file)
    hidden = sorted(set(range(256)) - set(SHOWN))
    byte = {chr(b): b for b in SHOWN} | {chr(0x100 + n): b for n, b in enumerate(hidden)}
    special = {token["content"] for token in stored["added_tokens"]}
    model = stored["model"]
    if stored["pre_tokenizer"]["type"] != "ByteLevel" or stored["normalizer"] or model["type"] != "BPE":
        return None
    vocabulary = {t: i for t, i in model["vocab"].items() if t not in special}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    in_order = [vocabulary[m] for m in merged] == list(range(256, 256 + len(merged)))
    return {bytes(byte[c] for c in t): i for t, i in vocabulary.items()} if in_order else None


class Encoder:
    """Ids of a text as little-endian 32-bit bytes.

    Latin text takes the vocabulary's merges without the bookkeeping of offsets, whole: a call per word costs more than
    the word. All other text takes the tokenizer itself. The tokenizer never joins text across a space that stands
    between two other characters: the space opens the next token. So a text that is Latin in part is cut at such spaces,
    into Latin stretches and other words or, if the others are many, into words; short ones are remembered. Strings of
    added tokens in a text are ordinary text unless ``added``, the tokenizer's own default; then a text that holds one
    goes through the tokenizer whole.
    """

    def __init__(self, path: str, added: bool = False):
        import tiktoken
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = not added
        known = self._tokenizer.get_added_tokens_decoder().values() if added else ()
        self._added = [token.content for token in known]
        ranks = _ranks(path)
        self._latin = ranks and tiktoken.Encoding(
            "vocabulary", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={}
        )
        self._known = Memo(self._apart)

    def _ids(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _apart(self, text: str) -> bytes:
        if BEYOND_LATIN.search(text):
            return self._ids(text)
        try:
            return self._latin.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        except ValueError:  # white space too long for its pattern matcher
            return self._ids(text)

    def __call__(self, text: str) -> bytes:
        if not self._latin or any(a in text for a in self._added):
            return self._ids(text)
        others = len(BEYOND_LATIN.findall(text))
        if not others:
            return self._apart(text)
        parts = CUT.split(text) if others * OFTEN > len(text) else _stretches(text)
        return b"".join(map(self._known.__getitem__, parts))


@functools.lru_cache(maxsize=1)
def encoder(path: str, added: bool = False) -> Encoder:
    """One encoder per worker process, with what it remembers from task to task."""
    return Encoder(path, added)


def _stretches(text: str) -> Iterator[str]:
    """Latin stretches of a text, as long as can be, and the other words between them."""
    done = 0
    while other := BEYOND_LATIN.search(text, done):
        start = text.rfind(" ", done, other.start())
        while start > done and (text[start - 1].isspace() or text[start + 1].isspace()):
            start = text.rfind(" ", done, start)
        if start > done:
            yield text[done:start]
        after = CUT.search(text, other.start())
        stop = after.start() if after else len(text)
        yield text[max(start, done) : stop]
        done = stop
    yield text[done:]


def pieces(length: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a cell: all full but the first, which takes what is left over."""
    first = (length - 1) % capacity + 1
    yield 0, first
    for start in range(first, length, capacity):
        yield start, capacity


def _tokenized(path: str, capacity: int, added: bool):
    fields = [(KEY, pa.int64()), (ROW, pa.int64()), ("piece", pa.int32()), ("start", pa.int64())]
    fields += [("length", pa.int32()), ("ids_crc32", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, added)
        for batch in batches:
            rows = []
            for key, row, text in zip(*[c.to_pylist() for c in batch.columns]):
                ids = memoryview(encode(text) + END.to_bytes(4, "little"))
                for n, (start, length) in enumerate(pieces(len(ids) // 4, capacity)):
                    rows.append((key, row, n, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            columns = list(zip(*rows)) if rows else [[]] * len(fields)
            arrays = [pa.array(c, t) for c, (_, t) in zip(columns, fields)]
            yield pa.RecordBatch.from_arrays(arrays, [n for n, _ in fields])

    return run


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length: the gap that leaves the smallest sum of squared counts of open bins per gap.

    Counts of full bins do not enter the sum. Of equal choices the smallest gap is taken, a new bin last.
    """
    count = np.zeros(capacity + 1, np.int64)  # open bins per gap; 0 and capacity stay 0
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, bins = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    never = np.iinfo(np.int64).max
    for i, size in enumerate(lengths.tolist()):
        # Moving a bin from gap g to gap g - size changes the sum by 2 * (count[g - size] - count[g] + 1); one that
        # gets full leaves the sum, by 1 - 2 * count[g]; a new bin adds 2 * count[capacity - size] + 1, or nothing.
        gaps = count[size:]
        change = np.where(gaps > 0, 2 * (count[: len(gaps)] - gaps + 1), never)
        if count[size]:
            change[0] = 1 - 2 * count[size]
        change[-1] = 2 * count[capacity - size] + 1 if size < capacity else 0
        gap = size + int(change.argmin())
        if gap == capacity:
            place, bins = bins, bins + 1
        else:
            place = waiting[gap].pop()
            count[gap] -= 1
        where[i], offset[i] = place, capacity - gap
        if gap > size:
            waiting[gap - size].append(place)
            count[gap - size] += 1
    return where, offset


def pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length: by sum of squares, then what is in bins left open once more, longest first.

    The second round only replaces the first one's open bins if it needs fewer.
    """
    bins, offset = sum_of_squares(lengths, capacity)
    while True:
        is_open = np.bincount(bins, weights=lengths, minlength=1)[bins] < capacity
        again = np.flatnonzero(is_open)
        again = again[np.argsort(-lengths[again], kind="stable")]
        if not len(again):
            return bins, offset
        old = np.unique(bins[again])
        new, place = sum_of_squares(lengths[again], capacity)
        if new.max() + 1 >= len(old):
            return bins, offset
        bins[again], offset[again] = old[new], place


def _packed(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        # The rule is an online one; a fixed order makes its outcome the same on every attempt.
        group = group.sort_values(["ids_crc32", KEY, "piece"], kind="stable")
        bins, offset = pack(group["length"].to_numpy(np.int64), capacity)
        sequence = (group["pack"].to_numpy(np.int64) << 32) + bins
        return group.assign(sequence_id=sequence, offset=offset).drop(columns="pack")

    return run


def packed_cells(
    rows: DataFrame,
    cell: str,
    tokenizer: str,
    row_index: str = ROW,
    row_key: str | None = None,
    capacity: int = 1024,
    group: int = GROUP,
    added: bool = False,
) -> DataFrame:
    """Cells of a table as token sequences of at most ``capacity`` ids, for training.

    ``tokenizer`` is the path of a vocabulary file, the same on every executor; ``added`` says whether the string of
    an added token in a cell is that token, as by the tokenizer's default, or ordinary text. A cell is its ids and the end id 2;
    only a longer one is cut, into full pieces behind a first piece that takes the rest. Returns one row per piece:
    (row_key, row_index, piece, start, length, ids_crc32, sequence_id, offset), where sequences are filled from
    offset 0 without gaps. Missing and empty cells are a piece of one id. Repeated rows are packed each. An empty
    table gives no rows. Other columns of the table are not read.

    Rows are dealt by number into groups of about ``group`` cells, however many there are in all. A group is packed
    by one task: each piece goes where the sum over gaps of the squared number of open sequences with that gap
    becomes smallest. That rule leaves few sequences open, so the groups cost at most a few sequences each.
    """
    cells = keyed(rows, cell, row_index, row_key)
    packs = max(1, math.ceil(rows.count() / group))
    schema = f"{KEY} long, {ROW} long, piece int, start long, length int, ids_crc32 long"
    cut_up = cells.mapInArrow(_tokenized(tokenizer, capacity, added), schema)
    dealt = cut_up.withColumn("pack", F.pmod(F.xxhash64(KEY), F.lit(packs)))
    out = f"{schema}, sequence_id long, offset long"
    return dealt.groupBy("pack").applyInPandas(_packed(capacity), out)
