"""Packing and backoff scores against the tokenizer itself."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidyledger.llm import backoff
from tidyledger.llm.packing import Encoder, pack, packed_cells, pieces, sum_of_squares

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "row_index long, note string, cell string, row_key string, pack int, length int"
TEXTS = [
    "plain words here", "", None, " ", "  lead", "tail  ", "a  b c\n d \t e", "line\nline two\n\nthree", "x" * 5000,
    "it's o'clock 's a'", "é ñ ß Ünï", "日本語 の テキスト", "a b 　 c d e f", "1 22 333 a1b2 !! ?!", "<|endoftext|> a b c",
    " ".join(f"w{i}" for i in range(4000)), "plain words here", "emoji 🙂🙂 here and there", "a \x1c b \x85 c d e",
]


@pytest.fixture(scope="module")
def tokenizer():
    own = Tokenizer.from_file(PATH)
    own.encode_special_tokens = True
    return own


def table(spark, texts):
    rows = [(i, t, "clash", "clash", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_chunked_ids_are_the_tokenizers(tokenizer):
    encode = Encoder(PATH)
    for text in filter(None, TEXTS):
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_pieces():
    assert list(pieces(1, 4)) == [(0, 1)]
    assert list(pieces(4, 4)) == [(0, 4)]
    assert list(pieces(9, 4)) == [(0, 1), (1, 4), (5, 4)]


def slow_sum_of_squares(lengths, capacity):
    gaps, where = [], []
    for size in lengths:
        def cost(gap):
            after = Counter(gaps)
            after[gap] -= gap != capacity
            after[gap - size] += 1
            return sum(n * n for g, n in after.items() if 0 < g < capacity), gap

        options = {g for g in gaps if g >= size} | {capacity}
        gap = min(options, key=cost)
        gaps = gaps + [gap - size] if gap == capacity else gaps
        if gap != capacity:
            gaps.remove(gap)
            gaps.append(gap - size)
        where.append(gap)
    return where


def test_each_length_goes_where_the_sum_of_squares_is_least():
    lengths = np.random.default_rng(2).integers(1, 13, 200)
    bins, offset = sum_of_squares(lengths, 12)
    assert (12 - offset).tolist() == slow_sum_of_squares(lengths.tolist(), 12)


@pytest.mark.parametrize("capacity", [7, 64])
def test_bins_are_gapless_and_few(capacity):
    lengths = np.random.default_rng(1).integers(1, capacity + 1, 5000)
    bins, offset = pack(lengths, capacity)
    for own in np.unique(bins):
        inside = np.flatnonzero(bins == own)
        inside = inside[np.argsort(offset[inside])]
        assert offset[inside].tolist() == np.concatenate([[0], np.cumsum(lengths[inside])[:-1]]).tolist()
        assert lengths[inside].sum() <= capacity
    assert len(np.unique(bins)) <= 1.03 * lengths.sum() / capacity + 5
    assert not len(pack(lengths[:0], capacity)[0])


def test_packed_cells(spark, tokenizer):
    found = packed_cells(table(spark, TEXTS), "note", PATH, capacity=64, group=5).collect()
    by_row, by_sequence = {}, {}
    for r in found:
        by_row.setdefault(r.row_index, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_row) == set(range(len(TEXTS)))
    for index, own in by_row.items():
        ids = np.array([*tokenizer.encode(TEXTS[index] or "", add_special_tokens=False).ids, 2], "<u4")
        own.sort(key=lambda r: r.piece)
        assert [(r.start, r.length) for r in own] == list(pieces(len(ids), 64))
        assert [r.piece for r in own] == list(range(len(own)))
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert packed_cells(table(spark, []), "note", PATH).count() == 0


@pytest.mark.parametrize("order,tokens", [(2, 3_000_000), (3, 3_000_000), (2, 40), (3, 1)])
def test_backoff_scores(spark, tokenizer, order, tokens):
    """Against counts in a dictionary, with cells in one chunk a task and in many."""
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in TEXTS]

    def runs(own, size):
        padded = ["start"] * (size - 1) + own
        return [tuple(padded[i : i + size]) for i in range(len(own))]

    sizes = range(1, order + 1)
    all_runs = [{k: runs(i, k) for k in sizes} for i in ids]
    own = [{k: Counter(r[k]) for k in sizes} for r in all_runs]
    starts = [{k: Counter(g[:-1] for g in r[k]) for k in sizes} for r in all_runs]
    every = {k: sum((o[k] for o in own), Counter()) for k in sizes}
    before = {k: sum((s[k] for s in starts), Counter()) for k in sizes}

    total = sum(every[1].values())

    def one(cell, at):
        for steps, size in enumerate(range(order, 1, -1)):
            gram = all_runs[cell][size][at]
            seen = every[size][gram] - own[cell][size][gram]
            if seen:
                return math.log10(0.4**steps * seen / (before[size][gram[:-1]] - starts[cell][size][gram[:-1]]))
        gram = all_runs[cell][1][at]
        rest = total - len(ids[cell])
        return math.log10(0.4 ** (order - 1) * max(every[1][gram] - own[cell][1][gram], 1) / max(rest, 1))

    scored = backoff.backoff_scores(table(spark, TEXTS), "note", PATH, order=order, chunk_tokens=tokens)
    found = {r.row_index: r for r in scored.collect()}
    assert len(found) == len(TEXTS)
    for i, tokens in enumerate(ids):
        assert found[i].n_tokens == len(tokens)
        assert found[i].score == pytest.approx(sum(one(i, at) for at in range(len(tokens))), abs=1e-6)
        assert (found[i].mean_score is None) == (not tokens)
    assert backoff.backoff_scores(table(spark, []), "note", PATH, order=order).count() == 0
    with pytest.raises(ValueError):
        backoff.backoff_scores(table(spark, []), "note", PATH, order=4)
