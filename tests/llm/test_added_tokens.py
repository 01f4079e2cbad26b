"""The queries tokenize as the stated file does by default: the string of an added token is that token."""

import math
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidyledger.llm import queries
from tidyledger.llm.packing import Encoder, pieces

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "<|endoftext|>", "a <|endoftext|> b", "one<|endoftext|>two words", "tail  <|endoftext|>", "<|endoftext|><|endoftext|> x",
    "almost <|endoftext| > and <|endoftext", "no such string here", "", "words " * 3000 + "<|endoftext|>\n\n next <|endoftext|>",
]


@pytest.fixture(scope="module")
def ids():
    own = Tokenizer.from_file(PATH)
    return [own.encode(t, add_special_tokens=False).ids for t in TEXTS]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("quoting"))
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    frame.write.parquet(f"{folder}/documents.parquet")
    return folder


def test_ids(ids):
    encode = Encoder(PATH, added=True)
    assert [np.frombuffer(encode(t), "<u4").tolist() for t in TEXTS] == ids
    assert sum(i.count(50256) for i in ids) == 8


def test_packing(spark, data, ids):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for frame in (queries.QUERIES["op4_sum_of_squares_packing"](spark, data), corpus_pipeline.packed(spark, docs, data)):
        found = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in frame.collect())
        expected = []
        for doc, own in enumerate(ids):
            whole = np.array([*own, 2], "<u4")
            for n, (start, length) in enumerate(pieces(len(whole), 1024)):
                expected.append((doc, n, start, length, zlib.crc32(whole[start : start + length].tobytes())))
        assert found == expected


def test_scores(spark, data, ids):
    own = [Counter(zip(["start", *i[:-1]], i)) for i in ids]
    table = sum(own, Counter())
    starts = [Counter(["start", *i[:-1]] if i else []) for i in ids]
    before, word, total = sum(starts, Counter()), Counter(t for i in ids for t in i), sum(map(len, ids))

    def one(doc, g, n):
        """All counts are those of the other cells; a token that none of them has counts once."""
        rest = table[g] - n
        if rest:
            return math.log10(rest / (before[g[0]] - starts[doc][g[0]]))
        return math.log10(0.4 * max(word[g[1]] - ids[doc].count(g[1]), 1) / max(total - len(ids[doc]), 1))

    for r in queries.QUERIES["op7_stupid_backoff_scores"](spark, data).collect():
        assert r.n_tokens == len(ids[r.doc_id])
        expected = sum(n * one(r.doc_id, g, n) for g, n in own[r.doc_id].items())
        assert r.score == pytest.approx(expected, abs=1e-6)
