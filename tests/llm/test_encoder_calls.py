"""A Latin text is one call to the vocabulary however many words it has, and ids stay those of the tokenizer."""

import itertools

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tidyledger.llm.packing import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORDS = ["".join(w) for w in itertools.product("ab", "eio", "lnrst", "aou", "dg", "äy")]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize(
    "text,most", [(" ".join(WORDS), 1), ("\n  ".join(WORDS), 1), (" ".join([*WORDS, "it’s", *WORDS]), 4)]
)
def test_calls(monkeypatch, tokenizer, text, most):
    calls = []

    class Counted(tiktoken.Encoding):
        def encode_ordinary(self, *args, **kwargs):
            calls.append(1)
            return super().encode_ordinary(*args, **kwargs)

        def encode_to_numpy(self, *args, **kwargs):
            calls.append(1)
            return super().encode_to_numpy(*args, **kwargs)

    monkeypatch.setattr(tiktoken, "Encoding", Counted)
    encode = Encoder(PATH, added=True)
    own = encode._ids
    monkeypatch.setattr(encode, "_ids", lambda text: calls.append(1) or own(text))
    assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(calls) <= most < len(WORDS)


@pytest.mark.parametrize(
    "text",
    [
        "x" * 3000 + " " + "ab1" * 700 + "é" * 300, " " * 1_200_000 + "a", "a" + "\n" * 300 + "b ", "we'll they'VE 's ''s",
        "a \x1c b \x85 c \xa0 d\x0b\x0c e", "“quoted” words — and more  “ ” \n’ end", "<|endoftext|> it’s", "Straße я ж x",
        "".join(map(chr, range(0x250))), " ".join(map(chr, range(0x300))), "日本 a 日  b\u3000 c", "", " ", "\n",
    ],
)
def test_ids(tokenizer, text):
    found = np.frombuffer(Encoder(PATH, added=True)(text), "<u4").tolist()
    assert found == tokenizer.encode(text, add_special_tokens=False).ids
