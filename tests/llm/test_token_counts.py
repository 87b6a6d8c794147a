import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagetables.llm import token_counts as module
from pagetables.llm.token_counts import Counter, _rounds, _sweep, read_merges, token_counts
from tests.llm.data import awkward, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")
MERGES, LIBRARY = read_merges(PATH), Tokenizer.from_file(PATH)


def by_library(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(), st.text("ab \n'st1é漢")), max_size=5))
def test_equals_library(texts):
    assert list(Counter(MERGES).count(texts)) == [by_library(text) for text in texts]


@pytest.mark.parametrize("text", [
    "", " ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b <|endoftext", "a՘b 1՘ \U00011de0x", "\x85 　x",
    "a" * 70_000, "ab" * 500 + " " * 300, "漢字" * 4000, "\U0001f600" * 90, "I'll we've 's 'S", "x\x00y",
])
def test_special_texts(text):
    assert list(Counter(MERGES).count([text])) == [by_library(text)]


def test_rounds_equal_sweep():
    rng = random.Random(1)
    words = ["".join(rng.choice("aabcdehilnorst ") for _ in range(rng.randrange(1, 300))).encode() for _ in range(200)]
    lengths = np.array([len(word) for word in words])
    symbols = MERGES.first[np.frombuffer(b"".join(words), np.uint8)]
    assert _rounds(symbols.copy(), lengths, MERGES).tolist() == _sweep(symbols.copy(), lengths, MERGES).tolist()


def test_small_slabs(monkeypatch):
    monkeypatch.setattr(module, "SLAB", 40)
    monkeypatch.setattr(module, "REMEMBERED", 5)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc d'st é") for _ in range(rng.randrange(200))) for _ in range(50)]
    assert list(Counter(MERGES).count(texts)) == [by_library(text) for text in texts]


def test_rows(spark):
    frame = awkward(spark)
    got = sorted(map(tuple, token_counts(frame, PATH).collect()), key=str)
    want = [
        (row["doc_id"], len((row["text"] or "").encode()), by_library(row["text"]), by_library(row["text"]) > 512)
        for row in frame.select("doc_id", "text").collect()
    ]
    assert got == sorted(want, key=str)
    assert token_counts(empty(spark), PATH).collect() == []


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        read_merges(public_tokenizers.path("word_bpe_49k.json"))
