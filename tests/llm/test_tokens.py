import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hushlake.llm.tokens import WordEncoder

PIECES = ["a", "B", "é", "\n", "\t", " ", " ", "'s", "1", "23", ",", "...", " word", "word", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "İ", "Σ", "ς", "́", "😀", "-", "　", " ", "\r\n", "ÿ", "×"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_equals_the_library_on_whole_texts(name):
    rng = random.Random(8)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(15_000)]
    encoder = WordEncoder(public_tokenizers.path(name), cache_words=2000, cache_pieces=500)
    want = Tokenizer.from_file(public_tokenizers.path(name)).encode_batch(texts, add_special_tokens=False)
    for text, got, ids in zip(texts, encoder.encode_many(texts), want, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == ids.ids, repr(text)


def test_nulls_and_long_words():
    encoder = WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    got = encoder.encode_many([None, "", "x " + "y" * 20_000])
    assert got[:2] == [b"", b""] and len(got[2]) > 4


def test_words_are_only_used_where_they_equal_the_library(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert WordEncoder(path).by_word
    monkeypatch.setattr(WordEncoder, "_word", lambda self, word: b"\0\0\0\0")
    broken = WordEncoder(path)
    assert not broken.by_word
    assert np.frombuffer(broken.encode_many(["two words"])[0], "<u4").tolist() == Tokenizer.from_file(path).encode("two words", add_special_tokens=False).ids
