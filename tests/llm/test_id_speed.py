"""The coder's files stay as they were, and words and places are worked on many at once."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from homescore.llm import coder, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
IDS = (np.arange(5000) ** 2 * 7919 + np.arange(5000) // 3) % 977 % 61 * 800 % 49408


def test_coded_bytes_are_those_of_the_first_coder():
    assert hashlib.sha256(coder.encode(IDS, 49408)).hexdigest() == "1f93579cc9ec04d172e5300cc48eb9129d9830e87b7982cb40ba81152022c4e4"


def test_groups_of_blocks_do_not_show(monkeypatch):
    whole = coder.encode(IDS, 49408)
    monkeypatch.setattr(coder, "_LANES", 3)
    assert coder.encode(IDS, 49408) == whole
    assert coder.decode(whole).tolist() == IDS.tolist()


def test_the_writer_computes_the_mixture_of_many_places_at_once(monkeypatch):
    calls, plain = [], coder._quotient
    monkeypatch.setattr(coder, "_quotient", lambda a, b: calls.append(1) or plain(a, b))
    coder.encode(IDS, 49408)
    assert len(calls) <= coder.BLOCK_IDS / 4


def test_new_words_are_encoded_together(monkeypatch):
    words, calls = tokens.WordIds(PATH, False), []

    class Counting:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, texts, **more):
            calls.extend(texts)
            return self.inner.encode_batch_fast(texts, **more)

    words.plain, words.tokenizer = Counting(words.plain), Counting(words.tokenizer)
    texts = [f"word{'abcdefghij'[k % 10]} Wört{'abcdefghij'[k // 10]}, {k}".encode() for k in range(100)]
    got = list(words.all_ids(texts))
    assert len(calls) <= 2
    theirs = Tokenizer.from_file(PATH)
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [theirs.encode(str(t, "utf-8"), add_special_tokens=False).ids for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("abS'.,0÷×ßÀÿµ_é. \n\t\x1c <|>́Σ字"), max_size=20), max_size=6), st.sampled_from([0, 3, 1000]))
def test_all_ids_are_the_tokenizers(texts, most):
    words, theirs = tokens.word_ids(PATH, False, most), tokens.word_ids(PATH, False).tokenizer
    got = list(words.all_ids([t.encode() for t in texts] + [None, b""]))
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [theirs.encode(t, add_special_tokens=False).ids for t in texts] + [[], []]


@pytest.mark.parametrize("name, spaced", [("byte_bpe_50k.json", True), ("byte_bpe_50k.json", False)])
def test_other_vocabularies_are_not_cut_as_plain(name, spaced):
    assert tokens.WordIds(public_tokenizers.path(name), spaced).plain is None
