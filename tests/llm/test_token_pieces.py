"""Splitting of spaced texts into the pieces that are encoded by themselves."""

import struct

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from homescore.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("text", ["", "a", " a b\nc ", "\na\n", "a \tb\x00c d\n\x00", "word\nword word", "<|x|> a b", "a  b", "é b ü\n", " ", "\n"])
def test_pieces_of_a_spaced_text_are_its_own(text):
    found = tokens.word_ids(PATH, True)._pieces(text)
    if found is not None:
        assert [p for p in found if p] == tokens._SPACED_PIECE.findall(text)
    ids = tokens.word_ids(PATH, True).ids(text)
    whole = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u2").tolist() == whole


def test_pieces_are_split_without_matching(monkeypatch):
    monkeypatch.setattr(tokens, "_SPACED_PIECE", None)
    assert tokens.WordIds(PATH, True)._pieces(" a b\nc") == ["", " a", " b", "\n", "c"]


def test_ids_are_little_endian():
    assert tokens._bytes_of([1, 65535, 258]) == struct.pack("<3H", 1, 65535, 258) == b"\x01\x00\xff\xff\x02\x01"


def test_a_cache_that_starts_anew_keeps_no_wrong_piece():
    small = tokens.WordIds(PATH, True, 2)
    first = [small.ids(x) for x in ("\na b c\n", "d e f\n", "\na b c\n")]
    assert first[0] == first[2] and all(first)
