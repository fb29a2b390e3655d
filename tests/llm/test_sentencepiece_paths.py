"""Paths through the lattice of a word: the one that is finite, found without composing the others."""

import public_tokenizers
import sentencepiece

from homescore.llm.sentencepieces import MARK, Transducer

PATH = public_tokenizers.path("piece_bpe_32k.model")
WORDS = ["internationalisation", "unbelievably", "qzxv", "aaaaaaaaaaaaaaaa", "Straßenbahnhaltestelle", "中b文", "0x41ff", "e" * 300]


def test_few_pairs_are_asked_for():
    ours, theirs = Transducer(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    for word in WORDS[:3]:
        ours.path(MARK + word)
    assert ours.n_pairs <= 51
    for word in WORDS:
        assert "".join(ours.path(MARK + word)) == MARK + word
        whole = [k for p in ours.path(MARK + word) for k in ([ours.ids[p]] if p in ours.ids else [ours.bytes[b] for b in p.encode()])]
        assert whole == theirs.encode(word)


def test_no_text_has_no_piece():
    assert Transducer(PATH).path("") == []
