"""The transducer against the library that the model file belongs to."""

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from homescore.llm import sentencepieces as S
from homescore.llm.common import table

PATH = public_tokenizers.path("piece_bpe_32k.model")
OURS, THEIRS = S.Transducer(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXTS = [None, "", " ", "a", "  two  spaces ", " " * 40 + "x" + " " * 17, "\n\t\x00", "<s> <0x41>", "中文😀 ﬁ é", "x▁y", "z" * 3000, "word " * 5000, "\U0010ffff"]


def same(text):
    ids = np.frombuffer(OURS.encode(text), "<u2").tolist()
    assert ids == THEIRS.encode(text or "")
    assert OURS.decode(OURS.encode(text)) == THEIRS.decode(ids) == (text or "").replace(S.MARK, " ")


def test_texts():
    for text in TEXTS:
        same(text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("abelnorstu AEé▁中\n.'0ß😀"), max_size=40))
def test_random_texts(text):
    same(text)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=20))
def test_any_text(text):
    same(text)


def test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = {r.doc_id: r.ids for r in S.encode(docs, PATH).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got == {k: THEIRS.encode(t or "") for k, t in texts.items()}
    back = {r.doc_id: r.text for r in S.decode(S.encode(docs, PATH), PATH).collect()}
    assert back == {k: t or "" for k, t in texts.items()}


def test_query_columns(spark):
    rows = spark.createDataFrame([(k, t, "c", 1) for k, t in enumerate(TEXTS)], "doc_id long, text string, ids string, n_tokens int")
    got = {r.doc_id: r for r in S.digests(rows, PATH).collect()}
    assert all(got[k].n_tokens == len(THEIRS.encode(t or "")) and got[k].round_trip == (S.MARK not in (t or "")) for k, t in enumerate(TEXTS))
    assert S.digests(rows.limit(0), PATH).count() == 0
    assert S.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), PATH).collect()[0].text == ""
