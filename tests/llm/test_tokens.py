"""Packing and coded id files against the tokenizer itself."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from homescore.llm import coder, packing, token_files
from homescore.llm.tokens import WordIds

TEXTS = [
    "Plain words, here.\nNext line", None, "", " ", "\n", "two  spaces", " lead and trail ", "tab\tand\r\nbreak",
    "it's <|endoftext|> special", "ümlaut é ß Σς İ", "\x1c odd \x85 spaces   here", "x" * 5000, "word " * 6000, "Plain words, here.\nNext line",
]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.mark.parametrize("name, spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_cached_ids_are_the_tokenizers(name, spaced):
    path = public_tokenizers.path(name)
    ours, theirs = WordIds(path, spaced), Tokenizer.from_file(path)

    @settings(max_examples=150, deadline=None)
    @given(st.text(st.sampled_from("ab'sé. \n\t\x1c <|>0ß́"), max_size=30))
    def same(text):
        assert np.frombuffer(ours.ids(text), "<u2").tolist() == theirs.encode(text, add_special_tokens=False).ids

    same()
    for text in TEXTS:
        assert np.frombuffer(ours.ids(text), "<u2").tolist() == theirs.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 4000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 49408, n), rng.zipf(1.3, n) % 49408, np.full(n, 49407), np.arange(n) % 5):
        assert coder.decode(coder.encode(ids, 49408)).tolist() == ids.tolist()


def test_coder_shrinks_repeats_and_notices_damage():
    ids = np.tile(np.arange(100, 140), 200)
    data = coder.encode(ids, 49408)
    assert len(data) < len(ids)
    broken = bytearray(data)
    broken[-40] ^= 255
    with pytest.raises(ValueError):
        coder.decode(bytes(broken))


def frame(spark, texts):
    rows = [(k * 3, t, "x", k) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, ids int").repartition(3)


def test_id_files(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    token_files.write_ids(frame(spark, TEXTS), str(tmp_path / "ids"), path)
    got = {r.doc_id: r for r in token_files.read_ids(spark, str(tmp_path / "ids"), with_ids=True).collect()}
    theirs, start = Tokenizer.from_file(path), 0
    assert len(got) == len(TEXTS)
    for k, text in enumerate(TEXTS):
        ids = [*theirs.encode(text or "", add_special_tokens=False).ids, 2]
        row = got[k * 3]
        assert (row.start, row.n_tokens, row.ids_crc32, row.ids) == (start, len(ids), crc(ids), ids)
        start += len(ids)
    token_files.write_ids(frame(spark, TEXTS).limit(0), str(tmp_path / "none"), path)
    assert token_files.read_ids(spark, str(tmp_path / "none")).count() == 0


def check_packing(rows, ids_of, limits):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for doc_id, own in pieces.items():
        at, ids = 0, ids_of[doc_id]
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limits.tokens and len(own) <= limits.segments
    return sequences


def test_pack_all_documents(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    theirs = Tokenizer.from_file(path)
    ids_of = {k * 3: [*theirs.encode(t or "", add_special_tokens=False).ids, 1] for k, t in enumerate(TEXTS)}
    df = frame(spark, TEXTS).coalesce(1)
    sequences = check_packing(packing.pack(df, path).collect(), ids_of, packing.Limits())
    assert sum(sum(r.length for r in own) < 2048 for own in sequences.values()) <= 1
    small = packing.Limits(tokens=64, segments=3, loss=64)
    check_packing(packing.pack(df, path, small).collect(), ids_of, small)
    assert packing.pack(df.limit(0), path).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 90), st.integers(0, 90)), max_size=40), st.integers(1, 40), st.integers(1, 5), st.integers(1, 40))
def test_packer_holds_every_limit(examples, tokens, segments, loss):
    packer = packing.Packer(packing.Limits(tokens, segments, loss))
    n = np.array([a for a, _ in examples], np.int64)
    bearing = np.minimum(n, np.array([b for _, b in examples], np.int64))
    used, covered = {}, [0] * len(n)
    half = len(n) // 2
    for at, part in ((0, slice(0, half)), (half, slice(half, None))):
        for k, start, length, sequence, offset in packer.pack(n[part], bearing[part]):
            k += at
            assert start == covered[k]
            covered[k] += length
            t, s, b = used.get(sequence, (0, 0, 0))
            assert offset == t
            free = int(n[k] - bearing[k])
            used[sequence] = (t + length, s + 1, b + max(0, start + length - max(free, start)))
    assert covered == n.tolist()
    assert all(t <= tokens and s <= segments and b <= loss for t, s, b in used.values())
