"""Repeated rows, null ids, clashing columns and equal texts in the stages; long texts; scores and spans of any batch."""

import random
import time

import numpy as np
import pytest

from homescore.llm import near_dedup, quality_model, secrets, substring_dedup
from homescore.llm.common import free_name

NAMES = ["k1", "k2", "s", "node", "component", "blocks", "given", "n", "h1", "first", "signature"]
rng = random.Random(12)


def text(n, seed):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(5000)}" for _ in range(n))


def frame(spark, rows):
    schema = "doc_id long, text string, " + ", ".join(f"{n} string" for n in NAMES)
    return spark.createDataFrame([(i, t, *NAMES) for i, t in rows], schema).repartition(3)


def left(df):
    assert all(tuple(r[n] for n in NAMES) == tuple(NAMES) for r in df.select(*NAMES).collect())
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


A, B, C = text(80, 1), text(80, 2), text(80, 3)
NEAR = A.rsplit(" ", 2)[0] + " other words"


def test_one_row_of_each_component_stays(spark):
    rows = [(1, A), (1, A), (2, A), (7, B), (None, B), (None, C), (None, C), (None, C), (-1, text(80, 4)), (3, NEAR), (5, None), (5, None), (None, " ")]
    kept = left(near_dedup.drop_near_duplicates(frame(spark, rows)))
    assert kept == sorted([(1, A), (7, B), (None, C), (-1, text(80, 4)), (5, None), (5, None), (None, " ")], key=repr)
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert {(1, 1, True), (2, 1, False), (3, 1, False), (None, 7, False), (None, None, True), (-1, -1, True)} <= got


def test_null_ids_with_near_texts_leave_one(spark):
    kept = left(near_dedup.drop_near_duplicates(frame(spark, [(None, A), (None, NEAR)])))
    assert len(kept) == 1 and kept[0] in [(None, A), (None, NEAR)]
    assert left(near_dedup.drop_near_duplicates(frame(spark, [(1, A)]).limit(0))) == []


def test_many_repeated_rows_without_ids(spark):
    """A hot key: the work grows with the rows, and all of them are judged alike."""
    long_ = text(300, 8)
    df = frame(spark, [(None, long_)] * 600 + [(4, C)])
    start = time.perf_counter()
    kept = left(substring_dedup.remove_repeats(df))
    assert kept == sorted([(None, "")] * 600 + [(4, C)], key=repr)
    assert time.perf_counter() - start < 90
    one = substring_dedup.dedup_substrings(frame(spark, [(None, long_), (4, C)])).collect()
    assert all(r.n_removed == 0 for r in one)


def test_repeats_with_clashing_columns(spark):
    shared = text(60, 9)
    rows = [(1, text(20, 10) + " " + shared), (1, shared + " " + text(20, 11)), (None, None), (None, ""), (2, C)]
    assert left(substring_dedup.remove_repeats(frame(spark, rows))) == sorted([(1, text(20, 10)), (1, text(20, 11)), (None, None), (None, ""), (2, C)], key=repr)
    assert left(substring_dedup.remove_repeats(frame(spark, rows).limit(0))) == []
    assert free_name("a", ["a", "a_"]) == "a__"


def test_equal_32_bit_hashes_are_told_apart(spark):
    """Two texts with one 32-bit hash, both without id: each keeps its own blocks."""
    seen, pair = {}, None
    rows = spark.range(150_000).selectExpr("id", "hash(concat('t', id)) h").collect()
    for r in rows:
        if r.h in seen:
            pair = seen[r.h], r.id
            break
        seen[r.h] = r.id
    assert pair, "no two texts of one hash among so many"
    x, y = (f"t{k}" for k in pair)
    rows = frame(spark, [(None, x), (None, y), (None, x)])
    got = substring_dedup._keyed(rows, "doc_id", "text").select("k1", "k2").distinct().count()
    assert got == 2


def test_score_does_not_depend_on_the_batch():
    weights = np.random.default_rng(3).normal(size=1 << 12)
    model = quality_model.Model(weights, 0.1)
    texts = [text(rng.randrange(1, 400), k) for k in range(30)] + ["", None]
    alone = [quality_model.score_texts([t], model)[0] for t in texts]
    for _ in range(4):
        order = rng.sample(range(len(texts)), len(texts))
        mixed = quality_model.score_texts([texts[k] for k in order], model)
        assert [mixed[order.index(k)] for k in range(len(texts))] == alone


def test_spans_of_a_long_text_in_linear_time():
    """Tens of thousands of base and random spans in one text."""
    import public_tokenizers

    scanner = secrets.SecretScanner(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    r = random.Random(5)
    letters = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789"
    odd = ["".join(r.choice(letters) for _ in range(24)) for _ in range(400)]
    line = " ".join(f"token={odd[k]} {odd[-k]}" for k in range(400))
    start = time.perf_counter()
    spans = scanner.spans((line + " ") * 40)
    assert len(spans) > 25_000 and time.perf_counter() - start < 10
    small = scanner.spans(line)
    assert spans[: len(small)] == small


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "")]])
def test_secrets_of_empty_tables(spark, rows):
    import public_tokenizers

    found = secrets.redact(frame(spark, rows), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert left(found) == sorted(rows, key=repr)
