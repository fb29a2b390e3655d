"""Substring dedup against a count of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from homescore.llm import substring_dedup as S
from homescore.llm.common import table

SF = "/root/testdata/sf0.001"


def expected(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts, window):
    rows = [(k, t, "f", [k]) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, factors string, s array<int>").repartition(3)
    got = {r.doc_id: r for r in S.dedup_substrings(df, window).collect()}
    assert len(got) == len(texts)
    for k, want in enumerate(expected(texts, window)):
        r = got[k]
        assert (r.n_words, r.n_removed, r.kept_sha256) == want, k
        covered = {i for f in r.factors for i in range(f.start, f.start + f.length)}
        assert len(covered) == r.n_removed and all(f.length >= window for f in r.factors)


@pytest.mark.parametrize("window", [5, 12])
def test_random_texts(spark, window):
    rng = random.Random(window)
    passages = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(3, 40))) for _ in range(6)]
    texts = [None, "", " \n", "a " * 60, "a b " * 40]
    for _ in range(50):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(str(rng.randint(0, 400)) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 5))]
        texts.append(rng.choice([" ", "\n", "\t "]).join(parts))
    check(spark, texts + texts[8:10], window)


def test_documents(spark):
    check(spark, [r.text for r in table(spark, SF, "documents").orderBy("doc_id").collect()], 35)


def test_repeated_ids_and_no_rows(spark):
    p = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(1, p), (1, p), (1, "x " + p), (None, "only me " * 9), (2, None)], "doc_id long, text string")
    got = sorted((r.n_words, r.n_removed) for r in S.dedup_substrings(df).collect())
    assert got == [(0, 0), (18, 0), (40, 40), (40, 40), (41, 40)]
    assert S.dedup_substrings(df.limit(0)).count() == 0


def test_removal_keeps_other_columns_and_untouched_texts(spark):
    p = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(1, f"a\n{p} b", "s", 9), (2, f"{p}  c", "t", 9), (3, " own\n text ", "u", 7), (4, None, "v", None)], "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.source, r.n_chars) for r in S.remove_repeats(df).collect()}
    assert got == {1: ("a b", "s", 3), 2: ("c", "t", 1), 3: (" own\n text ", "u", 7), 4: (None, "v", None)}


def test_least_of_windows():
    values = np.random.default_rng(1).integers(0, 9, 200).astype(np.uint64)
    for size in (1, 2, 3, 7, 28):
        assert S.least_of_windows(values, size).tolist() == [i + int(np.argmin(values[i : i + size])) for i in range(200 - size + 1)]
