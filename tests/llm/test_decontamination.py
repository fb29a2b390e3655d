"""Benchmark decontamination against plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from homescore.llm import decontamination as D
from tests.conftest import plan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SEEN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
rng = random.Random(4)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def sentence(n):
    return " ".join(rng.choice("ab cd ef gh ij".split()) + str(rng.randrange(30)) for _ in range(n))


LONG, SHORT, HOT = sentence(30), "Tiny Item \u00c9!", sentence(12)
ITEMS = [
    (1, LONG), (2, sentence(10)), (10, SHORT), (3, None), (4, " .,; "), (5, HOT), (6, HOT), (6, HOT), (7, HOT + " more words"),
    (None, sentence(11)), (8, "one"), (9, LONG.upper()),
]
DOCS = [
    (1, "Before, " + LONG.upper().replace(" ", "--") + " after."), (2, sentence(40)), (3, None), (4, ""), (5, " ?! "),
    (6, "x tiny\titem\n\u00c9 y Tiny item \u00e9"), (7, HOT + " . " + HOT), (7, HOT), (7, HOT), (8, " ".join(LONG.split()[3:12])),
    (9, " ".join(LONG.split()[3:13]) + " " + " ".join(LONG.split()[3:14])), (None, ITEMS[9][1]), (None, "clean"),
    (11, "One one oNe " * 3), (12, sentence(6000) + " " + LONG + " " + sentence(6000)), (13, "\u00dcber \u00c9! z\u00e9 1,2"),
]


def spans(text, items):
    """Hit places and the ids of items found."""
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        x = words(t)
        k = min(len(x), 10)
        mine = {tuple(x[i : i + k]) for i in range(len(x) - k + 1)} if k else set()
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in mine:
                hit |= set(range(i, i + k))
                ids |= {str(item)} - {"None"}
    return hit, sorted(ids)


def wanted(docs, items):
    out = []
    for doc, text in docs:
        hit, ids = spans(text, items)
        out.append((doc, len(words(text)), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame([(d, t, "row", "key") for d, t in DOCS], "doc_id long, text string, row string, key string").repartition(3)


@pytest.fixture()
def items(spark):
    return spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, size int")


def got(df):
    assert df.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("bound", [48_000_000, 0])
def test_like_plain_python(spark, docs, items, bound):
    """The same rows whether the windows are broadcast or, past the bound, shuffled."""
    df = D.contamination(docs, items, D.NGrams(broadcast_bytes=bound))
    assert got(df) == wanted(DOCS, ITEMS)


def test_broadcast_only_under_the_bound(spark, docs, items):
    windows, _ = D.benchmark_windows(items, D.NGrams(), "item_id", "text")
    assert D._sizes(windows)[0] == [10, 3, 1]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.lit(1).alias("given"), D.normalised_words(F.col("text")).alias("words"))
    assert "ResolvedHint (strategy=broadcast)" in plan(D._finds(rows, windows, D.NGrams()))
    assert "strategy=broadcast" not in plan(D._finds(rows, windows, D.NGrams(broadcast_bytes=0)))


def test_no_python_in_the_plan(spark, docs, items):
    text = plan(D.contamination(docs, items)) + plan(D.decontaminate(docs, items))
    assert not re.search("Python|Pandas|Arrow", text)


def test_other_window(spark, docs, items):
    df = D.contamination(docs, items, D.NGrams(window=4))
    n = {(r.doc_id, r.n_words): r.n_hit for r in df.collect()}
    assert n[(8, 9)] == 9


def test_equal_keys_are_told_apart(spark, docs, items, monkeypatch):
    """Finds are verified: with one hash for all windows the rows are the same."""
    monkeypatch.setattr(D, "_key", lambda hashes, at, size: F.xxhash64(hashes[at] * 0))
    few = [d for d in DOCS if d[0] != 12]
    df = D.contamination(docs.where("doc_id is null or doc_id <> 12"), items)
    assert got(df) == wanted(few, ITEMS)


def test_empty_tables(spark, docs, items):
    assert D.contamination(docs.limit(0), items).count() == 0
    assert got(D.contamination(docs, items.limit(0))) == wanted(DOCS, [])
    assert D.decontaminate(docs, items.limit(0)).count() == len(DOCS)


def cut(text):
    hit, _ = spans(text, ITEMS)
    if not hit:
        return text
    starts = [m.start() for m in SEEN.finditer(text)] + [len(text)]
    return text[: starts[0]] + "".join(text[starts[k] : starts[k + 1]] for k in range(len(starts) - 1) if k not in hit)


def test_spans_are_removed(spark, docs, items):
    left = D.decontaminate(docs, items)
    assert left.schema == docs.schema
    assert sorted((tuple(r) for r in left.collect()), key=repr) == sorted(((d, cut(t), "row", "key") for d, t in DOCS), key=repr)


def test_documents_are_removed(spark, docs, items):
    left = D.decontaminate(docs, items, remove="documents")
    clean = [(d, t, "row", "key") for d, t in DOCS if not spans(t, ITEMS)[0]]
    assert sorted((tuple(r) for r in left.collect()), key=repr) == sorted(clean, key=repr)
    with pytest.raises(ValueError):
        D.decontaminate(docs, items, remove="lines")


def test_one_passage_in_many_items_and_documents(spark):
    """A digest is made once for all documents that the same items hit."""
    many = spark.range(300).select(F.col("id").alias("item_id"), F.lit(HOT).alias("text"))
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b "), F.lit(HOT)).alias("text"))
    rows = D.contamination(docs, many).select("n_items", "items_sha256").distinct().collect()
    assert [tuple(r) for r in rows] == [(300, hashlib.sha256(",".join(sorted(map(str, range(300)))).encode()).hexdigest())]
