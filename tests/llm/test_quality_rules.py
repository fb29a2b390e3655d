"""Quality rules against plain Python counts."""

import math
import re
from collections import Counter

import pytest

from homescore.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", " \n\t ", "one two", "a a a a a", "a b c a b c d\n\na b c\r", "x\ny\nx\n \n \nx", "é # $ * ü|<>&%   z",
    "red green blue " * 40, " ".join(f"w{k}" for k in range(80)), " ".join(f"w{k}" for k in range(80)), "long " * 3000 + "end",
]


def expected(text):
    words = WORD.findall(text or "")
    runs = Counter(zip(words, words[1:], words[2:]))
    repeated = {k + j for k in range(len(words) - 2) if runs[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated), failed


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame([(k, t, "w", [k]) for k, t in enumerate(TEXTS)], "doc_id long, text string, words string, lines array<int>")


def test_base_counts(spark, docs):
    trusted = spark.createDataFrame([(9,), (9,), (77,)], "doc_id long")
    got = {r.doc_id: r for r in Q.quality_rules(docs, trusted).collect()}
    assert len(got) == len(TEXTS)
    for k, text in enumerate(TEXTS):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == expected(text)
        assert r.kept is False if r.base_failed else r.kept in (True, False)


def test_ratios_add_up(spark, docs):
    """The log ratios are those of counts taken in Python over the same buckets."""
    rules = Q.LlrRules(buckets=16, sizes=(1,), smoothing=1.0)
    trusted = spark.createDataFrame([(9,)], "doc_id long")
    bucket = {r.w: r.b for r in spark.createDataFrame([(w,) for t in TEXTS for w in WORD.findall(t or "")], "w string").distinct().selectExpr("w", "pmod(xxhash64(w), 16) b").collect()}
    raw, target = Counter(), Counter()
    for k, text in enumerate(TEXTS):
        for w in WORD.findall(text or ""):
            raw[bucket[w]] += 1
            target[bucket[w]] += k == 9
    n_raw, n_target = sum(raw.values()) + 16, sum(target.values()) + 16
    want = [round(10_000 * (math.log((target[b] + 1) / n_target) - math.log((raw[b] + 1) / n_raw))) for b in range(16)]
    assert Q.log_ratios(docs, trusted, rules) == want
    got = {r.doc_id: r.llr_units for r in Q.quality_rules(docs, trusted, rules).collect()}
    assert got[5] == sum(want[bucket[w]] for w in WORD.findall(TEXTS[5]))


def test_nothing_trusted_and_empty_table(spark, docs):
    none = spark.createDataFrame([], "doc_id long")
    assert all(r.kept != r.base_failed for r in Q.quality_rules(docs, none).collect())
    assert Q.quality_rules(docs.limit(0), none).count() == 0


def test_all_trusted_documents_count(spark):
    """Shares come from every trusted document, be their ids one block or several."""
    many = spark.range(21_000).selectExpr("id doc_id", "concat('w', if(id < 20500, 0, 1)) text")
    trusted = many.where("doc_id < 20900").select("doc_id")
    bucket = {w: spark.sql(f"select pmod(xxhash64('{w}'), 64) b").first().b for w in ("w0", "w1")}
    raw, target = {bucket["w0"]: 20_500, bucket["w1"]: 500}, {bucket["w0"]: 20_500, bucket["w1"]: 400}
    assert len(raw) == 2
    want = [round(10_000 * (math.log((target.get(b, 0) + 1) / (20_900 + 64)) - math.log((raw.get(b, 0) + 1) / (21_000 + 64)))) for b in range(64)]
    assert Q.log_ratios(many, trusted, Q.LlrRules(buckets=64, sizes=(1,), smoothing=1.0)) == want
    assert Q.log_ratios(many, trusted.union(trusted), Q.LlrRules(block_ids=4_000, buckets=64, sizes=(1,), smoothing=1.0)) == want
