"""Language and quality models: accuracy on held-out rows, edge cases, and a plain version of their sums."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from homescore.llm import language, quality_model
from homescore.llm.common import held_out, table

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "12 34 !"), (4, "ab " * 60000), (4, "ab " * 60000), (5, "中"), (None, "the")]


def odd(spark):
    return spark.createDataFrame([(i, t, 0.5, "x") for i, t in ODD], "doc_id long, text string, score double, lang_pred string")


def test_held_out_rule(spark):
    got = {r.i: r.h for r in spark.range(200).select(F.col("id").alias("i"), held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(200)}


def test_language_of_held_out_documents(spark):
    got = language.op7_hyperdimensional_language(spark, SF)
    both = got.join(table(spark, SF, "documents"), "doc_id").collect()
    assert len(both) == table(spark, SF, "documents").count()
    judged = [r for r in both if r.held_out and r.lang_pred != "und"]
    assert np.mean([r.lang == r.lang_pred for r in judged]) > 0.95
    assert all(0 <= r.score <= 1 for r in both)


def test_bundle_is_a_sum_of_bound_letters():
    text = "Ab  ñc!"
    v = language._letter_vectors(64, 3).astype(int)
    s = [0, 1, 2, 0, 27 + ord("ñ") % 37, 3, 0]
    want = sum(np.roll(v[a], 2) * np.roll(v[b], 1) * v[c] for a, b, c in zip(s, s[1:], s[2:]))
    assert (language.trigram_vectors(language.trigrams_of(text), 64, 3).astype(int).sum(0) == want).all()


def test_language_of_odd_rows(spark):
    model = language.fit(table(spark, SF, "documents"))
    rows = [(r.doc_id, r.lang_pred, r.score) for r in language.predict(odd(spark), model).collect()]
    assert len(rows) == len(ODD)
    by = {i: (p, s) for i, p, s in rows}
    assert by[1] == by[2] == by[3] == ("und", 0.0)
    assert by[5][0] in model.languages and [r for r in rows if r[0] == 4][0] == [r for r in rows if r[0] == 4][1]
    assert language.predict(odd(spark).limit(0), model).count() == 0
    nothing = language.fit(odd(spark).limit(0).withColumn("lang", F.lit("en")))
    assert {r.lang_pred for r in language.predict(odd(spark), nothing).collect()} == {"und"}


def test_quality_of_held_out_documents(spark):
    got = quality_model.op8_subword_quality(spark, SF).join(table(spark, SF, "labels"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.93
    assert all(r.predicted == int(r.score >= 0.7) for r in got)


def test_features_against_plain_loops():
    texts = ["ab ab c", None, "é\nab", "x y x y"]
    found, at = quality_model.features(texts, 1 << 16)
    for k, text in enumerate(texts):
        own = found[at[k] : at[k + 1]]
        alone, _ = quality_model.features([text], 1 << 16)
        assert sorted(own) == sorted(alone)
        words, raw = (text or "").split(), b" " + (text or "").encode() + b" "
        repeats = sum(words[i] == words[i - lag] for lag in (1, 2, 3, 4) for i in range(lag, len(words)))
        assert len(own) == len(words) + len(raw) - 2 + repeats


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1), (3, 0), (3, 0), (2, None), (None, 1), (99, 1)], "doc_id long, quality int")
    model = quality_model.fit(odd(spark), labels)
    rows = [(r.doc_id, r.score) for r in quality_model.score(odd(spark), model).collect()]
    assert len(rows) == len(ODD) and all(0 <= s <= 1 for _, s in rows)
    assert dict(rows)[1] == dict(rows)[2]
    assert quality_model.score(odd(spark).limit(0), model).count() == 0
    untaught = quality_model.fit(odd(spark), labels.limit(0), quality_model.Training(epochs=1))
    assert dict((r.doc_id, r.score) for r in quality_model.score(odd(spark), untaught).collect())[4] == pytest.approx(0.5)
