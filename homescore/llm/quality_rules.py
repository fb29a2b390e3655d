"""Quality rules in DataFrame functions alone: counts of a text, and how far its words are from trusted text."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from homescore.llm.common import id_text, table

_SPACE = r"[\x20\x09-\x0D]+"
_WORD_CHAR = r"[^\x20\x09-\x0D]"
_SYMBOL = r"[#*$%&|<>]"
#: Log ratios are kept as whole ten-thousandths, so their sums do not depend on any order.
UNIT = 10_000


@dataclass(frozen=True)
class LlrRules:
    """Buckets for hashed n-grams, n-gram sizes, smoothing, and the least mean log ratio kept.

    All trusted documents count; their ids are broadcast in blocks of about `block_ids`, one pass each.
    """

    block_ids: int = 1_000_000
    buckets: int = 8192
    sizes: tuple[int, ...] = (1, 2)
    smoothing: float = 4.0
    least: float = -0.05


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACE), "")


def _runs(words: Column, size: int) -> Column:
    """Hash of each run of `size` words, in order; none of shorter texts."""
    if size == 1:
        return F.transform(words, lambda w: F.xxhash64(w))
    places = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*[words[i + k] for k in range(size)]))


def _repeat_words(runs: Column, size: int) -> Column:
    """Words in runs that occur twice or more in the text: each word once."""
    placed = F.sort_array(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # one fold over the sorted runs: a run is repeated if the one before or after it is the same
    again = F.filter(
        F.transform(
            F.arrays_zip(placed.alias("x"), F.concat(F.array(F.lit(None)), F.slice(placed, 1, F.size(placed) - 1)).alias("y"), F.concat(F.slice(placed, 2, F.size(placed)), F.array(F.lit(None))).alias("z")),
            lambda t: F.when((t["x"]["h"] == t["y"]["h"]) | (t["x"]["h"] == t["z"]["h"]), t["x"]["i"]),
        ),
        lambda i: i.isNotNull(),
    )
    start = F.struct(F.lit(0).alias("n"), F.lit(-size).alias("at"))
    return F.aggregate(
        F.sort_array(again), start, lambda s, i: F.struct((s["n"] + F.least(F.lit(size), i - s["at"])).alias("n"), i.alias("at")), lambda s: s["n"]
    )


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, words, and the counts that the base rules and their report use.

    A null text has no words and counts of 0; rows that repeat stay separate.
    """
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(_WORD_CHAR))
    first = id_text(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    split = first.select("doc_id", "text", words_of(F.col("text")).alias("words"), lines.alias("lines"))
    runs = split.withColumn("runs", _runs(F.col("words"), 3))
    return runs.select(
        "doc_id",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(_SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("runs")) == F.size("runs"), 0).otherwise(_repeat_words(F.col("runs"), 3)).cast("long").alias("n_repeat_words"),
    )


def _buckets(words: Column, rules: LlrRules) -> Column:
    return F.concat(*[F.transform(_runs(words, n), lambda h: F.pmod(h, F.lit(rules.buckets)).cast("int")) for n in rules.sizes])


def log_ratios(docs: DataFrame, trusted: DataFrame, rules: LlrRules = LlrRules(), id_col: str = "doc_id", text_col: str = "text") -> list[int]:
    """Per bucket the log of its smoothed share in trusted documents over that in all documents, in units.

    `trusted` lists the trusted documents by `doc_id`. Every n-gram of every document counts in the
    corpus. Only one row a bucket and block comes back to the driver.
    """
    ids = trusted.select(trusted["doc_id"].cast("long").alias("doc_id")).dropna().distinct()
    blocks = max(1, -(-ids.count() // rules.block_ids))
    raw, target = Counter(), Counter()
    for k in range(blocks):
        # a block is of bounded size and broadcast, so texts stay where they are
        block = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == k).withColumn("trusted", F.lit(1))
        grams = (
            id_text(docs, id_col, text_col)
            .join(F.broadcast(block), "doc_id", "inner" if k else "left")  # the first pass counts the corpus too
            .select(F.coalesce("trusted", F.lit(0)).alias("trusted"), words_of(F.col("text")).alias("words"))
            .select("trusted", F.explode_outer(_buckets(F.col("words"), rules)).alias("bucket"))
        )  # plain explode would filter on the size of the array first, and so build it twice
        for r in grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("trusted").alias("trusted")).where("bucket is not null").collect():
            raw[r.bucket] += 0 if k else r.raw
            target[r.bucket] += r.trusted
    a, n = rules.smoothing, rules.buckets
    whole_raw, whole_target = sum(raw.values()) + a * n, sum(target.values()) + a * n
    if whole_target == a * n:  # nothing is trusted, so nothing speaks against any document
        return [0] * n
    return [
        round(UNIT * (math.log((target.get(b, 0) + a) / whole_target) - math.log((raw.get(b, 0) + a) / whole_raw)))
        for b in range(n)
    ]


def quality_rules(docs: DataFrame, trusted: DataFrame, rules: LlrRules = LlrRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts and verdicts of every document, its n-grams and the sum of their log ratios.

    Kept: at least 50 words, at most half of them in repeated 3-word runs, and a mean log ratio per
    n-gram of at least `rules.least`. The comparison is on whole numbers.
    """
    ratios = log_ratios(docs, trusted, rules, id_col, text_col)
    # One literal, folded once: a list of fixed length, whatever the corpus.
    weight = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<int>")
    counted = base_counts(docs, id_col, text_col).withColumn("grams", _buckets(F.col("words"), rules))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    least = F.size("grams") * F.lit(round(UNIT * rules.least))
    scored = counted.select(
        *[c for c in counted.columns if c not in ("words", "grams")],
        F.size("grams").cast("long").alias("n_grams"),
        F.aggregate("grams", F.lit(0).cast("long"), lambda s, b: s + weight[b]).alias("llr_units"),
        failed.alias("base_failed"),
        least.cast("long").alias("least"),
    )
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("llr_units") >= F.col("least"))).drop("least")


def op10_llr_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules of all documents; those labelled of good quality are the trusted target."""
    labels = table(spark, sf_dir, "labels")
    result = quality_rules(table(spark, sf_dir, "documents"), labels.where("quality = 1"))
    mean = F.round(F.col("llr_units") / F.col("n_grams") / UNIT, 6)
    return result.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.when(F.col("n_grams") > 0, mean).alias("mean_llr"),
    )
