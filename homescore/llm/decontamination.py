"""Benchmark decontamination in DataFrame functions alone.

The windows of all benchmark items form a hash set that is broadcast while it is small. Every window of
every document is looked up by its hash, a find is verified word by word, and what it covers is removed,
or the document is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from homescore.llm.common import stage, table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"  # after lower-casing
_WORD_AND_GAP = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
_LEADING_GAP = r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
#: Stands first among a document's windows, so that each document is seen once whatever it holds.
_ANY = 0


@dataclass(frozen=True)
class NGrams:
    """Words in a window, and the most bytes of benchmark windows that are broadcast; more are shuffled."""

    window: int = 10
    broadcast_bytes: int = 48_000_000


def normalised_words(text: Column) -> Column:
    """Words of a text in lower case (A to Z only), between ASCII characters that are no letters or digits."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lower, _GAP + "+"), "")


def _key(hashes: Column, at: Column | int, size: int) -> Column:
    return F.xxhash64(*[hashes[at + k] for k in range(size)])


def benchmark_windows(benchmark: DataFrame, how: NGrams, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The distinct windows (key, size, found: its words, ids: number of its list) and the lists of item ids.

    Windows that occur in the same items share one list, so that a document names few lists.
    """
    items = benchmark.select(benchmark[id_col].cast("string").alias("item"), normalised_words(benchmark[text_col].cast("string")).alias("words"))
    size = F.least(F.size("words"), F.lit(how.window))
    placed = items.where(F.size("words") > 0).select("item", "words", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("words") - size + 1)).alias("at"))
    each = placed.select("item", "size", F.slice("words", F.col("at"), F.col("size")).alias("found"))
    named = stage(each.groupBy("size", "found").agg(F.sort_array(F.collect_set("item")).alias("items")), "benchmark-windows")
    lists = stage(named.select("items").distinct().select(F.monotonically_increasing_id().alias("ids"), "items"), "benchmark-items")
    hashes = F.transform("found", lambda w: F.xxhash64(w))
    key = F.coalesce(*[F.when(F.col("size") == k, _key(hashes, 0, k)) for k in range(1, how.window + 1)])
    return stage(named.join(lists, "items").select(key.alias("key"), "size", "found", "ids"), "benchmark-keys"), lists


def _sizes(windows: DataFrame) -> tuple[list[int], int]:
    """The window sizes there are, at most `window` of them, and about how many bytes all windows take."""
    rows = windows.groupBy("size").agg(F.sum(F.length(F.array_join("found", "")) * 4 + F.col("size") * 16 + 96).alias("bytes")).collect()
    return sorted((r["size"] for r in rows), reverse=True), sum(r["bytes"] for r in rows)


def _window_keys(sizes: list[int]) -> Column:
    """Keys of all windows of `words`, those of one size after those of another."""

    def of(size: int) -> Column:
        last = F.size("hashes") - size
        keys = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: _key(F.col("hashes"), i, size))
        return F.when(last >= 0, keys).otherwise(F.array().cast("array<bigint>"))

    return F.concat(F.array(F.lit(_ANY).cast("long")), *[of(k) for k in sizes])


def _start(sizes: list[int]) -> Column:
    """First word of the window at place `e` among the keys, given the size of the window found there."""
    before, of = F.lit(1), F.lit(None).cast("int")
    for k in sizes:
        of = F.when(F.col("size") == k, F.col("e") - before).otherwise(of)
        before = before + F.greatest(F.col("n") - (k - 1), F.lit(0))
    return of


def _finds(rows: DataFrame, windows: DataFrame, how: NGrams) -> DataFrame:
    """row, given (null but once a row), n, and at, size, ids of every verified window.

    `rows`: row, given, words.
    """
    sizes, held = _sizes(windows)
    hashed = rows.select("row", "given", "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    # the outer form: the plain one would filter on the size of the array first, and so build it twice
    looked_up = hashed.select("row", "given", "words", F.size("words").alias("n"), F.posexplode_outer(_window_keys(sizes)).alias("e", "key"))
    at = _start(sizes)
    once = F.when(F.col("e") == 0, F.col("given"))
    if held <= how.broadcast_bytes:
        any_row = rows.sparkSession.sql(f"select bigint({_ANY}) key, 0 size, cast(array() as array<string>) found, bigint(null) ids")
        met = looked_up.join(F.broadcast(windows.union(any_row)), "key").withColumn("at", at)
        same = F.when(F.col("e") == 0, F.col("size") == 0).when(F.col("at") >= 0, F.slice("words", F.col("at") + 1, F.col("size")) == F.col("found"))
        return met.where(same).select("row", once.alias("given"), "n", "at", "size", "ids")
    alone = looked_up.where("e = 0").select("row", once.alias("given"), "n", F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("size"), F.lit(None).cast("long").alias("ids"))
    spans = [
        looked_up.where("e > 0").withColumn("size", F.lit(k)).withColumn("at", at)
        .where(f"at >= 0 and at <= n - {k}").select("row", "n", "at", "key", F.slice("words", F.col("at") + 1, k).alias("found"))
        for k in sizes
    ]
    for found, k in zip(spans, sizes):
        met = found.join(windows.where(F.col("size") == k), ["key", "found"])
        alone = alone.union(met.select("row", F.lit(None).cast(rows.schema["given"].dataType).alias("given"), "n", "at", "size", "ids"))
    return alone


def _covered(hits: Column) -> Column:
    """Words that the sorted windows of one document cover, each counted once."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(s: Column, h: Column) -> Column:
        end = F.greatest(s["end"], h["end"])
        return F.struct((s["n"] + end - F.greatest(F.least(h["at"], end), s["end"])).alias("n"), end.alias("end"))

    return F.aggregate(hits, start, step, lambda s: s["n"])


def _marked(docs: DataFrame, benchmark: DataFrame, how: NGrams, given: Column, text_col: str, item_col: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """given, n_words, n_hit, hits (at, end) and lists of every row of `docs`, staged; and the lists of items."""
    windows, lists = benchmark_windows(benchmark, how, item_col, item_text)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), given.alias("given"), normalised_words(docs[text_col].cast("string")).alias("words"))
    if _sizes(windows)[1] > how.broadcast_bytes:
        rows = stage(rows, "words")  # read once for the documents, once for their windows
    hit = F.when(F.col("at").isNotNull(), F.struct("at", (F.col("at") + F.col("size")).alias("end")))
    per_row = _finds(rows, windows, how).groupBy("row").agg(
        F.first("given", ignorenulls=True).alias("given"), F.max("n").cast("long").alias("n_words"),
        F.sort_array(F.collect_set(hit)).alias("hits"), F.sort_array(F.collect_set("ids")).alias("lists"),
    )
    return stage(per_row.select("given", "n_words", _covered(F.col("hits")).cast("long").alias("n_hit"), "hits", "lists"), "marked"), lists


def contamination(
    docs: DataFrame, benchmark: DataFrame, how: NGrams = NGrams(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of `docs`.

    A word is hit if a window of `how.window` words that an item has, too, covers it; an item of fewer
    words is one window. Null and wordless texts have no words and hit nothing. Rows that repeat, and
    those with a null id, are each judged alone. Items that share an id are one item; one without an id
    hits words but is not counted or listed. Empty tables give no rows, or no hits. Only the named
    columns are read.
    """
    marked, lists = _marked(docs, benchmark, how, F.struct(docs[id_col].cast("long").alias("doc_id")), text_col, item_col, item_text)
    # documents hit by the same lists share one digest, and it is made once
    sets = marked.select("lists").where("size(lists) > 0").distinct()
    items = sets.select("lists", F.explode("lists").alias("ids")).join(lists, "ids").groupBy("lists").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    digests = items.select("lists", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    of = F.col("given.doc_id").alias("doc_id")
    hit = marked.where("size(lists) > 0").join(digests, "lists").select(of, "n_words", "n_hit", "n_items", "items_sha256")
    clean = marked.where("size(lists) = 0").select(of, "n_words", "n_hit", F.lit(0).cast("long"), F.sha2(F.lit(""), 256))
    return hit.union(clean).withColumn("contaminated", F.col("n_hit") > 0)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, how: NGrams = NGrams(), remove: str = "spans", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """`docs` without the words that benchmark windows cover (remove="spans"), or without documents that
    have such words (remove="documents").

    A removed word takes the gap after it along; all else of a text stays as it was. A null text stays
    null. Columns and repeated rows are kept as they are, whatever the columns are called.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove is 'spans' or 'documents', not {remove!r}")
    given = F.struct(*[docs[c] for c in docs.columns])
    marked, _ = _marked(docs, benchmark, how, given, text_col, item_col, item_text)
    if remove == "documents":
        return marked.where("n_hit = 0").select("given.*")
    text = F.col("given").getField(text_col)
    inside = lambda i: F.exists("hits", lambda h: (i >= h["at"]) & (i < h["end"]))
    left = F.filter(F.regexp_extract_all(text.cast("string"), F.lit(f"({_WORD_AND_GAP})")), lambda _, i: ~inside(i))
    cut = F.concat(F.regexp_extract(text.cast("string"), f"({_LEADING_GAP})", 1), F.array_join(left, ""))
    return marked.select(*[(F.when(F.col("n_hit") > 0, cut).otherwise(text) if c == text_col else F.col("given").getField(c)).alias(c) for c in docs.columns])


def op11_ngram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document shares with the benchmark."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
