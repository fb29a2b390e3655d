"""Repeated passages by relative Lempel-Ziv parsing against an index of reference blocks.

The corpus is its own reference. Every text is cut into blocks at places that its words choose: of
the seeds (runs of `SEED` words) in each window of `window` words the one with the least hash is the
window's anchor, and consecutive windows of one anchor make a block. Equal passages are cut alike
wherever they stand, so a block is looked up by its anchor's seed, among all blocks of the corpus at
once: a join on a hash, never a comparison of texts with each other.

* A block that the index holds elsewhere word for word is copied whole. The parser goes on from block
  to block while the source goes on too; such a stretch is one factor.
* Where only the seed is found elsewhere, a factor begins or ends inside the block. There each window
  is looked up by itself. One text stands for all equal blocks, so the windows looked up are as many
  as there are different texts, not copies.

Hashes that decide equality have 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homescore.llm.common import discard, free_name, mix, powers, row_key, span_hashes, stage, table, window_hashes, word_spans

WINDOW = 35
SEED = 8
_BASES = (0xA24BAED4963EE407, 0x9FB21C651E98DF25)
_BATCH_BYTES = 1_000_000
_KEY = ["k1", "k2"]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, and a key that only rows which repeat both share."""
    doc_id, text = docs[id_col].cast("long"), docs[text_col].cast("string")
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), *row_key(doc_id, text))


def least_of_windows(values: np.ndarray, size: int) -> np.ndarray:
    """Place of the least of each `size` consecutive values, the first of equal ones."""
    n = len(values) - size + 1
    place, span = np.arange(len(values)), 1
    while span < size:
        step = min(span, size - span)
        left, right = place[:-step], place[step:]
        place = np.where(values[right] < values[left], right, left)
        span += step
    return place[:n]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the number of the text each belongs to."""
    raws = [(t or "").encode("utf-8", "replace") + b" " for t in texts]
    raw = np.frombuffer(b"".join(raws), np.uint8)
    starts, ends = word_spans(raw)
    return span_hashes(raw, starts, ends), np.searchsorted(np.cumsum([len(r) for r in raws]), starts, "right")


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def blocks_of(texts: list[str | None], window: int) -> dict[str, np.ndarray]:
    """Of each block: text, first window, windows, seed, and a hash of all its words."""
    words, owner = word_hashes(texts)
    seed = min(SEED, window)
    n = len(words) - window + 1
    if n <= 0:
        return {k: np.zeros(0, np.int64) for k in ("text", "s", "n", "seed", "b1", "b2")}
    seeds = window_hashes(words, seed, 0x2545F4914F6CDD1D)
    anchor = least_of_windows(seeds, window - seed + 1)
    whole = owner[:n] == owner[window - 1 :]
    starts = np.flatnonzero(whole & np.concatenate([[True], ~whole[:-1] | (anchor[1:] != anchor[:-1])]))
    # a block ends where the next begins or where windows leave the text
    stops = np.flatnonzero(whole & np.concatenate([~whole[1:] | (anchor[1:] != anchor[:-1]), [True]]))
    size = stops - starts + 1
    out = {"text": owner[starts], "s": starts - np.searchsorted(owner, owner[starts]), "n": size, "seed": _signed(seeds[anchor[starts]])}
    for name, base in zip(("b1", "b2"), _BASES):
        b = np.uint64(base)
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * powers(b, len(words)), out=total[1:])
        inverse = powers(np.uint64(pow(base, -1, 1 << 64)), len(words) + 1)
        out[name] = _signed(mix((total[stops + window] - total[starts]) * inverse[starts] + size.astype(np.uint64)))
    return out


def reference_blocks(keyed: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            texts, at = batch.column(0).to_pylist(), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (size < _BATCH_BYTES or end == at):
                    size += len(texts[end] or "")
                    end += 1
                b = blocks_of(texts[at:end], window)
                row = b["text"] + at
                columns = [b["seed"], b["b1"], b["b2"], k1[row], k2[row], b["s"].astype(np.int32), b["n"].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["seed", "b1", "b2", "k1", "k2", "s", "n"])
                at = end

    return keyed.select("text", "k1", "k2").mapInArrow(run, "seed long, b1 long, b2 long, k1 long, k2 long, s int, n int")


def _boundary_windows(keyed: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """Hash and place of each window of the wanted blocks."""
    wanted = wanted.groupBy(*_KEY).agg(F.collect_list(F.struct("s", "n", "seed", "b1", "b2", "c")).alias("blocks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["w1", "w2", "seed", "b1", "b2", "c", "off"]
        for batch in batches:
            for text, blocks in zip(batch.column(0).to_pylist(), batch.column(1)):
                words, _ = word_hashes([text])
                own = pa.StructArray.from_arrays(blocks.values.flatten(), names=["s", "n", "seed", "b1", "b2", "c"])
                s, n = own.field("s").to_numpy(), own.field("n").to_numpy()
                which = np.repeat(np.arange(len(s)), n)
                off = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                hashes = [_signed(window_hashes(words, window, base))[s[which] + off] for base in _BASES]
                rest = [own.field(k).to_numpy()[which] for k in ("seed", "b1", "b2", "c")]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*hashes, *rest, off.astype(np.int32))], names=names)

    both = keyed.join(wanted, _KEY).select("text", "blocks")
    return both.mapInArrow(run, "w1 long, w2 long, seed long, b1 long, b2 long, c long, off int")


def repeated_blocks(keyed: DataFrame, window: int) -> DataFrame:
    """Blocks with a repeated window: k1, k2, s, the repeated windows as bits, and the source of a whole copy."""
    if not 1 <= window <= 60:
        raise ValueError("a block's windows are bits of a long: take 1 to 60 words")
    blocks = stage(reference_blocks(keyed, window), "blocks")
    one = (F.min("b1") == F.max("b1")) & (F.min("b2") == F.max("b2"))
    # Tables that a join looks up are written first: joined as they leave their aggregation, they would
    # fix how the other side is dealt, and Spark could not split a seed or block with very many copies.
    again = blocks.groupBy("seed").agg(F.count("*").alias("times"), (~one).alias("mixed"))
    again = stage(again.where("times > 1").drop("times"), "seeds")
    met = stage(blocks.join(again, "seed"), "met")
    discard(blocks, again)

    key = ["seed", "b1", "b2"]
    texts = stage(
        met.groupBy(*key).agg(F.count("*").alias("c"), F.min(F.struct("k1", "k2", "s", "n")).alias("at"), F.first("mixed").alias("mixed")).select(*key, "c", "at.*", "mixed"),
        "texts",
    )
    windows = stage(_boundary_windows(keyed, texts.where("mixed"), window), "windows")
    several = (F.max("c") > 1) | (F.min("b1") != F.max("b1")) | (F.min("b2") != F.max("b2"))
    found = stage(windows.groupBy("w1", "w2").agg(several.alias("several")).where("several").drop("several"), "repeated")
    partly = windows.join(found, ["w1", "w2"]).groupBy(*key).agg(F.bit_or(F.expr("shiftleft(1L, off)")).alias("bits"))
    every = F.expr("shiftleft(1L, n) - 1")
    source = F.when(F.col("c") > 1, F.struct(F.col("k1").alias("k1"), F.col("k2").alias("k2"), F.col("s").alias("s")))
    bits = stage(
        texts.join(partly, key, "left")
        .select(*key, F.when(F.col("c") > 1, every).otherwise(F.col("bits")).alias("bits"), source.alias("source"))
        .where("bits is not null"),
        "bits",
    )
    discard(texts, windows, found)
    spans = stage(met.select(*key, *_KEY, "s").join(bits, key).select(*_KEY, "s", "bits", "source"), "spans")
    discard(met, bits)
    return spans


def factors(blocks: list[dict], window: int) -> list[tuple[int, int]]:
    """Greedy parse of one text: first word and words of each factor, by its repeated blocks in order.

    A factor grows while the next block is a whole copy from where the source went on; at its ends it
    takes the windows of partly repeated blocks, and windows that no factor joins stand alone.
    """
    out: list[list[int]] = []
    ahead = None  # where the source of the factor so far would go on
    for b in sorted(blocks, key=lambda b: b["s"]):
        at, bits = b["s"], b["bits"]
        source = b["source"]
        place = source and (source["k1"], source["k2"], source["s"] - at)
        while bits:
            skip = (bits & -bits).bit_length() - 1
            run = ((bits >> skip) + 1 & ~(bits >> skip)).bit_length() - 1
            start, stop = at + skip, at + skip + run + window - 1
            joins = out and start + window - 1 <= out[-1][1] and (place is None or ahead is None or place == ahead)
            if joins:
                out[-1][1] = max(out[-1][1], stop)
            else:
                out.append([start, stop])
            at, bits = at + skip + run, bits >> skip >> run
        ahead = place
    return [(start, stop - start) for start, stop in out]


def _covered(blocks: list[dict], n_words: int, window: int) -> np.ndarray:
    edge = np.zeros(n_words + 1, np.int64)
    for b in blocks:
        starts = b["s"] + np.flatnonzero([b["bits"] >> k & 1 for k in range(b["bits"].bit_length())])
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:-1]) > 0


def with_blocks(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and the repeated blocks of every row (null: none)."""
    keyed = _keyed(docs, id_col, text_col)
    found = repeated_blocks(keyed, window).groupBy(*_KEY).agg(F.collect_set(F.struct("s", "bits", "source")).alias("blocks"))
    return keyed.join(found, _KEY, "left").select("doc_id", "text", "blocks")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, n_factors, and the factors as first word and words.

    Words (runs of characters other than ASCII white space) go if a window of `window` words that
    covers them also starts anywhere else, in whatever row. A null text is an empty one; texts shorter
    than a window lose nothing; repeated rows each count as a place; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, blocks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = (text or "").encode("utf-8", "replace").split()
                gone, parsed = np.zeros(len(words), bool), []
                if blocks:
                    gone, parsed = _covered(blocks, len(words), window), factors(blocks, window)
                kept = b" ".join([w for w, g in zip(words, gone) if not g] if blocks else words)
                rows.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), len(parsed), [{"start": a, "length": n} for a, n in parsed]))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["doc_id", "n_words", "n_removed", "kept_sha256", "n_factors", "factors"])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_factors long, factors array<struct<start:long,length:long>>"
    return with_blocks(docs, window, id_col, text_col).mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` without the repeated words of `text`; kept words joined by one space, untouched texts as they were.

    A column `n_chars`, if there is one, follows the text. A null text stays null, a text without words as
    it is; rows that repeat are judged alike, each counts as a place; an empty table stays empty. Columns
    stay as they are, whatever they are called.
    """
    keyed = _keyed(docs, "doc_id", "text")
    # rows that repeat id and text find the same blocks: once is enough for all of them
    found = repeated_blocks(keyed, window).groupBy(*_KEY).agg(F.collect_set(F.struct("s", "bits")).alias("blocks"))
    given = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("given"), *row_key(docs["doc_id"].cast("long"), docs["text"].cast("string")))
    both = given.join(found, _KEY, "left").select("given.*", F.col("blocks").alias(free_name("blocks", docs.columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, counted = batch.schema.get_field_index("text"), batch.schema.get_field_index("n_chars")
            texts, changed = [], []
            for text, blocks in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if blocks:
                    words = text.encode("utf-8", "replace").split()
                    gone = _covered(blocks, len(words), window)
                    text = b" ".join([w for w, g in zip(words, gone) if not g]).decode()
                texts.append(text)
                changed.append(bool(blocks))
            arrays = list(batch.columns[:-1])
            arrays[at] = pa.array(texts, batch.schema.field(at).type)
            if counted >= 0:
                sizes = [len(t) if c else n for t, c, n in zip(texts, changed, arrays[counted].to_pylist())]
                arrays[counted] = pa.array(sizes, batch.schema.field(counted).type)
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names[:-1])

    return both.mapInArrow(run, docs.schema)


def op1_relative_lz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 35-word windows of all documents."""
    return dedup_substrings(table(spark, sf_dir, "documents")).drop("n_factors", "factors")
