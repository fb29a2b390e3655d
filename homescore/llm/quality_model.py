"""Quality of a text by supervised subword embeddings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homescore.llm.common import held_out, id_text, span_hashes, table, word_spans

THRESHOLD = 0.7
_BYTES = 1_000_000  # of texts scored at once
_LAGS = (1, 2, 3, 4)


@dataclass(frozen=True)
class Training:
    """`rows` bounds the labelled documents learned from: those with the smallest hash of their id."""

    rows: int = 3000
    buckets: int = 1 << 16
    dimensions: int = 16
    epochs: int = 12
    rate: float = 0.5
    seed: int = 11


@dataclass(frozen=True)
class Model:
    """Per bucket what its vector adds to the log odds of label 1, and what every text starts with."""

    weight: np.ndarray
    bias: float


def features(texts: list[str | None], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each text in order, and where each text's begin and end.

    Of every word: the word, its bytes in runs of three with one neighbour on either side, and of
    words repeated one to four places on a mark for the distance.
    """
    raws = [b" " + (t or "").encode("utf-8", "replace") + b" " for t in texts]
    ends = np.cumsum([len(r) for r in raws])
    raw = np.frombuffer(b"".join(raws), np.uint8)
    owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    mask = np.uint64(buckets - 1)
    starts, stops = word_spans(raw)
    hashes = span_hashes(raw, starts, stops)
    words, of = hashes & mask, owner[starts]
    wide = raw.astype(np.uint32)
    three = (wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) * np.uint32(2654435761)
    inside = owner[:-2] == owner[2:]
    grams = (three >> np.uint32(13)).astype(np.uint64)[inside] & mask
    found, owners = [words, grams], [of, owner[:-2][inside]]
    for lag in _LAGS:
        same = (hashes[lag:] == hashes[:-lag]) & (of[lag:] == of[:-lag])
        owners.append(of[lag:][same])
        found.append(np.full(len(owners[-1]), lag * 40503 & (buckets - 1), np.uint64))
    of, found = np.concatenate(owners), np.concatenate(found).astype(np.int64)
    order = np.argsort(of, kind="stable")
    return found[order], np.searchsorted(of[order], np.arange(len(texts) + 1))


def train(texts: list[list[tuple[np.ndarray, np.ndarray]]], labels: np.ndarray, how: Training = Training()) -> Model:
    """Stochastic gradient descent on averaged vectors under a softmax of the two labels.

    `texts` holds each document's distinct buckets and their counts.
    """
    rng = np.random.default_rng(how.seed)
    vectors = rng.uniform(-1, 1, (how.buckets, how.dimensions)) / how.dimensions
    out = np.zeros((2, how.dimensions))
    bias = np.zeros(2)
    steps, step = how.epochs * max(len(texts), 1), 0
    for _ in range(how.epochs):
        for k in rng.permutation(len(texts)):
            ids, n = texts[k]
            rate = how.rate * (1 - step / steps)
            step += 1
            share = n / max(n.sum(), 1)
            hidden = share @ vectors[ids]
            logits = out @ hidden + bias
            p = np.exp(logits - logits.max())
            error = p / p.sum()
            error[int(labels[k])] -= 1
            back = out.T @ error
            out -= rate * np.outer(error, hidden)
            bias -= rate * 0.1 * error
            # the embedding of a document is an average, so each vector's step is scaled up again
            vectors[ids] -= rate * np.outer(np.minimum(share * 20, 1), back)
    return Model(vectors @ (out[1] - out[0]), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, how: Training = Training(), *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Model from the documents that `labels` marks 0 or 1 (other rows are left out).

    At most `how.rows` documents are read, whatever the size of the tables, so their ids may be
    broadcast and their buckets meet on the driver.
    """
    marked = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label"))
    chosen = marked.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(how.rows)
    sample = id_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                found, _ = features([text], how.buckets)
                rows.append(np.unique(found, return_counts=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([a.astype(np.int32) for a, _ in rows], pa.list_(pa.int32())), pa.array([n.astype(np.int32) for _, n in rows], pa.list_(pa.int32()))],
                names=["doc_id", "label", "ids", "n"],
            )

    rows = sample.mapInArrow(counted, "doc_id long, label int, ids array<int>, n array<int>").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    texts = [(np.asarray(i.values, np.int64), np.asarray(n.values, float)) for i, n in zip(rows["ids"], rows["n"])]
    return train(texts, np.asarray(rows["label"].to_pylist(), np.int64), how)


def score_texts(texts: list[str | None], model: Model) -> np.ndarray:
    found, at = features(texts, len(model.weight))
    size = np.diff(at)
    # each text is summed by itself, so its score does not depend on the others of its batch
    total, some = np.zeros(len(texts)), np.flatnonzero(size)
    if len(some):
        total[some] = np.add.reduceat(model.weight[found], at[some])
    odds = total / np.maximum(size, 1) + model.bias
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of every row, from its whole text alone.

    A null text counts as empty and an empty one has the score of no n-gram at all; an empty table
    gives no rows; repeated rows are judged alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at, scores = batch.column(1).to_pylist(), 0, [np.zeros(0)]
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (size < _BYTES or end == at):
                    size += len(texts[end] or "") + 2
                    end += 1
                scores.append(score_texts(texts[at:end], model))
                at = end
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores))], names=["doc_id", "score"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of `docs` whose `text` scores `threshold` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column(batch.schema.get_field_index("text")).to_pylist(), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (size < _BYTES or end == at):
                    size += len(texts[end] or "") + 2
                    end += 1
                yield batch.slice(at, end - at).filter(pa.array(score_texts(texts[at:end], model) >= threshold))
                at = end

    return docs.mapInArrow(run, docs.schema)


def fit_unheld(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> Model:
    """Model that has seen no label of a held-out document."""
    return fit(docs, labels.where(~held_out(F.col("doc_id"))), how)


def op8_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    model = fit_unheld(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
