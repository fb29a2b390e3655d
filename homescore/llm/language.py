"""Language of a text by hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homescore.llm.common import held_out, id_text, table

UNKNOWN = "und"
_LETTERS = 64  # slots: 0 for what is no letter, then a to z, then hashed others
_TRIGRAMS = _LETTERS**3
_DOCS, _CHARS = 128, 2_000_000  # compared at once


@dataclass(frozen=True)
class Profiles:
    """Unit prototype of each language, and the seed and size of the letter vectors they are made of."""

    languages: tuple[str, ...]
    prototypes: np.ndarray
    dimensions: int
    seed: int


@lru_cache(maxsize=1)
def _slots() -> np.ndarray:
    """Letter slot of every code point; upper case counts as lower."""
    slots = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        if chr(point).isalpha():
            lower = ord(chr(point).lower()[0])
            slots[point] = lower - 96 if 97 <= lower <= 122 else 27 + lower % 37
    return slots


@lru_cache(maxsize=2)
def _letter_vectors(dimensions: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (_LETTERS, dimensions))


def trigram_vectors(trigrams: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """Letters bound by product, the first two turned by two and one places so that order counts."""
    v = _letter_vectors(dimensions, seed)
    first, second = np.roll(v, 2, 1), np.roll(v, 1, 1)
    return first[trigrams >> 12] * second[trigrams >> 6 & 63] * v[trigrams & 63]


def trigrams_of(text: str) -> np.ndarray:
    """Trigram codes of letters, every run of others one blank; empty without letters."""
    codes = _slots()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    if not codes.any():
        return np.zeros(0, np.int64)
    padded = np.zeros(len(codes) + 2, np.int64)
    padded[1:-1] = codes
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] > 0) | (padded[:-1] > 0)
    s = padded[keep]
    return s[:-2] << 12 | s[1:-1] << 6 | s[2:]


def fit(docs: DataFrame, *, dimensions: int = 512, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Prototypes from every row with a text and a language: the bundle of its trigrams' vectors.

    Tasks count trigrams per language; what reaches the driver is at most 64**3 counts a language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, n in held.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "trigram", "n"])
            held.clear()

        for batch in batches:
            for text, lang in zip(*(c.to_pylist() for c in batch.columns)):
                if lang not in held and len(held) >= 32:
                    yield from counted()
                codes = trigrams_of(text)
                at, n = np.unique(codes, return_counts=True)
                held.setdefault(lang, np.zeros(_TRIGRAMS, np.int64))[at] += n
        yield from counted()

    rows = docs.select(docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang")).dropna()
    counts = rows.mapInArrow(count, "lang string, trigram int, n long").groupBy("lang", "trigram").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(counts["lang"].unique()))
    prototypes = np.zeros((len(languages), dimensions))
    for k, lang in enumerate(languages):
        own = counts[counts["lang"] == lang]
        for part in np.array_split(np.arange(len(own)), len(own) // 20_000 + 1):
            vectors = trigram_vectors(own["trigram"].to_numpy()[part], dimensions, seed)
            prototypes[k] += own["n"].to_numpy()[part] @ vectors.astype(float)
        prototypes[k] /= max(np.linalg.norm(prototypes[k]), 1e-12)
    return Profiles(languages, prototypes.astype(np.float32), dimensions, seed)


def predict_texts(texts: list[str | None], model: Profiles) -> tuple[list[str], np.ndarray]:
    """Language whose prototype is nearest by cosine, and that cosine from 0 up; of equal ones the first by name."""
    codes = [trigrams_of(t or "") for t in texts]
    sizes = np.array([len(c) for c in codes])
    joined = np.concatenate(codes) if len(codes) else np.zeros(0, np.int64)
    used = np.zeros(_TRIGRAMS, bool)
    used[joined] = True
    kinds = np.flatnonzero(used)
    place = np.cumsum(used) - 1
    cell = np.repeat(np.arange(len(texts)), sizes) * len(kinds) + place[joined]
    counts = np.bincount(cell, minlength=len(texts) * len(kinds)).reshape(len(texts), len(kinds))
    bundles = counts.astype(np.float32) @ trigram_vectors(kinds, model.dimensions, model.seed).astype(np.float32)
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    cosine = bundles @ model.prototypes.T / np.maximum(np.linalg.norm(bundles, axis=1), 1e-12)[:, None]
    best = cosine.argmax(1)
    score = np.clip(cosine[np.arange(len(texts)), best], 0, 1).astype(float)
    return [model.languages[b] if n else UNKNOWN for b, n in zip(best, sizes)], np.where(sizes > 0, score, 0.0)


def predict(docs: DataFrame, model: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row, from its whole text alone.

    Null texts and texts without a letter are `und` with score 0, as is everything under a model of
    no language; an empty table gives no rows; repeated rows are judged alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            names, scores = [], []
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and end - at < _DOCS and (size < _CHARS or end == at):
                    size += len(texts[end] or "")
                    end += 1
                name, score = predict_texts(texts[at:end], model)
                names += name
                scores.append(score)
                at = end
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.concatenate([*scores, np.zeros(0)]))], names=["doc_id", "lang_pred", "score"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op7_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
