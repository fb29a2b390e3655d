"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The transducer is the composition of three parts, compiled from a model file:

* the normaliser: a mark before the text and in place of each space;
* the lexicon: an arc for every piece, from its characters to its id, weighted by its negative score;
  a character that is no piece has an arc to the ids of its bytes, taken where no longer piece may be;
* the grammar: after one piece another may follow if merging their joined characters, best score
  first, gives the two back. Other pairs have infinite weight.

A text is composed with it into a lattice whose states are a place and the piece that ends there; the
path of least weight (sums along a path, least among paths) is the encoding. Merging is decided by
neighbours alone, so exactly the model's own segmentation is finite: composing goes depth first and stops
at the first path that ends, without the states that lead nowhere near it. Runs of marks, whose pieces all
weigh the same, are merged by themselves from the left. No piece crosses from a word to the next mark,
so words are composed one by one and remembered.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from homescore.llm.common import id_text, table

MARK = "▁"
CACHE_WORDS, CACHE_PAIRS = 1_200_000, 1_000_000


class Transducer:
    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = range(model.get_piece_size())
        self.weight = {}
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        self.surface: list[bytes] = []
        for k in ids:
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.bytes[int(piece[3:5], 16)] = k
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
                self.surface.append(b"")
            else:
                self.ids[piece], self.weight[piece] = k, -model.get_score(k)
                self.surface.append(piece.replace(MARK, " ").encode())
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte fallback")
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece of the model crosses words")
        self.prefixes = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        self.pairs: dict[str, dict[str, bool]] = {}  # by a piece, those it may follow
        self.n_pairs = 0
        self.runs: dict[int, bytes] = {}
        self.words: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Characters merged pair by pair, the cheapest piece first and the leftmost of equal ones."""
        symbols, n = list(text), len(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else n
            if i >= 0 and j < n and (w := self.weight.get(symbols[i] + symbols[j])) is not None:
                heapq.heappush(queue, (w, i, j, symbols[i] + symbols[j]))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, j, piece = heapq.heappop(queue)
            if after[i] != j or symbols[i] + symbols[j] != piece or not symbols[i]:
                continue
            symbols[i], symbols[j] = piece, ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [s for s in symbols if s]

    def _learn_pair(self, before: dict[str, bool], a: str, b: str) -> bool:
        self.n_pairs += 1
        if self.n_pairs > CACHE_PAIRS:
            self.n_pairs = 0
            for known in self.pairs.values():
                known.clear()
        before[a] = found = self.merged(a + b) == [a, b]
        return found

    def _arcs(self, text: str, at: int) -> list[str]:
        """Pieces that begin at a place, the shortest first; a character that no piece covers is one."""
        weight, prefixes = self.weight, self.prefixes
        first = text[at : at + 1]
        found = [first]
        if first in prefixes:
            for end in range(at + 2, len(text) + 1):
                p = text[at:end]
                if p not in prefixes:
                    break
                if p in weight:
                    found.append(p)
        return found

    def path(self, text: str) -> list[str]:
        """Pieces of the path of least weight through the lattice of a text.

        As one path alone is finite, it is looked for depth first, long pieces first; states that no
        finite path goes on from are not entered again.
        """
        n, pairs = len(text), self.pairs
        if not n:
            return []
        ahead: list[list[str] | None] = [None] * n
        out, waiting, at, dead = [], [], 0, set()
        left = self._arcs(text, 0)
        while True:
            if left:
                p = left.pop()
                end = at + len(p)
                if out:
                    known = pairs.get(p)
                    if known is None:
                        known = pairs[p] = {}
                    before = out[-1]
                    ok = known.get(before)
                    if not (ok or ok is None and self._learn_pair(known, before, p)):
                        continue
                if end == n:
                    out.append(p)
                    return out
                if (end, p) in dead:
                    continue
                waiting.append(left)
                out.append(p)
                at = end
                if ahead[at] is None:
                    ahead[at] = self._arcs(text, at)
                left = ahead[at].copy()
            elif out:
                p = out.pop()
                dead.add((at, p))
                at -= len(p)
                left = waiting.pop()
            else:
                raise ValueError("no path is finite")

    def _bytes_of(self, pieces: list[str]) -> bytes:
        ids: list[int] = []
        for p in pieces:
            k = self.ids.get(p)
            ids += [k] if k is not None else [self.bytes[b] for b in p.encode("utf-8", "replace")]
        return np.array(ids, "<u2").tobytes()

    def _run(self, n: int) -> bytes:
        if n not in self.runs:
            if len(self.runs) > 1000:
                self.runs.clear()
            self.runs[n] = self._bytes_of(self.merged(MARK * n))
        return self.runs[n]

    def _word(self, word: str, marks: int) -> bytes:
        """A word after a run of marks; the last of them goes to the word if it merges with it."""
        if marks == 1 and word in self.words:
            return self.words[word]
        pieces = self.path(MARK + word)
        if pieces[0] == MARK:
            found = self._run(marks) + self._bytes_of(pieces[1:])
        else:
            found = (self._run(marks - 1) if marks > 1 else b"") + self._bytes_of(pieces)
        if marks == 1:
            if len(self.words) > CACHE_WORDS:
                self.words.clear()
            self.words[word] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 16-bit integers."""
        if not text:
            return b""
        words = text.replace(MARK, " ").split(" ")
        try:
            return b"".join(map(self.words.__getitem__, words))
        except KeyError:
            pass
        out, marks = [], 0
        for w in words:
            marks += 1
            if w:
                out.append(self._word(w, marks))
                marks = 0
        return b"".join(out) + (self._run(marks) if marks else b"")

    def decode(self, ids: bytes) -> str:
        surface = self.surface
        raw = b"".join([surface[k] for k in np.frombuffer(ids, "<u2").tolist()])
        return raw.decode("utf-8", "replace")[1:]


_KNOWN: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One per worker process, so that what it remembers serves all tasks of the process."""
    if path not in _KNOWN:
        _KNOWN[path] = Transducer(path)
    return _KNOWN[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of every row; a null or empty text has none, an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = transducer(path)
        for batch in batches:
            ids = [np.frombuffer(encoder.encode(t), "<u2").astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every row; null or no ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = transducer(path)
        for batch in batches:
            texts = [decoder.decode(np.asarray(x or [], "<u2").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    picked = rows.select(rows[id_col].cast("long").alias("doc_id"), rows[ids_col].cast("array<int>").alias("ids"))
    return picked.mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), text_crc32 of
    the decoded text in UTF-8, and whether that is the text given (null counts as empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                ids = t.encode(text)
                back = t.decode(ids)
                rows.append((len(ids) // 2, zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes()), zlib.crc32(back.encode()), back == (text or "")))
            made = [pa.array([r[k] for r in rows], pa.bool_() if k == 3 else pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", "n_tokens", "ids_crc32", "text_crc32", "round_trip"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, text_crc32 long, round_trip boolean")


def op3_wfst_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
