"""Packing of examples into sequences under several limits at once (vector bin packing)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homescore.llm.common import table
from homescore.llm.tokens import CACHE_PIECES, word_ids

END_ID = 1
#: Examples weighed against each other at once, and ids held for them.
BUFFER_EXAMPLES, BUFFER_IDS = 8192, 4_000_000


@dataclass(frozen=True)
class Limits:
    """Of one sequence: ids, segments (pieces of examples), and ids that bear loss."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


Piece = tuple[int, int, int, int, int]  # example, start, length, sequence, offset


class Packer:
    """Places examples one buffer after another; an open sequence waits for the next buffer.

    The next piece of a sequence is the example that fits whole and has the largest dot product of
    its demand with what is left of the limits. Where none fits, the largest is cut to fill the gap.
    An example's loss-bearing ids are its last ones.
    """

    def __init__(self, limits: Limits):
        if min(limits.tokens, limits.segments, limits.loss) < 1:
            raise ValueError("limits must be positive")
        self.full = np.array([limits.tokens, limits.segments, limits.loss], np.int64)
        self.sequences, self.open, self.left = 0, None, None

    def _new(self) -> int:
        self.sequences += 1
        return self.sequences - 1

    @staticmethod
    def _cut(start: int, n: int, loss: int, room: np.ndarray) -> tuple[int, int]:
        """Longest piece from `start` that the room takes, and its loss-bearing ids."""
        free = max(n - loss - start, 0)
        length = min(n - start, int(room[0]), free + int(room[2]))
        return length, max(length - free, 0)

    def pack(self, tokens: np.ndarray, loss: np.ndarray) -> Iterator[Piece]:
        start = np.zeros(len(tokens), np.int64)
        for k in range(len(tokens)):  # what no sequence takes whole first fills sequences of its own
            n, bearing = int(tokens[k]), min(int(loss[k]), int(tokens[k]))
            while (length := self._cut(int(start[k]), n, bearing, self.full)[0]) < n - start[k]:
                yield k, int(start[k]), length, self._new(), 0
                start[k] += length
        rest = tokens - start
        demand, kind = np.unique(np.stack([rest, np.minimum(rest, loss)], 1), axis=0, return_inverse=True)
        waiting: list[list[int]] = [[] for _ in demand]
        for k in np.flatnonzero(rest > 0)[::-1]:
            waiting[kind[k]].append(int(k))
        count = np.array([len(x) for x in waiting], np.int64)
        weight = demand / self.full[[0, 2]]
        while count.any():
            if self.open is None:
                self.open, self.left = self._new(), self.full.copy()
            room = self.left
            fits = (count > 0) & (demand[:, 0] <= room[0]) & (demand[:, 1] <= room[2])
            if fits.any():
                best = int(np.argmax(np.where(fits, weight @ (room[[0, 2]] / self.full[[0, 2]]), -1.0)))
                k = waiting[best].pop()
                count[best] -= 1
                length, bearing = (int(x) for x in demand[best])
            else:
                best = int(np.flatnonzero(count)[-1])
                k = waiting[best][-1]
                length, bearing = self._cut(int(start[k]), int(tokens[k]), min(int(loss[k]), int(tokens[k])), room)
                if not length:
                    self.open = None
                    continue
                waiting[best].pop()
                count[best] -= 1
            yield k, int(start[k]), length, self.open, int(self.full[0] - room[0])
            start[k] += length
            self.left = room - (length, 1, bearing)
            if self.left[0] == 0 or self.left[1] == 0:
                self.open = None
            if start[k] < tokens[k]:
                more = int(tokens[k] - start[k])
                both = np.array([more, min(more, int(loss[k]))])
                at = np.flatnonzero((demand == both).all(1))
                if len(at):
                    waiting[at[0]].append(k)
                    count[at[0]] += 1
                else:  # a demand no other example has: keep the kinds in order of size
                    place = int(np.searchsorted(demand[:, 0], more))
                    demand = np.insert(demand, place, both, 0)
                    weight = np.insert(weight, place, both / self.full[[0, 2]], 0)
                    count = np.insert(count, place, 1)
                    waiting.insert(place, [k])


def pack(
    docs: DataFrame,
    path: str,
    limits: Limits = Limits(),
    *,
    spaced: bool = True,
    end_id: int = END_ID,
    loss_chars: str | None = None,
    with_ids: bool = False,
    cache_pieces: int = CACHE_PIECES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of the documents' ids, each in one sequence.

    A null or empty text is its end id alone; an empty table gives no pieces; repeated rows are
    packed each on their own; a very long document fills whole sequences and its rest is packed.
    `loss_chars` names a column with the number of characters at the end of a text that bear loss
    (null: none); without it every id does. `with_ids` adds the ids of each piece.

    Every task packs the rows of its own split, one buffer at a time: no shuffle, memory bounded by
    the buffer and the longest document, and padding only in the last sequence of a task.
    """
    marked = F.lit(None).cast("long") if loss_chars is None else F.coalesce(docs[loss_chars].cast("long"), F.lit(0))
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), marked.alias("loss"))
    fields = [T.StructField(n, T.LongType(), False) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    fields[0].nullable = True
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType(), False), False))
    kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
    schema = pa.schema([(f.name, k) for f, k in zip(fields, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, packer = word_ids(path, spaced, cache_pieces), Packer(limits)
        first = TaskContext.get().partitionId() << 36
        end = np.array([end_id], "<u2").tobytes()
        held: list[tuple[int | None, np.ndarray, int]] = []

        def placed() -> Iterator[pa.RecordBatch]:
            tokens = np.array([len(x[1]) for x in held], np.int64)
            rows = list(packer.pack(tokens, np.array([x[2] for x in held], np.int64)))
            held_ids = [held[k][1][s : s + n].astype("<u4") for k, s, n, _, _ in rows]
            columns = [
                [held[k][0] for k, *_ in rows],
                [s for _, s, *_ in rows],
                [n for _, _, n, *_ in rows],
                [zlib.crc32(x.tobytes()) for x in held_ids],
                [int(tokens[k]) for k, *_ in rows],
                [first + q for *_, q, _ in rows],
                [o for *_, o in rows],
            ]
            if with_ids:
                columns.append([x.astype(np.int32) for x in held_ids])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], schema=schema)
            held.clear()

        size = 0
        for batch in batches:
            for doc_id, text, loss in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or ""
                if loss is None:
                    ids = ids_of.ids(text) + end
                    bearing = len(ids) // 2
                else:
                    cut = len(text) - max(0, min(loss, len(text)))
                    answer = ids_of.ids(text[cut:]) + end
                    ids, bearing = ids_of.ids(text[:cut]) + answer, len(answer) // 2 if loss > 0 else 0
                held.append((doc_id, np.frombuffer(ids, "<u2"), bearing))
                size += len(ids) // 2
                if len(held) >= BUFFER_EXAMPLES or size >= BUFFER_IDS:
                    yield from placed()
                    size = 0
        if held:
            yield from placed()

    return source.mapInArrow(run, T.StructType(fields))


def op6_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids of the byte-level vocabulary."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache_pieces=1_500_000)
