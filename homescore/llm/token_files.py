"""Token ids of a corpus in files: coded chunks in ascending document order, and their reader."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from homescore.llm import coder
from homescore.llm.common import id_text, shared_folder, table
from homescore.llm.tokens import word_ids

END_ID = 2
#: As many as numpy advances together well: its calls cost as much for a fourth of them.
CHUNK_IDS = 4096 * coder.BLOCK_IDS

_FILE = "part int, chunk int, first long, n_ids long, doc_ids array<long>, n_tokens array<long>, payload binary"
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]


def write_ids(docs: DataFrame, path: str, tokenizer: str, *, spaced: bool = False, vocabulary: int = 49408, end_id: int = END_ID, cache_pieces: int = 1_500_000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write every document's ids and an end id to `path`.

    A null or empty text is its end id; an empty table writes no chunk; rows that repeat a doc_id
    stay separate, side by side; null doc_ids come first. Documents are dealt by ranges of doc_id;
    each task writes its range in order, as chunks of whole documents. A chunk's row holds its place
    (part, number, ids before it in the part), a directory of its documents, and the coded blocks of
    `coder`. Parquet is the container, so any store serves and a lost task leaves nothing half written.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part = word_ids(tokenizer, spaced, cache_pieces), TaskContext.get().partitionId()
        end = np.array([end_id], "<u2").tobytes()
        chunk, first, held, doc_ids, lengths, size = 0, 0, [], [], [], 0

        def coded() -> pa.RecordBatch:
            payload = coder.encode(np.frombuffer(b"".join(held), "<u2"), vocabulary)
            row = [part, chunk, first, size, doc_ids, lengths, payload]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, _KINDS)], names=_FILE_NAMES)

        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            found = map(ids_of.ids, batch.column(1).to_pylist()) if spaced else ids_of.all_ids(texts)
            for doc_id, ids in zip(batch.column(0).to_pylist(), found):
                ids += end
                held.append(ids)
                doc_ids.append(doc_id)
                lengths.append(len(ids) // 2)
                size += len(ids) // 2
                if size >= CHUNK_IDS:
                    yield coded()
                    chunk, first = chunk + 1, first + size
                    held, doc_ids, lengths, size = [], [], [], 0
        if held:
            yield coded()

    ordered = id_text(docs, id_col, text_col).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(run, _FILE).write.parquet(path)


_FILE_NAMES = [field.split()[0] for field in _FILE.split(", ")]


def read_ids(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """Documents of `path` with start (ids of all documents before), n_tokens and ids_crc32.

    Every block's checksum is verified. `with_ids` adds the ids.
    """
    kinds = {"part": pa.int32(), "doc_id": pa.int64(), "first": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()}
    schema = "part int, doc_id long, first long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    if with_ids:
        kinds["ids"] = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = coder.decode(row["payload"])
                ends = np.cumsum(row["n_tokens"])
                pieces = np.split(ids, ends[:-1])
                columns = [
                    np.full(len(ends), row["part"], np.int32),
                    row["doc_ids"],
                    row["first"] + ends - row["n_tokens"],
                    row["n_tokens"],
                    [zlib.crc32(x.astype("<u4").tobytes()) for x in pieces],
                ]
                if with_ids:
                    columns.append([x.astype(np.int32) for x in pieces])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=list(kinds))

    files = spark.read.parquet(path)
    docs = files.select("part", "first", "n_ids", "doc_ids", "n_tokens", "payload").mapInArrow(run, schema)
    # One row a part: as many as the writer had partitions, whatever the corpus.
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    start = (F.col("base") + F.col("first")).alias("start")
    return docs.join(F.broadcast(base), "part").select("doc_id", start, "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op5_range_coded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written in coded files and read back."""
    import public_tokenizers

    path = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_ids(spark, path)
