"""What the operators share: inputs, staged tables, UTF-8 word spans and hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows handed to Python at once: texts are long, and an executor runs several workers.
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Keep what Python workers hold at once small."""
    if int(spark.conf.get(_BATCH)) > BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns the text operators work on, under fixed names; other columns play no part."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """k1 and k2, 128 bits that tell rows of other ids or texts apart; rows that repeat both share them."""
    given = [doc_id.isNull(), F.coalesce(doc_id, F.lit(0)), text.isNull(), F.coalesce(text, F.lit(""))]
    return [F.xxhash64(*given).alias("k1"), F.xxhash64(F.lit(23), *given).alias("k2")]


def free_name(name: str, taken: list[str]) -> str:
    """`name`, longer where a column is called so already."""
    while name in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir.

    Only a local session may go without; it gets one of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and return a scan of what was written.

    The written table cuts the lineage, outlives lost executors and is computed once; the shuffle
    files behind it go as soon as it is complete.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    return staged


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that no later step reads."""
    for df in staged:
        spark = df.sparkSession.sparkContext
        path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id):
    """True for the quarter of documents no model may learn labels from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


# --- words of a UTF-8 text: runs of bytes other than ASCII white space ------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_POWERS = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the longest asked for so far is kept."""
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        size = 1 << max(n - 1, (1 << 16) - 1).bit_length()
        known = np.full(size, base, np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if size <= 1 << 21:
            _POWERS[int(base)] = known
    return known[:n]


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in a buffer of bytes."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_SPACE[raw]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes: a polynomial from prefix sums, then mixed with the length."""
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(raw)), out=total[1:])
    poly = (total[ends] - total[starts]) * powers(_INVERSE, len(raw) + 1)[starts]
    return mix(poly + mix((ends - starts).astype(np.uint64)))


def window_hashes(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """64-bit hash of each run of `size` consecutive word hashes, in order."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    b = np.uint64(base | 1)
    inverse = np.uint64(pow(int(b), -1, 1 << 64))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(b, len(words)), out=total[1:])
    return mix((total[size:] - total[:-size]) * powers(inverse, n))
