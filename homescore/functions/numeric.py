"""Aggregate and arithmetic column functions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole) * 100


def clipped_ratio(value: Column, limit: float) -> Column:
    """value / limit, at most 1."""
    return F.when(value >= limit, F.lit(1.0)).otherwise(value / F.lit(limit))


def bucket_label(value: Column, edges: Sequence[float]) -> Column:
    """'[lo, hi)' of the bucket a value falls in; the last bucket also holds its upper edge.

    Values outside all buckets, and NULL, give NULL.
    """
    last = len(edges) - 2
    label = F.lit(None).cast("string")
    for i in reversed(range(last + 1)):
        lo, hi = edges[i], edges[i + 1]
        inside = (value >= lo) & ((value <= hi) if i == last else (value < hi))
        label = F.when(inside, F.lit(f"[{lo}, {hi}" + ("]" if i == last else ")"))).otherwise(label)
    return label


def bin_index(value: Column, edges: Sequence[float]) -> Column:
    """0-based index of the left-closed, right-open bin; NULL outside all bins."""
    index = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        index = F.when((value >= edges[i]) & (value < edges[i + 1]), F.lit(i)).otherwise(index)
    return index


def hash_bucket(key: Column, seed: int, buckets: int) -> Column:
    """Bucket of a key that depends only on the key and the seed, on any engine with md5."""
    text = F.concat_ws(":", key.cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % buckets
