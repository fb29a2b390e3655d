"""Connected components of a link table, by rounds of joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homescore.llm.common import discard, stage


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one task reduced to stars: of each node the least it reaches by them."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 1_000_000:  # bounded: hand on what is known and start again
            yield _links([(x, root(x)) for x in list(parent)])
            parent = {}
    yield _links([(x, root(x)) for x in list(parent)])


def _links(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """node and the smallest node it reaches, for every node of `links` (long columns a and b).

    Rounds of the large-star and small-star steps: every node of a star is joined to the star's least
    node, until only stars are left. In between every task joins what it holds. A node with very many links is a skewed key of a join, which
    Spark splits; no neighbourhood is ever gathered. Each round is written, so a lost executor costs
    a round at most. Null ends and loops link nothing; no links give no rows.
    """
    edges = links.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).where("u <> v")
    edges = stage(edges.mapInArrow(_forest, "u long, v long"), "links")
    before = None
    while True:
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # now every link leads downwards; the least below a node takes over its other links
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        older = edges
        edges = stage(
            small.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*").where("u <> v").distinct().mapInArrow(_forest, "u long, v long"),
            "stars",
        )
        discard(older)
        now = edges.distinct().agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    edges = edges.distinct()
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
