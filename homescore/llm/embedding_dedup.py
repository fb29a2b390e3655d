"""Near-duplicate vectors by navigable small-world graphs, one a shard, all of them searched."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homescore.llm.common import discard, stage, table
from homescore.llm.components import components
from homescore.llm.hnsw import Graph


@dataclass(frozen=True)
class Shards:
    """Least cosine that links; least number of shards and most vectors in one; vectors that search together.

    A search walks the graph with `beam`; where its worst hit is no less than the cosine, all products with
    the shard follow. Of the vectors that search together one in `audit_every` is also compared with the
    whole shard; while the graph finds less than `recall` of those links, the beams of all widen. `slack` covers single precision in the graph; the cosine that decides is a double.
    A shard holds no more than about `shard_values` components, however long its vectors, and a task
    takes `task_rows` vectors past one shard.
    """

    cosine: float = 0.95
    shards: int = 8
    shard_rows: int = 50_000
    block_rows: int = 8192
    beam: int = 32
    audit_every: int = 64
    recall: float = 0.99
    slack: float = 1e-4
    shard_values: int = 6_400_000
    task_rows: int = 65_536


_TOGETHER = 256
_CELLS = 1 << 19  # products computed at once
_PIECE = 1 << 20  # bytes of a graph in one row
_PARTS = ("members", "graph")  # what the pieces of a shard make up
_GRAPH = {"dims": pa.int32(), "shard": pa.int32(), "part": pa.int32(), "piece": pa.int32(), "data": pa.binary()}
_TASKS = 18  # least number of tasks a round of searches has, where there are so many vectors


def usable(vector) -> F.Column:
    """Neither null nor zero, with finite components only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ListArray) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _unit(raw: np.ndarray) -> np.ndarray:
    raw = raw.astype(np.float64)
    raw /= np.abs(raw).max(1, keepdims=True)  # squares of large components would overflow
    raw /= np.linalg.norm(raw, axis=1, keepdims=True)
    return raw


def _by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of rows with the same keys; a group may come in several."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([np.asarray(batch.column(k)) for k in keys], 1)
        cuts = np.flatnonzero((rows[1:] != rows[:-1]).any(1)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)]):
            yield tuple(rows[a].tolist()), batch.slice(a, b - a)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The graph of every dims and shard, in pieces."""

    def pieces(key: tuple, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        node, copies, raw = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        out = io.BytesIO()
        np.savez(out, node=node, copies=copies, raw=raw)
        for part, data in enumerate([out.getvalue(), Graph.build(_unit(raw)).to_bytes(with_vectors=False)]):
            for at in range(0, len(data), _PIECE):
                row = [key[0], key[1], part, at // _PIECE, data[at : at + _PIECE]]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _GRAPH.values())], names=list(_GRAPH))

    last, parts = None, []
    for key, rows in _by_group(batches, ["dims", "shard"]):
        if key != last and parts:
            yield from pieces(last, parts)
        last = key
        parts.append((np.array(rows.column("node")), np.array(rows.column("copies")), _matrix(rows.column("vector")).copy()))
    if parts:
        yield from pieces(last, parts)


@dataclass
class Shard:
    """Members of a shard: nodes, how many rows each stands for, unit doubles and the graph over them."""

    nodes: np.ndarray
    copies: np.ndarray
    exact: np.ndarray
    graph: Graph

    @classmethod
    def from_pieces(cls, members: bytes, graph: bytes) -> Shard:
        held = np.load(io.BytesIO(members))
        exact = _unit(held["raw"])
        return cls(held["node"], held["copies"], exact, Graph.from_bytes(graph, exact))

    def products(self, queries: np.ndarray, rows: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links of some queries by all products, a bounded number at once."""
        step = max(1, _CELLS // len(self.exact))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            row, m = np.nonzero(queries[part] @ self.exact.T >= cosine)
            yield part[row], m


def shard_links(shard: Shard, queries: np.ndarray, mine: np.ndarray, how: Shards) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Query and shard member of every link found but with itself, each query's in one part; `queries` are unit doubles of the nodes `mine`."""
    single, least = queries.astype(np.float32), how.cosine - how.slack

    def others(q: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = mine[q] != shard.nodes[m]
        return q[keep], m[keep]

    def walk(rows: np.ndarray, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(rows), _TOGETHER):
            part = rows[at : at + _TOGETHER]
            ids, near = shard.graph.search(single[part], beam)
            close = near >= least
            full = close.all(1) if ids.shape[1] < len(shard.exact) else np.zeros(len(part), bool)
            row, k = np.nonzero(close & ~full[:, None])
            q, m = part[row], ids[row, k]
            sure = np.einsum("nd,nd->n", queries[q], shard.exact[m]) >= how.cosine
            yield others(q[sure], m[sure])
            for q, m in shard.products(queries, part[full], how.cosine):
                yield others(q, m)

    audited = np.arange(0, len(queries), how.audit_every)
    true = [others(q, m) for q, m in shard.products(queries, audited, how.cosine)]
    links, beam = np.bincount(np.concatenate([q for q, _ in true]), minlength=len(queries)), how.beam
    while beam < len(shard.exact):
        # Those with more links than the beam holds are left to products: they say nothing about the graph.
        few = links < beam
        if sum(few[q].sum() for q, _ in walk(audited, beam)) >= how.recall * links[few].sum():
            break
        beam *= 2
    yield from walk(np.arange(len(queries)), beam)


class Forest:
    """Which members of a shard links have joined so far: the least member each reaches."""

    def __init__(self, n: int):
        self.least = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links that say what is new in a[k] - b[k]: one for every member that was the least of its own until now."""
        before = self.least.copy()
        while True:
            a, b = self.least[a], self.least[b]
            apart = a != b
            if not apart.any():
                break
            a, b = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
            np.minimum.at(self.least, b, a)
            while not np.array_equal(up := self.least[self.least], self.least):
                self.least = up
        new = np.flatnonzero((before == np.arange(len(before))) & (self.least != before))
        return new, self.least[new]


def _met(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], names=["kind", "a", "b"])


def _search(how: Shards) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Take a stream of vectors past one graph after the other: rows are sorted by graph, its pieces first."""

    def block(shard: Shard, forest: Forest, asked: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        mine, raw = (np.concatenate(x) for x in zip(*asked))
        asked.clear()
        for q, m in shard_links(shard, _unit(raw), mine, how):
            if not len(q):
                continue
            order = np.lexsort((m, q))
            q, m = q[order], m[order]
            # Members that one vector links are in its component: it needs a link to the first of them
            # only, and each of them to the next. A cluster's vectors share nearly all these links.
            first = np.ones(len(q), bool)
            first[1:] = q[1:] != q[:-1]
            later = np.flatnonzero(~first)
            linked = q[first]
            yield _met(0, mine[linked], np.bincount(q, shard.copies[m], len(mine))[linked])
            yield _met(1, mine[linked], shard.nodes[m[first]])
            new, least = forest.join(m[later - 1], m[later])
            yield _met(1, shard.nodes[new], shard.nodes[least])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pieces, shard, forest, asked, most = None, ([], []), None, None, [], 0
        for key, rows in _by_group(batches, ["dims", "shard", "lot", "part"]):
            if key[:3] != last:
                if asked:
                    yield from block(shard, forest, asked)
                last, pieces, shard = key[:3], ([], []), None
            if key[3] < len(_PARTS):
                pieces[key[3]].extend(rows.column("data").to_pylist())
                continue
            if shard is None and not pieces[0]:
                continue  # no vector of this length is in the shard
            if shard is None:
                shard, pieces = Shard.from_pieces(*map(b"".join, pieces)), ([], [])
                forest, most = Forest(len(shard.nodes)), max(_TOGETHER, min(how.block_rows, how.shard_values // (4 * key[0])))
            asked.append((np.array(rows.column("node")), _matrix(rows.column("vector")).copy()))
            if sum(len(x) for x, _ in asked) >= most:
                yield from block(shard, forest, asked)
        if asked:
            yield from block(shard, forest, asked)

    return run


def _meetings(classes: DataFrame, how: Shards) -> DataFrame:
    """kind 0: node and the rows it links in one shard; kind 1: nodes of one component.

    The shards are built at once and searched in rounds, so that what moves at a time is a few times
    the vectors, however many shards there are. A task has one graph in memory and takes a lot of
    vectors past it.
    """
    n, values = classes.agg(F.count("*"), F.coalesce(F.sum("dims"), F.lit(0))).first()
    shards = max(how.shards, -(-n // how.shard_rows), -(-values // how.shard_values))
    lots = max(1, min(-(-n // how.block_rows), max(-(-n // how.task_rows), -(-_TASKS // shards))))
    turn = F.xxhash64("node")
    shard = F.pmod(turn, F.lit(shards)).cast("int")
    graphs = stage(
        classes.select("dims", shard.alias("shard"), turn.alias("turn"), "node", "copies", "vector")
        .repartitionById(shards, "shard").sortWithinPartitions("dims", "shard", "turn", "node")
        .mapInArrow(_build, "dims int, shard int, part int, piece int, data binary"),
        "graphs",
    )
    none = F.lit(None)
    lot = F.pmod(F.shiftrightunsigned(turn, 20), F.lit(lots)).cast("int")
    at_once, met = -(-_TASKS // lots), []
    for first in range(0, shards, at_once):
        some = list(range(first, min(shards, first + at_once)))
        held = graphs.where(F.col("shard").isin(some)).select(
            "dims", "shard", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot"), "part",
            F.col("piece").cast("long").alias("turn"), none.cast("long").alias("node"), none.cast(classes.schema["vector"].dataType).alias("vector"), "data",
        )
        asked = classes.select(
            "dims", F.explode(F.array(*map(F.lit, some))).alias("shard"), lot.alias("lot"), F.lit(len(_PARTS)).alias("part"),
            turn.alias("turn"), "node", "vector", none.cast("binary").alias("data"),
        )
        passed = held.union(asked).repartitionById(len(some) * lots, (F.col("shard") - first) * lots + F.col("lot"))
        met.append(stage(passed.sortWithinPartitions("dims", "shard", "lot", "part", "turn", "node").mapInArrow(_search(how), "kind int, a long, b long"), "met"))
    discard(graphs)
    return classes.sparkSession.read.schema(met[0].schema).parquet(*[x.staged_at for x in met])


def near_vectors(rows: DataFrame, how: Shards = Shards(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Vectors link where their cosine is at least `how.cosine`. Null and zero vectors, and those with null
    or non-finite components, link with nothing and are components of their own, as are vectors of a
    length no other has: only equal lengths compare. Equal vectors are searched once and count as
    links of each other; repeated rows are equal vectors. An empty table gives no rows.
    """
    single = isinstance(getattr(rows.select(vector_col).schema[0].dataType, "elementType", None), T.FloatType)
    vector = rows[vector_col].cast("array<float>" if single else "array<double>")
    given = rows.select(rows[id_col].cast("long").alias("vec_id"), F.when(usable(vector), vector).alias("vector"))
    hashed = stage(given.select("vec_id", "vector", F.when(F.col("vector").isNotNull(), F.xxhash64("vector")).alias("h1"), F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(17), "vector")).alias("h2")), "vectors")
    grouped = hashed.where("h1 is not null").groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("vector").alias("vector"))
    classes = stage(grouped.select("*", F.monotonically_increasing_id().alias("node"), F.size("vector").alias("dims")), "distinct")
    keyed = stage(hashed.select("vec_id", "h1", "h2"), "ids")
    discard(hashed)
    met = _meetings(classes, how)

    links = met.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    found = stage(components(met.where("kind = 1").select("a", "b")), "components")
    whole = classes.join(found, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("component", "node"))
    least = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    named = whole.join(least, "root").select("h1", "h2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    one = F.coalesce("component_id", "vec_id")
    return keyed.join(named, ["h1", "h2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), one.alias("component_id"), F.col("vec_id").eqNullSafe(one).alias("kept")
    )


def op9_hnsw_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all embeddings."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
