"""Trie of conversations' prefixes, and the sums of its subtrees by an Euler tour.

A prefix is known by 128 bits over its turns and their places. Every node has an arc into it and one out of
it; the tour follows both around the tree. It is ranked as a list: every task joins the arcs it holds into
runs, the runs are ranked, by one task while they are few and by pointer jumping otherwise, and prefix sums
at a node's two arcs give its subtree's sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homescore.llm.common import discard, stage, table

_WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Tour:
    """Rows dealt to a task and least number of tasks of a sorted pass; most runs that one task ranks;
    bytes of joined ids in one row on their way to a digest."""

    task_rows: int = 250_000
    tasks: int = 8
    one_task: int = 250_000
    chunk: int = 65_536


# --- sorted passes ---------------------------------------------------------------------------------


def _sorted(rows: DataFrame, n: int, how: Tour, *order) -> DataFrame:
    """Rows dealt out by range and sorted, so that one large key is dealt out too."""
    return rows.repartitionByRange(max(how.tasks, -(-n // how.task_rows)), *order).sortWithinPartitions(*order)


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch[n].to_numpy(zero_copy_only=False) for n in names]


def _running(rows: DataFrame, n: int, how: Tour, order: list[str], kept: list[str], xors: tuple[str, ...] = ()) -> DataFrame:
    """conv and `kept` with `place`, a row's number within its `conv` in the given order, and each of `xors`
    as the exclusive-or of it over the conversation up to the row.

    A task counts what it holds. Only the first conversation of a task can have begun in an earlier one:
    one row a task tells where it stands.
    """
    names, kept = ["place", *xors], ["conv", *kept]
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, seen, held = TaskContext.get().partitionId(), None, 0, [0] * len(xors)
        for batch in batches:
            if not batch.num_rows:
                continue
            (of,) = _columns(batch, "conv")
            new = np.r_[of[0] != conv, of[1:] != of[:-1]]
            start = np.maximum.accumulate(np.where(new, np.arange(len(of)), 0))
            goes_on = np.cumsum(new) == 0
            out = [np.arange(len(of)) - start + 1 + np.where(goes_on, seen, 0)]
            for k, values in enumerate(_columns(batch, *xors)):
                whole = np.bitwise_xor.accumulate(values)
                out.append(whole ^ np.where(start > 0, whole[start - 1], 0) ^ np.where(goes_on, held[k], 0))
            conv, seen, held = of[-1], int(out[0][-1]), [int(x[-1]) for x in out[1:]]
            given = [batch[c] for c in kept]
            yield pa.RecordBatch.from_arrays([*given, pa.array([part] * len(of), pa.int32()), *[pa.array(x, pa.int64()) for x in out]], names=[*kept, "part", *names])

    schema = ", ".join([*[f"{c} {types[c]}" for c in kept], "part int", *[f"{c} long" for c in names]])
    ordered = _sorted(rows, n, how, "conv", *order)
    counted = stage(ordered.mapInArrow(run, schema), "running")
    ends = counted.groupBy("part").agg(F.min("conv").alias("first"), F.max(F.struct("conv", *names)).alias("last")).orderBy("part")
    before, carried = [], None
    for r in ends.collect():  # one row a task
        last = tuple(r["last"])
        if carried and carried[0] == r["first"]:
            before.append((r["part"], *carried))
            if last[0] == carried[0]:
                last = (last[0], last[1] + carried[1], *[a ^ b for a, b in zip(last[2:], carried[2:])])
        carried = last
    if not before:
        return counted.drop("part")
    spark = rows.sparkSession
    known = spark.createDataFrame(before, ", ".join(["part int", "conv long", *[f"b_{c} long" for c in names]]))
    joined = counted.join(F.broadcast(known), ["part", "conv"], "left")
    earlier = lambda c: F.coalesce(F.col(f"b_{c}"), F.lit(0))
    return joined.select(*kept, (F.col("place") + earlier("place")).alias("place"), *[F.col(c).bitwiseXOR(earlier(c)).alias(c) for c in xors])


# --- turns -----------------------------------------------------------------------------------------


def numbered_turns(rows: DataFrame, how: Tour = Tour(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, place (from 1), h1 and h2 (hash of role and text) and words of every turn.

    Turns are in the order of `turn_col`, null first; equal ones by role, then by the MD5 digest of the
    text. A null role or text is empty. Rows without a conversation id are left out; rows that repeat
    are turns of their own.
    """
    role, text = (F.coalesce(rows[c].cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = rows.select(
        rows[conv_col].cast("long").alias("conv"), rows[turn_col].alias("turn"), role.alias("role"), F.md5(text).alias("digest"),
        F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(29), role, text).alias("h2"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("given"),
    ).where("conv is not null")
    counted = _running(turns, rows.count(), how, ["turn", "role", "digest", "given"], ["h1", "h2", "words"])
    return counted.select("conv", "place", "h1", "h2", "words")


def with_borrowed_heads(turns: DataFrame, block: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as the first of their block of ids does: the turns, and all ids.

    Conversation c has the first h turns of conversation c - c % block (all, if fewer), then its own
    after its first h, where h = crc32(c) % heads. `turns` is read several times, so it is a table.
    """
    borrows = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    convs = turns.where("place = 1").select("conv", borrows.cast("long").alias("h"), (F.col("conv") - F.col("conv") % block).alias("base"))
    early = turns.where(F.col("place") < heads).withColumnRenamed("conv", "base")
    borrowed = convs.join(early, "base").where("place <= h").select("conv", "place", "h1", "h2", "words")
    counts = early.groupBy("base").agg(F.count("*").alias("n"))
    short = convs.join(counts, "base", "left").select("conv", (F.col("h") - F.least("h", F.coalesce("n", F.lit(0)))).alias("lacks")).where("lacks > 0")
    own = turns.where(F.col("place") > borrows).join(short, "conv", "left").select("conv", (F.col("place") - F.coalesce("lacks", F.lit(0))).alias("place"), "h1", "h2", "words")
    return borrowed.union(own), convs.select("conv")


# --- nodes -----------------------------------------------------------------------------------------


def _nodes(turns: DataFrame, convs: DataFrame, how: Tour) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, depth, k1, k2, p1, p2, conv_id, n_convs, words) and where each conversation ends (conv, depth, k1, k2)."""
    at_place = turns.select("conv", F.col("place").alias("depth"), "words", F.xxhash64("h1", "h2", "place").alias("z1"), F.xxhash64(F.lit(31), "h2", "h1", "place").alias("z2"))
    at_place = at_place.select("*", F.col("z1").alias("k1"), F.col("z2").alias("k2"))
    keyed = stage(_running(at_place, turns.count(), how, ["depth"], ["depth", "words", "z1", "z2"], ("k1", "k2")).drop("place"), "prefixes")
    nodes = keyed.groupBy("depth", "k1", "k2").agg(
        F.min(F.col("k1").bitwiseXOR(F.col("z1"))).alias("p1"), F.min(F.col("k2").bitwiseXOR(F.col("z2"))).alias("p2"),
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"),
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), "conv_id", "n_convs", zero.alias("words")
    )
    numbered = stage(nodes.union(root).withColumn("node", F.monotonically_increasing_id()), "nodes")
    deepest = keyed.groupBy("conv").agg(F.max(F.struct("depth", "k1", "k2")).alias("end")).select("conv", "end.*")
    ends = convs.join(deepest, "conv", "left").select("conv", *[F.coalesce(c, zero).alias(c) for c in ("depth", "k1", "k2")])
    ends = stage(ends, "ends")
    discard(keyed)
    return numbered, ends


def _next_siblings(tree: DataFrame, n: int, how: Tour) -> DataFrame:
    """node and the node of the next conversation with the same parent, where there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, at = TaskContext.get().partitionId(), (None, None), 0
        for batch in batches:
            if batch.num_rows:
                parent, node = _columns(batch, "parent", "node")
                later = np.r_[before[1] if before[0] == parent[0] else -1, np.where(parent[1:] == parent[:-1], node[:-1], -1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(node), pa.int32()), pa.array(np.arange(at, at + len(node))), pa.array(parent), pa.array(node), pa.array(later.astype(np.int64))],
                    names=["part", "at", "parent", "node", "later"],
                )
                before, at = (parent[-1], node[-1]), at + len(node)

    # later conversations come first, so that a task has met the next one when it needs it
    ordered = _sorted(tree.where("parent is not null").select("parent", "conv_id", "node"), n, how, F.col("parent"), F.col("conv_id").desc())
    met = stage(ordered.mapInArrow(run, "part int, at long, parent long, node long, later long"), "siblings")
    edges = met.groupBy("part").agg(F.min(F.struct("at", "parent", "node")).alias("first"), F.max(F.struct("at", "parent", "node")).alias("last")).orderBy("part")
    rows, fixed = edges.collect(), []  # one row a task
    for a, b in zip(rows, rows[1:]):
        if a["last"]["parent"] == b["first"]["parent"]:
            fixed.append((b["first"]["node"], a["last"]["node"]))
    known = tree.sparkSession.createDataFrame(fixed, "node long, across long")
    joined = met.join(F.broadcast(known), "node", "left").select("node", F.coalesce("across", F.when(F.col("later") >= 0, F.col("later"))).alias("sibling"))
    return joined.where("sibling is not null")


# --- the tour --------------------------------------------------------------------------------------


def _doubled(pointer: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums along pointers (-1: none), each element's own included, and the last element reached."""
    end, pointer = np.arange(len(pointer)), pointer.copy()
    sums = [s.copy() for s in sums]
    while (on := np.flatnonzero(pointer >= 0)).size:
        to = pointer[on]
        gained, ends, further = [s[to] for s in sums], end[to], pointer[to]
        for s, g in zip(sums, gained):
            s[on] += g
        end[on], pointer[on] = ends, further
    return (end, *sums)


_ARC = "kind int, node long, out int, head long, next long, n long, leaves long, saved long"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins one task's arcs. kind 0: an arc, the head of its run, and the sums of the run before it; kind 1: a
    run, its sums, and the head of the run after it (-1: none)."""
    held = [_columns(b, "node", "enter_next", "exit_next", "leaf", "saved") for b in batches if b.num_rows]
    if not held:
        return
    node, enter_next, exit_next, leaf, saved = (np.concatenate(c) for c in zip(*held))
    order = np.argsort(node)
    node, enter_next, exit_next, leaf, saved = (c[order] for c in (node, enter_next, exit_next, leaf, saved))
    n = len(node)
    arc, then = np.empty(2 * n, np.int64), np.empty(2 * n, np.int64)
    arc[0::2], arc[1::2] = 2 * node, 2 * node + 1
    then[0::2], then[1::2] = enter_next, exit_next
    weights = np.zeros((2, 2 * n), np.int64)
    weights[0, 0::2], weights[1, 0::2] = leaf, saved
    at = np.searchsorted(arc, then)
    here = (at < 2 * n) & (arc[np.minimum(at, 2 * n - 1)] == then)
    before = np.full(2 * n, -1)
    before[at[here]] = np.flatnonzero(here)
    head, count, leaves, cost = _doubled(before, np.ones(2 * n, np.int64), *weights)
    tail = np.flatnonzero(~here)

    def batch(kind: int, of: np.ndarray, nexts: np.ndarray) -> pa.RecordBatch:
        own = np.zeros((3, len(of)), np.int64) if kind else np.stack([np.ones(len(of), np.int64), *weights[:, of]])
        sums = np.stack([count[of], leaves[of], cost[of]]) - own
        columns = [np.full(len(of), kind, np.int32), arc[of] >> 1, (arc[of] & 1).astype(np.int32), arc[head[of]], nexts, *sums]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in _ARC.split(", ")])

    yield batch(1, tail, then[tail])
    for k in range(0, 2 * n, 65_536):
        of = np.arange(k, min(k + 65_536, 2 * n))
        yield batch(0, of, np.full(len(of), -1))


def _ranked_at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [_columns(b, "head", "next", "n", "leaves", "saved") for b in batches if b.num_rows]
    if not held:
        return
    head, then, *sums = (np.concatenate(c) for c in zip(*held))
    order = np.argsort(head)
    head, then, sums = head[order], then[order], [s[order] for s in sums]
    at = np.where(then >= 0, np.searchsorted(head, then), -1)
    _, *rest = _doubled(at, *sums)
    yield pa.RecordBatch.from_arrays([pa.array(head), *[pa.array(r) for r in rest]], names=["head", "n", "leaves", "saved"])


def _ranked(runs: DataFrame, how: Tour) -> DataFrame:
    """head, and the sums over its run and all runs after it."""
    figures = ("n", "leaves", "saved")
    if runs.count() <= how.one_task:
        return stage(runs.repartition(1).mapInArrow(_ranked_at_once, "head long, n long, leaves long, saved long"), "ranks")
    jumped = runs.select("head", "next", *figures)
    while jumped.where("next >= 0").limit(1).count():
        ahead = jumped.select(F.col("head").alias("next"), F.col("next").alias("after"), *[F.col(c).alias(f"more_{c}") for c in figures])
        older, jumped = jumped, stage(
            jumped.join(ahead, "next", "left").select("head", F.coalesce("after", F.lit(-1)).alias("next"), *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in figures]),
            "jumps",
        )
        if hasattr(older, "staged_at"):
            discard(older)
    return jumped.drop("next")


def _subtree_sums(tree: DataFrame, n: int, how: Tour) -> DataFrame:
    """node, n_leaves, below and tour_at. `tree`: node, conv_id, depth, parent, child, n_children, saved."""
    later = _next_siblings(tree, n, how)
    enter_next = F.coalesce(F.col("child") * 2, F.col("node") * 2 + 1)
    exit_next = F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1, F.lit(-1))
    arcs = tree.join(later, "node", "left").select(
        "conv_id", "depth", "node", enter_next.alias("enter_next"), exit_next.alias("exit_next"), (F.col("n_children") == 0).cast("long").alias("leaf"), "saved"
    )
    # in this order a conversation's own stretch of the tree and its neighbours' lie together
    found = stage(_sorted(arcs, n, how, "conv_id", "depth").mapInArrow(_runs, _ARC), "tour")
    runs = found.where("kind = 1").select("head", "next", "n", "leaves", "saved")
    ranks = _ranked(runs, how).select("head", *[F.col(c).alias(f"rest_{c}") for c in ("n", "leaves", "saved")])
    # sums before an arc are the whole less those from its run on, plus its part of the run; the whole cancels
    at_arc = found.where("kind = 0").join(ranks, "head")
    exits = F.col("out") == 1
    own = lambda c: F.when(exits, F.col(c) - F.col(f"rest_{c}")).otherwise(F.col(f"rest_{c}") - F.col(c))
    entered = F.when(~exits, 2 * n - F.col("rest_n") + F.col("n"))
    return at_arc.groupBy("node").agg(F.sum(own("leaves")).alias("n_leaves"), F.sum(own("saved")).alias("below"), F.max(entered).alias("tour_at"))


def _digests(ends: DataFrame, n: int, how: Tour) -> DataFrame:
    """depth, k1, k2 and ends_sha256: digest of the ids that end there, ascending and joined.

    Tasks join what they hold into pieces; a node's pieces then pass through one digest, a row at a time.
    """
    key = ["depth", "k1", "k2"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, now, ids, size = TaskContext.get().partitionId(), 0, None, [], 0
        names = [*key, "part", "at", "piece"]

        def rows(done: list) -> pa.RecordBatch:
            types = [pa.int64()] * 3 + [pa.int32(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(types)], names=names)

        for batch in batches:
            done = []
            for *k, conv in zip(*(batch[c].to_pylist() for c in (*key, "conv"))):
                if now is not None and (k != now or size > how.chunk):
                    done.append((*now, part, at, ",".join(ids)))
                    ids, size, at = [], 0, at + 1
                now = k
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            yield rows(done)
        if ids:
            yield rows([(*now, part, at, ",".join(ids))])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, names = None, None, [*key, "ends_sha256"]

        def rows(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string() if k == 3 else pa.int64()) for k in range(4)], names=names)

        for batch in batches:
            done = []
            for *k, piece in zip(*(batch[c].to_pylist() for c in (*key, "piece"))):
                if k != now:
                    if now is not None:
                        done.append((*now, sha.hexdigest()))
                    now, sha = k, hashlib.sha256(piece.encode())
                else:
                    sha.update(b"," + piece.encode())
            yield rows(done)
        if now is not None:
            yield rows([(*now, sha.hexdigest())])

    pieces = _sorted(ends, n, how, *key, "conv").mapInArrow(join, "depth long, k1 long, k2 long, part int, at long, piece string")
    dealt = pieces.repartition(*key).sortWithinPartitions(*key, "part", "at")
    return dealt.mapInArrow(digest, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, how: Tour = Tour()) -> DataFrame:
    """One row for each node of the trie of all conversations' turns.

    `turns`: conv, place (1, 2, ...), h1, h2 (hash of the turn) and words, as `numbered_turns` gives them,
    read more than once; `convs`: all ids, those of conversations without turns too. Returns conv_id (the
    smallest member), depth, parent_conv_id (root: null), n_convs, n_children, n_leaves, saved_tokens (over
    the subtree, each node's (n_convs - 1) * words), ends_sha256 (of the sorted ids of conversations that end
    there, joined by commas) and tour_at (place of the arc into it in the tour, from 0). No conversations give no rows, turnless ones the root.
    """
    nodes, ends = _nodes(turns, convs, how)
    n = nodes.count()
    above = nodes.select(F.col("depth").alias("up"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    child = nodes.where("depth > 0").withColumn("up", F.col("depth") - 1).join(above, ["up", "p1", "p2"])
    columns = ["node", "depth", "k1", "k2", "conv_id", "n_convs", "words", "parent", "parent_conv_id"]
    none = F.lit(None).cast("long")
    linked = stage(child.select(columns).union(nodes.where("depth = 0").withColumns({"parent": none, "parent_conv_id": none}).select(columns)), "linked")
    first = linked.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.min(F.struct("conv_id", "node")).alias("least"))
    first = first.select("node", "n_children", F.col("least.node").alias("child"))
    saved = (F.col("n_convs") - 1) * F.col("words")
    tree = stage(linked.join(first, "node", "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)).cast("long"), "saved": saved}), "tree")
    sums = _subtree_sums(tree, n, how)
    digests = _digests(ends, n, how)
    return tree.join(sums, "node").join(digests, ["depth", "k1", "k2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("below").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "tour_at",
    )


def op12_euler_tour_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie of all conversations, each begun as the first of its twenty."""
    turns = stage(numbered_turns(table(spark, sf_dir, "conversations")), "turns")
    rebuilt, convs = with_borrowed_heads(turns)
    return prefix_trie(stage(rebuilt, "rebuilt"), stage(convs, "convs")).drop("tour_at")
