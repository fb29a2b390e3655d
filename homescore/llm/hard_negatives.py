"""Hard negatives from Hilbert-ordered blocks with zone maps.

Vectors of one label follow a Hilbert curve and are cut into blocks, each a row of a Parquet table with the
least and greatest value of every dimension. Interval arithmetic over these zone maps bounds the score of an
anchor with anything in a block, so an anchor's windows of scores read only blocks that can hold a row for
them. What is read is scored exactly, in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from homescore.llm.common import discard, stage, table

#: Stands for a null id, which sorts after all others.
_NO_ID = np.iinfo(np.int64).max
_LARGEST = 1 << 24  # components are cut there, so that whole-number products cannot overflow
_NONE = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Mining:
    """Positives and negatives of an anchor; the window of negative scores in percent of the positive's.

    Components are floor(`scale` * x). `bits` a dimension make the curve. A block has `block_rows`
    vectors, a shard (what one task reads at once) about `shard_rows`, a group `group_anchors` anchors;
    there are `shards` shards at least.
    """

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    scale: int = 256
    bits: int = 4
    block_rows: int = 1024
    shard_rows: int = 131_072
    shards: int = 8
    group_anchors: int = 8192


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of `cells` (values of `bits` bits), as rows of big-endian bytes."""
    x = cells.T.astype(np.uint32)
    d = len(x)
    if not d:
        return np.zeros((len(cells), 0), np.uint8)
    for shift in range(bits - 1, 0, -1):
        low = np.uint32((1 << shift) - 1)
        for i in range(d):
            turned = (x[i] >> np.uint32(shift)) & np.uint32(1) == 1
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] ^= np.where(turned, low, swap)
            if i:
                x[i] ^= swap
    x = np.bitwise_xor.accumulate(x, axis=0)
    odd = np.zeros(x.shape[1], np.uint32)
    for shift in range(bits - 1, 0, -1):
        odd ^= np.where((x[-1] >> np.uint32(shift)) & np.uint32(1) == 1, np.uint32((1 << shift) - 1), np.uint32(0))
    x ^= odd
    planes = (x[None] >> np.arange(bits - 1, -1, -1, dtype=np.uint32)[:, None, None]) & np.uint32(1)
    return np.packbits(planes.reshape(bits * d, -1).T.astype(np.uint8), axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two whole-number matrices, exact."""
    size = (np.abs(a).max(initial=0) + 1) * (np.abs(b).max(initial=0) + 1) * max(a.shape[1], 1)
    if size < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with anything in each box."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return products(up, low) + products(down, high), products(up, high) + products(down, low)


def _whole(raw: bytes, dims: int) -> np.ndarray:
    """A matrix of stored components; rows without components have no bytes, so their number is lost and not needed."""
    return np.frombuffer(raw, "<i4").reshape(-1, dims).astype(np.int64) if dims else np.zeros((0, 0), np.int64)


def _longs(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i8")


def _best(of: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each `of`: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -scores, of))
    of = of[order]
    first = np.searchsorted(of, of, "left")
    return order[np.arange(len(of)) - first < k]


# --- blocks ----------------------------------------------------------------------------------------

_BLOCK = "block long, shard int, dims int, label long, ids binary, vectors binary, low binary, high binary, at binary, floors binary"


def _usable(rows: DataFrame, anchors: Column, how: Mining, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    vector = rows[vector_col].cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = rows.where(rows[label_col].isNotNull() & vector.isNotNull() & finite)
    cell = lambda x: F.floor(F.least(F.greatest(x * how.scale, F.lit(float(-_LARGEST))), F.lit(float(_LARGEST)))).cast("int")
    return kept.select(
        F.coalesce(rows[id_col].cast("long"), F.lit(int(_NO_ID))).alias("vec_id"), rows[label_col].cast("long").alias("label"),
        F.size(vector).alias("dims"), F.transform(vector, cell).alias("vector"), F.coalesce(anchors, F.lit(False)).alias("anchor"),
        F.monotonically_increasing_id().alias("given"),
    )


def _with_keys(rows: DataFrame, middle: float, spread: float, how: Mining) -> DataFrame:
    cells = 1 << how.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, values = np.asarray(batch["dims"]), np.asarray(batch["vector"].flatten())
            at = np.concatenate([[0], np.cumsum(dims)])
            keys: list[bytes] = [b""] * len(dims)
            for d in np.unique(dims):
                of = np.flatnonzero(dims == d)
                x = values[at[of][:, None] + np.arange(d)]
                place = np.floor((x - middle) / spread * (cells / 4) + cells / 2)  # two deviations either way
                for k, key in zip(of, hilbert_keys(np.clip(place, 0, cells - 1).astype(np.uint32), how.bits)):
                    keys[k] = key.tobytes()
            raw = values.astype("<i4")
            vectors = pa.array([raw[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], batch["dims"], vectors, batch["anchor"], batch["given"], pa.array(keys, pa.binary())], names=["vec_id", "label", "dims", "vector", "anchor", "given", "key"])

    return rows.mapInArrow(run, "vec_id long, label long, dims int, vector binary, anchor boolean, given long, key binary")


def _cut(how: Mining):
    """Blocks of sorted rows. An anchor notes the score it reaches `positives` times in its own block, if it does."""

    def block(number: int, shard: int, rows: list[tuple]) -> dict:
        dims, label = rows[0][2], rows[0][1]
        rows = sorted(rows, key=lambda r: r[0])  # ties in a score go by id
        raw = b"".join(r[3] for r in rows)
        x = _whole(raw, dims) if dims else np.zeros((len(rows), 0), np.int64)
        at = np.flatnonzero([r[4] for r in rows])
        scores = products(x[at], x)
        scores[np.arange(len(at)), at] = _NONE  # itself
        k = how.positives
        floors = np.sort(scores, axis=1)[:, -k] if len(rows) > k else np.full(len(at), _NONE)
        as_bytes = lambda a, kind: np.asarray(a).astype(kind).tobytes()
        return {
            "block": number, "shard": shard, "dims": dims, "label": label, "ids": as_bytes([r[0] for r in rows], "<i8"), "vectors": raw,
            "low": as_bytes(x.min(0), "<i4"), "high": as_bytes(x.max(0), "<i4"), "at": as_bytes(at, "<i8"), "floors": as_bytes(floors, "<i8"),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, made, held = TaskContext.get().partitionId(), 0, []

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal made, held
            if held:
                yield pa.RecordBatch.from_pylist([block((shard << 24) + made, shard, held)], schema=schema)
                made, held = made + 1, []

        longs, ints, raw = pa.int64(), pa.int32(), pa.binary()
        schema = pa.schema(list(zip([c.split()[0] for c in _BLOCK.split(", ")], [longs, ints, ints, longs, raw, raw, raw, raw, raw, raw])))
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("vec_id", "label", "dims", "vector", "anchor"))):
                if len(held) == how.block_rows or held and held[-1][1:3] != row[1:3]:
                    yield from done()
                held.append(row)
        yield from done()

    return run


# --- anchors in groups -----------------------------------------------------------------------------

_GROUP = "group int, dims int, rows binary, labels binary, vectors binary, lows binary, highs binary"


def _anchors(blocks: DataFrame) -> DataFrame:
    """row (its block and place there), anchor_id, shard, dims, label, vector and floor of every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                at, dims = _longs(r["at"]), r["dims"]
                if len(at):
                    vectors = [r["vectors"][4 * dims * k : 4 * dims * (k + 1)] for k in at]
                    n = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((r["block"] << 20) + at), pa.array(_longs(r["ids"])[at]), pa.array([r["shard"]] * n, pa.int32()), pa.array([dims] * n, pa.int32()), pa.array([r["label"]] * n, pa.int64()), pa.array(vectors, pa.binary()), pa.array(_longs(r["floors"]))],
                        names=["row", "anchor_id", "shard", "dims", "label", "vector", "floor"],
                    )

    held = blocks.where("octet_length(at) > 0").select("block", "shard", "dims", "label", "ids", "vectors", "at", "floors")
    return held.mapInArrow(run, "row long, anchor_id long, shard int, dims int, label long, vector binary, floor long")


def _numbered(anchors: DataFrame, how: Mining) -> DataFrame:
    """Anchors with the number of their group: shards in their order, so that near anchors want the same blocks."""
    counts = anchors.groupBy("dims", "shard").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("dims", "shard")) - F.col("n")  # one row a shard
    return anchors.join(counts.select("dims", "shard", F.floor(before / how.group_anchors).cast("int").alias("group")), ["dims", "shard"])


def _packed(anchors: DataFrame) -> DataFrame:
    """One row for each group (and number of dimensions). `lows` and `highs`: arrays of window ends, all of one length."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        raw = lambda c: np.asarray(rows[c].combine_chunks().flatten() if c in ("lows", "highs") else rows[c]).astype("<i8").tobytes()
        one = {"group": rows["group"][0].as_py(), "dims": rows["dims"][0].as_py(), "rows": raw("row"), "labels": raw("label"), "vectors": b"".join(rows["vector"].to_pylist()), "lows": raw("lows"), "highs": raw("highs")}
        return pa.Table.from_pylist([one], pa.schema([("group", pa.int32()), ("dims", pa.int32()), *[(c, pa.binary()) for c in ("rows", "labels", "vectors", "lows", "highs")]]))

    picked = anchors.select("group", "dims", "row", "label", "vector", "lows", "highs")
    return picked.groupBy("group", "dims").applyInArrow(run, _GROUP)


class _Group:
    """A group of anchors as arrays; `lows` and `highs` have one column a window."""

    def __init__(self, row: dict) -> None:
        self.rows, self.labels = _longs(row["rows"]), _longs(row["labels"])
        n = len(self.rows)
        self.vectors = _whole(row["vectors"], row["dims"]) if row["dims"] else np.zeros((n, 0), np.int64)
        self.lows, self.highs = (_longs(row[c]).reshape(n, -1) for c in ("lows", "highs"))

    def wants(self, low: np.ndarray, high: np.ndarray, labels: np.ndarray, same: bool) -> np.ndarray:
        """Anchors by blocks: whether a block, by its zone map, can hold a row for any window of the anchor."""
        least, most = bounds(self.vectors, low, high)
        wanted = np.zeros(least.shape, bool)
        for k in range(self.lows.shape[1]):
            wanted |= (most >= self.lows[:, k, None]) & (least <= self.highs[:, k, None])
        return wanted & ((self.labels[:, None] == labels) == same)


_SLICE = 1024


def _found(group: _Group, blocks: list[dict], dims: int, k: int, same: bool) -> tuple[np.ndarray, ...]:
    """Anchor row, window, id and score of the first k rows of each window, from the given blocks.

    While a window holds k rows, its low end is the worst of their scores.
    """
    boxes = [np.stack([_whole(b[c], dims)[0] if dims else np.zeros(0, np.int64) for b in blocks]) for c in ("low", "high")]
    labels = np.array([b["label"] for b in blocks])
    out: list[tuple[np.ndarray, ...]] = []
    for start in range(0, len(group.rows), _SLICE):
        part = slice(start, start + _SLICE)
        rows, x, high = group.rows[part], group.vectors[part], group.highs[part]
        low, n_windows = group.lows[part].copy(), group.lows.shape[1]
        least, most = bounds(x, *boxes)
        of, scores, ids = (np.zeros(0, np.int64) for _ in range(3))
        for at in np.argsort(-most.max(0), kind="stable"):
            block = blocks[at]
            reach = (most[:, at, None] >= low) & (least[:, at, None] <= high)
            here = np.flatnonzero(reach.any(1) & ((group.labels[part] == labels[at]) == same))
            if not len(here):
                continue
            names = _longs(block["ids"])
            y = _whole(block["vectors"], dims) if dims else np.zeros((len(names), 0), np.int64)
            score = products(x[here], y)
            own = rows[here] - (block["block"] << 20)
            itself = np.flatnonzero((own >= 0) & (own < len(names)))
            apart = np.ones(score.shape, bool)
            apart[itself, own[itself]] = False
            news = []
            for w in range(n_windows):
                a, c = np.nonzero(apart & (score >= low[here, w, None]) & (score <= high[here, w, None]))
                news.append((here[a] * n_windows + w, score[a, c], names[c]))
            of, scores, ids = (np.concatenate([old, *[new[j] for new in news]]) for j, old in enumerate((of, scores, ids)))
            keep = _best(of, scores, ids, k)
            of, scores, ids = of[keep], scores[keep], ids[keep]
            last = np.flatnonzero(np.r_[of[1:] != of[:-1], True]) if len(of) else np.zeros(0, np.int64)
            full = last[np.diff(np.r_[-1, last]) == k]
            low.reshape(-1)[of[full]] = np.maximum(low.reshape(-1)[of[full]], scores[full])
        out.append((rows[of // n_windows], of % n_windows, ids, scores))
    return tuple(np.concatenate([o[j] for o in out]) for j in range(4))


def _search(groups: DataFrame, blocks: DataFrame, shards: int, k: int, same: bool) -> DataFrame:
    """row, window, vec_id and score of the first k rows of each window, shard by shard.

    First the zone maps choose the blocks of a shard that a group must read, then these are read.
    """

    def choose(zones: pa.Table, group: pa.Table) -> pa.Table:
        out = []
        if zones.num_rows and group.num_rows:
            g, dims = group.slice(0, 1).to_pylist()[0], group["dims"][0].as_py()
            low, high = (_whole(b"".join(zones[c].to_pylist()), dims) if dims else np.zeros((zones.num_rows, 0), np.int64) for c in ("low", "high"))
            wanted = _Group(g).wants(low, high, np.asarray(zones["label"]), same).any(0)
            out = [(g["group"], b) for b in np.asarray(zones["block"])[wanted].tolist()]
        return pa.table({"group": pa.array([o[0] for o in out], pa.int32()), "block": pa.array([o[1] for o in out], pa.int64())})

    def read(chosen: pa.Table, group: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)] * 4
        if chosen.num_rows and group.num_rows:
            found = _found(_Group(group.slice(0, 1).to_pylist()[0]), chosen.to_pylist(), group["dims"][0].as_py(), k, same)
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("row", "window", "vec_id", "score"), found)})

    key = ["group", "dims", "shard"]
    everywhere = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    everywhere = everywhere.toDF(*everywhere.columns)  # columns of its own, for it meets tables made from `groups`
    zones = blocks.select("block", "shard", "dims", "label", "low", "high")
    asking = groups.select("group", "dims")
    zoned = zones.join(asking, "dims").groupBy(*key).cogroup(everywhere.groupBy(*key)).applyInArrow(choose, "group int, block long")
    wanted = stage(zoned, "wanted")
    held = blocks.select("block", "shard", "dims", "label", "ids", "vectors", "low", "high").join(wanted, "block")
    meets = stage(held.groupBy(*key).cogroup(everywhere.groupBy(*key)).applyInArrow(read, "row long, window long, vec_id long, score long"), "met")
    discard(wanted)
    return meets


def _first(met: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row", "window").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, anchors: Column, how: Mining = Mining(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Components x become floor(scale * x), cut at 2**24 either way; a score is their inner product. An
    anchor's positives are its first `positives` other rows of the same label; for each of them come the
    first `negatives` rows of other labels whose score is from `low` to `high` percent of the positive's.
    Higher scores come first, ties by smaller id, then by equal id in any order: such rows look alike.
    Rows with a null label or vector, or null or non-finite components, take no part, nor as anchors. Rows
    of different lengths do not meet; vectors without components all score 0. A null id sorts last. Each
    row counts, repeated or not: a row that repeats an anchor is an anchor, and a positive of it. Without
    anchors, positives or rows nothing comes out. Only the named columns are read.
    """
    usable = _usable(rows, anchors, how, id_col, vector_col, label_col)
    part = lambda f: F.aggregate("vector", F.lit(0.0), lambda s, x: s + f(x))
    n, values, total, squares = usable.agg(F.count("*"), F.sum("dims"), F.sum(part(lambda x: x)), F.sum(part(lambda x: x.cast("double") * x))).first()
    middle = (total or 0.0) / max(values or 0, 1)
    spread = max((squares or 0.0) / max(values or 0, 1) - middle**2, 1.0) ** 0.5
    keyed = stage(_with_keys(usable, middle, spread, how), "keyed")
    shards, order = max(how.shards, -(-n // how.shard_rows)), ["dims", "label", "key", "vec_id", "given"]
    blocks = stage(keyed.repartitionByRange(shards, *order).sortWithinPartitions(*order).mapInArrow(_cut(how), _BLOCK), "blocks")
    discard(keyed)
    shards = (blocks.agg(F.max("shard")).first()[0] or 0) + 1
    asked = stage(_numbered(_anchors(blocks), how), "anchors")

    floor = asked.select("*", F.array("floor").alias("lows"), F.array(F.lit(int(_NO_ID))).alias("highs"))
    groups = stage(_packed(floor), "groups")
    met = _search(groups, blocks, shards, how.positives, same=True)
    positives = stage(_first(met, how.positives).select("row", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    discard(groups, met)

    # whole numbers n with low * p <= 100 * n <= high * p
    down = lambda value: F.expr(f"({value} - pmod({value}, 100)) div 100")
    ends = positives.select("row", "place", (-down(f"{-how.low} * positive_score")).alias("l"), down(f"{how.high} * positive_score").alias("h"))
    windows = ends.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "l", "h"))).alias("w"))  # at most `positives` of them
    at = lambda c, k, none: F.coalesce(F.get(f"w.{c}", F.lit(k)), F.lit(none))
    lows, highs = (F.array(*[at(c, k, none) for k in range(how.positives)]).alias(name) for name, c, none in (("lows", "l", 1), ("highs", "h", 0)))
    groups = stage(_packed(asked.join(windows, "row").select("*", lows, highs)), "groups")
    met = _search(groups, blocks, shards, how.negatives, same=False)
    negatives = stage(_first(met, how.negatives), "negatives")
    discard(groups, met, blocks)
    named = lambda c: F.when(F.col(c) != int(_NO_ID), F.col(c)).alias(c)
    return (
        negatives.withColumn("place", (F.col("window") + 1).cast("int")).join(positives, ["row", "place"]).join(asked.select("row", "anchor_id"), "row")
        .select(named("anchor_id"), named("positive_id"), "rank", F.when(F.col("vec_id") != int(_NO_ID), F.col("vec_id")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )


def op13_zone_map_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh has the next label."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)
