"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document's set is that of its five-word shingles. Equal sets are one class from the start. Every
class stands in `TREES` sorted orders, each by a signature of `DEPTH` minima of its own. Neighbours in
an order share the longest prefixes there are, so how deep two documents must agree adapts to how
crowded their region is: in a sparse one all meet, in a crowded one each meets its nearest.
Candidates of all orders are confirmed on the full sets. Crowded regions are finished by an
exact join on rare shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homescore.llm.common import discard, mix, row_key, span_hashes, stage, table, window_hashes, word_spans
from homescore.llm.components import components

_BATCH_BYTES = 1_000_000
#: Which member of a component stands for it: the smallest id, a null one last, then the smallest key.
_ORDER = "named_struct('no_id', doc_id is null, 'id', coalesce(doc_id, 0), 'k1', k1, 'k2', k2)"
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[65:91] += 32


@dataclass(frozen=True)
class Forest:
    """Share of the union in percent that links; orders, minima in each, agreeing ones a candidate needs,
    and neighbours that all meet each other in a region. Where more classes than these agree, each first
    meets its nearest, then those of different components are joined on their shingles."""

    percent: int = 85
    shingle: int = 5
    trees: int = 16
    depth: int = 8
    least: int = 3
    reach: int = 8
    seed: int = 5


def shingle_sets(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, one text after another, and where each text's begin and end."""
    raws = [(t or "").encode("utf-8", "replace") + b" " for t in texts]
    raw = _UPPER[np.frombuffer(b"".join(raws), np.uint8)]
    starts, ends = word_spans(raw)
    words = span_hashes(raw, starts, ends)
    owner = np.searchsorted(np.cumsum([len(r) for r in raws]), starts, "right")
    count = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(count) - count
    hashes, of = window_hashes(words, size, 0x9E6C63D0876A9A47), owner[: max(len(words) - size + 1, 0)]
    inside = of == owner[size - 1 :] if len(of) else np.zeros(0, bool)
    hashes, of = hashes[inside], of[inside]
    short = np.flatnonzero((count > 0) & (count < size))
    alone = [mix(window_hashes(words[first[k] : first[k] + count[k]], count[k], 0x9E6C63D0876A9A47) + np.uint64(count[k])) for k in short]
    hashes, of = np.concatenate([hashes, *alone]), np.concatenate([of, short])
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    return hashes[new], np.searchsorted(of[new], np.arange(len(texts) + 1))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return (total[at[1:]] - total[at[:-1]]).view(np.int64)


def signatures(hashes: np.ndarray, at: np.ndarray, n: int, seed: int) -> np.ndarray:
    """n minima of each non-empty set, as big-endian bytes so that they sort as text does."""
    rng = np.random.default_rng(seed)
    turns, factors = rng.integers(0, 1 << 32, n, dtype=np.uint32), rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    starts = at[:-1][np.diff(at) > 0]
    out = np.zeros((len(starts), n), ">u4")
    if len(starts):
        for k in range(n):
            x = (low ^ turns[k]) * factors[k]
            x ^= x >> np.uint32(15)
            out[:, k] = np.minimum.reduceat(x * factors[k], starts)
    return out


def _slices(texts: list[str | None]) -> Iterator[slice]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size < _BATCH_BYTES or end == at):
            size += len(texts[end] or "")
            end += 1
        yield slice(at, end)
        at = end


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    doc_id, text = docs[id_col].cast("long"), docs[text_col].cast("string")
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), *row_key(doc_id, text))


def _signed_rows(keyed: DataFrame, how: Forest) -> DataFrame:
    """doc_id, key, size and hash of the set, and signature (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "k1", "k2", "n", "h1", "h2", "signature"]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in _slices(texts):
                hashes, at = shingle_sets(texts[part], how.shingle)
                sizes = np.diff(at)
                rows = iter(signatures(hashes, at, how.trees * how.depth, how.seed))
                signed = [next(rows).tobytes() if n else None for n in sizes]
                given = [batch.column(k).slice(part.start, part.stop - part.start) for k in (0, 2, 3)]
                made = [sizes, _sums(mix(hashes), at), _sums(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), at)]
                yield pa.RecordBatch.from_arrays([*given, *[pa.array(x) for x in made], pa.array(signed, pa.binary())], names=names)

    return keyed.mapInArrow(run, "doc_id long, k1 long, k2 long, n long, h1 long, h2 long, signature binary")


def _neighbours(rows: DataFrame, how: Forest) -> DataFrame:
    """Pairs of nodes near each other in an order; written.

    `rows`: tree, key, node. The orders are one total order, dealt out by range, so a
    crowded region is dealt out too. Rows of a region agree in the first `least` minima. The first
    `reach` + 1 rows of a region all meet, so those of a region that has no more have met each other;
    each row after them meets the nearest before it. The ends of every part meet across parts.
    """
    need, reach, word = how.least * 4, how.reach, "tree int, key binary, node long"

    def met(row: tuple, before: list[tuple]) -> list[tuple]:
        return [(min(row[2], o[2]), max(row[2], o[2])) for o in before if o[0] == row[0] and o[1][:need] == row[1][:need] and o[2] != row[2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, head, seen, place = TaskContext.get().partitionId(), [], [], 0, 0
        for batch in batches:
            pairs = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if before and (before[-1][0] != row[0] or before[-1][1][:need] != row[1][:need]):
                    before.clear()
                    place = 0
                pairs += met(row, before) if place <= reach else met(row, before)[-1:]
                place += 1
                before.append(row)
                del before[:-reach]
                if seen < reach:
                    head.append(row)
                seen += 1
            yield _pairs_batch(pairs, None, None)
        yield _pairs_batch([], part, [(0, *r) for r in head] + [(1, *r) for r in before])

    rows = rows.select("tree", "key", "node")
    made = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    found = stage(made.mapInArrow(run, f"a long, b long, part int, tail int, {word}"), "near")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_ = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        rows_.sort(key=lambda r: (r[2], r[3], r[4], r[0]))
        pairs, before = [], []
        for part, tail, *row in rows_:
            row = tuple(row)
            if not tail:
                pairs += met(row, [o[:3] for o in before if o[3] != part])
            before.append((*row, part))
            del before[: -2 * reach]
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    # at most 2 * reach rows a part, whatever the corpus
    edges = found.where("part is not null").select("part", "tail", "tree", "key", "node").repartition(1).mapInArrow(across, "a long, b long")
    pairs = stage(found.where("part is null").select("a", "b").union(edges).distinct(), "pairs")
    discard(found)
    return pairs


def _pairs_batch(pairs: list[tuple], part: int | None, ends: list[tuple] | None) -> pa.RecordBatch:
    ends = ends or []
    n, m = len(pairs), len(ends)
    columns = [
        pa.array([p[0] for p in pairs] + [None] * m, pa.int64()),
        pa.array([p[1] for p in pairs] + [None] * m, pa.int64()),
        pa.array([None] * n + [part] * m, pa.int32()),
        pa.array([None] * n + [e[0] for e in ends], pa.int32()),
        pa.array([None] * n + [e[1] for e in ends], pa.int32()),
        pa.array([None] * n + [e[2] for e in ends], pa.binary()),
        pa.array([None] * n + [e[3] for e in ends], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "part", "tail", "tree", "key", "node"])


def _sets(keyed: DataFrame, wanted: DataFrame, how: Forest) -> DataFrame:
    """node and sorted shingles of the wanted classes (k1, k2, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for part in _slices(texts):
                hashes, at = shingle_sets(texts[part], how.shingle)
                sets = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(part.start, part.stop - part.start), sets], names=["node", "shingles"])

    return keyed.join(wanted, ["k1", "k2"]).select("text", "node").mapInArrow(run, "node long, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, how: Forest) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= how.percent * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y")
    return joined.mapInArrow(run, "a long, b long")


def _regions(rows: DataFrame, how: Forest) -> DataFrame:
    return rows.withColumn("region", F.expr(f"substring(key, 1, {4 * how.least})"))


def _dense(orders: DataFrame, how: Forest) -> DataFrame:
    """Rows of `orders` in regions of more classes than all meet."""
    rows = _regions(orders, how)
    full = rows.groupBy("tree", "region").agg(F.count("*").alias("n")).where(F.col("n") > how.reach + 1)
    return rows.join(full.select("tree", "region"), ["tree", "region"]).select("tree", "key", "node")


def _crowd(dense: DataFrame, found: DataFrame, how: Forest) -> DataFrame:
    """node and component of the classes in dense regions; those all of one component need no link."""
    rows = _regions(dense, how).join(found, "node").select("tree", "region", "node", "component")
    sides = rows.groupBy("tree", "region").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return rows.join(sides.where("low < high").select("tree", "region"), ["tree", "region"]).select("node", "component").distinct()


def _sharing(sets: DataFrame, crowd: DataFrame, how: Forest) -> DataFrame:
    """All pairs of `crowd` of different components that can link, got by an exact join.

    All sets stand in one order, shingles that fewest of the crowd have first. A first shared shingle too
    late in either set leaves too few to share, so only those early enough meet, each with its place.
    The smaller set of a pair must share more of itself, and so needs to show fewer.
    """
    p = how.percent
    each = sets.join(crowd, "node").select("node", "component", F.explode("shingles").alias("shingle"))
    # a shingle that one component alone holds leads to no pair, be its members ever so many
    held = each.groupBy("shingle").agg(F.count("*").alias("held"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").drop("low", "high")
    one = F.struct(F.coalesce("held", F.lit(1)).alias("held"), "shingle")
    ranked = each.join(held, "shingle", "left").groupBy("node", "component").agg(F.sort_array(F.collect_list(one)).alias("row"))
    sized = stage(ranked.select("node", "component", F.size("row").cast("long").alias("n"), "row"), "ranked")

    def shown(least: str, x: str) -> DataFrame:
        early = sized.select("node", "component", "n", F.posexplode(F.expr(f"slice(row, 1, cast(n - {least} + 1 as int))")).alias("i", "at"))
        return early.where("at.held > 1").selectExpr("at.shingle", f"node {x}", f"component {x}_component", f"n {x}_n", f"n - i {x}_left")

    small = shown(f"(2 * {p} * n + {99 + p}) div {100 + p}", "s")
    large = shown(f"({p} * n + 99) div 100", "l")
    fits = f"s_component <> l_component and (s_n < l_n or s_n = l_n and s < l) and {100 + p} * least(s_left, l_left) >= {p} * (s_n + l_n)"
    return small.join(large, "shingle").where(fits).selectExpr("least(s, l) a", "greatest(s, l) b").distinct()


def _links(keyed: DataFrame, classes: DataFrame, how: Forest) -> DataFrame:
    """Confirmed links between classes, enough to join all that agree in the first minima of an order.

    Every class first meets its neighbours, all there are where a region is sparse. In dense regions the
    nearest of each order join most that link; an exact join finds every link between the components
    that are left.
    """
    width = 4 * how.depth
    key = F.expr(f"substring(signature, tree * {width} + 1, {width})")
    trees = classes.select("node", "signature", F.explode(F.sequence(F.lit(0), F.lit(how.trees - 1))).alias("tree"))
    orders = trees.select("tree", key.alias("key"), "node")
    tried = _neighbours(orders, how)
    # A class that no other came near in any order has a region of its own in all of them; the sets of
    # the others are read once.
    ends = tried.select(F.col("a").alias("node")).union(tried.select(F.col("b").alias("node")))
    met = stage(ends.distinct(), "ends")
    sets = stage(_sets(keyed, classes.select("k1", "k2", "node").join(met, "node"), how).dropDuplicates(["node"]), "sets")
    links = stage(_confirmed(tried, sets, how), "links")
    dense = stage(_dense(orders.join(met, "node"), how), "dense")
    if not dense.isEmpty():
        found = stage(components(links), "found")
        joined = dense.select("node").distinct().join(found, "node", "left")
        crowd = stage(_crowd(dense, joined.select("node", F.coalesce("component", "node").alias("component")), how), "crowd")
        rest = stage(_sharing(sets, crowd, how).join(tried, ["a", "b"], "left_anti"), "rest")
        links = links.union(stage(_confirmed(rest, sets, how), "links"))
        discard(crowd, found)
    discard(sets, dense)
    return links


def near_duplicates(docs: DataFrame, how: Forest = Forest(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; also the row's key (k1, k2) and `first`.

    Documents link where 100 * |A and B| >= percent * |A or B|; component_id is the smallest doc_id
    that links lead to. A text of fewer words than a shingle is one shingle; texts without words link
    with nothing, each its own component. Rows with equal sets link, be they repeated rows or not. A null
    doc_id comes after all others: a component has a null id only if no member has another, and all its
    members are then `kept`. `first` marks the member that stands for its component: the one with the
    smallest doc_id, of several such one text's rows. An empty table gives no rows. Sets and classes
    compare by hashes of 64 bits a shingle and 128 bits a set, rows by 128 bits of id and text. Only the
    named columns are read.
    """
    keyed = _keyed(docs, id_col, text_col)
    signed = stage(_signed_rows(keyed, how), "signed")
    grouped = signed.where("n > 0").groupBy("h1", "h2").agg(
        F.min(F.struct("k1", "k2")).alias("at"), F.first("signature").alias("signature"), F.min(F.expr(_ORDER)).alias("least")
    )
    classes = stage(grouped.select("h1", "h2", "at.*", "signature", "least", F.monotonically_increasing_id().alias("node")), "classes")
    found = stage(components(_links(keyed, classes, how)), "components")
    placed = classes.select("h1", "h2", "least", "node").join(found, "node", "left").withColumn("root", F.coalesce("component", "node"))
    least = placed.groupBy("root").agg(F.min("least").alias("least_of_all"))
    named = placed.join(least, "root").select("h1", "h2", "least_of_all")
    rows = signed.select("doc_id", "k1", "k2", F.col("n").alias("n_shingles"), F.expr(_ORDER).alias("order"), *[F.when(F.col("n") > 0, F.col(h)).alias(h) for h in ("h1", "h2")])
    wordless = F.col("least_of_all").isNull()
    one = F.when(wordless, F.col("doc_id")).otherwise(F.when(~F.col("least_of_all.no_id"), F.col("least_of_all.id")))
    return rows.join(named, ["h1", "h2"], "left").select(
        "doc_id", "n_shingles", one.alias("component_id"), F.col("doc_id").eqNullSafe(one).alias("kept"), "k1", "k2",
        (wordless | (F.col("order") == F.col("least_of_all"))).alias("first"),
    )


def drop_near_duplicates(docs: DataFrame, how: Forest = Forest()) -> DataFrame:
    """`docs` with one row of each component: that of the smallest doc_id, a null one last; of rows that repeat
    both id and text, one. Rows without words all stay. Columns stay as they are, whatever they are called;
    an empty table stays empty."""
    found = stage(near_duplicates(docs, how).select("k1", "k2", "n_shingles", "first"), "found")
    given = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("given"), *row_key(docs["doc_id"].cast("long"), docs["text"].cast("string")))
    left = given.join(found.where("not first").select("k1", "k2"), ["k1", "k2"], "left_anti")
    again = found.where("first and n_shingles > 0").groupBy("k1", "k2").agg(F.count("*").alias("times")).where("times > 1").select("k1", "k2")
    if again.limit(1).count():
        left = left.join(again, ["k1", "k2"], "left_anti").union(left.join(again, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]))
    return left.select("given.*")


def op2_lsh_forest_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("k1", "k2", "first")
