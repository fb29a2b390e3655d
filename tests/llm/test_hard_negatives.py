"""Hard negatives against all scores in plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from homescore.llm import hard_negatives as H

SMALL = H.Mining(block_rows=8, shard_rows=64, shards=3, group_anchors=4)


def wanted(rows, anchor, how=H.Mining()):
    cut = 2.0**24
    v = []
    for i, x, label in rows:
        if label is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            v.append((i, [math.floor(max(-cut, min(cut, how.scale * c))) for c in x], label))
    last = lambda i: (i is None, i or 0)
    out = []
    for a, (i, x, label) in enumerate(v):
        if i is None or not anchor(i):
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), last(j), j, lab == label) for b, (j, y, lab) in enumerate(v) if b != a and len(y) == len(x)]
        scored.sort(key=lambda t: t[:2])
        for p, _, positive, _ in [s for s in scored if s[3]][: how.positives]:
            inside = [s for s in scored if not s[3] and how.low * -p <= 100 * -s[0] <= how.high * -p][: how.negatives]
            out += [(i, positive, k + 1, s[2], -p, -s[0]) for k, s in enumerate(inside)]
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, x, y, "b", "g") for i, x, y in rows], "vec_id long, embedding array<double>, label int, block string, group string").repartition(3)


def mined(spark, rows, how=SMALL, every=10):
    df = H.hard_negatives(frame(spark, rows), F.col("vec_id") % every == 0, how)
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def clustered(n, dims, seed):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    return [(k, [c + rng.gauss(0, 0.3) for c in centres[k % 6]], rng.randrange(4)) for k in range(n)]


def test_like_all_scores(spark):
    rows = clustered(400, 5, 1)
    assert mined(spark, rows) == wanted(rows, lambda i: i % 10 == 0)


def test_odd_rows(spark):
    """Nulls, other lengths, no components, huge components, ties, repeated rows and a hot vector."""
    rows = clustered(120, 3, 2) + [(1000 + k, [0.5, 0.5, 0.25], k % 3) for k in range(90)]
    rows += [(10, [0.5, 0.5, 0.25], 1), (10, [0.5, 0.5, 0.25], 1), (None, [0.5, 0.5, 0.25], 2), (None, [0.4, 0.5, 0.25], 1)]
    rows += [(20, None, 1), (30, [1.0, None, 2.0], 1), (40, [math.nan, 1.0, 1.0], 1), (50, [math.inf, 0.0, 0.0], 1), (60, [0.1, 0.2, 0.3], None)]
    rows += [(70 + k, [float(k)], k % 2) for k in range(30)] + [(500 + k, [], k % 2) for k in range(12)]
    rows += [(200, [1e300, -1e300, 3.0], 1), (210, [1e300, 1e200, 0.0], 2), (220, [7e4, 6e4, -1.0], 1), (230, [-1e300, 0.0, 0.0], 3)]
    assert mined(spark, rows) == wanted(rows, lambda i: i % 10 == 0)


def test_few_rows_and_empty_tables(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (2, [0.5, 0.0], 2)]
    assert mined(spark, rows) == wanted(rows, lambda i: i % 10 == 0) == [(0, 1, 1, 2, 65536, 32768)]
    assert mined(spark, rows[1:]) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 2)]) == []
    assert H.hard_negatives(frame(spark, rows).limit(0), F.lit(True), SMALL).count() == 0


def test_curve_has_no_jumps():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        keys = [k.tobytes() for k in H.hilbert_keys(cells, bits)]
        assert len(set(keys)) == len(cells)
        path = cells[sorted(range(len(cells)), key=keys.__getitem__)]
        assert (np.abs(np.diff(path.astype(int), axis=0)).sum(1) == 1).all()


def test_bounds_hold_all_scores():
    rng = np.random.default_rng(3)
    x, y = rng.integers(-300, 300, (20, 7)), rng.integers(-300, 300, (50, 7))
    least, most = H.bounds(x, y.min(0)[None], y.max(0)[None])
    scores = H.products(x, y)
    assert (scores >= least).all() and (scores <= most).all()
    big = np.array([[1 << 24, -(1 << 24), 3]])
    assert H.products(big, big).tolist() == [[2 * (1 << 48) + 9]]


def test_zone_maps_leave_blocks_unread():
    """Of clusters far apart, an anchor's windows want few blocks."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 200, (40, 8))
    boxes = [np.floor(c + rng.normal(0, 5, (64, 8))).astype(np.int64) for c in centres]
    low, high = np.stack([b.min(0) for b in boxes]), np.stack([b.max(0) for b in boxes])
    best = int(H.products(boxes[0][:1], boxes[0]).max())
    group = {"rows": np.array([0]), "labels": np.array([1]), "vectors": boxes[0][:1], "lows": np.array([[best * 9 // 10]]), "highs": np.array([[best]])}
    packed = {k: v.astype("<i4" if k == "vectors" else "<i8").tobytes() for k, v in group.items()} | {"dims": 8}
    wanted_ = H._Group(packed).wants(low, high, np.ones(40, int), True)
    assert wanted_[0, 0] and wanted_.sum() <= 4


@pytest.mark.parametrize("blocks", [2, 300])
def test_block_size_does_not_matter(spark, blocks):
    rows = clustered(150, 4, 7)
    assert mined(spark, rows, H.Mining(block_rows=blocks, shards=2)) == wanted(rows, lambda i: i % 10 == 0)
