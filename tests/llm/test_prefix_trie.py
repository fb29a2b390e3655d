"""The trie of conversations against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from homescore.llm import prefix_trie as P
from homescore.llm.common import stage

MANY = P.Tour(task_rows=20, tasks=5, one_task=0, chunk=12)
FEW = P.Tour(task_rows=50, tasks=2)
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def in_order(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    return {c: [(t[2], t[4]) for t in sorted(x)] for c, x in own.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20 if c >= 0 else c + -c % 20, [])[:h] + turns[h:]
    return out


def trie(convs):
    nodes = {}
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            nodes.setdefault(tuple(convs[c][:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        children = [k for k in nodes if len(k) == len(key) + 1 and k[:-1] == key]
        under = [k for k in nodes if k[: len(key)] == key]
        leaves = sum(not any(len(q) == len(k) + 1 and q[:-1] == k for q in nodes) for k in under)
        saved = sum((len(nodes[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) for k in under if k)
        ends = ",".join(str(c) for c in members if len(convs[c]) == len(key))
        parent = nodes[key[:-1]][0] if key else None
        out.append((members[0], len(key), parent, len(members), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def made(n, seed):
    """Conversations that share turns, a hot one, a long one, ties, nulls and repeated rows."""
    rng = random.Random(seed)
    texts = ["a b", "a  b c", "", None, "\u00e9\tx", "long " * 30]
    rows = []
    for c in range(n):
        key = rng.choice([c, 40, 47, c])
        pick = random.Random(key)
        rows += [(c, k if k != 2 else None, pick.choice(["user", "bot", None]), pick.choice(texts)) for k in range(pick.randrange(7))]
    rows += [(n + 3, k // 2, "user", f"t{k % 5}") for k in range(90)]
    rows += [(61, 1, "user", "same")] * 3 + [(62, None, "b", "y"), (62, None, "a", "x"), (62, None, "a", "w"), (None, 1, "user", "no id"), (-7, 0, "user", "a b"), (-40, 1, "u", "z")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, node string, place string").repartition(3)


def got(spark, rows, how):
    turns = stage(P.numbered_turns(frame(spark, rows), how), "turns")
    again, convs = P.with_borrowed_heads(turns)
    df = P.prefix_trie(stage(again, "rebuilt"), stage(convs, "convs"), how)
    assert df.columns == [*NAMES, "tour_at"]
    return df


@pytest.mark.parametrize("how", [MANY, FEW], ids=["many tasks, pointer jumping", "one task ranks"])
def test_like_plain_python(spark, how):
    rows = made(70, 3)
    df = got(spark, rows, how)
    assert sorted((tuple(r[:8]) for r in df.collect()), key=repr) == trie(rebuilt(in_order(rows)))


def test_tour_walks_the_tree(spark):
    """Places of the arcs into nodes: a node's subtree follows it, children by their smallest conversation."""
    rows = made(50, 5)
    nodes = {(r.depth, r.conv_id): r for r in got(spark, rows, MANY).collect()}
    at, wanted = 0, {}

    def walk(key):
        nonlocal at
        wanted[key] = at
        at += 1
        for child in sorted(k for k, r in nodes.items() if k[0] == key[0] + 1 and r.parent_conv_id == key[1]):
            walk(child)
        at += 1

    walk(next(k for k in nodes if k[0] == 0))
    assert at == 2 * len(nodes)
    assert {k: r.tour_at for k, r in nodes.items()} == wanted


def test_turns_are_numbered_across_tasks(spark):
    """A conversation that fills several tasks is numbered on."""
    rows = [(5, k, "user", f"t{k}") for k in range(200)] + [(k, 0, "user", "x") for k in (1, 4, 6, 9)]
    got_ = P.numbered_turns(frame(spark, rows), P.Tour(task_rows=10)).where("conv = 5").select("place", "h1").collect()
    h = {r.h1: r.k for r in spark.range(200).select(F.col("id").alias("k"), F.xxhash64(F.lit("user"), F.concat(F.lit("t"), F.col("id").cast("string"))).alias("h1")).collect()}
    assert sorted(r.place for r in got_) == list(range(1, 201))
    assert all(h[r.h1] == r.place - 1 for r in got_)


def test_turnless_and_empty(spark):
    """A conversation that loses all turns is a member of the root; no conversations give no rows."""
    c = next(k for k in range(21, 40) if zlib.crc32(str(k).encode()) % 4 == 3)
    rows = [(c, 0, "user", "gone"), (c, 1, "bot", "gone too")]
    assert [tuple(r[:8]) for r in got(spark, rows, FEW).collect()] == trie({c: []})
    assert got(spark, [(None, 1, "a", "b")], MANY).count() == 0


def test_all_alike(spark):
    """Many conversations of the same turns: one chain of nodes, all ids in one digest."""
    rows = [(c, k, "user", f"t {k}") for c in range(300) for k in range(5)]
    df = got(spark, rows, MANY)
    assert sorted((tuple(r[:8]) for r in df.collect()), key=repr) == trie(rebuilt(in_order(rows)))


def test_pointer_sums():
    rng = np.random.default_rng(1)
    order = rng.permutation(100)
    then = np.full(100, -1)
    then[order[:-1]] = order[1:]
    weights = rng.integers(0, 9, 100)
    end, sums = P._doubled(then, weights)
    assert (end == order[-1]).all()
    assert (sums[order] == weights[order][::-1].cumsum()[::-1]).all()
