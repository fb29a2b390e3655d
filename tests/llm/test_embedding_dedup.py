"""Near vectors against all cosines."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from homescore.llm import embedding_dedup as V
from homescore.llm.common import table
from homescore.llm.hnsw import Graph
from tests.llm.test_near_dedup import roots

SF = "/root/testdata/sf0.01"


def expected(rows):
    good = {}
    for k, v in rows:
        if v is not None and None not in v and np.isfinite(v).all() and any(v):
            good[k] = np.asarray(v, float) / np.linalg.norm(np.asarray(v, float))
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.95]
    count = {k: 0 for k, _ in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return count, roots(count, links)


def check(df, rows, how=V.Shards()):
    got = V.near_vectors(df, how).collect()
    count, component = expected(rows)
    assert len(got) == len(rows)
    assert {r.vec_id: r.component_id for r in got} == component
    assert {r.vec_id: r.n_links for r in got} == count
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_embeddings(spark):
    df = table(spark, SF, "embeddings")
    check(df, [(r.vec_id, r.embedding) for r in df.collect()], V.Shards(shards=3, block_rows=200))


def test_odd_vectors_and_a_large_cluster(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=8)
    rows = [(k, (centre + rng.normal(size=8) * 0.05).tolist()) for k in range(150)]
    rows += [(200 + k, [1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 0.0, 1.0]) for k in range(40)]
    inf, nan = float("inf"), float("nan")
    rows += [(300, None), (301, []), (302, [0.0] * 8), (303, [nan] + [1.0] * 7), (304, [1.0, None] + [1.0] * 6), (305, [inf] + [1.0] * 7), (306, [1.0, 2.0]), (307, [2.0, 4.0]), (308, [1e300] * 8), (309, [1e-300] * 8)]
    df = spark.createDataFrame([(k, v, "l", 1) for k, v in rows], "vec_id long, embedding array<double>, n_links string, h1 int")
    rows = [(k, [x * 1e-300 for x in v] if k == 308 else [x * 1e300 for x in v] if k == 309 else v) for k, v in rows]
    check(df, rows, V.Shards(shards=2, block_rows=64, beam=4))
    assert V.near_vectors(df.limit(0)).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(3000, 24))
    v[:1500] = v[1500:] + rng.normal(size=(1500, 24)) * 0.05
    v = v[rng.permutation(3000)]
    v /= np.linalg.norm(v, axis=1)[:, None]
    graph = Graph.from_bytes(Graph.build(v).to_bytes())
    best = np.argsort(-(v @ v.T), 1)[:, :5]
    ids, near = graph.search(v.astype(np.float32), 48)
    assert np.mean([len(set(a[:5]) & set(b)) / 5 for a, b in zip(ids, best)]) > 0.9
    assert (np.diff(near, axis=1) <= 0).all() and all(len(set(a)) == len(a) for a in ids)


def test_a_graph_moves_in_small_rows_and_the_rounds_of_its_shards_in_few(spark, monkeypatch):
    """No staged row holds a whole graph, long vectors make more shards, and floats stay floats."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(6000, 48)).astype(np.float32)
    v[:40] = v[40] + rng.normal(size=(40, 48)).astype(np.float32) * 0.05
    rows = [(k, x.tolist()) for k, x in enumerate(v)]
    staged = {}

    def spy(df, name, stage=V.stage):
        out = stage(df, name)
        binary = [F.max(F.octet_length(c)) for c, kind in out.dtypes if kind == "binary"]
        staged.setdefault(name, []).append(max([x or 0 for x in out.agg(*binary).first()]) if binary else 0)
        if name == "graphs":
            staged["shards"] = out.select("dims", "shard").distinct().count()
        if name == "vectors":
            staged["kind"] = dict(out.dtypes)["vector"]
        return out

    monkeypatch.setattr(V, "stage", spy)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in V.near_vectors(df, V.Shards(shards=1, block_rows=4096)).collect()}
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    links = unit.astype(float) @ unit.T.astype(float) >= 0.95
    assert [got[k][0] for k in range(len(v))] == (links.sum(1) - 1).tolist()
    assert {got[k][1] for k in range(41)} == {0} and all(got[k][1] == k for k in range(41, len(v)))
    assert max(staged["graphs"]) <= 1 << 20 and staged["shards"] == 1 and staged["kind"] == "array<float>"
    again = V.near_vectors(df, V.Shards(shards=1, block_rows=4096, shard_values=6000 * 48 // 4)).collect()
    assert staged["shards"] == 4 and {r.vec_id: (r.n_links, r.component_id) for r in again} == got


def test_memory_of_a_shard_that_is_one_cluster():
    """Links of a cluster leave in bounded parts, not as the square of its size, and small groups beside it are found."""
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.normal(size=16) + rng.normal(size=(4000, 16)) * 0.05, np.repeat(rng.normal(size=(100, 16)), 2, 0) + rng.normal(size=(200, 16)) * 0.02])
    part, v = np.arange(3000, 4200), v[order := rng.permutation(len(v))]  # as hashes order them
    part, node = np.argsort(order)[part], rng.permutation(len(v)).astype(np.int64)
    n = len(part)
    built = V._build(iter([pa.RecordBatch.from_pydict({"dims": pa.array([16] * len(v), pa.int32()), "shard": pa.array([0] * len(v), pa.int32()), "node": node, "copies": np.ones(len(v), np.int64), "vector": v.tolist()})]))
    graph = [pa.record_batch({"dims": b["dims"], "shard": b["shard"], "lot": b["shard"], "part": b["part"], "node": pa.array([0], pa.int64()), "vector": pa.array([None], pa.list_(pa.float64())), "data": b["data"]}) for b in built]
    asked = pa.record_batch({"dims": pa.array([16] * n, pa.int32()), "shard": pa.array([0] * n, pa.int32()), "lot": pa.array([0] * n, pa.int32()), "part": pa.array([2] * n, pa.int32()), "node": node[part], "vector": pa.array(v[part].tolist()), "data": pa.array([None] * n, pa.binary())})
    tracemalloc.start()
    met = pa.Table.from_batches(V._search(V.Shards(beam=64))(iter([*graph, asked])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    count = (unit[part] @ unit.T >= 0.95).sum(1) - 1
    kind, a, b = (np.asarray(met[c]) for c in ("kind", "a", "b"))
    assert dict(zip(a[kind == 0].tolist(), b[kind == 0].tolist())) == {int(x): int(c) for x, c in zip(node[part], count) if c}
    assert count[:1000].min() > 3000 and (kind == 1).sum() < 2 * n + len(v)
    assert peak < 80e6  # the pairs alone are 64 MB, and were held several times over
