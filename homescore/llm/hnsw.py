"""Hierarchical navigable small-world graph over unit vectors, many searches at once in numpy."""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np

LINKS = 16  # a node's links on upper layers; twice as many on the lowest
BUILD_BEAM = 48
_TOGETHER = 256
_EXPAND = 4
_PAIRS = 1024  # so many products of pairs stay in the processor's cache
_EMPTY = np.int64(np.iinfo(np.int64).max)


def _keys(near: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Cosine and node in one number, the best least; the last bit is set once the node is expanded."""
    bits = near.view(np.int32)
    return (np.invert(bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))).astype(np.int64) << 32) | (ids.astype(np.int64) << 1)


def _cosines(keys: np.ndarray) -> np.ndarray:
    bits = np.invert((keys >> 32).astype(np.int32))
    return (bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))).view(np.float32)


def _products(queries: np.ndarray, row: np.ndarray, vectors: np.ndarray, node: np.ndarray) -> np.ndarray:
    out = np.empty(len(row), np.float32)
    for at in range(0, len(row), _PAIRS):
        part = slice(at, at + _PAIRS)
        np.einsum("kd,kd->k", queries.take(row[part], axis=0), vectors.take(node[part], axis=0), out=out[part])
    return out


def search_layer(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of every query from its entry node; the `beam` best nodes met and their cosines.

    Rows run from best to worst; -1 fills what was not reached. All queries expand up to four nodes a step.
    """
    q, bits = len(queries), max(1, (len(vectors) - 1).bit_length())
    seen = np.zeros(q << bits, bool)
    seen[(np.arange(q) << bits) | entries] = True
    keys = np.full((q, beam), _EMPTY)
    keys[:, 0] = _keys(np.einsum("qd,qd->q", queries, vectors[entries]), entries)
    active, now, at = np.arange(q), keys.copy(), np.arange(q)
    while True:
        open_ = (now & 1) == 0
        left = open_.any(1)
        if not left.all():
            keys[active[~left]] = now[~left]
            active, now, open_ = active[left], now[left], open_[left]
            if not len(active):
                break
            at[active] = np.arange(len(active))
        if beam > _EXPAND:
            open_ &= np.cumsum(open_, 1, dtype=np.int32) <= _EXPAND
        flat, pick = now.ravel(), np.flatnonzero(open_)
        around = links.take((flat[pick] & 0xFFFFFFFF) >> 1, axis=0)
        flat[pick] |= 1
        place = ((active[pick // beam] << bits)[:, None] | around)[around >= 0]
        place = place[~seen.take(place)]
        if not len(place):
            continue
        place.sort()
        place = place[np.concatenate([[True], place[1:] != place[:-1]])]
        seen[place] = True
        row, node = place >> bits, place & ((1 << bits) - 1)
        fresh = _keys(_products(queries, row, vectors, node), node)
        row = at[row]
        better = fresh < now[row, -1]
        row, fresh = row[better], fresh[better]
        if len(row):
            count = np.bincount(row, minlength=len(active))
            both = np.full((len(active), beam + count.max()), _EMPTY)
            both[:, :beam] = now
            both[row, beam + np.arange(len(row)) - (np.cumsum(count) - count)[row]] = fresh
            both.sort(1)
            now = np.ascontiguousarray(both[:, :beam])
    ids = np.where(keys == _EMPTY, -1, (keys & 0xFFFFFFFF) >> 1)
    return ids, np.where(ids < 0, np.float32(-np.inf), _cosines(keys))


def choose(vectors: np.ndarray, own: np.ndarray, ids: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Links of each node among its candidates (best first): those nearer to it than to any chosen, then the nearest."""
    n, c = ids.shape
    found = vectors[ids]
    among = found @ found.transpose(0, 2, 1)
    good = (ids >= 0) & (ids != own[:, None])
    chosen = np.zeros((n, c), bool)
    for k in range(c):
        clear = ~((among[:, k, :] > near[:, k, None]) & chosen).any(1)
        chosen[:, k] = good[:, k] & clear & (chosen.sum(1) < most)
    rank = np.where(chosen, 0, np.where(good, 1, 2))
    order = np.argsort(rank, 1, kind="stable")[:, :most]
    return np.where(np.take_along_axis(rank, order, 1) < 2, np.take_along_axis(ids, order, 1), -1)


def _padded(ids: np.ndarray, width: int) -> np.ndarray:
    return np.pad(ids, ((0, 0), (0, max(0, width - ids.shape[1]))), constant_values=-1)[:, :width]


def _insert(vectors: np.ndarray, links: np.ndarray, new: np.ndarray, ids: np.ndarray) -> None:
    """Join new nodes to candidates, and the candidates back to them."""
    width = links.shape[1]
    near = np.where(ids >= 0, np.einsum("nd,ncd->nc", vectors[new], vectors[ids]), -np.inf)
    order = np.argsort(-near, 1, kind="stable")
    ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
    chosen = choose(vectors, new, ids, near, width // 2)
    links[new] = _padded(chosen, width)
    source = np.repeat(new, chosen.shape[1])[chosen.ravel() >= 0]
    target = chosen.ravel()[chosen.ravel() >= 0]
    order = np.lexsort((-np.einsum("nd,nd->n", vectors[source], vectors[target]), target))
    source, target = source[order], target[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    for part in np.array_split(np.arange(len(nodes)), len(nodes) // _TOGETHER + 1):
        if not len(part):
            continue
        own, most = nodes[part], int(min(count[part].max(), width))
        place = first[part][:, None] + np.arange(most)
        back = np.where(np.arange(most) < count[part][:, None], source[np.minimum(place, len(source) - 1)], -1)
        back = np.where((back[:, :, None] == links[own][:, None, :]).any(2), -1, back)
        both = np.concatenate([links[own], back], 1)
        close = np.where(both >= 0, np.einsum("nd,ncd->nc", vectors[own], vectors[both]), -np.inf)
        order = np.argsort(-close, 1, kind="stable")
        both, close = np.take_along_axis(both, order, 1), np.take_along_axis(close, order, 1)
        full = (both >= 0).sum(1) > width
        links[own] = both[:, :width]
        if full.any():
            links[own[full]] = _padded(choose(vectors, own[full], both[full], close[full], width), width)


@dataclass
class Graph:
    """Unit vectors in insertion order; layers from the lowest up, each over a leading run of the nodes."""

    vectors: np.ndarray
    layers: list[np.ndarray]

    @classmethod
    def build(cls, vectors: np.ndarray) -> Graph:
        """Every sixteenth node of a layer, the first ones inserted, also stands on the layer above."""
        vectors = np.ascontiguousarray(vectors, np.float32)
        sizes = [len(vectors)]
        while sizes[-1] > LINKS:
            sizes.append(-(-sizes[-1] // LINKS))
        graph = cls(vectors, [np.full((n, LINKS * (2 if k == 0 else 1)), -1, np.int32) for k, n in enumerate(sizes)])
        at = 1
        while at < len(vectors):
            new = np.arange(at, min(len(vectors), at + max(1, min(_TOGETHER, at // 2))))
            entries = np.zeros(len(new), np.int64)
            for level in range(len(sizes) - 1, -1, -1):
                links = graph.layers[level]
                mine = new[new < sizes[level]]
                ids, _ = search_layer(vectors[: new[0]] if new[0] < sizes[level] else vectors[: sizes[level]], links[: new[0]], vectors[new], entries, BUILD_BEAM if len(mine) else 1)
                if len(mine):
                    peers = vectors[mine] @ vectors[mine].T
                    np.fill_diagonal(peers, -np.inf)
                    order = np.argsort(-peers, 1, kind="stable")[:, :LINKS]
                    other = np.where(np.take_along_axis(peers, order, 1) > -np.inf, mine[order], -1)
                    _insert(vectors[: sizes[level]], links, mine, np.concatenate([ids[: len(mine)], other], 1))
                entries = ids[:, 0]
            at = int(new[-1]) + 1
        return graph

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        entries = np.zeros(len(queries), np.int64)
        for links in self.layers[:0:-1]:
            entries = search_layer(self.vectors[: len(links)], links, queries, entries, 1)[0][:, 0]
        return search_layer(self.vectors, self.layers[0], queries, entries, min(beam, len(self.vectors)))

    def to_bytes(self, with_vectors: bool = True) -> bytes:
        out = io.BytesIO()
        np.savez(out, **({"vectors": self.vectors} if with_vectors else {}), **{f"layer{k}": x for k, x in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes, vectors: np.ndarray | None = None) -> Graph:
        """`vectors`: those of the graph, if its bytes are without."""
        held = np.load(io.BytesIO(data))
        layers = [held[f"layer{k}"] for k in range(sum(name.startswith("layer") for name in held.files))]
        return cls(held["vectors"] if vectors is None else np.ascontiguousarray(vectors, np.float32), layers)
