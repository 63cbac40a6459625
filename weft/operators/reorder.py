"""Orders of vertices with edges near the diagonal. All but Cuthill and McKee's are dense problems, bounded by ``LOCAL_VERTICES``."""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weft.graph import Graph
from weft.plans.linalg import coo_to_numpy, to_dense

from .analysis import laplacian
from .transform import local_pairs


def _order(graph: Graph, order) -> DataFrame:
    order = np.array(order, np.int64)
    return graph.vertices.sparkSession.createDataFrame(pa.table([pa.array(np.arange(len(order))), pa.array(order)], ["position", "id"]), "position long, id long")


def permute_graph(graph: Graph, order) -> Graph:
    """The vertex at each place of ``order`` (ids, or ``position, id`` rows) gets the place's number."""
    return graph.permute(order if isinstance(order, DataFrame) else _order(graph, order))


def cuthill_mckee_order(adj: np.ndarray) -> list[int]:
    """Breadth first from the vertex of least degree, neighbours by degree; the next such vertex begins the next part."""
    return _breadth_first(len(adj), *np.nonzero(adj))


def _breadth_first(n: int, src: np.ndarray, dst: np.ndarray) -> list[int]:
    """``cuthill_mckee_order`` from the ends of edges, each pair once."""
    degree = np.bincount(src, minlength=n)
    a, b = np.concatenate([src, dst]), np.concatenate([dst, src])
    order = np.lexsort((b, degree[b], a))
    a, b = a[order], b[order].tolist()
    start = np.searchsorted(a, np.arange(n + 1)).tolist()
    out, seen = [], bytearray(n)
    for first in np.lexsort((np.arange(n), degree)).tolist():
        if seen[first]:
            continue
        queue = deque([first])
        seen[first] = 1
        while queue:
            v = queue.popleft()
            out.append(v)
            for w in b[start[v] : start[v + 1]]:
                if not seen[w]:
                    seen[w] = 1
                    queue.append(w)
    return out


def cuthill_mckee(graph: Graph) -> Graph:
    """Reordered by the reverse Cuthill-McKee order: one sequence on the driver, over the edges."""
    return permute_graph(graph, _breadth_first(graph.num_vertices(), *local_pairs(graph))[::-1])


def laplacian_reordering(graph: Graph, *, threshold: float = 1e-8) -> Graph:
    """Reordered by the Laplacian's eigenvector with the smallest eigenvalue beyond the threshold; equal entries go by id."""
    m = coo_to_numpy(laplacian(graph), graph.num_vertices())
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    v = vectors[:, int(np.searchsorted(values, threshold))]
    return permute_graph(graph, np.argsort(np.round(v * np.sign(v[np.abs(v).argmax()]), 12), kind="stable"))


def _width(i: np.ndarray, j: np.ndarray, place: np.ndarray) -> tuple[int, int]:
    """(largest distance of places along an edge, number of edges as long)."""
    if not len(i):
        return 0, 0
    d = np.abs(place[i] - place[j])
    return int(d.max()), int((d == d.max()).sum())


def node_centroid_hill_climbing(graph: Graph, *, relax: float = 1, num_centerings: int = 20, seed: int = 0) -> Graph:
    """Reordered by turns: ends of the longest edges move to the mean place of what they are tied to, if that narrows the graph; then swaps of such
    an end with another vertex, as long as the width or the number of longest edges falls. Begins breadth first from a random vertex."""
    adj = to_dense(graph) != 0
    n = len(adj)
    both = adj | adj.T
    i, j = np.triu(both, 1).nonzero()
    rng, order, left = np.random.default_rng(seed), [], set(range(n))
    while left:
        queue = deque([int(rng.choice(sorted(left)))])
        left.discard(queue[0])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in np.flatnonzero(both[v]):
                if int(w) in left:
                    left.discard(int(w))
                    queue.append(int(w))
    place = np.argsort(order)
    for _ in range(num_centerings):
        width, _ = _width(i, j, place)
        long = np.abs(place[i] - place[j]) >= relax * width
        total, count = place.astype(float), np.ones(n)
        for a, b in ((i[long], j[long]), (j[long], i[long])):
            np.add.at(total, a, place[b])
            np.add.at(count, a, 1)
        moved = np.argsort(np.argsort(total / count, kind="stable"))
        if _width(i, j, moved)[0] < width:
            place = moved
        place = _climb(i, j, place)
    return permute_graph(graph, np.argsort(place))


def _climb(i: np.ndarray, j: np.ndarray, place: np.ndarray) -> np.ndarray:
    while True:
        best = _width(i, j, place)
        long = np.flatnonzero(np.abs(place[i] - place[j]) == best[0])
        for e in long:
            lo, hi = sorted((i[e], j[e]), key=lambda v: place[v])
            for w in range(len(place)):
                end = lo if place[w] > place[lo] else hi
                new = place.copy()
                new[end], new[w] = place[w], place[end]
                if _width(i, j, new) < best:
                    break
            else:
                continue
            place = new
            break
        else:
            return place


__all__ = ["cuthill_mckee", "cuthill_mckee_order", "laplacian_reordering", "node_centroid_hill_climbing", "permute_graph"]
