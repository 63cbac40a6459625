"""Analysis of networks: components, distances, centrality, Laplacians, widths.

Paths from a source don't depend on other sources, so sources are dealt over tasks with the edges broadcast, as long as there are no
more than ``BROADCAST_EDGES`` of them; beyond that distances spread by joins, round by round.
"""

from __future__ import annotations

import heapq
import math
import warnings
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.graph import Graph
from weft.plans import components as _components
from weft.plans.iterate import until
from weft.plans.linalg import LOCAL_EDGES
from weft.plans.tables import discard, materialize

#: Edges that a worker may hold (24 bytes each), counted before they are sent.
BROADCAST_EDGES = 2_000_000
INFINITY = math.inf


# -- components ----------------------------------------------------------------------------------------------------------------


def connected_components(graph: Graph, *, connection: str = "weak", local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``id, component, root``: components numbered from 0 by their smallest vertex, which is the root. Strong ones need a path both
    ways. Isolated vertices are components of their own."""
    if connection not in ("weak", "strong"):
        raise ValueError(f"connection is weak or strong, not {connection!r}")
    if connection == "strong":
        roots = _local_strong(graph) if graph.edges.count() <= local_edges else _strong(graph)
    else:
        edges = graph.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
        roots = _components.connected_components(edges)
    own = graph.vertices.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    from weft.graph import numbered

    names = numbered(own.select(F.col("root").alias("id")).distinct()).select(F.col("id").alias("root"), F.col("new").alias("component"))
    return own.join(names, "root").select("id", "component", "root")


def _local_strong(graph: Graph) -> DataFrame:
    """Strong components of a counted number of edges in one process: one search, in which a vertex that leads back to none before it
    closes a component."""
    e = graph.edges.select("src", "dst").toPandas()
    ids, flat = np.unique(np.concatenate([e["src"].to_numpy(np.int64), e["dst"].to_numpy(np.int64)]), return_inverse=True)
    order = np.argsort(flat[: len(e)], kind="stable")
    to, start = flat[len(e) :][order], np.searchsorted(flat[: len(e)][order], np.arange(len(ids) + 1))
    seen, low, root, path = np.full(len(ids), -1), np.zeros(len(ids), np.int64), np.full(len(ids), -1), []
    clock, place = 0, np.zeros(len(ids), np.int64)
    for first in range(len(ids)):
        if seen[first] >= 0:
            continue
        stack = [(first, start[first])]
        while stack:
            v, at = stack.pop()
            if at == start[v] and seen[v] < 0:
                seen[v] = low[v] = clock
                clock += 1
                place[v] = len(path)
                path.append(v)
            if at < start[v + 1]:
                w = to[at]
                stack.append((v, at + 1))
                if seen[w] < 0:
                    stack.append((w, start[w]))
                elif root[w] < 0:
                    low[v] = min(low[v], seen[w])
                continue
            if low[v] == seen[v]:
                cut = place[v]
                root[path[cut:]] = min(path[cut:])
                del path[cut:]
            if stack:
                low[stack[-1][0]] = min(low[stack[-1][0]], low[v])
    return graph.edges.sparkSession.createDataFrame(list(zip(ids.tolist(), ids[root].tolist(), strict=True)), "id long, root long")


def _strong(graph: Graph, max_rounds: int = 200) -> DataFrame:
    """Strong components by colouring: the smallest id that reaches a vertex is its colour; those of a colour that reach the vertex it is named after
    are one component. They are taken out, and the rest goes on."""
    left = materialize(graph.edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    todo = materialize(graph.vertices, "todo")
    done = None
    for _ in range(max_rounds):
        if not todo.take(1):
            break
        colour = _spread(todo.select("id", F.col("id").alias("c")), left)
        same = left.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd")
        back = same.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        seeds = colour.select("id", F.when(F.col("id") == F.col("c"), F.col("c")).otherwise(F.lit(2**62)).alias("c"))
        reach = _spread(seeds, materialize(back, "back")).where(F.col("c") < 2**62)
        part = materialize(reach.select("id", F.col("c").alias("root")), "strong")
        done = part if done is None else done.union(part)
        new_todo = materialize(todo.join(part, "id", "left_anti"), "todo")
        out = part.select(F.col("id").alias("src"))
        new_left = materialize(left.join(out, "src", "left_anti").join(out.select(F.col("src").alias("dst")), "dst", "left_anti").select("src", "dst"), "edges")
        discard(todo)
        discard(left)
        todo, left = new_todo, new_left
    return done if done is not None else graph.vertices.select("id", F.col("id").alias("root"))


def _spread(labels: DataFrame, edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Smallest label ``c`` that reaches each vertex along edges."""

    def step(now: DataFrame, _: int) -> DataFrame:
        sent = edges.join(now.select(F.col("id").alias("src"), "c"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("n"))
        return now.join(sent, "id", "left").select("id", F.least("c", F.coalesce("n", "c")).alias("c"))

    def done(old: DataFrame, new: DataFrame) -> bool:
        return not old.join(new.withColumnRenamed("c", "d"), "id").where("c <> d").take(1)

    return until(labels, step, done, rounds=max_rounds, name="labels")


# -- Laplacians ----------------------------------------------------------------------------------------------------------------


def laplacian(graph: Graph, *, normed: bool = False, use_out_degree: bool = False) -> DataFrame:
    """``i, j, value`` of D - A without loops, D the sums of the columns (or rows); every diagonal cell is there. Normed: both sides
    by the root of the degree; the diagonal is 1, or 0 for a vertex of degree 0."""
    own = graph.matrix().where("i <> j")
    end = "i" if use_out_degree else "j"
    degree = graph.vertices.join(own.groupBy(F.col(end).alias("id")).agg(F.sum("value").alias("d")), "id", "left").select("id", F.coalesce("d", F.lit(0.0)).alias("d"))
    if not normed:
        return own.select("i", "j", (-F.col("value")).alias("value")).union(degree.select(F.col("id").alias("i"), F.col("id").alias("j"), F.col("d").alias("value")))
    root = F.when(F.col("d") == 0, 1.0).otherwise(F.sqrt("d"))
    cells = own.join(degree.select(F.col("id").alias("i"), root.alias("p")), "i").join(degree.select(F.col("id").alias("j"), root.alias("q")), "j")
    cells = cells.select("i", "j", (-F.col("value") / F.col("p") / F.col("q")).alias("value"))
    return cells.union(degree.select(F.col("id").alias("i"), F.col("id").alias("j"), F.when(F.col("d") == 0, 0.0).otherwise(1.0).alias("value")))


def degree_diagonal(graph: Graph, *, use_out_degree: bool = False, normed: bool = False) -> DataFrame:
    """``id, value``: the diagonal that ``laplacian`` divides by or subtracts from."""
    cells = laplacian(graph, use_out_degree=use_out_degree).where("i = j").select(F.col("i").alias("id"), "value")
    return cells.select("id", F.when(F.col("value") == 0, 1.0).otherwise(F.sqrt("value")).alias("value")) if normed else cells


def ave_laplacian(graph: Graph) -> DataFrame:
    """``i, j, value`` of the symmetric part of I - W / D, D the sums of the columns, taken for the rows."""
    own = graph.matrix()
    degree = own.groupBy(F.col("j").alias("i")).agg(F.sum("value").alias("d"))
    cells = own.join(degree, "i", "left").select("i", "j", (-F.coalesce(F.try_divide("value", "d"), F.lit(0.0))).alias("value"))
    both = cells.union(graph.vertices.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("value")))
    both = both.union(both.select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    return both.groupBy("i", "j").agg((F.sum("value") / 2).alias("value"))


def stationary(graph: Graph, *, eta: float = 0.99, tol: float = 1e-12, max_iter: int = 500) -> DataFrame:
    """``id, phi``: the vector that the walk with teleporting leaves alone, by power iteration; rows without edges stay 0 and only
    teleport. Rounds end when the largest change is within ``tol``; a warning is said if ``max_iter`` isn't enough."""
    cells, n = _walk(graph), graph.num_vertices()
    if n and cells.count() <= LOCAL_EDGES:
        ids = np.array([r.id for r in graph.vertices.orderBy("id").collect()], np.int64)
        e = cells.toPandas()
        i, j, p = np.searchsorted(ids, e["i"]), np.searchsorted(ids, e["j"]), e["p"].to_numpy(float)
        phi = np.full(n, 1.0 / n)
        for _ in range(max_iter):
            new = (1 - eta) / n * phi.sum() + eta * np.bincount(j, phi[i] * p, n)
            new /= new.sum()
            change = np.abs(new - phi).max()
            phi = new
            if change <= tol:
                break
        else:
            warnings.warn(f"no stationary vector within {max_iter} rounds", stacklevel=2)
        return graph.edges.sparkSession.createDataFrame(list(zip(ids.tolist(), phi.tolist(), strict=True)), "id long, phi double")
    cells = materialize(cells, "walk")

    def step(now: DataFrame, _: int) -> DataFrame:
        flow = cells.join(now.select(F.col("id").alias("i"), "phi"), "i").groupBy(F.col("j").alias("id")).agg(F.sum(F.col("phi") * F.col("p")).alias("f"))
        total = now.agg(F.sum("phi")).first()[0]
        new = now.join(flow, "id", "left").select("id", (F.lit((1 - eta) / n * total) + eta * F.coalesce("f", F.lit(0.0))).alias("phi"))
        mass = (1 - eta) * total + eta * (flow.agg(F.sum("f")).first()[0] or 0.0)
        return new.withColumn("phi", F.col("phi") / mass)

    def done(old: DataFrame, new: DataFrame) -> bool:
        return old.join(new.withColumnRenamed("phi", "q"), "id").agg(F.max(F.abs(F.col("phi") - F.col("q")))).first()[0] <= tol

    return until(graph.vertices.select("id", F.lit(1.0 / max(n, 1)).alias("phi")), step, done, rounds=max_iter, name="phi", warn=f"no stationary vector within {max_iter} rounds")


def _walk(graph: Graph) -> DataFrame:
    """``i, j, p``: edges by the sum of their row."""
    own = graph.matrix()
    rows = own.groupBy("i").agg(F.sum("value").alias("d"))
    return own.join(rows, "i").where("d <> 0").select("i", "j", (F.col("value") / F.col("d")).alias("p"))


def directed_laplacian(graph: Graph, *, eta: float = 0.99, tol: float = 1e-12, max_iter: int = 500) -> DataFrame:
    """``i, j, value`` of F - (F P + P'F) / 2: P the walk with teleporting, F its stationary vector on the diagonal. All cells are
    there (teleporting reaches every vertex), so it is for small networks."""
    phi = materialize(stationary(graph, eta=eta, tol=tol, max_iter=max_iter), "phi")
    n = phi.count()
    pairs = phi.select(F.col("id").alias("i"), F.col("phi").alias("fi")).join(phi.select(F.col("id").alias("j"), F.col("phi").alias("fj")))
    walk = _walk(graph).select("i", "j", (eta * F.col("p")).alias("p"))
    there, back = walk, walk.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("p").alias("q"))
    own = pairs.join(there, ["i", "j"], "left").join(back, ["i", "j"], "left")
    jump = (1 - eta) / max(n, 1)
    mixed = (F.col("fi") * (jump + F.coalesce("p", F.lit(0.0))) + F.col("fj") * (jump + F.coalesce("q", F.lit(0.0)))) / 2
    return own.select("i", "j", (F.when(F.col("i") == F.col("j"), F.col("fi")).otherwise(0.0) - mixed).alias("value"))


# -- widths --------------------------------------------------------------------------------------------------------------------


def bandwidth(graph: Graph) -> DataFrame:
    """One row ``bandwidth``: the largest distance of ids along an edge, 0 without edges."""
    return graph.edges.agg(F.coalesce(F.max(F.abs(F.col("src") - F.col("dst"))), F.lit(0).cast("long")).alias("bandwidth"))


def profile(graph: Graph) -> DataFrame:
    """One row ``profile``: sum over vertices of their id less the smallest source of an edge into them (their id if none)."""
    first = graph.edges.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("f"))
    return graph.vertices.join(first, "id", "left").agg(F.coalesce(F.sum(F.col("id") - F.coalesce("f", F.lit(0))), F.lit(0)).cast("long").alias("profile"))


# -- paths ---------------------------------------------------------------------------------------------------------------------


def _traversed(graph: Graph, directed: bool | None, weighted: bool | None) -> DataFrame:
    """``src, dst, weight`` of the edges that paths use: the lightest of repeated ones, both ways if undirected, all 1 if unweighted."""
    weighted = graph.weighted if weighted is None else weighted
    own = graph.edges.select("src", "dst", (F.col("weight") if weighted else F.lit(1.0)).alias("weight"))
    if directed is False:
        own = own.union(own.select("dst", "src", "weight"))
    return own.where("src <> dst").groupBy("src", "dst").agg(F.min("weight").alias("weight"))


class _Adjacency:
    """Edges of a graph for searches in a worker, in rows of sources."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, weight: np.ndarray):
        order = np.lexsort((dst, src))
        self.ids = np.unique(np.concatenate([src, dst]))
        s, self.dst, self.weight = np.searchsorted(self.ids, src[order]), np.searchsorted(self.ids, dst[order]), weight[order]
        self.start = np.searchsorted(s, np.arange(len(self.ids) + 1))
        self.unit = bool((self.weight == 1).all())

    def near(self, v: int) -> zip:
        """(place of the edge, target, weight) of a vertex's edges."""
        lo, hi = int(self.start[v]), int(self.start[v + 1])
        return zip(range(lo, hi), self.dst[lo:hi].tolist(), self.weight[lo:hi].tolist(), strict=True)

    def search(self, source: int, limit: float = INFINITY) -> tuple[dict[int, float], dict[int, int]]:
        """(distances, predecessors) of what the place ``source`` reaches, and nothing else; of equally short paths the smallest predecessor counts."""
        dist, pred = {source: 0.0}, {source: -1}
        heap, closed = [(0.0, source)], set()
        while heap:
            d, v = heapq.heappop(heap)
            if v in closed:
                continue
            closed.add(v)
            for _, w, weight in self.near(v):
                new, old = d + weight, dist.get(w, INFINITY)
                if new > limit:
                    continue
                if new < old:
                    dist[w], pred[w] = new, v
                    heapq.heappush(heap, (new, w))
                elif new == old and w not in closed and v < pred[w]:
                    pred[w] = v
        return dist, pred

    def ordered(self, source: int) -> tuple[list[int], dict[int, list[int]], dict[int, float]]:
        """(vertices by distance, places of the edges into each on shortest paths, numbers of shortest paths) of what ``source`` reaches."""
        dist, sigma = {source: 0.0}, {source: 1.0}
        into: dict[int, list[int]] = {source: []}
        heap, closed, order = [(0.0, source)], set(), []
        while heap:
            d, v = heapq.heappop(heap)
            if v in closed:
                continue
            closed.add(v)
            order.append(v)
            for k, w, weight in self.near(v):
                new, old = d + weight, dist.get(w, INFINITY)
                if new < old:
                    dist[w], sigma[w], into[w] = new, sigma[v], [k]
                    heapq.heappush(heap, (new, w))
                elif new == old and w not in closed:
                    sigma[w] += sigma[v]
                    into[w].append(k)
        return order, into, sigma


def _sent(edges: DataFrame, n: int):
    if n > BROADCAST_EDGES:
        raise ValueError(f"{n} edges are too many to hold in a worker ({BROADCAST_EDGES})")
    e = edges.toPandas()
    adjacency = _Adjacency(e["src"].to_numpy(np.int64), e["dst"].to_numpy(np.int64), e["weight"].to_numpy(float))
    return edges.sparkSession.sparkContext.broadcast(adjacency)


def _by_source(graph: Graph, sources: DataFrame | None) -> DataFrame:
    own = graph.vertices if sources is None else sources.select("id").distinct()
    n = own.count()
    return own.repartition(max(1, min(n // 8, 10_000, 4 * own.sparkSession.sparkContext.defaultParallelism)), "id")


def shortest_path(graph: Graph, *, directed: bool | None = None, weighted: bool | None = None, limit: float = INFINITY, sources: DataFrame | None = None, broadcast_edges: int = BROADCAST_EDGES) -> DataFrame:
    """``src, dst, dist, pred`` for the pairs with a path of at most ``limit``, from all vertices or the ids in ``sources``. A vertex
    reaches itself with 0 and no predecessor. Weights must not be negative."""
    edges = materialize(_traversed(graph, directed, weighted), "edges")
    n = edges.count()
    if n > broadcast_edges:
        return _relaxed(graph.vertices if sources is None else sources.select("id").distinct(), edges, limit)
    shared = _sent(edges, n)

    def worker(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adj, rows = shared.value, ([], [], [], [])

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], ["src", "dst", "dist", "pred"])
            for c in rows:
                c.clear()
            return out

        for b in batches:
            for source in b.column(0).to_pylist():
                at = int(np.searchsorted(adj.ids, source))
                alone = at == len(adj.ids) or adj.ids[at] != source
                dist, pred = ({}, {}) if alone else adj.search(at, limit)
                seen = np.fromiter(dist, np.int64, len(dist))
                before = np.fromiter(pred.values(), np.int64, len(pred))
                rows[0].extend([source] * max(1, len(dist)))
                rows[1].extend([source] if alone else adj.ids[seen].tolist())
                rows[2].extend([0.0] if alone else dist.values())
                rows[3].extend([None] if alone else [None if p < 0 else v for p, v in zip(before.tolist(), adj.ids[before].tolist(), strict=True)])
                if len(rows[0]) >= 10_000:
                    yield batch()
        if rows[0]:
            yield batch()

    return _by_source(graph, sources).mapInArrow(worker, "src long, dst long, dist double, pred long")


def _relaxed(sources: DataFrame, edges: DataFrame, limit: float) -> DataFrame:
    """Distances by rounds: what got nearer in the last round is sent along the edges; the nearest, then smallest predecessor stays."""
    start = sources.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("dist"), F.lit(None).cast("long").alias("pred"), F.lit(True).alias("new"))

    def step(now: DataFrame, _: int) -> DataFrame:
        sent = now.where("new").select("src", F.col("dst").alias("v"), "dist").join(edges.select(F.col("src").alias("v"), F.col("dst").alias("w"), "weight"), "v")
        sent = sent.select("src", F.col("w").alias("dst"), (F.col("dist") + F.col("weight")).alias("dist"), F.col("v").alias("pred")).where(F.col("dist") <= limit)
        sent = sent.groupBy("src", "dst").agg(F.min(F.struct("dist", "pred")).alias("s"))
        both = now.join(sent, ["src", "dst"], "full")
        nearer = F.col("s").isNotNull() & (F.col("dist").isNull() | (F.col("s.dist") < F.col("dist")) | ((F.col("s.dist") == F.col("dist")) & (F.col("s.pred") < F.col("pred"))))
        moved = F.col("s").isNotNull() & (F.col("dist").isNull() | (F.col("s.dist") < F.col("dist")))
        return both.select("src", "dst", F.when(nearer, F.col("s.dist")).otherwise(F.col("dist")).alias("dist"), F.when(nearer, F.col("s.pred")).otherwise(F.col("pred")).alias("pred"), F.coalesce(moved, F.lit(False)).alias("new"))

    return until(start, step, lambda old, new: not new.where("new").take(1), rounds=1_000_000, name="dist").select("src", "dst", "dist", "pred")


def betweenness(graph: Graph, kind: str = "vertex", *, directed: bool | None = None, weighted: bool | None = None) -> DataFrame:
    """``id, betweenness``, or ``src, dst, betweenness`` of edges: shares of shortest paths through each, ends not counted. Paths use
    the edges as stored; ``directed=False`` halves the sums."""
    if kind not in ("vertex", "edge"):
        raise ValueError(f"kind is vertex or edge, not {kind!r}")
    edges = materialize(_traversed(graph, True, weighted), "edges")
    shared = _sent(edges, edges.count())

    def worker(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adj = shared.value
        vertex, edge = np.zeros(len(adj.ids)), np.zeros(len(adj.dst))
        owner = np.repeat(np.arange(len(adj.ids)), np.diff(adj.start))
        for b in batches:
            for source in b.column(0).to_pylist():
                at = int(np.searchsorted(adj.ids, source))
                if at == len(adj.ids) or adj.ids[at] != source:
                    continue
                order, into, sigma = adj.ordered(at)
                delta = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for k in into[w]:
                        v = int(owner[k])
                        part = sigma[v] / sigma[w] * (1 + delta[w])
                        edge[k] += part
                        delta[v] += part
                    if w != at:
                        vertex[w] += delta[w]
        if kind == "vertex":
            own, other, value = adj.ids, adj.ids, vertex
        else:
            own, other, value = adj.ids[owner], adj.ids[adj.dst], edge
        some = np.flatnonzero(value)  # what this task's searches came to
        own, other, value = own[some], other[some], value[some]
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(other), pa.array(value)], ["src", "dst", "b"])

    sums = _by_source(graph, None).mapInArrow(worker, "src long, dst long, b double").groupBy("src", "dst").agg(F.sum("b").alias("b"))
    value: Column = F.coalesce("b", F.lit(0.0)) * (0.5 if directed is False else 1.0)
    if kind == "vertex":
        return graph.vertices.join(sums, F.col("id") == F.col("src"), "left").select("id", value.alias("betweenness"))
    return graph.edges.select("src", "dst").distinct().join(sums, ["src", "dst"], "left").select("src", "dst", value.alias("betweenness"))


def eccentricity(graph: Graph, *, directed: bool | None = None, weighted: bool | None = None) -> DataFrame:
    """``id, eccentricity``: the largest distance to a vertex from any other; infinite if some can't reach it."""
    n = graph.num_vertices()
    dist = shortest_path(graph, directed=directed, weighted=weighted).groupBy(F.col("dst").alias("id")).agg(F.max("dist").alias("d"), F.count("*").alias("c"))
    return graph.vertices.join(dist, "id", "left").select("id", F.when(F.col("c") == n, F.col("d")).otherwise(F.lit(INFINITY)).alias("eccentricity"))


def diameter(graph: Graph, **how) -> DataFrame:
    """One row ``diameter``: the largest eccentricity."""
    return eccentricity(graph, **how).agg(F.max("eccentricity").alias("diameter"))


def radius(graph: Graph, **how) -> DataFrame:
    """One row ``radius``: the smallest eccentricity."""
    return eccentricity(graph, **how).agg(F.min("eccentricity").alias("radius"))


__all__ = ["ave_laplacian", "bandwidth", "betweenness", "connected_components", "degree_diagonal", "diameter", "directed_laplacian", "eccentricity", "laplacian", "profile", "radius", "shortest_path", "stationary"]
