"""Minimum spanning trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.metrics import Metric, canonical, pairwise
from weft.graph import Graph
from weft.plans.components import connected_components
from weft.plans.linalg import LOCAL_EDGES, LOCAL_VERTICES
from weft.plans.tables import discard, looked_up, materialize

from . import scan
from .neighbors import _points, all_pairs, blocked, neighbors
from .scan import SCREENED, Screen, scanned, stacked, streamed


def _kruskal(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Places of the tree's edges; edges by weight, then ends."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i in np.lexsort((b, a, w)):
        x, y = find(int(a[i])), find(int(b[i]))
        if x != y:
            root[x] = y
            out.append(i)
    return np.array(out, np.int64)


def spanning_forest(half: DataFrame, *, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``a, b, w`` of the minimum spanning forest of undirected edges ``a, b, w``; equal weights go by ends.

    Up to ``local_edges`` edges are solved in one process; more by Boruvka's rounds: every component takes its lightest edge out, what these
    connect is contracted, and of parallel edges the lightest stays. About log(n) rounds of aggregations and look-ups.
    """
    own = half.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").where("a <> b")
    own = materialize(own.groupBy("a", "b").agg(F.min("w").alias("w")), "edges")
    spark = half.sparkSession
    if own.count() <= local_edges:
        e = own.toPandas()
        keep = e.iloc[_kruskal(e["a"].to_numpy(), e["b"].to_numpy(), e["w"].to_numpy())]
        return spark.createDataFrame(list(zip(keep["a"].tolist(), keep["b"].tolist(), keep["w"].tolist(), strict=True)), "a long, b long, w double")
    left = own.select(F.col("a").alias("ca"), F.col("b").alias("cb"), "a", "b", "w")
    tree = None
    while left.take(1):
        both = left.select("ca", "cb", "a", "b", "w").union(left.select("cb", "ca", "a", "b", "w"))
        best = materialize(both.groupBy("ca").agg(F.min(F.struct("w", "a", "b", "cb")).alias("m")), "lightest")
        chosen = best.select("m.a", "m.b", "m.w").distinct()
        tree = chosen if tree is None else tree.union(chosen)
        roots = connected_components(best.select(F.col("ca").alias("a"), F.col("m.cb").alias("b")))
        n = roots.count()
        step = looked_up(left, roots.select(F.col("id").alias("ca"), F.col("root").alias("ra")), "ca", n)
        step = looked_up(step, roots.select(F.col("id").alias("cb"), F.col("root").alias("rb")), "cb", n).where("ra <> rb")
        step = step.groupBy(F.least("ra", "rb").alias("ca"), F.greatest("ra", "rb").alias("cb")).agg(F.min(F.struct("w", "a", "b")).alias("m"))
        new = materialize(step.select("ca", "cb", "m.a", "m.b", "m.w"), "contracted")
        discard(left)
        discard(roots)
        left = new
    return tree if tree is not None else own


def minimum_spanning_subtree(graph: Graph) -> Graph:
    """The graph's minimum spanning forest, both ways; of two directions the lighter counts."""
    half = graph.edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col("weight").alias("w"))
    return _both_ways(graph.vertices, spanning_forest(half))


def _both_ways(vertices: DataFrame, tree: DataFrame) -> Graph:
    edges = tree.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("w").alias("weight"))
    return Graph(vertices, edges.union(edges.select("dst", "src", "weight")))


def _pairs(points: DataFrame, metric: Metric) -> DataFrame:
    """All distances; 0 is no edge."""
    return all_pairs(points, metric).where("d <> 0").select("a", "b", F.col("d").alias("w"))


#: Nearest points that trees begin with, and rows of these that are brought to the driver.
NEAR, NEAR_ROWS = 12, 20_000_000


class _Trees:
    """Spanning forests of many points, one after the other without the pairs of those before, by Boruvka's rounds over each point's nearest others.

    A part takes the lightest edge that is known out of it once every point of it has looked as far: what a point hasn't seen is no nearer than the last of its
    nearest. Where no part has, all but the largest send the points that haven't through all points of other parts. Pairs that coincide are no edges; equal weights go by ends.
    """

    def __init__(self, points: DataFrame, n: int, metric: str, near: int = NEAR):
        self.own, self.n, self.metric = materialize(_points(points), "points"), n, metric
        self.ids = np.sort(self.own.select("id").toPandas()["id"].to_numpy(np.int64))
        found = neighbors(self.own, self.own, metric=metric, k=near, exclude_self=True, positive=True).select("qid", "tid", "dist").toPandas()
        self.q, self.t = self._place(found["qid"]), self._place(found["tid"])
        self.w = found["dist"].to_numpy(float)
        seen = np.bincount(self.q, minlength=n)
        self.reach = np.full(n, np.inf)
        far = np.zeros(n)
        np.maximum.at(far, self.q, self.w)
        self.reach[seen >= near] = far[seen >= near]
        self.banned = np.zeros(0, np.int64)  # pairs of the trees so far, as one number each

    def _place(self, ids) -> np.ndarray:
        return np.searchsorted(self.ids, np.asarray(ids, np.int64))

    def _key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.minimum(a, b) * self.n + np.maximum(a, b)

    def _ask(self, which: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For some points the nearest of another part that isn't banned."""
        degree = np.bincount(np.concatenate([self.banned // self.n, self.banned % self.n]), minlength=self.n) if len(self.banned) else np.zeros(self.n, int)
        parts = pa.table([pa.array(self.ids), pa.array(root)], ["id", "g"])
        both = materialize(self.own.join(self.own.sparkSession.createDataFrame(parts), "id"), "parts")
        asked = []
        for level in (degree < 8, degree >= 8):  # few have many banned pairs to look past
            now = which & level
            if now.any():
                some = self.own.sparkSession.createDataFrame(pa.table([pa.array(self.ids[now])], ["id"]))
                asked.append(scanned(both.join(some, "id", "left_semi"), both, self.metric, k=1 + int(degree[now].max()), epsilon=None, n=int(now.sum()), n_targets=self.n, apart=True, positive=True).toPandas())
        found = pd.concat(asked)
        discard(both)
        q, t, w = self._place(found["qid"]), self._place(found["tid"]), found["dist"].to_numpy(float)
        keep = ~np.isin(self._key(q, t), self.banned)
        q, t, w = q[keep], t[keep], w[keep]
        order = np.lexsort((t, w, q))
        first = order[np.unique(q[order], return_index=True)[1]]
        return q[first], t[first], w[first]

    def tree(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(smaller id, larger id, weight) of the next forest."""
        keep = ~np.isin(self._key(self.q, self.t), self.banned) if len(self.banned) else np.ones(len(self.q), bool)
        a, b, w = np.minimum(self.q, self.t)[keep], np.maximum(self.q, self.t)[keep], self.w[keep]
        root, alone, out = np.arange(self.n), np.zeros(self.n, bool), []
        while True:
            order = np.lexsort((b, a, w))
            a, b, w = a[order], b[order], w[order]
            best = self._lightest(a, b, root)
            sure = np.full(self.n, np.inf)
            np.minimum.at(sure, root, self.reach)
            some = np.flatnonzero(best < len(a))
            taken = best[some][w[best[some]] < sure[some]]
            if not len(taken):
                size = np.bincount(root, minlength=self.n)
                weight = np.append(w, np.inf)[best]
                which = (self.reach <= weight[root]) & (root != size.argmax()) & ~alone[root]
                if not which.any():
                    break
                asked = np.unique(root[which])
                q, t, d = self._ask(which, root)
                a, b, w = np.concatenate([a, np.minimum(q, t)]), np.concatenate([b, np.maximum(q, t)]), np.concatenate([w, d])
                order = np.lexsort((b, a, w))
                a, b, w = a[order], b[order], w[order]
                best = self._lightest(a, b, root)
                alone[asked[best[asked] == len(a)]] = True  # nothing goes out of them
                taken = best[asked][best[asked] < len(a)]
                if not len(taken):
                    continue
            key, first = np.unique(self._key(a[taken], b[taken]), return_index=True)
            taken = taken[first]
            out.append((a[taken], b[taken], w[taken]))
            root = _joined(root, a[taken], b[taken])
            apart = root[a] != root[b]
            a, b, w = a[apart], b[apart], w[apart]
        found = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        self.banned = np.concatenate([self.banned, self._key(found[0], found[1])])
        return self.ids[found[0]], self.ids[found[1]], found[2]

    def _lightest(self, a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
        """For each part the place of its first edge, of edges in order that all lead out; their number if it has none."""
        out, back = np.full(self.n, len(a)), np.arange(len(a))[::-1]
        ends = np.empty(2 * len(a), np.int64)  # both ends of an edge beside each other, the last first
        ends[::2], ends[1::2] = root[a[::-1]], root[b[::-1]]
        out[ends] = np.repeat(back, 2)
        return out


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots once the edges have joined parts: the smallest of each."""
    to, x, y = np.arange(len(root)), root[a], root[b]
    while len(x):
        np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
        while (to[to] != to).any():
            to = to[to]
        x, y = to[x], to[y]
        x, y = x[x != y], y[x != y]
    return to[root]


def _trees(points: DataFrame, n: int, metric: Metric, few: int) -> _Trees | None:
    """None for what ``_Trees`` isn't for: few points, too many for the driver, or a metric without a screen."""
    metric = metric if callable(metric) else canonical(metric)
    return _Trees(points, n, metric) if few < n <= NEAR_ROWS // NEAR and not callable(metric) and metric in SCREENED else None


def _table(spark, tree: tuple) -> DataFrame:
    return spark.createDataFrame(pa.table([pa.array(c) for c in tree], ["a", "b", "w"]))


def forest_of_points(points: DataFrame, metric: Metric = "euclidean", *, few: int = LOCAL_VERTICES) -> DataFrame:
    """``a, b, w`` of the minimum spanning forest of points by their distances; equal ones go by ends, and 0 is no edge.

    Up to ``few`` points all pairs are made. More are joined over their nearest neighbours (``_Trees``). Metrics without a screen, and still more points, go by Boruvka's rounds
    over all: blocks of points meet in kernels that keep, for each point, the nearest one of another component only, so no table of pairs is made; the shortest such edge out of each
    component is taken, and components are merged.
    """
    n = points.count()
    if n <= few:
        return spanning_forest(_pairs(points, metric))
    if (trees := _trees(points, n, metric, few)) is not None:
        out = _table(points.sparkSession, trees.tree())
        discard(trees.own)
        return out
    metric = metric if callable(metric) else canonical(metric)

    def kernel(q: pa.Table, t: pa.Table) -> pa.Table:
        order = np.argsort(t["id"].to_numpy(), kind="stable")
        qid, tid, qroot, troot = q["id"].to_numpy(), t["id"].to_numpy()[order], q["root"].to_numpy(), t["root"].to_numpy()[order]
        at, best = np.zeros(len(qid), np.int64), np.full(len(qid), np.inf)
        if len(qid) and len(tid):
            x, y = stacked(q["x"]), stacked(t["x"])[order]
            step = max(1, 8_000_000 // len(tid))
            for lo in range(0, len(qid), step):
                d = pairwise(x[lo : lo + step], y, metric)
                d[(qroot[lo : lo + step, None] == troot[None]) | (d == 0)] = np.inf
                at[lo : lo + step] = d.argmin(1)
                best[lo : lo + step] = d.min(1)
        keep = np.isfinite(best)
        return pa.table([pa.array(c[keep]) for c in (qroot, qid, tid[at] if len(tid) else at, best, troot[at] if len(tid) else at)], ["root", "q", "t", "w", "other"])

    own = materialize(_points(points).withColumn("root", F.col("id")), "parts")
    tree = None
    while True:
        near = blocked(own, own.toDF(*own.columns), kernel, "root long, q long, t long, w double, other long")
        edge = F.struct("w", F.least("q", "t").alias("a"), F.greatest("q", "t").alias("b"), "other")
        best = materialize(near.groupBy("root").agg(F.min(edge).alias("m")), "lightest")
        if not best.take(1):
            break
        chosen = best.select("m.a", "m.b", "m.w").distinct()
        tree = chosen if tree is None else tree.union(chosen)
        roots = connected_components(best.select(F.col("root").alias("a"), F.col("m.other").alias("b")))
        named = looked_up(own, roots.select(F.col("id").alias("root"), F.col("root").alias("_r")), "root", of=roots, how="left")
        new = materialize(named.select("id", "x", F.coalesce("_r", "root").alias("root")), "parts")
        discard(own)
        discard(roots)
        own = new
    empty = points.sparkSession.createDataFrame([], "a long, b long, w double")
    return empty if tree is None else tree


def mst(points: DataFrame, *, metric: Metric = "euclidean") -> Graph:
    """Minimum spanning tree of points by their distances; points that coincide aren't connected by that."""
    return _both_ways(points.select("id"), forest_of_points(points, metric))


def perturbed_mst(points: DataFrame, *, num_perturbations: int = 20, metric: Metric = "euclidean", jitter: float | None = None, seed: int = 0) -> Graph:
    """Union of the trees of the points and of noisy copies; an edge weighs the share of trees it is in. The noise's deviation
    is ``jitter``, by default the 5th percentile of the positive distances."""
    if metric == "precomputed":
        raise ValueError("noise needs points")
    n, name = points.count(), metric if callable(metric) else canonical(metric)
    if n > LOCAL_VERTICES and name in ("euclidean", "sqeuclidean"):
        if jitter is None:
            jitter = percentile_of_distances(points, 0.05, name)
        return _perturbed(points, forest_of_points(points, metric), num_perturbations, metric, jitter, seed)
    base = materialize(_pairs(points, metric), "distances")
    if jitter is None:
        jitter = base.agg(F.percentile("w", F.lit(0.05))).first()[0] or 0.0
    return _perturbed(points, spanning_forest(base), num_perturbations, metric, jitter, seed)


def _perturbed(points: DataFrame, tree: DataFrame, num_perturbations: int, metric: Metric, jitter: float, seed: int) -> Graph:
    trees = tree.select("a", "b")
    for i in range(num_perturbations):
        noise = F.transform("x", lambda v, j: v + jitter * _gauss(F.col("id"), j, seed * 1_000_003 + i))
        trees = trees.union(forest_of_points(points.select("id", noise.alias("x")), metric).select("a", "b"))
    share = trees.groupBy("a", "b").agg((F.count("*") / (num_perturbations + 1)).alias("w"))
    return _both_ways(points.select("id"), share)


def _gauss(i, j, seed: int):
    """Standard normal number that depends on its arguments only, by Box and Muller: the same again after a lost task."""
    u = lambda k: (F.pmod(F.xxhash64(i, j, F.lit(seed), F.lit(k)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    return F.sqrt(-2 * F.log(u(0))) * F.cos(2 * np.pi * u(1))


def disjoint_mst(points: DataFrame, *, num_spanning_trees: int = 3, metric: Metric = "euclidean") -> Graph:
    """Union of trees, each of what the ones before left."""
    if (trees := _trees(points, points.count(), metric, LOCAL_VERTICES)) is not None:
        out = _table(points.sparkSession, [np.concatenate(c) for c in zip(*(trees.tree() for _ in range(num_spanning_trees)), strict=True)])
        return _both_ways(points.select("id"), out)
    left = materialize(_pairs(points, metric), "distances")
    out = None
    for _ in range(num_spanning_trees):
        tree = spanning_forest(left)
        out = tree if out is None else out.union(tree)
        new = materialize(left.join(tree, ["a", "b"], "left_anti"), "distances")
        discard(left)
        left = new
    return _both_ways(points.select("id"), out)


class _Counts:
    """Of the pairs of smaller and larger ids whose distance isn't 0: how many lie under ``lo``, and how many in each part of what is from there to ``hi``; or these
    distances themselves."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, metric: str, lo: float, hi: float, bins: int, keep: bool):
        self.ids, self.x, self.metric, self.lo, self.hi, self.keep = ids, x, metric, lo, hi, keep
        self.screen, self.count, self.values = Screen(x, metric), np.zeros(bins + 1, np.int64), []

    def add(self, ids: np.ndarray, y: np.ndarray, _: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(ids), scan.COLUMNS):
            cut = slice(at, at + scan.COLUMNS)
            own = self.screen.targets(y[cut])
            for r in range(0, len(self.ids), scan.ROWS):
                self._piece(r, min(r + scan.ROWS, len(self.ids)), ids[cut], y[cut], own)
        yield from ()

    def _piece(self, r: int, r1: int, ids: np.ndarray, y: np.ndarray, own: np.ndarray) -> None:
        values, error = self.screen.piece(r, r1, own)
        level = lambda v, side: (self.screen.level(np.full(r1 - r, v), r, r1) + side * error)[:, None]
        later = self.ids[r:r1, None] < ids[None]
        under = later & (values < level(self.lo, -1)) & (values > level(0.0, 1))
        self.count[0] += np.count_nonzero(under)
        i, j = np.nonzero(later & ~under & ~(values > level(self.hi, 1)))
        for k in range(0, len(i), scan.PAIRS):
            d = scan.measured(self.x[r + i[k : k + scan.PAIRS]], y[j[k : k + scan.PAIRS]], self.metric)
            self.count[0] += np.count_nonzero((d < self.lo) & (d != 0))
            d = d[(d >= self.lo) & (d <= self.hi) & (d != 0)]
            if self.keep:
                self.values.append(d)
            elif len(d):
                np.add.at(self.count, 1 + _bin(d, self.lo, self.hi, len(self.count) - 1), 1)

    def end(self) -> Iterator[pa.RecordBatch]:
        some = np.flatnonzero(self.count)
        yield pa.RecordBatch.from_arrays([pa.array(some - 1), pa.array(np.zeros(len(some))), pa.array(self.count[some])], ["bin", "value", "n"])
        for d in self.values:
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(d), np.int64)), pa.array(d), pa.array(np.ones(len(d), np.int64))], ["bin", "value", "n"])


def _bin(d: np.ndarray, lo: float, hi: float, bins: int) -> np.ndarray:
    return np.minimum(((d - lo) / (hi - lo) * bins).astype(np.int64), bins - 1) if hi > lo else np.zeros(len(d), np.int64)


def percentile_of_distances(points: DataFrame, share: float, metric: str, *, bins: int = 1 << 16, few: int = 2000) -> float:
    """The exact percentile of the positive distances of all pairs, between two ranks in proportion; 0 if there are none. A sample of points tells where it may lie;
    all pairs are then counted, under that stretch and in parts of it, and once more for the values of the part that holds it. A stretch that doesn't hold it is widened."""
    own = materialize(_points(points), "points")
    n = own.count()
    rows = own.select("x", F.xxhash64("id").alias("h")).orderBy("h").limit(few).collect()
    x = np.array([r.x for r in rows], float)
    some = np.sort(np.concatenate([pairwise(x[i : i + 1], x[i + 1 :], metric)[0] for i in range(len(x))]))
    some = some[some > 0]
    if not len(some):
        some = np.array([0.0])

    def counted(lo: float, hi: float, keep: bool) -> np.ndarray:
        start = lambda ids, x, g: _Counts(ids, x, metric, lo, hi, bins, keep)
        return streamed(own, own, n, n, start, "bin long, value double, n long").groupBy("bin", "value").agg(F.sum("n").alias("n")).toPandas()

    far = counted(np.inf, np.inf, False)
    total = int(far["n"].sum())
    if not total:
        return 0.0
    at = share * (total - 1)
    margin = 0.01
    while True:
        lo, hi = (float(np.quantile(some, min(max(share + s * margin, 0), 1))) for s in (-1, 1))
        lo, hi = (0.0 if share - margin <= 0 else lo), (np.inf if share + margin >= 1 else hi)
        hi = hi if np.isfinite(hi) else float(np.finfo(float).max)
        got = counted(lo, hi, False)
        under = int(got.loc[got["bin"] < 0, "n"].sum())
        inside = np.bincount(got.loc[got["bin"] >= 0, "bin"], got.loc[got["bin"] >= 0, "n"], bins)
        if under <= at and np.ceil(at) < under + inside.sum():
            break
        margin *= 4
    ranks = under + np.cumsum(inside)
    first, last = int(np.searchsorted(ranks, np.floor(at), "right")), int(np.searchsorted(ranks, np.ceil(at), "right"))
    edge = lambda k: lo + (hi - lo) * k / bins
    a, b = max(lo, edge(first - 0.01)), min(hi, edge(last + 1.01))
    got = counted(a, b, True)
    under = int(got.loc[got["bin"] < 0, "n"].sum())
    values = got.loc[got["bin"] >= 0].sort_values("value")
    ranks, values = under + np.cumsum(values["n"].to_numpy()), values["value"].to_numpy()
    pick = lambda k: float(values[np.searchsorted(ranks, k, "right")])
    low, high = pick(np.floor(at)), pick(np.ceil(at))
    return low + (high - low) * (at - np.floor(at))
