"""Nearest neighbours and neighbour networks, exact, in blocks of points.

Points are dealt into blocks; each pair of a query block and a target block is one NumPy kernel with bounded memory, which keeps
the best of its pairs only. Blocks meet through a shuffle of points, never of pairs. Where there are several blocks and the metric obeys the triangle inequality,
blocks are cells around pivots (``cells``): each meets itself first, which bounds how far its neighbours can be, and then only those that may hold something
nearer. Where cells keep nothing apart, as for points in many dimensions, and for cosine, all points meet all in streams behind a screen (``scan``). Metrics of
the user's own let all blocks meet.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.metrics import Metric, canonical, pairwise
from weft.graph import Graph
from weft.plans.tables import materialize

from .cells import BOUNDED, brought_together, cells, gain, meetings, spread
from .scan import SCREENED, Nearest, scanned, stacked

BLOCK = 4096


def blocked(query: DataFrame, targets: DataFrame, kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str, *, block: int = BLOCK) -> DataFrame:
    """``kernel`` over each pair of a block of ``query`` and one of ``targets``, a group of its own; both need a column ``id``."""
    n = query.count()
    nq, nt = max(1, math.ceil(n / block)), max(1, math.ceil(targets.count() / block))
    nq = max(nq, min(query.sparkSession.sparkContext.defaultParallelism, n // 256))  # few points still keep all cores busy
    several = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = query.withColumn("_q", F.pmod(F.xxhash64("id"), F.lit(nq)).cast("int")).withColumn("_t", several(nt))
    right = targets.withColumn("_t", F.pmod(F.xxhash64("id"), F.lit(nt)).cast("int")).withColumn("_q", several(nq))
    return left.groupBy("_q", "_t").cogroup(right.groupBy("_q", "_t")).applyInArrow(lambda a, b: kernel(a, b), schema)


def _points(points: DataFrame) -> DataFrame:
    return points.select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x"))


def neighbors(query: DataFrame, targets: DataFrame, *, metric: Metric = "euclidean", k: int | None = None, epsilon: float | None = None, exclude_self: bool = False, positive: bool = False, block: int = BLOCK) -> DataFrame:
    """``qid, tid, dist, rank``: for each query point its k nearest targets, those with ``dist <= epsilon``, or both; ties go to the
    smaller id; ``rank`` counts from 1. ``positive``: targets that coincide with the query don't count (for metrics of ``SCREENED``)."""
    metric = metric if callable(metric) else canonical(metric)

    def kernel(a: pa.Table, b: pa.Table) -> pa.Table:
        qid, tid = a["id"].to_numpy(), b["id"].to_numpy()
        out = [[], [], []]
        if len(qid) and len(tid) and metric in SCREENED and epsilon != math.inf:
            best = Nearest(qid, stacked(a["x"]), metric, k=k, epsilon=epsilon, group=qid if exclude_self else None, positive=positive)
            parts = [*best.add(tid, stacked(b["x"]), tid if exclude_self else None)]
            out = [list(c) for c in zip(*(parts if k is None else [best.found()[:3]]), strict=True)] or out
        elif len(qid) and len(tid):
            order = np.argsort(tid, kind="stable")
            tid = tid[order]
            x, y = stacked(a["x"]), stacked(b["x"])[order]
            step = max(1, 8_000_000 // len(tid))
            for lo in range(0, len(qid), step):
                d = pairwise(x[lo : lo + step], y, metric)
                ok = np.ones(d.shape, bool) if epsilon is None else d <= epsilon
                if exclude_self:
                    ok &= qid[lo : lo + step, None] != tid[None, :]
                if k is None:
                    i, j = ok.nonzero()
                else:
                    top = np.argsort(np.where(ok, d, np.inf), axis=1, kind="stable")[:, :k]
                    i = np.repeat(np.arange(len(d)), top.shape[1])
                    j = top.ravel()
                    i, j = i[ok[i, j]], j[ok[i, j]]
                out[0].append(qid[lo + i])
                out[1].append(tid[j])
                out[2].append(d[i, j])
        cols = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table([pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int64)), pa.array(cols[2].astype(float))], ["qid", "tid", "dist"])

    schema = "qid long, tid long, dist double"
    n = targets.count()
    whole = lambda q, t: _ranked(scanned(q, t, metric, k=k, epsilon=epsilon, n=q.count(), n_targets=n, apart=exclude_self, positive=positive), k)
    if metric in SCREENED and epsilon != math.inf and (n <= block or metric not in BOUNDED or not gain(_points(targets), n, metric, block)):
        own = materialize(_points(targets), "targets")
        return whole(own if query is targets else _points(query), own)
    if n <= block or metric not in BOUNDED or epsilon == math.inf:
        return _ranked(blocked(_points(query), _points(targets), kernel, schema, block=block), k)
    same = query is targets
    targets = materialize(_points(targets), "targets")
    own = cells(targets, n, metric, block)
    targets = materialize(own.dealt(targets), "target-blocks")
    query = targets.toDF(*targets.columns) if same else materialize(own.dealt(_points(query)), "query-blocks")
    shape_q, shape_t = spread(query), spread(targets)
    root = math.sqrt if metric == "sqeuclidean" else float
    reach = np.full(len(shape_q[0]), np.inf if epsilon is None else root(epsilon))
    found = None
    if k is not None:
        first = query.groupBy("block").cogroup(targets.groupBy("block")).applyInArrow(lambda a, b: kernel(a, b), schema)
        found = materialize(first, "near")
        far = found.groupBy("qid").agg(F.max("dist").alias("far"), F.count("*").alias("n"))
        far = query.select(F.col("id").alias("qid"), "block").join(far, "qid", "left")
        far = far.groupBy("block").agg(F.max(F.when(F.col("n") >= k, F.col("far")).otherwise(F.lit(math.inf))).alias("far"))
        known = {r.block: root(r.far) for r in far.collect()}  # one row a block
        reach = np.minimum(reach, [known.get(b, math.inf) for b in shape_q[0].tolist()])
    pairs = meetings(own, shape_q, shape_t, reach, apart=k is not None)
    if 2 * len(pairs) > len(shape_q[0]) * len(shape_t[0]):  # nothing to gain: fewer, larger blocks copy less
        query, targets = (t.select("id", "x") for t in (query, targets))
        if metric in SCREENED:
            return whole(query, targets)
        return _ranked(blocked(query, targets, kernel, schema, block=block), k)
    left, right = brought_together(query, targets, pairs)
    rest = left.groupBy("_q", "_t").cogroup(right.groupBy("_q", "_t")).applyInArrow(lambda a, b: kernel(a, b), schema)
    return _ranked(rest if found is None else found.union(rest), k)


def _ranked(found: DataFrame, k: int | None) -> DataFrame:
    near = Window.partitionBy("qid").orderBy("dist", "tid")
    out = found.withColumn("rank", F.row_number().over(near).cast("long"))
    return out if k is None else out.where(F.col("rank") <= k)


def nearest_neighbors(query: DataFrame, targets: DataFrame | None = None, *, metric: Metric = "euclidean", k: int | None = None, epsilon: float | None = None, precomputed: bool = False) -> DataFrame:
    """``qid, tid, dist``. Without targets all points are held against all, themselves included. Precomputed: ``query`` has ``i, j, d``
    rows, in which a point's distance to itself counts if it is there."""
    _check(k, epsilon)
    if precomputed or metric == "precomputed":
        if targets is not None:
            raise ValueError("precomputed distances have no targets")
        own = query.select(F.col("i").alias("qid"), F.col("j").alias("tid"), F.col("d").cast("double").alias("dist"))
        own = own if epsilon is None else own.where(F.col("dist") <= epsilon)
        return _ranked(own, k).select("qid", "tid", "dist")
    return neighbors(query, query if targets is None else targets, metric=metric, k=k, epsilon=epsilon).select("qid", "tid", "dist")


def _check(k: int | None, epsilon: float | None, weighting: str = "none") -> None:
    if k is None and epsilon is None:
        raise ValueError("k or epsilon is needed")
    if k is not None and k < 1:
        raise ValueError("k is at least 1")
    if weighting not in ("none", "binary"):
        raise ValueError(f"weighting is none or binary, not {weighting!r}")


def neighbor_graph(points: DataFrame, *, metric: Metric = "euclidean", k: int | None = None, epsilon: float | None = None, weighting: str = "none", precomputed: bool = False, vertices: DataFrame | None = None) -> Graph:
    """Edges to the k nearest others, to those within epsilon, or to those that are both. They weigh their distance (so points that
    coincide have no edge) or 1 with ``weighting="binary"``. Precomputed: ``points`` are ``i, j, d`` rows."""
    _check(k, epsilon, weighting)
    if precomputed or metric == "precomputed":
        found = nearest_neighbors(points.where("i <> j"), k=k, epsilon=epsilon, precomputed=True)
        vertices = vertices if vertices is not None else points.select(F.col("i").alias("id")).union(points.select("j")).distinct()
    else:
        found = neighbors(points, points, metric=metric, k=k, epsilon=epsilon, exclude_self=True)
        vertices = points.select("id")
    weight = F.lit(1.0) if weighting == "binary" else F.col("dist")
    return Graph(vertices, found.select(F.col("qid").alias("src"), F.col("tid").alias("dst"), weight.alias("weight")))


def all_pairs(points: DataFrame, metric: Metric = "euclidean") -> DataFrame:
    """``a, b, d`` with a < b: all distances. Quadratic by its meaning, for operators on small sets."""
    own = neighbors(points, points, metric=metric, epsilon=math.inf)
    return own.where("qid < tid").select(F.col("qid").alias("a"), F.col("tid").alias("b"), F.col("dist").alias("d"))
