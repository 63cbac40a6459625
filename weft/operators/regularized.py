"""Networks by sparse coding: each point is made up of few others; a small problem for each point, in groups of a table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.metrics import Metric
from weft.graph import Graph

from .neighbors import _points, neighbors, stacked

MAX_ROUNDS, TOLERANCE = 1000, 1e-4


def lasso(a: np.ndarray, y: np.ndarray, alpha: float, *, positive: bool = False, scaled: bool = False, tol: float = TOLERANCE) -> np.ndarray:
    """Minimises |y - A w|^2 / 2m + alpha |w|_1 over centred columns, by coordinates, until neither the largest step nor the duality gap
    is beyond the tolerance. ``scaled``: columns count by their length."""
    m = len(y)
    a, y = a - a.mean(0), y - y.mean()
    size = np.sqrt((a * a).sum(0))
    if scaled:
        a = a / np.where(size > 0, size, 1)
    square, w, r, cut = (a * a).sum(0), np.zeros(a.shape[1]), y.copy(), alpha * m
    if scaled:
        tol = 1e-9
    for _ in range(MAX_ROUNDS if not scaled else 20 * MAX_ROUNDS):
        step = 0.0
        for j in np.flatnonzero(square > 0):
            old = w[j]
            rho = a[:, j] @ r + old * square[j]
            w[j] = max(rho - cut, 0) / square[j] if positive else np.sign(rho) * max(abs(rho) - cut, 0) / square[j]
            if w[j] != old:
                r += a[:, j] * (old - w[j])
            step = max(step, abs(w[j] - old))
        top = np.abs(w).max(initial=0)
        if top == 0 or step / top < tol:
            slope = a.T @ r
            worst = slope.max() if positive else np.abs(slope).max()
            shrink = min(1.0, cut / worst) if worst > 0 else 1.0
            gap = 0.5 * (r @ r) * (1 + shrink * shrink) + cut * np.abs(w).sum() - shrink * (r @ y)
            if gap < tol * (y @ y):
                break
    return w / np.where(size > 0, size, 1) if scaled else w


def lasso_cv(a: np.ndarray, y: np.ndarray, folds: int, *, positive: bool = False, scaled: bool = False, grid: int = 100, least: float = 1e-3) -> np.ndarray:
    """``lasso`` with the penalty, of a geometric grid down from the one that leaves nothing, that errs least on held-out stretches of
    rows."""
    m = len(y)
    centred = a - a.mean(0)
    size = np.sqrt((centred * centred).sum(0))
    slope = (centred / np.where(size > 0, size, 1) if scaled else centred).T @ (y - y.mean()) / m
    top = max(float(slope.max() if positive else np.abs(slope).max()), 1e-12)
    alphas, cuts = top * np.logspace(0, np.log10(least), grid), np.array_split(np.arange(m), folds)
    error = np.zeros(grid)
    for hold in cuts:
        rest = np.setdiff1d(np.arange(m), hold)
        for i, alpha in enumerate(alphas):
            w = lasso(a[rest], y[rest], alpha, positive=positive, scaled=scaled)
            b = y[rest].mean() - a[rest].mean(0) @ w
            error[i] += ((y[hold] - a[hold] @ w - b) ** 2).mean()
    return lasso(a, y, float(alphas[error.argmin()]), positive=positive, scaled=scaled)


def _candidates(points: DataFrame, k: int | None, metric: Metric = "euclidean") -> DataFrame:
    """``src, xs, dst, xd, dist`` for each point and its k nearest others (all, if None), one group for each source."""
    own = _points(points)
    found = neighbors(own, own, metric=metric, k=k, epsilon=None if k is not None else float("inf"), exclude_self=True)
    found = found.select(F.col("qid").alias("src"), F.col("tid").alias("dst"), "dist")
    return found.join(own.select(F.col("id").alias("src"), F.col("x").alias("xs")), "src").join(own.select(F.col("id").alias("dst"), F.col("x").alias("xd")), "dst")


def sparse_regularized_graph(points: DataFrame, *, positive: bool = False, sparsity_param: float | None = None, kmax: int | None = None) -> Graph:
    """Edges weigh a point's share in the sparse code of another over all others (or its ``kmax`` nearest) and the unit vectors; points are scaled to length
    1. Codes are positive if asked for. Without a penalty it is chosen by cross-validation, which is slow."""
    own = _points(points)
    n, d = own.count(), own.agg(F.max(F.size("x"))).first()[0] or 0
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    unit = own.select("id", F.transform("x", lambda v: v / length).alias("x"))
    scaled = not positive and d >= n
    folds = min(d, 3)

    def solve(t: pa.Table) -> pa.Table:
        order = np.argsort(t["dst"].to_numpy())
        x, b = stacked(t["xs"])[0], stacked(t["xd"])[order]
        a = np.vstack([b, np.eye(len(x))]).T
        w = lasso_cv(a, x, folds, positive=positive, scaled=scaled) if sparsity_param is None else lasso(a, x, sparsity_param, positive=positive, scaled=scaled)
        w = np.abs(w[: len(b)])
        keep = np.flatnonzero(w)
        return pa.table([t["src"].take(pa.array(order[keep])), t["dst"].take(pa.array(order[keep])), pa.array(w[keep] / w.sum() if len(keep) else w[keep])], ["src", "dst", "weight"])

    pairs = _candidates(unit, kmax)
    return Graph(own.select("id"), pairs.groupBy("src").applyInArrow(solve, "src long, dst long, weight double"))


def affine_code(y: np.ndarray, penalty: np.ndarray, *, tol: float = 1e-9, max_moves: int = 100_000) -> np.ndarray:
    """Affine sparse code: the c with sum 1 at which |c'Y|^2 / 2 + sum of penalty |c| is least.

    Begins with the best single share and moves weight from one share to another, the two for which that pays most at the margin, as far as it pays or until one
    of them is 0, where the penalty turns. The sum stays 1; where no move pays, none of several does.
    """
    gram = y @ y.T
    size = np.diag(gram)
    c = np.zeros(len(y))
    c[np.argmin(size / 2 + penalty)] = 1.0
    slope = gram @ c
    for _ in range(max_moves):
        more = slope + np.where(c >= 0, penalty, -penalty)  # what a little more of each costs, and a little less gives
        less = slope + np.where(c > 0, penalty, -penalty)
        i, j = int(more.argmin()), int(less.argmax())
        gain = less[j] - more[i]
        if gain <= tol * (1 + abs(more[i])):
            break
        curve = size[i] + size[j] - 2 * gram[i, j]
        step = gain / curve if curve > 0 else np.inf
        if c[i] < 0:
            step = min(step, -c[i])
        if c[j] > 0:
            step = min(step, c[j])
        if not np.isfinite(step):
            break
        slope += step * (gram[i] - gram[j])
        c[i], c[j] = (0.0 if c[i] == -step else c[i] + step), (0.0 if c[j] == step else c[j] - step)
    return c


def smce_graph(points: DataFrame, *, metric: Metric = "l2", sparsity_param: float = 10, kmax: int | None = None, keep_ratio: float = 0.95) -> Graph:
    """Edges weigh a neighbour's share in the sparse affine code of the directions to ``kmax`` neighbours (a tenth of all, 5 at least), near ones
    being cheaper; of each vertex the heaviest stay, until they reach ``keep_ratio``."""
    n = points.count()
    k = min(n - 1, max(5, n // 10)) if kmax is None else kmax

    def solve(t: pa.Table) -> pa.Table:
        q = t["dist"].to_numpy()
        c = np.abs(affine_code((stacked(t["xd"]) - stacked(t["xs"])) / q[:, None], sparsity_param * q / q.sum()) / q)
        keep = np.flatnonzero(c)
        return pa.table([t["src"].take(pa.array(keep)), t["dst"].take(pa.array(keep)), pa.array(c[keep] / c.sum())], ["src", "dst", "weight"])

    edges = _candidates(points, k, metric).groupBy("src").applyInArrow(solve, "src long, dst long, weight double")
    if keep_ratio < 1:
        before = Window.partitionBy("src").orderBy(F.desc("weight"), "dst").rowsBetween(Window.unboundedPreceding, -1)
        edges = edges.withColumn("_b", F.coalesce(F.sum("weight").over(before), F.lit(0.0))).where(F.col("_b") < keep_ratio).drop("_b")
    return Graph(points.select("id"), edges)
