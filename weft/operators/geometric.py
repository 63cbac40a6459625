"""Networks of points by empty regions: Delaunay, Urquhart, Gabriel, relative neighbourhood."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.metrics import Metric, canonical, pairwise
from weft.graph import Graph
from weft.plans.tables import materialize

from .neighbors import _points, all_pairs, blocked, neighbors, stacked

TOLERANCE = 1e-10
#: Points of a triangulation, which is held on the driver.
PLANE_POINTS = 1_000_000
#: Nearest neighbours that are tried before all points.
TRIED = 12


def _graph(points: DataFrame, half: DataFrame, weighted: bool) -> Graph:
    both = half.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("d").alias("weight"))
    both = both.union(both.select("dst", "src", "weight"))
    return Graph(points.select("id"), both, weighted=weighted, symmetric=not weighted)


def _ends(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """``id, a, b, d, xa, xb`` of pairs."""
    own = _points(points)
    out = pairs.join(own.select(F.col("id").alias("a"), F.col("x").alias("xa")), "a").join(own.select(F.col("id").alias("b"), F.col("x").alias("xb")), "b")
    return out.select(F.xxhash64("a", "b").alias("id"), "a", "b", "d", "xa", "xb")


def _breaks(broken):
    """The kernel that names the pairs that some point breaks."""

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = left["a"].to_numpy(), left["b"].to_numpy()
        bad = np.zeros(len(a), bool)
        if len(a) and right.num_rows:
            xa, xb, d, y, ids = stacked(left["xa"]), stacked(left["xb"]), left["d"].to_numpy(), stacked(right["x"]), right["id"].to_numpy()
            step = max(1, 4_000_000 // len(y))
            for lo in range(0, len(a), step):
                s = slice(lo, lo + step)
                other = (ids[None, :] != a[s, None]) & (ids[None, :] != b[s, None])
                bad[s] = (broken(xa[s], xb[s], d[s], y) & other).any(1)
        return pa.table([pa.array(a[bad]), pa.array(b[bad])], ["a", "b"])

    return kernel


def _without(points: DataFrame, metric: Metric, broken) -> DataFrame:
    """``a, b, d`` of the pairs that no point breaks: ``broken(xa, xb, d, points)`` says for blocks of pairs and points which are."""

    pairs = _sides(points) if metric == "euclidean" else None
    if pairs is not None:
        return _without_near(points, pairs, broken)
    pairs = all_pairs(points, metric)
    gone = blocked(_ends(points, pairs), _points(points), _breaks(broken), "a long, b long")
    return pairs.join(gone.distinct(), ["a", "b"], "left_anti")


def _without_near(points: DataFrame, pairs: DataFrame, broken) -> DataFrame:
    """``_without`` for sides of a triangulation: a pair is tried against the points nearest to its middle. Those of which one breaks it go; those whose nearest points reach
    beyond both ends' circles have met all that could break them; only the others, as long sides of the hull, meet all points."""
    ends = materialize(_ends(points, pairs), "ends")
    middle = ends.select("id", F.transform(F.arrays_zip("xa", "xb"), lambda v: (v["xa"] + v["xb"]) / 2).alias("x"))
    own = _points(points)
    found = neighbors(middle, own, k=TRIED).select(F.col("qid").alias("id"), F.col("tid"), "dist").join(own.select(F.col("id").alias("tid"), F.col("x").alias("y")), "tid")

    def kernel(t: pa.Table) -> pa.Table:
        xa, xb, d, y = stacked(t["xa"].slice(0, 1)), stacked(t["xb"].slice(0, 1)), t["d"].to_numpy()[:1], stacked(t["y"])
        tid, a, b = t["tid"].to_numpy(), t["a"][0].as_py(), t["b"][0].as_py()
        bad = bool((broken(xa, xb, d, y)[0] & (tid != a) & (tid != b)).any())
        # a point nearer to both ends than they are to each other lies within sqrt(3) / 2 of their distance from the middle
        seen = len(tid) < TRIED or t["dist"].to_numpy().max() > 0.8661 * d[0] * (1 + 1e-9)
        return pa.table([pa.array([a]), pa.array([b]), pa.array([bad]), pa.array([seen])], ["a", "b", "bad", "seen"])

    tried = materialize(ends.join(found, "id").groupBy("id").applyInArrow(kernel, "a long, b long, bad boolean, seen boolean"), "tried")
    kept = pairs.join(tried.where("NOT bad"), ["a", "b"])
    rest = materialize(kept.where("NOT seen").select("a", "b", "d"), "open")
    if not rest.take(1):
        return kept.select("a", "b", "d")
    gone = blocked(_ends(points, rest), own, _breaks(broken), "a long, b long")
    return kept.where("seen").select("a", "b", "d").union(rest.join(gone.distinct(), ["a", "b"], "left_anti"))


def _sides(points: DataFrame) -> DataFrame | None:
    """``a, b, d``: in the plane only sides of the triangulation can have nothing in between; None where that doesn't apply (other
    dimensions, points that coincide, or too many for it)."""
    head = points.limit(PLANE_POINTS + 1).select(F.size("x").alias("n"), "x").agg(F.count("*").alias("n"), F.count_distinct("x").alias("k"), F.min("n").alias("lo"), F.max("n").alias("hi")).first()
    if head.lo != 2 or head.hi != 2 or head.n > PLANE_POINTS or head.k < head.n:
        return None
    return materialize(_triangle_edges(points).select("a", "b", "d").distinct(), "sides")


def gabriel_graph(points: DataFrame, *, metric: Metric = "euclidean", weighted: bool = False) -> Graph:
    """Pairs with no point nearer to their middle than themselves."""
    metric = metric if callable(metric) else canonical(metric)
    broken = lambda xa, xb, d, y: d[:, None] - 2 * pairwise((xa + xb) / 2, y, metric) >= TOLERANCE
    return _graph(points, _without(points, metric, broken), weighted)


def relative_neighborhood_graph(points: DataFrame, *, metric: Metric = "euclidean", weighted: bool = False) -> Graph:
    """Pairs with no point nearer to both than they are to each other."""
    metric = metric if callable(metric) else canonical(metric)
    broken = lambda xa, xb, d, y: np.maximum(pairwise(xa, y, metric), pairwise(xb, y, metric)) < d[:, None]
    return _graph(points, _without(points, metric, broken), weighted)


def _turn(a, b, c) -> float:
    """Positive if a, b, c turn left; exact sign."""
    left, right = (a[0] - c[0]) * (b[1] - c[1]), (a[1] - c[1]) * (b[0] - c[0])
    out = left - right
    if abs(out) > 4e-16 * (abs(left) + abs(right)):
        return out
    (ax, ay), (bx, by), (cx, cy) = ((Fraction(v[0]), Fraction(v[1])) for v in (a, b, c))
    out = (ax - cx) * (by - cy) - (ay - cy) * (bx - cx)
    return 1.0 if out > 0 else -1.0 if out < 0 else 0.0


def _inside(a, b, c, d) -> bool:
    """Whether d lies inside the circle through a, b, c, which turn left; exact."""
    ax, ay, bx, by, cx, cy = a[0] - d[0], a[1] - d[1], b[0] - d[0], b[1] - d[1], c[0] - d[0], c[1] - d[1]
    bc, cb, ca, ac, ab, ba = bx * cy, cx * by, cx * ay, ax * cy, ax * by, bx * ay
    la, lb, lc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    out = la * (bc - cb) + lb * (ca - ac) + lc * (ab - ba)
    if abs(out) > 1.2e-15 * (la * (abs(bc) + abs(cb)) + lb * (abs(ca) + abs(ac)) + lc * (abs(ab) + abs(ba))):
        return out > 0
    (ax, ay), (bx, by), (cx, cy) = ((Fraction(v[0]) - Fraction(d[0]), Fraction(v[1]) - Fraction(d[1])) for v in (a, b, c))
    la, lb, lc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    return la * (bx * cy - cx * by) + lb * (cx * ay - ax * cy) + lc * (ax * by - bx * ay) > 0


def _insertion_order(x: np.ndarray) -> list[int]:
    """Places of points in random rounds that double; within a round along rows of cells, there and back, so that each is near the one before."""
    shuffled, out = np.random.default_rng(0).permutation(len(x)), []
    low, wide = x.min(0), np.maximum(np.ptp(x, axis=0), 1e-300)
    hi = len(x)
    while hi:
        lo = hi // 2 if hi > 64 else 0
        part = shuffled[lo:hi]
        side = max(1, int(np.sqrt(len(part) / 2)))
        row, along = np.minimum((x[part, 1] - low[1]) / wide[1] * side, side - 1).astype(int), (x[part, 0] - low[0]) / wide[0]
        out.append(part[np.lexsort((np.where(row % 2, -along, along), row))])
        hi = lo
    return np.concatenate(out[::-1]).tolist()


def triangulate(x: np.ndarray) -> np.ndarray:
    """Delaunay triangles of points in the plane, by inserting one after the other near the one before: triangles whose circle holds the new point make way for those of their
    outline with it. Sides of the hull have a triangle with a vertex at infinity (-1). Signs are exact. Points that coincide with an earlier one are left out."""
    if x.shape[1] != 2:
        raise ValueError("triangulation is for points in the plane")
    kept = np.sort(np.unique(x, axis=0, return_index=True)[1]) if len(x) else np.zeros(0, np.int64)
    if len(kept) < 3:
        return np.zeros((0, 3), np.int64)
    order = [int(kept[i]) for i in _insertion_order(x[kept])]
    p = [tuple(v) for v in x.tolist()]
    a, b = order[:2]
    c = next((v for v in order[2:] if _turn(p[a], p[b], p[v]) != 0), None)
    if c is None:
        return np.zeros((0, 3), np.int64)  # all on a line
    if _turn(p[a], p[b], p[c]) < 0:
        a, b = b, a
    apex: dict[tuple[int, int], int] = {}  # third vertex to the left of a directed side

    def put(u: int, v: int, w: int) -> None:
        apex[u, v], apex[v, w], apex[w, u] = w, u, v

    put(a, b, c)
    for u, v in ((b, a), (c, b), (a, c)):
        put(u, v, -1)

    def holds(u: int, v: int, w: int, q: tuple) -> bool:
        if -1 not in (u, v, w):
            return _inside(p[u], p[v], p[w], q)
        while w != -1:
            u, v, w = v, w, u
        side = _turn(p[u], p[v], q)
        if side:
            return side > 0
        low, high = sorted((p[u], p[v]))  # on the hull's line: between its ends
        return low < q < high

    now = (a, b)
    for i in order[2:]:
        if i == c:
            continue
        q = p[i]
        u, v = now
        w = apex[u, v]
        while w != -1:  # walk towards the point
            if _turn(p[u], p[v], q) < 0:
                u, v = v, u
            elif _turn(p[v], p[w], q) < 0:
                u, v = w, v
            elif _turn(p[w], p[u], q) < 0:
                u, v = u, w
            else:
                break
            w = apex[u, v]
        if w == -1:  # outside: along the hull to a side that sees the point
            while not holds(u, v, w, q):
                u, v = v, apex[-1, v]
        gone, outline = [(u, v, w)], []
        for s, t in ((u, v), (v, w), (w, u)):
            del apex[s, t]
        sides = [(u, v), (v, w), (w, u)]
        while sides:
            s, t = sides.pop()
            r = apex.get((t, s))
            if r is None:
                continue  # between two that make way
            if holds(t, s, r, q):
                gone.append((t, s, r))
                for e in ((t, s), (s, r), (r, t)):
                    del apex[e]
                sides += [(s, r), (r, t)]
            else:
                outline.append((s, t))
        for s, t in outline:
            put(s, t, i)
        now = next((s, t) for s, t in outline if s != -1 and t != -1)
    return np.array([(u, v, w) for (u, v), w in apex.items() if -1 < u < v and u < w], np.int64).reshape(-1, 3)


def _triangle_edges(points: DataFrame) -> DataFrame:
    """``t, a, b, d``: the sides of the Delaunay triangles, made on the driver; bounded by ``PLANE_POINTS`` points."""
    rows = points.select("id", F.col("x").cast("array<double>").alias("x")).limit(PLANE_POINTS + 1).toArrow()
    if rows.num_rows > PLANE_POINTS:
        raise ValueError(f"triangulation is limited to {PLANE_POINTS} points")
    order = np.argsort(rows["id"].to_numpy(), kind="stable")
    ids, x = rows["id"].to_numpy()[order].astype(np.int64), stacked(rows["x"])[order]
    tri = triangulate(x)
    a, b = np.minimum(tri, np.roll(tri, -1, 1)).ravel(), np.maximum(tri, np.roll(tri, -1, 1)).ravel()
    d = np.sqrt(((x[a] - x[b]) ** 2).sum(1))
    low, high = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
    table = pa.table([pa.array(np.repeat(np.arange(len(tri)), 3)), pa.array(low), pa.array(high), pa.array(d)], ["t", "a", "b", "d"])
    return points.sparkSession.createDataFrame(table, "t long, a long, b long, d double")


def delaunay_graph(points: DataFrame, *, weighted: bool = False) -> Graph:
    """Sides of the Delaunay triangles of points in the plane, both ways."""
    return _graph(points, _triangle_edges(points).select("a", "b", "d").distinct(), weighted)


def urquhart_graph(points: DataFrame, *, weighted: bool = False) -> Graph:
    """Delaunay without the longest side of each triangle; a side stays if either of its triangles keeps it."""
    sides = _triangle_edges(points)
    longest = sides.groupBy("t").agg(F.max_by(F.struct("a", "b"), F.struct("d", F.col("a"), F.col("b"))).alias("m"))
    kept = sides.join(longest, "t").where((F.col("a") != F.col("m.a")) | (F.col("b") != F.col("m.b")))
    return _graph(points, kept.select("a", "b", "d").distinct(), weighted)
