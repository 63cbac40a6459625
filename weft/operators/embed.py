"""Embeddings and layouts. Spectral ones are dense problems, bounded by ``LOCAL_VERTICES``; linear ones reduce to d x d sums first."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.graph import Graph
from weft.plans.linalg import LOCAL_VERTICES, bounded, coo_to_numpy, from_numpy, gram, null_space, points_to_numpy, times_transposed, to_dense
from weft.plans.sparse import Local, eigenvectors, lanczos
from weft.plans.tables import materialize

from .analysis import laplacian, shortest_path
from .scan import stacked
from .transform import barycenter_edge_weights


def isomap(graph: Graph, *, num_dims: int | None = None, directed: bool | None = None) -> DataFrame:
    """``id, coords``: leading eigenvectors of the centred squares of all distances, by the roots of their eigenvalues."""
    n = bounded(graph.num_vertices())
    d = np.full((n, n), np.inf)
    rows = shortest_path(graph, directed=directed).select("src", "dst", "dist").toPandas()
    d[rows["src"], rows["dst"]] = rows["dist"]
    k = -0.5 * d**2
    k = k - k.mean(0)[None, :] - k.mean(1)[:, None] + k.mean()
    values, vectors = np.linalg.eigh(k)
    order = np.argsort(-values)[: n if num_dims is None else num_dims]
    order = order[values[order] > 1e-12]
    return from_numpy(graph.edges.sparkSession, vectors[:, order] * np.sqrt(values[order]))


def centred_distances(graph: Graph, *, directed: bool | None = None) -> DataFrame:
    """``i, j, value``: squares of all distances, times -1/2, less the means of their row and column, plus that of all; of
    connected networks."""
    own = shortest_path(graph, directed=directed).select(F.col("src").alias("i"), F.col("dst").alias("j"), (-0.5 * F.col("dist") * F.col("dist")).alias("v"))
    rows, cols = own.groupBy("i").agg(F.avg("v").alias("r")), own.groupBy("j").agg(F.avg("v").alias("c"))
    mean = own.agg(F.avg("v").alias("m"))
    return own.join(rows, "i").join(cols, "j").join(F.broadcast(mean)).select("i", "j", (F.col("v") - F.col("r") - F.col("c") + F.col("m")).alias("value"))


def laplacian_eigenmaps(graph: Graph, *, num_dims: int | None = None, normed: bool = True, val_thresh: float = 1e-8) -> DataFrame:
    """``id, coords``: eigenvectors of the Laplacian by ascending eigenvalue, those up to the threshold left out.

    Beyond ``LOCAL_VERTICES`` vertices ``num_dims`` must be given, and the vectors come from Lanczos' method over tables.
    """
    if graph.num_vertices() > LOCAL_VERTICES and num_dims is not None:
        return _lanczos(laplacian(graph, normed=normed), graph.vertices, num_dims, val_thresh)
    m = coo_to_numpy(laplacian(graph, normed=normed), graph.num_vertices())
    return from_numpy(graph.edges.sparkSession, null_space((m + m.T) / 2, num_dims, val_thresh))


def _lanczos(cells: DataFrame, vertices: DataFrame, num_dims: int, threshold: float = 1e-8) -> DataFrame:
    """``id, coords`` of the smallest eigenvalues beyond the threshold; more are computed until there are enough."""
    both = cells.select("i", "j", (F.col("value") / 2).alias("value"))
    both = both.union(both.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")).groupBy("i", "j").agg(F.sum("value").alias("value"))
    both, want = materialize(both, "symmetric"), num_dims + 1
    while True:
        values, found = eigenvectors(both, vertices, want)
        skip = int(np.searchsorted(values, threshold))
        if len(values) - skip >= num_dims or len(values) < want:
            return found.select("id", F.slice("coords", skip + 1, num_dims).alias("coords"))
        want += num_dims


def _dims(points: DataFrame) -> int:
    return points.agg(F.max(F.size("x"))).first()[0]


def locality_preserving_projections(graph: Graph, points: DataFrame, *, num_dims: int | None = None) -> np.ndarray:
    """Projection d x k by which neighbours stay near: only d x d sums reach the driver."""
    d = _dims(points)
    u, s, _ = np.linalg.svd(gram(points, None, d))
    f = np.linalg.pinv(u * np.sqrt(s))
    t = f @ gram(points, laplacian(graph, normed=True), d) @ f.T
    return null_space((t + t.T) / 2, num_dims)


def lle_matrix(graph: Graph) -> DataFrame:
    """``i, j, value`` of (I - W)'(I - W)."""
    w = graph.matrix()
    minus = w.select("i", "j", (-F.col("value")).alias("value"))
    eye = graph.vertices.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("value"))
    parts = times_transposed(w).union(minus).union(minus.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")).union(eye)
    return parts.groupBy("i", "j").agg(F.sum("value").alias("value"))


def locally_linear_embedding(graph: Graph, *, num_dims: int | None = None) -> DataFrame:
    """``id, coords`` that the graph's weights (see ``barycenter_edge_weights``) make up best from each other. Beyond ``LOCAL_VERTICES`` vertices by Lanczos' method,
    ``num_dims`` being given."""
    if graph.num_vertices() > LOCAL_VERTICES and num_dims is not None:
        return _lanczos(lle_matrix(graph), graph.vertices, num_dims)
    return from_numpy(graph.edges.sparkSession, null_space(coo_to_numpy(lle_matrix(graph), graph.num_vertices()), num_dims))


def _left_over(graph: Graph, points: DataFrame) -> DataFrame:
    """``x`` of (I - W) X: each point less what its edges' targets make up; X'MX is the sum of its products, with a row for each point and not for each cell of M."""
    ends = graph.matrix().select(F.col("i").alias("id"), F.col("j"), (-F.col("value")).alias("value"))
    ends = ends.union(graph.vertices.select("id", F.col("id").alias("j"), F.lit(1.0).alias("value")))
    ends = ends.join(points.select(F.col("id").alias("j"), F.col("x").cast("array<double>").alias("x")), "j").select("id", "value", "x")

    def total(t: pa.Table) -> pa.Table:
        x = stacked(t["x"])
        return pa.table([t["id"].slice(0, 1), pa.array([(t["value"].to_numpy() @ x).tolist()])], ["id", "x"])

    return ends.groupBy("id").applyInArrow(total, "id long, x array<double>")


def neighborhood_preserving_embedding(graph: Graph, points: DataFrame, *, num_dims: int | None = None, reweight: bool = True) -> np.ndarray:
    """Projection d x k: X'MX a = l X'X a with M as for locally linear embedding, by ascending l, each of length 1."""
    own = barycenter_edge_weights(graph, points) if reweight else graph
    d = _dims(points)
    values, vectors = np.linalg.eig(np.linalg.solve(gram(points, None, d), gram(_left_over(own, points), None, d)))
    order = np.argsort(values.real)[: d if num_dims is None else num_dims]
    out = vectors.real[:, order]
    return out / np.linalg.norm(out, axis=0)


def laplacian_pca(graph: Graph, points: DataFrame, *, num_dims: int | None = None, beta: float = 0.5) -> DataFrame:
    """``id, coords``: the points, rebuilt from the eigenvectors of a mix of their own products and the Laplacian."""
    if num_dims is not None and points.count() > LOCAL_VERTICES:
        return _large_pca(graph, points, num_dims, beta)
    ids, x = points_to_numpy(points)
    m = coo_to_numpy(laplacian(graph, normed=True), len(ids))
    kernel = x @ x.T
    top = lambda a: np.abs(np.linalg.eigvalsh((a + a.T) / 2)).max()
    w = (1 - beta) * (np.eye(len(ids)) - kernel / top(kernel)) + beta * m / top(m)
    _, vectors = np.linalg.eigh((w + w.T) / 2)
    v = vectors if num_dims is None else vectors[:, :num_dims]
    return from_numpy(points.sparkSession, v @ (v.T @ x), ids)


def _large_pca(graph: Graph, points: DataFrame, num_dims: int, beta: float) -> DataFrame:
    """``laplacian_pca`` by Lanczos' method on the driver, which holds the points and the Laplacian's cells but no matrix of all pairs."""
    m = Local(laplacian(graph, normed=True), points)
    rows = points.select("id", F.col("x").cast("array<double>").alias("x")).orderBy("id").toArrow()
    x = stacked(rows["x"])
    half = Local.__new__(Local)  # both ways' mean
    half.ids, half.i, half.j, half.value = m.ids, np.concatenate([m.i, m.j]), np.concatenate([m.j, m.i]), np.concatenate([m.value, m.value]) / 2
    top_kernel = float(np.linalg.eigvalsh(x.T @ x).max())
    top_m = max(abs(float(lanczos(half.__matmul__, len(x), 1, smallest=s)[0][0])) for s in (True, False))
    w = lambda v: (1 - beta) * (v - x @ (x.T @ v) / top_kernel) + beta * (half @ v) / top_m
    _, v = lanczos(w, len(x), num_dims)
    out = v @ (v.T @ x)
    coords = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), out.shape[1]).cast(pa.list_(pa.float64()))
    return points.sparkSession.createDataFrame(pa.table([pa.array(m.ids), coords], ["id", "coords"]), "id long, coords array<double>")


def layout_circle(graph: Graph) -> DataFrame:
    """``id, x, y``: vertices evenly on a circle, by id."""
    n = graph.num_vertices()
    angle = F.col("id") * (2 * np.pi / max(n, 1))
    return graph.vertices.select("id", F.cos(angle).alias("x"), F.sin(angle).alias("y"))


def layout_spring(graph: Graph, *, num_dims: int = 2, spring_constant: float | None = None, iterations: int = 50, initial_temp: float = 0.1, initial_layout: np.ndarray | None = None, seed: int = 0) -> DataFrame:
    """``id, coords`` by springs along edges and repulsion of all vertices, with steps that shrink. Bounded by ``LOCAL_VERTICES``."""
    adj = to_dense(graph)
    n = len(adj)
    x = np.random.default_rng(seed).random((n, num_dims)) if initial_layout is None else np.array(initial_layout, float)
    if x.shape != (n, num_dims):
        raise ValueError(f"the layout has shape {x.shape}, not {(n, num_dims)}")
    k = n**-0.5 if spring_constant is None else spring_constant
    pull = np.divide(1.0, adj, out=np.zeros_like(adj), where=adj != 0) / k
    for i in range(iterations):
        step = initial_temp * (1 - i / (iterations + 1))
        moved = np.empty_like(x)
        for lo in range(0, n, 1024):
            delta = x[lo : lo + 1024, None] - x[None]
            dist = np.maximum(np.sqrt((delta**2).sum(2)), 1e-8)
            moved[lo : lo + 1024] = np.einsum("ijk,ij->ik", delta, k * k / dist - pull[lo : lo + 1024] * dist**2)
        x = x + moved * step / np.maximum(np.sqrt((moved**2).sum(1)), 1e-2)[:, None]
    return from_numpy(graph.edges.sparkSession, x)
