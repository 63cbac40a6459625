"""Labels on vertices: colouring, clustering, semi-supervised classification, regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.graph import Graph
from weft.plans.iterate import until
from weft.plans.linalg import LOCAL_EDGES, LOCAL_VERTICES, collected, coo_to_numpy, from_numpy
from weft.plans.sparse import eigenvectors, product, solve
from weft.plans.tables import discard, materialize

from .analysis import laplacian
from .transform import kernelize


def _partial(labels: DataFrame) -> DataFrame:
    """Known ``id, label``: null and -1 are unknown."""
    return labels.select(F.col("id").cast("long").alias("id"), F.col("label").cast("int").alias("label")).where("label IS NOT NULL AND label <> -1")


def color_greedy(graph: Graph, *, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``id, color``: the smallest positive colour that no neighbour (target) with a smaller id has, vertex by vertex. Vertices whose
    smaller neighbours are done are coloured together, round by round, with the same result."""
    lower = materialize(graph.edges.where("dst < src").select("src", "dst").distinct(), "lower")
    if lower.count() <= local_edges and graph.num_vertices() <= local_edges:
        rows = lower.groupBy("src").agg(F.collect_list("dst").alias("n")).collect()
        near, colour = {r.src: r.n for r in rows}, {}
        for r in graph.vertices.orderBy("id").toLocalIterator():
            used = {colour[w] for w in near.get(r.id, ())}
            colour[r.id] = next(c for c in range(1, len(used) + 2) if c not in used)
        return graph.vertices.sparkSession.createDataFrame(list(colour.items()), "id long, color int")
    done = materialize(graph.vertices.join(lower.select(F.col("src").alias("id")).distinct(), "id", "left_anti").select("id", F.lit(1).alias("color")), "colors")
    while True:
        todo = graph.vertices.join(done, "id", "left_anti").select(F.col("id").alias("src"))
        seen = lower.join(todo, "src").join(done.select(F.col("id").alias("dst"), "color"), "dst", "left")
        used = seen.groupBy("src").agg(F.collect_set("color").alias("used"), F.count_if(F.col("color").isNull()).alias("open")).where("open = 0")
        new = used.select(F.col("src").alias("id"), F.array_min(F.array_except(F.sequence(F.lit(1), F.size("used") + 1), "used")).alias("color"))
        more = materialize(done.union(new), "colors")
        ended = more.count() == done.count()
        discard(done)
        done = more
        if ended:
            return done


def bicolor_spectral(graph: Graph) -> DataFrame:
    """``id, color boolean``: sign of the Laplacian's eigenvector with the largest eigenvalue; vertex 0 is true. Beyond ``LOCAL_VERTICES`` vertices by Lanczos'
    method, for symmetric networks."""
    if graph.num_vertices() > LOCAL_VERTICES:
        _, found = eigenvectors(materialize(laplacian(graph), "laplacian"), graph.vertices, 1, smallest=False)
        own = materialize(found.select("id", (F.col("coords")[0] > 0).alias("s")), "sides")
        first = own.where("id = 0").first().s
        return own.select("id", (F.col("s") == F.lit(first)).alias("color"))
    m = coo_to_numpy(laplacian(graph), graph.num_vertices())
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    side = vectors[:, np.argmax(np.abs(values))] > 0
    side = side if side[0] else ~side
    return graph.vertices.sparkSession.createDataFrame([(i, bool(v)) for i, v in enumerate(side)], "id long, color boolean")


def cluster_spectral(graph: Graph, num_clusters: int, *, kernel: str = "rbf", seed: int = 0) -> DataFrame:
    """``id, cluster``: k-means on the normalised Laplacian's leading eigenvectors; beyond ``LOCAL_VERTICES`` vertices these come from Lanczos' method,
    for symmetric networks."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    cells = laplacian(kernelize(graph, kernel), normed=True)
    if graph.num_vertices() > LOCAL_VERTICES:
        _, own = eigenvectors(materialize(cells, "laplacian"), graph.vertices, num_clusters)
    else:
        m = coo_to_numpy(cells, graph.num_vertices())
        _, vectors = np.linalg.eigh((m + m.T) / 2)
        own = from_numpy(graph.vertices.sparkSession, vectors[:, :num_clusters])
    own = own.withColumn("features", array_to_vector("coords"))
    model = KMeans(k=num_clusters, seed=seed, initSteps=5, maxIter=100).fit(own)
    return model.transform(own).select("id", F.col("prediction").alias("cluster"))


def classify_nearest(graph: Graph, labels: DataFrame) -> DataFrame:
    """``id, label``: that of the labelled vertex to which the way is shortest; the smallest such id of several; vertex 0's if
    there is none.

    One search: labels run backwards along the edges from all labelled vertices at once, each vertex keeping the best only.
    """
    known = materialize(_partial(labels), "labels")
    back = materialize(graph.edges.select(F.col("dst").alias("v"), F.col("src").alias("id"), "weight"), "back")
    start = known.select("id", F.lit(0.0).alias("dist"), F.col("id").alias("source"), F.lit(True).alias("new"))

    def step(now: DataFrame, _: int) -> DataFrame:
        sent = now.where("new").select(F.col("id").alias("v"), "dist", "source").join(back, "v").groupBy("id").agg(F.min(F.struct((F.col("dist") + F.col("weight")).alias("dist"), "source")).alias("s"))
        both = now.join(sent, "id", "full")
        better = F.col("s").isNotNull() & (F.col("dist").isNull() | (F.col("s") < F.struct("dist", "source")))
        return both.select("id", F.when(better, F.col("s.dist")).otherwise(F.col("dist")).alias("dist"), F.when(better, F.col("s.source")).otherwise(F.col("source")).alias("source"), F.coalesce(better, F.lit(False)).alias("new"))

    reached = until(start, step, lambda old, new: not new.where("new").take(1), rounds=1_000_000, name="nearest")
    own = graph.vertices.join(reached, "id", "left").select("id", F.coalesce("source", F.lit(0).cast("long")).alias("source"))
    return own.join(known.select(F.col("id").alias("source"), "label"), "source", "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"))


def classify_lgc(graph: Graph, labels: DataFrame, *, kernel: str = "rbf", alpha: float = 0.2, tol: float = 1e-3, max_iter: int = 30, distributions: bool = False) -> DataFrame:
    """``id, label``: labels spread along the normalised weights until all changes sum to ``tol``; the class with most wins, the smallest of
    several. ``distributions``: ``id, label, value`` instead, absent ones being 0."""
    known = materialize(_partial(labels), "labels")
    cells = materialize(laplacian(kernelize(graph, kernel), normed=True).where("i <> j").select("i", "j", (-F.col("value")).alias("value")), "weights")
    clamp = graph.vertices.join(known.select("id", F.lit(1.0).alias("c")), "id", "left").select(F.col("id").alias("i"), F.coalesce("c", F.lit(alpha)).alias("c"))
    clamp = materialize(clamp, "clamp")
    fixed = known.select("id", "label", F.lit(min(1 - alpha, 1.0)).alias("y"))

    def step(now: DataFrame, _: int) -> DataFrame:
        spread = cells.join(now.select(F.col("id").alias("j"), "label", F.col("value").alias("f")), "j").groupBy("i", "label").agg(F.sum(F.col("value") * F.col("f")).alias("s"))
        spread = spread.join(clamp, "i").select(F.col("i").alias("id"), "label", (F.col("s") * F.col("c")).alias("s"))
        return spread.join(fixed, ["id", "label"], "full").select("id", "label", (F.coalesce("s", F.lit(0.0)) + F.coalesce("y", F.lit(0.0))).alias("value"))

    def done(old: DataFrame, new: DataFrame) -> bool:
        gap = old.withColumnRenamed("value", "o").join(new, ["id", "label"], "full").agg(F.sum(F.abs(F.coalesce("o", F.lit(0.0)) - F.coalesce("value", F.lit(0.0))))).first()[0]
        return (gap or 0.0) <= tol

    start = known.select("id", "label", F.lit(1.0).alias("value"))
    out = until(start, step, done, rounds=max_iter, name="labels", warn=f"classify_lgc didn't converge in {max_iter} rounds")
    return out if distributions else _heaviest(graph, known, out)


def _heaviest(graph: Graph, known: DataFrame, values: DataFrame) -> DataFrame:
    first = known.agg(F.min("label")).first()[0]
    best = Window.partitionBy("id").orderBy(F.desc("value"), "label")
    top = values.withColumn("r", F.row_number().over(best)).where("r = 1").select("id", F.when(F.col("value") > 0, F.col("label")).otherwise(F.lit(first)).alias("label"))
    return graph.vertices.join(top, "id", "left").select("id", F.coalesce("label", F.lit(-1 if first is None else first)).alias("label"))


def classify_local(graph: Graph, labels: DataFrame, **_) -> DataFrame:
    """Not available: its meaning was never settled."""
    raise NotImplementedError("classify_local")


def classify_harmonic(graph: Graph, labels: DataFrame, *, use_CMN: bool = True) -> DataFrame:
    """``id, label``: unknown vertices get the harmonic function of the known ones, its classes scaled to the known ones' masses if
    asked for; known labels stay. Beyond ``LOCAL_VERTICES`` vertices by conjugate gradients, for symmetric networks."""
    n = graph.num_vertices()
    if n > LOCAL_VERTICES:
        return _harmonic(graph, materialize(_partial(labels), "labels"), use_CMN)
    own = {r.id: r.label for r in collected(_partial(labels), "labels", LOCAL_VERTICES)}
    known = np.array([i in own for i in range(n)])
    classes = sorted(set(own.values()))
    one = np.array([[own[i] == c for c in classes] for i in range(n) if known[i]], float)
    m = coo_to_numpy(laplacian(graph), n)[~known]
    f = -np.linalg.solve(m[:, ~known], m[:, known] @ one)
    if use_CMN:
        f *= (1 + one.sum(0)) / f.sum(0)
    out, free = dict(own), np.flatnonzero(~known)
    out.update((int(i), classes[c]) for i, c in zip(free, f.argmax(1), strict=True))
    return graph.vertices.sparkSession.createDataFrame(sorted(out.items()), "id long, label int")


def _unknown(cells: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells between unknown vertices, and those from unknown to known ones; ``known`` has a column ``id``."""
    k = known.select("id")
    rows = cells.join(k, cells["i"] == k["id"], "left_anti")
    return materialize(rows.join(k, rows["j"] == k["id"], "left_anti"), "inner"), materialize(rows.join(k, rows["j"] == k["id"], "left_semi"), "outer")


def _harmonic(graph: Graph, known: DataFrame, use_CMN: bool) -> DataFrame:
    classes = sorted(r[0] for r in known.select("label").distinct().collect())  # as many as there are classes
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    inner, outer = _unknown(laplacian(graph), known)
    one = known.select("id", F.array(*[(F.col("label") == c).cast("double") for c in classes]).alias("x"))
    free = graph.vertices.join(known.select("id"), "id", "left_anti")
    rhs = free.join(product(outer, one, len(classes)), "id", "left").select("id", F.coalesce(F.transform("y", lambda v: -v), F.array(*[F.lit(0.0)] * len(classes))).alias("x"))
    f = materialize(solve(inner, rhs, len(classes)), "harmonic")
    if use_CMN:
        mass = f.agg(*[F.sum(F.col("x")[k]) for k in range(len(classes))]).first()
        scale = [(1 + counts[c]) / m for c, m in zip(classes, mass, strict=True)]
        f = f.select("id", F.array(*[F.col("x")[k] * F.lit(float(s)) for k, s in enumerate(scale)]).alias("x"))
    best = F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position("x", F.array_max("x")).cast("int"))
    return known.select("id", "label").union(f.select("id", best.cast("int")))


def _regressed(graph: Graph, known: DataFrame, penalty: float, kernel: str, flat: bool) -> DataFrame:
    width = 1 if flat else known.agg(F.max(F.size("y"))).first()[0]
    y = known.select("id", (F.array(F.col("y").cast("double")) if flat else F.col("y").cast("array<double>")).alias("x"))
    mean = [v or 0.0 for v in y.agg(*[F.avg(F.col("x")[k]) for k in range(width)]).first()]
    y = materialize(y.select("id", F.array(*[F.col("x")[k] - F.lit(float(m)) for k, m in enumerate(mean)]).alias("x")), "values")
    cells, zero = laplacian(kernelize(graph, kernel), normed=True), F.array(*[F.lit(0.0)] * width)
    if penalty == 0:
        inner, outer = _unknown(cells, y)
        free = graph.vertices.join(y.select("id"), "id", "left_anti")
        rhs = free.join(product(outer, y, width), "id", "left").select("id", F.coalesce(F.transform("y", lambda v: -v), zero).alias("x"))
        f = solve(inner, rhs, width).union(y)
    else:
        scaled = cells.select("i", "j", (F.col("value") * F.lit(float(y.count() * penalty))).alias("value"))
        held = y.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("value"))
        lhs = materialize(scaled.union(held).groupBy("i", "j").agg(F.sum("value").alias("value")), "equations")
        f = solve(lhs, graph.vertices.join(y, "id", "left").select("id", F.coalesce("x", zero).alias("x")), width)
    out = F.array(*[F.col("x")[k] + F.lit(float(m)) for k, m in enumerate(mean)])
    return f.select("id", (out[0] if flat else out).alias("y"))


def regression(graph: Graph, targets: DataFrame, *, smoothness_penalty: float = 0, kernel: str = "rbf") -> DataFrame:
    """``id, y``: values on all vertices, smooth along the edges, from ``id, y`` (a number or an array) on some. Without a penalty the known ones
    stay as they are. Beyond ``LOCAL_VERTICES`` vertices by conjugate gradients, for symmetric networks."""
    if graph.num_vertices() > LOCAL_VERTICES:
        known = materialize(targets.select("id", "y"), "known")
        if not known.take(1):
            raise ValueError("no values are known")
        return _regressed(graph, known, smoothness_penalty, kernel, not str(targets.schema["y"].dataType.typeName()) == "array")
    rows = collected(targets.select("id", "y").orderBy("id"), "known values", LOCAL_VERTICES)
    if not rows:
        raise ValueError("no values are known")
    flat = not isinstance(rows[0].y, list)
    y = np.array([[r.y] if flat else r.y for r in rows], float)
    if y.ndim != 2 or not y.size:
        raise ValueError(f"values have shape {y.shape}")
    n, at = graph.num_vertices(), np.array([r.id for r in rows])
    known = np.zeros(n, bool)
    known[at] = True
    mean = y.mean(0)
    s = coo_to_numpy(laplacian(kernelize(graph, kernel), normed=True), n)
    f = np.zeros((n, y.shape[1]))
    f[at] = y - mean
    if smoothness_penalty == 0:
        f[~known] = -np.linalg.solve(s[np.ix_(~known, ~known)], s[np.ix_(~known, known)] @ f[known])
    else:
        lhs = len(y) * smoothness_penalty * s
        lhs[at, at] += 1
        f = np.linalg.solve(lhs, f)
    f = f + mean
    return from_numpy(graph.vertices.sparkSession, f[:, 0] if flat else f, name="y")


__all__ = ["bicolor_spectral", "classify_harmonic", "classify_lgc", "classify_local", "classify_nearest", "cluster_spectral", "color_greedy", "regression"]
