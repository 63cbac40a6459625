"""Small dense problems on the driver, and sparse products as joins.

Spectral operators need dense eigenvectors; they are solved with NumPy up to ``LOCAL_VERTICES`` vertices and refused beyond.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_VERTICES = 4000
#: Networks of up to so many edges are solved in one process where an operator has a local kernel; larger ones by joins.
LOCAL_EDGES = 200_000


def bounded(n: int, what: str = "vertices") -> int:
    if n > LOCAL_VERTICES:
        raise ValueError(f"{n} {what}: dense problems are limited to {LOCAL_VERTICES}")
    return n


def collected(df: DataFrame, what: str, limit: int = LOCAL_EDGES) -> list:
    """Rows on the driver, of which there may be no more than the limit; nothing beyond it is brought."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} {what} are too many for the driver")
    return rows


def to_dense(graph) -> np.ndarray:
    n = bounded(graph.num_vertices())
    out = np.zeros((n, n))
    e = graph.edges.toPandas()
    out[e["src"].to_numpy(np.int64), e["dst"].to_numpy(np.int64)] = e["weight"].to_numpy(float)
    return out


def coo_to_numpy(cells: DataFrame, n: int) -> np.ndarray:
    bounded(n)
    out = np.zeros((n, n))
    c = cells.toPandas()
    out[c["i"].to_numpy(np.int64), c["j"].to_numpy(np.int64)] = c["value"].to_numpy(float)
    return out


def points_to_numpy(points: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order, and their points; bounded like vertices."""
    rows = points.select("id", "x").orderBy("id").limit(LOCAL_VERTICES + 1).collect()
    bounded(len(rows), "points")
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float).reshape(len(rows), -1)


def from_numpy(spark: SparkSession, x: np.ndarray, ids: np.ndarray | None = None, name: str = "coords") -> DataFrame:
    """``id, coords``."""
    ids = range(len(x)) if ids is None else ids
    kind = "array<double>" if x.ndim > 1 else "double"
    return spark.createDataFrame([(int(i), [float(v) for v in r] if x.ndim > 1 else float(r)) for i, r in zip(ids, x, strict=True)], f"id long, {name} {kind}")


def null_space(m: np.ndarray, num: int | None = None, threshold: float = 1e-8) -> np.ndarray:
    """Eigenvectors of a symmetric matrix by ascending eigenvalue, without those up to the threshold."""
    values, vectors = np.linalg.eigh(m)
    first = int(np.searchsorted(values, threshold))
    return vectors[:, first : len(values) if num is None else first + num]


def times_transposed(cells: DataFrame) -> DataFrame:
    """``i, j, value`` of A'A for the sparse matrix A: a join on its rows."""
    left, right = cells.select("i", F.col("j").alias("a"), F.col("value").alias("x")), cells.select("i", F.col("j").alias("b"), F.col("value").alias("y"))
    return left.join(right, "i").groupBy(F.col("a").alias("i"), F.col("b").alias("j")).agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def gram(points: DataFrame, cells: DataFrame | None, d: int) -> np.ndarray:
    """X'X, or X'MX for sparse M: each task sums its rows to d x d numbers; only their sums reach the driver."""
    if cells is None:
        rows = points.select(F.col("x").cast("array<double>").alias("a"), F.col("x").cast("array<double>").alias("b"), F.lit(1.0).alias("v"))
    else:
        a, b = points.select(F.col("id").alias("i"), F.col("x").cast("array<double>").alias("a")), points.select(F.col("id").alias("j"), F.col("x").cast("array<double>").alias("b"))
        rows = cells.join(a, "i").join(b, "j").select("a", "b", F.col("value").cast("double").alias("v"))

    def worker(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        matrix = lambda c: np.asarray(c.flatten().to_numpy(zero_copy_only=False), float).reshape(len(c), d)
        for batch in batches:
            total += matrix(batch.column(0)).T @ (matrix(batch.column(1)) * batch.column(2).to_numpy(zero_copy_only=False)[:, None])
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], ["s"])

    sums = rows.mapInArrow(worker, "s array<double>").select(F.posexplode("s").alias("p", "s")).groupBy("p").agg(F.sum("s").alias("s"))
    out = np.zeros(d * d)
    for r in sums.collect():
        out[r.p] = r.s
    return out.reshape(d, d)
