"""Linear equations and eigenvectors of sparse symmetric matrices as tables, for any number of rows.

A matrix is ``i, j, value``, a stack of vectors ``id, x`` with one array of a fixed length for each row. Products are joins with partial sums; only sums over all rows (a few
numbers a round) reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import discard, materialize

#: Cells and numbers of vectors that the driver holds, 24 bytes each three of them at most.
LOCAL_CELLS = 20_000_000


def product(cells: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """``id, y``: the matrix times the vectors; rows that would be 0 are absent."""
    both = cells.join(vectors.select(F.col("id").alias("j"), F.col("x").alias("_x")), "j")
    return both.groupBy(F.col("i").alias("id")).agg(F.array(*[F.sum(F.col("value") * F.col("_x")[k]) for k in range(width)]).alias("y"))


def _sums(rows: DataFrame, *columns: tuple[str, str], width: int) -> list[np.ndarray]:
    """Products of two array columns, summed over all rows, place by place."""
    got = rows.agg(*[F.sum(F.col(a)[k] * F.col(b)[k]).alias(f"{a}{b}{k}") for a, b in columns for k in range(width)]).first()
    flat = np.array([0.0 if v is None else v for v in got])
    return list(flat.reshape(len(columns), width))


def _scaled(values: np.ndarray, a: str, b: str) -> Column:
    """a + values * b, place by place."""
    return F.array(*[F.col(a)[k] + F.lit(float(v)) * F.col(b)[k] for k, v in enumerate(values)])


def solve(cells: DataFrame, rhs: DataFrame, width: int, *, tol: float = 1e-10, rounds: int = 1000) -> DataFrame:
    """``id, x`` with cells times x = ``rhs`` (``id, x``, one row for each row of the matrix), for positive definite cells: conjugate
    gradients, for all right sides at once, until their residuals are ``tol`` of what they were."""
    zero = F.array(*[F.lit(0.0)] * width)
    state = materialize(rhs.select("id", zero.alias("s"), F.col("x").alias("r"), F.col("x").alias("p")), "gradients")
    (rr,) = _sums(state, ("r", "r"), width=width)
    stop = rr * tol * tol
    for _ in range(rounds):
        if (rr <= stop).all():
            break
        q = product(cells, state.select("id", F.col("p").alias("x")), width).withColumnRenamed("y", "q")
        half = materialize(state.join(q, "id", "left").withColumn("q", F.coalesce("q", zero)), "gradients")
        (pq,) = _sums(half, ("p", "q"), width=width)
        alpha = np.divide(rr, pq, out=np.zeros(width), where=(pq > 0) & (rr > stop))
        moved = half.select("id", _scaled(alpha, "s", "p").alias("s"), _scaled(-alpha, "r", "q").alias("r"), "p")
        (new,) = _sums(moved, ("r", "r"), width=width)
        beta = np.divide(new, rr, out=np.zeros(width), where=(rr > stop) & (new > 0))
        following = materialize(moved.select("id", "s", "r", _scaled(beta, "r", "p").alias("p")), "gradients")
        discard(state)
        discard(half)
        state, rr = following, new
    else:
        raise RuntimeError(f"conjugate gradients need more than {rounds} rounds")
    return state.select("id", F.col("s").alias("x"))


class Local:
    """A symmetric matrix ``i, j, value`` on the driver, by rows: 24 bytes a cell, of a counted number."""

    def __init__(self, cells: DataFrame, ids: DataFrame):
        self.ids = np.sort(ids.select("id").toPandas()["id"].to_numpy(np.int64))
        e = cells.select("i", "j", F.col("value").cast("double").alias("value")).toPandas()
        i, j = (np.searchsorted(self.ids, e[c].to_numpy(np.int64)) for c in ("i", "j"))
        order = np.argsort(i, kind="stable")
        self.i, self.j, self.value = i[order], j[order], e["value"].to_numpy(float)[order]

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.i, self.value * v[self.j], len(self.ids))


def lanczos(times: Callable[[np.ndarray], np.ndarray], n: int, num: int, *, smallest: bool = True, tol: float = 1e-8, held: int = 120, rounds: int = 200, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(values, unit vectors as columns): the ``num`` smallest or largest eigenvalues of a symmetric product, ascending.

    Lanczos' method, each new vector being made orthogonal to all before (twice); at ``held`` vectors it begins anew from the best combinations of them, so memory
    is bounded by so many vectors, however many products it takes.
    """
    held = min(n, max(held, 4 * num + 20))
    rng = np.random.default_rng(seed)
    basis, images = np.empty((held, n)), np.empty((held, n))
    fresh = rng.normal(size=n)
    m = 0
    for _ in range(rounds):
        while m < held:
            before = np.linalg.norm(fresh)
            for _ in range(2):
                fresh = fresh - basis[:m].T @ (basis[:m] @ fresh)
            length = np.linalg.norm(fresh)
            if length <= 1e-10 * max(before, 1e-300):  # a part of the space is closed: go on with another vector
                fresh = rng.normal(size=n)
                continue
            basis[m] = fresh / length
            images[m] = times(basis[m])
            fresh = images[m].copy()
            m += 1
        small = basis[:m] @ images[:m].T
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        chosen = np.arange(min(num, m)) if smallest else np.arange(max(0, m - num), m)
        top = max(1.0, float(np.abs(values).max()))
        found, image = vectors[:, chosen].T @ basis[:m], vectors[:, chosen].T @ images[:m]
        rest = image - values[chosen][:, None] * found
        error = np.linalg.norm(rest, axis=1)
        if m >= n or (error < tol * top).all():
            return values[chosen], found.T
        keep = min(held // 2, num + 10 + held // 4)
        keep = np.arange(keep) if smallest else np.arange(m - keep, m)
        basis[: len(keep)], images[: len(keep)] = vectors[:, keep].T @ basis[:m], vectors[:, keep].T @ images[:m]
        m, fresh = len(keep), rest[error.argmax()]
    raise RuntimeError(f"eigenvectors need more than {rounds} rounds of {held} vectors")


def eigenvectors(cells: DataFrame, ids: DataFrame, num: int, *, smallest: bool = True, tol: float = 1e-8, steps: int = 300, every: int = 10, seed: int = 0, local_cells: int = LOCAL_CELLS) -> tuple[np.ndarray, DataFrame]:
    """(values, ``id, coords``): the ``num`` smallest or largest eigenvalues of symmetric cells, ascending, and unit eigenvectors.

    Up to ``local_cells`` cells the products are made on the driver (``lanczos``); a step over tables is a few jobs. Beyond, by tables: Lanczos' method, each new vector being made
    orthogonal to all before (twice). The basis is one array a row that grows by a number a step; every few steps the
    small matrix of the steps tells whether the wanted values have settled.
    """
    n = ids.count()
    if n * 240 + 3 * cells.count() <= 3 * local_cells:
        own = Local(cells, ids)
        values, vectors = lanczos(own.__matmul__, n, num, smallest=smallest, tol=tol, seed=seed)
        rows = pa.table([pa.array(own.ids), pa.FixedSizeListArray.from_arrays(pa.array(vectors.ravel()), vectors.shape[1]).cast(pa.list_(pa.float64()))], ["id", "coords"])
        return values, ids.sparkSession.createDataFrame(rows, "id long, coords array<double>")
    uniform = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) + 1) / float(1 << 30) - 0.5
    basis = materialize(ids.select("id", F.array(uniform).alias("b")), "basis")
    norm = np.sqrt(_sums(basis, ("b", "b"), width=1)[0][0])
    basis = materialize(basis.select("id", F.array(F.col("b")[0] / F.lit(float(norm))).alias("b")), "basis")
    diagonal: list[float] = []
    beside: list[float] = []
    steps = min(steps, n)
    while True:
        m = len(diagonal) + 1
        last = basis.select("id", F.array(F.col("b")[m - 1]).alias("x"))
        y = basis.join(product(cells, last, 1), "id", "left").select("id", "b", F.coalesce(F.col("y")[0], F.lit(0.0)).alias("w"))
        y = materialize(y, "product")
        total = np.zeros(m)
        for _ in range(2):
            got = y.agg(*[F.sum(F.col("b")[k] * F.col("w")) for k in range(m)]).first()
            share = np.array([v or 0.0 for v in got])
            total += share
            off = sum((F.col("b")[k] * F.lit(float(share[k])) for k in range(m)), F.lit(0.0))
            y = y.withColumn("w", F.col("w") - off)
        diagonal.append(float(total[-1]))
        y = materialize(y, "product")
        length = float(np.sqrt(y.agg(F.sum(F.col("w") * F.col("w"))).first()[0] or 0.0))
        small = np.diag(diagonal) + np.diag(beside, 1) + np.diag(beside, -1)
        values, vectors = np.linalg.eigh(small)
        chosen = np.arange(min(num, m)) if smallest else np.arange(max(0, m - num), m)
        error = np.abs(length * vectors[-1, chosen])
        done = m >= n or length < 1e-12 or m >= num and m % every == 0 and (error < tol * max(1.0, np.abs(values).max())).all()
        if done or m >= steps:
            if not done:
                raise RuntimeError(f"eigenvectors need more than {steps} steps")
            break
        beside.append(length)
        new = materialize(y.select("id", F.concat("b", F.array(F.col("w") / F.lit(length))).alias("b")), "basis")
        discard(basis)
        basis = new
    coords = [sum((F.col("b")[k] * F.lit(float(vectors[k, c])) for k in range(m)), F.lit(0.0)) for c in chosen]
    return values[chosen], basis.select("id", F.array(*coords).alias("coords"))
