"""Distances between points: as columns over two array columns, and as NumPy kernels over blocks of points."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Metric = str | Callable[[np.ndarray, np.ndarray], np.ndarray]

#: Cells of one temporary of a kernel, so that its memory is bounded.
CELLS = 4_000_000

# Other names of the metrics.
ALIASES = {"l2": "euclidean", "l1": "manhattan", "cityblock": "manhattan"}
NAMES = ("euclidean", "manhattan", "sqeuclidean", "cosine", "chebyshev")


def canonical(metric: str) -> str:
    name = ALIASES.get(metric, metric)
    if name not in NAMES:
        raise ValueError(f"unknown metric {metric!r}")
    return name


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def distance(a: Column, b: Column, metric: str = "euclidean") -> Column:
    """Distance of two array<double> columns; stays in the JVM."""
    name = canonical(metric)
    squares = _total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))
    if name == "sqeuclidean":
        return squares
    if name == "euclidean":
        return F.sqrt(squares)
    if name == "manhattan":
        return _total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    if name == "chebyshev":
        return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def pairwise(x: np.ndarray, y: np.ndarray, metric: Metric = "euclidean") -> np.ndarray:
    """Distances of all rows of ``x`` to all rows of ``y``. Differences are squared, not expanded, so near points stay exact."""
    if callable(metric):
        return np.asarray(metric(x, y), float)
    name = canonical(metric)
    if name == "cosine":
        nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
        with np.errstate(divide="ignore", invalid="ignore"):
            return 1 - (x @ y.T) / nx[:, None] / ny[None, :]
    out = np.empty((len(x), len(y)))
    step = max(1, CELLS // max(1, y.size))
    for lo in range(0, len(x), step):
        diff = x[lo : lo + step, None, :] - y[None, :, :]
        if name == "manhattan":
            out[lo : lo + step] = np.abs(diff).sum(2)
        elif name == "chebyshev":
            out[lo : lo + step] = np.abs(diff).max(2, initial=0)
        else:
            out[lo : lo + step] = np.einsum("ijk,ijk->ij", diff, diff)
    return np.sqrt(out) if name == "euclidean" else out
