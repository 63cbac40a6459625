"""Points in cells around pivots, so that cells too far apart never meet.

Pivots are a bounded sample of the targets; each point belongs to its nearest one, and a cell with more points than a block is cut into rings by the distance
from its pivot. By the triangle inequality two points are no nearer than their pivots' distance less their own distances from these, and in one cell no nearer than
these differ. That bounds what two blocks can hold, so only blocks that may hold something near enough are brought together.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.metrics import pairwise
from weft.plans.tables import materialize

from .scan import stacked

#: Pivots at most: they are brought to the driver and sent to every worker.
PIVOTS = 1024
#: Metrics that obey the triangle inequality, and squares of such.
BOUNDED = {"euclidean": "euclidean", "manhattan": "manhattan", "chebyshev": "chebyshev", "sqeuclidean": "euclidean"}


@dataclass
class Cells:
    """Pivots, and where each cell is cut into rings; blocks are numbered by cell and ring."""

    metric: str
    pivots: np.ndarray
    cuts: list[np.ndarray] = field(default_factory=list)

    @property
    def first(self) -> np.ndarray:
        return np.cumsum([0, *(len(c) + 1 for c in self.cuts)])

    def cell_of(self, block: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, block, side="right") - 1

    def dealt(self, points: DataFrame) -> DataFrame:
        """``id, x, cell, r``, and ``block`` once the rings are known."""

        def worker(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = self.first
            for b in batches:
                x = stacked(b.column(1))
                cell, r = np.zeros(len(x), np.int64), np.zeros(len(x))
                step = max(1, 4_000_000 // len(self.pivots))
                for lo in range(0, len(x), step):
                    d = pairwise(x[lo : lo + step], self.pivots, self.metric)
                    cell[lo : lo + step] = d.argmin(1)
                    r[lo : lo + step] = d.min(1)
                block = np.zeros(len(x), np.int64)
                if self.cuts:
                    for c in np.unique(cell):
                        own = cell == c
                        block[own] = first[c] + np.searchsorted(self.cuts[c], r[own], side="right")
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell), pa.array(r), pa.array(block)], ["id", "x", "cell", "r", "block"])

        return points.mapInArrow(worker, "id long, x array<double>, cell long, r double, block long")


def cells(targets: DataFrame, n: int, metric: str, block: int) -> Cells:
    """Cells of about a quarter block, with ``PIVOTS`` at most; rings of a block at most."""
    few = min(PIVOTS, max(1, 4 * n // block))
    out = Cells(BOUNDED[metric], _pivots(targets, few))
    sizes = {r.cell: r.n for r in out.dealt(targets).groupBy("cell").agg(F.count("*").alias("n")).collect()}
    rings = max(1, math.ceil(max(sizes.values(), default=1) / block))
    shares = [i / rings for i in range(1, rings)]
    found = {}
    if shares:
        for r in out.dealt(targets).groupBy("cell").agg(F.percentile_approx("r", shares, 10_000).alias("q")).collect():
            need = math.ceil(sizes[r.cell] / block)  # rings of its own
            found[r.cell] = np.unique(np.quantile(np.array(r.q), [i / need for i in range(1, need)])) if need > 1 else np.zeros(0)
    out.cuts = [found.get(c, np.zeros(0)) for c in range(len(out.pivots))]
    return out


def gain(targets: DataFrame, n: int, metric: str, block: int) -> bool:
    """Whether cells may keep points apart: whether of the pivots at least half are farther from each other than twice the usual distance to the nearest."""
    few = min(PIVOTS, max(1, 4 * n // block))
    own = _pivots(targets, few)
    between = pairwise(own, own, BOUNDED[metric])
    np.fill_diagonal(between, np.inf)
    nearest = np.median(between.min(1))
    return bool(len(own) > 1 and 2 * np.count_nonzero(between[np.isfinite(between)] > 2 * nearest) >= len(own) * (len(own) - 1))


def _pivots(targets: DataFrame, few: int) -> np.ndarray:
    rows = targets.select("x", F.xxhash64("id").alias("h")).orderBy("h").limit(few).collect()
    return np.array([r.x for r in rows], float)


def spread(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the blocks that have points, their smallest and their largest distance from the pivot: one row a block."""
    rows = sorted(tuple(r) for r in blocks.groupBy("block").agg(F.min("r"), F.max("r")).collect())
    table = np.array(rows, float).reshape(-1, 3)
    return table[:, 0].astype(np.int64), table[:, 1], table[:, 2]


def meetings(own: Cells, query: tuple, target: tuple, reach: np.ndarray, *, apart: bool) -> np.ndarray:
    """Pairs (query block, target block) that may hold points within the query block's ``reach``; ``apart`` leaves out equal ones."""
    (qb, qlo, qhi), (tb, tlo, thi) = query, target
    qc, tc = own.cell_of(qb), own.cell_of(tb)
    between = pairwise(own.pivots, own.pivots, own.metric)
    slack = 1e-9 * (1 + between.max(initial=0))
    out = []
    for i, b in enumerate(qb):
        least = np.where(tc == qc[i], np.maximum(qlo[i] - thi, tlo - qhi[i]), between[qc[i], tc] - qhi[i] - thi)
        ok = least - slack <= reach[i]
        if apart:
            ok &= tb != b
        hit = tb[ok]
        out.append(np.column_stack([np.full(len(hit), b), hit]))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def brought_together(query: DataFrame, targets: DataFrame, pairs: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """The points of both sides once for each pair of blocks that they are in, as ``_q, _t``."""
    spark = query.sparkSession
    met = materialize(spark.createDataFrame(pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["_q", "_t"])), "block-pairs")
    left = query.withColumnRenamed("block", "_q").join(met, "_q")
    return left, targets.withColumnRenamed("block", "_t").join(met, "_t")
