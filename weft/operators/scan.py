"""All points against all others, exactly, as streams: where nothing is known that would keep points apart.

Query points are dealt over tasks, a bounded number to each, and every task reads all targets (or a share of them) in batches. A product of matrices of single precision screens
a piece of queries and targets; only pairs that, with the product's largest error, may still count are measured by their differences. What a task holds is its
queries, the best found for each and one piece of the screen; no table of pairs is made.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.metrics import pairwise

#: Metrics that have a screen.
SCREENED = ("euclidean", "sqeuclidean", "cosine", "manhattan")
#: Query points a task holds, queries and targets of a piece, pairs measured at once.
HELD, ROWS, COLUMNS, PAIRS = 32_768, 512, 4096, 100_000
NONE = np.iinfo(np.int64).max


def stacked(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """An array column as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = np.asarray(flat.flatten().to_numpy(zero_copy_only=False), float)
    return values.reshape(len(flat), -1) if len(flat) else values.reshape(0, 0)


def measured(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the rows of ``x`` to those of ``y`` at the same places."""
    if metric == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            return 1 - np.einsum("ij,ij->i", x, y) / np.sqrt((x * x).sum(1)) / np.sqrt((y * y).sum(1))
    diff = x - y
    if metric == "manhattan":
        return np.abs(diff).sum(1)
    out = np.einsum("ij,ij->i", diff, diff)
    return np.sqrt(out) if metric == "euclidean" else out


class Screen:
    """Cheap numbers that order targets as the distances from one query do, but for an error that is known."""

    def __init__(self, x: np.ndarray, metric: str):
        self.x, self.metric = x, metric
        with np.errstate(all="ignore"):
            self.centre = x.mean(0) if len(x) and metric != "cosine" else np.zeros(x.shape[1])
            if metric == "manhattan":
                own = np.abs(x - self.centre).max(initial=0)
                self.step = (own if np.isfinite(own) and own > 0 else 1.0) / 63
                self.own = self._levels(x).T.copy()
                return
            own = x - self.centre
            self.scale = np.abs(own).max(initial=0)
            self.scale = self.scale if np.isfinite(self.scale) and self.scale > 0 else 1.0
            own = self._unit(own)
            self.norm = (own * own).sum(1)
            self.own = np.column_stack([-own if metric == "cosine" else -2 * own, np.ones(len(own))]).astype(np.float32)

    def _levels(self, x: np.ndarray) -> np.ndarray:
        """Coordinates by whole steps, at most 63 from the centre: differences lose up to a step, and never gain more."""
        return np.clip(np.nan_to_num(np.floor((x - self.centre) / self.step)), -64, 63).astype(np.int8)

    def _unit(self, x: np.ndarray) -> np.ndarray:
        return x / np.sqrt((x * x).sum(1, keepdims=True)) if self.metric == "cosine" else x / self.scale

    def targets(self, y: np.ndarray) -> np.ndarray:
        """Targets as ``piece`` takes them."""
        with np.errstate(all="ignore"):
            if self.metric == "manhattan":
                return self._levels(y).T.copy()
            own = self._unit(y - self.centre)
            last = np.zeros(len(own)) if self.metric == "cosine" else (own * own).sum(1)
            return np.column_stack([own, last]).astype(np.float32).T.copy()

    def piece(self, lo: int, hi: int, y: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
        """(screen, largest error of each row) of the queries from ``lo`` to ``hi`` and some targets."""
        if self.metric == "manhattan":
            return self._steps(lo, hi, y), y.shape[0] + 1.0
        with np.errstate(all="ignore"):
            width, tiny = len(y) + 8, 2.0**-22
            if self.metric == "cosine":
                return self.own[lo:hi] @ y, width * tiny * 2
            top = float(y[-1].max(initial=0))
            return self.own[lo:hi] @ y, width * tiny * (np.sqrt(self.norm[lo:hi]) + math.sqrt(max(top, 0.0))) ** 2 if math.isfinite(top) else np.inf

    def _steps(self, lo: int, hi: int, y: np.ndarray) -> np.ndarray:
        """Sums of the differences of levels: two coordinates in a byte, then even and odd places in two bytes, a few rows at a time."""
        width = y.shape[1]
        out = np.zeros((hi - lo, width + width % 2), np.uint32)
        y = np.pad(y, ((0, len(y) % 2), (0, width % 2)))
        for r in range(lo, hi, 64):
            own = np.pad(self.own[:, r : min(r + 64, hi)], ((0, len(self.own) % 2), (0, 0)))
            a, b = np.empty((own.shape[1], y.shape[1]), np.int8), np.empty((own.shape[1], y.shape[1]), np.int8)
            part, sums = np.empty((len(a), y.shape[1] // 2), np.uint16), np.zeros((2, len(a), y.shape[1] // 2), np.uint16)
            for k in range(0, len(y), 2):
                np.abs(np.subtract(own[k][:, None], y[k][None], out=a), out=a)
                np.abs(np.subtract(own[k + 1][:, None], y[k + 1][None], out=b), out=b)
                two = np.add(a.view(np.uint8), b.view(np.uint8), out=a.view(np.uint8)).view(np.uint16)
                sums[0] += np.bitwise_and(two, 255, out=part)
                sums[1] += np.right_shift(two, 8, out=part)
                if k % 512 == 510 or k + 2 >= len(y):  # before two bytes are full
                    out[r - lo : r - lo + 64, ::2] += sums[0]
                    out[r - lo : r - lo + 64, 1::2] += sums[1]
                    sums[:] = 0
        return out[:, :width]

    def level(self, d: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Distances of the queries from ``lo`` to ``hi`` in numbers of the screen."""
        with np.errstate(all="ignore"):
            if self.metric == "manhattan":
                return d / self.step
            if self.metric == "cosine":
                return d - 1
            return (d / self.scale) ** 2 - self.norm[lo:hi] if self.metric == "euclidean" else d / self.scale**2 - self.norm[lo:hi]


class Nearest:
    """For some queries the ``k`` nearest of all targets that are added, or at once those within ``epsilon``; ties go to the smaller id.

    ``group``: targets of a query's own group don't count; ``positive``: nor do those that coincide with it.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, metric: str, *, k: int | None, epsilon: float | None, group: np.ndarray | None = None, positive: bool = False):
        self.ids, self.x, self.metric, self.k, self.epsilon, self.group, self.positive = ids, x, metric, k, epsilon, group, positive
        self.screen = Screen(x, metric)
        if k is not None:
            self.dist, self.near = np.full((len(ids), k), np.nan), np.full((len(ids), k), NONE)

    def add(self, ids: np.ndarray, y: np.ndarray, group: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Takes targets in; without ``k`` gives (query ids, target ids, distances) of those within ``epsilon``."""
        for at in range(0, len(ids), COLUMNS):
            cut = slice(at, at + COLUMNS)
            own = self.screen.targets(y[cut])
            for lo in range(0, len(self.ids), ROWS):
                yield from self._piece(lo, min(lo + ROWS, len(self.ids)), ids[cut], y[cut], own, None if group is None else group[cut])

    def _piece(self, lo, hi, ids, y, own, group):
        screen, error = self.screen.piece(lo, hi, own)
        apart = None if group is None else self.group[lo:hi]
        far = np.full(hi - lo, np.inf if self.epsilon is None else self.epsilon)
        if self.k is not None:
            last = self.dist[lo:hi, -1]
            far = np.where(np.isnan(last), far, np.minimum(far, last))
            open_ = np.flatnonzero(self.near[lo:hi, -1] == NONE)
            if len(open_) and len(ids) >= self.k:
                far[open_] = np.minimum(far[open_], self._reach(lo, open_, screen, error, ids, y, group))
        level = (self.screen.level(far, lo, hi) + error).astype(np.float64)
        level = np.where(np.isnan(level), np.inf, level)
        # single precision may round the bound down: one step up
        bound = np.nextafter(level.astype(np.float32), np.float32(np.inf)) if screen.dtype == np.float32 else np.minimum(np.floor(level), np.iinfo(screen.dtype).max).astype(screen.dtype)
        out = np.greater(screen, bound[:, None])
        some = np.flatnonzero(~out.all(1))
        i, j = np.nonzero(~out[some])
        i = some[i]
        if apart is not None:
            keep = apart[i] != group[j]
            i, j = i[keep], j[keep]
        for at in range(0, len(i), PAIRS):
            a, b = i[at : at + PAIRS], j[at : at + PAIRS]
            d = measured(self.x[lo + a], y[b], self.metric)
            keep = ~(d > far[a])
            if self.epsilon is not None:
                keep &= d <= self.epsilon
            if self.positive:
                keep &= d != 0
            a, b, d = lo + a[keep], ids[b[keep]], d[keep]
            if self.k is None:
                if len(a):
                    yield self.ids[a], b, d
            else:
                self._take(a, b, d)

    def _reach(self, lo, rows, screen, error, ids, y, group):
        """How far the k-th of a piece's targets is at most, for queries that have too few so far."""
        own = screen[rows].astype(np.float64)
        if group is not None:
            own[self.group[lo + rows][:, None] == group[None]] = np.inf
        if self.positive:
            zero = self.screen.level(np.zeros(len(screen)), lo, lo + len(screen)) + error
            own[own <= zero[rows][:, None]] = np.inf
        best = np.argpartition(own, self.k - 1, axis=1)[:, : self.k] if own.shape[1] > self.k else np.broadcast_to(np.arange(own.shape[1]), own.shape)
        some = np.isfinite(np.take_along_axis(own, best, 1)).all(1)
        out = np.full(len(rows), np.inf)
        for at in range(0, len(rows), max(1, PAIRS // self.k)):
            s = slice(at, at + max(1, PAIRS // self.k))
            d = measured(np.repeat(self.x[lo + rows[s]], self.k, 0), y[best[s].ravel()], self.metric).reshape(-1, self.k)
            out[s] = np.where(some[s] & ~np.isnan(d).any(1), d.max(1), np.inf)
        return out

    def _take(self, rows: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        far, last = self.dist[rows, -1], self.near[rows, -1]
        keep = ~((d > far) | ((d == far) & (ids > last)))
        rows, ids, d = rows[keep], ids[keep], d[keep]
        if not len(rows):
            return
        some, place = np.unique(rows, return_inverse=True)
        place = np.concatenate([np.repeat(np.arange(len(some)), self.k), place])
        ids, d = np.concatenate([self.near[some].ravel(), ids]), np.concatenate([self.dist[some].ravel(), d])
        order = np.lexsort((ids, d, place))
        best = order[np.searchsorted(place[order], np.arange(len(some)))[:, None] + np.arange(self.k)]
        self.near[some], self.dist[some] = ids[best], d[best]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query ids, target ids, distances, places from 1)."""
        i, j = np.nonzero(self.near != NONE)
        return self.ids[i], self.near[i, j], self.dist[i, j], j + 1


def streamed(query: DataFrame, targets: DataFrame, n: int, n_targets: int, start: Callable, schema: str, *, whole: bool = False) -> DataFrame:
    """Rows of every task's work. ``query`` and ``targets`` have ``id, x`` and may have a number ``g``; ``start(ids, x, g)`` gives an object with
    ``add(ids, x, g)`` and ``end()``, which both give batches of ``schema``. With ``whole`` each query is in one task; else few queries meet shares of
    the targets in several."""
    cores = query.sparkSession.sparkContext.defaultParallelism
    nq = max(1, math.ceil(n / HELD), min(cores, n // 256))
    nt = 1 if whole else max(1, min(cores // nq, n_targets // 4096))
    many = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    place = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    g = lambda t: F.col("g") if "g" in t.columns else F.col("id")
    left = query.select(place(nq).alias("_q"), many(nt).alias("_t"), F.lit(0).alias("_s"), "id", "x", g(query).cast("long").alias("g"))
    right = targets.select(many(nq).alias("_q"), place(nt).alias("_t"), F.lit(1).alias("_s"), "id", "x", g(targets).cast("long").alias("g"))
    both = left.union(right).select((F.col("_q") * nt + F.col("_t")).alias("_p"), "_s", "id", "x", "g")

    def worker(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, held, state = None, [], [], None

        def work() -> Iterator[pa.RecordBatch]:
            nonlocal held, state
            if own and state is None:
                state = start(*columns(own))
                own.clear()
            if held and state is not None:
                yield from state.add(*columns(held))
            held = []

        def end() -> Iterator[pa.RecordBatch]:
            nonlocal state
            yield from work()
            if state is not None:
                yield from state.end()
            state = None
            own.clear()

        for b in batches:
            p, s = b.column(0).to_numpy(), b.column(1).to_numpy()
            cut = np.flatnonzero((np.diff(p) != 0) | (np.diff(s) != 0)) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(p)], strict=True):
                if lo == hi:
                    continue
                if p[lo] != now:
                    yield from end()
                    now = p[lo]
                (held if s[lo] else own).append(b.slice(lo, hi - lo))
                if held and sum(t.num_rows for t in held) >= 2 * COLUMNS:
                    yield from work()
        yield from end()

    def columns(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = pa.Table.from_batches(parts)
        return t["id"].to_numpy(), stacked(t["x"]), t["g"].to_numpy()

    return both.repartitionById(nq * nt, "_p").sortWithinPartitions("_p", "_s").mapInArrow(worker, schema)


def scanned(query: DataFrame, targets: DataFrame, metric: str, *, k: int | None, epsilon: float | None, n: int, n_targets: int, apart: bool = False, positive: bool = False) -> DataFrame:
    """``qid, tid, dist`` for each query: its ``k`` nearest targets (in shares, if several tasks met it), those within ``epsilon``, or both. ``apart``: targets of the
    same ``g`` (by default the id) don't count."""

    class Task:
        def __init__(self, ids, x, g):
            self.best = Nearest(ids, x, metric, k=k, epsilon=epsilon, group=g if apart else None, positive=positive)

        def add(self, ids, y, g):
            for q, t, d in self.best.add(ids, y, g if apart else None):
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(t), pa.array(d)], ["qid", "tid", "dist"])

        def end(self):
            if k is not None:
                q, t, d, _ = self.best.found()
                for lo in range(0, len(q), 100_000):
                    s = slice(lo, lo + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(q[s]), pa.array(t[s]), pa.array(d[s])], ["qid", "tid", "dist"])

    return streamed(query, targets, n, n_targets, Task, "qid long, tid long, dist double")
