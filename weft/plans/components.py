"""Connected components by contraction, for networks of any size and shape."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, looked_up, materialize

MAX_ROUNDS = 60
#: Edges left (of 16 bytes each) that one task finishes; more are contracted by rounds first.
ONE_TASK = 1_000_000


def _smallest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a, to``: the smallest vertex that each is connected with, over the edges ``a, b`` of one task."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    ends = [np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1)]
    ids, place = np.unique(np.concatenate(ends), return_inverse=True)
    a, b = place[: len(ends[0])], place[len(ends[0]) :]
    to = np.arange(len(ids))
    while len(a):  # edges join the roots of their ends; those within one root are done
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(to, high, low)
        while (to[to] != to).any():
            to = to[to]
        a, b = to[a], to[b]
        a, b = a[a != b], b[a != b]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[to])], ["a", "to"])


def connected_components(edges: DataFrame, *, max_rounds: int = MAX_ROUNDS, one_task: int = ONE_TASK) -> DataFrame:
    """``id, root`` for every vertex of the undirected edges ``a, b``: root is the smallest id in its component.

    As long as more than ``one_task`` edges are left, a round hooks every vertex to its smallest neighbour (itself included), follows these pointers to their
    ends, and contracts the edges; about log(n) rounds do. What is left then is solved in one task, with the same result. Nothing comes to the driver: hooks
    are partially aggregated, so a vertex with many edges is no hot group. Null ends and loops are left out.
    """
    own = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    vertices = own.select(F.col("a").alias("id")).union(own.select("b")).distinct()
    roots = materialize(vertices.select("id", F.col("id").alias("root")), "roots")
    left = materialize(own.where("a <> b").distinct(), "edges")
    for _ in range(max_rounds):
        n_left = left.count()
        if not n_left:
            break
        if n_left <= one_task:
            hooks = materialize(left.coalesce(1).mapInArrow(_smallest, "a long, to long"), "hooks")
        else:
            both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
            hooks = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to")), "hooks")
            while True:  # pointer jumping: the chain lengths halve
                ends = hooks.select(F.col("a").alias("to"), F.col("to").alias("end"))
                jumped = looked_up(hooks, ends.where("to <> end"), "to", of=hooks, how="left")
                jumped = materialize(jumped.select("a", F.coalesce("end", "to").alias("to"), F.col("end").isNotNull().alias("moved")), "hooks")
                discard(hooks)
                hooks = jumped.select("a", "to")
                hooks._weft_path = jumped._weft_path
                if not jumped.where("moved").take(1):
                    break
        target = hooks.select(F.col("a").alias("root"), F.col("to").alias("_to"))
        new_roots = materialize(looked_up(roots, target, "root", of=hooks, how="left").select("id", F.coalesce("_to", "root").alias("root")), "roots")
        if n_left <= one_task:
            discard(roots)
            discard(hooks)
            roots = new_roots
            break
        step = looked_up(left, hooks.select("a", F.col("to").alias("_a")), "a", of=hooks)
        step = looked_up(step, hooks.select(F.col("a").alias("b"), F.col("to").alias("_b")), "b", of=hooks)
        step = step.where("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()
        new_left = materialize(step, "edges")
        for old in (roots, left, hooks):
            discard(old)
        roots, left = new_roots, new_left
    else:
        raise RuntimeError(f"components need more than {max_rounds} rounds")
    discard(left)
    return roots
