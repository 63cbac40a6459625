"""Neighbour networks that grow step by step: ranked once, cut for each step."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.metrics import Metric
from weft.graph import Graph
from weft.operators.neighbors import nearest_neighbors, neighbors
from weft.plans.tables import materialize


def incremental_edges(points: DataFrame, *, k: int | Sequence[int] | None = None, epsilon: float | Sequence[float] | None = None, metric: Metric = "euclidean", precomputed: bool = False, weighting: str = "none", inclusive: bool = False) -> DataFrame:
    """``step, src, dst, weight`` of all steps; one of k and epsilon is a sequence. Distances count up to a fixed epsilon, but under
    a varied one unless ``inclusive``."""
    many_k, many_e = isinstance(k, Sequence), isinstance(epsilon, Sequence)
    if many_k == many_e:
        raise ValueError("one of k and epsilon is a sequence")
    top_k = max(k) if many_k else k
    top_e = max(epsilon) if many_e else epsilon
    if precomputed:
        found = nearest_neighbors(points.where("i <> j"), k=top_k, epsilon=math.inf if top_k is None else top_e, precomputed=True)
        from weft.operators.neighbors import _ranked

        found = _ranked(found, top_k)
    else:
        found = neighbors(points, points, metric=metric, k=top_k, epsilon=top_e, exclude_self=True)
    spark = points.sparkSession
    steps = spark.createDataFrame([(i, int(x) if many_k else None, None if many_k else float(x)) for i, x in enumerate(k if many_k else epsilon)], "step int, k int, eps double")
    if many_k:
        on = F.col("rank") <= F.col("k")
        found = found if epsilon is None else found.where(F.col("dist") <= epsilon)
    else:
        on = (F.col("dist") <= F.col("eps")) if inclusive else (F.col("dist") < F.col("eps"))
    weight = F.lit(1.0) if weighting == "binary" else F.col("dist")
    out = found.join(F.broadcast(steps), on)  # steps are arguments
    return out.select(F.col("step"), F.col("qid").alias("src"), F.col("tid").alias("dst"), weight.alias("weight"))


def incremental_neighbor_graph(points: DataFrame, **options) -> Iterator[Graph]:
    """One graph for each step, independent of each other; neighbours are ranked once."""
    steps = options.get("k") if isinstance(options.get("k"), Sequence) else options.get("epsilon")
    edges = materialize(incremental_edges(points, **options), "steps")
    ids = points.select("id") if "id" in points.columns else points.select(F.col("i").alias("id")).union(points.select("j")).distinct()
    for i in range(len(steps)):
        yield Graph(ids, edges.where(F.col("step") == i).drop("step"))
