"""The graph: vertices ``id``, directed edges ``src, dst, weight``, both immutable DataFrames."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions.metrics import distance, pairwise
from weft.plans.tables import materialize, sums_before

#: Adapters that bring a graph to the driver refuse more edges than this.
LOCAL_EDGES = 5_000_000


class Graph:
    """Vertices and directed edges. Ids count from 0; vertices without edges are in ``vertices`` only.

    ``weighted`` networks have no zero weight (it means no edge) and no repeated edge. Unweighted networks hold pairs, which may repeat, each with
    weight 1; ``symmetric`` ones are made of both directions of each pair. Every method gives a new graph; none changes this one. All
    of them are plans: nothing runs before an action, except where a method says so.
    """

    def __init__(self, vertices: DataFrame, edges: DataFrame, *, weighted: bool = True, symmetric: bool = False):
        self.vertices = vertices.select(F.col("id").cast("long").alias("id"))
        weight = F.col("weight").cast("double") if weighted else F.lit(1.0)
        own = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), weight.alias("weight"))
        self.edges = own.where(F.col("weight") != 0) if weighted else own
        self.weighted = weighted
        self.symmetric = symmetric

    # -- making ------------------------------------------------------------------------------------------------------------

    @staticmethod
    def _vertices(spark: SparkSession, pairs: DataFrame, num_vertices: int | None) -> DataFrame:
        if num_vertices is not None:
            return spark.range(num_vertices)
        top = pairs.agg(F.coalesce(F.max(F.greatest("src", "dst")), F.lit(-1).cast("long")).alias("m"))
        return top.select(F.explode(F.when(F.col("m") >= 0, F.sequence(F.lit(0).cast("long"), F.col("m"))).otherwise(F.array().cast("array<long>"))).alias("id"))

    @classmethod
    def from_edge_pairs(cls, pairs: DataFrame, *, num_vertices: int | None = None, vertices: DataFrame | None = None, symmetric: bool = False, weights: float | str | None = None, order: str | None = None) -> Graph:
        """From ``src, dst`` rows (fractions are cut off).

        ``weights``: None for an unweighted graph (pairs may repeat unless symmetric), one number for all, or the name of a
        column; zeros are no edges. Symmetric: each pair once as (smaller, larger), then both ways; of repeated weighted
        pairs the last by the column ``order`` counts, or else the heaviest. Vertices: those given, or 0 to num_vertices - 1, or
        to the largest id; none for an empty table.
        """
        weight = F.lit(1.0) if weights is None else F.lit(float(weights)) if isinstance(weights, int | float) else F.col(weights)
        rank = F.col(order) if order else weight
        own = pairs.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), weight.cast("double").alias("weight"), rank.alias("_rank"))
        vertices = vertices if vertices is not None else cls._vertices(pairs.sparkSession, own, num_vertices)
        if symmetric:
            half = own.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight", "_rank")
            half = half.groupBy("src", "dst").agg(F.max_by("weight", "_rank").alias("weight"))
            own = half.union(half.where("src <> dst").select("dst", "src", "weight"))
        elif weights is not None and order:
            own = own.groupBy("src", "dst").agg(F.max_by("weight", "_rank").alias("weight"))
        return cls(vertices, own, weighted=weights is not None, symmetric=symmetric)

    @classmethod
    def from_adj_rows(cls, rows: DataFrame, *, id_col: str = "id", row_col: str = "row") -> Graph:
        """From a dense matrix: one row ``id, row array<double>`` for each vertex; every non-zero cell is an edge."""
        cells = rows.select(F.col(id_col).alias("src"), F.posexplode(row_col).alias("dst", "weight"))
        return cls(rows.select(F.col(id_col).alias("id")), cells)

    @classmethod
    def from_coo(cls, cells: DataFrame, num_vertices: int | None = None) -> Graph:
        """From a sparse matrix: rows ``i, j, value``; repeated cells add up, zeros are no edges."""
        own = cells.groupBy(F.col("i").alias("src"), F.col("j").alias("dst")).agg(F.sum("value").alias("weight"))
        return cls(cls._vertices(cells.sparkSession, own, num_vertices), own)

    @classmethod
    def from_numpy(cls, spark: SparkSession, matrix: np.ndarray) -> Graph:
        i, j = matrix.nonzero()
        rows = [(int(a), int(b), float(matrix[a, b])) for a, b in zip(i, j, strict=True)]
        return cls(spark.range(len(matrix)), spark.createDataFrame(rows, "src long, dst long, weight double"))

    def _like(self, edges: DataFrame, *, vertices: DataFrame | None = None, weighted: bool | None = None, symmetric: bool = False) -> Graph:
        return Graph(self.vertices if vertices is None else vertices, edges, weighted=self.weighted if weighted is None else weighted, symmetric=symmetric)

    def persisted(self) -> Graph:
        """This graph with its tables written to the shared folder: for what reads it often."""
        return Graph(materialize(self.vertices, "vertices"), materialize(self.edges, "edges"), weighted=self.weighted, symmetric=self.symmetric)

    # -- reading -----------------------------------------------------------------------------------------------------------

    def pairs(self, *, directed: bool = True) -> DataFrame:
        """``src, dst``. Undirected: of a weighted graph the upper triangle (an edge 2 to 1 without 1 to 2 isn't in it); of an
        unweighted one each pair once, smaller id first."""
        own = self.edges.select("src", "dst")
        if directed:
            return own
        if self.weighted:
            return own.where("src <= dst")
        return own.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()

    def edge_weights(self, *, directed: bool = True) -> DataFrame:
        """``src, dst, weight``; undirected as in ``pairs``."""
        if directed:
            return self.edges
        return self.pairs(directed=False).join(self.edges, ["src", "dst"]) if self.weighted else self.pairs(directed=False).withColumn("weight", F.lit(1.0))

    def matrix(self) -> DataFrame:
        """``i, j, value`` of the adjacency matrix; absent cells are 0, repeated pairs count once."""
        own = self.edges if self.weighted else self.edges.distinct()
        return own.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("weight").alias("value"))

    def dense_rows(self) -> DataFrame:
        """``id, row array<double>``; needs memory for n numbers a row, so for small networks."""
        n = self.num_vertices()
        filled = self.edges.groupBy("src").agg(F.map_from_entries(F.collect_set(F.struct("dst", "weight"))).alias("m"))
        cell = lambda j: F.coalesce(F.try_element_at(F.col("m"), j), F.lit(0.0))
        return self.vertices.join(filled, F.col("id") == F.col("src"), "left").select("id", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), cell).alias("row"))

    def num_edges(self) -> int:
        return self.edges.count()

    def num_vertices(self) -> int:
        return self.vertices.count()

    def is_weighted(self) -> bool:
        return self.weighted

    def is_directed(self) -> bool:
        """Always true: an undirected reading is an argument of the operators that have one."""
        return True

    def copy(self) -> Graph:
        return Graph(self.vertices, self.edges, weighted=self.weighted, symmetric=self.symmetric)

    def adj_list(self) -> DataFrame:
        """``id, neighbors``: sorted targets of each vertex, empty lists included."""
        own = self.edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("neighbors"))
        return self.vertices.join(own, "id", "left").select("id", F.coalesce("neighbors", F.array().cast("array<long>")).alias("neighbors"))

    def degree(self, kind: str = "out", *, weighted: bool = True) -> DataFrame:
        """``id, degree``: sum of weights of the edges out of or into each vertex, or their number; repeated pairs count."""
        if kind not in ("in", "out"):
            raise ValueError(f"kind is in or out, not {kind!r}")
        end = "src" if kind == "out" else "dst"
        total = F.sum("weight") if weighted else F.count("*").cast("double")
        own = self.edges.groupBy(F.col(end).alias("id")).agg(total.alias("degree"))
        return self.vertices.join(own, "id", "left").select("id", F.coalesce("degree", F.lit(0.0)).alias("degree"))

    # -- changing ----------------------------------------------------------------------------------------------------------

    def add_edges(self, new: DataFrame, *, weight: float | str = 1, symmetric: bool = False) -> Graph:
        """Add ``src, dst`` rows: weighted networks overwrite (a zero deletes), unweighted ones insert what is absent and warn if a
        weight is given."""
        own = new.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), (F.col(weight) if isinstance(weight, str) else F.lit(float(weight))).cast("double").alias("weight"))
        if symmetric or self.symmetric:
            flipped = own.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
            own = own.union(flipped if self.weighted else flipped.where("src <> dst"))
        if not self.weighted:
            if isinstance(weight, str) or weight != 1:
                warnings.warn("an unweighted graph has no use for weights", stacklevel=2)
            if self.symmetric:
                own = own.distinct()
            return self._like(self.edges.union(own.join(self.edges, ["src", "dst"], "left_anti")), symmetric=self.symmetric)
        own = own.groupBy("src", "dst").agg(F.max("weight").alias("weight"))
        return self._like(self.edges.join(own, ["src", "dst"], "left_anti").union(own))

    def remove_edges(self, old: DataFrame, *, symmetric: bool = False) -> Graph:
        """Without ``src, dst`` rows, both ways if symmetric; missing ones don't matter."""
        own = old.select("src", "dst")
        if symmetric or self.symmetric:
            own = own.union(old.select("dst", "src"))
        return self._like(self.edges.join(own.distinct(), ["src", "dst"], "left_anti"), symmetric=self.symmetric)

    def symmetrize(self, method: str = "sum") -> Graph:
        """Both directions with the sum, the larger (at least 0) or the average of both weights, an absent one being 0. An
        unweighted graph becomes the set of its pairs both ways, whatever the method."""
        if method not in ("sum", "max", "avg"):
            raise ValueError(f"method is sum, max or avg, not {method!r}")
        flipped = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
        both = self.edges.union(flipped)
        if not self.weighted:
            return self._like(both.distinct(), symmetric=True)
        total = {"sum": F.sum("weight"), "avg": F.sum("weight") / 2, "max": F.when(F.count("*") < 2, F.greatest(F.max("weight"), F.lit(0.0))).otherwise(F.max("weight"))}[method]
        return self._like(both.groupBy("src", "dst").agg(total.alias("weight")))

    def add_self_edges(self, weight: float = 1) -> Graph:
        """With a loop at every vertex; weights overwrite those of old loops."""
        return self.add_edges(self.vertices.select(F.col("id").alias("src"), F.col("id").alias("dst")), weight=weight if self.weighted else 1)

    def reweight(self, weights: DataFrame | float, positions: Sequence[int] | None = None) -> Graph:
        """With other weights: one number, or rows ``position, weight`` where positions count the edges by (src, dst) from 0. An
        unweighted graph warns and stays. ``positions`` restricts one number to these edges."""
        if not self.weighted:
            warnings.warn("an unweighted graph can't be reweighted", stacklevel=2)
            return self.copy()
        if isinstance(weights, int | float) and positions is None:
            return self._like(self.edges.withColumn("weight", F.lit(float(weights))))
        spark = self.edges.sparkSession
        if isinstance(weights, int | float):
            weights = spark.createDataFrame([(int(p), float(weights)) for p in positions], "position long, weight double")
        new = weights.select("position", F.col("weight").alias("_w"))
        return self._like(self._positioned().join(new, "position", "left").select("src", "dst", F.coalesce("_w", "weight").alias("weight")))

    def _positioned(self) -> DataFrame:
        """Edges with ``position`` by (src, dst): places within each source, after the edges of the sources before it, which are
        summed in ranges, so no task sees all edges."""
        per = self.edges.groupBy("src").agg(F.count("*").alias("c"))
        own = Window.partitionBy("src").orderBy("dst")
        placed = self.edges.withColumn("_i", F.row_number().over(own) - 1)
        return placed.join(sums_before(per, "src", "c", "_b").select("src", "_b"), "src").select("src", "dst", "weight", (F.col("_b") + F.col("_i")).cast("long").alias("position"))

    def reweight_by_distance(self, points: DataFrame, metric="l2") -> Graph:
        """Each edge weighs the distance of its ends: ``points`` are ``id, x``, or ``i, j, d`` with ``metric="precomputed"``. A
        callable takes two arrays of points and gives all distances, as in ``weft.functions.metrics.pairwise``."""
        if metric == "precomputed":
            got = self.edges.join(points.select(F.col("i").alias("src"), F.col("j").alias("dst"), "d"), ["src", "dst"])
            return self._like(got.select("src", "dst", F.col("d").alias("weight")), weighted=True)
        ends = self.edges.select("src", "dst").join(points.select(F.col("id").alias("src"), F.col("x").alias("a")), "src").join(points.select(F.col("id").alias("dst"), F.col("x").alias("b")), "dst")
        if isinstance(metric, str):
            value: Column = distance(F.col("a").cast("array<double>"), F.col("b").cast("array<double>"), metric)
        else:
            value = _row_metric(metric)(F.col("a").cast("array<double>"), F.col("b").cast("array<double>"))
        return self._like(ends.select("src", "dst", value.alias("weight")), weighted=True)

    def subgraph(self, ids: DataFrame) -> Graph:
        """Of the vertices ``id`` (in the order of ``position`` if there is such a column, else by id), numbered anew from 0.

        Numbering is one running count over the chosen vertices, done in ranges of ids unless there are positions.
        """
        if "position" in ids.columns:
            new = ids.select("id", F.col("position").cast("long").alias("new"))
        else:
            new = numbered(ids.select("id").distinct())
        keep = self.edges.join(new.select(F.col("id").alias("src"), F.col("new").alias("_s")), "src").join(new.select(F.col("id").alias("dst"), F.col("new").alias("_d")), "dst")
        return self._like(keep.select(F.col("_s").alias("src"), F.col("_d").alias("dst"), "weight"), vertices=new.select(F.col("new").alias("id")), symmetric=self.symmetric)

    def permute(self, order: DataFrame) -> Graph:
        """``position, id``: the vertex at each new place."""
        return self.subgraph(order.select("id", "position"))

    # -- handing over ------------------------------------------------------------------------------------------------------

    def to_numpy(self) -> np.ndarray:
        """Dense adjacency matrix on the driver, for small networks: n is bounded by ``weft.plans.linalg.LOCAL_VERTICES``."""
        from weft.plans.linalg import to_dense

        return to_dense(self)

    def _local(self):
        """Ids and edges in order, for a library on the driver; both bounded."""
        from weft.plans.linalg import collected

        return [r.id for r in collected(self.vertices.orderBy("id"), "vertices", LOCAL_EDGES)], [tuple(r) for r in collected(self.edges.orderBy("src", "dst"), "edges", LOCAL_EDGES)]

    def to_networkx(self, directed: bool | None = None):
        import networkx as nx

        ids, edges = self._local()
        out = nx.Graph() if directed is False else nx.DiGraph()
        out.add_nodes_from(ids)
        out.add_weighted_edges_from(edges)
        return out

    def to_igraph(self, weighted: bool | None = None):
        import igraph

        ids, edges = self._local()
        out = igraph.Graph(n=len(ids), edges=[e[:2] for e in edges], directed=True)
        if self.weighted if weighted is None else weighted:
            out.es["weight"] = [e[2] for e in edges]
        return out

    def to_graph_tool(self):
        import graph_tool

        ids, edges = self._local()
        out = graph_tool.Graph(directed=True)
        out.add_vertex(len(ids))
        weight = out.new_edge_property("double")
        out.add_edge_list(edges, eprops=[weight])
        out.edge_properties["weight"] = weight
        return out


def numbered(ids: DataFrame) -> DataFrame:
    """``id, new``: numbers from 0 by id, counted in ranges of ids."""
    return sums_before(ids.select("id", F.lit(1).alias("_one")), "id", "_one", "new").select("id", "new")


def _row_metric(metric, rows: int = 32):
    """A metric of stacks of points for pairs of points: so many pairs go into one call, of whose matrix the diagonal counts."""

    @F.pandas_udf("double")
    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.empty(len(a))
        for k in range(0, len(a), rows):
            out[k : k + rows] = np.diagonal(pairwise(np.stack(a[k : k + rows].to_list()), np.stack(b[k : k + rows].to_list()), metric))
        return pd.Series(out)

    return apply


__all__ = ["Graph", "numbered"]
