"""Queries over the test tables, one for each operator, and the same in DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import weft
from weft.graph import Graph
from weft.operators import analysis, embed, label, transform
from weft.plans.linalg import from_numpy

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Part ids follow supplier ids in the graph of what suppliers sell.
PART = 1_000_000


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(x: Column | str) -> Column:
    return F.round(x, 6) + F.lit(0.0)


# -- inputs --------------------------------------------------------------------------------------------------------------------


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def points(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))


def plane(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).select("id", F.slice("x", 1, 2).alias("x"))


def sold(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + PART).alias("dst"), F.col("l_quantity").alias("weight"))


def supply(spark: SparkSession, d: str) -> Graph:
    """Suppliers to parts, by quantity."""
    rows = sold(spark, d).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    ids = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id")).union(_t(spark, d, "part").select(F.col("p_partkey") + PART))
    return Graph.from_edge_pairs(rows, vertices=ids, weights="weight")


def trade(spark: SparkSession, d: str) -> Graph:
    """Customers' nations to suppliers' nations, by the inverse of thousands of pieces: near where much is traded."""
    rows = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.groupBy("o_custkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    rows = rows.join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.where("c_nationkey <> s_nationkey").groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg((1000 / F.sum("q")).alias("weight"))
    return Graph.from_edge_pairs(rows, vertices=_t(spark, d, "nation").select(F.col("n_nationkey").alias("id")), weights="weight").persisted()


def knn(spark: SparkSession, d: str, k: int = 5) -> Graph:
    return weft.neighbor_graph(points(spark, d), k=k).persisted()


def pairs_1nn(spark: SparkSession, d: str) -> Graph:
    """Nearest neighbours both ways, unweighted: many small components."""
    return Graph.from_edge_pairs(knn(spark, d, 1).edges, vertices=points(spark, d).select("id"), symmetric=True).persisted()


def states(spark: SparkSession, d: str) -> DataFrame:
    """Events of each user in time, as trajectories of (value, seconds since the last)."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.col("ts").cast("timestamp").cast("double")
    gap = seconds - F.coalesce(F.lag(seconds).over(w), seconds)
    return _t(spark, d, "events").select(F.col("user_id").alias("traj_id"), (F.row_number().over(w) - 1).alias("step"), F.array(F.col("value"), F.log1p(gap)).alias("x"))


def lengths(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").groupBy(F.col("user_id").alias("traj_id")).agg(F.count("*").alias("length"))


def partial(spark: SparkSession, d: str) -> DataFrame:
    """A label for each vector, unknown to two of three."""
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 3 == 0, F.col("label")).otherwise(-1).alias("label"))


P = "p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings)"
P2 = "p AS (SELECT vec_id AS id, list_slice(embedding::DOUBLE[], 1, 2) AS x FROM embeddings)"
DIST = P + ", dist AS (SELECT a.id AS s, b.id AS t, list_distance(a.x, b.x) AS d FROM p a, p b)"
DIST2 = P2 + ", dist AS (SELECT a.id AS s, b.id AS t, list_distance(a.x, b.x) AS d FROM p a, p b)"
RANK = DIST + ", r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY d, t) AS k FROM dist WHERE s <> t)"
SOLD = f"sold AS (SELECT l_suppkey AS src, l_partkey + {PART} AS dst, l_quantity AS weight FROM lineitem)"
SUPPLY = SOLD + ", e AS (SELECT src, dst, sum(weight) AS weight FROM sold GROUP BY ALL HAVING sum(weight) <> 0)"
SUPPLY_V = SUPPLY + f", v AS (SELECT s_suppkey AS id FROM supplier UNION ALL SELECT p_partkey + {PART} FROM part)"
TRADE = """t0 AS (SELECT c_nationkey AS src, s_nationkey AS dst, 1000 / sum(l_quantity) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL),
e AS (SELECT src::BIGINT AS src, dst::BIGINT AS dst, weight FROM t0), v AS (SELECT n_nationkey::BIGINT AS id FROM nation)"""
NN1 = RANK + ", half AS (SELECT DISTINCT least(s, t) AS a, greatest(s, t) AS b FROM r WHERE k = 1), e AS (SELECT a AS src, b AS dst FROM half UNION ALL SELECT b, a FROM half), v AS (SELECT id FROM p)"


# -- making --------------------------------------------------------------------------------------------------------------------


@query(f"WITH {SOLD} SELECT src::BIGINT AS src, dst::BIGINT AS dst, count(*)::BIGINT AS n FROM sold GROUP BY src, dst")
def graph_from_pairs(spark, d):
    g = Graph.from_edge_pairs(sold(spark, d), vertices=supply(spark, d).vertices)
    return g.edges.groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(f"WITH {SUPPLY} SELECT src::BIGINT AS src, dst::BIGINT AS dst, round(weight, 6) + 0.0 AS weight FROM e")
def graph_from_weighted_pairs(spark, d):
    return supply(spark, d).edges.select("src", "dst", rounded("weight").alias("weight"))


@query(f"WITH {SOLD}, h AS (SELECT DISTINCT src, dst FROM sold) SELECT src::BIGINT AS src, dst::BIGINT AS dst FROM h UNION ALL SELECT dst, src FROM h")
def graph_from_symmetric_pairs(spark, d):
    return Graph.from_edge_pairs(sold(spark, d), vertices=supply(spark, d).vertices, symmetric=True).pairs()


@query(f"""WITH l AS (SELECT l_suppkey AS a, l_partkey + {PART} AS b, l_quantity AS w, l_orderkey * 8 + l_linenumber AS o FROM lineitem),
h AS (SELECT a, b, max_by(w, o) AS w FROM l GROUP BY a, b) SELECT a::BIGINT AS src, b::BIGINT AS dst, w AS weight FROM h UNION ALL SELECT b, a, w FROM h""")
def graph_from_symmetric_weighted_pairs(spark, d):
    rows = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + PART).alias("dst"), F.col("l_quantity").alias("weight"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("o"))
    return Graph.from_edge_pairs(rows, vertices=supply(spark, d).vertices, symmetric=True, weights="weight", order="o").edges


@query("""WITH c AS (SELECT vec_id AS src, unnest(embedding)::DOUBLE AS w, generate_subscripts(embedding, 1) - 1 AS dst FROM embeddings)
SELECT src, dst::BIGINT AS dst, round(w, 6) + 0.0 AS weight FROM c WHERE w <> 0""")
def graph_from_adjacency_rows(spark, d):
    g = Graph.from_adj_rows(points(spark, d), row_col="x")
    return g.edges.select("src", "dst", rounded("weight").alias("weight"))


@query(f"WITH {RANK} SELECT s AS src, t AS dst, round(d, 6) AS weight FROM r WHERE k <= 5 AND d <> 0")
def graph_knn(spark, d):
    return weft.neighbor_graph(points(spark, d), k=5).edges.select("src", "dst", rounded("weight").alias("weight"))


@query(f"WITH {RANK} SELECT id, count(r.t)::DOUBLE AS degree FROM p LEFT JOIN (SELECT * FROM r WHERE k <= 5) r ON r.t = p.id GROUP BY id")
def graph_knn_degree(spark, d):
    return weft.neighbor_graph(points(spark, d), k=5, weighting="binary").degree("in")


@query(f"WITH {DIST} SELECT s AS src, t AS dst, round(d, 6) AS weight FROM dist WHERE s <> t AND d <= 1.2 AND d <> 0")
def graph_epsilon(spark, d):
    return weft.neighbor_graph(points(spark, d), epsilon=1.2).edges.select("src", "dst", rounded("weight").alias("weight"))


@query(f"WITH {RANK} SELECT s AS src, t AS dst, 1::DOUBLE AS weight FROM r WHERE k <= 4 AND d <= 1.25")
def graph_knn_epsilon(spark, d):
    return weft.neighbor_graph(points(spark, d), k=4, epsilon=1.25, weighting="binary").edges


@query(f"WITH {TRADE}, r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight, dst) AS k FROM e) SELECT src, dst, round(weight, 6) AS weight FROM r WHERE k <= 3")
def graph_knn_precomputed(spark, d):
    rows = trade(spark, d).edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("weight").alias("d"))
    return weft.neighbor_graph(rows, k=3, precomputed=True).edges.select("src", "dst", rounded("weight").alias("weight"))


@query(f"WITH {DIST}, r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY d, t) AS k FROM dist) SELECT s AS qid, t AS tid, round(d, 6) AS dist FROM r WHERE k <= 3")
def nearest_neighbors(spark, d):
    return weft.nearest_neighbors(points(spark, d), k=3).select("qid", "tid", rounded("dist").alias("dist"))


@query(f"""WITH {P}, dist AS (SELECT a.id AS s, b.id AS t, list_sum(list_transform(list_zip(a.x, b.x), lambda z: abs(z[1] - z[2]))) AS d FROM p a, p b WHERE a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY d, t) AS k FROM dist) SELECT s AS src, t AS dst, round(d, 6) AS weight FROM r WHERE k <= 2""")
def graph_knn_manhattan(spark, d):
    return weft.neighbor_graph(points(spark, d), k=2, metric="l1").edges.select("src", "dst", rounded("weight").alias("weight"))


@query(f"""WITH {P}, dist AS (SELECT a.id AS s, b.id AS t, 1 - list_cosine_similarity(a.x, b.x) AS d FROM p a, p b WHERE a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY d, t) AS k FROM dist) SELECT s AS src, t AS dst, round(d, 6) AS weight FROM r WHERE k <= 2""")
def graph_knn_cosine(spark, d):
    return weft.neighbor_graph(points(spark, d), k=2, metric="cosine").edges.select("src", "dst", rounded("weight").alias("weight"))


@query(f"WITH {RANK}, st AS (SELECT unnest([0, 1, 2]) AS step, unnest([1, 2, 4]) AS n) SELECT step::INTEGER AS step, s AS src, t AS dst, round(d, 6) AS weight FROM r JOIN st ON k <= n AND d <= 1.3")
def incremental_neighbors_k(spark, d):
    return weft.incremental_edges(points(spark, d), k=[1, 2, 4], epsilon=1.3).select("step", "src", "dst", rounded("weight").alias("weight"))


@query(f"WITH {RANK}, st AS (SELECT unnest([0, 1, 2]) AS step, unnest([1.1, 1.15, 1.2]) AS e) SELECT step::INTEGER AS step, s AS src, t AS dst, round(d, 6) AS weight FROM r JOIN st ON k <= 10 AND d < e")
def incremental_neighbors_epsilon(spark, d):
    return weft.incremental_edges(points(spark, d), k=10, epsilon=[1.1, 1.15, 1.2]).select("step", "src", "dst", rounded("weight").alias("weight"))


def _half(g: Graph) -> DataFrame:
    return g.edges.where("src < dst").select("src", "dst", rounded("weight").alias("weight"))


@query(f"""WITH {DIST2}, m AS (SELECT a.id AS s, b.id AS t, list_distance(a.x, b.x) AS d, [(a.x[1] + b.x[1]) / 2, (a.x[2] + b.x[2]) / 2] AS c FROM p a, p b WHERE a.id < b.id)
SELECT s AS src, t AS dst, round(d, 6) AS weight FROM m WHERE NOT EXISTS (SELECT 1 FROM p WHERE id <> s AND id <> t AND d - 2 * list_distance(c, p.x) >= 1e-10)""")
def gabriel_graph(spark, d):
    return _half(weft.gabriel_graph(plane(spark, d), weighted=True))


@query(f"""WITH {DIST2} SELECT s AS src, t AS dst, round(d, 6) AS weight FROM dist o WHERE s < t
AND NOT EXISTS (SELECT 1 FROM dist a JOIN dist b ON a.t = b.t WHERE a.s = o.s AND b.s = o.t AND a.d < o.d AND b.d < o.d AND a.t <> o.s AND a.t <> o.t)""")
def relative_neighborhood_graph(spark, d):
    return _half(weft.relative_neighborhood_graph(plane(spark, d), weighted=True))


# A pair is a side if some circle through both is empty: each other point bounds how far its centre may lie along the middle line, to one side or the other.
SIDES = f"""{P2}, m AS (SELECT a.id AS s, b.id AS t, a.x AS xa, list_distance(a.x, b.x) AS d, (a.x[1] + b.x[1]) / 2 AS mx, (a.x[2] + b.x[2]) / 2 AS my, a.x[2] - b.x[2] AS nx, b.x[1] - a.x[1] AS ny FROM p a, p b WHERE a.id < b.id),
w AS (SELECT s, t, d, nx * (p.x[1] - mx) + ny * (p.x[2] - my) AS g, (p.x[1] - mx) ** 2 + (p.x[2] - my) ** 2 - d * d / 4 AS h FROM m, p WHERE p.id <> s AND p.id <> t),
side AS MATERIALIZED (SELECT s, t, any_value(d) AS d FROM w GROUP BY s, t HAVING coalesce(max(h / g) FILTER (WHERE g < 0), '-inf'::DOUBLE) < coalesce(min(h / g) FILTER (WHERE g > 0), 'inf'::DOUBLE))"""


@query(f"WITH {SIDES} SELECT s AS src, t AS dst, round(d, 6) AS weight FROM side")
def delaunay_graph(spark, d):
    return _half(weft.delaunay_graph(plane(spark, d), weighted=True))


# Three sides are a triangle of the triangulation if no point lies in the circle through their ends; a side stays if it isn't the longest of one of its triangles.
@query(f"""WITH {SIDES}, three AS (SELECT x.s AS i, x.t AS j, y.t AS k, x.d AS dij, y.d AS djk, z.d AS dik FROM side x JOIN side y ON y.s = x.t JOIN side z ON z.s = x.s AND z.t = y.t),
c AS (SELECT three.*, a.x AS pa, b.x[1] - a.x[1] AS bx, b.x[2] - a.x[2] AS b_y, c.x[1] - a.x[1] AS cx, c.x[2] - a.x[2] AS cy FROM three JOIN p a ON a.id = i JOIN p b ON b.id = j JOIN p c ON c.id = k),
o AS (SELECT *, (cy * (bx * bx + b_y * b_y) - b_y * (cx * cx + cy * cy)) / (2 * (bx * cy - b_y * cx)) AS ux, (bx * (cx * cx + cy * cy) - cx * (bx * bx + b_y * b_y)) / (2 * (bx * cy - b_y * cx)) AS uy FROM c),
tri AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.id NOT IN (i, j, k) AND (p.x[1] - pa[1] - ux) ** 2 + (p.x[2] - pa[2] - uy) ** 2 < (ux * ux + uy * uy) * (1 - 1e-9))),
lines AS (SELECT i AS s, j AS t, dij AS d, greatest(dij, djk, dik) AS longest FROM tri UNION ALL SELECT j, k, djk, greatest(dij, djk, dik) FROM tri UNION ALL SELECT i, k, dik, greatest(dij, djk, dik) FROM tri)
SELECT DISTINCT s AS src, t AS dst, round(d, 6) AS weight FROM lines WHERE d < longest""")
def urquhart_graph(spark, d):
    return _half(weft.urquhart_graph(plane(spark, d), weighted=True))


def _grown(trees: int) -> str:
    """Trees grown from the first point: each time the nearest point outside comes in. Each tree goes without the pairs of those before."""
    out = f"""{P}, o AS (SELECT row_number() OVER (ORDER BY id) AS i, id, x FROM p), sz AS (SELECT count(*) AS n FROM p),
m1 AS MATERIALIZED (SELECT a.i, list(CASE WHEN list_distance(a.x, b.x) = 0 THEN 'inf'::DOUBLE ELSE list_distance(a.x, b.x) END ORDER BY b.i) AS d FROM o a, o b GROUP BY a.i)"""
    for t in range(1, trees + 1):
        out += f""",
g{t}(k, near, origin, a, b, w) AS (
  SELECT 1::BIGINT, list_concat([NULL::DOUBLE], d[2:]), list_transform(d, lambda z: 1::BIGINT), 0::BIGINT, 0::BIGINT, 0::DOUBLE FROM m{t} WHERE i = 1
  UNION ALL
  SELECT k + 1, list_transform(range(1, len(near) + 1), lambda z: CASE WHEN z = j OR near[z] IS NULL THEN NULL ELSE least(near[z], m.d[z]) END),
         list_transform(range(1, len(near) + 1), lambda z: CASE WHEN m.d[z] < near[z] THEN j ELSE origin[z] END), origin[j], j, w0
  FROM (SELECT k, near, origin, list_min(near) AS w0, list_position(near, list_min(near))::BIGINT AS j FROM g{t}, sz WHERE k < n) s JOIN m{t} m ON m.i = s.j WHERE w0 < 'inf'::DOUBLE
),
t{t} AS MATERIALIZED (SELECT least(a, b) AS a, greatest(a, b) AS b, w FROM g{t} WHERE a > 0)"""
        if t < trees:
            out += f""",
u{t} AS (SELECT i, list(j) AS js FROM (SELECT a AS i, b AS j FROM t{t} UNION ALL SELECT b, a FROM t{t}) GROUP BY i),
m{t + 1} AS MATERIALIZED (SELECT m.i, list_transform(range(1, len(d) + 1), lambda z: CASE WHEN list_contains(coalesce(js, []), z) THEN 'inf'::DOUBLE ELSE d[z] END) AS d FROM m{t} m LEFT JOIN u{t} u ON u.i = m.i)"""
    whole = " UNION ALL ".join(f"SELECT * FROM t{t}" for t in range(1, trees + 1))
    return f"WITH RECURSIVE {out}, whole AS ({whole}) SELECT x.id AS src, y.id AS dst, round(w, 6) AS weight FROM whole JOIN o x ON x.i = a JOIN o y ON y.i = b"


@query(_grown(1))
def mst(spark, d):
    return _half(weft.mst(points(spark, d)))


@query(_grown(3))
def disjoint_mst(spark, d):
    return _half(weft.disjoint_mst(points(spark, d)))


@query()
def perturbed_mst(spark, d):
    return _half(weft.perturbed_mst(points(spark, d), num_perturbations=20))


@query()
def b_matching(spark, d):
    rows = trade(spark, d).symmetrize("avg").edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("weight").alias("d"))
    return weft.b_matching(rows, 3, damping=0.5, weighted=True).edges.select("src", "dst", rounded("weight").alias("weight"))


@query()
def directed_trajectory_graph(spark, d):
    return weft.directed_graph(states(spark, d), k=5).edges.select("src", "dst", rounded("weight").alias("weight"))


@query(f"""WITH {P}, l AS (SELECT vec_id AS id, label FROM embeddings), d AS (
  SELECT la.label AS c1, lb.label AS c2, list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d, a.id AS i, b.id AS j
  FROM p a JOIN l la ON la.id = a.id, p b JOIN l lb ON lb.id = b.id WHERE la.label < lb.label)
SELECT c1::BIGINT AS c1, c2::BIGINT AS c2, round(min(d), 6) AS d, arg_min(i, (d, i, j)) AS i, arg_min(j, (d, i, j)) AS j FROM d GROUP BY 1, 2""")
def inter_cluster_distance(spark, d):
    labels = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"))
    return weft.inter_cluster_distance(points(spark, d), labels).select("c1", "c2", rounded("d").alias("d"), "i", "j")


@query(f"""WITH {P}, c AS (SELECT label, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM p JOIN (SELECT vec_id, label FROM embeddings) ON vec_id = id)
SELECT label::BIGINT AS label, i::INTEGER AS i, round(avg(v), 6) + 0.0 AS mean, 1.0::DOUBLE AS length FROM c GROUP BY label, i""")
def cluster_subspaces(spark, d):
    """Means, and the length of the first axis for each coordinate."""
    from weft.operators.manifold import cluster_subspaces as subspaces

    labels = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    own = subspaces(points(spark, d), labels, 1)
    length = F.sqrt(F.aggregate("axes", F.lit(0.0), lambda s, v: s + v * v))
    return own.select("label", rounded(length).alias("length"), F.posexplode("mean").alias("i", "v")).select("label", (F.col("i") + 1).alias("i"), rounded("v").alias("mean"), "length")


@query()
def manifold_spanning_graph(spark, d):
    return _half(weft.manifold_spanning_graph(points(spark, d), 1))


@query()
def flesh_out(spark, d):
    """The tree of nearest ways with more edges, between the vectors' labels as first parts."""
    labels = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return _half(weft.flesh_out(points(spark, d), weft.mst(points(spark, d)), 2, labels, angle_thresh=0.9))


@query()
def saffron_graph(spark, d):
    return weft.saffron(points(spark, d), q=32, k=4).edges.select("src", "dst", rounded("weight").alias("weight"))


@query()
def sparse_regularized_graph(spark, d):
    return weft.sparse_regularized_graph(points(spark, d), sparsity_param=0.002, kmax=10).edges.select("src", "dst", F.round("weight", 4).alias("weight"))


@query()
def smce_graph(spark, d):
    return weft.smce_graph(points(spark, d), kmax=10).edges.select("src", "dst", F.round("weight", 4).alias("weight"))


# -- generators and data -------------------------------------------------------------------------------------------------------


@query("WITH h AS (SELECT i AS a, (i + 1) % 100 AS b FROM range(100) t(i)) SELECT a::BIGINT AS src, b::BIGINT AS dst FROM h UNION ALL SELECT b, a FROM h")
def chain_graph(spark, d):
    return weft.chain_graph(spark, 100, wraparound=True).pairs()


@query("""WITH c AS (SELECT r, q, r + 6 * q AS id FROM range(6) a(r), range(9) b(q)), h AS (
SELECT a.id AS s, b.id AS t FROM c a JOIN c b ON (b.r = a.r + 1 AND b.q = a.q) OR (b.q = a.q + 1 AND b.r = a.r)) SELECT s::BIGINT AS src, t::BIGINT AS dst FROM h UNION ALL SELECT t, s FROM h""")
def lattice_graph(spark, d):
    return weft.lattice_graph(spark, (6, 9)).pairs()


@query("WITH n AS (SELECT s_suppkey AS k, s_suppkey % 7 AS degree FROM supplier) SELECT (row_number() OVER (ORDER BY k) - 1)::BIGINT AS id, degree::DOUBLE AS degree, 0::BIGINT AS loops FROM n")
def random_graph_degrees(spark, d):
    from weft.graph import numbered

    own = numbered(_t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))).select(F.col("new").alias("id"), (F.col("id") % 7).alias("degree"))
    g = weft.random_graph(own, seed=3)
    loops = g.edges.agg(F.count_if((F.col("src") == F.col("dst"))).alias("loops"))
    return Graph(g.vertices, g.edges.distinct(), weighted=False).degree().crossJoin(loops)


LENGTHS = "n AS (SELECT user_id, count(*) AS len FROM events GROUP BY 1), b AS (SELECT *, coalesce(sum(len) OVER (ORDER BY user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM n)"


@query(f"WITH {LENGTHS}, s AS (SELECT b, len, unnest(range(len)) AS s FROM b) SELECT (b + s)::BIGINT AS src, (b + s + 1)::BIGINT AS dst FROM s WHERE s + 1 < len")
def concat_trajectories(spark, d):
    return weft.concat_trajectories(spark, lengths(spark, d), directed=True).pairs()


@query(f"""WITH {LENGTHS}, s AS (SELECT b, len, unnest(range(len)) AS s FROM b), c AS (SELECT *, greatest(len // 4 - 1, 0) AS last FROM s)
SELECT (b + s)::BIGINT AS src, (b + s + 1)::BIGINT AS dst FROM c WHERE s + 1 < len AND least(s // 4, last) = least((s + 1) // 4, last)""")
def chunk_trajectories(spark, d):
    return weft.chunk_up(spark, lengths(spark, d), chunk_size=4, directed=True).pairs()


@query("""WITH t AS (SELECT i, 1 + 5 * i / 999.0::DOUBLE AS theta, 4.8 * sqrt(i / 999.0::DOUBLE) AS r FROM range(1000) a(i))
SELECT i::BIGINT AS id, round(r * sin(theta), 6) + 0.0 AS x, round(r * cos(theta), 6) + 0.0 AS z, round(theta, 6) AS theta FROM t""")
def swiss_roll(spark, d):
    own = weft.swiss_roll(spark, 6, 1000, radius=4.8, theta_noise=0, radius_noise=0)
    return own.select("id", rounded(F.col("x")[0]).alias("x"), rounded(F.col("x")[2]).alias("z"), rounded("theta").alias("theta"))


@query(f"""WITH {RANK}, e AS (SELECT a.x[1] AS u, b.x[1] AS w FROM r JOIN p a ON a.id = s JOIN p b ON b.id = t WHERE k <= 5)
SELECT count(*) FILTER (WHERE abs(u - w) > 0.1) AS errors, count(*) AS edges, round(count(*) FILTER (WHERE abs(u - w) > 0.1) / count(*), 6) AS ratio FROM e""")
def error_ratio(spark, d):
    return weft.error_ratio(weft.neighbor_graph(points(spark, d), k=5), points(spark, d)).select("errors", "edges", rounded("ratio").alias("ratio"))


@query("""WITH t AS (SELECT i, 2 * pi() * i / 499.0::DOUBLE AS a FROM range(500) b(i)) SELECT i::BIGINT AS id, round(sin(a), 6) + 0.0 AS x, round(sin(a) * cos(a), 6) + 0.0 AS y FROM t""")
def figure_eight(spark, d):
    return weft.FigureEight().point_cloud(spark, 500).select("id", rounded(F.col("x")[0]).alias("x"), rounded(F.col("x")[1]).alias("y"))


# Where a parameter is random, what holds for any value of it: the strip's angle and slope, the figure's equation.
@query("""WITH i AS (SELECT range AS i, 2 * pi() * range / 199.0::DOUBLE AS t, -pi() - 1 + (2 * pi() + 2) * range / 199.0::DOUBLE AS u FROM range(200))
SELECT 'mobius' AS shape, i AS id, round(atan2(sin(t), cos(t)), 6) + 0.0 AS a, 0.0::DOUBLE AS b FROM i
UNION ALL SELECT 's_curve', i, round(sin(u), 6) + 0.0, round(CASE WHEN i < 100 THEN 2 - cos(u) ELSE cos(u) END, 6) + 0.0 FROM i UNION ALL SELECT 'figure_eight', i % 40, i % 40, 0 FROM i""")
def shapes(spark, d):
    x, y, z = (F.col("x")[i] for i in range(3))
    strip = weft.MobiusStrip().point_cloud(spark, 200).withColumn("t", 2 * F.pi() * F.col("id") / 199.0)
    strip = strip.select(F.lit("mobius").alias("shape"), "id", rounded(F.atan2(y, x)).alias("a"), rounded(z * F.cos(F.col("t") / 2) - (F.hypot(x, y) - 1) * F.sin(F.col("t") / 2)).alias("b"))
    curve = weft.SCurve().point_cloud(spark, 200).select(F.lit("s_curve"), "id", rounded(x), rounded(z))
    eight = weft.FigureEight(dimension=3).trajectories(spark, 5, 40)
    return strip.union(curve).union(eight.select(F.lit("figure_eight"), F.col("step").cast("long"), F.col("step").cast("double"), rounded(y * y - x * x * (1 - x * x))))


@query()
def mountain_car(spark, d):
    return weft.mountain_car_trajectories(weft.mountain_car_traces(spark, 20))


@query(f"""WITH RECURSIVE {DIST}, o AS (SELECT id, row_number() OVER (ORDER BY id) AS i, (SELECT coalesce(list(t), []) FROM dist WHERE s = id AND t < id AND d <= 1.2) AS near FROM p),
c(i, taken) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT c.i + 1, CASE WHEN list_has_any(taken, near) THEN taken ELSE list_append(taken, o.id) END FROM c JOIN o ON o.i = c.i + 1)
SELECT unnest(taken) AS id FROM c WHERE i = (SELECT count(*) FROM p)""")
def epsilon_net(spark, d):
    return weft.epsilon_net(points(spark, d), 1.2)


@query()
def fuzzy_c_means(spark, d):
    return weft.fuzzy_c_means(points(spark, d), 8)


@query(f"""WITH s AS (SELECT user_id AS traj_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS id FROM events)
SELECT traj_id, step::BIGINT AS step FROM s WHERE id % 3 = 0""")
def downsample_trajectories(spark, d):
    return weft.downsample_trajectories(states(spark, d), lambda p: p.where("id % 3 = 0")).select("traj_id", F.col("step").cast("long").alias("step"))


# -- reading and changing ------------------------------------------------------------------------------------------------------


@query(f"WITH {SUPPLY} SELECT src::BIGINT AS src, dst::BIGINT AS dst FROM e WHERE src <= dst")
def undirected_pairs(spark, d):
    return supply(spark, d).pairs(directed=False)


@query(f"WITH {SUPPLY_V} SELECT (SELECT count(*) FROM e)::BIGINT AS edges, (SELECT count(*) FROM v)::BIGINT AS vertices")
def graph_counts(spark, d):
    g = supply(spark, d)
    return g.edges.agg(F.count("*").alias("edges")).crossJoin(g.vertices.agg(F.count("*").alias("vertices")))


@query(f"WITH {SUPPLY} SELECT src::BIGINT AS i, dst::BIGINT AS j, round(weight, 6) AS value FROM e")
def adjacency_matrix(spark, d):
    return supply(spark, d).matrix().select("i", "j", rounded("value").alias("value"))


@query(f"WITH {SUPPLY} SELECT src::BIGINT AS src, dst::BIGINT AS dst, round(weight, 6) AS weight FROM e WHERE src <= dst")
def edge_weights(spark, d):
    return supply(spark, d).edge_weights(directed=False).select("src", "dst", rounded("weight").alias("weight"))


@query(f"""WITH {SUPPLY}, {RANK}, h AS (SELECT * FROM r WHERE k <= 1) SELECT 'supply' AS name, true AS weighted, true AS directed, (SELECT count(*) FROM e)::BIGINT AS edges
UNION ALL SELECT 'nearest', false, true, (SELECT count(DISTINCT (least(s, t), greatest(s, t))) * 2 FROM h)::BIGINT""")
def graph_flags(spark, d):
    rows = [(name, g.is_weighted(), g.is_directed(), g.copy().num_edges()) for name, g in (("supply", supply(spark, d)), ("nearest", pairs_1nn(spark, d)))]
    return spark.createDataFrame(rows, "name string, weighted boolean, directed boolean, edges long")


NEW = f"n AS (SELECT DISTINCT l_suppkey AS src, l_partkey + {PART} AS dst FROM lineitem WHERE l_returnflag = 'R')"


def _returned(spark, d):
    return _t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + PART).alias("dst")).distinct()


@query(f"WITH {SUPPLY}, {NEW}, s AS (SELECT src, dst FROM n UNION SELECT dst, src FROM n) SELECT src::BIGINT AS src, dst::BIGINT AS dst, 2::DOUBLE AS weight FROM s UNION ALL SELECT src, dst, round(weight, 6) FROM e WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.src = e.src AND s.dst = e.dst)")
def add_edges(spark, d):
    return supply(spark, d).add_edges(_returned(spark, d), weight=2, symmetric=True).edges.select("src", "dst", rounded("weight").alias("weight"))


@query(f"WITH {SUPPLY}, {NEW} SELECT src::BIGINT AS src, dst::BIGINT AS dst FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.src = e.src AND n.dst = e.dst)")
def remove_edges(spark, d):
    return supply(spark, d).remove_edges(_returned(spark, d), symmetric=True).pairs()


for _how, _sql in {"sum": "sum(weight)", "max": "CASE WHEN count(*) = 1 THEN greatest(max(weight), 0) ELSE max(weight) END", "avg": "sum(weight) / 2"}.items():

    def _symmetrized(spark, d, how=_how):
        g = knn(spark, d)
        return g.symmetrize(how).edges.select("src", "dst", rounded("weight").alias("weight"))

    _symmetrized.__name__ = f"symmetrize_{_how}"
    query(f"WITH {RANK}, e AS (SELECT s AS src, t AS dst, d AS weight FROM r WHERE k <= 5), b AS (SELECT * FROM e UNION ALL SELECT dst, src, weight FROM e) SELECT src, dst, round({_sql}, 6) AS weight FROM b GROUP BY src, dst")(_symmetrized)


@query(f"WITH {SUPPLY_V} SELECT src::BIGINT AS src, dst::BIGINT AS dst, round(weight, 6) AS weight FROM e UNION ALL SELECT id, id, 3 FROM v")
def self_edges(spark, d):
    return supply(spark, d).add_self_edges(3).edges.select("src", "dst", rounded("weight").alias("weight"))


@query(f"WITH {SUPPLY}, o AS (SELECT *, row_number() OVER (ORDER BY src, dst) - 1 AS i FROM e) SELECT src::BIGINT AS src, dst::BIGINT AS dst, CASE WHEN i % 2 = 0 THEN i + 0.5 ELSE weight END::DOUBLE AS weight FROM o")
def reweight(spark, d):
    g = supply(spark, d)
    n = g.num_edges()
    new = spark.range(0, n, 2).select(F.col("id").alias("position"), (F.col("id") + 0.5).alias("weight"))
    return g.reweight(new).edges


@query(f"WITH {P}, r AS (SELECT vec_id AS s, (vec_id + 1) % (SELECT count(*) FROM embeddings) AS t FROM embeddings) SELECT s AS src, t::BIGINT AS dst, round(list_distance(a.x, b.x), 6) AS weight FROM r JOIN p a ON a.id = s JOIN p b ON b.id = t")
def reweight_by_distance(spark, d):
    own = points(spark, d)
    n = own.count()
    g = Graph(own.select("id"), own.select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"), F.lit(1.0).alias("weight")))
    return g.reweight_by_distance(own).edges.select("src", "dst", rounded("weight").alias("weight"))


@query(f"WITH {P}, r AS (SELECT vec_id AS s, (vec_id + 1) % (SELECT count(*) FROM embeddings) AS t FROM embeddings) SELECT s AS src, t::BIGINT AS dst, round(list_max(list_transform(list_zip(a.x, b.x), lambda z: abs(z[1] - z[2]))), 6) AS weight FROM r JOIN p a ON a.id = s JOIN p b ON b.id = t")
def reweight_by_callable(spark, d):
    """A metric of the user's own, from two stacks of points to a matrix: the largest difference of a coordinate."""
    own = points(spark, d)
    n = own.count()
    g = Graph(own.select("id"), own.select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"), F.lit(1.0).alias("weight")))
    return g.reweight_by_distance(own, lambda a, b: abs(a[:, None] - b[None]).max(2)).edges.select("src", "dst", rounded("weight").alias("weight"))


@query(f"WITH {RANK}, e AS (SELECT * FROM r WHERE k <= 5) SELECT s AS src, t AS dst, round(exp(-d / (SELECT stddev_pop(d) FROM e)), 6) AS weight FROM e")
def kernelize_rbf(spark, d):
    return knn(spark, d).kernelize("rbf").edges.select("src", "dst", rounded("weight").alias("weight"))


@query(f"""WITH {SUPPLY_V}, s AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM v WHERE id % 3 <> 1)
SELECT a.i::BIGINT AS src, b.i::BIGINT AS dst, round(weight, 6) AS weight FROM e JOIN s a ON a.id = src JOIN s b ON b.id = dst""")
def subgraph(spark, d):
    g = supply(spark, d)
    return g.subgraph(g.vertices.where("id % 3 <> 1")).edges.select("src", "dst", rounded("weight").alias("weight"))


@query(f"WITH {RANK}, n AS (SELECT count(*) AS n FROM p) SELECT n - 1 - s AS src, n - 1 - t AS dst, round(d, 6) AS weight FROM r, n WHERE k <= 5")
def permute_graph(spark, d):
    g = knn(spark, d)
    n = g.num_vertices()
    return g.permute(g.vertices.select((n - 1 - F.col("id")).alias("position"), "id")).edges.select("src", "dst", rounded("weight").alias("weight"))


@query(f"WITH {SUPPLY_V} SELECT id::BIGINT AS id, coalesce((SELECT string_agg(dst::BIGINT::VARCHAR, ',' ORDER BY dst) FROM e WHERE src = id), '') AS neighbors FROM v")
def adjacency_lists(spark, d):
    return supply(spark, d).adj_list().select("id", F.array_join("neighbors", ",").alias("neighbors"))


@query(f"""WITH {SUPPLY_V} SELECT id::BIGINT AS id, coalesce((SELECT sum(weight) FROM e WHERE src = id), 0)::DOUBLE AS out_weight, (SELECT count(*) FROM e WHERE dst = id)::DOUBLE AS in_edges FROM v""")
def degrees(spark, d):
    g = supply(spark, d)
    return g.degree("out").withColumnRenamed("degree", "out_weight").join(g.degree("in", weighted=False).withColumnRenamed("degree", "in_edges"), "id").select("id", rounded("out_weight").alias("out_weight"), "in_edges")


# -- analysis ------------------------------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {NN1}, c(v, l) USING KEY (v) AS (SELECT id, id FROM v UNION
(SELECT e.dst, min(c.l) FROM c JOIN e ON e.src = c.v JOIN recurring.c r ON r.v = e.dst WHERE c.l < r.l GROUP BY e.dst))
SELECT v AS id, (dense_rank() OVER (ORDER BY l) - 1)::BIGINT AS component, l AS root FROM c""")
def connected_components(spark, d):
    return pairs_1nn(spark, d).connected_components()


@query(f"""WITH RECURSIVE {RANK}, e AS (SELECT s AS src, t AS dst FROM r WHERE k = 1), h(s, t) AS (SELECT id, id FROM p UNION SELECT h.s, e.dst FROM h JOIN e ON e.src = h.t),
m AS (SELECT a.s AS id, min(a.t) AS root FROM h a JOIN h b ON b.s = a.t AND b.t = a.s GROUP BY 1) SELECT id, (dense_rank() OVER (ORDER BY root) - 1)::BIGINT AS component, root FROM m""")
def strong_components(spark, d):
    return analysis.connected_components(knn(spark, d, 1), connection="strong")


LAP = "a AS (SELECT s AS i, t AS j, d AS w FROM r WHERE k <= 5), dg AS (SELECT id, coalesce((SELECT sum(w) FROM a WHERE j = id), 0) AS g FROM p)"


@query(f"WITH {RANK}, {LAP} SELECT i, j, round(-w, 6) AS value FROM a UNION ALL SELECT id, id, round(g, 6) + 0.0 FROM dg")
def laplacian(spark, d):
    return knn(spark, d).laplacian().select("i", "j", rounded("value").alias("value"))


@query(f"WITH {RANK}, {LAP}, q AS (SELECT id, CASE WHEN g = 0 THEN 1 ELSE sqrt(g) END AS q, CASE WHEN g = 0 THEN 0 ELSE 1 END AS o FROM dg) SELECT i, j, round(-w / x.q / y.q, 6) + 0.0 AS value FROM a JOIN q x ON x.id = i JOIN q y ON y.id = j UNION ALL SELECT id, id, o FROM q")
def laplacian_normed(spark, d):
    return knn(spark, d).laplacian(normed=True).select("i", "j", rounded("value").alias("value"))


@query(f"""WITH {TRADE}, g AS (SELECT dst AS id, sum(weight) AS g FROM e GROUP BY 1), c AS (SELECT src AS i, dst AS j, -weight / g AS w FROM e JOIN g ON g.id = src UNION ALL SELECT id, id, 1 FROM v),
b AS (SELECT * FROM c UNION ALL SELECT j, i, w FROM c) SELECT i, j, round(sum(w) / 2, 6) + 0.0 AS value FROM b GROUP BY i, j""")
def ave_laplacian(spark, d):
    return trade(spark, d).ave_laplacian().select("i", "j", rounded("value").alias("value"))


@query(f"""WITH RECURSIVE {TRADE}, w AS (SELECT src AS i, dst AS j, weight / sum(weight) OVER (PARTITION BY src) AS p FROM e), n AS (SELECT count(*)::DOUBLE AS n FROM v),
f(k, id, phi) AS (SELECT 0, id, 1 / n FROM v, n UNION ALL
  (SELECT k + 1, j, sum(phi * (0.99 * coalesce(p, 0) + 0.01 / n)) FROM (SELECT f.k, f.phi, v.id AS j, w.p, n.n FROM f JOIN v ON true CROSS JOIN n LEFT JOIN w ON w.i = f.id AND w.j = v.id WHERE f.k < 60) GROUP BY k, j)),
x AS (SELECT id, phi FROM f WHERE k = 60), m AS (SELECT a.id AS i, b.id AS j, a.phi AS fi, b.phi AS fj, 0.99 * coalesce(w1.p, 0) + 0.01 / n AS p, 0.99 * coalesce(w2.p, 0) + 0.01 / n AS q
  FROM x a JOIN x b ON true CROSS JOIN n LEFT JOIN w w1 ON w1.i = a.id AND w1.j = b.id LEFT JOIN w w2 ON w2.i = b.id AND w2.j = a.id)
SELECT i, j, round(CASE WHEN i = j THEN fi ELSE 0 END - (fi * p + fj * q) / 2, 6) + 0.0 AS value FROM m""")
def directed_laplacian(spark, d):
    return trade(spark, d).directed_laplacian().select("i", "j", rounded("value").alias("value"))


@query(f"WITH {RANK} SELECT max(abs(s - t)) AS bandwidth FROM r WHERE k <= 5")
def bandwidth(spark, d):
    return knn(spark, d).bandwidth()


@query(f"WITH {RANK} SELECT sum(id - coalesce((SELECT min(s) FROM r WHERE k <= 5 AND t = id), 0))::BIGINT AS profile FROM p")
def profile(spark, d):
    return knn(spark, d).profile()


APSP = f"""{TRADE}, ap(n, src, dst, d) AS (SELECT 0, a.id, b.id, CASE WHEN a.id = b.id THEN 0 ELSE coalesce(weight, 'inf'::DOUBLE) END FROM v a JOIN v b ON true LEFT JOIN e ON e.src = a.id AND e.dst = b.id
UNION ALL (SELECT n + 1, a, c, min(x) FROM (SELECT p.n, p.src AS a, q.dst AS c, p.d + q.d AS x FROM ap p JOIN ap q ON p.dst = q.src WHERE p.n < 5) GROUP BY n, a, c)), far AS (SELECT src, dst, d FROM ap WHERE n = 5)"""


@query(f"WITH RECURSIVE {APSP} SELECT src, dst, round(d, 6) + 0.0 AS dist FROM far WHERE d < 'inf'::DOUBLE")
def shortest_paths(spark, d):
    return trade(spark, d).shortest_path().select("src", "dst", rounded("dist").alias("dist"))


@query(f"""WITH RECURSIVE {NN1}, h(src, dst, n) AS (SELECT id, id, 0 FROM v UNION SELECT h.src, e.dst, h.n + 1 FROM h JOIN e ON e.src = h.dst WHERE h.n < 3)
SELECT src, dst, min(n)::DOUBLE AS dist FROM h GROUP BY src, dst""")
def shortest_paths_limited(spark, d):
    return pairs_1nn(spark, d).shortest_path(limit=3).select("src", "dst", "dist")


@query(f"WITH RECURSIVE {APSP} SELECT dst AS id, round(max(d), 6) AS eccentricity FROM far GROUP BY 1")
def eccentricity(spark, d):
    return trade(spark, d).eccentricity().select("id", rounded("eccentricity").alias("eccentricity"))


@query(f"WITH RECURSIVE {APSP}, x AS (SELECT max(d) AS m FROM far GROUP BY dst) SELECT round(max(m), 6) AS diameter, round(min(m), 6) AS radius FROM x")
def diameter_and_radius(spark, d):
    g = trade(spark, d)
    return g.diameter().crossJoin(g.radius()).select(rounded("diameter").alias("diameter"), rounded("radius").alias("radius"))


# Shortest paths by numbers of edges in the small components of nearest neighbours.
PATHS = f"""{NN1}, h(s, t, n, c) AS (SELECT id, id, 0, 1::DOUBLE FROM v UNION ALL
(SELECT s, dst, n + 1, sum(c) FROM (SELECT h.s, e.dst, h.n, h.c FROM h JOIN e ON e.src = h.t WHERE h.n < 16) GROUP BY s, dst, n)),
f AS (SELECT s, t, min(n) AS n, arg_min(c, n) AS c FROM h GROUP BY s, t)"""


@query(f"""WITH RECURSIVE {PATHS}, b AS (SELECT a.t AS id, sum(a.c * z.c / w.c) AS b FROM f a JOIN f z ON z.s = a.t JOIN f w ON w.s = a.s AND w.t = z.t
WHERE a.n + z.n = w.n AND a.s <> a.t AND z.s <> z.t GROUP BY 1) SELECT v.id, round(coalesce(b, 0), 6) + 0.0 AS betweenness FROM v LEFT JOIN b ON b.id = v.id""")
def betweenness(spark, d):
    return pairs_1nn(spark, d).betweenness().select("id", rounded("betweenness").alias("betweenness"))


@query(f"""WITH RECURSIVE {PATHS} SELECT e.src, e.dst, round(sum(a.c * z.c / w.c), 6) AS betweenness FROM e JOIN f a ON a.t = e.src JOIN f z ON z.s = e.dst JOIN f w ON w.s = a.s AND w.t = z.t
WHERE a.n + 1 + z.n = w.n GROUP BY 1, 2""")
def edge_betweenness(spark, d):
    return pairs_1nn(spark, d).betweenness("edge").select("src", "dst", rounded("betweenness").alias("betweenness"))


@query(f"""WITH RECURSIVE {APSP}, s AS (SELECT f.src AS s, f.dst AS t FROM far f), q(s, t, c) AS (SELECT id, id, 1::DOUBLE FROM v)
, b AS (SELECT a.dst AS id, count(*)::DOUBLE AS b FROM far a JOIN far z ON z.src = a.dst JOIN far w ON w.src = a.src AND w.dst = z.dst
WHERE abs(a.d + z.d - w.d) < 1e-12 AND a.src <> a.dst AND z.src <> z.dst AND a.src <> z.dst GROUP BY 1) SELECT v.id, coalesce(b, 0) AS betweenness FROM v LEFT JOIN b ON b.id = v.id""")
def weighted_betweenness(spark, d):
    return trade(spark, d).betweenness().select("id", rounded("betweenness").alias("betweenness"))


# -- transformation ------------------------------------------------------------------------------------------------------------


# Each vertex's equations as rows with their right side, freed of one unknown after the other.
@query(f"""WITH RECURSIVE {RANK}, z AS (SELECT s, t, list_transform(list_zip(b.x, a.x), lambda q: q[1] - q[2]) AS z FROM r JOIN p a ON a.id = s JOIN p b ON b.id = t WHERE k <= 5 AND d <> 0),
tr AS (SELECT s, sum(list_dot_product(z, z)) AS tr FROM z GROUP BY s),
row AS (SELECT a.s, a.t, list(list_dot_product(a.z, b.z) + CASE WHEN a.t = b.t THEN CASE WHEN tr > 0 THEN 1e-3 * tr ELSE 1e-3 END ELSE 0 END ORDER BY b.t) AS row FROM z a JOIN z b ON a.s = b.s JOIN tr ON tr.s = a.s GROUP BY a.s, a.t),
q(k, s, ts, rows) AS (SELECT 0, s, list(t ORDER BY t), list(list_append(row, 1::DOUBLE) ORDER BY t) FROM row GROUP BY s
UNION ALL SELECT k + 1, s, ts, list_transform(range(1, len(ts) + 1), lambda i: CASE WHEN i = k + 1 THEN list_transform(rows[i], lambda v: v / rows[k + 1][k + 1])
ELSE list_transform(range(1, len(ts) + 2), lambda c: rows[i][c] - rows[i][k + 1] * rows[k + 1][c] / rows[k + 1][k + 1]) END) FROM q WHERE k < len(ts)),
w AS (SELECT s, unnest(ts) AS t, unnest(list_transform(rows, lambda x: x[len(x)])) AS w FROM q WHERE k = len(ts))
SELECT s AS src, t AS dst, round(w / sum(w) OVER (PARTITION BY s), 6) + 0.0 AS weight FROM w""")
def barycenter_edge_weights(spark, d):
    return knn(spark, d).barycenter_edge_weights(points(spark, d)).edges.select("src", "dst", rounded("weight").alias("weight"))


@query(f"""WITH RECURSIVE {NN1}, c(v, l) USING KEY (v) AS (SELECT id, id FROM v UNION
(SELECT e.dst, min(c.l) FROM c JOIN e ON e.src = c.v JOIN recurring.c r ON r.v = e.dst WHERE c.l < r.l GROUP BY e.dst)),
m AS (SELECT v, dense_rank() OVER (ORDER BY l) - 1 AS c, row_number() OVER (PARTITION BY l ORDER BY v) - 1 AS i FROM c)
SELECT a.c::BIGINT AS component, a.i::BIGINT AS src, b.i::BIGINT AS dst FROM e JOIN m a ON a.v = e.src JOIN m b ON b.v = e.dst""")
def connected_subgraphs(spark, d):
    return transform.component_edges(pairs_1nn(spark, d)).select("component", "src", "dst")


@query(f"WITH RECURSIVE {APSP}, o AS (SELECT dst, d FROM far WHERE src = 0) SELECT e.src, e.dst, round(e.weight, 6) AS weight FROM e JOIN o a ON a.dst = e.src JOIN o b ON b.dst = e.dst WHERE abs(a.d + e.weight - b.d) < 1e-12")
def shortest_path_subtree(spark, d):
    return trade(spark, d).shortest_path_subtree(0).edges.select("src", "dst", rounded("weight").alias("weight"))


# An edge is in the tree unless its ends are tied by lighter ones: widest ways, by rounds of the matrix product of (min, max).
TREE = f"""{TRADE}, u AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, min(weight) AS w FROM e GROUP BY 1, 2), y AS (SELECT a, b, w FROM u UNION ALL SELECT b, a, w FROM u),
ww(n, a, b, w) AS (SELECT 0, a, b, w FROM y UNION ALL (SELECT n + 1, a, c, min(x) FROM (SELECT p.n, p.a, q.b AS c, greatest(p.w, q.w) AS x FROM ww p JOIN ww q ON p.b = q.a WHERE p.n < 5) GROUP BY n, a, c)),
wide AS (SELECT a, b, min(w) AS w FROM ww GROUP BY a, b), tree AS (SELECT y.a AS src, y.b AS dst, y.w AS weight FROM y JOIN wide ON wide.a = y.a AND wide.b = y.b AND y.w <= wide.w)"""


@query(f"WITH RECURSIVE {TREE} SELECT src, dst, round(weight, 6) AS weight FROM tree")
def minimum_spanning_subtree(spark, d):
    return trade(spark, d).minimum_spanning_subtree().edges.select("src", "dst", rounded("weight").alias("weight"))


@query(f"WITH RECURSIVE {APSP}, k AS (SELECT dst AS id, row_number() OVER (ORDER BY dst) - 1 AS i FROM far WHERE src = 3 AND d <= 0.2) SELECT a.i::BIGINT AS src, b.i::BIGINT AS dst, round(weight, 6) AS weight FROM e JOIN k a ON a.id = src JOIN k b ON b.id = dst")
def neighborhood_subgraph(spark, d):
    return trade(spark, d).neighborhood_subgraph(3, radius=0.2).edges.select("src", "dst", rounded("weight").alias("weight"))


@query(f"""WITH RECURSIVE {TREE}, f AS (SELECT max(weight) AS f FROM tree), gone AS (SELECT src, dst FROM e, f WHERE weight >= f AND NOT EXISTS (SELECT 1 FROM tree t WHERE t.src = e.src AND t.dst = e.dst)
AND NOT EXISTS (SELECT 1 FROM e x JOIN e y ON x.dst = y.src WHERE x.src = e.src AND y.dst = e.dst AND x.weight < e.weight AND y.weight < e.weight))
SELECT src, dst FROM e WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.src = e.src AND g.dst = e.dst)""")
def isograph(spark, d):
    return trade(spark, d).isograph().pairs()


@query()
def circle_tear(spark, d):
    return knn(spark, d, 3).symmetrize("max").circle_tear(cycle_len_thresh=8).pairs()


@query()
def cycle_cut(spark, d):
    return knn(spark, d, 2).symmetrize("max").cycle_cut().pairs()


# -- embedding -----------------------------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {APSP}, q AS (SELECT src, dst, -0.5 * d * d AS v FROM far)
SELECT src AS i, dst AS j, round(v - avg(v) OVER (PARTITION BY src) - avg(v) OVER (PARTITION BY dst) + avg(v) OVER (), 6) + 0.0 AS value FROM q""")
def isomap_centred(spark, d):
    return embed.centred_distances(trade(spark, d)).select("i", "j", rounded("value").alias("value"))


def _coords(df: DataFrame) -> DataFrame:
    """Coordinates without a sign."""
    return df.select("id", F.transform("coords", lambda v: F.round(F.abs(v), 4)).alias("coords"))


def _xy(df: DataFrame) -> DataFrame:
    """Two coordinates without their signs."""
    return df.select("id", *[(F.round(F.abs(F.col("coords")[i]), 4) + F.lit(0.0)).alias(c) for i, c in enumerate(("x", "y"))])


def _leading(name: str, *others: str, rounds: int = 20_000) -> str:
    """The leading unit vector of the matrix ``ms`` (a list of rows by place) among those orthogonal to others, by repeated products."""
    out = f"""{name}_q(k, f) AS (SELECT 0, list(sin(i * 1.7 + {len(others)})::DOUBLE ORDER BY i) FROM o UNION ALL
  SELECT k + 1, list_transform(x, lambda z: z / sqrt(list_dot_product(x, x))) FROM (SELECT k, $X AS x FROM {name}_q, ms{"".join(", " + o for o in others)} WHERE k < {rounds})),
{name} AS MATERIALIZED (SELECT f AS {name} FROM {name}_q WHERE k = {rounds})"""
    x = "list_transform(ms, lambda l: list_dot_product(l, f))"
    if others:  # of what the product gives, the parts along the others go
        parts = " - ".join(["y[i]", *(f"{o}[i] * list_dot_product(y, {o})" for o in others)])
        return out.replace("$X AS x FROM", f"list_transform(range(1, len(y) + 1), lambda i: {parts}) AS x FROM (SELECT *, {x} AS y FROM").replace(f"WHERE k < {rounds})", f"WHERE k < {rounds}))")
    return out.replace("$X", x)


PLACES = "o AS (SELECT id, row_number() OVER (ORDER BY id) AS i FROM v)"
MEAN = "y AS (SELECT src, dst, sum(weight) / 2 AS w FROM (SELECT * FROM e UNION ALL SELECT dst, src, weight FROM e) GROUP BY 1, 2)"


@query(f"""WITH RECURSIVE {TRADE}, {MEAN}, {PLACES},
ap(n, src, dst, d) AS (SELECT 0, a.id, b.id, CASE WHEN a.id = b.id THEN 0 ELSE coalesce(w, 'inf'::DOUBLE) END FROM v a JOIN v b ON true LEFT JOIN y ON y.src = a.id AND y.dst = b.id
UNION ALL (SELECT n + 1, a, c, min(x) FROM (SELECT p.n, p.src AS a, q.dst AS c, p.d + q.d AS x FROM ap p JOIN ap q ON p.dst = q.src WHERE p.n < 5) GROUP BY n, a, c)),
c AS (SELECT src, dst, -0.5 * d * d AS h FROM ap WHERE n = 5), m AS (SELECT src, dst, h - avg(h) OVER (PARTITION BY src) - avg(h) OVER (PARTITION BY dst) + avg(h) OVER () AS h FROM c),
ms AS MATERIALIZED (SELECT list(l ORDER BY src) AS ms FROM (SELECT src, list(h ORDER BY dst) AS l FROM m GROUP BY src)), {_leading("one")}, {_leading("two", "one")}
SELECT id, round(abs(one[i]) * sqrt(list_dot_product(one, list_transform(ms, lambda l: list_dot_product(l, one)))), 4) + 0.0 AS x,
       round(abs(two[i]) * sqrt(list_dot_product(two, list_transform(ms, lambda l: list_dot_product(l, two)))), 4) + 0.0 AS y FROM o, one, two, ms""")
def isomap(spark, d):
    return _xy(trade(spark, d).symmetrize("avg").isomap(num_dims=2))


# The smallest of the Laplacian are the largest of 2 - L, beyond the one that is known.
@query(f"""WITH RECURSIVE {TRADE}, {MEAN}, {PLACES}, g AS (SELECT dst AS id, sum(w) AS g FROM y GROUP BY 1),
ms AS MATERIALIZED (SELECT list(l ORDER BY id) AS ms FROM (SELECT a.id, list(CASE WHEN a.id = b.id THEN 1 ELSE coalesce(w / sqrt(ga.g) / sqrt(gb.g), 0) END ORDER BY b.id) AS l
  FROM v a JOIN v b ON true JOIN g ga ON ga.id = a.id JOIN g gb ON gb.id = b.id LEFT JOIN y ON y.src = a.id AND y.dst = b.id GROUP BY a.id)),
known AS MATERIALIZED (SELECT list(sqrt(g / (SELECT sum(g) FROM g)) ORDER BY id) AS known FROM g), {_leading("one", "known")}, {_leading("two", "known", "one")}
SELECT id, round(abs(one[i]), 4) + 0.0 AS x, round(abs(two[i]), 4) + 0.0 AS y FROM o, one, two""")
def laplacian_eigenmaps(spark, d):
    return _xy(trade(spark, d).symmetrize("avg").laplacian_eigenmaps(num_dims=2))


def _projection(spark, m) -> DataFrame:
    return _coords(from_numpy(spark, m))


@query()
def locality_preserving_projections(spark, d):
    return _projection(spark, knn(spark, d).symmetrize("avg").locality_preserving_projections(points(spark, d), num_dims=2))


@query(f"""WITH {RANK}, w AS (SELECT s AS i, t AS j, d AS w FROM r WHERE k <= 5), c AS (SELECT a.j AS i, b.j AS j, a.w * b.w AS x FROM w a JOIN w b ON a.i = b.i UNION ALL SELECT i, j, -w FROM w UNION ALL SELECT j, i, -w FROM w UNION ALL SELECT id, id, 1 FROM p)
SELECT i, j, round(sum(x), 6) + 0.0 AS value FROM c GROUP BY i, j""")
def lle_matrix(spark, d):
    return embed.lle_matrix(knn(spark, d)).select("i", "j", rounded("value").alias("value"))


@query()
def locally_linear_embedding(spark, d):
    return _coords(knn(spark, d, 8).barycenter_edge_weights(points(spark, d)).locally_linear_embedding(num_dims=2))


@query()
def neighborhood_preserving_embedding(spark, d):
    return _projection(spark, knn(spark, d, 8).neighborhood_preserving_embedding(points(spark, d), num_dims=2))


@query()
def laplacian_pca(spark, d):
    return _coords(knn(spark, d).symmetrize("avg").laplacian_pca(points(spark, d), num_dims=2))


@query("WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT vec_id AS id, round(cos(2 * pi() * vec_id / n), 6) + 0.0 AS x, round(sin(2 * pi() * vec_id / n), 6) + 0.0 AS y FROM embeddings, n")
def layout_circle(spark, d):
    g = Graph(points(spark, d).select("id"), spark.createDataFrame([], "src long, dst long, weight double"))
    return g.layout_circle().select("id", rounded("x").alias("x"), rounded("y").alias("y"))


@query(f"""WITH RECURSIVE {TRADE}, y AS (SELECT src, dst, sum(weight) / 2 AS w FROM (SELECT * FROM e UNION ALL SELECT dst, src, weight FROM e) GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM v),
s(k, id, px, py) AS (SELECT 0, id, cos(id * 2.0)::DOUBLE, sin(id * 3.0)::DOUBLE FROM v UNION ALL (
  SELECT k + 1, id, px + mx * 0.1 * (1 - k / 51.0::DOUBLE) / greatest(sqrt(mx * mx + my * my), 0.01), py + my * 0.1 * (1 - k / 51.0::DOUBLE) / greatest(sqrt(mx * mx + my * my), 0.01)
  FROM (SELECT k, id, any_value(px) AS px, any_value(py) AS py, sum(dx * f) AS mx, sum(dy * f) AS my FROM (
    SELECT k, id, px, py, dx, dy, 1 / n / dist - coalesce(1 / w, 0) * sqrt(n) * dist * dist AS f FROM (
      SELECT a.k, a.id, a.px, a.py, a.px - b.px AS dx, a.py - b.py AS dy, greatest(sqrt((a.px - b.px) ** 2 + (a.py - b.py) ** 2), 1e-8) AS dist, y.w, n.n::DOUBLE AS n
      FROM s a JOIN s b ON a.k = b.k CROSS JOIN n LEFT JOIN y ON y.src = a.id AND y.dst = b.id WHERE a.k < 50)) GROUP BY k, id)))
SELECT id, round(px, 4) + 0.0 AS x, round(py, 4) + 0.0 AS y FROM s WHERE k = 50""")
def layout_spring(spark, d):
    import numpy as np

    g = trade(spark, d).symmetrize("avg")
    ids = np.arange(g.num_vertices())
    own = g.layout_spring(initial_layout=np.column_stack([np.cos(2.0 * ids), np.sin(3.0 * ids)]))
    return own.select("id", *[(F.round(F.col("coords")[i], 4) + F.lit(0.0)).alias(c) for i, c in enumerate(("x", "y"))])


# -- labels --------------------------------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {RANK}, b AS (SELECT s, t FROM r WHERE k <= 5 UNION SELECT t, s FROM r WHERE k <= 5),
o AS (SELECT id, row_number() OVER (ORDER BY id) AS i FROM p), l AS (SELECT x.i, list(y.i) AS near FROM b JOIN o x ON x.id = b.s JOIN o y ON y.id = b.t WHERE y.i < x.i GROUP BY x.i),
c(i, colors) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT c.i + 1, list_append(colors, (SELECT min(q) FROM range(1, len(colors) + 2) g(q)
WHERE NOT list_contains(list_transform(coalesce(l.near, []), lambda j: colors[j]), q))) FROM c JOIN o ON o.i = c.i + 1 LEFT JOIN l ON l.i = o.i)
SELECT id, colors[o.i]::INTEGER AS color FROM o, c WHERE c.i = (SELECT count(*) FROM p)""")
def color_greedy(spark, d):
    return knn(spark, d).symmetrize("max").color_greedy()


# The trade between nations with both ways' mean: neighbours as lists by place. Repeated products with the matrix turn any start to the leading vector.
AVG = f"{TRADE}, y AS (SELECT src, dst, sum(weight) / 2 AS w FROM (SELECT * FROM e UNION ALL SELECT dst, src, weight FROM e) GROUP BY 1, 2)"


@query(f"""WITH RECURSIVE {AVG}, g AS (SELECT dst AS id, sum(w) AS g FROM y GROUP BY 1), o AS (SELECT id, row_number() OVER (ORDER BY id) AS i FROM v),
m AS MATERIALIZED (SELECT a.i, list(CASE WHEN a.id = b.id THEN coalesce(g.g, 0) ELSE -coalesce(y.w, 0) END ORDER BY b.i) AS l FROM o a JOIN o b ON true LEFT JOIN g ON g.id = a.id LEFT JOIN y ON y.src = a.id AND y.dst = b.id GROUP BY a.i),
ms AS MATERIALIZED (SELECT list(l ORDER BY i) AS ms FROM m),
q(k, f) AS (SELECT 0, list(sin(i * 1.7)::DOUBLE ORDER BY i) FROM o UNION ALL SELECT k + 1, list_transform(x, lambda z: z / sqrt(list_sum(list_transform(x, lambda r: r * r)))) FROM (SELECT k, list_transform(ms, lambda l: list_dot_product(l, f)) AS x FROM q, ms WHERE k < 3000))
SELECT id, (f[i] > 0) = (f[1] > 0) AS color FROM q, o WHERE k = 3000""")
def bicolor_spectral(spark, d):
    return trade(spark, d).symmetrize("avg").bicolor_spectral()


@query()
def cluster_spectral(spark, d):
    return knn(spark, d).symmetrize("avg").cluster_spectral(3)


@query(f"""WITH RECURSIVE {RANK}, e AS (SELECT s AS src, t AS dst, d AS w FROM r WHERE k <= 5), k AS (SELECT vec_id AS id, label FROM embeddings WHERE vec_id % 3 = 0),
c(v, d, s) USING KEY (v) AS (SELECT id, 0::DOUBLE, id FROM k UNION (SELECT v, min(d), arg_min(s, (d, s)) FROM (
SELECT e.src AS v, c.d + e.w AS d, c.s FROM c JOIN e ON e.dst = c.v LEFT JOIN recurring.c r ON r.v = e.src WHERE r.v IS NULL OR (c.d + e.w, c.s) < (r.d, r.s)) GROUP BY v))
SELECT p.id, coalesce(k.label, (SELECT CASE WHEN 0 % 3 = 0 THEN label END FROM embeddings WHERE vec_id = 0))::INTEGER AS label FROM p LEFT JOIN c ON c.v = p.id LEFT JOIN k ON k.id = c.s""")
def classify_nearest(spark, d):
    return knn(spark, d).classify_nearest(partial(spark, d))


LGC = f"""{RANK}, e AS (SELECT s, t, d AS w FROM r WHERE k <= 5), b AS (SELECT s, t, sum(w) / 2 AS w FROM (SELECT * FROM e UNION ALL SELECT t, s, w FROM e) GROUP BY s, t), x AS (SELECT s AS i, t AS j, exp(-w / (SELECT stddev_pop(w) FROM b)) AS w FROM b),
g AS (SELECT j AS id, sqrt(sum(w)) AS q FROM x GROUP BY 1), m AS (SELECT i, j, w / a.q / z.q AS w FROM x JOIN g a ON a.id = i JOIN g z ON z.id = j), k AS (SELECT vec_id AS id, label FROM embeddings WHERE vec_id % 3 = 0),
f(n, id, label, v) AS (SELECT 0, id, label, 1::DOUBLE FROM k UNION ALL (SELECT n + 1, id, label, sum(v) FROM (
SELECT f.n, m.i AS id, f.label, m.w * f.v * CASE WHEN m.i % 3 = 0 THEN 1 ELSE 0.2 END AS v FROM f JOIN m ON m.j = f.id WHERE f.n < 4 UNION ALL SELECT q.n, k.id, k.label, 0.8 FROM k, (SELECT DISTINCT n FROM f WHERE n < 4) q) GROUP BY n, id, label))"""


@query(f"WITH RECURSIVE {LGC} SELECT id, label::INTEGER AS label, round(v, 6) AS value FROM f WHERE n = 4 AND v > 0")
def label_spreading(spark, d):
    import warnings as w

    with w.catch_warnings():
        w.simplefilter("ignore")
        out = label.classify_lgc(knn(spark, d).symmetrize("avg"), partial(spark, d), tol=-1, max_iter=4, distributions=True)
    return out.where("value > 0").select("id", "label", rounded("value").alias("value"))


# As many rounds as it takes until all changes sum to 0.001, 30 at most.
@query(f"""WITH RECURSIVE {LGC.replace("f.n < 4", "f.n < 30").replace("n < 4", "n < 30")}, gap AS (SELECT a.n, sum(abs(a.v - coalesce(b.v, 0))) AS g FROM f a LEFT JOIN f b ON b.n = a.n - 1 AND b.id = a.id AND b.label = a.label WHERE a.n > 0 GROUP BY a.n),
last AS (SELECT coalesce(min(n) FILTER (WHERE g <= 0.001), 30) AS n FROM gap)
SELECT p.id, coalesce((SELECT arg_min(label, (-v, label)) FROM f, last WHERE f.n = last.n AND f.id = p.id AND v > 0), (SELECT min(label) FROM k))::INTEGER AS label FROM p""")
def classify_lgc(spark, d):
    return knn(spark, d).symmetrize("avg").classify_lgc(partial(spark, d))


WAYS = f"{RANK}, e AS (SELECT s, t, d AS w FROM r WHERE k <= 5), b AS (SELECT s AS i, t AS j, sum(w) / 2 AS w FROM (SELECT * FROM e UNION ALL SELECT t, s, w FROM e) GROUP BY s, t)"


# Unknown vertices take the mean of their neighbours, round by round.
@query(f"""WITH RECURSIVE {WAYS}, m AS MATERIALIZED (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM b), k AS (SELECT vec_id AS id, label FROM embeddings WHERE vec_id % 3 = 0),
f(n, id, label, v) AS (SELECT 0, id, label, 1::DOUBLE FROM k UNION ALL (SELECT n + 1, id, label, sum(v) FROM (
SELECT f.n, m.i AS id, f.label, m.w * f.v AS v FROM f JOIN m ON m.j = f.id WHERE f.n < 150 AND m.i % 3 <> 0 UNION ALL SELECT q.n, k.id, k.label, 1 FROM k, (SELECT DISTINCT n FROM f WHERE n < 150) q) GROUP BY n, id, label)),
x AS (SELECT id, label, v FROM f WHERE n = 150 AND id % 3 <> 0), mass AS (SELECT label, (1 + (SELECT count(*) FROM k WHERE k.label = x.label)) / sum(v) AS c FROM x GROUP BY label)
SELECT id, label::INTEGER AS label FROM k UNION ALL SELECT id, arg_max(label, (v * c, -label))::INTEGER FROM x JOIN mass USING (label) GROUP BY id""")
def classify_harmonic(spark, d):
    return knn(spark, d).symmetrize("avg").classify_harmonic(partial(spark, d))


@query(f"""WITH RECURSIVE {WAYS}, x AS (SELECT i, j, exp(-w / (SELECT stddev_pop(w) FROM b)) AS w FROM b), g AS (SELECT j AS id, sqrt(sum(w)) AS q FROM x GROUP BY 1),
m AS MATERIALIZED (SELECT i, j, w / a.q / z.q AS w FROM x JOIN g a ON a.id = i JOIN g z ON z.id = j), y AS (SELECT id, x[1] AS y FROM p WHERE id % 2 = 0), mean AS (SELECT avg(y) AS m FROM y),
f(n, id, v) AS (SELECT 0, id, y - m FROM y, mean UNION ALL (SELECT n + 1, id, sum(v) FROM (SELECT f.n, m.i AS id, m.w * f.v AS v FROM f JOIN m ON m.j = f.id WHERE f.n < 150 AND m.i % 2 = 1
UNION ALL SELECT q.n, y.id, y.y - mean.m FROM y, mean, (SELECT DISTINCT n FROM f WHERE n < 150) q) GROUP BY n, id))
SELECT p.id, round(coalesce(v, 0) + m, 6) + 0.0 AS y FROM p CROSS JOIN mean LEFT JOIN f ON f.id = p.id AND f.n = 150""")
def regression(spark, d):
    known = points(spark, d).where("id % 2 = 0").select("id", F.col("x")[0].alias("y"))
    return knn(spark, d).symmetrize("avg").regression(known).select("id", rounded("y").alias("y"))


# -- orders and sinks ----------------------------------------------------------------------------------------------------------


# The queue is the order itself: each step looks at its next vertex and puts the unseen neighbours at its end, or begins a new part.
@query(f"""WITH RECURSIVE {RANK}, b AS (SELECT s, t FROM r WHERE k <= 5 UNION SELECT t, s FROM r WHERE k <= 5), g AS (SELECT s, count(*) AS g FROM b GROUP BY s),
near AS MATERIALIZED (SELECT b.s, list(b.t ORDER BY g.g, b.t) AS near FROM b JOIN g ON g.s = b.t GROUP BY b.s), starts AS MATERIALIZED (SELECT list(id ORDER BY coalesce(g, 0), id) AS starts FROM p LEFT JOIN g ON g.s = p.id),
q(k, o) AS (SELECT 0, []::BIGINT[] UNION ALL SELECT k + 1, CASE WHEN k = len(o) THEN list_append(o, list_filter(starts, lambda z: NOT list_contains(o, z))[1]) ELSE o END
|| list_filter(coalesce((SELECT near FROM near WHERE s = CASE WHEN k = len(o) THEN list_filter(starts, lambda z: NOT list_contains(o, z))[1] ELSE o[k + 1] END), []), lambda z: NOT list_contains(o, z) AND z <> CASE WHEN k = len(o) THEN list_filter(starts, lambda y: NOT list_contains(o, y))[1] ELSE -1 END)
FROM q, starts WHERE k < len(starts)), last AS (SELECT list_reverse(o) AS o FROM q, starts WHERE k = len(starts)), place AS (SELECT unnest(o) AS id, generate_subscripts(o, 1) - 1 AS i FROM last)
SELECT x.i::BIGINT AS src, y.i::BIGINT AS dst FROM b JOIN place x ON x.id = b.s JOIN place y ON y.id = b.t""")
def cuthill_mckee(spark, d):
    return knn(spark, d).symmetrize("max").cuthill_mckee().pairs()


@query(f"""WITH RECURSIVE {TRADE}, {MEAN}, {PLACES}, g AS (SELECT dst AS id, sum(w) AS g FROM y GROUP BY 1), top AS (SELECT 2 * max(g) AS top FROM g),
ms AS MATERIALIZED (SELECT list(l ORDER BY id) AS ms FROM (SELECT a.id, list(CASE WHEN a.id = b.id THEN top - g ELSE coalesce(w, 0) END ORDER BY b.id) AS l
  FROM v a JOIN v b ON true JOIN g ON g.id = a.id CROSS JOIN top LEFT JOIN y ON y.src = a.id AND y.dst = b.id GROUP BY a.id)),
known AS MATERIALIZED (SELECT list(1 / sqrt((SELECT count(*) FROM v)) ORDER BY id) AS known FROM v), {_leading("one", "known")},
big AS (SELECT one[list_position(list_transform(one, lambda z: round(abs(z), 10)), list_max(list_transform(one, lambda z: round(abs(z), 10))))] AS big FROM one),
place AS (SELECT id, row_number() OVER (ORDER BY one[i] * sign(big), id) - 1 AS p FROM o, one, big)
SELECT a.p::BIGINT AS src, b.p::BIGINT AS dst FROM y JOIN place a ON a.id = src JOIN place b ON b.id = dst""")
def laplacian_reordering(spark, d):
    return trade(spark, d).symmetrize("avg").laplacian_reordering().pairs()


@query()
def node_centroid_hill_climbing(spark, d):
    return weft.neighbor_graph(_t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.array(F.sin(F.col("n_nationkey") * 7.0), F.cos(F.col("n_nationkey") * 7.0)).alias("x")), k=2).node_centroid_hill_climbing(num_centerings=3).pairs()


@query(f"WITH {RANK} SELECT s AS src, t AS dst, round(a.x[1], 6) + 0.0 AS x1, round(a.x[2], 6) + 0.0 AS y1, round(b.x[1], 6) + 0.0 AS x2, round(b.x[2], 6) + 0.0 AS y2, round(d, 6) AS weight FROM r JOIN p a ON a.id = s JOIN p b ON b.id = t WHERE k <= 5")
def plot_segments(spark, d):
    own = knn(spark, d).segments(plane(spark, d).withColumnRenamed("x", "coords"), directed=True)
    return own.select("src", "dst", *[rounded(c).alias(c) for c in ("x1", "y1", "x2", "y2", "weight")])

