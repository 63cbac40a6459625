"""The graph and its changes, on small networks with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import weft
from weft.graph import Graph, numbered

PAIRS = [(0, 1), (0, 2), (1, 1), (2, 1), (3, 3)]
ADJ = np.array([[0, 1, 1, 0], [0, 1, 0, 0], [0, 1, 0, 0], [0, 0, 0, 1]], float)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def pairs(spark, own):
    return spark.createDataFrame(own, "src long, dst long")


@pytest.fixture(scope="module")
def both(spark):
    """The same graph unweighted and weighted by column."""
    weights = [(i, j, float(j)) if j else (i, j, 1.0) for i, j in PAIRS]
    return Graph.from_edge_pairs(pairs(spark, PAIRS)), Graph.from_edge_pairs(spark.createDataFrame(weights, "src long, dst long, weight double"), weights="weight", num_vertices=4)


def test_counts_and_degrees(both):
    plain, weighted = both
    for g in both:
        assert (g.num_edges(), g.num_vertices(), g.is_directed()) == (5, 4, True)
        assert [r.degree for r in g.degree("in", weighted=False).orderBy("id").collect()] == [0, 3, 1, 1]
        assert [r.neighbors for r in g.adj_list().orderBy("id").collect()] == [[1, 2], [1], [1], [3]]
    assert [r.degree for r in weighted.degree("in").orderBy("id").collect()] == [0, 3, 2, 3]
    assert [r.degree for r in weighted.degree("out").orderBy("id").collect()] == [3, 1, 1, 3]
    assert (plain.is_weighted(), weighted.is_weighted()) == (False, True)
    with pytest.raises(ValueError):
        plain.degree("up")


def test_undirected_pairs_differ_by_kind(both):
    plain, weighted = both
    assert rows(plain.pairs(directed=False)) == [(0, 1), (0, 2), (1, 1), (1, 2), (3, 3)]
    assert rows(weighted.pairs(directed=False)) == [(0, 1), (0, 2), (1, 1), (3, 3)]
    assert plain.symmetrize().num_edges() == 8 and plain.symmetrize().copy().symmetric


def test_makers(spark):
    rows3 = spark.createDataFrame([(0, 1, 1.0), (1, 0, 5.0), (2, 2, 0.0), (0, 1, 2.0)], "src long, dst long, o double")
    half = Graph.from_edge_pairs(rows3, symmetric=True)
    assert rows(half.pairs()) == [(0, 1), (1, 0), (2, 2)] and half.num_vertices() == 3
    last = Graph.from_edge_pairs(rows3, symmetric=True, weights="o", order="o")
    assert rows(last.edges) == [(0, 1, 5.0), (1, 0, 5.0)]
    assert Graph.from_edge_pairs(pairs(spark, []), num_vertices=5).num_vertices() == 5
    assert Graph.from_edge_pairs(pairs(spark, [])).num_vertices() == 0
    assert (Graph.from_numpy(spark, ADJ).to_numpy() == ADJ).all()
    dense = Graph.from_numpy(spark, ADJ).dense_rows()
    assert (Graph.from_adj_rows(dense).to_numpy() == ADJ).all()
    coo = spark.createDataFrame([(0, 1, 2.0), (0, 1, 3.0), (1, 1, 0.0)], "i long, j long, value double")
    assert rows(Graph.from_coo(coo, 2).edges) == [(0, 1, 5.0)]
    cut = Graph.from_edge_pairs(spark.createDataFrame([(0.9, 1.2)], "src double, dst double"))
    assert rows(cut.pairs()) == [(0, 1)]


def test_adding_and_removing(spark, both):
    plain, weighted = both
    new = pairs(spark, [(0, 1), (2, 3)])
    assert rows(weighted.add_edges(new, weight=7).edges) == [(0, 1, 7.0), (0, 2, 2.0), (1, 1, 1.0), (2, 1, 1.0), (2, 3, 7.0), (3, 3, 3.0)]
    assert weighted.add_edges(new, weight=0).num_edges() == 4
    assert weighted.add_edges(new, symmetric=True).num_edges() == 8
    with pytest.warns(UserWarning):
        assert plain.add_edges(new, weight=7).num_edges() == 6
    assert rows(weighted.remove_edges(pairs(spark, [(1, 0), (9, 9)]), symmetric=True).pairs()) == [(0, 2), (1, 1), (2, 1), (3, 3)]
    half = plain.symmetrize()
    assert half.remove_edges(pairs(spark, [(1, 0)])).num_edges() == 6
    assert weighted.add_self_edges(4).to_numpy().diagonal().tolist() == [4, 4, 4, 4]


def test_symmetrize(both):
    m = both[1].to_numpy()
    got = {how: both[1].symmetrize(how).to_numpy() for how in ("sum", "max", "avg")}
    assert (got["sum"] == m + m.T).all() and (got["max"] == np.maximum(m, m.T)).all() and (got["avg"] == (m + m.T) / 2).all()
    with pytest.raises(ValueError):
        both[1].symmetrize("mean")


def test_reweighting(spark, both):
    plain, weighted = both
    assert set(weighted.reweight(4).edges.select("weight").distinct().collect()[0]) == {4.0}
    assert rows(weighted.reweight(9, [1, 4]).edges) == [(0, 1, 1.0), (0, 2, 9.0), (1, 1, 1.0), (2, 1, 1.0), (3, 3, 9.0)]
    with pytest.warns(UserWarning):
        plain.reweight(3)
    points = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(4)], "id long, x array<double>")
    want = [(0, 1, 1.0), (0, 2, 2.0), (2, 1, 1.0)]
    assert rows(plain.reweight_by_distance(points).edges) == want
    assert rows(plain.reweight_by_distance(points, lambda a, b: np.abs(a[:, :1] - b[:, 0])).edges) == want
    given = spark.createDataFrame([(i, j, float(10 * i + j)) for i in range(4) for j in range(4)], "i long, j long, d double")
    assert rows(plain.reweight_by_distance(given, "precomputed").edges)[:2] == [(0, 1, 1.0), (0, 2, 2.0)]


def test_kernelize(both):
    w = both[1].edges.select("weight").toPandas()["weight"].to_numpy()
    got = both[1].kernelize("rbf").edges.orderBy("src", "dst").toPandas()["weight"].to_numpy()
    own = both[1].edges.orderBy("src", "dst").toPandas()["weight"].to_numpy()
    assert np.allclose(got, np.exp(-own / w.std()))
    assert both[1].kernelize("none") is both[1]
    assert rows(both[1].kernelize("binary").edges.select("weight").distinct()) == [(1.0,)]
    for bad in ("cosine", "rbf"):
        with pytest.raises(ValueError):
            both[0].kernelize(bad)


def test_subgraph_and_permutation(spark, both):
    sub = both[1].subgraph(both[1].vertices.where("id <> 1"))
    assert (sub.to_numpy() == both[1].to_numpy()[np.ix_([0, 2, 3], [0, 2, 3])]).all()
    order = [2, 0, 3, 1]
    assert (weft.Graph.permute_graph(both[1], order).to_numpy() == both[1].to_numpy()[np.ix_(order, order)]).all()


def test_numbered(spark):
    ids = spark.range(0, 300_000, 1001).withColumn("id", F.col("id") * 7)
    got = rows(numbered(ids))
    assert sorted(n for _, n in got) == list(range(300)) and [n for _, n in sorted(got)] == list(range(300))


def test_generators(spark):
    assert rows(weft.chain_graph(spark, 3, directed=True).pairs()) == [(0, 1), (1, 2)]
    assert weft.chain_graph(spark, 3, wraparound=True).num_edges() == 6
    assert rows(weft.chain_graph(spark, 3, directed=True, weights=spark.createDataFrame([(0, 2.0), (1, 5.0)], "position long, weight double")).edges) == [(0, 1, 2.0), (1, 2, 5.0)]
    assert weft.lattice_graph(spark, (3,)).num_edges() == 4 and weft.lattice_graph(spark, (1, 4)).num_edges() == 6
    grid = {tuple(p) for p in weft.lattice_graph(spark, (3, 2)).pairs().collect()}
    assert grid == {(a, b) for x, y in [(0, 1), (1, 2), (3, 4), (4, 5), (0, 3), (1, 4), (2, 5)] for a, b in [(x, y), (y, x)]}
    assert weft.lattice_graph(spark, (3, 2), wraparound=True).num_edges() == len(grid) + 4
    with pytest.raises(ValueError):
        weft.lattice_graph(spark, (1,))
    with pytest.raises(NotImplementedError):
        weft.lattice_graph(spark, (2, 2, 2))
    for degrees in ([1] * 5, [1, 2, 2], [1, 0, 0, 1], [9] * 10, [3, 0, 7, 2] * 5):
        g = weft.random_graph(degrees, spark)
        edges = rows(g.pairs())
        assert [r.degree for r in g.degree().orderBy("id").collect()] == degrees and len(set(edges)) == len(edges) and all(a != b for a, b in edges)
        assert all(0 <= b < len(degrees) for _, b in edges)
    with pytest.raises(ValueError):
        weft.random_graph([1, 2, 3], spark)
    assert rows(weft.concat_trajectories(spark, [2, 3], directed=True).pairs()) == [(0, 1), (2, 3), (3, 4)]
    assert rows(weft.chunk_up(spark, [4, 4], chunk_size=2, directed=True).pairs()) == [(0, 1), (2, 3), (4, 5), (6, 7)]
    assert rows(weft.chunk_up(spark, [3, 2], chunk_size=3, directed=True).pairs()) == [(0, 1), (1, 2), (3, 4)]
    assert rows(weft.chunk_up(spark, [5], chunk_size=2, directed=True).pairs()) == [(0, 1), (2, 3), (3, 4)]


def test_datasets(spark):
    roll = weft.swiss_roll(spark, 6, 50, seed=1)
    assert rows(roll) == rows(weft.swiss_roll(spark, 6, 50, seed=1)) and len(roll.first().x) == 3
    assert all(-1 <= r.x[1] <= 1 for r in roll.collect())
    truth = spark.createDataFrame([(i, [(i / 3) ** 2]) for i in range(4)], "id long, x array<double>")
    path = weft.chain_graph(spark, 4)
    for bound, want in ((0.1, 6), (0.2, 4), (0.5, 2), (1, 0)):
        r = weft.error_ratio(path, truth, max_delta_theta=bound).first()
        assert (r.errors, r.edges, r.ratio) == (want, 6, pytest.approx(want / 6))
    for shape, dims in ((weft.MobiusStrip(), 3), (weft.FigureEight(), 2), (weft.FigureEight(dimension=3), 3), (weft.SCurve(), 3)):
        assert {len(r.x) for r in shape.point_cloud(spark, 20).collect()} == {dims}
        assert shape.trajectories(spark, 3, 4).count() == 12
    traces = weft.mountain_car_traces(spark, 5)
    assert rows(traces) == rows(weft.mountain_car_traces(spark, 5)) and traces.groupBy("traj_id").count().agg(F.max("count")).first()[0] <= 40
    assert weft.mountain_car_trajectories(traces).count() == traces.count()


def test_files(spark, tmp_path, both):
    weft.write_edges(both[1], f"{tmp_path}/e")
    assert rows(weft.read_edges(spark, f"{tmp_path}/e", weight="weight").edges) == rows(both[1].edges)
    spark.createDataFrame([(1, [1, 2])], "k int, v array<int>").write.parquet(f"{tmp_path}/p")
    assert rows(weft.read_points(spark, f"{tmp_path}/p", id_col="k", x_col="v")) == [(1, [1.0, 2.0])]


def test_page_and_segments(spark, both, tmp_path):
    coords = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "id long, coords array<double>")
    assert rows(both[1].segments(coords, directed=True))[0] == (0, 1, 0.0, 1.0, 1.0, 1.0, 1.0)
    line = coords.withColumn("coords", F.slice("coords", 1, 1))
    assert both[1].segments(line).columns == ["src", "dst", "x1", "y1", "x2", "y2", "weight"]
    with pytest.raises(ValueError):
        both[1].segments(coords.withColumn("coords", F.array_repeat(F.lit(1.0), 4)))
    both[1].to_html(f"{tmp_path}/g.html", vertex_ids=["<a>", "b", "c", "d"], vertex_labels=[1, 1, 2, 2], weighted=True, title="<t>")
    page = (tmp_path / "g.html").read_text()
    assert "<a>" not in page and "&lt;t&gt;" in page
    for bad in ({"vertex_ids": ["a"]}, {"vertex_colors": [1] * 4, "vertex_labels": [1] * 4}):
        with pytest.raises(ValueError):
            both[1].to_html(f"{tmp_path}/h.html", **bad)
    with pytest.raises(NotImplementedError):
        both[1].to_html(f"{tmp_path}/h.html", directed=True)
