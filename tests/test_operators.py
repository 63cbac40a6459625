"""Operators against known answers and independent small computations."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

import weft
from weft.functions.metrics import distance, pairwise
from weft.graph import Graph
from weft.operators import analysis, embed, label, neighbors, regularized, reorder, spanning, transform
from weft.plans.components import connected_components as contracted

P4 = [(0, 0), (1, 2), (3, 2), (-1, 0)]
P7 = [(0, 0), (1, 2), (3, 2.5), (-1, 0), (0.5, 0.2), (3, 0.6), (-2, -0.5)]
P10 = [(0.192, 0.622), (0.438, 0.785), (0.780, 0.273), (0.276, 0.802), (0.958, 0.876), (0.358, 0.501), (0.683, 0.713), (0.370, 0.561), (0.503, 0.014), (0.773, 0.883)]


def points(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, x array<double>")


def graph(spark, edges, n, *, both=False):
    e = [(a, b, float(w[0]) if w else 1.0) for a, b, *w in edges]
    e += [(b, a, w) for a, b, w in e if a != b] if both else []
    return Graph(spark.range(n), spark.createDataFrame(e, "src long, dst long, weight double"))


def half(g):
    return sorted((r.src, r.dst) for r in g.pairs(directed=False).collect())


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


# -- points --------------------------------------------------------------------------------------------------------------------


def test_metrics_agree(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6, 4))
    own = points(spark, x)
    two = own.select(F.col("id").alias("a"), F.col("x").alias("xa")).crossJoin(own.select(F.col("id").alias("b"), F.col("x").alias("xb")))
    for name in ("euclidean", "l2", "manhattan", "l1", "sqeuclidean", "cosine", "chebyshev"):
        d = pairwise(x, x, name)
        for r in two.select("a", "b", distance(F.col("xa"), F.col("xb"), name).alias("d")).collect():
            assert r.d == pytest.approx(d[r.a, r.b], abs=1e-9)
    with pytest.raises(ValueError):
        pairwise(x, x, "nearness")


def test_neighbor_graph(spark):
    p = points(spark, P4)
    assert weft.neighbor_graph(p, k=2, weighting="binary").to_numpy().tolist() == [[0, 1, 0, 1], [1, 0, 1, 0], [1, 1, 0, 0], [1, 1, 0, 0]]
    assert weft.neighbor_graph(p, k=2, metric="sqeuclidean").to_numpy().tolist() == [[0, 5, 0, 1], [5, 0, 4, 0], [13, 4, 0, 0], [1, 8, 0, 0]]
    near = weft.neighbor_graph(p, metric="euclidean", epsilon=3.61).to_numpy() ** 2
    assert np.allclose(near, [[0, 5, 13, 1], [5, 0, 4, 8], [13, 4, 0, 0], [1, 8, 0, 0]])
    d = pairwise(np.array(P4, float), np.array(P4, float))
    given = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(4) for j in range(4)], "i long, j long, d double")
    assert np.allclose(weft.neighbor_graph(given, k=2, precomputed=True).to_numpy(), weft.neighbor_graph(p, k=2).to_numpy())
    for bad in ({}, {"k": 2, "weighting": "heavy"}, {"k": 0}):
        with pytest.raises(ValueError):
            weft.neighbor_graph(p, **bad)
    twins = points(spark, [(0, 0), (0, 0), (1, 1)])
    assert weft.neighbor_graph(twins, k=1).num_edges() == 1 and weft.neighbor_graph(twins, k=1, weighting="binary").num_edges() == 3


def test_blocks_do_not_matter(spark):
    x = np.random.default_rng(1).normal(size=(90, 3)).round(1)
    p = points(spark, x)
    d = pairwise(x, x)
    one = sorted(map(tuple, neighbors.neighbors(p, p, k=4, exclude_self=True).collect()))
    many = sorted(map(tuple, neighbors.neighbors(p, p, k=4, exclude_self=True, block=13).collect()))
    want = sorted((i, j, d[i, j], r + 1) for i in range(90) for r, j in enumerate(sorted((j for j in range(90) if j != i), key=lambda j: (d[i, j], j))[:4]))
    assert one == many and [r[:2] + r[3:] for r in one] == [r[:2] + r[3:] for r in want]
    assert weft.nearest_neighbors(p, k=2).where("qid = 5").count() == 2
    assert weft.nearest_neighbors(p, points(spark, x[:3]), epsilon=100.0).count() == 270
    assert weft.nearest_neighbors(p.limit(0), p, k=2).count() == 0
    with pytest.raises(ValueError):
        weft.nearest_neighbors(p, p, k=1, precomputed=True)


def test_incremental_equals_batch(spark):
    p = points(spark, P7)
    for step, g in zip([1, 3, 6], weft.incremental_neighbor_graph(p, k=[1, 3, 6]), strict=True):
        assert np.allclose(g.to_numpy(), weft.neighbor_graph(p, k=step).to_numpy())
    for eps, g in zip([0.1, 2.8, 5.5], weft.incremental_neighbor_graph(p, epsilon=[0.1, 2.8, 5.5]), strict=True):
        assert np.allclose(g.to_numpy(), weft.neighbor_graph(p, epsilon=eps).to_numpy())
    with pytest.raises(ValueError):
        weft.incremental_edges(p, k=3, epsilon=2.0)


def test_geometric_graphs(spark):
    p = points(spark, P10)
    assert half(weft.gabriel_graph(p)) == [(0, 3), (0, 7), (1, 3), (1, 6), (1, 7), (2, 5), (2, 6), (2, 8), (3, 7), (4, 9), (5, 7), (5, 8), (6, 9)]
    lune = half(weft.relative_neighborhood_graph(p))
    assert lune == [(0, 3), (0, 7), (1, 3), (1, 6), (1, 7), (2, 6), (2, 8), (4, 9), (5, 7), (6, 9)]
    delaunay, urquhart = half(weft.delaunay_graph(p)), half(weft.urquhart_graph(p))
    assert set(lune) <= set(urquhart) < set(delaunay)
    x = np.array(P10)
    circles = set()
    for i in range(10):
        for j in range(i + 1, 10):
            for k in range(j + 1, 10):
                m = np.linalg.solve(2 * (x[[j, k]] - x[i]), (x[[j, k]] ** 2).sum(1) - (x[i] ** 2).sum())
                if all(((x[q] - m) ** 2).sum() >= ((x[i] - m) ** 2).sum() - 1e-12 for q in range(10)):
                    circles |= {(i, j), (i, k), (j, k)}
    assert set(delaunay) == circles
    with pytest.raises(ValueError):
        weft.delaunay_graph(points(spark, [(0, 0, 0)] * 4))


def test_spanning_trees(spark):
    p = points(spark, P4)
    assert np.allclose(weft.mst(p).to_numpy() ** 2, [[0, 5, 0, 1], [5, 0, 4, 0], [0, 4, 0, 0], [1, 0, 0, 0]])
    x = np.random.default_rng(2).normal(size=(40, 2))
    pairs = neighbors.all_pairs(points(spark, x)).select("a", "b", F.col("d").alias("w"))
    assert sorted(map(tuple, spanning.spanning_forest(pairs).collect())) == sorted(map(tuple, spanning.spanning_forest(pairs, local_edges=0).collect()))
    own = weft.disjoint_mst(p, num_spanning_trees=2)
    assert own.num_edges() == 12
    noisy = weft.perturbed_mst(p, num_perturbations=3, jitter=0.01)
    assert noisy.edges.agg(F.sum("weight")).first()[0] == pytest.approx(6)


def test_b_matching(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(8, 2))
    d = pairwise(x, x)
    rows = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(8) for j in range(8)], "i long, j long, d double")
    g = weft.b_matching(rows, 1, damping=0.5)
    import itertools

    def cost(order):
        return sum(d[order[i], order[i + 1]] for i in range(0, 8, 2))

    best = min(itertools.permutations(range(8)), key=cost)
    assert half(g) == sorted(tuple(sorted(best[i : i + 2])) for i in range(0, 8, 2))
    full = weft.b_matching(rows, 20)
    assert full.num_edges() == 56
    with pytest.raises(ValueError):
        weft.b_matching(rows, [1, 2])


def test_trajectories(spark):
    rows = [(t, s, [float(s), float(t)]) for t in range(2) for s in range(6)]
    own = spark.createDataFrame(rows, "traj_id long, step int, x array<double>")
    g = weft.directed_graph(own, k=3)
    whole = weft.neighbor_graph(points(spark, [r[2] for r in rows]), k=3).edges
    x = np.array([r[2] for r in rows])
    want = set()
    for r in whole.collect():
        last = r.src % 6 == 5
        way, edge = (None if last else x[r.src + 1] - x[r.src]), x[r.dst] - x[r.src]
        if last or 1 - way @ edge / np.linalg.norm(way) / np.linalg.norm(edge) <= 0:
            want.add((r.src, r.dst))
    assert {(r.src, r.dst) for r in g.edges.collect()} == want
    thin = weft.downsample_trajectories(own, lambda p, d: weft.epsilon_net(p, d), 1.5)
    assert 0 < thin.count() < 12


def test_epsilon_net_is_sequential(spark):
    x = np.random.default_rng(4).random((60, 2))
    chosen = []
    for i in range(60):
        if all(np.linalg.norm(x[i] - x[j]) > 0.2 for j in chosen):
            chosen.append(i)
    assert sorted(r.id for r in weft.epsilon_net(points(spark, x), 0.2).collect()) == chosen
    assert sorted(r.id for r in weft.epsilon_net(points(spark, P4), 1.7).collect()) == [0, 1, 2]


def test_fuzzy_c_means(spark):
    x = [(0, 0), (0.1, 0), (5, 5), (5.1, 5)]
    ids = {r.id for r in weft.fuzzy_c_means(points(spark, x), 2).collect()}
    assert len(ids & {0, 1}) == 1 and len(ids & {2, 3}) == 1
    assert weft.fuzzy_c_means(points(spark, x), 9).count() == 4


def test_sparse_codes(spark):
    rng = np.random.RandomState(1234)
    x = np.vstack([rng.normal(size=(5, 20)) + c for c in (0, 6)])
    for how in ({"sparsity_param": 0.005}, {"positive": True, "sparsity_param": 0.005}, {"sparsity_param": 0.005, "kmax": 4}):
        m = weft.sparse_regularized_graph(points(spark, x), **how).to_numpy()
        assert np.allclose(m.sum(1)[m.any(1)], 1) and (m >= 0).all() and not m.diagonal().any()
    m = weft.smce_graph(points(spark, x), kmax=4, keep_ratio=1).to_numpy()
    assert np.allclose(m.sum(1), 1) and weft.smce_graph(points(spark, x), kmax=4, keep_ratio=0.5).num_edges() < (m > 0).sum()
    a, y = rng.normal(size=(30, 6)), rng.normal(size=30)
    w = regularized.lasso(a, y, 0.05, tol=1e-10)
    slope = (a - a.mean(0)).T @ (y - y.mean() - (a - a.mean(0)) @ w) / 30
    assert np.allclose(slope[w != 0], 0.05 * np.sign(w[w != 0]), atol=1e-6) and (np.abs(slope) <= 0.05 + 1e-6).all()
    assert np.isfinite(regularized.lasso_cv(a, y, 3, grid=10)).all()


def test_manifold_graphs(spark):
    t = np.linspace(0, np.pi, 40)
    g = weft.manifold_spanning_graph(points(spark, np.column_stack([np.cos(t), np.sin(t)]) + np.random.default_rng(5).normal(0, 1e-3, (40, 2))), 1)
    assert g.connected_components().select("component").distinct().count() == 1
    moons = np.vstack([np.column_stack([np.cos(t), np.sin(t)]), np.column_stack([1 - np.cos(t) + 6, 0.5 - np.sin(t)])])
    two = weft.manifold_spanning_graph(points(spark, moons + np.random.default_rng(6).normal(0, 1e-3, moons.shape)), 1, num_ccs=2)
    assert two.connected_components().select("component").distinct().count() == 2
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        s = weft.saffron(points(spark, moons), q=6, k=2)
    d = pairwise(moons, moons)
    assert s.num_edges() == 160 and all(r.weight == pytest.approx(d[r.src, r.dst]) for r in s.edges.collect())
    labels = spark.createDataFrame([(i, int(i >= 40)) for i in range(80)], "id long, label long")
    r = weft.inter_cluster_distance(points(spark, moons), labels).first()
    block = pairwise(moons[:40], moons[40:], "sqeuclidean")
    assert r.d == pytest.approx(block.min()) and block[r.i, r.j - 40] == pytest.approx(block.min())


# -- analysis ------------------------------------------------------------------------------------------------------------------

G5D = [(0, 1), (0, 2), (1, 2), (2, 0), (3, 4), (4, 3)]
G4B = [(0, 1, 1), (0, 2, 2), (1, 0, 1), (1, 3, 3), (2, 0, 2), (2, 3, 1), (3, 1, 3), (3, 2, 1)]


def test_components(spark):
    g = graph(spark, G5D, 6)
    assert column(g.connected_components(), "component") == [0, 0, 0, 1, 1, 2]
    assert column(analysis.connected_components(g, local_edges=0), "component") == [0, 0, 0, 1, 1, 2]
    strong = graph(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (5, 0)], 6)
    assert column(analysis.connected_components(strong, connection="strong"), "component") == [0, 0, 0, 1, 1, 2]
    assert column(analysis.connected_components(strong, connection="strong", local_edges=0), "component") == [0, 0, 0, 1, 1, 2]
    with pytest.raises(ValueError):
        g.connected_components(connection="loose")
    rng = np.random.default_rng(12)
    for _ in range(5):
        n = 14
        e = [tuple(map(int, x)) for x in rng.integers(0, n, (20, 2))]
        reach = np.eye(n, dtype=bool)
        for a, b in e:
            reach[a, b] = True
        for k in range(n):
            reach |= reach[:, k, None] & reach[None, k]
        want = [int(np.flatnonzero(reach[i] & reach[:, i])[0]) for i in range(n)]
        assert column(analysis.connected_components(graph(spark, e, n), connection="strong"), "root") == want
    rng = np.random.default_rng(7)
    edges = spark.createDataFrame([tuple(map(int, e)) for e in rng.integers(0, 300, (200, 2))], "a long, b long")
    assert sorted(map(tuple, contracted(edges).collect())) == sorted(map(tuple, contracted(edges, one_task=0).collect()))


def test_widths(spark):
    g = graph(spark, G5D, 5)
    assert (g.bandwidth().first()[0], g.profile().first()[0]) == (2, 1)


def test_laplacians(spark):
    rng = np.random.default_rng(8)
    a = np.where(rng.random((7, 7)) < 0.4, rng.random((7, 7)), 0)
    g = Graph.from_numpy(spark, a)
    from weft.plans.linalg import coo_to_numpy

    own = a - np.diag(a.diagonal())
    for out, axis in ((False, 0), (True, 1)):
        deg = own.sum(axis)
        assert np.allclose(coo_to_numpy(g.laplacian(use_out_degree=out), 7), np.diag(deg) - own)
        q = np.where(deg > 0, np.sqrt(deg), 1)
        normed = -own / q[:, None] / q[None] + np.diag((deg > 0).astype(float))
        assert np.allclose(coo_to_numpy(g.laplacian(normed=True, use_out_degree=out), 7), normed)
    col = a.sum(0)
    half_l = np.eye(7) - np.divide(a, col[:, None], out=np.zeros_like(a), where=col[:, None] > 0)
    assert np.allclose(coo_to_numpy(g.ave_laplacian(), 7), (half_l + half_l.T) / 2)
    row = a.sum(1, keepdims=True)
    walk = 0.99 * np.divide(a, row, out=np.zeros_like(a), where=row > 0) + 0.01 / 7
    values, vectors = np.linalg.eig(walk.T)
    phi = np.abs(vectors[:, values.real.argmax()].real)
    f = np.diag(phi / phi.sum())
    assert np.allclose(coo_to_numpy(g.directed_laplacian(), 7), f - (f @ walk + walk.T @ f) / 2, atol=1e-8)
    with pytest.warns(UserWarning):
        g.directed_laplacian(max_iter=2)


def test_shortest_paths(spark):
    rng = np.random.default_rng(9)
    a = np.where(rng.random((15, 15)) < 0.2, rng.integers(1, 6, (15, 15)), 0).astype(float)
    np.fill_diagonal(a, 0)
    g = Graph.from_numpy(spark, a)
    for directed in (True, False):
        d = np.where(a > 0, a, np.inf)
        d = d if directed else np.minimum(d, d.T)
        np.fill_diagonal(d, 0)
        for k in range(15):
            d = np.minimum(d, d[:, k, None] + d[None, k])
        for edges in (10**6, 0):
            got = g.shortest_path(directed=directed, broadcast_edges=edges).collect()
            assert {(r.src, r.dst): r.dist for r in got} == {(i, j): d[i, j] for i in range(15) for j in range(15) if np.isfinite(d[i, j])}
            w = a if directed else np.where((a > 0) & (a.T > 0), np.minimum(a, a.T), np.maximum(a, a.T))
            assert all(r.pred is None if r.src == r.dst else d[r.src, r.pred] + w[r.pred, r.dst] == r.dist for r in got)
    near = {(r.src, r.dst) for r in g.shortest_path(weighted=False, limit=1).collect()}
    assert near == {(i, j) for i in range(15) for j in range(15) if i == j or a[i, j]}


def test_eccentricity(spark):
    g = graph(spark, [(0, 1, 1), (0, 2, 2)], 3, both=True)
    assert column(g.eccentricity(), "eccentricity") == [2, 3, 3]
    assert (g.diameter().first()[0], g.radius().first()[0]) == (3, 2)
    assert set(column(graph(spark, G5D, 5).eccentricity(), "eccentricity")) == {np.inf}


def test_betweenness(spark):
    g = graph(spark, G4B, 4)
    assert column(g.betweenness(weighted=False), "betweenness") == [1, 1, 1, 1]
    assert column(g.betweenness(), "betweenness") == [2, 0, 2, 0]
    assert column(g.betweenness(weighted=False, directed=False), "betweenness") == [0.5] * 4
    edge = lambda w: [r.betweenness for r in g.betweenness("edge", weighted=w).orderBy("src", "dst").collect()]
    assert edge(False) == [2] * 8 and edge(True) == [2, 3, 2, 1, 3, 2, 1, 2]


# -- transformation ------------------------------------------------------------------------------------------------------------


def test_subgraphs(spark):
    g = graph(spark, [(0, 1), (0, 2), (1, 2), (3, 4)], 5, both=True)
    assert [s.num_vertices() for s in g.connected_subgraphs(ordered=True)] == [3, 2]
    tree = g.shortest_path_subtree(0)
    assert sorted((r.src, r.dst) for r in tree.edges.collect()) == [(0, 1), (0, 2)]
    assert g.shortest_path_subtree(0, directed=False).num_edges() == 4
    assert g.neighborhood_subgraph(0, radius=1).num_vertices() == 3
    assert g.minimum_spanning_subtree().num_edges() == 6


def test_barycenter(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(20, 3))
    g = weft.neighbor_graph(points(spark, x), k=4)
    m = g.barycenter_edge_weights(points(spark, x)).to_numpy()
    assert np.allclose(m.sum(1), 1) and ((m != 0) <= (g.to_numpy() != 0)).all()
    i, nb = 0, np.flatnonzero(m[0])
    z = x[nb] - x[i]
    c = z @ z.T
    c.flat[:: len(c) + 1] += 1e-3 * np.trace(z @ z.T)
    w = np.linalg.solve(c, np.ones(len(c)))
    assert np.allclose(m[0, nb], w / w.sum())


def test_isograph(spark):
    t = np.linspace(0, 2 * np.pi, 10)[1:]
    g = weft.neighbor_graph(points(spark, np.column_stack([2 * np.sin(t), np.cos(t)])), k=2)
    gone = {(r.src, r.dst) for r in g.pairs().collect()} - {(r.src, r.dst) for r in g.isograph().pairs().collect()}
    assert gone == {(3, 4), (4, 3)}
    assert g.isograph(min_weight=999).num_edges() == g.num_edges()


def test_cycles(spark):
    ring = weft.chain_graph(spark, 12, wraparound=True, weights=1.0)
    for tree, how in (("mst", {}), ("spt", {"spt_idx": 0})):
        torn = ring.circle_tear(spanning_tree=tree, cycle_len_thresh=5, **how)
        assert torn.num_edges() == 22
    assert ring.circle_tear(cycle_len_thresh=11).num_edges() == 24
    with pytest.raises(ValueError):
        ring.circle_tear(spanning_tree="oak")
    assert ring.cycle_cut(cycle_len_thresh=6).num_edges() == 22
    assert ring.cycle_cut(cycle_len_thresh=20).num_edges() == 24


# -- embedding, labels, orders -------------------------------------------------------------------------------------------------


def coords(df):
    return np.array(column(df, "coords"))


def signless(a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    return all(np.allclose(p, q, atol=1e-5) or np.allclose(p, -q, atol=1e-5) for p, q in zip(a.T, b.T, strict=True))


EMB = [(0, 1), (0, 2), (1, 2), (2, 3), (2, 4), (3, 4)]
XE = [(1, 2), (2, 1), (3, 1.5), (4, 0.5), (5, 1)]


def test_embeddings(spark):
    chain = weft.chain_graph(spark, 5, weights=1.0)
    r2 = np.sqrt(2)
    line = weft.chain_graph(spark, 5, weights=r2)
    assert signless(coords(line.isomap(num_dims=1)), np.array([[-2 * r2, -r2, 0, r2, 2 * r2]]).T)
    assert signless(coords(chain.laplacian_eigenmaps(num_dims=1)), np.array([[0.5, 0.5, 0, -0.5, -0.5]]).T)
    g, p = graph(spark, EMB, 5, both=True), points(spark, XE)
    assert signless(g.locality_preserving_projections(p, num_dims=1), [[-0.95479113], [0.29727749]])
    assert signless(g.neighborhood_preserving_embedding(p, num_dims=1), [[0.99763], [0.068804]])
    x = np.array(XE) - np.mean(XE, 0)
    u, s, v = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(coords(g.laplacian_pca(points(spark, x), num_dims=1, beta=0)), s[0] * np.outer(u[:, 0], v[0]))
    m = g.barycenter_edge_weights(p)
    w = m.to_numpy()
    from weft.plans.linalg import coo_to_numpy

    assert np.allclose(coo_to_numpy(embed.lle_matrix(m), 5), (np.eye(5) - w).T @ (np.eye(5) - w))
    assert coords(m.locally_linear_embedding(num_dims=2)).shape == (5, 2)


def test_layouts(spark):
    g = weft.chain_graph(spark, 4, weights=1.0)
    got = [(r.x, r.y) for r in g.layout_circle().orderBy("id").collect()]
    assert np.allclose(got, [(1, 0), (0, 1), (-1, 0), (0, -1)])
    five = weft.chain_graph(spark, 5, weights=spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 0.1), (3, 1.0), (4, 2.0)], "position long, weight double"))
    x = coords(five.layout_spring(initial_layout=np.arange(10).reshape(5, 2)))
    assert np.allclose(x[:, 1] - x[:, 0], 1)
    assert np.allclose(x[0], (1.837091, 2.837091), atol=1e-5) and np.allclose(x[-1], (6.162909, 7.162909), atol=1e-5)
    with pytest.raises(ValueError):
        five.layout_spring(initial_layout=np.zeros((2, 2)))


def test_colors(spark):
    g = graph(spark, [(0, 1), (0, 2), (1, 2), (3, 4)], 5, both=True)
    assert column(g.color_greedy(), "color") == [1, 2, 3, 1, 2]
    assert column(label.color_greedy(g, local_edges=0), "color") == [1, 2, 3, 1, 2]
    kite = graph(spark, [(0, 1), (0, 2), (1, 2), (2, 3)], 4, both=True)
    assert column(kite.bicolor_spectral(), "color") == [True, True, False, True]


def test_classifiers(spark):
    rng = np.random.default_rng(11)
    x = np.vstack([rng.random((10, 2)), rng.random((10, 2)) + 2])
    truth = [0] * 10 + [1] * 10
    known = spark.createDataFrame([(i, truth[i] if i in (0, 19) else (None if i % 2 else -1)) for i in range(20)], "id long, label int")
    near = weft.neighbor_graph(points(spark, x), k=5).symmetrize("max")
    assert column(near.classify_nearest(known), "label") == truth
    whole = weft.neighbor_graph(points(spark, x), k=19).symmetrize("max")
    assert column(near.kernelize("rbf").classify_harmonic(known), "label") == truth or column(whole.kernelize("rbf").classify_harmonic(known), "label") == truth
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert column(near.classify_lgc(known), "label") == truth
    with pytest.warns(UserWarning):
        near.classify_lgc(known, max_iter=1)
    with pytest.raises(NotImplementedError):
        near.classify_local(known)
    split = column(whole.cluster_spectral(2), "cluster")
    assert split in (truth, [1 - t for t in truth])


def test_regression(spark):
    t = np.linspace(0, 1, 31)
    p = points(spark, np.column_stack([np.sin(t), np.cos(t)]))
    g = weft.neighbor_graph(p, k=4).symmetrize("avg")
    known = spark.createDataFrame([(i, float(t[i])) for i in range(0, 31, 2)], "id long, y double")
    for penalty in (0, 1e-4):
        for kernel, bound in (("rbf", 0.15), ("none", 0.25)):
            assert np.linalg.norm(np.array(column(g.regression(known, smoothness_penalty=penalty, kernel=kernel), "y")) - t) < bound
    two = known.withColumn("y", F.array("y", -F.col("y")))
    got = np.array(column(g.regression(two), "y"))
    assert np.allclose(got[:, 0], -got[:, 1])
    with pytest.raises(ValueError):
        g.regression(known.limit(0))


R9 = [(0, 1), (0, 2), (1, 3), (2, 4), (2, 5), (3, 6), (3, 7), (3, 8), (4, 7), (5, 7)]


def test_orders(spark):
    g = graph(spark, R9, 9, both=True)
    assert g.cuthill_mckee().bandwidth().first()[0] == 3
    assert g.laplacian_reordering().bandwidth().first()[0] == 3
    narrow = g.node_centroid_hill_climbing()
    assert narrow.bandwidth().first()[0] <= g.bandwidth().first()[0] and narrow.num_edges() == g.num_edges()
    assert sorted(reorder.cuthill_mckee_order(g.to_numpy())) == list(range(9))
    assert transform.component_edges(g).count() == 20


# Points whose matchings are known, and for each vertex the two that it chooses.
MATCHED = [(0.192, 0.622), (0.438, 0.785), (0.780, 0.273), (0.276, 0.802), (0.958, 0.876), (0.358, 0.501), (0.683, 0.713), (0.370, 0.561), (0.503, 0.014), (0.773, 0.883)]
DAMPED = [{1, 3}, {0, 3}, {6, 8}, {0, 1}, {2, 9}, {7, 8}, {2, 9}, {0, 5}, {2, 5}, {4, 6}]
UNDAMPED = [{3, 7}, {3, 7}, {4, 8}, {0, 1}, {6, 9}, {7, 8}, {4, 9}, {0, 5}, {2, 5}, {4, 6}]


def test_b_matching_of_known_points(spark):
    d = pairwise(np.array(MATCHED), np.array(MATCHED))
    rows = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(10) for j in range(10)], "i long, j long, d double")
    for damping, want in ((0.5, DAMPED), (1, UNDAMPED)):
        got = [set() for _ in range(10)]
        for r in weft.b_matching(rows, 2, damping=damping).edges.collect():
            got[r.src].add(r.dst)
        assert got == want
    some = weft.b_matching(rows, [0] * 5 + [20] * 5).edges.collect()
    assert {(r.src, r.dst) for r in some} == {(i, j) for i in range(5, 10) for j in range(10) if i != j}
    with pytest.warns(UserWarning, match="did not settle"):
        weft.b_matching(rows, 2, max_iter=2)


def test_affine_code_is_the_least():
    rng = np.random.default_rng(4)
    for _ in range(20):
        y, penalty = rng.normal(size=(6, 4)), rng.uniform(0.05, 1, 6)
        cost = lambda c: ((c @ y) ** 2).sum() / 2 + (penalty * np.abs(c)).sum()  # noqa: E731, B023
        c = regularized.affine_code(y, penalty)
        assert c.sum() == pytest.approx(1, abs=1e-7)
        for _ in range(300):
            step = rng.normal(size=6) * 10.0 ** rng.uniform(-6, 0)
            assert cost(c) <= cost(c + step - step.mean()) + 1e-7


def test_spanning_network_of_moons_and_a_roll(spark):
    rng = np.random.RandomState(1234)
    a = np.hstack((rng.uniform(0, 1, 55), rng.uniform(1, 2, 75))) * np.pi
    x = (1.3 + 0.12 * rng.randn(130)[:, None]) * np.column_stack((np.cos(a), np.sin(a)))
    x[:55] += (0, -0.2)
    x[55:] += (0.9, 0.25)
    g = weft.manifold_spanning_graph(points(spark, x), 2, num_ccs=2)
    assert not [e for e in g.edges.collect() if (e.src < 55) != (e.dst < 55)]
    assert g.connected_components().select("component").distinct().count() == 2
    roll = weft.swiss_roll(spark, 6, 120, radius=4.8, seed=2).persist()
    wide = roll.agg(F.min("theta"), F.max("theta")).first()
    share = roll.select("id", F.array((F.col("theta") - wide[0]) / (wide[1] - wide[0])).alias("x"))
    assert weft.error_ratio(weft.manifold_spanning_graph(roll.select("id", "x"), 2), share).first().errors == 0


def test_neighbors_in_cells_equal_all_pairs(spark, monkeypatch):
    """Clustered points: cells that can't hold anything near enough never meet."""
    from weft.operators import cells, neighbors

    rng, met = np.random.default_rng(0), []
    plan = cells.meetings

    def counted(own, q, t, reach, *, apart):
        out = plan(own, q, t, reach, apart=apart)
        met.append((len(out), len(q[0]) * len(t[0])))
        return out

    monkeypatch.setattr(neighbors, "meetings", counted)
    centres = rng.normal(size=(30, 3)) * 20
    x = centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 3)) * 0.3
    x[:50] = x[50:100]  # some coincide
    own = points(spark, x)
    other = points(spark, x[::7] + 0.1)
    rows = lambda df: sorted((r.qid, r.tid, round(r.dist, 9), r["rank"]) for r in df.collect())
    for q, kwargs in ((own, {"k": 4, "exclude_self": True}), (own, {"epsilon": 0.2}), (other, {"k": 3, "epsilon": 0.3, "metric": "manhattan"}), (other, {"k": 2, "metric": "sqeuclidean"}), (own, {"k": 2, "metric": "chebyshev"})):
        assert rows(neighbors.neighbors(q, own, block=256, **kwargs)) == rows(neighbors.neighbors(q, own, block=10**6, **kwargs))
    assert len(met) == 5 and all(a < 0.4 * b for a, b in met)


def test_forest_of_points_by_rounds(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(150, 3)), 2)
    x[3] = x[4]
    own = points(spark, x)
    key = lambda df: sorted((r.a, r.b, round(r.w, 9)) for r in df.collect())
    assert key(spanning.forest_of_points(own, few=0)) == key(spanning.forest_of_points(own))


def test_components_by_rounds_and_in_one_task(spark):
    from weft.plans.components import connected_components

    rng = np.random.default_rng(2)
    rows = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(None, 3), (5, 5)]
    edges = spark.createDataFrame(rows, "a long, b long")
    assert sorted(map(tuple, connected_components(edges, one_task=0).collect())) == sorted(map(tuple, connected_components(edges).collect()))


def test_sparse_solvers_equal_dense_ones(spark, monkeypatch):
    """Conjugate gradients and Lanczos' method, as beyond the bound of dense problems, against the dense results."""
    from weft.operators import embed, label

    rng = np.random.default_rng(7)
    g = weft.neighbor_graph(points(spark, rng.normal(size=(14, 2))), k=4).symmetrize("avg").persisted()
    labels = spark.createDataFrame([(i, i % 3) for i in range(0, 14, 4)], "id long, label int")
    values = spark.createDataFrame([(i, [float(np.sin(i)), float(i)]) for i in range(0, 14, 3)], "id long, y array<double>")

    def results():
        yield sorted(map(tuple, g.classify_harmonic(labels).collect()))
        for penalty in (0, 0.1):
            yield np.array([r.y for r in g.regression(values, smoothness_penalty=penalty).orderBy("id").collect()])
        yield np.abs([r.coords for r in g.laplacian_eigenmaps(num_dims=2).orderBy("id").collect()])
        yield [r.color for r in g.bicolor_spectral().orderBy("id").collect()]

    dense = list(results())
    monkeypatch.setattr(label, "LOCAL_VERTICES", 10)
    monkeypatch.setattr(embed, "LOCAL_VERTICES", 10)
    for a, b in zip(dense, results(), strict=True):
        assert a == b if isinstance(a, list) else np.allclose(a, b, atol=1e-6)
