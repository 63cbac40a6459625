"""Steps that carry operators over large tables, against brute force on small ones."""

import numpy as np
import pytest

from weft.functions.metrics import pairwise


def points(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, x array<double>")


@pytest.mark.parametrize("metric", ["euclidean", "sqeuclidean", "manhattan", "cosine"])
def test_screened_neighbors_are_exact(metric):
    """what the screen of single precision leaves is what all distances say, with ties, copies and far targets."""
    from weft.operators.scan import Nearest, measured

    rng = np.random.default_rng(0)
    for dims in (2, 33):
        x = rng.normal(size=(700, dims)).round(1 if dims < 5 else 9)
        x[:90], x[90:95] = x[5], x[90:95] * 1e4
        ids = rng.permutation(700).astype(np.int64)
        d = np.vstack([measured(np.repeat(x[i : i + 1], 700, 0), x, metric) for i in range(700)])
        assert np.allclose(d, pairwise(x, x, metric), equal_nan=True)
        for k, positive in ((1, True), (6, False), (None, False)):
            own = Nearest(ids, x, metric, k=k, epsilon=0.5, group=ids, positive=positive)
            found = [t for lo in range(0, 700, 300) for t in own.add(ids[lo : lo + 300], x[lo : lo + 300], ids[lo : lo + 300])]
            found = found if k is None else [own.found()[:3]]
            got = {(int(a), int(b), float(c)) for t in found for a, b, c in zip(*t, strict=True)}
            want = set()
            for i in range(700):
                j = [j for j in np.lexsort((ids, d[i])) if j != i and d[i, j] <= 0.5 and (d[i, j] != 0 or not positive)]
                want |= {(int(ids[i]), int(ids[j]), float(d[i, j])) for j in j[:k]}
            assert got == want


def test_points_without_clusters_are_screened(spark):
    """no cells, and few queries meet shares of the targets in several tasks."""
    from weft.operators import neighbors

    x = np.random.default_rng(3).normal(size=(9000, 40))
    own = points(spark, x)
    few = own.where("id < 50")
    d = pairwise(x[:50], x)
    got = {(r.qid, r.tid, r["rank"]) for r in neighbors.neighbors(few, own, k=3, exclude_self=True).collect()}
    assert got == {(i, int(j), r + 1) for i in range(50) for r, j in enumerate([j for j in np.argsort(d[i], kind="stable") if j != i][:3])}


def test_searches_touch_what_they_reach(spark):
    """a search in one of many small components costs nothing for the others."""
    from weft.operators.analysis import _Adjacency

    a = np.arange(0, 200_000, 2)
    adj = _Adjacency(np.concatenate([a, a + 1]), np.concatenate([a + 1, a]), np.ones(200_000))
    dist, pred = adj.search(10)
    assert dist == {10: 0.0, 11: 1.0} and pred == {10: -1, 11: 10}
    order, into, sigma = adj.ordered(11)
    assert order == [11, 10] and len(into) == len(sigma) == 2


def test_gaps_between_clusters(spark):
    """a pair for each two clusters, the first of equally near ones, and no table of pairs."""
    from weft.operators.manifold import _Gaps, inter_cluster_distance

    x = np.random.default_rng(1).normal(size=(600, 2)).round(1)
    label = np.random.default_rng(2).integers(0, 7, 600)
    d = pairwise(x, x, "sqeuclidean")
    want = {}
    for i in range(600):
        for j in range(600):
            if label[i] < label[j]:
                key = (int(label[i]), int(label[j]))
                want[key] = min(want.get(key, (np.inf, 0, 0)), (float(d[i, j]), i, j))
    got = inter_cluster_distance(points(spark, x), spark.createDataFrame(list(enumerate(label.tolist())), "id long, label int")).collect()
    assert {(r.c1, r.c2): (r.d, r.i, r.j) for r in got} == want
    own = _Gaps(np.arange(600), x, label)
    assert not list(own.add(np.arange(600), x, label)) and next(own.end()).num_rows == 21


def test_subspaces_of_large_clusters(spark):
    """directions from sums, in memory that doesn't grow with a cluster (a full decomposition of 20,000 points has 20,000 x 20,000 numbers)."""
    from weft.operators.manifold import _axes, cluster_subspaces

    x = np.random.default_rng(3).normal(size=(400, 5)) * [5, 3, 2, 1, 0.5] + 100
    own = cluster_subspaces(points(spark, x), spark.createDataFrame([(i, i % 3) for i in range(400)], "id long, label int"), 2)
    for r in own.collect():
        one = x[r.label :: 3]
        _, _, v = np.linalg.svd(one - one.mean(0))
        assert np.allclose(r["mean"], one.mean(0)) and np.allclose(np.abs(np.array(r.axes).reshape(2, 5)), np.abs(v[:2]), atol=1e-8)
    assert _axes(np.random.default_rng(4).normal(size=(60_000, 3)), 1).shape == (3, 1)


def test_products_of_points(spark):
    """sums of d x d numbers made by tasks, and X'MX with a row for each point."""
    from weft.graph import Graph
    from weft.operators.embed import _left_over
    from weft.plans.linalg import gram

    rng = np.random.default_rng(5)
    x, w = rng.normal(size=(30, 4)), np.where(rng.random((30, 30)) < 0.2, rng.normal(size=(30, 30)), 0)
    g, own = Graph.from_numpy(spark, w), points(spark, x)
    assert np.allclose(gram(own, None, 4), x.T @ x) and np.allclose(gram(own, g.matrix(), 4), x.T @ w @ x)
    assert np.allclose(gram(_left_over(g, own), None, 4), x.T @ (np.eye(30) - w).T @ (np.eye(30) - w) @ x)


def test_trees_over_nearest_neighbors(spark, monkeypatch):
    """trees without a table of all pairs, also where parts lie farther apart than nearest neighbours reach."""
    import weft
    from weft.operators import spanning

    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(60, 3)).round(1) + c for c in (0, 40, 90)])
    x[7] = x[8]
    own = points(spark, x)
    key = lambda g: sorted((r.src, r.dst, round(r.weight, 9)) for r in g.edges.collect())
    want = key(weft.mst(own)), key(weft.disjoint_mst(own)), key(weft.perturbed_mst(own, num_perturbations=1))
    monkeypatch.setattr(spanning, "LOCAL_VERTICES", 10)
    monkeypatch.setattr(spanning, "_pairs", None)
    assert key(spanning._both_ways(own.select("id"), spanning.forest_of_points(own, few=10))) == want[0]
    assert key(weft.disjoint_mst(own)) == want[1]
    monkeypatch.setattr(spanning.forest_of_points, "__kwdefaults__", {"few": 10})
    assert key(weft.perturbed_mst(own, num_perturbations=1)) == want[2]
    d = pairwise(x, x)[np.triu_indices(len(x), 1)]
    for share in (0.05, 0.5, 1.0):
        assert spanning.percentile_of_distances(own, share, "euclidean", bins=8, few=40) == pytest.approx(np.quantile(d[d > 0], share), rel=1e-12)


def test_sequences_over_edges(spark):
    """more vertices than a dense matrix may have, and the same decisions as by whole searches."""
    from weft.graph import Graph
    from weft.operators import reorder, transform

    rng = np.random.default_rng(7)
    for _ in range(20):
        tree = [(int(rng.integers(0, b)), b) for b in range(1, 25)]
        more = sorted({tuple(sorted(map(int, e))) for e in rng.integers(0, 30, (25, 2))} - set(tree))
        slow, want = transform._Ways(30, tree, False), []
        for a, b in more:
            way = slow.way(a, b)
            want.append((a, b)) if way is not None and len(way) - 1 > 3 else slow.put([(a, b)])
        assert transform._closing_long_cycles(transform._Ways(30, tree, False), more, 3) == want
    n = 4500
    a = np.arange(n)
    ring = spark.createDataFrame([(int(v), int(w), 1.0) for v, w in [*zip(a, np.roll(a, -1), strict=True), *zip(np.roll(a, -1), a, strict=True)]], "src long, dst long, weight double")
    g = Graph(spark.range(n), ring).persisted()
    assert g.circle_tear(cycle_len_thresh=8).num_edges() == g.cycle_cut().num_edges() == 2 * n - 2
    assert g.cuthill_mckee().bandwidth().first()[0] == 2
    adj = rng.random((12, 12)) < 0.2
    assert sorted(reorder.cuthill_mckee_order(adj)) == list(range(12))


def test_cycle_cut_has_cycles_to_cut(spark):
    """a network of single nearest neighbours has none."""
    from weft.plans.queries import QUERIES, knn

    d = "/root/testdata/sf0.01"
    assert 0 < QUERIES["cycle_cut"](spark, d).count() < knn(spark, d, 2).symmetrize("max").num_edges()


def test_eigenvectors_on_the_driver(spark):
    """restarted, with few vectors held, against dense ones; and Laplacian PCA beyond the bound of dense problems."""
    from weft.graph import Graph
    from weft.operators import embed
    from weft.plans.sparse import eigenvectors, lanczos

    rng = np.random.default_rng(8)
    m = np.where(rng.random((300, 300)) < 0.05, rng.normal(size=(300, 300)), 0)
    m = m + m.T
    values, vectors = np.linalg.eigh(m)
    for smallest, at in ((True, slice(0, 3)), (False, slice(-3, None))):
        got, v = lanczos(m.__matmul__, 300, 3, smallest=smallest, held=40)
        assert np.allclose(got, values[at], atol=1e-8) and np.allclose(np.abs(v), np.abs(vectors[:, at]), atol=1e-5)
    twice, v = lanczos(np.diag([1.0, 1.0, 2.0, 3.0]).__matmul__, 4, 2)
    assert np.allclose(twice, 1) and np.allclose(v[2:], 0, atol=1e-8)
    x = rng.normal(size=(60, 4))
    g = Graph.from_numpy(spark, np.where(np.abs(m[:60, :60]) > 0, np.abs(m[:60, :60]), 0))
    got, own = eigenvectors(g.laplacian(), g.vertices, 2)
    dense = np.linalg.eigvalsh(np.diag(g.to_numpy().sum(0)) - g.to_numpy() + np.diag(g.to_numpy().diagonal()) * 0)[:2]
    assert len(own.columns) == 2 and got.shape == dense.shape
    p = points(spark, x)
    want = {r.id: r.coords for r in g.laplacian_pca(p, num_dims=2).collect()}
    large = {r.id: r.coords for r in embed._large_pca(g, p, 2, 0.5).collect()}
    assert all(np.allclose(want[i], large[i], atol=1e-6) for i in want)


def test_triangulation_of_many_points(spark, monkeypatch):
    """Thousands of points, hulls with long sides, grids and copies; and empty regions without all pairs."""
    import weft
    from weft.operators import geometric

    rng = np.random.default_rng(9)
    grid = np.array([(a, b) for a in range(8) for b in range(8)], float)
    for x, hull in ((rng.normal(size=(5000, 2)), None), (np.vstack([grid, grid[:5]]), 28)):
        tri = geometric.triangulate(x)
        sides = np.sort(np.vstack([tri[:, [0, 1]], tri[:, [1, 2]], tri[:, [2, 0]]]), 1)
        once = (np.unique(sides, axis=0, return_counts=True)[1] == 1).sum()
        assert len(tri) == 2 * len(np.unique(x, axis=0)) - 2 - once and hull in (None, once)
    a, b, c = (x[tri[:, k]] for k in range(3))
    assert np.abs((b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0]).sum() / 2 == pytest.approx(49)
    assert geometric.triangulate(np.arange(10.0).reshape(5, 2)).shape == (0, 3)
    x = rng.normal(size=(120, 2)) * [50, 1]
    own, d = points(spark, x), pairwise(x, x)
    monkeypatch.setattr(geometric, "all_pairs", None)
    lune = {(i, j) for i in range(120) for j in range(i + 1, 120) if not any(max(d[i, k], d[j, k]) < d[i, j] for k in range(120) if k not in (i, j))}
    circle = {(i, j) for i in range(120) for j in range(i + 1, 120) if not any(d[i, j] - 2 * np.linalg.norm((x[i] + x[j]) / 2 - x[k]) >= 1e-10 for k in range(120) if k not in (i, j))}
    for f, want in ((weft.relative_neighborhood_graph, lune), (weft.gabriel_graph, circle)):
        assert {(r.src, r.dst) for r in f(own).pairs(directed=False).collect()} == want
