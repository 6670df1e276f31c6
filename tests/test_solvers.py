"""Planted structure and hand-computed images."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.operators import raster, solvers


@pytest.fixture(scope="module")
def planted(spark):
    """Three blocks of 20, weight 1 inside and a few weak edges between."""
    edges = [(b * 20 + i, b * 20 + j, 1.0) for b in range(3) for i in range(20) for j in range(20) if i != j]
    weak = [(0, 20), (21, 41), (5, 45)]
    edges += [(a, b, 0.01) for a, b in weak] + [(b, a, 0.01) for a, b in weak]
    return spark.createDataFrame(edges, "src long, dst long, w double").cache()


def test_communities_find_the_blocks(planted):
    member = solvers.communities(planted)
    got = {r["node"]: r["community"] for r in member.collect()}
    assert len(got) == 60 and 2 <= len(set(got.values())) <= 4
    for b in range(3):
        block = [got[b * 20 + i] for i in range(20)]
        assert max(map(block.count, block)) >= 18
    singles = member.withColumn("community", F.col("node"))
    assert solvers.modularity(planted, member).first()["q"] > max(solvers.modularity(planted, singles).first()["q"], 0.6)


def test_communities_of_nothing(planted):
    assert solvers.communities(planted.limit(0)).count() == 0


def test_eigenvectors_of_a_small_matrix(spark):
    rng = np.random.default_rng(1)
    a = rng.random((12, 12))
    a = (a + a.T) / 2
    a /= np.abs(np.linalg.eigvalsh(a)).max()
    df = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(12) for j in range(12)], "src long, dst long, w double")
    vectors, values = solvers.top_eigenvectors(df, 2, tolerance=1e-9)
    x = np.array([r["vec"] for r in vectors.orderBy("id").collect()])
    assert values == pytest.approx(np.linalg.eigvalsh(a)[::-1][:2].tolist(), abs=1e-4)
    assert np.abs(x.T @ x - np.eye(2)).max() < 1e-8
    assert np.abs(a @ x[:, 0] - values[0] * x[:, 0]).max() < 1e-2


def test_density_clusters(spark):
    rows = [(i, i * 0.1, 0.0, 0.0) for i in range(10)] + [(20 + i, 5 + i * 0.1, 1.0, 1.0) for i in range(10)] + [(99, 9.0, 9.0, 9.0)]
    got = {r["id"]: r["cluster"] for r in solvers.density_clusters(spark.createDataFrame(rows, "id long, x double, y double, z double"), 0.15, 3).collect()}
    assert {got[i] for i in range(10)} == {1} and {got[20 + i] for i in range(10)} == {2} and got[99] == 0


def test_farthest_points(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 5.0]), (3, [4.0, 0.0])], "id long, v array<double>")
    assert solvers.farthest_points(df, "v", 3) == [0, 2, 3]


@pytest.mark.parametrize("shape", [(1, 1), (2, 3), (4, 4), (5, 2), (3, 6)])
def test_assignment_equals_all_permutations(shape):
    rng = np.random.default_rng(sum(shape))
    for _ in range(20):
        s = rng.integers(0, 6, shape).astype(float)
        got = solvers.assign(s)
        n, m = shape
        small, large = sorted(shape)
        best = max(sum(s[a, b] if n <= m else s[b, a] for a, b in enumerate(p)) for p in itertools.permutations(range(large), small))
        assert len(got) == small and len({a for a, _ in got}) == len({b for _, b in got}) == small
        assert sum(s[a, b] for a, b in got) == best


def test_sobel_is_zero_inside_a_uniform_image(spark):
    df = spark.createDataFrame([(0, y, x, 0.5) for y in range(5) for x in range(5)], "i int, y int, x int, v double")
    got = {(r["y"], r["x"]): r["edge"] for r in raster.edge_strength(df, ["i"]).collect()}
    assert len(got) == 25 and all(got[y, x] == pytest.approx(0, abs=1e-6) for y in range(1, 4) for x in range(1, 4)) and got[0, 2] == pytest.approx(2.0)


def test_blur_lowers_a_peak_and_keeps_its_mass(spark):
    df = spark.createDataFrame([(0, y, x, float(y == x == 6)) for y in range(13) for x in range(13)], "i int, y int, x int, v double")
    got = [r["blurred"] for r in raster.blur(df, ["i"], 1.0).collect()]
    assert max(got) < 0.2 and sum(got) == pytest.approx(1.0)


def test_front_splats_hide_those_behind(spark):
    df = spark.createDataFrame([(0, 1, 1.0, 0.5, 1), (0, 2, 2.0, 0.5, 2), (0, 3, 3.0, 1.0, 3)], "ray int, id int, depth double, a double, k int")
    c = raster.composited(df, ["ray"], F.col("depth"), F.col("a"))
    assert [r["weight"] for r in c.orderBy("id").collect()] == pytest.approx([0.5, 0.25, 0.25])
    assert raster.strongest_cluster(c, ["ray"], least=0.4).first()["k"] == 1


def test_embedding_finds_the_planted_number_of_groups(planted):
    from gneiss.operators import affinity

    rows, k, clear = solvers.spectral_embedding(affinity.normalised(planted), 5, tolerance=1e-4)
    assert k == 3 and clear > 5
    x = {r["id"]: np.array(r["vec"]) for r in rows.collect()}
    assert all(abs(np.linalg.norm(v) - 1) < 1e-9 for v in x.values())
    assert min(x[0] @ x[i] for i in range(20)) > 0.99 and max(abs(x[0] @ x[20 + i]) for i in range(40)) < 0.1


def test_kmeans_and_unknown_clusterers(spark):
    df = spark.createDataFrame([(i, [float(i // 10) * 5, 0.1 * (i % 3)]) for i in range(30)], "id long, v array<double>")
    got = {r["id"]: r["cluster"] for r in solvers.clusterer("kmeans")(df, "v", 3).collect()}
    assert len({got[i] for i in range(30)}) == 3 and all(got[i] == got[10 * (i // 10)] for i in range(30))
    with pytest.raises(ValueError):
        solvers.clusterer("other")


def test_kmeans_settles_and_leaves_out_what_is_no_vector(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(c, 1.0, (40, 3)) for c in ((0, 0, 0), (6, 0, 0), (0, 6, 0), (3, 3, 6))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0, None, 2.0]), (902, [1.0, float("nan"), 2.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r["id"]: r["cluster"] for r in solvers.clusterer("kmeans")(df, "v", 4).collect()}
    assert sorted(got) == list(range(160)) and set(got.values()) == {0, 1, 2, 3}
    label = np.array([got[i] for i in range(160)])
    means = np.array([x[label == c].mean(axis=0) for c in range(4)])
    gaps = np.square(x[:, None] - means).sum(axis=2)
    assert (gaps.argmin(axis=1) == label).all()  # no row is nearer to the mean of another cluster
    assert gaps.min(axis=1).sum() < 1.2 * sum(np.square(x[40 * c : 40 * c + 40] - x[40 * c : 40 * c + 40].mean(axis=0)).sum() for c in range(4))


def test_kmeans_of_few_different_vectors_and_of_none(spark):
    df = spark.createDataFrame([(i, [float(i % 2), 1.0]) for i in range(9)], "id long, v array<double>")
    got = {r["id"]: r["cluster"] for r in solvers.clusterer("kmeans")(df, "v", 5).collect()}
    assert len({got[0], got[1]}) == 2 and all(got[i] == got[i % 2] for i in range(9))
    assert solvers.clusterer("kmeans")(df.limit(0), "v", 3).count() == 0
    with pytest.raises(Exception, match="other lengths"):
        solvers.clusterer("kmeans")(df.union(spark.createDataFrame([(77, [1.0])], df.schema)), "v", 2).collect()


def _reached(edges):
    root = {x: x for e in edges for x in e}

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in edges:
        low, high = sorted((top(a), top(b)))
        root[high] = low
    return {i: top(i) for i in root}


@pytest.mark.parametrize("shape", ["backwards", "random path", "grid", "stars", "cycle and loops"])
def test_components_of_wide_graphs_settle(spark, shape):
    from gneiss.operators.components import connected_components

    rng = np.random.default_rng(8)
    n = 5000
    if shape == "backwards":
        path = [0, *range(n - 1, 0, -1)]
        edges = list(itertools.pairwise(path))
    elif shape == "random path":
        edges = list(itertools.pairwise(rng.permutation(n).tolist()))
    elif shape == "grid":
        name = rng.permutation(3600).reshape(60, 60)
        edges = [(int(name[i, j]), int(name[i + a, j + b])) for i in range(59) for j in range(59) for a, b in ((0, 1), (1, 0))]
    elif shape == "stars":
        edges = [(9000 + s, s * 500 + k) for s in range(4) for k in range(500)] + [(9000, 9001)]
    else:
        edges = [(k, (k + 1) % 700) for k in range(700)] + [(k, k) for k in range(800, 820)] + [(901, 900), (900, 901)]
    df = spark.createDataFrame([*edges, (None, 3), (4, None)] if shape == "stars" else edges, "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == _reached(edges)


def _parts(rows, inside):
    left, out = set(rows), []
    while left:
        grown, stack = set(), [next(iter(left))]
        while stack:
            i = stack.pop()
            if i not in grown:
                grown.add(i)
                stack += [b for a, b, _ in inside if a == i]
        out.append(grown)
        left -= grown
    return out


@pytest.mark.parametrize("seed", [1])
def test_refined_communities_are_well_connected_and_no_worse(spark, seed):
    rng = np.random.default_rng(seed)
    group = np.repeat(np.arange(8), 12)
    pairs = [(i, j) for i, j in itertools.combinations(range(96), 2) if rng.random() < (0.5 if group[i] == group[j] else 0.06)]
    edges = [(a, b, 1.0) for i, j in pairs for a, b in ((i, j), (j, i))]
    df = spark.createDataFrame(edges, "src long, dst long, w double").cache()
    found = {}
    for refine in (True, False):
        member = solvers.communities(df, refine=refine)
        found[refine] = solvers.modularity(df, member).first()["q"], {r["node"]: r["community"] for r in member.collect()}
    assert found[True][0] >= found[False][0] - 1e-6 and found[True][0] > 0.3
    label, total = found[True][1], float(len(edges))
    degree = {i: sum(a == i for a, _, _ in edges) for i in label}
    for c in set(label.values()):
        rows = [i for i in label if label[i] == c]
        inside = [e for e in edges if label[e[0]] == c == label[e[1]]]
        assert min(rows) == c and len(_parts(rows, inside)) == 1
        dc = sum(degree[i] for i in rows)
        for i in rows:  # no node hangs on its community by less than chance
            assert len(rows) == 1 or sum(a == i for a, _, _ in inside) >= degree[i] * (dc - degree[i]) / total - 1e-9


def test_refined_parts_are_held_together(spark):
    """Two cliques in one community that a single weak edge joins are two parts of it."""
    edges = [(b * 6 + i, b * 6 + j, 1.0) for b in range(2) for i in range(6) for j in range(6) if i != j] + [(0, 6, 0.1), (6, 0, 0.1), (12, 13, 60.0), (13, 12, 60.0)]
    df = spark.createDataFrame(edges, "src long, dst long, w double")
    degree = df.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("d"))
    state = degree.withColumn("c", F.when(F.col("node") < 12, 0).otherwise(12).cast("long"))
    got = {r["node"]: r["part"] for r in solvers._refined(df, state, sum(e[2] for e in edges), 1.0).collect()}
    assert got == {**{i: 0 for i in range(6)}, **{6 + i: 6 for i in range(6)}, 12: 12, 13: 12}


def test_edges_by_name(spark):
    df = spark.createDataFrame([(0, y, x, float(x > 2)) for y in range(4) for x in range(6)], "i int, y int, x int, v double")
    plain, named = ({(r["y"], r["x"]): r["edge"] for r in f.collect()} for f in (raster.edge_strength(df, ["i"]), raster.edge_maps(df, ["i"])))
    assert named == plain and named[1, 2] == pytest.approx(4.0)
    soft = {(r["y"], r["x"]): r["edge"] for r in raster.edge_maps(df, ["i"], smooth=1.0).collect()}
    assert len(soft) == 24 and soft[1, 2] < named[1, 2]
    maps = spark.createDataFrame([(0, 1, 1, 0.7), (0, 1, 2, 0.2), (0, 9, 9, 1.0)], "i int, y int, x int, edge double")
    raw = {(r["y"], r["x"]): r["edge"] for r in raster.edge_maps(df, ["i"], "ingested", maps=maps).collect()}
    cut = {(r["y"], r["x"]): r["edge"] for r in raster.edge_maps(df, ["i"], "ingested", maps=maps, threshold=0.5).collect()}
    assert len(raw) == 24 and raw[1, 1] == 0.7 and raw[0, 0] == 0.0 and sum(cut.values()) == 1.0 == cut[1, 1]
    for bad in ({"method": "other"}, {"method": "ingested"}, {"method": "ingested", "maps": maps, "threshold": 1.0}):
        with pytest.raises(ValueError):
            raster.edge_maps(df, ["i"], **bad)


@pytest.mark.parametrize("part", [16384, 9])
def test_eigenvectors_compute_their_input_once(spark, monkeypatch, part):
    """However many products, and in whatever parts."""
    monkeypatch.setattr(solvers, "PART", part)
    n, rng = 60, np.random.default_rng(2)
    a = rng.random((n, n)) * (rng.random((n, n)) < 0.2)
    a = (a + a.T) / 2 + np.diag(np.full(n, 0.1))
    a /= np.abs(np.linalg.eigvalsh(a)).max()
    met = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            met.add(batch.num_rows)
            yield batch

    i, j = np.nonzero(a)
    rows = list(zip(i.tolist(), j.tolist(), a[i, j].tolist(), strict=True))
    df = spark.createDataFrame(rows, "src long, dst long, w double").mapInArrow(counted, "src long, dst long, w double")
    vectors, values = solvers.top_eigenvectors(df, 3, tolerance=1e-8)
    x = np.array([r["vec"] for r in vectors.orderBy("id").collect()])
    assert met.value == len(rows)
    assert values == pytest.approx(np.linalg.eigvalsh(a)[::-1][:3].tolist(), abs=1e-6)
    assert np.abs(x.T @ x - np.eye(3)).max() < 1e-8 and np.abs(a @ x - x * values).max() < 1e-2


@pytest.mark.parametrize("eps, least", [(0.35, 4), (0.8, 6), (0.1, 3)])
def test_density_clusters_equal_all_pairs(spark, eps, least):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, s, (n, 3)) for c, s, n in ((0, 0.15, 60), (1.2, 0.3, 60), (-2, 0.6, 40))] + [np.full((9, 3), 5.0), np.array([[5.0, 5.0, 5.0 + eps], [8.0, 8.0, 8.0]])])
    rows = [(2 * i, *map(float, p)) for i, p in enumerate(rng.permutation(x))] + [(1001, None, 0.0, 0.0), (1003, float("nan"), 0.0, 0.0)]
    p = np.array([r[1:] for r in rows[:-2]])
    d2 = ((p[:, None] - p[None]) ** 2)
    d2 = d2[..., 0] + d2[..., 1] + d2[..., 2]
    near = d2 <= eps * eps
    core = near.sum(axis=1) >= least
    label = np.where(core, np.arange(len(p)), -1)
    while True:
        low = np.array([min(label[near[i] & core]) if core[i] else -1 for i in range(len(p))])
        if (low == label).all():
            break
        label = low
    rank = {c: k + 1 for k, c in enumerate(sorted(set(label[core].tolist())))}
    want = {1001: 0, 1003: 0}
    for i in range(len(p)):
        by = [(d2[i, j], j) for j in np.flatnonzero(near[i] & core)]
        want[2 * i] = rank[int(label[min(by)[1]])] if by else 0
    df = spark.createDataFrame(rows, "id long, x double, y double, z double")
    assert {r["id"]: r["cluster"] for r in solvers.density_clusters(df, eps, least).collect()} == want
    assert len(rank) >= 2


def test_density_clusters_write_no_pairs_of_a_crowd(spark, monkeypatch):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.normal(0, 0.1, (3000, 3)))], "id long, x double, y double, z double")
    rows, write = [], solvers.materialise

    def counted(df, label):
        out = write(df, label)
        rows.append(out.count())
        return out

    monkeypatch.setattr(solvers, "materialise", counted)
    assert solvers.density_clusters(df, 0.2, 5).count() == 3000
    assert max(rows) < 20 * 3000
