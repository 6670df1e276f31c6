"""The density hierarchy against brute force over all pairs."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from gneiss.operators import hierarchy


def planted(seed, n=100, noise=20):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.3, (n, 3)) for c in ((0, 0, 0), (3, 0, 0), (0, 4, 1))][:2] + [rng.normal((0, 4, 1), 0.6, (n - noise, 3)), rng.uniform(-6, 9, (noise, 3))])
    return rng.permutation(x)


def frame(spark, x):
    return spark.createDataFrame([(10 * i + 3, [float(v) for v in p]) for i, p in enumerate(x)], "id long, vec array<double>").repartition(3)


def brute_reach(x, least):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, least] if len(x) > least else np.full(len(x), np.inf)
    return core, np.maximum(np.maximum(d, core[:, None]), core[None])


def brute_tree(w):
    """Kruskal over all pairs."""
    root, out = list(range(len(w))), []

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for v, i, j in sorted((w[i, j], i, j) for i, j in itertools.combinations(range(len(w)), 2)):
        a, b = top(i), top(j)
        if a != b:
            root[b] = a
            out.append((10 * i + 3, 10 * j + 3, v))
    return out


def brute_clusters(tree, ids, least):
    """Clusters by cutting the tree's edges from the heaviest on, recursively, on sets of nodes."""

    def parts(nodes, edges):
        left, out = set(nodes), []
        while left:
            grown, stack = set(), [min(left)]
            while stack:
                i = stack.pop()
                if i not in grown:
                    grown.add(i)
                    stack += [b if a == i else a for a, b, _ in edges if i in (a, b)]
            out.append(grown)
            left -= grown
        return out

    def solve(nodes, edges, birth, top):
        full, stability = set(nodes), 0.0
        while edges:
            heaviest = max(edges, key=lambda e: (e[2], e[0], e[1]))
            edges = [e for e in edges if e is not heaviest]
            rate, two = 1 / heaviest[2], parts(nodes, edges)
            large = [p for p in two if len(p) >= least]
            if len(large) == 2:
                stability += (rate - birth) * len(nodes)
                below = [solve(p, [e for e in edges if e[0] in p], rate, False) for p in large]
                inner = sum(s for s, _ in below)
                if not top and stability >= inner:
                    return stability, [full]
                return max(stability, inner), [c for _, cs in below for c in cs]
            stability += sum((rate - birth) * len(p) for p in two if len(p) < least)
            if not large:
                break
            nodes = large[0]
            edges = [e for e in edges if e[0] in nodes]
        return stability, [] if top else [full]

    found = sorted(solve(set(ids), tree, 0.0, True)[1], key=min)
    return {i: k for k, c in enumerate(found) for i in c}


def test_labels_equal_brute_force(spark):
    x = planted(1)
    df = frame(spark, x)
    ids = [10 * i + 3 for i in range(len(x))]
    core, w = brute_reach(x, 5)
    dealt = hierarchy._dealt(df, 64)
    assert dealt.select("block").distinct().count() > 3
    cores = hierarchy.core_distances(dealt, 5)
    got = {r["id"]: r["core"] for r in cores.collect()}
    assert [got[i] for i in ids] == pytest.approx(core.tolist(), rel=1e-12)
    tree = brute_tree(w)
    forest = [tuple(r) for r in hierarchy.spanning_forest(dealt, cores).collect()]
    assert sorted(r[2] for r in forest) == pytest.approx(sorted(t[2] for t in tree), rel=1e-12) and {r[:2] for r in forest} == {t[:2] for t in tree}
    want = brute_clusters(tree, ids, 15)
    assert len(set(want.values())) >= 3
    rows = {r["id"]: (r["cluster"], r["noise"]) for r in hierarchy.density_hierarchy(df, 15, 5, block_rows=64).collect()}
    assert {i: c for i, (c, noise) in rows.items() if not noise} == want
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    named = [k for k, i in enumerate(ids) if i in want]
    for k, i in enumerate(ids):
        if i not in want:
            assert rows[i] == (want[ids[min(named, key=lambda j: (d[k, j], j))]], True)


def test_one_block_and_many_give_the_same(spark):
    df = frame(spark, planted(2, n=60))
    one, many = ({tuple(r) for r in hierarchy.density_hierarchy(df, 10, 4, block_rows=b).collect()} for b in (5000, 23))
    assert one == many


def test_all_noise_is_one_cluster(spark):
    x = np.random.default_rng(3).uniform(0, 1, (30, 2))
    got = hierarchy.density_hierarchy(frame(spark, x), 25, 3).collect()
    assert len(got) == 30 and {(r["cluster"], r["noise"]) for r in got} == {(0, True)}


def test_few_equal_and_missing_points(spark):
    schema = "id long, vec array<double>"
    assert hierarchy.density_hierarchy(spark.createDataFrame([], schema), 2).count() == 0
    assert [tuple(r) for r in hierarchy.density_hierarchy(spark.createDataFrame([(4, [1.0]), (None, [2.0]), (5, None), (6, [])], schema), 2).collect()] == [(4, 0, True)]
    same = [(i, [0.0, 0.0]) for i in range(10)] + [(20 + i, [5.0, float(i == 9)]) for i in range(10)]
    got = {r["id"]: r["cluster"] for r in hierarchy.density_hierarchy(spark.createDataFrame(same, schema), 5, 3, block_rows=4).collect()}
    assert {got[i] for i in range(10)} == {0} and {got[20 + i] for i in range(10)} == {1}


def test_shelves_give_the_same_lists_and_tree(spark, monkeypatch):
    """Points that go to other shelves, copies of a point, and far clusters, against all pairs."""
    monkeypatch.setattr(hierarchy, "SHELF", 40)
    monkeypatch.setattr(hierarchy, "LISTED", 5)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 1, (70, 4)), rng.normal(30, 0.2, (60, 4)), np.full((20, 4), 7.0), np.round(rng.normal(3, 1, (30, 4)))])
    df = frame(spark, x)
    ids = [10 * i + 3 for i in range(len(x))]
    dealt = hierarchy._dealt(df, 16)
    assert dealt.select("shelf").distinct().count() > 3
    core, w = brute_reach(x, 3)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    near = {r["id"]: [(n["gap"], n["to"]) for n in r["near"]] for r in hierarchy.nearest_lists(dealt, 5).collect()}
    for k, i in enumerate(ids):
        want = sorted((d[k, j], ids[j]) for j in range(len(x)) if j != k)[:5]
        assert [n[1] for n in near[i]] == [n[1] for n in want] and [n[0] for n in near[i]] == pytest.approx([n[0] for n in want], rel=1e-12)
    forest = [tuple(r) for r in hierarchy.spanning_forest(dealt, hierarchy.core_distances(dealt, 3)).collect()]
    assert {r[:2] for r in forest} == {t[:2] for t in brute_tree(w)} and len(forest) == len(x) - 1
    labels = spark.createDataFrame([(i, -1 if k < 75 or k % 9 else k) for k, i in enumerate(ids)], "id long, label long")
    named = [k for k in range(75, len(x)) if k % 9 == 0]
    got = {r["id"]: r["label"] for r in hierarchy._nearest_named(dealt, labels).collect()}
    assert got == {i: min(named, key=lambda j: (d[k, j], j)) for k, i in enumerate(ids) if k not in named}
