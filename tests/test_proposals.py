"""Merge proposals and greedy unions against plain loops over small tables."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from gneiss.operators import proposals as pr


@pytest.fixture(scope="module", params=[1, 2, 3])
def scene(request, spark):
    rng = np.random.default_rng(request.param)
    n = 9
    clusters = {i: (float(rng.random()), int(rng.integers(5, 30))) for i in range(n)}
    pairs = {(a, b): (float(rng.uniform(-0.5, 1)), float(rng.uniform(-0.2, 1)), float(rng.uniform(-1, 1))) for a, b in itertools.combinations(range(n), 2)}
    p = spark.createDataFrame([(*k, *v) for k, v in pairs.items()], "a long, b long, traj double, pair double, corr double")
    c = spark.createDataFrame([(k, *v) for k, v in clusters.items()], "id long, objectness double, area long")
    return p, c, pairs, clusters, float(sum(a for _, a in clusters.values()))


def of(pairs, a, b):
    return pairs[min(a, b), max(a, b)]


def test_component_proposals(scene):
    p, c, pairs, clusters, total = scene
    o, area = {i: v[0] for i, v in clusters.items()}, {i: v[1] for i, v in clusters.items()}
    seeds = [i for i in sorted(o, key=lambda i: -o[i])[:5] if o[i] >= 0.3]
    found = []
    for seed in seeds:
        near = []
        for x in clusters:
            if x == seed:
                continue
            traj, pair, corr = of(pairs, seed, x)
            if o[x] >= 0.1 and traj >= 0.0 and pair >= 0.2 and corr <= 0.5 and (area[seed] + area[x]) / total <= 0.6:
                near.append((pair + 0.4 * (o[seed] + o[x]) / 2 + 0.3 * max(0.0, 0.5 - corr), x))
        near.sort(key=lambda s: -s[0])
        found += [(s, {seed, x}) for s, x in near[:2]]
        group = [seed]
        for _, x in near:
            fits = sum(area[g] for g in [*group, x]) / total <= 0.6 and max(of(pairs, x, g)[0] for g in group) >= 0.0 and min(of(pairs, x, g)[2] for g in group) <= 0.5
            if len(group) < 4 and fits:
                group.append(x)
        if len(group) > 1:
            inner = [of(pairs, a, b) for a, b in itertools.combinations(group, 2)]
            share = sum(area[g] for g in group) / total
            score = np.mean([q[1] for q in inner]) + 0.4 * np.mean([o[g] for g in group]) + 0.3 * max(0.0, 0.5 - np.mean([q[2] for q in inner])) - 0.05 * max(0.0, share - 0.45)
            found.append((score, set(group)))
    want, used = [], set()
    for score, group in sorted(found, key=lambda f: -f[0]):
        if not group & used and len(want) < 3:
            want.append((score, group))
            used |= group
    rules = dict(most_seeds=5, least_seed=0.3, least_member=0.1, least_traj=0.0, tau=0.2, most_corr=0.5, most_area=0.6, by_objectness=0.4, by_visibility=0.3)
    got = {}
    for r in pr.component_proposals(p, c, total, top=2, most_members=4, most_components=3, **rules).collect():
        got.setdefault((r["component"], round(r["score"], 9)), set()).add(r["id"])
    assert got == {(k, round(float(s), 9)): g for k, (s, g) in enumerate(want)}


def test_single_component(scene):
    p, c, pairs, clusters, total = scene
    o, area = {i: v[0] for i, v in clusters.items()}, {i: v[1] for i, v in clusters.items()}
    best = None
    for seed in [i for i in sorted(o, key=lambda i: -o[i])[:5] if o[i] >= 0.3]:
        group = [seed]
        while len(group) < 4:
            tries = {}
            for x in set(clusters) - set(group):
                like, traj = max(of(pairs, x, g)[1] for g in group), max(of(pairs, x, g)[0] for g in group)
                if o[x] >= 0.1 and traj >= 0.1 and like >= 0.3 and sum(area[g] for g in [*group, x]) / total <= 0.5:
                    tries[x] = like + 0.4 * o[x]
            if not tries:
                break
            group.append(max(tries, key=tries.get))
        if len(group) > 1:
            share = sum(area[g] for g in group) / total
            score = np.mean([o[g] for g in group]) + 0.35 * np.mean([of(pairs, a, b)[1] for a, b in itertools.combinations(group, 2)]) + 0.15 * (1 - abs(share - 0.3) / 0.3)
            best = (score, group) if best is None or score > best[0] + 1e-12 else best  # of equal ones the first seed's
    got = pr.single_component(p, c, total, most_seeds=5, least_seed=0.3, least_member=0.1, least_traj=0.1, tau=0.3, most_members=4, most_area=0.5, target_area=0.3, by_objectness=0.4).collect()
    assert [(round(r["score"], 9), r["members"]) for r in got] == ([(round(float(best[0]), 9), best[1])] if best else [])


def test_greedy_unions(spark):
    rng = np.random.default_rng(7)
    rows = [(f, k, int(rng.integers(0, 9)), int(rng.integers(9, 20)), 30) for f in range(5) for k in range(1, 7)]
    dense = spark.createDataFrame(rows, "frame int, k long, inter long, pred long, gt long")

    def score(chosen, pooled):
        sums = [(sum(r[2] for r in rows if r[0] == f and r[1] in chosen), sum(r[3] for r in rows if r[0] == f and r[1] in chosen), 30) for f in range(5)]
        if pooled:
            sums = [tuple(map(sum, zip(*sums, strict=True)))]
        return np.mean([i / (p + g - i) for i, p, g in sums])

    for pooled in (True, False):
        want, last = [], -1.0
        while len(want) < 6:
            top, k = max((round(score([*want, k], pooled), 12), -k) for k in range(1, 7) if k not in want)
            if top <= last + 1e-12:
                break
            want, last = [*want, -k], top
        if pooled:
            totals = dense.groupBy("k").agg(pr.F.sum("inter").alias("inter"), pr.F.sum("pred").alias("pred"))
            got = pr.greedy_union(totals, pr.F.lit(150), 1e-12)
        else:
            got = pr.greedy_union_by_frames(dense)
        assert [r["k"] for r in got.orderBy("rank").collect()] == want
    assert pr.greedy_union(totals.limit(0), pr.F.lit(0)).count() == 0
    assert pr.greedy_union_by_frames(dense.limit(0)).count() == 0


def test_likeness_without_a_signal(spark):
    still = spark.createDataFrame([(k, [1.0] * 6, [0.1 * k] * 3) for k in (1, 2, 2)], "label int, traj array<double>, f_dc array<double>")
    row = pr.similarity(still, "label", (0.5, 0.3, 0.2), 0.5, feat=None).first()
    assert row["s"] == pytest.approx(row["color"]) == pytest.approx(np.exp(-0.03 / 0.5))
    with pytest.raises(Exception, match="signals"):
        pr.similarity(still, "label", (0.5, 0.3, 0.0), 0.5, feat=None).collect()
