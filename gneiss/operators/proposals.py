"""Merge proposals of clusters from their likeness, objectness and visibility.

Tables here have one row a cluster, or one a pair of clusters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.safe import dot, norm, ratio
from gneiss.operators.affinity import gaussian, square_distance
from gneiss.operators.clusters import cluster_vectors
from gneiss.storage import materialise


def similarity(points: DataFrame, key: str, weights: tuple[float, float, float], sigma: float, least_size: int = 1, traj: str = "traj", feat: str | None = "feats", color: str = "f_dc") -> DataFrame:
    """``(a, b, traj, feat, color, s)`` for each two clusters, a < b.

    ``s`` sums the cosine of mean trajectories (less the one mean of all their
    numbers), that of unit mean features, and a Gaussian of mean colours, by
    ``weights`` that are made to sum to 1.  A signal that is missing has weight
    0: features without a column, trajectories when none moves by more than
    1e-6; without any signal the query raises.  ``s`` is 0 where a cluster has
    fewer than ``least_size`` points.
    """
    stats = points.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n"))
    for name, column in (("t", traj), ("f", feat), ("c", color)):
        if column:
            means = cluster_vectors(points.where(F.col(column).isNotNull()), key, column).select(F.col(key).alias("of"), F.col("mean").alias(name))
            stats = stats.join(means, F.col("id") == F.col("of"), "left").drop("of")
    mean = F.aggregate("t", F.lit(0.0), lambda acc, x: acc + x) / F.size("t")
    stats = stats.withColumn("_mean", mean).withColumn("t", F.transform("t", lambda x: x - F.col("_mean"))).withColumn("r", norm(F.col("t")))
    wt, wf, wc = weights
    wf = wf if feat else 0.0
    moving = F.when(F.col("most") > 1e-6, wt).otherwise(0.0)
    total = moving + wf + wc
    share = lambda w: w / F.when(total > 0, total).otherwise(F.raise_error(F.lit("all signals of the likeness are missing")))
    used = stats.agg(F.max("r").alias("most")).select(share(moving).alias("wt"), share(F.lit(wf)).alias("wf"), share(F.lit(wc)).alias("wc"))
    side = lambda s: stats.select(*(F.col(c).alias(f"{c}_{s}") for c in stats.columns if c != "_mean"))
    pairs = side("i").join(side("j"), F.col("id_i") < F.col("id_j")).crossJoin(F.broadcast(used))  # one row of weights
    unit = lambda s: F.greatest(norm(F.col(f"f_{s}")), F.lit(1e-12))
    out = pairs.select(
        F.col("id_i").alias("a"), F.col("id_j").alias("b"),
        (dot(F.col("t_i"), F.col("t_j")) / (F.greatest("r_i", F.lit(1e-12)) * F.greatest("r_j", F.lit(1e-12)))).alias("traj"),
        (dot(F.col("f_i"), F.col("f_j")) / (unit("i") * unit("j")) if feat else F.lit(0.0)).alias("feat"),
        gaussian(square_distance(F.col("c_i"), F.col("c_j")), sigma).alias("color"),
        "wt", "wf", "wc", (F.least("n_i", "n_j") >= least_size).alias("valid"),
    )
    s = F.col("wt") * F.col("traj") + F.col("wf") * F.col("feat") + F.col("wc") * F.col("color")
    return out.select("a", "b", "traj", "feat", "color", F.when(F.col("valid"), s).otherwise(0.0).alias("s"))


def objectness(stats: DataFrame, motion: str, area: str, border: str, total: Column, border_scale: float, area_scale: float, most_area: float) -> DataFrame:
    """Adds ``objectness``: moving, visible, not at the border and not huge.

    Motion is scaled from its 5th to its 85th percentile and clipped to m; the
    score is (0.2 + 0.8 m) (1 - exp(-share / area_scale)) exp(-edge / border_scale)
    exp(-max(share - most_area, 0) / 0.1), share being the area's part of
    ``total`` and edge the border pixels' part of the area.
    """
    ends = stats.agg(F.percentile(motion, F.lit(0.05)).alias("_low"), F.percentile(motion, F.lit(0.85)).alias("_high"))
    m = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(motion) - F.col("_low")) / F.greatest(F.col("_high") - F.col("_low"), F.lit(1e-9))))
    share, edge = ratio(F.col(area), F.greatest(total, F.lit(1))), F.col(border) / F.greatest(F.col(area), F.lit(1))
    huge = F.exp(-F.greatest(share - most_area, F.lit(0.0)) / 0.1)
    score = (0.2 + 0.8 * m) * (1 - F.exp(-share / area_scale)) * F.exp(-edge / border_scale) * huge
    return stats.crossJoin(F.broadcast(ends)).withColumn("objectness", score).drop("_low", "_high")  # one row of ends


def both_ways(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Each pair of (a, b) from both sides."""
    return pairs.unionByName(pairs.select(F.col(b).alias(a), F.col(a).alias(b), *(c for c in pairs.columns if c not in (a, b))))


def seed_neighbours(pairs: DataFrame, clusters: DataFrame, total: float, most_seeds: int, least_seed: float, least_member: float, least_traj: float, tau: float, most_corr: float, most_area: float, by_objectness: float, by_visibility: float) -> DataFrame:
    """``(seed, other, score, rank)``: what each seed could merge with, best first.

    ``pairs`` is ``(a, b, traj, pair, corr)``, a < b; ``clusters`` is ``(id,
    objectness, area)``.  Seeds are the ``most_seeds`` clusters of the highest
    objectness, at least ``least_seed``.  A neighbour's objectness, trajectory
    and likeness are high enough, it is seldom visible together with the seed,
    and both together are not too large.
    """
    seeds = clusters.orderBy(F.col("objectness").desc(), "id").limit(most_seeds).where(F.col("objectness") >= least_seed)
    seeds = seeds.select(F.col("id").alias("seed"), F.col("objectness").alias("so"), F.col("area").alias("sa"))
    others = clusters.select(F.col("id").alias("other"), F.col("objectness").alias("oo"), F.col("area").alias("oa"))
    met = both_ways(pairs).join(seeds, F.col("a") == F.col("seed")).join(others, F.col("b") == F.col("other"))
    fits = (F.col("oo") >= least_member) & (F.col("traj") >= least_traj) & (F.col("pair") >= tau) & (F.col("corr") <= most_corr)
    fits &= (F.col("sa") + F.col("oa")) / max(1.0, total) <= most_area
    score = F.col("pair") + by_objectness * (F.col("so") + F.col("oo")) / 2 + by_visibility * F.greatest(F.lit(0.0), most_corr - F.col("corr"))
    kept = met.where(fits).select("seed", "other", score.alias("score"))
    # Rounded, so that equal scores are ties whatever the order of sums.
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy(F.round("score", 12).desc(), "other")))


def component_proposals(
    pairs: DataFrame, clusters: DataFrame, total: float, *, top: int, most_members: int, most_components: int, least_traj: float, most_corr: float, most_area: float, by_objectness: float, by_visibility: float, **rules
) -> DataFrame:
    """``(component, id, score)``: disjoint groups of clusters to merge, best first.

    Candidates are each seed's pairs with its ``top`` neighbours, and one group
    that grows from the seed along its neighbours while the limits hold for the
    whole group.  Groups grow seed by seed, each in a task of its own; the
    candidates, at most ``most_seeds * (top + 1)``, are then gone through once,
    and a group is taken when it meets none taken before.
    """
    import pandas as pd

    limits = {"least_traj": least_traj, "most_corr": most_corr, "most_area": most_area, "by_objectness": by_objectness, "by_visibility": by_visibility}
    near = seed_neighbours(pairs, clusters, total, **limits, **rules)
    # To each seed: its neighbours in order, and all pairs among these and itself.
    ends = near.select("seed", "rank", F.col("other").alias("id")).union(near.select("seed", F.lit(0), F.col("seed")).distinct())
    ends = ends.join(clusters.select("id", "objectness", "area"), "id")
    one, two = (ends.select(F.col("seed").alias("of"), *(F.col(c).alias(f"{c}_{s}") for c in ("id", "rank", "objectness", "area"))) for s in "ij")
    inside = one.join(two, "of").where("rank_i < rank_j").join(both_ways(pairs).withColumnsRenamed({"a": "id_i", "b": "id_j"}), ["id_i", "id_j"])

    def grow(pdf):
        pair = {(r.id_i, r.id_j): r for r in pdf.itertuples()} | {(r.id_j, r.id_i): r for r in pdf.itertuples()}
        members = {r.id_j: (r.rank_j, r.objectness_j, r.area_j) for r in pdf.itertuples()} | {r.id_i: (r.rank_i, r.objectness_i, r.area_i) for r in pdf.itertuples()}
        seed, *others = sorted(members, key=lambda i: members[i][0])
        group = [seed]
        for other in others:
            if len(group) >= most_members:
                break
            known = [pair[other, old] for old in group]
            area = sum(members[i][2] for i in group) + members[other][2]
            if area / max(1.0, total) <= most_area and max(r.traj for r in known) >= least_traj and min(r.corr for r in known) <= most_corr:
                group.append(other)
        if len(group) < 2:
            return pd.DataFrame({"seed": [], "members": [], "score": []}, dtype=object)
        known = [pair[a, b] for k, a in enumerate(group) for b in group[k + 1 :]]
        mean = lambda xs: math.fsum(xs) / len(xs)
        share = sum(members[i][2] for i in group) / max(1.0, total)
        score = mean([r.pair for r in known]) + by_objectness * mean([members[i][1] for i in group])
        score += by_visibility * max(0.0, most_corr - mean([r.corr for r in known])) - 0.05 * max(0.0, share - 0.75 * most_area)
        return pd.DataFrame({"seed": [seed], "members": [sorted(group)], "score": [score]})

    grown = inside.groupBy("of").applyInPandas(grow, "seed long, members array<bigint>, score double")
    pairs_of = near.where(F.col("rank") <= top).select("seed", F.array_sort(F.array("seed", "other")).alias("members"), "score", "rank")
    # In the order in which seeds give them: pairs by rank, then the grown group.
    order = clusters.select(F.col("id").alias("seed"), F.col("objectness").alias("o"))
    found = pairs_of.union(grown.select("seed", "members", "score", F.lit(1 << 30))).join(order, "seed")
    first = Window.partitionBy("members").orderBy(F.round("score", 12).desc(), F.col("o").desc(), "seed", "rank")
    found = found.withColumn("_first", F.row_number().over(first)).where("_first = 1").drop("_first")
    best = F.array_sort(F.collect_list(F.struct((-F.round("score", 12)).alias("loss"), (-F.col("o")).alias("so"), "seed", "rank", "members")))
    start = F.struct(F.array().cast("array<bigint>").alias("used"), F.array().cast("array<struct<members:array<bigint>,loss:double>>").alias("taken"))

    def take(state: Column, x: Column) -> Column:
        free = ~F.arrays_overlap(state["used"], x["members"]) & (F.size(state["taken"]) < most_components)
        more = F.struct(F.concat(state["used"], x["members"]).alias("used"), F.concat(state["taken"], F.array(F.struct(x["members"].alias("members"), x["loss"].alias("loss")))).alias("taken"))
        return F.when(free, more).otherwise(state)

    taken = found.agg(F.aggregate(best, start, take)["taken"].alias("taken")).select(F.posexplode("taken").alias("component", "t"))
    return taken.select("component", F.explode("t.members").alias("id"), (-F.col("t.loss")).alias("score"))


def component_ids(clusters: DataFrame, groups: DataFrame) -> DataFrame:
    """``(id, merged)``: groups ``(component, id)`` are numbered first, in their order, then every other cluster by its id."""
    named = clusters.select("id").join(groups.select("id", "component"), "id", "left")
    order = Window.orderBy(F.col("component").asc_nulls_last(), F.when(F.col("component").isNull(), F.col("id")))
    return named.select("id", (F.dense_rank().over(order) - 1).cast("long").alias("merged"))


def single_component(pairs: DataFrame, clusters: DataFrame, total: float, *, most_seeds: int, least_seed: float, least_member: float, least_traj: float, tau: float, most_members: int, most_area: float, target_area: float, by_objectness: float) -> DataFrame:
    """``(seed, members, score)`` of the one best group, none where no seed finds a partner.

    From each seed a group takes, again and again, the cluster with the highest
    likeness to any member plus its weighted objectness, while trajectory,
    likeness and area allow it.  Groups score mean objectness, 0.35 times their
    mean likeness and 0.15 times the nearness of their area to ``target_area``.
    Every seed grows in a task of its own, over the pairs of eligible clusters.
    """
    import pandas as pd

    seeds = clusters.orderBy(F.col("objectness").desc(), "id").limit(most_seeds).where(F.col("objectness") >= least_seed)
    named = lambda s: clusters.select(*(F.col(c).alias(f"{c}_{s}") for c in ("id", "objectness", "area")))
    known = pairs.join(named("i"), F.col("a") == F.col("id_i")).join(named("j"), F.col("b") == F.col("id_j"))
    seed = seeds.select(F.col("id").alias("seed"))
    may = lambda s: (F.col(f"objectness_{s}") >= least_member) | (F.col(f"id_{s}") == F.col("seed"))
    given = known.join(seed, may("i") & may("j"))

    def grow(pdf):
        pair = {(r.id_i, r.id_j): r for r in pdf.itertuples()} | {(r.id_j, r.id_i): r for r in pdf.itertuples()}
        members = {r.id_j: (r.objectness_j, r.area_j) for r in pdf.itertuples()} | {r.id_i: (r.objectness_i, r.area_i) for r in pdf.itertuples()}
        group = [int(pdf.seed.iloc[0])]
        while len(group) < most_members and group[0] in members:
            area = sum(members[i][1] for i in group)
            tries = []
            for other in members.keys() - set(group):
                near = [pair[other, old] for old in group]
                like = max(r.pair for r in near)
                if max(r.traj for r in near) >= least_traj and like >= tau and (area + members[other][1]) / max(1.0, total) <= most_area:
                    tries.append((-round(like + by_objectness * members[other][0], 12), other))
            if not tries:
                break
            group.append(min(tries)[1])
        if len(group) < 2:
            return pd.DataFrame({"seed": [], "members": [], "score": []}, dtype=object)
        mean = lambda xs: math.fsum(xs) / len(xs)
        share = sum(members[i][1] for i in group) / max(1.0, total)
        score = mean([members[i][0] for i in group]) + 0.35 * mean([pair[a, b].pair for k, a in enumerate(group) for b in group[k + 1 :]])
        score += 0.15 * (1 - abs(share - target_area) / max(target_area, 1e-9))
        return pd.DataFrame({"seed": [group[0]], "members": [group], "score": [score]})

    grown = given.groupBy("seed").applyInPandas(grow, "seed long, members array<bigint>, score double")
    order = grown.join(clusters.select(F.col("id").alias("seed"), "objectness"), "seed")
    return order.orderBy(F.round("score", 12).desc(), F.col("objectness").desc(), "seed").limit(1).select("seed", "members", "score")


def greedy_union(totals: DataFrame, gt: Column, margin: float = 0.0, from_empty: bool = False, k: str = "k") -> DataFrame:
    """``(rank, k, score)``: clusters in the order in which a union takes them.

    ``totals`` is ``(k, inter, pred)`` over a whole scene, one row a cluster.
    From the best cluster on (or from none, a score of 0), the cluster that
    raises the union's IoU most is taken, the smallest id on ties, while the
    IoU grows by more than ``margin``.
    """
    row = totals.agg(F.array_sort(F.collect_list(F.struct(F.col(k).cast("long").alias("k"), F.col("inter").cast("long").alias("i"), F.col("pred").cast("long").alias("p")))).alias("all"), gt.cast("long").alias("gt"))
    entry = "struct<k:bigint,score:double>"
    start = F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("p"), F.lit(0.0 if from_empty else -1.0 - margin).alias("score"), F.array().cast(f"array<{entry}>").alias("taken"), F.lit(True).alias("open"))

    def step(state: Column, _: Column) -> Column:
        left = F.filter(F.col("all"), lambda x: ~F.exists(state["taken"], lambda t: t["k"] == x["k"]))
        value = lambda x: ratio(state["i"] + x["i"], state["p"] + x["p"] + F.col("gt") - state["i"] - x["i"])
        best = F.array_min(F.transform(left, lambda x: F.struct((-value(x)).alias("loss"), x["k"].alias("k"), x["i"].alias("i"), x["p"].alias("p"))))
        grows = state["open"] & best.isNotNull() & (-best["loss"] > state["score"] + margin)
        more = F.struct((state["i"] + best["i"]).alias("i"), (state["p"] + best["p"]).alias("p"), (-best["loss"]).alias("score"), F.concat(state["taken"], F.array(F.struct(best["k"].alias("k"), (-best["loss"]).alias("score")))).alias("taken"), F.lit(True).alias("open"))
        return F.when(grows, more).otherwise(F.struct(state["i"].alias("i"), state["p"].alias("p"), state["score"].alias("score"), state["taken"].alias("taken"), F.lit(False).alias("open")))

    taken = row.select(F.posexplode(F.aggregate("all", start, step)["taken"]).alias("rank", "t"))
    return taken.select(F.col("rank").cast("long").alias("rank"), F.col("t.k").alias("k"), F.col("t.score").alias("score"))


def greedy_union_by_frames(dense: DataFrame, margin: float = 1e-12) -> DataFrame:
    """``(rank, k, score)`` for the mean of the frames' IoU: one aggregate over all candidates for each cluster taken.

    ``dense`` is ``(frame, k, inter, pred, gt)`` with a row for each frame and
    cluster; an empty union has an IoU of 0.  Each frame's union and the
    clusters taken are tables; the driver sees the last row of a step, which
    says whether there is another.
    """
    left = materialise(dense.select("frame", "k", "inter", "pred", "gt"), "union-dense")
    base = left.groupBy("frame").agg(F.lit(0).cast("long").alias("ci"), F.lit(0).cast("long").alias("cp"))
    taken = left.select(F.lit(0).cast("long").alias("rank"), F.col("k").cast("long").alias("k"), F.lit(0.0).alias("score")).limit(0)
    rank, score = 0, -1.0 - margin
    while True:
        i, p = F.col("inter") + F.col("ci"), F.col("pred") + F.col("cp")
        tries = left.join(base, "frame").groupBy("k").agg(F.avg(ratio(i, p + F.col("gt") - i)).alias("score"))
        best = tries.orderBy(F.round("score", 12).desc(), "k").limit(1).where(F.col("score") > score + margin)
        more = materialise(taken.union(best.select(F.lit(rank).cast("long"), F.col("k").cast("long"), "score")), "union-taken")
        top = more.where(F.col("rank") == rank).first()
        if top is None:
            return taken
        taken, rank, score = more, rank + 1, top["score"]
        won = left.where(F.col("k") == top["k"]).select("frame", F.col("inter").alias("wi"), F.col("pred").alias("wp"))
        base = materialise(base.join(won, "frame").select("frame", (F.col("ci") + F.col("wi")).alias("ci"), (F.col("cp") + F.col("wp")).alias("cp")), "union-frames")
        left = left.where(F.col("k") != top["k"])
