"""Clusters by a hierarchy of densities: core distances, a spanning forest, a condensed tree."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.operators.components import _flattened
from gneiss.storage import materialise

#: Rows of a shelf, the part of the tree of blocks that points of other shelves are sent to.
SHELF = 16384

#: Neighbours that a point lists for the spanning forest, at least.
LISTED = 16


def _dealt(points: DataFrame, block_rows: int) -> DataFrame:
    """``(id, vec, block, shelf)``: blocks are the leaves of a tree of cuts, shelves parts of it.

    A part with too many rows is cut across its widest coordinates, up to three
    at a time, each about its median; points in one place go by their ids.
    """
    points = materialise(points.select("id", F.transform("vec", lambda v: v.cast("double")).alias("vec")), "hier-points")
    width = points.agg(F.max(F.size("vec"))).first()[0] or 1
    dealt = points.select("id", "vec", F.lit(1).cast("long").alias("block"), F.lit(None).cast("long").alias("shelf"))
    x = [F.get("vec", F.lit(i)) for i in range(width)]
    cuts = F.when(F.col("n") > 4 * block_rows, 3).when(F.col("n") > 2 * block_rows, 2).otherwise(1)
    for _ in range(20):
        sides = F.array(*(F.struct((F.max(c) - F.min(c)).alias("span"), F.lit(i).alias("axis"), F.percentile_approx(c, 0.5, 1000).alias("cut"), F.min(c).alias("low")) for i, c in enumerate(x)))
        per = dealt.groupBy(F.col("block").alias("of")).agg(F.count("*").alias("n"), sides.alias("sides"))
        per = materialise(per.select("of", "n", F.slice(F.sort_array(F.filter("sides", lambda s: s["span"] > 0), asc=False), 1, cuts).alias("sides")), "hier-cuts")
        most = per.agg(F.max("n")).first()[0] or 0
        right = lambda s: F.when(s["cut"] > s["low"], F.get("vec", s["axis"]) >= s["cut"]).otherwise(F.get("vec", s["axis"]) > s["cut"])
        child = F.when(F.size("sides") > 0, F.aggregate("sides", F.lit(0).cast("long"), lambda n, s: n * 2 + right(s).cast("long"))).otherwise(F.pmod(F.xxhash64("id", "block"), F.lit(8)))
        shelf = F.coalesce("shelf", F.when(F.col("n") <= max(SHELF, block_rows), F.col("block")))
        joined = dealt.join(per, F.col("block") == F.col("of"))
        dealt = materialise(joined.select("id", "vec", F.when(F.col("n") > block_rows, F.col("block") * 8 + child).otherwise(F.col("block")).alias("block"), shelf.alias("shelf")), "hier-blocks")
        if most <= block_rows:
            break
    return materialise(dealt.withColumn("shelf", F.coalesce("shelf", "block")), "hier-blocks")


_PARTS = {"ids": np.int64, "vecs": float, "ats": float, "groups": np.int64, "bounds": float}
_BLOCK = pa.schema(
    [("block", pa.int64()), ("shelf", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("only", pa.int64()), ("reach", pa.float64()), *((c, pa.binary()) for c in _PARTS)]
)
_BLOCK_DDL = "block long, shelf long, low array<double>, high array<double>, only long, reach double, ids binary, vecs binary, ats binary, groups binary, bounds binary"


def _blocks_of(table: pa.Table) -> list[dict]:
    """The blocks of a shelf's rows ``(id, vec, block, shelf, at, group, bound)``, each with the box around it.

    ``at`` is a number a point (its core distance), ``group`` its component or
    label, ``bound`` how far it looks for others (below 0: not at all).
    """
    if not table.num_rows:
        return []
    column = lambda c, kind: table.column(c).to_numpy().astype(kind)
    block = column("block", np.int64)
    vecs = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(block), -1)
    columns = {"ids": column("id", np.int64), "vecs": vecs, "ats": column("at", float), "groups": column("group", np.int64), "bounds": column("bound", float)}
    order = np.lexsort((columns["ids"], block))
    out = []
    for rows in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
        b = {c: v[rows] for c, v in columns.items()}
        alone = (b["groups"] == b["groups"][0]).all()
        out.append(b | {"block": int(block[rows[0]]), "shelf": table.column("shelf")[0].as_py(), "low": b["vecs"].min(axis=0), "high": b["vecs"].max(axis=0), "only": int(b["groups"][0]) if alone else None})
    return out


def _written_blocks(blocks: list[dict]) -> pa.Table:
    rows = [b | {"low": b["low"].tolist(), "high": b["high"].tolist(), "reach": float(b["bounds"].max())} | {c: np.ascontiguousarray(b[c]).tobytes() for c in _PARTS} for b in blocks]
    return pa.Table.from_pylist([{c: r[c] for c in _BLOCK.names} for r in rows], schema=_BLOCK)


def _read_block(row: dict) -> dict:
    b = {c: np.frombuffer(row[c], kind) for c, kind in _PARTS.items() if row.get(c) is not None}
    return row | b | {"vecs": b["vecs"].reshape(len(b["ids"]), -1)} | {c: np.array(row[c]) for c in ("low", "high") if row.get(c) is not None}


def _off_box(vecs: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of rows from a box."""
    off = np.maximum(np.maximum(low - vecs, vecs - high), 0.0)
    return (off * off).sum(axis=1)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return np.sqrt((gap * gap).sum(axis=1))


def _close(vecs: np.ndarray, bounds: np.ndarray, block: dict):
    """``(i, j)``, some rows of vecs at a time: all pairs with rows of a block within the first one's bound, and few others.

    One product of matrices gives d^2 - bound^2 up to its rounding, which is
    allowed for; what is found is measured anew by the caller.
    """
    low, high, to = block["low"], block["high"], block["vecs"]
    rows = np.flatnonzero((bounds >= 0) & (_off_box(vecs, low, high) <= np.square(bounds) * (1 + 1e-9)))
    b = to - (low + high) / 2
    bb = (b * b).sum(axis=1)
    right = np.column_stack([b, np.ones(len(b)), bb]).T
    step = max(2**22 // max(len(b), 1), 1)
    for part in (rows[k : k + step] for k in range(0, len(rows), step)):
        a = vecs[part] - (low + high) / 2
        aa = (a * a).sum(axis=1)
        size = aa.max() + bb.max()
        far = np.minimum(np.square(bounds[part]), 4 * size + 1)
        found = np.column_stack([-2 * a, aa - far, np.ones(len(a))]) @ right <= 1e-15 * (a.shape[1] + 10) * (size + far.max())
        i, j = np.divmod(np.flatnonzero(found.ravel()), len(b))
        yield part[i], j


def _begun(a: dict, block: dict, k: int) -> None:
    """Bounds for rows without any: a little above the distance of the (k + 1)-th row of a block, which has more than k."""
    rows = np.flatnonzero(a["bounds"] == np.inf)
    b = block["vecs"] - block["low"]
    bb = (b * b).sum(axis=1)
    step = max(2**20 // len(b), 1)
    for part in (rows[at : at + step] for at in range(0, len(rows), step)):
        x = a["vecs"][part] - block["low"]
        xx = (x * x).sum(axis=1)
        d = np.partition(xx[:, None] + bb - 2 * x @ b.T, k, axis=1)[:, k]
        a["bounds"][part] = np.sqrt(np.maximum(d, 0.0) + 1e-15 * (x.shape[1] + 10) * (xx + bb.max())) * (1 + 1e-9)


def _nearer(a: dict, block: dict, gaps: np.ndarray, ids: np.ndarray) -> None:
    """Takes the rows of a block into the lists of nearest ones, by distance and id; ``bounds`` of a are what lists end with."""
    k = gaps.shape[1]
    if len(block["ids"]) > k and a["bounds"].max() == np.inf:
        _begun(a, block, k)
    for i, j in _close(a["vecs"], a["bounds"], block):
        other = a["ids"][i] != block["ids"][j]
        i, j = i[other], j[other]
        d = _exact(a["vecs"][i], block["vecs"][j])
        within = d <= a["bounds"][i]
        i, j, d = i[within], j[within], d[within]
        if not len(i):
            continue
        rows = np.unique(i)
        of = np.concatenate([np.repeat(rows, k), i])
        gap, by = np.concatenate([gaps[rows].ravel(), d]), np.concatenate([ids[rows].ravel(), block["ids"][j]])
        order = np.lexsort((by, gap, of))
        of = of[order]
        first = np.searchsorted(of, rows)
        keep = order[(np.arange(len(of)) - first[np.searchsorted(rows, of)]) < k]
        gaps[rows], ids[rows] = gap[keep].reshape(-1, k), by[keep].reshape(-1, k)
        a["bounds"][rows] = np.minimum(a["bounds"][rows], gaps[rows, -1])


def _listed(ids: np.ndarray, gaps: np.ndarray, by: np.ndarray) -> pa.Table:
    """``(id, near)`` of lists that may end early."""
    kept = np.isfinite(gaps)
    near = pa.StructArray.from_arrays([pa.array(gaps[kept]), pa.array(by[kept])], ["gap", "to"])
    ends = np.concatenate([[0], np.cumsum(kept.sum(axis=1))]).astype(np.int32)
    return pa.table({"id": pa.array(ids), "near": pa.ListArray.from_arrays(pa.array(ends), near)})


def _box(vecs: np.ndarray) -> dict:
    return {"low": vecs.min(axis=0), "high": vecs.max(axis=0)}


def _by_distance(a: dict, blocks: list[dict]):
    """Blocks by the distance of their boxes from that around a's rows, as far as its ``bounds``, which may fall meanwhile, reach."""
    if not blocks:
        return
    box = a if "low" in a else _box(a["vecs"])
    off = np.maximum(np.maximum(np.array([b["low"] for b in blocks]) - box["high"], box["low"] - np.array([b["high"] for b in blocks])), 0.0)
    off = (off * off).sum(axis=1)
    for n in sorted(range(len(blocks)), key=lambda n: (blocks[n]["ids"] is not a["ids"], off[n])):
        if off[n] > np.square(a["bounds"].max()) * (1 + 1e-9):
            break
        yield blocks[n]


def _sent(packed: DataFrame, across: bool) -> DataFrame:
    """``(shelf, queries)``: the rows of blocks that look as far as a block of another shelf, for that shelf.

    With ``across``, blocks that hold one group alone are not looked into by rows of that group.
    """
    apart = lambda p, q, r, s: F.sqrt(F.aggregate(F.zip_with(F.zip_with(p, s, lambda x, y: x - y), F.zip_with(r, q, lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))), F.lit(0.0), lambda n, v: n + v * v))
    boxes = packed.select(F.col("shelf").alias("to"), F.col("low").alias("l"), F.col("high").alias("h"), "only")
    least = lambda c, f: F.array(*(f(F.get(c, F.lit(i))) for i in range(width)))
    width = packed.select(F.size("low")).first()
    width = width[0] if width else 1
    shelves = boxes.groupBy("to").agg(least("l", F.min).alias("low_b"), least("h", F.max).alias("high_b"), F.collect_list(F.struct("l", "h", "only")).alias("boxes"))
    from_ = packed.where("reach >= 0").select("block", F.col("shelf").alias("own"), F.col("low").alias("low_a"), F.col("high").alias("high_a"), "reach")
    pairs = from_.crossJoin(shelves).where("own <> to").where(apart("low_a", "high_a", "low_b", "high_b") <= F.col("reach") * (1 + 1e-9))
    seen = pairs.groupBy(F.col("block").alias("of")).agg(F.collect_list(F.struct("to", "boxes")).alias("seen"))

    def rows(batches):
        for batch in batches:
            for row in batch.to_pylist():
                a, out = _read_block(row), []
                far = np.square(a["bounds"]) * (1 + 1e-9)
                for to in row["seen"]:
                    looks = np.zeros(len(far), bool)
                    for box in to["boxes"]:
                        looks |= (_off_box(a["vecs"], np.array(box["l"]), np.array(box["h"])) <= far) & (a["groups"] != box["only"] if across and box["only"] is not None else True)
                    looks &= a["bounds"] >= 0
                    if looks.any():
                        out.append({"shelf": to["to"]} | {c: np.ascontiguousarray(a[c][looks]).tobytes() for c in _PARTS})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("shelf", pa.int64()), *((c, pa.binary()) for c in _PARTS)]))

    joined = packed.join(seen, F.col("block") == F.col("of")).select(*_PARTS, "seen")
    return materialise(joined.mapInArrow(rows, "shelf long, ids binary, vecs binary, ats binary, groups binary, bounds binary"), "hier-sent")


def _met(packed: DataFrame, across: bool = False) -> DataFrame:
    """What ``_sent`` gives, each row beside the blocks of its shelf."""
    shelves = packed.groupBy("shelf").agg(F.collect_list(F.struct("low", "high", "only", "ids", "vecs", "ats", "groups")).alias("blocks"))
    return _sent(packed, across).join(materialise(shelves, "hier-shelves"), "shelf")


def _rows(work):
    """A function of batches from one of (rows sent, blocks) that gives a table."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                a = _read_block(row)
                a["bounds"] = a["bounds"].copy()
                yield from work(a, [_read_block(b) for b in row["blocks"]]).to_batches()

    return run


_NEAR_DDL = "id long, near array<struct<gap: double, to: long>>"


def nearest_lists(dealt: DataFrame, k: int) -> DataFrame:
    """``(id, near)``: the k nearest other points of each, all where there are fewer, as (gap, to) in that order.

    Points meet those of their own shelf first, block by block.  What that
    leaves open goes, point by point, to the shelves that hold a block no
    farther than its kth distance so far.
    """

    def own(table: pa.Table) -> pa.Table:
        blocks, out, lists = _blocks_of(table), [], []
        for a in blocks:
            a = a | {"bounds": a["bounds"].copy()}
            gaps, ids = np.full((len(a["ids"]), k), np.inf), np.full((len(a["ids"]), k), -1)
            for b in _by_distance(a, blocks):
                _nearer(a, b, gaps, ids)
            a["bounds"] = np.where(np.isfinite(gaps[:, -1]), gaps[:, -1], np.inf)
            out.append(a)
            lists.append((gaps, ids))
        table = _written_blocks(out)
        for name, n in (("gaps", 0), ("tos", 1)):
            table = table.append_column(name, pa.array([np.ascontiguousarray(x[n]).tobytes() for x in lists], pa.binary()))
        return table

    points = dealt.select("id", "vec", "block", "shelf", F.lit(0.0).alias("at"), F.lit(0).cast("long").alias("group"), F.lit(float("inf")).alias("bound"))
    packed = materialise(points.groupBy("shelf").applyInArrow(own, f"{_BLOCK_DDL}, gaps binary, tos binary"), "hier-packed")

    def unpacked(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                yield from _listed(ids, np.frombuffer(row["gaps"], float).reshape(-1, k), np.frombuffer(row["tos"], np.int64).reshape(-1, k)).to_batches()

    def other(a: dict, blocks: list[dict]) -> pa.Table:
        gaps, ids = np.full((len(a["ids"]), k), np.inf), np.full((len(a["ids"]), k), -1)
        for b in _by_distance(a, blocks):
            _nearer(a, b, gaps, ids)
        some = np.isfinite(gaps[:, 0])
        return _listed(a["ids"][some], gaps[some], ids[some])

    inside = packed.select("ids", "gaps", "tos").mapInArrow(unpacked, _NEAR_DDL)
    outside = _met(packed.drop("gaps", "tos")).mapInArrow(_rows(other), _NEAR_DDL)
    every = inside.union(outside).groupBy("id").agg(F.flatten(F.collect_list("near")).alias("near"))
    return every.select("id", F.slice(F.sort_array("near"), 1, k).alias("near"))


def core_distances(dealt: DataFrame, least: int) -> DataFrame:
    """``(id, core)``: the distance of each point to its ``least``-th nearest other one (infinite where there are fewer)."""
    return nearest_lists(dealt, least).select("id", _core(least))


def _core(least: int) -> Column:
    return F.coalesce(F.get("near", F.lit(least - 1))["gap"], F.lit(float("inf"))).alias("core")


_EDGE = pa.schema([("of", pa.int64()), ("w", pa.float64()), *((c, pa.int64()) for c in ("a", "b", "to"))])
_EDGE_DDL = "of long, w double, a long, b long, to long"


def _outgoing(a: dict, blocks) -> pa.Table:
    """The least edge of each component of rows to another one among blocks, by weight and ids, within the rows' bounds."""
    comps, at = np.unique(a["groups"], return_inverse=True)
    best: dict[int, tuple] = {}
    a["bounds"] = bounds = a["bounds"].copy()
    for block in blocks:
        if block["only"] is not None and (a["groups"] == block["only"]).all():
            continue
        looking = np.where(a["groups"] == block["only"], -np.inf, bounds) if block["only"] is not None else bounds
        for i, j in _close(a["vecs"], looking, block):
            other = a["groups"][i] != block["groups"][j]
            i, j = i[other], j[other]
            w = np.maximum(np.maximum(a["ats"][i], block["ats"][j]), _exact(a["vecs"][i], block["vecs"][j]))
            within = w <= bounds[i]
            i, j, w = i[within], j[within], w[within]
            x, y = a["ids"][i], block["ids"][j]
            low, high = np.minimum(x, y), np.maximum(x, y)
            order = np.lexsort((high, low, w, at[i]))
            first = order[np.flatnonzero(np.diff(at[i][order], prepend=-1))]
            for e in first.tolist():
                c, edge = int(at[i[e]]), (float(w[e]), int(low[e]), int(high[e]), int(block["groups"][j[e]]))
                if c not in best or edge < best[c]:
                    best[c] = edge
            if len(first):
                most = np.full(len(comps), np.inf)
                most[list(best)] = [v[0] for v in best.values()]
                np.minimum(bounds, most[at], out=bounds)
                looking = np.minimum(looking, bounds)
    rows = [(int(comps[c]), *v) for c, v in best.items()]
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _EDGE, strict=True)] if rows else [pa.array([], f.type) for f in _EDGE], schema=_EDGE)


def _least_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("of").agg(F.min(F.struct("w", "a", "b", "to")).alias("e")).select("of", "e.*")


def _searched(points: DataFrame, state: DataFrame, best: DataFrame) -> DataFrame:
    """``(of, w, a, b, to)``: the least edges out of the components ``(of, w, a, b, to)`` of ``best``.

    A point looks as far as its component's least edge so far, among its own
    shelf first, and not at all where all that near is listed (``horizon``).  A
    component that then still knows of none starts from single points of blocks.
    """

    def looking(best: DataFrame) -> DataFrame:
        bound = F.when(F.col("of").isNull() | (F.col("horizon") > F.coalesce("w", F.lit(float("inf")))) | (F.col("horizon") == float("inf")) | (F.col("core") > F.coalesce("w", F.lit(float("inf")))), float("-inf")).otherwise(F.coalesce("w", F.lit(float("inf"))))
        joined = points.join(state, "id").join(best, F.col("comp") == F.col("of"), "left")
        return joined.select("id", "vec", "block", "shelf", F.col("core").alias("at"), F.col("comp").alias("group"), bound.alias("bound"))

    def own(table: pa.Table) -> pa.Table:
        blocks = _blocks_of(table)
        return pa.concat_tables([_EDGE.empty_table(), *(_outgoing(a, _by_distance(a, blocks)) for a in blocks if a["bounds"].max() >= 0)])

    inside = looking(best).groupBy("shelf").applyInArrow(own, _EDGE_DDL)
    known = best.select("of", "w", "a", "b", "to")
    found = materialise(_least_edges(known.where("w IS NOT NULL").union(inside)), "hier-found")
    lost = known.select("of").join(found, "of", "left_anti")
    if not lost.isEmpty():
        rows = points.join(state, "id").select("block", F.struct("comp", "id", "core", "vec").alias("p"))
        ends = rows.groupBy("block").agg(F.array(F.min("p"), F.max("p")).alias("ps")).select(F.explode("ps").alias("p"))
        ends = materialise(ends, "hier-ends")
        gap = F.sqrt(F.aggregate(F.zip_with("p.vec", "q.vec", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda n, v: n + v))
        first = ends.join(lost, F.col("p.comp") == F.col("of")).crossJoin(ends.select(F.col("p").alias("q"))).where("q.comp <> of")
        # A little more than the edge's weight, whose sum may be rounded otherwise: only a bound.
        bound = first.groupBy("of").agg((F.min(F.greatest("p.core", "q.core", gap)) * (1 + 1e-9)).alias("w"))
        none = (F.lit(None).cast("long").alias(c) for c in ("a", "b", "to"))
        found = materialise(found.union(bound.select("of", "w", *none)), "hier-found")
    packed = materialise(looking(found).groupBy("shelf").applyInArrow(lambda table: _written_blocks(_blocks_of(table)), _BLOCK_DDL), "hier-packed")
    outside = _met(packed, True).mapInArrow(_rows(lambda a, blocks: _outgoing(a, _by_distance(a, blocks))), _EDGE_DDL)
    return materialise(_least_edges(found.where("a IS NOT NULL").union(outside)), "hier-found")


def spanning_forest(dealt: DataFrame, cores: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """``(a, b, w)``: the minimum spanning tree of the mutual reachability max(core, core, distance).

    In a round components take their least edges to others, by weight and then
    by ids, and those that these edges join are one in the next.  Edges come
    from the lists of nearest points (``near``).  What a list lacks is no nearer
    than its end, so a component whose least listed edge is shorter than all its
    points' lists has its least edge; the others may wait for those, as every
    edge so taken is one of the tree.  When few have theirs, the rest but the
    largest one are searched for (``_searched``).
    """
    near = materialise(nearest_lists(dealt, LISTED) if near is None else near, "hier-near")
    points = materialise(dealt.join(cores, "id"), "hier-points")
    full = near.agg(F.max(F.size("near"))).first()[0] or 0
    horizon = F.when(F.size("near") < points.count() - 1, F.get("near", F.lit(full - 1))["gap"]).otherwise(float("inf"))
    state = materialise(near.select("id", F.col("id").alias("comp"), horizon.alias("horizon")), "hier-state")
    listed = near.select("id", F.explode("near").alias("n")).select("id", F.col("n.to").alias("to"), "n.gap")
    ends = [points.select(F.col("id").alias(i), F.col("core").alias(f"core_{i}")) for i in ("id", "to")]
    pair = F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b")
    edges = listed.join(ends[0], "id").join(ends[1], "to").select(*pair, F.greatest("core_id", "core_to", "gap").alias("w")).distinct()
    edges = materialise(edges.select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb")), "hier-edges")
    taken = []
    while True:
        sizes = state.groupBy(F.col("comp").alias("c")).agg(F.min("horizon").alias("horizon_c"), F.count("*").alias("n"))
        both = edges.select(F.col("ca").alias("of"), "w", "a", "b", F.col("cb").alias("to")).union(edges.select("cb", "w", "a", "b", "ca"))
        best = sizes.join(_least_edges(both), F.col("c") == F.col("of"), "left")
        settled = F.coalesce((F.col("w") < F.col("horizon_c")) | (F.col("horizon_c") == float("inf")), F.lit(False)) & F.col("w").isNotNull()
        best = materialise(best.select(F.col("c").alias("of"), "w", "a", "b", "to", "n", settled.alias("settled")), "hier-best")
        many, done, largest = best.agg(F.count("*"), F.count_if("settled"), F.max(F.struct("n", "of"))["of"]).first()
        if many < 2:
            break
        chosen = best.where("settled").select("of", "w", "a", "b", "to")
        if done * 4 < many:
            chosen = materialise(chosen, "hier-chosen").union(_searched(points, state, best.where(F.expr("NOT settled") & (F.col("of") != largest)).select("of", "w", "a", "b", "to")))
        chosen = materialise(chosen, "hier-chosen")
        taken.append(chosen.select("a", "b", "w"))
        back = chosen.select(F.col("of").alias("to_of"), F.col("to").alias("back"))
        # Of two that take each other the smaller is a root, as is what takes none.
        root = F.when((F.col("back") == F.col("of")) & (F.col("of") < F.col("to")), F.col("of")).otherwise(F.coalesce("to", "of"))
        hooks = best.select("of").join(chosen.select("of", "to", "w"), "of", "left").join(back, F.col("to") == F.col("to_of"), "left")
        hooks = materialise(hooks.select(F.col("of").alias("node"), root.alias("root"), "w"), "hier-hooks")
        parents = _flattened(hooks.select("node", "root"))
        moved = parents.join(hooks.select(F.col("node").alias("of"), "w"), F.col("node") == F.col("of")).select("node", "root", "w")
        # Nothing outside a component is nearer than the edge that it has taken.
        state = materialise(state.join(moved, F.col("comp") == F.col("node")).select("id", F.col("root").alias("comp"), F.greatest("horizon", F.coalesce("w", "horizon")).alias("horizon")), "hier-state")
        a, b = (parents.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in ("ca", "cb"))
        ends = edges.join(a, "ca").join(b, "cb").where("rca <> rcb").groupBy(F.least("rca", "rcb").alias("ca"), F.greatest("rca", "rcb").alias("cb"))
        edges = materialise(ends.agg(F.min(F.struct("w", "a", "b")).alias("e")).select("e.a", "e.b", "e.w", "ca", "cb"), "hier-edges")
    if not taken:
        return dealt.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("w")).limit(0)
    return reduce(DataFrame.union, taken).distinct()


def condensed_labels(a: np.ndarray, b: np.ndarray, w: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """``(ids, labels)`` of a tree's nodes: -1 is noise, clusters count from 0 by their smallest id.

    Merging by rising weight gives a binary hierarchy.  From its top, a split in
    two parts of at least ``least`` nodes makes two clusters; smaller parts fall
    out of theirs.  A cluster's stability is the sum over its nodes of 1 / w
    when they leave it less 1 / w at its birth; the clusters chosen are those of
    largest stability in all, none inside another, never the whole.
    """
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    n, a, b = len(ids), ends[: len(a)], ends[len(a) :]
    order = np.lexsort((ids[b], ids[a], w))
    root, left, right, size, height = list(range(2 * n - 1)), [0] * (n - 1), [0] * (n - 1), [1] * n + [0] * (n - 1), w[order]

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for k, e in enumerate(order.tolist()):
        left[k], right[k] = top(int(a[e])), top(int(b[e]))
        root[left[k]] = root[right[k]] = n + k
        size[n + k] = size[left[k]] + size[right[k]]

    def leaves(node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            x = stack.pop()
            if x < n:
                out.append(x)
            else:
                stack += (left[x - n], right[x - n])
        return out

    parent, birth, stability, cluster, children = [-1], [0.0], [0.0], np.zeros(n, np.int64), [[]]
    stack = [(2 * n - 2, 0)]
    while stack:
        node, c = stack.pop()
        if node < n:
            continue
        rate = 1 / height[node - n] if height[node - n] > 0 else np.inf
        parts = (left[node - n], right[node - n])
        large = [x for x in parts if size[x] >= least]
        gain = rate - birth[c] if rate > birth[c] else 0.0
        for x in parts:
            if len(large) == 2:  # a split: both are clusters of their own
                stability[c] += gain * size[x]
                parent.append(c)
                birth.append(rate)
                stability.append(0.0)
                children.append([])
                children[c].append(len(parent) - 1)
                stack.append((x, len(parent) - 1))
            elif x in large:
                stack.append((x, c))
            else:
                stability[c] += gain * size[x]
                cluster[leaves(x)] = c
    chosen = [False] * len(parent)
    for c in range(len(parent) - 1, 0, -1):
        below = sum(stability[k] for k in children[c])
        chosen[c] = not children[c] or stability[c] >= below
        stability[c] = max(stability[c], below)
    label = [-1] * len(parent)  # the outermost chosen cluster around each
    for c in range(1, len(parent)):
        outer = label[parent[c]]
        label[c] = outer if outer >= 0 else c if chosen[c] else -1
    found = np.array([label[c] for c in cluster])
    names = {c: k for k, c in enumerate(dict.fromkeys(found[found >= 0].tolist()))}
    return ids, np.array([names.get(c, -1) for c in found.tolist()], np.int64)


def _nearest_named(dealt: DataFrame, labels: DataFrame) -> DataFrame:
    """``(id, label)`` of the points labelled -1: the label of the nearest other point that has one, ties to the smallest id."""
    if labels.where("label >= 0").isEmpty():
        return labels.select("id", "label").limit(0)

    def named(block: dict) -> dict | None:
        some = block["groups"] >= 0
        vecs = block["vecs"][some]
        return {"ids": block["ids"][some], "vecs": vecs, "low": vecs.min(axis=0), "high": vecs.max(axis=0)} if some.any() else None

    def nearest(a: dict, blocks: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        gaps, by = np.full((len(a["ids"]), 1), np.inf), np.full((len(a["ids"]), 1), -1)
        for b in _by_distance(a, [x for x in map(named, blocks) if x]):
            _nearer(a, b, gaps, by)
        return gaps, by

    def own(table: pa.Table) -> pa.Table:
        blocks, out, found = _blocks_of(table), [], []
        for a in blocks:
            a = a | {"bounds": a["bounds"].copy()}
            found.append(nearest(a, blocks))
            out.append(a)
        table = _written_blocks(out)
        for name, n in (("gaps", 0), ("tos", 1)):
            table = table.append_column(name, pa.array([x[n].tobytes() for x in found], pa.binary()))
        return table

    bound = F.when(F.col("label") < 0, float("inf")).otherwise(float("-inf"))
    points = dealt.join(labels.select("id", F.col("label").alias("group"), bound.alias("bound")), "id").withColumn("at", F.lit(0.0))
    packed = materialise(points.groupBy("shelf").applyInArrow(own, f"{_BLOCK_DDL}, gaps binary, tos binary"), "hier-packed")
    looking = packed.drop("gaps", "tos")
    if not packed.where("reach = double('inf')").isEmpty():
        # Shelves without any label: one such point of each block bounds how far their blocks look.
        some = materialise(points.where("group >= 0").groupBy("block").agg(F.min(F.struct("id", "vec"))["vec"].alias("some")).select("some"), "hier-some")
        far = lambda low, high, x: F.sqrt(F.aggregate(F.zip_with(F.zip_with(x, low, lambda p, q: F.abs(p - q)), F.zip_with(high, x, lambda p, q: F.abs(p - q)), lambda p, q: F.greatest(p, q)), F.lit(0.0), lambda n, v: n + v * v))
        most = packed.where("reach = double('inf')").select("block", "low", "high").crossJoin(some).groupBy(F.col("block").alias("of")).agg((F.min(far("low", "high", "some")) * (1 + 1e-9)).alias("most"))

        def bounded(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    b = _read_block(row)
                    if row["most"] is not None:
                        b["bounds"] = np.minimum(b["bounds"], row["most"])
                    yield from _written_blocks([b]).to_batches()

        looking = materialise(looking.join(most, F.col("block") == F.col("of"), "left").drop("of").mapInArrow(bounded, _BLOCK_DDL), "hier-packed")

    def unpacked(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from _listed(*(np.frombuffer(row[c], kind).reshape(shape) for c, kind, shape in (("ids", np.int64, -1), ("gaps", float, (-1, 1)), ("tos", np.int64, (-1, 1))))).to_batches()

    def other(a: dict, blocks: list[dict]) -> pa.Table:
        return _listed(a["ids"], *nearest(a, blocks))

    found = packed.select("ids", "gaps", "tos").mapInArrow(unpacked, _NEAR_DDL).union(_met(looking, True).mapInArrow(_rows(other), _NEAR_DDL))
    best = found.select("id", F.explode("near").alias("n")).groupBy("id").agg(F.min("n")["to"].alias("to"))
    return best.join(labels.select(F.col("id").alias("to"), "label"), "to").select("id", "label")


def density_hierarchy(points: DataFrame, least_size: int, least_samples: int = 5, block_rows: int = 2048, most_edges: int = 20_000_000) -> DataFrame:
    """``(id, cluster, noise)`` of ``(id, vec)``: clusters from 0, by their smallest point.

    Lists of nearest points and the spanning tree of mutual reachability are found
    between blocks of points that are near enough (``nearest_lists``,
    ``spanning_forest``); ``condensed_labels`` reads clusters of at least
    ``least_size`` points off the tree, whose edges, three numbers a point,
    are one group: beyond ``most_edges`` it raises.  Points that are noise get
    the cluster of the nearest point with one; where all are noise there is one
    cluster, 0.  Points with a null id or a null or empty vector take no part;
    vectors have one length, and ids are distinct.
    """
    points = points.where("id IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0").select(F.col("id").cast("long").alias("id"), "vec")
    dealt = _dealt(points, block_rows)
    near = materialise(nearest_lists(dealt, max(least_samples, LISTED)), "hier-near")
    edges = materialise(spanning_forest(dealt, near.select("id", _core(least_samples)), near), "hier-forest")
    if edges.count() > most_edges:
        raise ValueError(f"more than {most_edges:,} edges in one tree")

    def condense(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, labels = condensed_labels(pdf["a"].to_numpy(), pdf["b"].to_numpy(), pdf["w"].to_numpy(), least_size)
        return pd.DataFrame({"id": ids, "label": labels})

    found = edges.groupBy().applyInPandas(condense, "id long, label long")
    labels = materialise(dealt.select("id").join(found, "id", "left").select("id", F.coalesce("label", F.lit(-1)).cast("long").alias("label")), "hier-labels")
    near = _nearest_named(dealt, labels).withColumnRenamed("label", "near")
    return labels.join(near, "id", "left").select("id", F.when(F.col("label") >= 0, F.col("label")).otherwise(F.coalesce("near", F.lit(0))).alias("cluster"), (F.col("label") < 0).alias("noise"))
