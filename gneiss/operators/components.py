"""Connected components by hooking roots onto smaller roots, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.storage import materialise


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node of an undirected edge list.

    The component is the smallest node id in it.  Nodes of a component that is
    still growing are merged into one: each node hooks onto a neighbour, its
    smallest in one round and its smallest by a hash of the round in the next,
    where that is smaller than itself; the trees so formed are flattened by
    doubling, and edges are rewritten between their roots.  Under the hash a
    root is, but for one case in three, not the least of itself and its
    neighbours, so at least a constant share of the roots that still have edges
    goes in every second round: the rounds are logarithmic in the nodes
    whatever the diameter, and edges shrink with the roots.  Every table is
    written to the shared folder: no lineage grows, and both sides of each join
    are scans, so a node with a large share of the edges is split by adaptive
    execution.  Null ends are ignored; self loops keep a node in the result
    with its own id; an empty input gives an empty result.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    both = materialise(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    nodes = both.select(F.col("a").alias("node")).distinct()
    live = both.where("a <> b")
    maps, turn = [], 0
    while not live.isEmpty():
        parents = _flattened(_hooked(live, turn))
        maps.append(parents)
        a, b = (parents.select(F.col("node").alias(c), F.col("root").alias(f"r_{c}")) for c in ("a", "b"))
        live = live.join(a, "a").join(b, "b").select(F.col("r_a").alias("a"), F.col("r_b").alias("b")).where("a <> b").distinct()
        live, turn = materialise(live, "cc-edges"), turn + 1
    if not maps:
        return nodes.select("node", F.col("node").alias("component"))
    # From the last roots back to the nodes, then the smallest node of each root.
    reached = maps.pop()
    while maps:
        last = reached.select(F.col("node").alias("at"), F.col("root").alias("top"))
        reached = materialise(maps.pop().join(last, F.col("root") == F.col("at"), "left").select("node", F.coalesce("top", "root").alias("root")), "cc-roots")
    least = reached.groupBy(F.col("root").alias("of")).agg(F.min("node").alias("component"))
    placed = reached.join(least, F.col("root") == F.col("of")).select(F.col("node").alias("at"), "component")
    return materialise(nodes.join(placed, F.col("node") == F.col("at"), "left").select("node", F.coalesce("component", "node").alias("component")), "cc-labels")


def _hooked(live: DataFrame, turn: int) -> DataFrame:
    """``(node, root)``: each node under its least neighbour, or under itself where it is less."""
    order = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("id")) if turn % 2 else F.struct(F.lit(0).alias("h"), F.col(c).alias("id"))
    return live.groupBy(F.col("a").alias("node")).agg(F.min(order("b")).alias("low")).select("node", F.least(order("node"), F.col("low"))["id"].alias("root"))


def _flattened(parents: DataFrame) -> DataFrame:
    """Trees made flat: every node under its root, by doubling."""
    parents = materialise(parents, "cc-roots")
    while True:
        up = parents.select(F.col("node").alias("at"), F.col("root").alias("top"))
        step = materialise(parents.join(up, F.col("root") == F.col("at")).select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), "cc-roots")
        parents = step.select("node", "root")
        if step.where("moved").isEmpty():
            return parents
