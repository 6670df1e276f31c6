"""Spelling variants by finite-state composition: acceptor, one-edit transducer, acceptor."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.storage import materialise

_UPPER = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
_NEAR = pa.schema([("word", pa.string()), ("links", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def letter_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int = 31, shortest: int = 7) -> DataFrame:
    """``(word)``: each run of ``[A-Za-z\\u00C0-\\u00FF]`` of at least ``shortest`` code points, A-Z lower-cased.

    Where ``slip`` divides h, the crc32 of ``<id>:<run>``, the run's code point
    h modulo its length is deleted (and the result goes if that makes it too
    short).  Null texts have no runs; a null id counts as an empty one.
    """
    runs = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(f"[A-Za-zÀ-ÿ]{{{shortest},}}"), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", _UPPER, _UPPER.lower()).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % slip == 0, shorter).otherwise(F.col("run")).alias("word")).where(F.length("word") >= shortest)


def vocabulary(words: DataFrame, least: int = 2) -> DataFrame:
    """``(word, n)`` of the words that occur at least ``least`` times."""
    return words.where("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _partitions(rows: DataFrame, splits: Column) -> DataFrame:
    """Rows ``(word, n, m, a, b, key)``, one for each ``(m, a, b)`` of an array of structs."""
    split = rows.select("word", "n", F.explode(splits).alias("s")).select("word", "n", "s.*")
    shared = "concat(m, ':', a, ':', b, ':', substring(word, 1, a), ':', right(word, greatest(m - b, 0)))"
    return split.withColumn("key", F.expr(shared))


def _cuts(*cuts: tuple[str, str, str]) -> Column:
    """An array of structs ``(m, a, b)`` from SQL expressions of whole numbers."""
    return F.array(*(F.struct(*(F.expr(f"int({e})").alias(c) for c, e in zip("mab", cut, strict=True))) for cut in cuts))


def keyed(words: DataFrame, most: int) -> DataFrame:
    """Each word once for every partition of pairs that it may be in.

    A pair is of the class m of its shorter word's length, and the length p of
    its common beginning says where its edit is.  A partition ``(m, a, b)`` with
    a beginning and an end holds the pairs with p in [a, b): its words share
    their first a and last m - b letters.  [0, m] is cut in two; partitions of
    more than ``most`` words are cut in two again, down to one place, where the
    words differ in two letters at most: no more than the square of the
    alphabet's 90 letters, however large the vocabulary.
    """
    rows = materialise(
        _partitions(
            words.withColumn("l", F.length("word")),
            _cuts(("l", "0", "(l + 1) div 2"), ("l", "(l + 1) div 2", "l + 1"), ("l - 1", "0", "l div 2"), ("l - 1", "l div 2", "l")),
        ),
        "variant-keys",
    )
    while True:
        large = rows.where("b - a > 1").groupBy(F.xxhash64("key").alias("h")).agg(F.count("*").alias("c")).where(F.col("c") > most).select("h")
        large = materialise(large, "variant-large")
        if large.isEmpty():
            return rows
        hashed = rows.withColumn("h", F.xxhash64("key"))
        # Of the partitions with a large hash, those of a single place stay as they are.
        whole = hashed.join(large, "h", "left_anti").union(hashed.where("b - a <= 1").join(large, "h", "left_semi")).select(rows.columns)
        halves = _cuts(("m", "a", "(a + b) div 2"), ("m", "(a + b) div 2", "b"))
        cut = hashed.where("b - a > 1").join(large, "h", "left_semi").select("word", "n", halves.alias("s"))
        rows = materialise(whole.union(_partitions(cut, F.col("s"))), "variant-keys")


class Acceptor:
    """The minimal acceptor of some sequences of small integers, with a count of what
    each state accepts, so that a path gives its sequence's place in their order.

    ``rows`` is a matrix in lexicographic order, no two alike, of which row i has
    ``lengths[i]`` symbols from 1 on.
    """

    def __init__(self, rows: np.ndarray, lengths: np.ndarray):
        n, width = rows.shape
        self.symbols = int(rows.max(initial=0)) + 1
        # The trie: a row opens a node at each depth beyond what it shares with the row before.
        shared = np.zeros(n, np.int64)
        if n > 1:
            differ = rows[1:] != rows[:-1]
            shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        node, total, parents, symbols, children, depth_of = np.zeros(n, np.int64), 1, [], [], [], []
        ends = np.where(lengths == 0, 0, -1)
        for depth in range(1, width + 1):
            fresh = (lengths >= depth) & (shared < depth)
            number = total + np.cumsum(fresh) - 1
            parents.append(node[fresh])
            symbols.append(rows[fresh, depth - 1])
            children.append(number[fresh])
            depth_of.append(np.full(int(fresh.sum()), depth))
            node = np.where(lengths >= depth, number, node)
            ends = np.where(lengths == depth, node, ends)
            total += int(fresh.sum())
        parent, symbol, child, depth = (np.concatenate(x) for x in (parents, symbols, children, depth_of))
        final = np.zeros(total, bool)
        final[ends] = True
        height = np.zeros(total, np.int64)
        for d in range(width, 0, -1):
            at = depth == d
            np.maximum.at(height, parent[at], height[child[at]] + 1)
        # States of one height are equal when their final flags and arcs are: a chain of
        # pairs (what came before, arc) is numbered arc by arc.
        order = np.lexsort((symbol, parent))
        parent, symbol, child = parent[order], symbol[order], child[order]
        first, arcs = np.searchsorted(parent, np.arange(total)), np.bincount(parent, minlength=total)
        state, states = np.full(total, -1, np.int64), 0
        keep = []
        for h in range(int(height.max(initial=0)) + 1):
            nodes = np.flatnonzero(height == h)
            if not len(nodes):
                continue
            code = final[nodes].astype(np.int64)
            for k in range(int(arcs[nodes].max(initial=0)) if nodes[0] else 0):  # the root, node 0, is alone at its height
                have = np.flatnonzero(arcs[nodes] > k)
                arc = first[nodes[have]] + k
                packed = (code[have] * self.symbols + symbol[arc]) * (states + 1) + state[child[arc]]
                code[have] = np.unique(packed, return_inverse=True)[1] + 2 + k * (total + 1)
            _, single, inverse = np.unique(code, return_index=True, return_inverse=True)
            state[nodes] = states + inverse
            keep.append(nodes[single])
            states += len(single)
        kept = np.concatenate(keep)
        self.final = final[kept]
        counts = arcs[kept]
        self.first = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat(first[kept] - self.first[:-1], counts) + np.arange(self.first[-1])
        self.symbol, self.to = symbol[at], state[child[at]]
        self.root = int(state[0])
        # States are numbered by height, so those that arcs lead to are counted before.
        accepted = self.final.astype(np.int64)
        self.skip = np.zeros(len(self.to), np.int64)
        for s in range(states):
            a, b = self.first[s], self.first[s + 1]
            below = accepted[self.to[a:b]]
            self.skip[a:b] = accepted[s] + np.cumsum(below) - below
            accepted[s] += below.sum()
        self._keys = np.repeat(np.arange(states), counts) * self.symbols + self.symbol

    def arcs(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every arc that leaves one of the states: which of them, and the arc."""
        counts = self.first[states + 1] - self.first[states]
        source = np.repeat(np.arange(len(states)), counts)
        return source, np.arange(len(source)) - np.repeat(np.cumsum(counts) - counts, counts) + self.first[states][source]

    def follow(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The arc of each state with a symbol, or -1."""
        wanted = states * self.symbols + symbols
        at = np.minimum(np.searchsorted(self._keys, wanted), max(len(self._keys) - 1, 0))
        return np.where(self._keys[at] == wanted, at, -1) if len(self._keys) else np.full(len(wanted), -1)


def composed_pairs(acceptor: Acceptor, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places ``(left, right)`` of the sequences that differ by one edit, each pair once.

    The arcs of the acceptor's initial state are partitions: their symbol is not
    edited, and partition i is edited only behind fewer than ``reach[i]`` symbols.
    The composed machine is run breadth first.  Before the edit both sides are in
    one state; the edit replaces a symbol or deletes one on the left; behind it
    both sides read the same symbols.  A deletion is only taken at the end of
    the common beginning: what follows on the right is another symbol.
    """
    start = np.arange(acceptor.first[acceptor.root], acceptor.first[acceptor.root + 1])
    before = [acceptor.to[start], acceptor.skip[start], np.arange(len(start))]
    after = [np.zeros(0, np.int64) for _ in range(5)]
    found, depth = [], 0
    while len(before[0]) or len(after[0]):
        p, q, i, j, banned = after
        ended = acceptor.final[p] & acceptor.final[q] if len(p) else np.zeros(0, bool)
        found.append((i[ended], j[ended]))
        source, arc = acceptor.arcs(p)
        other = acceptor.follow(q[source], acceptor.symbol[arc])
        same = (other >= 0) & (acceptor.symbol[arc] != banned[source])
        source, arc, other = source[same], arc[same], other[same]
        after = [acceptor.to[arc], acceptor.to[other], i[source] + acceptor.skip[arc], j[source] + acceptor.skip[other], np.zeros(len(arc), np.int64)]
        state, at, part = before
        editable = depth < reach[part]
        state, at, part = state[editable], at[editable], part[editable]
        source, arc = acceptor.arcs(state)
        new = [[acceptor.to[arc], state[source], at[source] + acceptor.skip[arc], at[source], acceptor.symbol[arc]]]
        for gap in range(1, int(np.bincount(source).max(initial=0))):
            left = np.flatnonzero(source[gap:] == source[:-gap])
            x, y = arc[left], arc[left + gap]
            new.append([acceptor.to[x], acceptor.to[y], at[source[left]] + acceptor.skip[x], at[source[left]] + acceptor.skip[y], np.zeros(len(left), np.int64)])
        after = [np.concatenate([after[c], *(e[c] for e in new)]) for c in range(5)]
        before = [acceptor.to[arc], at[source] + acceptor.skip[arc], part[source]]
        depth += 1
    return tuple(np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in (0, 1))


def near_in(table: pa.Table) -> pa.Table:
    """``(word, links, best_n, best)`` of the words of some partitions: near words there, and the most frequent."""
    table = table.combine_chunks()
    words = table.column("word").combine_chunks()
    n, m, a, b = (table.column(c).to_numpy() for c in ("n", "m", "a", "b"))
    lengths = pc.utf8_length(words).to_numpy().astype(np.int64)
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    part = np.unique(table.column("key").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)[1]
    # What a partition's words do not share, behind the partition's own symbol.
    inner = lengths - np.maximum(m - b, 0) - a
    column = np.arange(int(inner.max(initial=0)))
    inside = column < inner[:, None]
    _, symbols = np.unique(points, return_inverse=True)
    middle = np.zeros(inside.shape, np.int64)
    middle[inside] = symbols[((starts + a)[:, None] + column)[inside]] + 1
    rows = np.column_stack([part + 1, middle])
    order = np.lexsort(rows.T[::-1])
    reach = np.zeros(int(part.max()) + 1, np.int64)
    reach[part] = b - a
    left, right = composed_pairs(Acceptor(rows[order], inner[order] + 1), reach)
    left, right = order[left], order[right]
    own = np.minimum(lengths[left], lengths[right]) == m[left]  # two longer words are a pair of the next class
    one, two = np.concatenate([left[own], right[own]]), np.concatenate([right[own], left[own]])
    rank = np.empty(len(n), np.int64)
    rank[pc.sort_indices(words.cast(pa.binary())).to_numpy()] = np.arange(len(n))
    best = np.lexsort((rank[two], -n[two], one))
    one, two = one[best], two[best]
    each, first, links = np.unique(one, return_index=True, return_counts=True)
    return pa.table([words.take(pa.array(each)), pa.array(links), pa.array(n[two[first]]), words.take(pa.array(two[first]))], schema=_NEAR)


def spelling_variants(words: DataFrame, ratio: int = 10, group_rows: int = 4_000, bin_rows: int = 10_000) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` of every row of ``(word, n)``, words being distinct.

    Two words are near if one inserted, deleted or replaced code point makes one
    of the other; ``n_near`` counts a word's near words.  Its ``form`` is the
    most frequent of them (ties: the first in code-point order) if that is at
    least ``ratio`` times as frequent, and ``root`` is where its forms lead.
    Null words go; an empty table gives an empty one.

    Pairs are dealt into partitions by what the two words share (``keyed``), so
    no task holds more than bins of about ``bin_rows`` words of whole partitions
    of at most about ``group_rows``.  In a bin the partitions' minimal acceptor,
    whose initial state has an arc a partition, is composed with the one-edit
    transducer and itself.  Only a count and the best near word of each word
    leave a bin.
    """
    spark = words.sparkSession
    words = materialise(words.where("word IS NOT NULL").select("word", "n"), "variant-words")
    rows = keyed(words, group_rows)
    bins = max(-(-rows.count() // bin_rows), 2 * spark.sparkContext.defaultParallelism)
    dealt = rows.withColumn("bin", F.pmod(F.xxhash64("key"), F.lit(bins)).cast("int"))
    near = dealt.groupBy("bin").applyInArrow(near_in, "word string, links long, best_n long, best string")
    near = near.groupBy(F.col("word").alias("of")).agg(F.sum("links").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("top"))
    good = -F.col("top.less") >= ratio * F.col("n")
    found = words.join(near, F.col("word") == F.col("of"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("top.best")).alias("form"), F.when(good, -F.col("top.less")).alias("form_n")
    )
    found = materialise(found, "variant-found")
    # Frequencies grow along forms, so there are no loops, and each step doubles what is followed.
    chain = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        on = chain.select(F.col("word").alias("at"), F.col("root").alias("next"))
        step = materialise(chain.join(on, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        chain = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    roots = chain.select(F.col("word").alias("of"), "root")
    return found.join(roots, F.col("word") == F.col("of"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
