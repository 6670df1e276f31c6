"""Exact top-k inner-product search by Fagin's threshold algorithm."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.storage import materialise

_HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float, is_query: Column) -> DataFrame:
    """``(id, v, query)`` with v = floor(scale * x) of each component; vectors with null or non-finite components go."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    valid = vectors.where(F.col(id_col).isNotNull() & x.isNotNull()).where(finite)
    return valid.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))


def quantities(column: pa.Array) -> tuple[np.ndarray, int]:
    """Vectors as the rows of an int64 matrix, shorter ones with zeros behind, and the largest magnitude."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        out = flat.reshape(len(lengths), width)
    else:
        out = np.zeros((len(lengths), width), np.int64)
        out[np.arange(width) < lengths[:, None]] = flat
    return out, int(np.abs(flat.astype(np.float64)).max(initial=0))


class SortedLists:
    """A block of vectors with, for each dimension, its rows in order of value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by_id], np.ascontiguousarray(vectors[by_id])
        self.order = np.argsort(self.vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(self.vectors, self.order, axis=0)

    def bounds(self, queries: np.ndarray, depths: list[int]) -> np.ndarray:
        """For each query and depth, the most that a row can score which is in no list's first ``depth``."""
        up, down, n = np.minimum(queries, 0), np.maximum(queries, 0), len(self.ids)
        return np.stack([up @ self.values[min(d, n - 1)] + down @ self.values[max(n - 1 - d, 0)] for d in depths], axis=1)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, ids: list[np.ndarray], scores: list[np.ndarray], depth: int = 16) -> None:
        """Updates each query's ``ids`` and ``scores``, its k best so far over other blocks, with this block's.

        Ties go to smaller ids.  A query reads all lists that matter to it in
        parallel from their better end, and each row met is scored in full.
        Once the bound of the rows not yet met, the product with the values at
        the current depth, is below its kth score, none of them can enter; a
        block whose first values are below it is not read at all.  Depth doubles
        from step to step, and when the lists read hold half as many
        entries as the block has rows, the others are scored at once.
        """
        n = len(self.ids)
        if not n:
            return
        depths = [0]
        while 2 * depths[-1] * queries.shape[1] < n and depths[-1] < n:
            depths.append(min(2 * depths[-1] or depth, n))
        bound = self.bounds(queries, depths)
        least = np.array([s[-1] if len(s) == k else -np.inf for s in scores], bound.dtype if bound.dtype == object else np.float64)
        for q in np.flatnonzero(bound[:, 0] >= least).tolist():
            query = queries[q]
            used = np.flatnonzero(query)
            up = query[used] < 0  # these lists start from the smallest value
            met = self.ids == own[q]
            for step, at in enumerate(depths):
                if len(scores[q]) == k and bound[q, step] < scores[q][-1]:
                    break
                if step + 1 < len(depths) and len(used):
                    to = depths[step + 1]
                    read = np.concatenate([self.order[at:to, used[up]].ravel(), self.order[n - to : n - at, used[~up]].ravel()])
                    fresh = np.zeros(n, bool)
                    fresh[read] = True
                    fresh = np.flatnonzero(fresh & ~met)
                else:
                    fresh = np.flatnonzero(~met)
                met[fresh] = True
                found = np.concatenate([scores[q], self.vectors[fresh] @ query])
                names = np.concatenate([ids[q], self.ids[fresh]])
                best = np.lexsort((names, -found))[:k] if len(found) <= 4 * k else _best(found, names, k)
                ids[q], scores[q] = names[best], found[best]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    edge = np.partition(scores, len(scores) - k)[len(scores) - k]
    near = np.flatnonzero(scores >= edge)
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def _searcher(k: int, list_rows: int):
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _HITS.empty_table()
        (queries, most), (rows, most_of_rows) = quantities(left.column("v")), quantities(right.column("v"))
        width = min(queries.shape[1], rows.shape[1])
        # In float64 where every product is exact in it, else in Python integers.
        kind = np.float64 if most * most_of_rows * max(width, 1) < 1 << 52 else object
        queries, own, names = queries[:, :width].astype(kind), left.column("id").to_numpy(), right.column("id").to_numpy()
        ids, scores = [np.zeros(0, np.int64)] * len(queries), [np.zeros(0, kind)] * len(queries)
        for at in range(0, len(rows), list_rows):
            SortedLists(names[at : at + list_rows], rows[at : at + list_rows, :width].astype(kind)).search(queries, own, k, ids, scores)
        return pa.table([np.repeat(own, [len(i) for i in ids]), np.concatenate(ids), np.array([int(x) for s in scores for x in s], np.int64)], schema=_HITS)

    return search


def top_k(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    scale: float = 256.0,
    block_rows: int = 65_536,
    query_rows: int = 16_384,
    list_rows: int = 4_096,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k best rows but its own.

    Queries and candidates are dealt into blocks by a hash of their ids, at
    most about ``query_rows`` and ``block_rows`` rows each, and every two blocks
    meet in one task, which holds only these.  There, candidates are read as
    sorted lists of ``list_rows`` rows, one after the other, and a query's kth
    score of the lists before bounds how far the next ones are read.  Each query
    leaves a block with at most k rows, and the last step ranks these few.
    Integer scores are exact.  What is shipped is, for each pair of a query and
    a candidate, ``1 / query_rows + 1 / block_rows`` rows of the smallest
    integers that hold all components.

    Rows with a null id or a vector that is null or has null or non-finite
    components take no part; vectors of different lengths score over the
    components that both have, empty ones 0; repeated ids are one row each, and
    a query leaves out every row of its own id.  Other columns play no part.
    """
    spark = vectors.sparkSession
    base = quantised(vectors, id_col, vector_col, scale, is_query)
    base = materialise(base, "topk-base")
    n, n_queries, most = base.agg(F.count("*"), F.coalesce(F.count_if("query"), F.lit(0)), F.coalesce(F.max(F.greatest(F.array_max("v"), -F.array_min("v"))), F.lit(0))).first()
    kind = "array<smallint>" if most < 1 << 15 else "array<int>" if most < 1 << 31 else "array<bigint>"
    parallel = spark.sparkContext.defaultParallelism
    blocks, parts = max(-(-n // block_rows), 4 * parallel), max(-(-n_queries // query_rows), 1)
    block = lambda count: F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
    small = base.select("id", F.col("v").cast(kind).alias("v"), "query")
    candidates = small.select("id", "v", block(blocks).alias("b")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    queries = small.where("query").select("id", "v", block(parts).alias("q")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    hits = queries.groupBy("q", "b").cogroup(candidates.groupBy("q", "b")).applyInArrow(_searcher(k, list_rows), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
