"""k-means in passes over the rows: what leaves a task is one row a centre."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.storage import materialise

#: Numbers of all centres together above which a run raises; tasks and the driver hold them.
MOST_NUMBERS = 1 << 22
#: Centres are kept to this many decimals, so that they do not depend on the order of sums.
DECIMALS = 9


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if (column.value_lengths().to_numpy(zero_copy_only=False) != width).any():
        raise ValueError(f"vectors of other lengths than {width}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def _gaps(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Square distances of rows to centres, to 12 decimals."""
    return np.round(np.stack([np.square(rows - c).sum(axis=1) for c in centres], axis=1), 12)


def _farther(centres: np.ndarray):
    """Of each task's rows, the one that wins its race by distance to the nearest centre."""

    def run(batches):
        best = None
        for batch in batches:
            if batch.num_rows:
                gap = _gaps(_matrix(batch.column("vec"), centres.shape[1]), centres).min(axis=1)
                time = np.divide(batch.column("race").to_numpy(), gap, out=np.full(len(gap), np.inf), where=gap > 0)
                ids = batch.column("id").to_pylist()
                for at in np.flatnonzero((time == time.min()) & (gap > 0)).tolist():
                    mine = (float(time[at]), ids[at], batch.column("vec")[at].as_py())
                    best = mine if best is None or mine[:2] < best[:2] else best
        if best:
            yield pa.RecordBatch.from_pylist([dict(zip(("time", "id", "vec"), best, strict=True))])

    return run


def _summed(centres: np.ndarray):
    """For each centre the sums of a task's rows that are nearest to it, and behind them their number."""

    def run(batches):
        sums = np.zeros((len(centres), centres.shape[1] + 1))
        for batch in batches:
            rows = _matrix(batch.column("vec"), centres.shape[1])
            near = _gaps(rows, centres).argmin(axis=1)
            for c in np.unique(near).tolist():
                own = rows[near == c]
                sums[c] += np.append(own.sum(axis=0), len(own))
        at = np.flatnonzero(sums[:, -1])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at].tolist(), pa.list_(pa.float64()))], ["c", "sums"])

    return run


def _named(centres: np.ndarray):
    def run(batches):
        for batch in batches:
            near = _gaps(_matrix(batch.column("vec"), centres.shape[1]), centres).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(near, pa.int64())], ["id", "cluster"])

    return run


def first_centres(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """Vectors of k rows ``(id, vec)``, each drawn with a chance in proportion to the square
    distance to the nearest one before, the first evenly.

    A draw is a race: a row's time is ``-ln(u)`` over its weight, u a variate of
    seed, step and id, and the least time wins, the smaller id on ties.  So a
    draw is one pass, in which a task keeps one row.  Where fewer than k vectors
    differ, there are as many centres as vectors.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def raced(step: int) -> DataFrame:
        digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:{step}:"), F.col("id").cast("string")).cast("binary")), 1, 13)
        return rows.withColumn("race", -F.log((F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)))

    first = raced(1).agg(F.min_by("vec", F.struct("race", "id"))).first()[0]
    centres = np.zeros((0, 0)) if first is None else np.array([first], float)
    if len(first or ()) * k > MOST_NUMBERS:
        raise ValueError(f"centres of more than {MOST_NUMBERS:,} numbers")
    for step in range(2, k + 1 if len(centres) else 2):
        times = raced(step).select("id", "vec", "race").mapInArrow(_farther(centres), f"time double, id {kind}, vec array<double>")
        won = times.agg(F.min_by("vec", F.struct("time", "id"))).first()[0]
        if won is None:
            break
        centres = np.vstack([centres, won])
    return centres


def kmeans_clusters(points: DataFrame, vector: str, k: int, seed: int = 0, rounds: int = 300) -> DataFrame:
    """``(id, cluster)`` by k-means on a column of vectors, clusters numbered from 0.

    From the centres that ``first_centres`` draws, rows go to their nearest
    centre (the first of equally near ones) and centres to the mean of their
    rows, until no centre changes or ``rounds`` are over.  A round is one pass:
    a task sums its rows by centre, the sums are added by centre and place, and
    only the centres, a bounded number of numbers, reach the driver.  A centre
    that no row is nearest to stays where it is.

    Rows whose vector is null or has null or non-finite entries take no part; repeated
    ids are rows of their own; vectors of different lengths raise; an empty
    table gives no row.
    """
    v = F.col(vector)
    whole = v.isNotNull() & F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    rows = materialise(points.where(whole).select("id", v.cast("array<double>").alias("vec")), "means-rows")
    kind = rows.schema["id"].dataType.simpleString()
    centres = first_centres(rows, k, seed)
    if not len(centres):
        return rows.select("id", F.lit(0).cast("long").alias("cluster"))
    for _ in range(rounds):
        sums = rows.select("vec").mapInArrow(_summed(centres), "c long, sums array<double>").select("c", F.posexplode("sums").alias("at", "s"))
        found = sums.groupBy("c", "at").agg(F.sum("s").alias("s")).toArrow()
        total = np.zeros((len(centres), centres.shape[1] + 1))
        total[found.column("c").to_numpy(), found.column("at").to_numpy()] = found.column("s").to_numpy()
        met = total[:, -1] > 0
        moved = centres.copy()
        moved[met] = np.round(total[met, :-1] / total[met, -1:], DECIMALS)
        if (moved == centres).all():
            break
        centres = moved
    return rows.mapInArrow(_named(centres), f"id {kind}, cluster long")
