"""State across the frames and steps of a stream: adjacent frames of a pixel, running means, snapshots by scene."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The store that keyed state needs.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _Neighbours(StatefulProcessor):
    """The labels of one pixel by frame, until both frames beside it have been met."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "frame long", "k long, met int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = []
        for part in rows:
            for frame, k in zip(part["frame"].tolist(), part["k"].tolist(), strict=True):
                if self.waiting.containsKey((frame,)):
                    continue  # the frame has been met
                met = 0
                for side, beside in ((1, frame - 1), (2, frame + 1)):
                    if not self.waiting.containsKey((beside,)):
                        continue
                    other, seen = self.waiting.getValue((beside,))
                    if other is not None:
                        found.append((*key, min(frame, beside), *((other, k) if side == 1 else (k, other))))
                        met |= side
                        seen |= 3 - side
                        # A frame that has met both sides is kept as a mark without its label, so that a repeat is known.
                        self.waiting.updateValue((beside,), (None if seen == 3 else other, seen))
                self.waiting.updateValue((frame,), (None if met == 3 else k, met))
        yield pd.DataFrame(found, columns=["scene", "pixel", "t", "a", "b"])

    def close(self) -> None:
        pass


def adjacent_labels(pixels: DataFrame) -> DataFrame:
    """``(scene, pixel, t, a, b)``: the labels of a pixel in frames t and t + 1, once both have arrived.

    ``pixels`` are ``(scene, pixel, frame, k)``, frames whole numbers, k not
    null.  Frames may arrive in any order, and of a frame that arrives again the
    first label counts.  State is one small map a pixel, so no task holds a frame.
    """
    rows = pixels.select(F.col("scene").cast("string"), F.col("pixel").cast("long"), F.col("frame").cast("long"), F.col("k").cast("long"))
    return rows.groupBy("scene", "pixel").transformWithStateInPandas(_Neighbours(), "scene string, pixel long, t long, a long, b long", "Append", "None")


def consistency(pairs: DataFrame) -> DataFrame:
    """``(scene, t, tc, ids)``: the mean IoU, over the labels above 0 in either frame, of frames t and t + 1."""
    sides = pairs.select("scene", "t", F.explode(F.array_distinct(F.array("a", "b"))).alias("k"), (F.col("a") == F.col("b")).alias("same")).where("k > 0")
    each = sides.groupBy("scene", "t", "k").agg((F.count_if("same") / F.count("*")).alias("iou"))
    return each.groupBy("scene", "t").agg(F.avg("iou").alias("tc"), F.count("*").alias("ids"))


class _Mean(StatefulProcessor):
    """The running mean of one key, and the values of steps behind a gap."""

    def __init__(self, share: float):
        self.share = share

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "step long, mean double")
        self.early = handle.getMapState("early", "step long", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        step, mean = self.last.get() if self.last.exists() else (-1, 0.0)
        found = []
        for part in rows:
            for at, value in zip(part["step"].tolist(), part["value"].tolist(), strict=True):
                if at > step and not self.early.containsKey((at,)):
                    self.early.updateValue((at,), (value,))
            while self.early.containsKey((step + 1,)):
                step += 1
                (value,) = self.early.getValue((step,))
                self.early.removeKey((step,))
                # A missing or undefined value leaves the mean as it is.
                mean = mean if value is None or value != value else self.share * value + (1 - self.share) * mean
                found.append((*key, step, mean))
        self.last.update((step, mean))
        yield pd.DataFrame(found, columns=["run", "step", "mean"])

    def close(self) -> None:
        pass


def running_means(losses: DataFrame, share: float = 0.4) -> DataFrame:
    """``(run, step, mean)``: the mean that takes ``share`` of each new value, from 0, by run in order of steps.

    ``losses`` are ``(run, step, value)``, steps counted from 0.  A step is
    given once all before it have arrived, in whatever order; repeats of a step
    do not count.
    """
    rows = losses.select(F.col("run").cast("string"), F.col("step").cast("long"), F.col("value").cast("double"))
    return rows.groupBy("run").transformWithStateInPandas(_Mean(share), "run string, step long, mean double", "Append", "None")


def _versions(spark: SparkSession, out: str) -> DataFrame | None:
    try:
        return spark.read.parquet(out)
    except AnalysisException:  # nothing has been written yet
        return None


def snapshot(spark: SparkSession, out: str, owner: str, before: int | None = None) -> DataFrame | None:
    """The rows of each owner as its latest batch (below ``before``) left them; None where there is no batch."""
    rows = _versions(spark, out)
    if rows is None:
        return None
    rows = rows if before is None else rows.where(F.col("batch") < before)
    last = rows.groupBy(F.col(owner).alias("_owner")).agg(F.max("batch").alias("_last"))
    return rows.join(last, F.col(owner).eqNullSafe(F.col("_owner")) & (F.col("batch") == F.col("_last"))).drop("_owner", "_last", "batch")


def merge_batch(rows: DataFrame, batch: int, out: str, owner: str, part: str, order: str) -> None:
    """Put a batch's rows in the place of those of the same owner and part, and write the owners that it touches.

    Of a part that a batch has several times, the rows with the greatest
    ``order`` count.  A batch is written under its own number from the batches
    below it, so one that is replayed writes what it wrote before.
    """
    spark = rows.sparkSession
    latest = F.max(order).over(Window.partitionBy(owner, part))
    fresh = rows.withColumn("_latest", latest).where(F.col(order).eqNullSafe(F.col("_latest"))).drop("_latest")
    old = snapshot(spark, out, owner, batch)
    if old is not None:
        touched = fresh.select(F.col(owner).alias("_o"), F.col(part).alias("_p")).distinct()
        stay = old.join(touched.select("_o").distinct(), F.col(owner).eqNullSafe(F.col("_o")), "left_semi")
        stay = stay.join(touched, F.col(owner).eqNullSafe(F.col("_o")) & F.col(part).eqNullSafe(F.col("_p")), "left_anti")
        fresh = fresh.unionByName(stay)
    fresh.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch}")


def keep_snapshots(stream: DataFrame, out: str, checkpoint: str, owner: str = "scene", part: str = "step", order: str = "at") -> None:
    """Merge what has arrived into the snapshots in ``out``, and stop."""
    each = lambda rows, batch: merge_batch(rows, batch, out, owner, part, order)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
