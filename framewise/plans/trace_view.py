"""The windowed trace view: what a trace viewer shows of some cells and a stretch of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewise.operators.intervals import covered
from framewise.operators.motion import motion_regressed, with_regressors
from framewise.operators.sequence import KEY, block_baseline


def trace_view(frames: DataFrame, bad: DataFrame, lo: int, hi: int, block: int, points: int, regressors: list[str] | None = None, chunk: int = 5000, overlap: int = 0) -> DataFrame:
    """(cell, bin, frame, z): lowest and highest z-score of each bin of ``points`` frames, in order of time.

    Frames outside [lo, hi) aren't read on; bad epochs have no value; what ``regressors`` of the shifts x and y (``motion.SHIFTS``) explain of a
    trace is taken off by chunks of frames, if any are named; the baseline is the smoothed lower percentile of
    blocks, taken off before the z-score (population deviation; a flat trace has 1).
    """
    view = frames.where(F.col("frame").between(lo, hi - 1))
    view = covered(view, bad, "__bad").withColumn("v", F.when(~F.col("__bad"), F.col("v")))
    if regressors:
        view = motion_regressed(with_regressors(view, "x", "y", KEY), "v", regressors, "__clean", KEY, chunk=chunk, overlap=overlap).withColumn("v", F.col("__clean"))
    based = block_baseline(view, "v", block, 0.2, 3, "__base").withColumn("__d", F.col("v") - F.col("__base"))
    cell = W.partitionBy(KEY)
    sd = F.stddev_pop("__d").over(cell)
    z = based.withColumn("z", (F.col("__d") - F.avg("__d").over(cell)) / F.when(sd > 0, sd).otherwise(F.lit(1.0))).where("z is not null")
    point = F.struct("frame", "z")
    bins = z.groupBy(KEY, F.floor((F.col("frame") - lo) / points).cast("long").alias("bin")).agg(
        F.min_by(point, F.struct("z", "frame")).alias("low"), F.max_by(point, F.struct(F.col("z"), -F.col("frame"))).alias("high")
    )
    return bins.select(KEY, "bin", F.explode(F.array_sort(F.array_distinct(F.array("low", "high")))).alias("p")).select(KEY, "bin", "p.frame", "p.z")
