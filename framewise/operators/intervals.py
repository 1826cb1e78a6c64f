"""Runs, merges and joins of intervals; ends are inclusive unless said otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewise.operators.sequence import FRAME, KEY, boxcar_zero, by_cell, interpolated


def runs(df: DataFrame, flag: str) -> DataFrame:
    """(cell, lo, hi): maximal runs of frames whose flag is true."""
    on = df.where(F.col(flag)).select(KEY, FRAME)
    on = on.withColumn("__g", F.col(FRAME) - F.row_number().over(by_cell()))
    return on.groupBy(KEY, "__g").agg(F.min(FRAME).alias("lo"), F.max(FRAME).alias("hi")).drop("__g")


def merged(intervals: DataFrame, touch: int = 1) -> DataFrame:
    """Intervals that overlap, or lie ``touch`` frames apart, made one; touch = 0 merges only what overlaps."""
    ordered = W.partitionBy(KEY).orderBy("lo", "hi")
    before = F.max("hi").over(ordered.rowsBetween(W.unboundedPreceding, -1))
    marked = intervals.withColumn("__new", F.coalesce((F.col("lo") > before + touch).cast("long"), F.lit(1).cast("long")))
    grouped = marked.withColumn("__g", F.sum("__new").over(ordered.rowsBetween(W.unboundedPreceding, 0)))
    return grouped.groupBy(KEY, "__g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("__g")


def clipped(intervals: DataFrame, lo: int, hi: int) -> DataFrame:
    """Ends in order and inside [lo, hi]; what lies outside goes."""
    a, b = F.least("lo", "hi"), F.greatest("lo", "hi")
    cut = intervals.withColumns({"lo": F.greatest(a, F.lit(lo)), "hi": F.least(b, F.lit(hi))})
    return cut.where("lo <= hi")


def covered(df: DataFrame, intervals: DataFrame, out: str, end: int = 1) -> DataFrame:
    """``out``: whether an interval of the cell holds the frame; ``end`` = 0 leaves the intervals' ends out.

    Intervals are short against a recording, so they are made frames and joined by equality; no range join is needed.
    """
    frames_in = intervals.where(F.col("lo") <= F.col("hi") - (1 - end)).select(KEY, F.explode(F.sequence("lo", F.col("hi") - (1 - end))).alias(FRAME)).distinct().withColumn(out, F.lit(True))
    return df.join(frames_in, [KEY, FRAME], "left").withColumn(out, F.coalesce(out, F.lit(False)))


def points_inside(points: DataFrame, intervals: DataFrame, ident: str) -> DataFrame:
    """(interval columns, point columns as p_...) for each point of an interval, ends included."""
    keep = [c for c in points.columns if c not in (KEY, FRAME)]
    spread = intervals.select("*", F.explode(F.sequence("lo", "hi")).alias(FRAME))
    return spread.join(points.select(KEY, FRAME, *(F.col(c).alias(f"p_{c}") for c in keep)), [KEY, FRAME])


def count_inside(points: DataFrame, intervals: DataFrame, ident: str) -> DataFrame:
    """Every interval with n, the number of its points, and first, the earliest (null without any)."""
    got = points_inside(points, intervals, ident).groupBy(KEY, ident).agg(F.count(F.lit(1)).alias("n"), F.min(FRAME).alias("first"))
    return intervals.join(got, [KEY, ident], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def burst_events(bursts: DataFrame, complex_spikes: DataFrame | None, ident: str = "burst", frames: int | None = None) -> DataFrame:
    """(cell, frame): the first complex spike of each burst; where there is no list of complex spikes at all, the bursts' own ``loc``.

    A list that is there but holds nothing for a burst gives it no event.  Each frame counts once; frames outside of [0, frames) go.
    """
    at = bursts.select(KEY, F.col("loc").alias(FRAME)) if complex_spikes is None else count_inside(complex_spikes, bursts, ident).select(KEY, F.col("first").alias(FRAME)).where(F.col(FRAME).isNotNull())
    inside = F.col(FRAME) >= 0 if frames is None else F.col(FRAME).between(0, frames - 1)
    return at.where(inside).distinct()


def long_runs(df: DataFrame, flag: str, least: int) -> DataFrame:
    return runs(df, flag).where(F.col("hi") - F.col("lo") + 1 >= least)


def moving(df: DataFrame, fastest: float, smooth: int, level: float, least: int, gap: int) -> DataFrame:
    """(cell, lo, hi) of movement: speeds over ``fastest`` interpolated away, smoothed, over ``level``, at least ``least`` frames, gaps under ``gap`` closed."""
    s = interpolated(df.withColumn("__s", F.when(F.col("speed") <= fastest, F.col("speed"))), "__s", "__i")
    s = boxcar_zero(s, "__i", smooth, "__m").withColumn("__on", F.col("__m") > level)
    return merged(long_runs(s, "__on", least), max(0, gap))


def short_gaps_filled(df: DataFrame, c: str, most: int, out: str) -> DataFrame:
    """Gaps of at most ``most`` frames with values on both sides are interpolated; other gaps stay."""
    gap = df.withColumn("__gap", F.col(c).isNull())
    short = runs(gap, "__gap").where(F.col("hi") - F.col("lo") < most)
    filled = covered(interpolated(df, c, "__i"), short, "__short")
    cell = W.partitionBy(KEY)
    some = F.when(F.col(c).isNotNull(), F.col(FRAME))
    between = (F.col(FRAME) > F.min(some).over(cell)) & (F.col(FRAME) < F.max(some).over(cell))
    return filled.withColumn(out, F.when(F.col(c).isNotNull(), F.col(c)).when(F.col("__short") & between, F.col("__i"))).drop("__i", "__short")


def session_ranges(df: DataFrame) -> DataFrame:
    """(cell, session, lo, hi) with hi exclusive: from a session's first frame to the next one's."""
    starts = df.groupBy(KEY, "session").agg(F.min(FRAME).alias("lo"), F.max(FRAME).alias("__last"))
    after = F.lead("lo").over(W.partitionBy(KEY).orderBy("session"))
    return starts.withColumn("hi", F.coalesce(after, F.col("__last") + 1)).drop("__last")


def remapped(points: DataFrame, kept: DataFrame) -> DataFrame:
    """Points on the frames that are kept, numbered anew without gaps; points of lost frames go, each frame once."""
    new = kept.select(KEY, FRAME, (F.row_number().over(by_cell()) - 1).cast("long").alias("__new"))
    return points.join(new, [KEY, FRAME]).select(KEY, F.col("__new").alias(FRAME)).distinct()


def sliced(intervals: DataFrame, ranges: DataFrame) -> DataFrame:
    """Intervals that overlap a session's range [lo, hi), counted from its start (so starts may be negative)."""
    r = ranges.select(KEY, "session", F.col("lo").alias("__lo"), F.col("hi").alias("__hi"))
    return intervals.join(r, KEY).where("lo < __hi and hi >= __lo").withColumns({"lo": F.col("lo") - F.col("__lo"), "hi": F.col("hi") - F.col("__lo")}).drop("__lo", "__hi")
