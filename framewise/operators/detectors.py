"""Spike and burst detectors on traces, composed of windows, runs and interval joins; each step is a DataFrame of its own.

Traces are (cell, frame, value); windows of bursts are (cell, burst, lo, hi) with inclusive ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewise.operators import intervals as I
from framewise.operators.sequence import FRAME, KEY, by_cell, interpolated, local_peaks, median_edge
from framewise.scratch import stored


def subthreshold(df: DataFrame, c: str, spikes: DataFrame, k: int, out: str, blank: int = 1) -> DataFrame:
    """(cell, frame, out): the trace without its spikes: ``blank`` frames around each are bridged, then a running median of k frames."""
    near = spikes.select(KEY, (F.col(FRAME) - blank).alias("lo"), (F.col(FRAME) + blank).alias("hi"))
    bare = I.covered(df.select(KEY, FRAME, c), near, "__hit").withColumn("__bare", F.when(~F.col("__hit"), F.col(c)))
    return median_edge(interpolated(bare, "__bare", "__line"), "__line", k, out).select(KEY, FRAME, out)


def segment_thresholds(df: DataFrame, c: str, segment: int, mads: float) -> DataFrame:
    """(cell, segment, height): median and ``mads`` scaled median absolute deviations of each segment of frames."""
    s = _segment_spread(df, c, segment)
    return s.select(KEY, "segment", (F.col("__m") + mads * 1.4826 * F.col("__d")).alias("height"))


def _segment_spread(df: DataFrame, c: str, segment: int) -> DataFrame:
    at = F.floor(F.col(FRAME) / segment).cast("long")
    s = df.where(F.col(c).isNotNull()).select(KEY, at.alias("segment"), c)
    mid = F.expr(f"percentile({c}, 0.5)").over(W.partitionBy(KEY, "segment"))
    return s.withColumn("__m", mid).groupBy(KEY, "segment").agg(F.first("__m").alias("__m"), F.percentile(F.abs(F.col(c) - F.col("__m")), 0.5).alias("__d"))


def first_round(df: DataFrame, c: str, k: int, segment: int, mads: float) -> DataFrame:
    """(cell, frame, detrended): peaks of the trace less its running median that pass their segment's threshold."""
    flat = median_edge(df.select(KEY, FRAME, c), c, k, "__base").join(df.select(KEY, FRAME, F.col(c).alias("__v")), [KEY, FRAME]).select(KEY, FRAME, (F.col("__v") - F.col("__base")).alias("detrended"))
    peaks = local_peaks(flat, "detrended", float("-inf")).withColumn("segment", F.floor(F.col(FRAME) / segment).cast("long"))
    return peaks.join(segment_thresholds(flat, "detrended", segment, mads), [KEY, "segment"]).where("detrended > height").select(KEY, FRAME, "detrended")


def scored_peaks(df: DataFrame, c: str, k: int, segment: int, rounds: dict[str, float]) -> DataFrame:
    """(cell, frame, a flag of each name in ``rounds``): the peaks of ``first_round`` at several numbers of deviations, out of one running median."""
    flat = stored(median_edge(df.select(KEY, FRAME, c), c, k, "__base").join(df.select(KEY, FRAME, F.col(c).alias("__v")), [KEY, FRAME]).select(KEY, FRAME, (F.col("__v") - F.col("__base")).alias("detrended")), "detrended")
    peaks = local_peaks(flat, "detrended", float("-inf")).withColumn("segment", F.floor(F.col(FRAME) / segment).cast("long"))
    passed = [(F.col("detrended") > F.col("__m") + m * 1.4826 * F.col("__d")).alias(name) for name, m in rounds.items()]
    return peaks.join(_segment_spread(flat, "detrended", segment), [KEY, "segment"]).select(KEY, FRAME, *passed).where(" or ".join(rounds))


def onsets(df: DataFrame, c: str, windows: DataFrame, level: float, ident: str = "burst") -> DataFrame:
    """(cell, ident, steepest, onset): the frame of the steepest rise inside of a window (the first of equals) and the last frame of the window up to it that is at most ``level``."""
    rise = df.select(KEY, FRAME, c, (F.col(c) - F.lag(c).over(by_cell())).alias("__rise"))
    inside = I.points_inside(rise, windows.select(KEY, ident, "lo", "hi"), ident)
    top = inside.where("p___rise is not null").groupBy(KEY, ident).agg(F.max_by(F.col(FRAME), F.struct("p___rise", -F.col(FRAME))).alias("steepest"))
    low = inside.join(top, [KEY, ident]).where((F.col(FRAME) <= F.col("steepest")) & (F.col(f"p_{c}") <= level))
    return top.join(low.groupBy(KEY, ident).agg(F.max(FRAME).alias("onset")), [KEY, ident], "left")


def burst_windows(df: DataFrame, c: str, height: DataFrame, segment: int, level: float, spikes: DataFrame) -> DataFrame:
    """(cell, lo, hi, amplitude, frames, n_spikes, least_isi): runs in which the trace over its segment's height (cell, segment, height) passes ``level``."""
    at = F.floor(F.col(FRAME) / segment).cast("long")
    scaled = df.select(KEY, FRAME, c, at.alias("segment")).join(height, [KEY, "segment"]).select(KEY, FRAME, (F.col(c) / F.col("height")).alias("scaled"))
    runs = I.runs(scaled.withColumn("__on", F.col("scaled") > level), "__on").withColumn("burst", F.col("lo"))
    inside = I.points_inside(scaled, runs, "burst").groupBy(KEY, "burst").agg(F.max("p_scaled").alias("amplitude"), F.count(F.lit(1)).alias("frames"))
    hits = I.points_inside(spikes.select(KEY, FRAME).distinct(), runs, "burst")
    gap = F.col(FRAME) - F.lag(FRAME).over(W.partitionBy(KEY, "burst").orderBy(FRAME))
    hits = hits.withColumn("__gap", gap).groupBy(KEY, "burst").agg(F.count(F.lit(1)).alias("n_spikes"), F.min("__gap").alias("least_isi"))
    out = runs.join(inside, [KEY, "burst"]).join(hits, [KEY, "burst"], "left")
    return out.select(KEY, "lo", "hi", "amplitude", "frames", F.coalesce("n_spikes", F.lit(0).cast("long")).alias("n_spikes"), "least_isi")


def burst_verdict(least_spikes: int, least_amplitude: float, least_frames: int, most_isi: int, need_isi: bool) -> Column:
    """What a window of ``burst_windows`` is: ``complex``, or the first condition that it fails."""
    isi = (F.col("n_spikes") >= 2) & (F.col("least_isi") <= most_isi)
    return (
        F.when(F.col("n_spikes") < least_spikes, "few spikes").when(F.col("amplitude") < least_amplitude, "low").when(F.col("frames") < least_frames, "short")
        .when(F.lit(need_isi) & ~isi, "slow").otherwise("complex")
    )


def plateaus(df: DataFrame, c: str, level: float, least_amplitude: float, least_frames: int, share: float, least_high: int) -> DataFrame:
    """(cell, lo, hi, peak, high): runs over ``level`` that are tall and long, with a stretch of at least ``least_high`` frames at ``share`` of the peak or more."""
    runs = I.runs(df.withColumn("__on", F.col(c) > level), "__on").withColumn("burst", F.col("lo"))
    inside = I.points_inside(df.select(KEY, FRAME, c), runs, "burst").withColumn("__peak", F.max(f"p_{c}").over(W.partitionBy(KEY, "burst")))
    high = inside.where(F.col(f"p_{c}") >= share * F.col("__peak")).withColumn("__g", F.col(FRAME) - F.row_number().over(W.partitionBy(KEY, "burst").orderBy(FRAME)))
    longest = high.groupBy(KEY, "burst", "__g").agg(F.count(F.lit(1)).alias("__n"), F.max("__peak").alias("peak")).groupBy(KEY, "burst").agg(F.max("__n").alias("high"), F.max("peak").alias("peak"))
    return runs.join(longest, [KEY, "burst"]).where((F.col("peak") >= least_amplitude) & (F.col("hi") - F.col("lo") + 1 >= least_frames) & (F.col("high") >= least_high)).select(KEY, "lo", "hi", "peak", "high")


def reassigned(spikes: DataFrame, windows: DataFrame, least: int, ident: str = "burst") -> DataFrame:
    """(cell, frame, kind): ``complex`` where a window with at least ``least`` spikes holds the spike, else ``simple``."""
    full = I.count_inside(spikes.select(KEY, FRAME).distinct(), windows, ident).where(F.col("n") >= least)
    return I.covered(spikes.select(KEY, FRAME).distinct(), full, "__in").select(KEY, FRAME, F.when(F.col("__in"), "complex").otherwise("simple").alias("kind"))


def accepted_in_bursts(spikes: DataFrame, windows: DataFrame, value: str, heights: list[float], ident: str = "burst") -> DataFrame:
    """(cell, ident, frame, accepted): spikes of a window in order; the height to reach depends on how many were accepted before (the last of ``heights`` from there on)."""
    inside = I.points_inside(spikes.select(KEY, FRAME, value), windows, ident).groupBy(KEY, ident).agg(F.array_sort(F.collect_list(F.struct(F.col(FRAME).alias("f"), F.col(f"p_{value}").alias("v")))).alias("s"))
    need = F.array(*(F.lit(float(h)) for h in heights))
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<f:bigint,ok:boolean>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        ok = F.coalesce(x["v"] >= F.element_at(need, F.least(acc["n"] + 1, F.lit(len(heights)))), F.lit(False))
        return F.struct((acc["n"] + ok.cast("int")).alias("n"), F.concat(acc["out"], F.array(F.struct(x["f"].alias("f"), ok.alias("ok")))).alias("out"))

    return inside.select(KEY, ident, F.explode(F.aggregate("s", start, step, lambda a: a["out"])).alias("o")).select(KEY, ident, F.col("o.f").alias(FRAME), F.col("o.ok").alias("accepted"))
