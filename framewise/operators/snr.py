"""Signal to noise over a recording's time: heights of lone spikes, noise of spike-free windows, exponential trends of both.

The trends are least-squares fits of a + b exp(-t / tau) whose sums Spark aggregates: for a given tau the rest is linear, and a round
narrows the interval of tau around its best value, so no task holds a recording's spikes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.operators import intervals as I
from framewise.operators.sequence import FRAME, KEY, isi_groups
from framewise.scratch import stored

#: Values of tau that a round tries, rounds, and how far the first interval goes below and above the time that points span.
TAUS, ROUNDS, BELOW, ABOVE = 17, 7, 1e-4, 1e3


def spike_heights(trace: DataFrame, c: str, spikes: DataFrame, isi: int, before: int = 3) -> DataFrame:
    """(cell, frame, height) of lone spikes and the first of each group of spikes at most ``isi`` frames apart: the value less the lowest of the ``before`` frames ahead.

    Spikes without a value or without one ahead have none.
    """
    groups = isi_groups(spikes.select(KEY, FRAME).distinct(), isi)
    first = groups.groupBy(KEY, "grp").agg(F.min(FRAME).alias(FRAME)).select(KEY, FRAME)
    ahead = I.points_inside(trace.select(KEY, FRAME, c), first.select(KEY, F.col(FRAME).alias("spike"), F.greatest(F.col(FRAME) - before, F.lit(0)).alias("lo"), (F.col(FRAME) - 1).alias("hi")).where("hi >= lo"), "spike")
    low = ahead.groupBy(KEY, F.col("spike").alias(FRAME)).agg(F.min(f"p_{c}").alias("__low"))
    out = first.join(trace.select(KEY, FRAME, F.col(c).alias("__v")), [KEY, FRAME]).join(low, [KEY, FRAME])
    return out.select(KEY, FRAME, (F.col("__v") - F.col("__low")).alias("height")).where("height is not null")


def window_noise(trace: DataFrame, c: str, spikes: DataFrame, bursts: DataFrame | None, window: int, around: int = 3, least: int = 20) -> DataFrame:
    """(cell, window, at, sd): the population deviation of each window's frames that lie more than ``around`` frames off all spikes and outside of ``bursts`` (cell, lo, hi), at its middle; null under ``least`` frames."""
    out = spikes.select(KEY, F.greatest(F.col(FRAME) - around, F.lit(0)).alias("lo"), (F.col(FRAME) + around).alias("hi"))
    out = out.unionByName(bursts.select(KEY, "lo", "hi")) if bursts is not None else out
    kept = I.covered(trace.select(KEY, FRAME, c), out, "__out")
    value = F.when(~F.col("__out"), F.col(c))
    g = kept.groupBy(KEY, F.floor(F.col(FRAME) / window).cast("long").alias("window")).agg(F.stddev_pop(value).alias("sd"), F.count(F.when(~F.col("__out"), 1)).alias("n"), F.max(FRAME).alias("last"))
    return g.select(KEY, "window", ((F.col("window") * window + F.col("last") + 1) / 2).alias("at"), F.when(F.col("n") >= least, F.col("sd")).alias("sd"))


def _linear(n: Column, e: Column, ee: Column, y: Column, ey: Column, yy: Column, rising: bool) -> tuple[Column, Column, Column]:
    """(a, b, cost) of the best a + b e for given sums: b not under 0; if ``rising``, b not over 0 and a + b, what it rises from, not under 0."""
    det = n * ee - e * e
    free = F.when(det > 1e-12 * n * ee, (n * ey - e * y) / det).otherwise(F.lit(0.0))
    b = F.least(free, F.lit(0.0)) if rising else F.greatest(free, F.lit(0.0))
    a = (y - b * e) / n
    if rising:
        held = F.least(F.when(ee - 2 * e + n > 0, (ey - y) / (ee - 2 * e + n)).otherwise(F.lit(0.0)), F.lit(0.0))
        low = a + b < 0
        a, b = F.when(low, -held).otherwise(a), F.when(low, held).otherwise(b)
    return a, b, yy - 2 * a * y - 2 * b * ey + a * a * n + 2 * a * b * e + b * b * ee


def exponential_trend(points: DataFrame, t: str, y: str, rising: bool = False) -> DataFrame:
    """(cell, a, b, tau): the least-squares curve a + b exp(-t / tau) of each cell's points; b is not under 0, or, ``rising``, not over 0 with a + b not under 0.

    Cells of fewer than 3 points, or of one value only, get their median (b = 0, tau null).
    """
    p = points.where(f"{t} is not null and {y} is not null").select(KEY, F.col(t).cast("double").alias("t"), F.col(y).cast("double").alias("y"))
    p = stored(p, "trend-points")
    base = p.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), F.percentile("y", 0.5).alias("mid"), (F.max("y") - F.min("y")).alias("range"), (F.max("t") - F.min("t")).alias("span"))
    some = base.where("n >= 3 and range > 0 and span > 0")
    state = stored(some.select(KEY, F.log(F.col("span") * BELOW).alias("lo"), F.log(F.col("span") * ABOVE).alias("hi"), F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b"), F.lit(None).cast("double").alias("tau")), "trend")
    for _ in range(ROUNDS):
        step = (F.col("hi") - F.col("lo")) / (TAUS - 1)
        rows = p.join(state.select(KEY, "lo", "hi"), KEY)
        taus = [F.exp(F.col("lo") + i * step) for i in range(TAUS)]
        e = [F.exp(-F.col("t") / tau) for tau in taus]
        sums = rows.groupBy(KEY, "lo", "hi").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("y"), F.sum(F.col("y") * F.col("y")).alias("yy"), *(F.sum(x).alias(f"e{i}") for i, x in enumerate(e)), *(F.sum(x * x).alias(f"ee{i}") for i, x in enumerate(e)), *(F.sum(x * F.col("y")).alias(f"ey{i}") for i, x in enumerate(e)))
        tried = []
        for i in range(TAUS):
            a, b, cost = _linear(F.col("n"), F.col(f"e{i}"), F.col(f"ee{i}"), F.col("y"), F.col(f"ey{i}"), F.col("yy"), rising)
            tried.append(F.struct(cost.alias("cost"), F.lit(i).alias("i"), a.alias("a"), b.alias("b"), taus[i].alias("tau")))
        best = sums.withColumn("best", F.array_min(F.array(*tried)))
        at = F.col("lo") + F.col("best.i") * step
        state = stored(best.select(KEY, F.greatest(at - step, F.col("lo")).alias("lo"), F.least(at + step, F.col("hi")).alias("hi"), "best.a", "best.b", "best.tau"), "trend")
    fit = state.select(KEY, "a", "b", F.when(F.col("b") != 0, F.col("tau")).alias("tau"))
    return base.join(fit, KEY, "left").select(KEY, F.coalesce("a", "mid").alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"), "tau")


def trend_at(t: Column, fit: str) -> Column:
    return F.col(f"{fit}.a") + F.when(F.col(f"{fit}.b") != 0, F.col(f"{fit}.b") * F.exp(-t / F.col(f"{fit}.tau"))).otherwise(F.lit(0.0))


def snr_over_time(trace: DataFrame, c: str, spikes: DataFrame, bursts: DataFrame | None, rate: float, isi_ms: float = 20, seconds: float = 10, around: int = 3, least: int = 20) -> DataFrame:
    """(cell, frame, height, noise, snr): the trends of spike height (falling) and noise (rising), and their ratio, null where there is no noise."""
    heights = spike_heights(trace, c, spikes, max(1, round(isi_ms / 1000 * rate)))
    noise = window_noise(trace, c, spikes, bursts, max(1, round(seconds * rate)), around, least)
    up = exponential_trend(heights.withColumn("t", F.col(FRAME) / rate), "t", "height").select(KEY, F.struct("a", "b", "tau").alias("h"))
    down = exponential_trend(noise.withColumn("t", F.col("at") / rate), "t", "sd", rising=True).select(KEY, F.struct("a", "b", "tau").alias("s"))
    at = F.col(FRAME) / rate
    out = trace.select(KEY, FRAME).join(up, KEY, "left").join(down, KEY, "left").select(KEY, FRAME, trend_at(at, "h").alias("height"), trend_at(at, "s").alias("noise"))
    return out.withColumn("snr", F.when(F.col("noise") != 0, F.col("height") / F.col("noise")))


#: Of a cell: its last spike, its last values and their frames.
_STATE = "last long, recent array<double>, frames array<long>"


def streamed_heights(rows: DataFrame, isi: int, before: int = 3) -> DataFrame:
    """``spike_heights`` of a stream of (cell, frame, v, spike) rows that come in order of frames: what a cell keeps is its last spike and its last ``before`` values.

    A batch and a stream of the same rows give the same heights, whatever the cuts between batches.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, recent, at = (None, [], []) if not state.exists else (lambda s: (s[0], list(s[1]), list(s[2])))(state.get)
        out = []
        for pdf in sorted([b for b in batches if len(b)], key=lambda b: b.frame.min()):
            for frame, v, spike in pdf.sort_values("frame")[["frame", "v", "spike"]].itertuples(index=False):
                if spike:
                    low = [x for f, x in zip(at, recent, strict=True) if frame - before <= f < frame and np.isfinite(x)]
                    if (last is None or frame - last > isi) and low and np.isfinite(v):
                        out.append((key[0], int(frame), float(v) - min(low)))
                    last = int(frame)
                recent, at = [*recent, float(v)][-before:], [*at, int(frame)][-before:]
        state.update((last, recent, at))
        yield pd.DataFrame(out, columns=["cell", "frame", "height"])

    kind = rows.schema["cell"].dataType.simpleString()
    return rows.groupBy("cell").applyInPandasWithState(run, f"cell {kind}, frame long, height double", _STATE, "append", "NoTimeout")
