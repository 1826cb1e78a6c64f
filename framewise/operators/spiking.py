"""Spikes and complex bursts from a raw trace: matched filters, adaptive thresholds, refinement by segments, brackets of bursts.

A trace (cell, frame, value) is cut into segments of a fixed time, which are keys of their own from there on (``cell:segment``), so every
step is a window, join or aggregate over bounded groups; Python tasks hold one segment and do the one thing that needs its
spectrum, the density of its peaks, or a scan of its brackets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewise.operators import intervals as I
from framewise.operators.sequence import FRAME, KEY, by_cell, interpolated, isi_groups, median_edge, plateau_peaks
from framewise.operators.signals import butterworth, find_peaks
from framewise.scratch import stored

#: Samples of a periodogram.
WELCH = 1000
#: Places at which a density of peak heights is taken.
PLACES = 2001


def stored_rows(df: DataFrame, tag: str) -> DataFrame:
    """``stored``, joined by sorting only: a file of frames or peaks that is small enough for Spark to broadcast may be many times as large in the driver's memory."""
    return stored(df, tag).hint("merge")


def segmented(df: DataFrame, size: int, trace: DataFrame | None = None) -> DataFrame:
    """``df`` (cell, frame, ...) with ``cell:segment`` as its key and frames counted from the segment's start: segments of ``size`` frames, a last one of less than half joined to the one before.

    Points of a ``trace`` are cut as that is.
    """
    n = (df if trace is None else trace).groupBy(KEY).agg((F.max(FRAME) + 1).alias("__n"))
    last = F.ceil(F.col("__n") / size) - 1
    last = F.when((F.col("__n") - last * size < size / 2) & (last > 0), last - 1).otherwise(last)
    at = df.join(n, KEY).withColumn("__s", F.least(F.floor(F.col(FRAME) / size), last))
    return at.withColumns({KEY: F.concat_ws(":", F.col(KEY).cast("string"), F.col("__s").cast("string")), FRAME: (F.col(FRAME) - F.col("__s") * size).cast("long")}).drop("__n", "__s")


def unsegmented(df: DataFrame, size: int, kind: str, *frames: str) -> DataFrame:
    """With cell and segment instead of ``cell:segment``, and the columns ``frames`` counted from the recording's start."""
    part = lambda i: F.split_part(F.col(KEY), F.lit(":"), F.lit(i))
    segment = part(2).cast("long")
    return df.select(part(1).cast(kind).alias(KEY), segment.alias("segment"), *((F.col(c) + segment * size).alias(c) if c in frames else F.col(c) for c in df.columns if c != KEY))


def power_spectrum(noise: np.ndarray, size: int, length: int = WELCH) -> np.ndarray:
    """The mean periodogram of half-overlapping Hamming-windowed stretches of ``noise``, at ``size`` // 2 + 1 frequencies, in power over angular frequency."""
    length = min(length, len(noise))
    window = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(length) / length)
    starts = range(0, len(noise) - length + 1, max(1, length - length // 2))
    power = np.mean([np.abs(np.fft.rfft(noise[s : s + length] * window, max(size, length))) ** 2 for s in starts], axis=0) / (2 * np.pi * (window**2).sum())
    power[1:-1] *= 2
    return power


def matched_filter(v: np.ndarray, spikes: np.ndarray, half: int) -> np.ndarray:
    """``v`` whitened by the spectrum of what lies more than ``half`` samples off all spikes, correlated with the mean whitened shape around the spikes.

    Spikes nearer than ``half`` to an end don't make the shape (all do, with the trace held at its ends, if there are no others);
    without spikes or spike-free samples, zeros.
    """
    n, size = len(v), 1 << int(np.ceil(np.log2(max(len(v), 2))))
    near = np.zeros(n + 1)
    np.add.at(near, np.maximum(spikes - half, 0), 1)
    np.add.at(near, np.minimum(spikes + half + 1, n), -1)
    noise = v[np.cumsum(near[:-1]) < 0.5]
    if not len(spikes) or len(noise) < 2:
        return np.zeros(n)
    power = power_spectrum(noise, size)[: size // 2 + 1]
    white = np.fft.irfft(np.fft.rfft(v, size) / np.sqrt(np.maximum(power, power.max() * 1e-12 + 1e-300)), size)
    inner = spikes[(spikes >= half) & (spikes < n - half)]
    at = (inner if len(inner) else spikes)[:, None] + np.arange(-half, half + 1)
    shape = white[np.clip(at, 0, n - 1)].mean(axis=0)
    wide = np.concatenate((np.zeros(half), white[:n], np.zeros(half)))
    wide[half + n :] = white[n : n + half] if size >= n + half else np.concatenate((white[n:], np.zeros(half - (size - n))))
    return np.correlate(wide, shape, "valid")


def whitened_matched(trace: DataFrame, c: str, spikes: DataFrame, half: int, out: str) -> DataFrame:
    """(key, frame, out): ``matched_filter`` of each key's trace by its ``spikes`` (key, frame), less its median; gaps count as 0."""
    flagged = trace.select(KEY, FRAME, c).join(spikes.select(KEY, FRAME).distinct().withColumn("__spike", F.lit(True)), [KEY, FRAME], "left")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by(FRAME)
        v = np.nan_to_num(t.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False))
        got = matched_filter(v, np.flatnonzero(t.column("__spike").fill_null(False).to_numpy(zero_copy_only=False)), half)
        return pa.table([t.column(KEY), t.column(FRAME), pa.array(got - np.median(got))], names=[KEY, FRAME, out])

    return flagged.groupBy(KEY).applyInArrow(run, f"{KEY} string, {FRAME} long, {out} double")


def adaptive_threshold(peaks: np.ndarray, pnorm: float = 0.5, least: int = 10, most: int = 0) -> tuple[float, float, float, bool]:
    """(height, false positive rate, detection rate, few): where S^p - N^p is greatest, S the peaks and N the noise peaks above a height.

    The density of heights up to the median, mirrored, stands for the noise, but never for more than there is; heights are tried at PLACES
    points.  If fewer than ``least`` peaks pass, the height is that of the ``least`` tallest (few), if more than ``most`` (0: any), of the ``most`` tallest.
    """
    n = len(peaks)
    if n == 0:
        return np.nan, np.nan, np.nan, True
    sd = peaks.std(ddof=1) if n > 1 else 0.0
    if sd == 0:
        return float(peaks.max()), np.nan, np.nan, True
    lo, hi = peaks.min(), peaks.max()
    at = np.linspace(lo - 0.05 * (hi - lo), hi + 0.05 * (hi - lo), PLACES)
    width = sd * n**-0.2
    density = np.zeros(PLACES)
    for part in np.array_split(peaks, max(1, n // 2048)):
        density += np.exp(-0.5 * ((at[:, None] - part) / width) ** 2).sum(axis=1)
    density /= n * width * np.sqrt(2 * np.pi)
    middle = int(np.argmax(at > np.median(peaks)))
    noise = np.concatenate((density[: middle + 1], density[:middle][::-1]))
    noise = np.append(noise, np.full(max(0, PLACES - len(noise)), noise.min()))[:PLACES]
    share, noise_share = np.cumsum(density) / density.sum(), np.cumsum(noise) / max(density.sum(), noise.sum())
    crosses = np.flatnonzero((share[:-2] > noise_share[:-2] + np.spacing(1)) & (share[1:-1] < noise_share[1:-1]))  # at the last place both are all there is
    joint = int(crosses[0]) if len(crosses) else middle
    noise[: joint + 1] = density[: joint + 1]
    noise[joint:] = np.minimum(noise[joint:], density[joint:])
    above = lambda x: np.cumsum(x)[-1] - np.cumsum(x)
    s, b = np.maximum(above(density), 0), np.maximum(above(noise), 0)
    height = float(at[np.argmax(s**pnorm - b**pnorm)])
    few = bool((peaks > height).sum() < least)
    if few:
        height = float(np.percentile(peaks, 100 * max(0.0, 1 - least / n)))
    elif 0 < most < (peaks > height).sum():
        height = float(np.percentile(peaks, 100 * (1 - most / n)))
    i = int(np.argmin(np.abs(at - height)))
    top = (s - b).max()
    return height, float(b[i] / s[i]) if s[i] > 0 else np.nan, float((s[i] - b[i]) / top) if top > 0 else np.nan, few


def adaptive_thresholds(peaks: DataFrame, c: str, pnorm: float, least: int | str, most: int = 0) -> DataFrame:
    """(key, height, false_rate, detection_rate, few) of each key's peak heights; ``least`` may name a column of the key's own number."""

    def run(t: pa.Table) -> pa.Table:
        own = t.column(least)[0].as_py() if isinstance(least, str) else least
        found = adaptive_threshold(t.column(c).drop_null().to_numpy(zero_copy_only=False), pnorm, own, most)
        return pa.table([t.column(KEY).slice(0, 1), *(pa.array([x], pa.bool_() if i == 3 else pa.float64(), from_pandas=True) for i, x in enumerate(found))], names=[KEY, "height", "false_rate", "detection_rate", "few"])

    columns = [KEY, c, least] if isinstance(least, str) else [KEY, c]
    return peaks.select(*columns).groupBy(KEY).applyInArrow(run, f"{KEY} string, height double, false_rate double, detection_rate double, few boolean")


def template_spikes(trace: DataFrame, c: str, spikes: DataFrame, isi: int, most: int) -> DataFrame:
    """(key, frame): of each key's spikes farther than ``isi`` frames from all others, the ``most`` with the steepest rise into them (the earlier of equals)."""
    groups = isi_groups(spikes.select(KEY, FRAME).distinct(), isi)
    alone = groups.join(groups.groupBy(KEY, "grp").agg(F.count(F.lit(1)).alias("__n")).where("__n = 1"), [KEY, "grp"]).select(KEY, FRAME)
    rise = trace.select(KEY, FRAME, (F.col(c) - F.lag(c).over(by_cell())).alias("__rise")).where("__rise is not null")
    place = F.row_number().over(W.partitionBy(KEY).orderBy(F.desc("__rise"), FRAME))
    return alone.join(rise, [KEY, FRAME]).withColumn("__place", place).where(F.col("__place") <= most).select(KEY, FRAME)


def refined_spikes(df: DataFrame, c: str, spikes: DataFrame | None, size: int, isi: int, half: int, pnorm: float = 0.5, least: int = 10, median: int = 21) -> DataFrame:
    """(cell, segment, frame, filtered, height, few): spikes found again by segments of ``size`` frames.

    Each segment less its running median goes through the matched filter of its best lone ``spikes`` (cell, frame; without any given, all peaks of the
    trace), and peaks that reach the adaptive threshold of their heights are spikes.  Segments without a lone spike give none.
    """
    kind, slim = df.schema[KEY].dataType.simpleString(), df.select(KEY, FRAME, c)
    trace = stored_rows(interpolated(segmented(slim, size), c, "__v").where("__v is not null").select(KEY, FRAME, c, "__v"), "segments")
    if spikes is None:
        given = plateau_peaks(trace.select(KEY, FRAME, "__v"), "__v", float("-inf"))
    else:
        given = segmented(spikes.select(KEY, FRAME).distinct(), size, slim).join(trace.where(F.col(c).isNotNull()).select(KEY, FRAME), [KEY, FRAME])
    seeds = stored_rows(template_spikes(trace, "__v", given, isi, least), "template-spikes")
    base = median_edge(trace.select(KEY, FRAME, "__v"), "__v", median, "__base")
    flat = base.select(KEY, FRAME, (F.col("__v") - F.col("__base")).alias("flat")).join(seeds.groupBy(KEY).agg(F.count(F.lit(1)).alias("__seeds")), KEY)
    peaks = stored_rows(plateau_peaks(whitened_matched(flat, "flat", seeds, half, "filtered"), "filtered", float("-inf")), "filtered-peaks")
    #: A segment with few lone spikes asks for no more than it has.
    heights = adaptive_thresholds(peaks.join(seeds.groupBy(KEY).agg(F.count(F.lit(1)).alias("__seeds")), KEY), "filtered", pnorm, "__seeds")
    return unsegmented(peaks.join(heights.select(KEY, "height", "few"), KEY).where("filtered >= height"), size, kind, FRAME)


def simple_spikes(df: DataFrame, c: str, size: int, mads: float, flat: bool = True) -> DataFrame:
    """(cell, segment, frame, value, height): peaks of each segment that reach its median and ``mads`` (unscaled) median absolute deviations; equal values in a row may be a peak, if ``flat``."""
    kind = df.schema[KEY].dataType.simpleString()
    trace = interpolated(segmented(df.select(KEY, FRAME, c), size), c, "value").select(KEY, FRAME, "value").where("value is not null")
    return unsegmented(plateau_peaks(trace, "value", float("-inf"), flat).join(_mad_heights(trace, "value", mads), KEY).where("value >= height"), size, kind, FRAME)


def _mad_heights(trace: DataFrame, c: str, mads: float) -> DataFrame:
    mid = trace.groupBy(KEY).agg(F.percentile(c, 0.5).alias("__m"))
    off = trace.join(mid, KEY).groupBy(KEY).agg(F.first("__m").alias("__m"), F.percentile(F.abs(F.col(c) - F.col("__m")), 0.5).alias("__d"))
    return off.select(KEY, (F.col("__m") + mads * F.col("__d")).alias("height"))


def spikeless(trace: DataFrame, c: str, spikes: DataFrame, isi: int, reach: int, median: int, out: str) -> DataFrame:
    """(key, frame, out): the trace without sharp spikes, for bursts: lone spikes and their neighbours, and local peaks less than ``reach`` frames from a group's first spike, are bridged, then a running median."""
    groups = isi_groups(spikes.select(KEY, FRAME).distinct(), isi).groupBy(KEY, "grp").agg(F.count(F.lit(1)).alias("n"), F.min(FRAME).alias("f"))
    lone = groups.where("n = 1").select(KEY, (F.col("f") - 1).alias("lo"), (F.col("f") + 1).alias("hi"))
    bare = I.covered(trace.select(KEY, FRAME, c), lone, "__lone").withColumn("__bare", F.when(~F.col("__lone"), F.col(c)))
    near = groups.where("n > 1").select(KEY, (F.col("f") - reach + 1).alias("lo"), (F.col("f") + reach - 2).alias("hi"))
    tops = plateau_peaks(bare.select(KEY, FRAME, F.col("__bare").alias("v")), "v", float("-inf")).select(KEY, FRAME)
    tops = I.covered(tops, near, "__in").where("__in").select(KEY, FRAME, F.lit(True).alias("__top"))
    cut = bare.join(tops, [KEY, FRAME], "left").withColumn("__bare", F.when(F.col("__top").isNull(), F.col("__bare")))
    return median_edge(interpolated(cut.select(KEY, FRAME, "__bare"), "__bare", "__line").select(KEY, FRAME, "__line"), "__line", median, out).select(KEY, FRAME, out)


def troughs(trace: DataFrame, c: str, distance: int, prominence: float) -> DataFrame:
    """(key, frame, depth): minima at least ``distance`` frames apart (the deepest stays), with a prominence of ``prominence`` standard deviations of their key's trace or more."""
    upside = trace.select(KEY, FRAME, (-F.col(c)).alias("depth"))
    found = find_peaks(upside, "depth", float("-inf"), distance).withColumn("__trough", F.lit(True))
    flagged = upside.join(found.select(KEY, FRAME, "__trough"), [KEY, FRAME], "left")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by(FRAME)
        v = t.column("depth").to_numpy()
        at = np.flatnonzero(t.column("__trough").fill_null(False).to_numpy(zero_copy_only=False))
        keep = [i for i in at if peak_prominence(v, i) >= prominence * v.std()]
        return t.take(pa.array(keep, pa.int64())).select([KEY, FRAME, "depth"])

    return flagged.groupBy(KEY).applyInArrow(run, f"{KEY} string, {FRAME} long, depth double")


def peak_prominence(v: np.ndarray, i: int) -> float:
    """How far a peak stands over the higher of the lowest points between it and the next higher values on either side."""
    higher = np.flatnonzero(v > v[i])
    k = int(np.searchsorted(higher, i))
    left = v[(higher[k - 1] if k else 0) : i + 1].min()
    right = v[i : (higher[k] + 1 if k < len(higher) else len(v))].min()
    return float(v[i] - max(left, right))


def bracketed(peaks: list[int], minima: list[int], depths: list[float], n: int, least: int, most: int) -> list[tuple[int, int, int]]:
    """(start, end, peak) of peaks in order, each between the troughs around it; a bracket begins no earlier than the one before ends.

    Brackets are lengthened to ``least`` and cut to ``most`` frames; one with several peaks is cut at the deepest trough between each two
    (halfway, without any), and parts under ``least`` frames go.
    """
    minima_, depth = np.array(minima, np.int64), np.array(depths)
    peaks_ = np.array(peaks, np.int64)
    events, ended = [], 0
    for peak in peaks:
        i, j = np.searchsorted(minima_, peak), np.searchsorted(minima_, peak, "right")
        start = int(minima_[i - 1]) if i and minima_[i - 1] >= ended else max(ended, peak - 1)
        end = int(minima_[j]) if j < len(minima_) else peak
        end = max(end, start + 1)
        end = start + max(least, min(end - start, most))
        start, end = max(0, start), min(n - 1, end)
        if end <= start:
            end = min(start + 1, n - 1)
        inside = peaks_[(peaks_ >= start) & (peaks_ <= end)].tolist()
        if len(inside) <= 1:
            events.append((start, end, peak))
        else:
            cuts = []
            for a, b in zip(inside, inside[1:], strict=False):
                between = np.flatnonzero((minima_ > a) & (minima_ < b))
                cuts.append(int(minima_[between[np.argmax(depth[between])]]) if len(between) else (a + b) // 2)
            for s, e, p in zip([start, *cuts], [*cuts, end], inside, strict=True):
                if e - s >= max(1, least):
                    events.append((s, min(e, s + most), p))
        ended = end
    return events


def brackets_by_troughs(peaks: DataFrame, minima: DataFrame, ends: DataFrame, least: int, most: int) -> DataFrame:
    """(key, lo, hi, peak): ``bracketed`` peaks (key, frame) of each key between its troughs (key, frame, depth); ``ends`` has each key's first and last frame."""
    rows = peaks.select(KEY, FRAME, F.lit(None).cast("double").alias("depth")).unionByName(minima.select(KEY, FRAME, "depth")).join(ends.select(KEY, "first", "last"), KEY)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by(FRAME)
        frame, depth, first = t.column(FRAME).to_pylist(), t.column("depth").to_pylist(), t.column("first")[0].as_py()
        low = [(f - first, d) for f, d in zip(frame, depth, strict=True) if d is not None]
        found = bracketed([f - first for f, d in zip(frame, depth, strict=True) if d is None], [f for f, _ in low], [d for _, d in low], t.column("last")[0].as_py() - first + 1, least, most)
        columns = [pa.array([x[i] + first for x in found], pa.int64()) for i in range(3)]
        return pa.table([pa.array([t.column(KEY)[0].as_py()] * len(found), pa.string()), *columns], names=[KEY, "lo", "hi", "peak"])

    return rows.groupBy(KEY).applyInArrow(run, f"{KEY} string, lo long, hi long, peak long")


def brackets_by_crossings(trace: DataFrame, c: str, peaks: DataFrame, heights: DataFrame, most: int) -> DataFrame:
    """(key, lo, hi, peak): each peak with the run of values of at least its key's height around it, cut to ``most`` frames."""
    on = trace.join(heights.select(KEY, "height"), KEY).withColumn("__on", F.col(c) >= F.col("height"))
    runs = I.runs(on.select(KEY, FRAME, "__on"), "__on").withColumn("burst", F.col("lo"))
    inside = I.points_inside(peaks.select(KEY, FRAME), runs.select(KEY, "burst", "lo", "hi"), "burst")
    return inside.select(KEY, "lo", F.least(F.col("hi"), F.col("lo") + most).alias("hi"), F.col(FRAME).alias("peak"))


def burst_features(brackets: DataFrame, trace: DataFrame, c: str, before: int = 10) -> DataFrame:
    """(key, lo, hi, peak, loc, top, baseline, amplitude): the highest value in a bracket and its first frame, over the lowest of the ``before`` frames ahead of it (0 without any)."""
    b = brackets.where("hi > lo").withColumn("burst", F.struct("lo", "hi", "peak"))
    inside = I.points_inside(trace.select(KEY, FRAME, c), b.select(KEY, "burst", "lo", "hi"), "burst")
    top = inside.groupBy(KEY, "burst").agg(F.max_by(F.struct(F.col(FRAME).alias("loc"), F.col(f"p_{c}").alias("top")), F.struct(F.col(f"p_{c}"), -F.col(FRAME))).alias("t"))
    ahead = I.points_inside(trace.select(KEY, FRAME, c), b.select(KEY, "burst", (F.col("lo") - before).alias("lo"), (F.col("lo") - 1).alias("hi")), "burst")
    base = ahead.groupBy(KEY, "burst").agg(F.min(f"p_{c}").alias("__base"))
    baseline = F.coalesce("__base", F.lit(0.0))
    out = top.join(base, [KEY, "burst"], "left")
    return out.select(KEY, "burst.lo", "burst.hi", "burst.peak", "t.loc", "t.top", baseline.alias("baseline"), (F.col("t.top") - baseline).alias("amplitude"))


def _centred(trace: DataFrame, c: str, out: str) -> DataFrame:
    return trace.join(trace.groupBy(KEY).agg(F.percentile(c, 0.5).alias("__m")), KEY).select(KEY, FRAME, (F.col(c) - F.col("__m")).alias(out))


def complex_bursts(
    df: DataFrame, c: str, spikes: DataFrame, rate: float, seconds: float = 60, cut_hz: float = 20, method: str = "troughs", mads: float = 3, pnorm: float = 0.25, most_templates: int = 100, least: int = 10,
    half_ms: float = 40, isi_ms: float = 14, least_ms: float = 15, most_ms: float = 1000, trough_ms: float = 3, prominence: float = 0.01,
) -> DataFrame:
    """(cell, segment, lo, hi, peak, loc, top, baseline, amplitude) of complex bursts in a raw trace, by segments.

    The trace without its sharp ``spikes`` (cell, frame) is smoothed by a median of 11 and a low pass.  Method ``crossings``: peaks that reach ``mads``
    median absolute deviations, bracketed by where the trace passes that height.  Method ``troughs``: peaks of the matched filter of
    the most prominent ones that reach an adaptive threshold, bracketed by troughs; a burst must hold a spike.
    """
    if method not in ("troughs", "crossings"):
        raise ValueError(f"method {method!r}")
    kind, slim, size = df.schema[KEY].dataType.simpleString(), df.select(KEY, FRAME, c), int(seconds * rate)
    frames = lambda ms: max(1, int(ms * rate / 1000))
    apart, most, columns = frames(20), frames(most_ms), (FRAME, "lo", "hi", "peak", "loc")
    #: Each step is a written table, as later ones read it several times.
    trace = stored_rows(interpolated(segmented(slim, size), c, "__v").where("__v is not null").select(KEY, FRAME, F.col(c).isNotNull().alias("known"), F.col("__v").alias("v")), "segments")
    given = stored_rows(segmented(spikes.select(KEY, FRAME).distinct(), size, slim).join(trace.where("known").select(KEY, FRAME), [KEY, FRAME]), "given-spikes")
    smooth = stored_rows(spikeless(trace, "v", given, int(isi_ms * rate / 1000), frames(40) // 2, 11, "mf"), "smooth")
    low = stored_rows(_centred(stored_rows(butterworth(smooth, "mf", "__low", cut_hz / rate, "low", 3), "low-pass"), "__low", "slow"), "slow")
    #: Of peaks too near each other the taller stays, so a height may come after that.
    first = stored_rows(find_peaks(low, "slow", float("-inf"), apart), "slow-peaks")
    if method == "crossings":
        heights = low.groupBy(KEY).agg((mads * F.percentile(F.abs("slow"), 0.5)).alias("height"))
        peaks = first.join(heights, KEY).where("slow >= height")
        return unsegmented(burst_features(stored_rows(brackets_by_crossings(low, "slow", peaks, heights, most), "brackets"), smooth, "mf"), size, kind, *columns)
    seeds = stored_rows(first.join(adaptive_thresholds(first, "slow", 0.25, least, most_templates).select(KEY, "height"), KEY).where("slow >= height").select(KEY, FRAME), "template-bursts")
    told = stored_rows(whitened_matched(low.join(seeds.select(KEY).distinct(), KEY), "slow", seeds, int(np.ceil(half_ms * rate / 1000)), "told"), "told")
    peaks = stored_rows(find_peaks(told, "told", float("-inf"), apart), "told-peaks")
    peaks = peaks.join(adaptive_thresholds(peaks, "told", pnorm, least).select(KEY, "height"), KEY).where("told >= height").select(KEY, FRAME)
    ends = low.groupBy(KEY).agg(F.min(FRAME).alias("first"), F.max(FRAME).alias("last"))
    brackets = stored_rows(brackets_by_troughs(peaks, troughs(low, "slow", frames(trough_ms), prominence), ends, frames(least_ms), most), "brackets")
    found = burst_features(brackets, smooth, "mf")
    ident = found.withColumn("burst", F.struct("lo", "hi", "peak"))
    held = I.count_inside(given, ident.select(KEY, "burst", "lo", "hi"), "burst").where("n > 0").select(KEY, "burst")
    return unsegmented(ident.join(held, [KEY, "burst"]).drop("burst"), size, kind, *columns)


def two_rounds(df: DataFrame, c: str, rate: float, seconds: float, median: int, mads: float, simple_mads: float, complex_mads: float, burst_mads: float = 3, least: int = 1) -> DataFrame:
    """(cell, frame, kind, lo): spikes in two rounds.

    Peaks of the trace less its running median that pass ``mads`` of their segment tell where bursts are (``complex_bursts`` by crossings of ``burst_mads``). In the second
    round peaks inside of a burst must pass ``complex_mads`` and are complex, with the burst's first frame, where at least ``least`` of them do; peaks outside must
    pass ``simple_mads`` and are simple.
    """
    from framewise.operators.detectors import scored_peaks

    slim = stored_rows(df.select(KEY, FRAME, c), "rounds-trace")
    #: What a peak passes tells all rounds, so the running median and the segments' percentiles are worked out once.
    scored = stored_rows(scored_peaks(slim, c, median, int(seconds * rate), {"first": mads, "inner": complex_mads, "outer": simple_mads}), "scored-peaks")
    first = scored.where(F.col("first")).select(KEY, FRAME)
    found = stored_rows(complex_bursts(slim, c, first, rate, seconds, method="crossings", mads=burst_mads).select(KEY, "lo", "hi").withColumn("burst", F.col("lo")).dropDuplicates([KEY, "lo"]), "round-bursts")
    inside = I.points_inside(scored.where(F.col("inner")).select(KEY, FRAME), found, "burst").select(KEY, FRAME, "burst")
    full = inside.groupBy(KEY, "burst").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(KEY, "burst")
    complex_ = inside.join(full, [KEY, "burst"]).groupBy(KEY, FRAME).agg(F.min("burst").alias("lo")).select(KEY, FRAME, F.lit("complex").alias("kind"), "lo")
    outside = I.covered(scored.where(F.col("outer")).select(KEY, FRAME), found, "__in").where("not __in")
    return complex_.unionByName(outside.select(KEY, FRAME, F.lit("simple").alias("kind"), F.lit(None).cast("long").alias("lo")))
