"""Filters and detectors on traces.  Work that needs a stretch of samples at once goes by blocks with a halo, so a task holds a block, however long a recording is."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.operators.sequence import FRAME, KEY, by_cell, in_blocks, isi_groups, plateau_peaks


def _filtered(v: np.ndarray, gain) -> np.ndarray:
    """``gain`` of the frequency (in cycles a sample) applied to v, continued oddly at both ends; gaps are bridged by lines and come back as gaps."""
    ok = np.isfinite(v)
    if ok.sum() < 2:
        return v
    x = np.interp(np.arange(len(v)), np.flatnonzero(ok), v[ok])
    p = len(x) - 1
    wide = np.concatenate([2 * x[0] - x[p:0:-1], x, 2 * x[-1] - x[-2 : -p - 2 : -1]])
    y = np.fft.irfft(np.fft.rfft(wide) * gain(np.fft.rfftfreq(len(wide))), len(wide))[p : p + len(x)]
    y[~ok] = np.nan
    return y


def _kind(df: DataFrame) -> str:
    return df.schema[KEY].dataType.simpleString()


def _by_blocks(df: DataFrame, c: str, out: str, gain, block: int, halo: int) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(FRAME)
        pdf[out] = _filtered(pdf[c].to_numpy(float), gain)
        return pdf.loc[pdf.own, [KEY, FRAME, out]]

    rows = in_blocks(df.select(KEY, FRAME, c), block, halo)
    return rows.groupBy(KEY, "block").applyInPandas(run, f"{KEY} {_kind(df)}, {FRAME} long, {out} double")


def butterworth(df: DataFrame, c: str, out: str, cut: float, kind: str = "high", order: int = 5, top: float | None = None, block: int = 65536) -> DataFrame:
    """Zero-phase Butterworth filter (forward and backward: the squared gain); ``cut`` (and ``top`` of kind "band") in cycles a frame.

    The filter's memory falls by exp(-2 pi cut sin(pi / 2 order)) a frame, so a halo of 8 / cut frames makes a frame's result in a
    block that of the whole recording to about 1e-6 of the trace's range (at order 5).
    """

    def low(f: np.ndarray, at: float) -> np.ndarray:
        ratio = np.tan(np.pi * np.minimum(f, 0.4999999)) / np.tan(np.pi * at)
        return 1 / (1 + ratio ** (2 * order))

    if kind not in ("low", "high", "band") or (kind == "band") != (top is not None):
        raise ValueError(f"kind {kind!r} with top {top!r}")
    gain = {"low": lambda f: low(f, cut), "high": lambda f: 1 - low(f, cut), "band": lambda f: (1 - low(f, cut)) * low(f, top)}[kind]
    halo = max(1024, int(np.ceil(8 / cut)))
    return _by_blocks(df, c, out, gain, max(block, 4 * halo), halo)


def guarded_highpass(df: DataFrame, c: str, good: str, out: str, cut: float, guard: int, order: int = 5) -> DataFrame:
    """(cell, frame, out): runs of ``good`` frames with a value, each high-passed by itself; null in the ``guard`` frames at both ends of a run and outside of runs."""
    kind = _kind(df)
    on = df.where(F.col(good) & F.col(c).isNotNull()).select(KEY, FRAME, c)
    on = on.withColumn("__g", F.col(FRAME) - F.row_number().over(by_cell()))
    ends = on.groupBy(KEY, "__g").agg(F.min(FRAME).alias("__lo"), F.max(FRAME).alias("__hi"))
    runs = on.join(ends, [KEY, "__g"]).select(F.concat_ws(":", F.col(KEY).cast("string"), "__lo", "__hi").alias(KEY), (F.col(FRAME) - F.col("__lo")).alias(FRAME), c)
    part = lambda i: F.split_part(F.col(KEY), F.lit(":"), F.lit(i)).cast("long")
    inside = (F.col(FRAME) >= guard) & (F.col(FRAME) <= part(3) - part(2) - guard)
    told = butterworth(runs, c, "__out", cut, "high", order).where(inside)
    told = told.select(F.split_part(F.col(KEY), F.lit(":"), F.lit(1)).cast(kind).alias(KEY), (F.col(FRAME) + part(2)).alias(FRAME), F.col("__out").alias(out))
    return df.select(KEY, FRAME).join(told, [KEY, FRAME], "left")


def fft_highpass(df: DataFrame, c: str, out: str, cut: float, block: int = 65536, halo: int = 4096) -> DataFrame:
    """Frequencies under ``cut`` taken out whole.

    Recordings of up to ``block`` frames are filtered whole.  The filter has no finite memory: in longer ones a frame at a block's seam
    differs from the whole recording's result by up to about 1 / (pi^2 cut halo) of the trace's range; take ``block`` as large as a task holds.
    """
    return _by_blocks(df, c, out, lambda f: (f >= cut).astype(float), block, halo)


def find_peaks(df: DataFrame, c: str, height: float, distance: int) -> DataFrame:
    """(cell, frame, c): peaks over the height, no two nearer than ``distance`` frames: the tallest stays first.

    Peaks farther apart than that don't touch each other, so only chains of near peaks go to Python, each by itself.
    """
    p = isi_groups(plateau_peaks(df, c, height), distance - 1)
    sizes = p.groupBy(KEY, "grp").agg(F.count(F.lit(1)).alias("__n"))
    p = p.join(sizes, [KEY, "grp"])

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([c, FRAME], ascending=[False, False])
        kept: list[int] = []  # in order of frames
        for f in pdf[FRAME]:
            i = bisect_left(kept, f)
            if all(abs(f - g) >= distance for g in kept[max(0, i - 1) : i + 1]):
                kept.insert(i, f)
        return pdf.loc[pdf[FRAME].isin(kept), [KEY, FRAME, c]]

    lone = p.where("__n = 1").select(KEY, FRAME, c)
    return lone.unionByName(p.where("__n > 1").groupBy(KEY, "grp").applyInPandas(thin, f"{KEY} {_kind(df)}, {FRAME} long, {c} double"))


def poisson_tuning(counts: DataFrame, bins: int, penalty: float) -> DataFrame:
    """(cell, bin, log_rate): rates of circular bins that maximise the Poisson likelihood less a roughness penalty, by Newton steps.

    ``counts`` (cell, bin, frames, spikes) are sufficient for one-hot bins, so a task holds as many rows as there are bins.
    """
    d = np.roll(np.eye(bins), 1, axis=1) - np.eye(bins)
    rough = penalty * d.T @ d

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        t, n = np.zeros(bins), np.zeros(bins)
        t[pdf.bin], n[pdf.bin] = pdf.frames, pdf.spikes
        u = np.full(bins, np.log(max(n.sum(), 0.5) / t.sum()))
        for _ in range(100):
            mean = t * np.exp(np.clip(u, -50, 50))
            step = np.linalg.solve(np.diag(mean) + rough + 1e-9 * np.eye(bins), mean - n + rough @ u)
            u -= np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-10:
                break
        return pd.DataFrame({KEY: pdf[KEY].iloc[0], "bin": np.arange(bins), "log_rate": u})

    return counts.groupBy(KEY).applyInPandas(fit, f"{KEY} long, bin long, log_rate double")
