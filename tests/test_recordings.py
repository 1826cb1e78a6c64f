"""Expected frames of masks and burst events written out by hand, filters by blocks, and peaks against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.operators import intervals as I
from framewise.operators import sequence as S
from framewise.operators import signals


def per_frame(spark, n, cells=1, **columns):
    rows = [(c, f, *(v[f] for v in columns.values())) for c in range(cells) for f in range(n)]
    return spark.createDataFrame(rows, "cell long, frame long, " + ", ".join(f"{k} double" for k in columns))


def bad_frames(df, intervals=None, least_snr=5.0):
    """Frames that any criterion rejects, by cell."""
    df = I.covered(df, intervals, "listed") if intervals is not None else df.withColumn("listed", F.lit(False))
    bad = F.col("listed") | F.col("hd").isNull() | F.col("v").isNull() | (F.col("snr") < least_snr)
    out = {}
    for r in df.where(bad).collect():
        out.setdefault(r.cell, set()).add(r.frame)
    return out


def test_frames_without_head_direction_are_bad(spark):
    hd = [0.0, 0.1, None, 0.3, 0.4, None, 0.6, 0.7]
    assert bad_frames(per_frame(spark, 8, 2, hd=hd, v=[1.0] * 8, snr=[10.0] * 8)) == {0: {2, 5}, 1: {2, 5}}


def test_every_reason_for_a_bad_frame(spark):
    hd, v, snr = [0.0] * 8, [1.0] * 8, [10.0] * 8
    hd[2], v[5], snr[6] = None, None, 1.0
    listed = spark.createDataFrame([(0, 1, 1), (0, 3, 3), (0, 4, 4)], "cell long, lo long, hi long")
    assert bad_frames(per_frame(spark, 8, hd=hd, v=v, snr=snr), listed) == {0: {1, 2, 3, 4, 5, 6}}


def test_stored_masks_of_each_cell(spark):
    hd = [0.0] * 6
    hd[1] = None
    listed = spark.createDataFrame([(0, 1, 1), (1, 4, 4)], "cell long, lo long, hi long")
    assert bad_frames(per_frame(spark, 6, 2, hd=hd, v=[1.0] * 6, snr=[10.0] * 6), listed) == {0: {1}, 1: {1, 4}}


BURSTS = "cell long, burst long, lo long, hi long, loc long"


@pytest.mark.parametrize(
    ("bursts", "spikes", "want"),
    [
        ([(10, 15, 11), (20, 25, 21), (40, 45, 41), (80, 90, 81)], [9, 12, 14, 20, 23, 44, 50, 85, 86], {12, 20, 44, 85}),
        ([(10, 15, 11), (20, 25, 21), (20, 25, 21), (80, 90, 101), (91, 92, -1)], None, {11, 21}),
        ([(10, 15, 11), (20, 25, 21)], [], set()),
    ],
)
def test_events_of_bursts(spark, bursts, spikes, want):
    b = spark.createDataFrame([(0, i, *x) for i, x in enumerate(bursts)], BURSTS)
    s = None if spikes is None else spark.createDataFrame([(0, f) for f in spikes], "cell long, frame long")
    assert {r.frame for r in I.burst_events(b, s, frames=100).collect()} == want


def test_events_on_bad_frames_go(spark):
    b = spark.createDataFrame([(0, 0, 1, 3, 2), (0, 1, 4, 4, 4), (0, 2, 5, 7, 6)], BURSTS)
    s = spark.createDataFrame([(0, 2), (0, 4), (0, 6)], "cell long, frame long")
    hd = [0.0] * 8
    hd[2] = None
    fr = I.covered(per_frame(spark, 8, hd=hd), spark.createDataFrame([(0, 4, 4)], "cell long, lo long, hi long"), "listed")
    good = fr.where("hd is not null and not listed").select("cell", "frame")
    assert {r.frame for r in I.burst_events(b, s, frames=8).join(good, ["cell", "frame"]).collect()} == {6}


def test_blocks_give_what_the_whole_recording_gives(spark):
    v = np.cumsum(np.random.default_rng(1).standard_normal(9000))
    df = per_frame(spark, 9000, v=v.tolist())
    for how in ({"kind": "high"}, {"kind": "low"}, {"kind": "band", "top": 0.2}):
        by_block, whole = (signals.butterworth(df, "v", "f", 0.05, block=b, **how).orderBy("frame").toPandas().f.to_numpy() for b in (2048, 65536))
        assert np.abs(by_block - whole).max() < 1e-4 * np.ptp(v), how


def test_peaks_against_plain_python(spark):
    g = np.random.default_rng(3)
    v = np.round(np.cumsum(g.standard_normal(600)), 0)
    runs, start = [], 0
    for i in range(1, len(v) + 1):
        if i == len(v) or v[i] != v[start]:
            runs.append((start, i - 1, v[start]))
            start = i
    peaks = [((a + b) // 2, x) for (_, _, p), (a, b, x), (_, _, n) in zip(runs, runs[1:], runs[2:], strict=False) if x > p and x > n and x >= 0]
    kept = []
    for f, x in sorted(peaks, key=lambda q: (-q[1], -q[0])):
        if all(abs(f - k) >= 5 for k, _ in kept):
            kept.append((f, x))
    got = signals.find_peaks(per_frame(spark, 600, v=v.tolist()), "v", 0.0, 5)
    assert sorted((r.frame, r.v) for r in got.collect()) == sorted(kept)


def test_gaps_are_filled_in_linear_time(spark):
    import time

    took = []
    for n in (20_000, 80_000):
        df = spark.range(n).selectExpr("0L AS cell", "id AS frame", "if(id % 3 = 0, null, cast(id as double)) AS v")
        began = time.perf_counter()
        assert S.interpolated(df, "v", "f").where("abs(f - frame) > 1e-6 and frame > 0").count() <= 1
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 2
