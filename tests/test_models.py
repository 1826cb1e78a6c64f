"""Models, movies, motion and detectors against dense or looping Python."""

import time
from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framewise.operators import intervals, models, motion, movies, sequence, signals, spiking, statistics

VARIABLES = [models.Variable("P", "p", (4, 3), 2.0), models.Variable("H", "h", (6,), 3.0, circular=True), models.Variable("S", "s", (3,), 1.0)]


def observed(seed=0, n=3000, cells=2):
    g = np.random.default_rng(seed)
    rows = []
    for cell in range(cells):
        p, h, s = g.integers(0, 12, n), g.integers(0, 6, n), g.integers(0, 3, n)
        rate = np.exp(-1.5 + np.cos(p / 2) + (1.2 * np.cos(h) if cell == 0 else 0))
        rows.append(pd.DataFrame({"cell": cell, "frame": np.arange(n), "fold": np.arange(n) * 10 // n, "p": p, "h": h, "s": s, "n": g.poisson(rate)}))
    return pd.concat(rows, ignore_index=True)


def roughness_by_hand(theta, v):
    if len(v.shape) == 1:
        steps = np.diff(theta)
        return v.weight * ((steps**2).sum() + (v.circular and (theta[0] - theta[-1]) ** 2))
    grid = theta.reshape(v.shape[::-1])
    return v.weight * ((np.diff(grid, axis=0) ** 2).sum() + (np.diff(grid, axis=1) ** 2).sum())


@pytest.mark.parametrize("v", VARIABLES)
def test_penalties(spark, v):
    theta = np.random.default_rng(1).standard_normal(v.bins)
    assert theta @ v.penalty() @ theta == pytest.approx(roughness_by_hand(theta, v))
    nx = v.shape[0]
    rows = spark.createDataFrame([(1, i % nx, i // nx, float(t)) for i, t in enumerate(theta)], "k long, ix long, iy long, value double")
    assert v.weight * models.roughness(rows, "value", "k", circular=v.circular).first().roughness == pytest.approx(roughness_by_hand(theta, v))


def test_fits_against_a_dense_optimiser(spark):
    pdf = observed(n=600, cells=1)
    got = {(r.fold, r.model): np.concatenate([np.array(t) for t in r.theta]) for r in models.fits(spark.createDataFrame(pdf), VARIABLES, "n", "fold", 10).collect()}
    assert set(got) == set(product([*range(10), models.ALL], ["P", "H", "S", "PH", "PS", "HS", "PHS"]))
    for fold, name in ((models.ALL, "PHS"), (3, "PH"), (0, "S")):
        train, some = pdf[pdf.fold != fold], [v for v in VARIABLES if v.letter in name]
        x = np.hstack([np.eye(v.bins)[train[v.column]] for v in some])
        parts = np.cumsum([0, *(v.bins for v in some)])

        def cost(theta, x=x, some=some, parts=parts, n=train.n.to_numpy()):
            return (np.exp(x @ theta) - n * (x @ theta)).sum() + 0.5 * sum(roughness_by_hand(theta[a:b], v) for a, b, v in zip(parts, parts[1:], some, strict=False))

        best = cost(got[fold, name])
        g = np.random.default_rng(2)
        assert all(cost(got[fold, name] + step * g.standard_normal(x.shape[1])) > best - 1e-9 for step in (1e-1, 1e-2, 1e-3) for _ in range(30))
        slope = [(cost(got[fold, name] + e) - cost(got[fold, name] - e)) / 2e-5 for e in 1e-5 * np.eye(x.shape[1])]
        assert np.abs(slope).max() < 1e-4


def test_circular_tuning_is_a_model_of_one_variable(spark):
    g = np.random.default_rng(3)
    frames, spikes = g.integers(0, 40, 12), g.integers(0, 15, 12)
    df = spark.createDataFrame([(1, b, int(f), int(n)) for b, (f, n) in enumerate(zip(frames, spikes, strict=True))], "cell long, bin long, frames long, spikes long")
    got = signals.poisson_tuning(df, 12, 0.7).orderBy("bin").toPandas().log_rate
    want = models.fitted(np.arange(12)[:, None], frames.astype(float), spikes.astype(float), [models.Variable("H", "h", (12,), 0.7, circular=True).penalty()])[0]
    slope = frames * np.exp(got) - spikes + models.Variable("H", "h", (12,), 0.7, circular=True).penalty() @ got
    assert np.allclose(got, want, atol=1e-6) and np.abs(slope).max() < 1e-6


def test_selection_finds_what_drives_a_cell(spark):
    df = spark.createDataFrame(observed())
    fits = models.fits(df, VARIABLES, "n", "fold", 10)
    pred = models.predicted(df, fits, VARIABLES, "fold")
    assert pred.count() == 7 * df.count()
    metrics = models.fit_metrics(pred, "n", "frame", 0.02, models.gaussian_weights(2, 4), "cell", "fold", "model")
    got = {r.cell: r for r in models.forward_selection(metrics, VARIABLES).collect()}
    assert (got[0].selected, got[1].selected) == ("PH", "P") and got[0].p_12 < 0.05 <= got[1].p_12
    one = pred.where("cell = 0 and fold = 4 and model = 'PHS'").orderBy("frame").toPandas()
    w = models.gaussian_weights(2, 4)
    rate, told = (np.convolve(c / 0.02, w, "same") for c in (one.n, one.pred))
    m = metrics.where("cell = 0 and fold = 4 and model = 'PHS'").first()
    bits = ((one.n * np.log(one.pred) - one.pred).sum() - (one.n * np.log(one.n.mean()) - one.n.mean()).sum()) / one.n.sum() / np.log(2)
    assert (m.var_explained, m.correlation, m.mse, m.llh_bits_spike) == pytest.approx((1 - ((told - rate) ** 2).sum() / ((rate - rate.mean()) ** 2).sum(), np.corrcoef(rate, told)[0, 1], ((told - rate) ** 2).mean(), bits))


def test_profiles_are_means_over_observations(spark):
    pdf = observed(n=400, cells=1)
    df = spark.createDataFrame(pdf)
    fits = models.fits(df, VARIABLES, "n", None, 0)
    theta = {r.model: [np.array(t) for t in r.theta] for r in fits.collect()}
    got = {(r.model, r.variable, r.bin): r.rate for r in models.profiles(df, fits, VARIABLES, "n", 0.5).collect()}
    p, s = theta["PS"][0][pdf.p], theta["PS"][1]
    assert all(got["PS", "S", b] == pytest.approx((np.exp(p + s[b])).mean() / 0.5) for b in range(3))
    assert got["PS", "H", 2] == pytest.approx(np.exp(p + s[pdf.s]).mean() / 0.5) and len(got) == 7 * 21


def test_one_sided_signed_ranks():
    d = np.array([1.5, -0.3, 2.2, 0.9, -1.1, 3.0, 0.2])
    r = np.argsort(np.argsort(np.abs(d))) + 1
    sums = np.array([sum(r[np.array(s) > 0]) for s in product((1, -1), repeat=len(d))])
    assert statistics.wilcoxon_greater_p(d) == pytest.approx((sums >= r[d > 0].sum()).mean())
    assert statistics.wilcoxon_greater_p(np.zeros(3)) == 1.0 and np.isnan(statistics.wilcoxon_greater_p(np.array([]))) and statistics.wilcoxon_greater_p(-np.abs(d)) == 1.0


def flood(on):
    found, label = {}, {}
    for start in sorted(on):
        if start in label:
            continue
        todo, label[start] = [start], start
        while todo:
            t, y, x = todo.pop()
            for dt, dy, dx in product((-1, 0, 1), repeat=3):
                near = (t + dt, y + dy, x + dx)
                if near in on and near not in label:
                    label[near] = start
                    todo.append(near)
    for v, root in label.items():
        found.setdefault(root, set()).add(v)
    return {frozenset(v) for v in found.values()}


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_components_in_chunks_are_those_of_the_whole(spark, chunk):
    g = np.random.default_rng(4)
    values = g.random((60, 9, 8))
    values[10:40, 4, 4] = 1.0  # a component over many chunks
    on = {tuple(map(int, v)) for v in np.argwhere(values > 0.93)}
    rows = [("m", *map(int, v), float(values[v])) for v in np.ndindex(values.shape)]
    df = spark.createDataFrame(rows, "movie string, t long, y long, x long, value double").withColumn("on", F.col("value") > 0.93)
    parts = movies.components(df, "on", "movie", chunk)
    got = parts.toPandas()
    assert {frozenset(zip(p.t, p.y, p.x, strict=True)) for _, p in got.groupby("component")} == flood(on)
    peaks = {r.component: r for r in movies.component_peaks(parts, "value", "movie", 3, chunk).collect()}
    for c, p in got.groupby("component"):
        assert (c in peaks) == (len(p) >= 3)
        if c in peaks:
            best = p.sort_values(["value", "t", "y", "x"], ascending=[False, True, True, True]).iloc[0]
            assert (peaks[c].t, peaks[c].y, peaks[c].x, peaks[c].owner, peaks[c].voxels) == (best.t, best.y, best.x, best.t // chunk, len(p))


def test_regions_group_greedily(spark):
    g = np.random.default_rng(5)
    rows = [(k, i, float(y), float(x)) for k in range(3) for i, (y, x) in enumerate(g.integers(0, 40, (60, 2)))]
    want = {}
    for k in range(3):
        leaders = []
        for _, i, y, x in (r for r in rows if r[0] == k):
            first = next((j for j, a, b in leaders if np.hypot(y - a, x - b) <= 10), None)
            want[k, i] = i if first is None else first
            if first is None:
                leaders.append((i, y, x))
    got = movies.grouped_regions(spark.createDataFrame(rows, "k long, i long, cy double, cx double"), "k", "i", 10.0)
    assert {(r.k, r.i): r.leader for r in got.collect()} == want


def test_gaps_are_filled_in_order(spark):
    g = np.random.default_rng(6)
    grid = np.where(g.random((5, 7)) < 0.5, g.random((5, 7)), np.nan)
    df = spark.createDataFrame([(3, int(x), int(y), float(grid[y, x])) for y, x in np.argwhere(np.isfinite(grid))], "m long, ix long, iy long, v double")
    want = grid.copy()
    for y, x in np.argwhere(np.isnan(grid)):
        near = [want[min(max(y + a, 0), 4), min(max(x + b, 0), 6)] for a, b in product((-1, 0, 1), repeat=2) if a or b]
        near = [v for v in near if np.isfinite(v)]
        want[y, x] = np.mean(near) if near else np.nan
    got = {(r.iy, r.ix): r.v for r in movies.neighbour_filled(df, "v", "m", (7, 5)).collect()}
    assert np.allclose([got[y, x] for y in range(5) for x in range(7)], want.reshape(-1), equal_nan=True)


def test_drift_comes_back_under_a_lit_cell(spark):
    g = np.random.default_rng(7)
    pattern, alpha = 50 + 20 * g.random((10, 10)), 1 + 0.1 * np.sin(np.arange(30) / 5)
    movie = alpha[:, None, None] * pattern + 0.1 * g.standard_normal((30, 10, 10))
    movie[10:20, 3:6, 3:6] += 60
    df = spark.createDataFrame([(0, int(t), int(y), int(x), float(movie[t, y, x])) for t, y, x in np.ndindex(movie.shape)], "m long, t long, y long, x long, v double")
    shape = spark.createDataFrame([(0, int(y), int(x), float(pattern[y, x])) for y, x in np.ndindex(10, 10)], "m long, y long, x long, pattern double")
    off = lambda rounds: max(abs(r.alpha - alpha[r.t]) for r in movies.drift(df, shape, "v", "m", rounds).collect())
    assert off(0) > 0.03 and off(6) < 0.005
    left = movies.without_drift(df, shape, movies.drift(df, shape, "v", "m", 6), "v", "m", "r").where("y > 6").agg(F.max(F.abs("r"))).first()[0]
    assert left < 1.0


def dense_motion(v, x, good, components, ridge):
    sd = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(sd <= 1e-8, 1, sd)
    _, size, axes = np.linalg.svd(z[good], full_matrices=False)
    k = min(components, int((size > 1e-8).sum()))
    u = z @ axes[:k].T / size[:k]
    fit = good & np.isfinite(v)
    return v - u @ np.linalg.solve(u[fit].T @ u[fit] + ridge * np.eye(k), u[fit].T @ (v[fit] - v[fit].mean()))


@pytest.mark.parametrize(("overlap", "components", "ridge"), [(0, 5, 0.0), (20, 5, 0.0), (50, 2, 0.1)])
def test_motion_against_a_dense_decomposition(spark, overlap, components, ridge):
    g = np.random.default_rng(8)
    n, chunk = 430, 100
    sx, sy = np.cumsum(g.standard_normal((2, n)), axis=1)
    dx, dy = sx - sx.mean(), sy - sy.mean()
    x = np.column_stack((dx, dy, dx * dx, dy * dy, dx * dy))
    v = np.sin(np.arange(n) / 9) + x @ [0.5, -0.2, 0.03, 0.0, 0.1]
    v[g.integers(0, n, 15)] = np.nan
    bad = g.random(n) < 0.1
    want, stride, start = np.zeros(n), chunk - overlap, 0
    while True:
        end = min(start + chunk, n)
        w = np.ones(end - start)
        if start and overlap:
            w[:overlap] = np.linspace(0, 1, overlap)
        if end < n and overlap:
            w[-overlap:] = 1 - np.linspace(0, 1, overlap)
        want[start:end] += w * dense_motion(v[start:end], x[start:end], ~bad[start:end], components, ridge)
        if end == n:
            break
        start += stride
    rows = [(1, i, None if np.isnan(v[i]) else float(v[i]), float(sx[i]), float(sy[i]), bool(bad[i])) for i in range(n)]
    df = motion.with_regressors(spark.createDataFrame(rows, "cell long, frame long, v double, sx double, sy double, bad boolean"), "sx", "sy", "cell")
    got = motion.motion_regressed(df, "v", list(motion.SHIFTS), "out", "cell", chunk=chunk, overlap=overlap, components=components, ridge=ridge, bad="bad").orderBy("frame").toPandas()
    assert np.allclose(got.out, want, atol=1e-9, equal_nan=True)


def test_short_chunks_keep_their_values(spark):
    df = spark.createDataFrame([(1, i, float(i), 1.0 * i) for i in range(3)], "cell long, frame long, v double, x double")
    assert [r.out for r in motion.motion_regressed(df, "v", ["x"], "out", "cell").orderBy("frame").collect()] == [0.0, 1.0, 2.0]


def test_medians_by_blocks(spark):
    g = np.random.default_rng(9)
    v = pd.Series(np.where(g.random(700) < 0.2, np.nan, g.standard_normal(700)))
    df = spark.createDataFrame([(1, i, None if np.isnan(x) else float(x), "keep") for i, x in enumerate(v)], "cell long, frame long, v double, tag string")
    for k in (1, 4, 5, 101):
        want = [np.nanmedian(v[max(0, i - k // 2) : i + k - k // 2]) if v[max(0, i - k // 2) : i + k - k // 2].notna().any() else np.nan for i in range(700)]
        got = sequence.moving_median(df, "v", k, "m", block=50).orderBy("frame").toPandas()
        assert np.allclose(got.m, want, equal_nan=True) and set(got.tag) == {"keep"}
    w = v.fillna(0.0).to_numpy()
    full = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(w)], "cell long, frame long, v double")
    for p in (2, 20):
        wide = np.concatenate((w[:p][::-1], w, w[-p:][::-1]))
        held = np.concatenate((np.full(p, w[0]), w, np.full(p, w[-1])))
        at = lambda a, p=p: [np.median(a[i : i + 2 * p + 1]) for i in range(700)]
        assert np.allclose(sequence.median_edge(full, "v", 2 * p + 1, "m", block=60).orderBy("frame").toPandas().m, at(wide))
        assert np.allclose(sequence.median_highpass(full, "v", 2 * p + 1, "m", block=60).orderBy("frame").toPandas().m, w - at(held))


def test_spectrum_and_filter_against_their_definition():
    g = np.random.default_rng(10)
    v, spikes, half, size = g.standard_normal(60), np.array([10, 30, 45]), 2, 64
    noise = v[[i for i in range(60) if min(abs(i - spikes)) > half]]
    m = len(noise)
    window = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(m) / m)
    turn = np.exp(-2j * np.pi * np.outer(np.arange(size), np.arange(size)) / size)
    power = np.abs(turn[:, :m] @ (noise * window)) ** 2 / (2 * np.pi * (window**2).sum())
    power[1 : size // 2] *= 2
    power[size // 2 + 1 :] *= 2
    white = (turn.conj() @ (turn[:, :60] @ v / np.sqrt(power))).real / size
    shape = np.mean([white[s - half : s + half + 1] for s in spikes], axis=0)
    want = [sum(shape[j + half] * white[i + j] for j in range(-half, half + 1) if 0 <= i + j < size) for i in range(60)]
    assert np.allclose(spiking.matched_filter(v, spikes, half), want)


def threshold_by_hand(pks, p, least):
    lo, hi = min(pks), max(pks)
    at = np.linspace(lo - 0.05 * (hi - lo), hi + 0.05 * (hi - lo), 2001)
    width = np.std(pks, ddof=1) * len(pks) ** -0.2
    f = np.array([np.exp(-0.5 * ((a - np.array(pks)) / width) ** 2).sum() for a in at])
    c = next(i for i, a in enumerate(at) if a > np.median(pks))
    m = [*f[: c + 1], *f[:c][::-1]]
    m = np.array((m + [min(m)] * len(f))[: len(f)])
    cf, cm = np.cumsum(f) / f.sum(), np.cumsum(m) / max(f.sum(), m.sum())
    last = next((i for i in range(len(f) - 2) if cf[i] > cm[i] + np.spacing(1) and cf[i + 1] < cm[i + 1]), c)
    m[: last + 1] = f[: last + 1]
    m[last:] = np.minimum(m[last:], f[last:])
    s, b = f.sum() - np.cumsum(f), m.sum() - np.cumsum(m)
    height = at[np.argmax(np.maximum(s, 0) ** p - np.maximum(b, 0) ** p)]
    return height if (np.array(pks) > height).sum() >= least else np.percentile(pks, 100 * (1 - least / len(pks)))


def test_adaptive_threshold():
    g = np.random.default_rng(11)
    for seed in range(5):
        pks = np.concatenate((3 + g.standard_normal(3000), 12 + g.standard_normal(60 + seed)))
        height, false, found, few = spiking.adaptive_threshold(pks, 0.5, 5)
        assert height == pytest.approx(threshold_by_hand(pks, 0.5, 5)) and 5.5 < height < 12 and not few and false < 0.1 and found > 0.9
    height, _, _, few = spiking.adaptive_threshold(np.arange(20.0), 0.5, 30)
    assert few and height == 0.0
    height, _, _, few = spiking.adaptive_threshold(np.arange(20.0), 0.5, 1, 2)
    assert not few and height == pytest.approx(np.percentile(np.arange(20.0), 90))
    assert np.isnan(spiking.adaptive_threshold(np.array([]))[0]) and spiking.adaptive_threshold(np.ones(4))[3]


def test_planted_spikes_are_found_by_segments(spark):
    g = np.random.default_rng(12)
    n, size = 9000, 3000
    v = g.standard_normal(n) + 2 * np.sin(np.arange(n) / 400)
    planted = np.sort(g.choice(np.arange(50, n - 50, 60), 90, replace=False))
    for t in planted:
        v[t - 1 : t + 3] += np.array([3.0, 9.0, 5.0, 2.0])
    rows = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "cell long, frame long, v double")
    seeds = spark.createDataFrame([(1, int(t)) for t in planted[::2]], "cell long, frame long")
    got = spiking.refined_spikes(rows, "v", seeds, size, 7, 3).toPandas()
    for k in range(3):
        own, found = planted[planted // size == k], got[got.segment == k].frame.to_numpy()
        hit = [t for t in own if np.abs(found - t).min() <= 1]
        wrong = [f for f in found if np.abs(own - f).min() > 1]
        assert len(hit) >= 0.95 * len(own) and len(wrong) <= 0.05 * len(found)
    assert spiking.refined_spikes(rows, "v", None, size, 1, 3).count() > 0


def test_last_segment_joins_if_short(spark):
    df = spark.createDataFrame([(c, i, 0.0) for c, n in ((1, 95), (2, 81), (3, 10)) for i in range(n)], "cell long, frame long, v double")
    got = spiking.unsegmented(spiking.segmented(df, 30), 30, "long", "frame").groupBy("cell", "segment").agg(F.min("frame"), F.max("frame")).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 29), (1, 1, 30, 59), (1, 2, 60, 94), (2, 0, 0, 29), (2, 1, 30, 59), (2, 2, 60, 80), (3, 0, 0, 9)]


def test_brackets():
    lows, deep = [5, 12, 20, 33], [-1.0, -2.0, -0.5, -3.0]
    assert spiking.bracketed([8, 25], lows, deep, 50, 1, 100) == [(5, 12, 8), (20, 33, 25)]
    assert spiking.bracketed([3], lows, deep, 50, 1, 100) == [(2, 5, 3)] and spiking.bracketed([40], lows, deep, 50, 4, 100) == [(33, 40, 40)]
    # a bracket lengthened over the next peak is cut at the trough between them; the next peak is bracketed again from there on
    assert spiking.bracketed([8, 16], lows, deep, 50, 14, 100)[:1] != [(5, 12, 8)]
    assert spiking.bracketed([8, 16], lows, deep, 50, 5, 6) == [(5, 11, 8), (12, 18, 16)]
    assert spiking.peak_prominence(np.array([0.0, 3, 1, 2, 1.5, 4, 0]), 3) == 0.5


#: Bursts of given frames and complex spikes in a trace of 100 frames, and the events that come of them.
WINDOWS, COMPLEX = [(10, 15, 11), (20, 25, 21), (40, 45, 41), (80, 90, 81)], [9, 12, 14, 20, 23, 44, 50, 85, 86]


def test_burst_events_from_a_trace(spark):
    v = np.zeros(100)
    for lo, hi, loc in WINDOWS:
        v[lo : hi + 1] = 5.0
        v[loc] = 9.0
    trace = spark.createDataFrame([("1:0", i, float(x)) for i, x in enumerate(v)], "cell string, frame long, v double")
    peaks = sequence.plateau_peaks(trace, "v", 4.0)
    found = spiking.burst_features(spiking.brackets_by_crossings(trace, "v", peaks, spark.createDataFrame([("1:0", 4.0)], "cell string, height double"), 50), trace, "v")
    assert sorted((r.lo, r.hi, r.loc, r.top, r.baseline) for r in found.collect()) == [(lo, hi, loc, 9.0, 0.0) for lo, hi, loc in WINDOWS]
    bursts = found.withColumn("burst", F.col("lo"))
    at = lambda spikes: sorted(r.frame for r in intervals.burst_events(bursts, spikes, frames=100).collect())
    given = lambda some: spark.createDataFrame([("1:0", f) for f in some], "cell string, frame long")
    assert at(given(COMPLEX)) == [12, 20, 44, 85] and at(None) == [11, 21, 41, 81] and at(given([])) == []


@pytest.mark.parametrize("method", ["troughs", "crossings"])
def test_planted_bursts_are_found_from_a_raw_trace(spark, method):
    g = np.random.default_rng(13)
    n, rate = 12000, 500.0
    v = 0.3 * g.standard_normal(n)
    centres = np.arange(400, n - 400, 700)
    for t in centres:
        v[t - 25 : t + 26] += 6 * np.hanning(51)
        v[[t - 8, t, t + 8]] += 6
    rows = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "cell long, frame long, v double")
    spikes = spark.createDataFrame([(1, int(t + k)) for t in centres for k in (-8, 0, 8)], "cell long, frame long")
    got = spiking.complex_bursts(rows, "v", spikes, rate, 12, method=method, mads=8 if method == "crossings" else 3).toPandas()
    held = [any((got.lo <= t) & (got.hi >= t)) for t in centres]
    assert np.mean(held) >= 0.9 and len(got) <= 1.3 * len(centres) and (got.amplitude > 2).mean() > 0.8 and set(got.segment) == {0, 1}


def test_guarded_runs_are_filtered_by_themselves(spark):
    g = np.random.default_rng(14)
    v, good = np.cumsum(g.standard_normal(300)), g.random(300) > 0.03
    rows = [(5, i, float(v[i]), bool(good[i])) for i in range(300)]
    got = signals.guarded_highpass(spark.createDataFrame(rows, "cell long, frame long, v double, good boolean"), "v", "good", "f", 0.05, 3).orderBy("frame").toPandas().f
    ratio = lambda f: 1 / (1 + (np.tan(np.pi * np.minimum(f, 0.4999999)) / np.tan(np.pi * 0.05)) ** 10)
    want, lo = np.full(300, np.nan), 0
    for i in range(301):
        if i == 300 or not good[i]:
            if i > lo:
                part = signals._filtered(v[lo:i], lambda f: 1 - ratio(f))
                want[lo + 3 : max(lo + 3, i - 3)] = part[3 : max(3, i - lo - 3)]
            lo = i + 1
    assert len(got) == 300 and np.allclose(got, want, equal_nan=True)


def test_two_rounds_tell_simple_from_complex(spark):
    g = np.random.default_rng(15)
    n, rate = 6000, 500.0
    v = 0.3 * g.standard_normal(n)
    bursts, lone = np.arange(500, n - 300, 900), np.arange(900, n - 300, 900)
    for t in bursts:
        v[t - 30 : t + 31] += 8 * np.hanning(61)
        v[[t - 8, t, t + 8]] += 8
    v[lone] += 9
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "cell long, frame long, v double")
    got = spiking.two_rounds(df, "v", rate, 12, 21, 5, 6, 4, burst_mads=8).toPandas()
    complex_, simple = set(got[got.kind == "complex"].frame), set(got[got.kind == "simple"].frame)
    assert {t for b in bursts for t in (b - 8, b, b + 8)} <= complex_ | simple and set(lone) <= simple and sum(b in complex_ for b in bursts) >= len(bursts) - 1 and not complex_ & simple


def _events(spark, folder, values):
    rows = [(i, f"2024-01-01 00:00:{i:02d}", 1, "view", float(v), '{"k": 3}') for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.to_timestamp_ntz("ts")).coalesce(1).write.parquet(f"{folder}/wide")
    (part,) = [p for p in folder.joinpath("wide").iterdir() if p.suffix == ".parquet"]
    part.rename(folder / "events.parquet")
    return str(folder)


#: Two equal values in a row over both heights, then single peaks.
FLAT = [10, 200, 200, 10, 10, 300, 10, 20, 10, 12, 11, 250, 240, 10, 9, 8, 7, 180, 6, 5]


@pytest.mark.parametrize("name", ["g7_simple_refinement", "g8_bursts_by_crossings"])
def test_equal_neighbours_are_no_peaks_of_the_sql(spark, tmp_path, name):
    from __spark_entry__ import oracle_sql, queries
    from tests.compare import rows, sql_rows

    d = _events(spark, tmp_path, FLAT)
    want = rows(sql_rows(d, oracle_sql()[name]))
    assert want and rows(queries()[name](spark, d).toPandas()) == want


def test_many_cells_are_fitted_together(spark):
    """A cell and a fold were a task's group each before: these fits took over a minute."""
    pdf = observed(n=60, cells=1)
    df = spark.createDataFrame(pdf).crossJoin(spark.range(400).withColumnRenamed("id", "k")).withColumn("cell", F.col("k")).drop("k")
    began = time.time()
    got = models.fits(df, VARIABLES, "n", "fold", 10).toPandas()
    assert time.time() - began < 40 and len(got) == 400 * 11 * 7
    train = pdf[pdf.fold != 3]
    want = models.fitted(train[["p", "h"]].to_numpy(np.int64), np.ones(len(train)), train.n.to_numpy(float), [v.penalty() for v in VARIABLES[:2]])
    for cell in (0, 399):
        (theta,) = got[(got.cell == cell) & (got.fold == 3) & (got.model == "PH")].theta
        total = np.array(theta[0])[:, None] + np.array(theta[1])[None, :]
        assert total == pytest.approx(want[0][:, None] + want[1][None, :], abs=1e-6)


def test_rounds_of_grouping_write_open_regions_only(spark, monkeypatch):
    """Each round wrote all regions before."""
    g = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": 0, "i": np.arange(400), "cy": g.random(400) * 20, "cx": g.random(400) * 20})
    written, keep = [], movies.stored

    def counted(df, tag):
        out = keep(df, tag)
        written.append((tag, out.count()))
        return out

    monkeypatch.setattr(movies, "stored", counted)
    got = {r.i: r.leader for r in movies.grouped_regions(spark.createDataFrame(pdf), "k", "i", 2.0).collect()}
    leaders, want = [], {}
    for r in pdf.itertuples():
        want[r.i] = next((j for j in leaders if np.hypot(pdf.cy[j] - r.cy, pdf.cx[j] - r.cx) <= 2.0), r.i)
        leaders += [r.i] * (want[r.i] == r.i)
    assert got == want
    assert sum(n for tag, n in written if tag == "leaders") == len(leaders)


@pytest.mark.parametrize("width", [0.001, 1e-9])
def test_exact_percentiles_by_brackets(spark, monkeypatch, width):
    """Also where brackets are too narrow at first, and where one value is most of a group."""
    monkeypatch.setattr(movies, "BRACKET", width)
    g = np.random.default_rng(6)
    pdf = pd.DataFrame({"k": np.repeat([1, 2, 3], [5000, 4000, 1]), "v": np.concatenate((g.standard_normal(5000), np.minimum(g.integers(0, 3000, 4000), 700), [4.5]))})
    got = {r.k: (r.a, r.b, r.c) for r in movies.exact_percentiles(spark.createDataFrame(pdf), "v", {"a": 0.01, "b": 0.5, "c": 0.99}, "k").collect()}
    want = {k: tuple(np.quantile(x, [0.01, 0.5, 0.99])) for k, x in pdf.groupby("k").v}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_scored_peaks_are_those_of_each_round(spark):
    """Rounds at several heights come from one running median."""
    from framewise.operators import detectors

    g = np.random.default_rng(8)
    df = spark.createDataFrame(pd.DataFrame({"cell": np.repeat([1, 2], 300), "frame": np.tile(np.arange(300), 2), "v": g.standard_normal(600)}))
    rounds = {"low": 0.5, "high": 2.0}
    got = detectors.scored_peaks(df, "v", 11, 100, rounds).toPandas()
    for name, mads in rounds.items():
        want = detectors.first_round(df, "v", 11, 100, mads).toPandas()
        assert len(want) and set(zip(want.cell, want.frame, strict=True)) == set(zip(got[got[name]].cell, got[got[name]].frame, strict=True))


def test_stored_peaks_are_not_broadcast(spark):
    """Files of peaks under 10 MB went through the driver as broadcasts before, however many rows they held."""
    peaks = spiking.stored_rows(spark.range(50).select(F.col("id").cast("string").alias("cell"), F.col("id").alias("frame")), "test-peaks")
    one = spark.range(2000).select(F.col("id").cast("string").alias("cell"))
    for joined in (one.join(peaks, "cell"), one.join(peaks.groupBy("cell").agg(F.max("frame").alias("frame")), "cell"), one.join(peaks.where("frame > 3").select("cell"), "cell", "left")):
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
