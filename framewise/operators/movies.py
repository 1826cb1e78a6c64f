"""Movies as rows (movie, t, y, x, value): components in time and space, static patterns and their drift, grouping of regions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewise.operators.links import smallest_labels
from framewise.scratch import stored

#: Bits of a voxel's number for y and for x; the rest is for t.
SIDE_BITS = 15


def voxel(t: Column, y: Column, x: Column) -> Column:
    """A number that grows with t, then y, then x (each side of a frame under 2^15, t under 2^33)."""
    return F.shiftleft(t.cast("long"), 2 * SIDE_BITS) + F.shiftleft(y.cast("long"), SIDE_BITS) + x.cast("long")


def label_voxels(t: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each voxel the number of the first voxel (in order of t, y, x) among those that it is connected with, corners counting."""
    order = np.lexsort((x, y, t))
    t, y, x = t[order], y[order], x[order]
    code = (t << 2 * SIDE_BITS) + (y << SIDE_BITS) + x
    ends = []
    for dt, dy, dx in [(0, 0, 1), (0, 1, -1), (0, 1, 0), (0, 1, 1)] + [(1, dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]:
        ok = (y + dy >= 0) & (x + dx >= 0)
        want = code + (dt << 2 * SIDE_BITS) + (dy << SIDE_BITS) + dx
        at = np.minimum(np.searchsorted(code, want), len(code) - 1)
        hit = np.flatnonzero((code[at] == want) & ok)
        ends.append(np.stack((hit, at[hit])))
    a, b = np.concatenate(ends, axis=1)
    label = np.arange(len(code))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = np.empty(len(code), np.int64)
    out[order] = code[label]
    return out


def components(movie: DataFrame, flag: str, key: str, chunk: int = 1000) -> DataFrame:
    """``movie`` (key, t, y, x, ...) where ``flag`` holds, with component: the number (``voxel``) of the first voxel of those connected in time and space, corners counting.

    Voxels are labelled in chunks of frames, each in a task; where voxels of two chunks touch at a seam, their labels make an edge, and
    labels that edges connect become one.  Components may be as long as the movie.
    """
    kind = movie.schema[key].dataType.simpleString()
    on = movie.where(F.col(flag)).withColumn("__chunk", F.floor(F.col("t") / chunk))
    names = [c for c in movie.columns]

    def label(part: pa.Table) -> pa.Table:
        t, y, x = (part.column(c).cast(pa.int64()).to_numpy() for c in ("t", "y", "x"))
        return part.select([*names, "__chunk"]).append_column("__label", pa.array(label_voxels(t, y, x)))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in movie.schema.fields)
    parts = stored(on.groupBy(key, "__chunk").applyInArrow(label, f"{fields}, __chunk long, __label long"), "voxel-labels")
    last, first = parts.where(F.pmod("t", F.lit(chunk)) == chunk - 1), parts.where(F.pmod("t", F.lit(chunk)) == 0)
    step = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1))))
    reach = last.select(F.col(key).alias("k"), (F.col("t") + 1).alias("t"), "y", "x", F.col("__label").alias("la"), step.alias("s")).select("k", "t", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "la")
    seams = reach.join(first.select(F.col(key).alias("k"), "t", "y", "x", F.col("__label").alias("lb")), ["k", "t", "y", "x"])
    edges = seams.select(F.struct(F.col("k").cast(kind).alias("k"), F.col("la").alias("v")).alias("a"), F.struct(F.col("k").cast(kind).alias("k"), F.col("lb").alias("v")).alias("b"))
    became = smallest_labels(edges).select(F.col("id.k").alias(key), F.col("id.v").alias("__label"), F.col("label.v").alias("__to"))
    return parts.join(became, [key, "__label"], "left").select(*movie.columns, F.coalesce("__to", "__label").alias("component"))


def component_peaks(parts: DataFrame, value: str, key: str, least: int, chunk: int) -> DataFrame:
    """(key, component, voxels, first_t, last_t, t, y, x, peak, owner): components of at least ``least`` voxels with their highest voxel (the first of equals) and the chunk that it lies in."""
    best = F.max_by(F.struct("t", "y", "x", F.col(value).alias("peak")), F.struct(F.col(value), -voxel(F.col("t"), F.col("y"), F.col("x"))))
    g = parts.groupBy(key, "component").agg(F.count(F.lit(1)).alias("voxels"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), best.alias("b")).where(F.col("voxels") >= least)
    return g.select(key, "component", "voxels", "first_t", "last_t", "b.t", "b.y", "b.x", "b.peak", F.floor(F.col("b.t") / chunk).cast("long").alias("owner"))


def coarse_events(movie: DataFrame, value: str, key: str, sds: float, least: int, chunk: int = 1000) -> DataFrame:
    """``component_peaks`` of the voxels over ``sds`` standard deviations of their pixel's values."""
    noise = movie.groupBy(key, "y", "x").agg(F.stddev_pop(value).alias("__sd"))
    on = movie.join(noise, [key, "y", "x"]).withColumn("__on", F.col(value) > sds * F.col("__sd")).drop("__sd")
    return component_peaks(components(on, "__on", key, chunk), value, key, least, chunk)


#: Accuracy of the sketch that brackets a percentile, and its bracket's half width in shares of the rows.
SKETCH, BRACKET = 10000, 0.001


def exact_percentiles(df: DataFrame, value: str, shares: dict[str, float], *by: str) -> DataFrame:
    """(by, a column of each name): exact percentiles of the known values (null without any), on the line between the two ranks around the share.

    A sketch brackets each percentile by two values of the group.  Rows below the bracket are counted, distinct values inside of it are
    counted one by one and ordered, so no task holds a group's values.  Where a rank lies beyond its bracket, the bracket is widened, at last to all values.
    """
    known = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))
    names, width, found, todo = list(shares), BRACKET, None, None
    while True:
        at = lambda q: F.percentile_approx("__v", F.lit(min(max(q, 0.0), 1.0)), F.lit(SKETCH))
        ends = [(at(q - width) if q > width else F.min("__v")).alias(f"__lo{i}") for i, q in enumerate(shares.values())] + [(at(q + width) if q + width < 1 else F.max("__v")).alias(f"__hi{i}") for i, q in enumerate(shares.values())]
        part = known if todo is None else known.join(todo, list(by))
        brackets = stored(part.groupBy(*by).agg(*ends, F.count(F.lit(1)).alias("__n")), "brackets")
        low = stored(part.join(brackets, list(by)).groupBy(*by).agg(*(F.sum((F.col("__v") < F.col(f"__lo{i}")).cast("long")).alias(f"__b{i}") for i in range(len(names)))), "below-brackets")
        inside = part.join(brackets, list(by)).select(*by, "__v", F.explode(F.array(*(F.when(F.col("__v").between(F.col(f"__lo{i}"), F.col(f"__hi{i}")), F.lit(i)) for i in range(len(names))))).alias("__i")).where("__i is not null")
        counts = inside.groupBy(*by, "__i", "__v").agg(F.count(F.lit(1)).alias("__c"))
        upto = F.sum("__c").over(W.partitionBy(*by, "__i").orderBy("__v").rowsBetween(W.unboundedPreceding, 0))
        of = F.element_at(F.array(*(F.col(f"__b{i}") for i in range(len(names)))), F.col("__i") + 1)
        share = F.element_at(F.array(*(F.lit(float(q)) for q in shares.values())), F.col("__i") + 1)
        ranked = counts.join(brackets.select(*by, "__n").join(low, list(by)), list(by)).withColumn("__to", upto + of).withColumn("__rank", share * (F.col("__n") - 1))
        #: The first value that reaches rank floor(r), and rank ceil(r), counted from 0.
        reach = lambda r: F.min(F.when(F.col("__to") > r("__rank"), F.col("__v")))
        told = ranked.groupBy(*by, "__i").agg(reach(F.floor).alias("__a"), reach(F.ceil).alias("__z"), F.first("__rank").alias("__rank"), F.min(F.col("__to") - F.col("__c")).alias("__from"))
        value_ = F.when(F.col("__from") <= F.floor("__rank"), F.when(F.col("__a") == F.col("__z"), F.col("__a")).otherwise(F.col("__a") + (F.col("__z") - F.col("__a")) * (F.col("__rank") - F.floor("__rank"))))
        got = stored(told.groupBy(*by).agg(*(F.max(F.when(F.col("__i") == i, value_)).alias(n) for i, n in enumerate(names))), "percentiles")
        whole = " and ".join(f"{n} is not null" for n in names)
        found = got.where(whole) if found is None else found.unionByName(got.where(whole))
        todo = got.where(f"not ({whole})").select(*by)
        if width >= 1 or todo.isEmpty():
            return df.select(*by).distinct().join(found, list(by), "left")
        width *= 32


def static_pattern(movie: DataFrame, value: str, key: str, q: float = 0.5) -> DataFrame:
    """(key, y, x, pattern): the percentile of each pixel over time."""
    return exact_percentiles(movie, value, {"pattern": q}, key, "y", "x")


def drift(movie: DataFrame, pattern: DataFrame, value: str, key: str, rounds: int = 0, scale: float = 1.0) -> DataFrame:
    """(key, t, alpha): how much of the pattern each frame holds, sum(w v p) / sum(w p p) over its pixels.

    Without ``rounds`` all weights are 1.  In each round a pixel is weighed by 1 / sqrt(1 + (residual / (scale * s))^2), s the frame's median
    absolute residual / 0.6745, so that pixels with something of their own (a cell that lights up) count less: the minimum of the soft-L1 loss.
    """
    both = movie.join(pattern, [key, "y", "x"]).where(F.col(value).isNotNull())
    v, p = F.col(value), F.col("pattern")
    alpha = both.groupBy(key, "t").agg((F.sum(v * p) / F.sum(p * p)).alias("alpha"))
    for _ in range(rounds):
        rest = both.join(alpha, [key, "t"]).withColumn("__r", v - F.col("alpha") * p)
        spread = rest.groupBy(key, "t").agg((F.percentile(F.abs("__r"), 0.5) / 0.6745).alias("__s"))
        w = F.when(F.col("__s") > 0, 1 / F.sqrt(1 + (F.col("__r") / (scale * F.col("__s"))) ** 2)).otherwise(F.lit(1.0))
        alpha = stored(rest.join(spread, [key, "t"]).withColumn("__w", w).groupBy(key, "t").agg((F.sum(F.col("__w") * v * p) / F.sum(F.col("__w") * p * p)).alias("alpha")), "drift")
    return alpha


def without_drift(movie: DataFrame, pattern: DataFrame, alpha: DataFrame, value: str, key: str, out: str) -> DataFrame:
    """``movie`` with ``out``: the value less the frame's share of the pattern."""
    return movie.join(pattern, [key, "y", "x"]).join(alpha, [key, "t"]).withColumn(out, F.col(value) - F.col("alpha") * F.col("pattern")).drop("pattern", "alpha")


def flat_fielded(movie: DataFrame, pattern: DataFrame, value: str, key: str, out: str, dark: float = 0.0, eps: float = 1e-6) -> DataFrame:
    """``movie`` with ``out``: (value - dark) / (pattern + eps) times the pattern's median."""
    mid = pattern.groupBy(key).agg(F.percentile("pattern", 0.5).alias("__mid"))
    return movie.join(pattern, [key, "y", "x"]).join(mid, key).withColumn(out, (F.col(value) - dark) / (F.col("pattern") + eps) * F.col("__mid")).drop("pattern", "__mid")


def grouped_regions(regions: DataFrame, key: str, ident: str, distance: float) -> DataFrame:
    """``regions`` (key, ident, cy, cx) with leader: greedy groups in order of ident, each region in the group of the first leader at most ``distance`` away, or a leader itself.

    Neighbours meet over cells of a grid as wide as the distance, not in a cross join, each pair once: a region goes to its own cell and the four ahead
    of it.  A region leads as soon as no earlier neighbour is open or leads, and follows once one leads; pairs with a decided region go, so each round's
    written table is smaller than the last one's.  Whom a region follows is looked up once all leaders are known.
    """
    cell = lambda c: F.floor(F.col(c) / distance).cast("long")
    own = regions.select(key, ident, "cy", "cx", cell("cy").alias("gy"), cell("cx").alias("gx"))
    ahead = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1)))))
    spread = own.select(key, F.col(ident).alias("__b"), F.col("cy").alias("__y"), F.col("cx").alias("__x"), "gy", "gx", ahead.alias("__s"))
    spread = spread.select(key, "__b", "__y", "__x", (F.col("gy") + F.col("__s.dy")).alias("gy"), (F.col("gx") + F.col("__s.dx")).alias("gx"), ((F.col("__s.dy") == 0) & (F.col("__s.dx") == 0)).alias("__same"))
    #: Pairs in one cell are met twice and kept once.
    met = own.join(spread, [key, "gy", "gx"]).where((F.hypot(F.col("cy") - F.col("__y"), F.col("cx") - F.col("__x")) <= distance) & (F.col("__b") != F.col(ident)) & (~F.col("__same") | (F.col("__b") < F.col(ident))))
    near = stored(met.select(key, F.greatest(ident, "__b").alias(ident), F.least(ident, "__b").alias("__to")), "near-regions")
    leaders = stored(regions.select(key, ident).join(near.select(key, ident).distinct(), [key, ident], "left_anti"), "leaders")
    new, open_ = leaders, near
    while True:
        heads = new.select(key, F.col(ident).alias("__to"))
        follow = stored(open_.join(heads, [key, "__to"], "left_semi").select(key, ident).distinct(), "followers")
        left = open_.join(follow, [key, ident], "left_anti")
        rest = stored(left.join(follow.select(key, F.col(ident).alias("__to")), [key, "__to"], "left_anti"), "open-regions")
        #: Open regions whose earlier neighbours all follow lead.
        new = stored(left.select(key, ident).distinct().join(rest.select(key, ident).distinct(), [key, ident], "left_anti"), "leaders")
        if new.isEmpty():
            break
        leaders, open_ = leaders.unionByName(new), rest
    first = near.join(leaders.select(key, F.col(ident).alias("__to")), [key, "__to"]).join(leaders, [key, ident], "left_anti").groupBy(key, ident).agg(F.min("__to").alias("leader"))
    return regions.join(first.unionByName(leaders.select(key, ident, F.col(ident).alias("leader"))), [key, ident])


def neighbour_filled(m: DataFrame, value: str, key: str, n: tuple[int, int]) -> DataFrame:
    """(key, ix, iy, value) of all bins of ``n`` columns and rows; gaps take the mean of the known bins around them, swept in row order, so that a filled bin counts for the next gaps.

    Bins beyond the edge are those of the edge itself, as many times as they are met.  A map is a bounded grid and a task's group;
    ``m`` has ix (column) and iy (row).
    """
    nx, ny = n
    kind = m.schema[key].dataType.simpleString()

    def fill(part: pa.Table) -> pa.Table:
        grid = np.full((ny, nx), np.nan)
        ix, iy = (part.column(c).cast(pa.int64()).to_numpy() for c in ("ix", "iy"))
        grid[iy, ix] = part.column(value).cast(pa.float64()).to_numpy(zero_copy_only=False)
        for r, c in np.argwhere(~np.isfinite(grid)):
            rows, columns = np.clip(np.arange(r - 1, r + 2), 0, ny - 1), np.clip(np.arange(c - 1, c + 2), 0, nx - 1)
            around = np.delete(grid[np.ix_(rows, columns)].reshape(-1), 4)
            if np.isfinite(around).any():
                grid[r, c] = around[np.isfinite(around)].mean()
        rows, columns = np.indices(grid.shape).reshape(2, -1)
        whose = pa.array([part.column(key)[0].as_py()] * grid.size, part.schema.field(key).type)
        return pa.table([whose, pa.array(columns), pa.array(rows), pa.array(grid.reshape(-1), from_pandas=True)], names=[key, "ix", "iy", value])

    return m.select(key, "ix", "iy", value).groupBy(key).applyInArrow(fill, f"{key} {kind}, ix long, iy long, {value} double")


def display_range(movie: DataFrame, value: str, key: str, low: float, high: float, top: int = 65535) -> DataFrame:
    """``movie`` with shown: values between two percentiles of the movie stretched to 0 to ``top``, whole numbers."""
    ends = exact_percentiles(movie, value, {"__lo": low, "__hi": high}, key)
    share = F.when(F.col("__hi") > F.col("__lo"), (F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(F.lit(0.0))
    return movie.join(ends, key).withColumn("shown", F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * top).cast("long")).drop("__lo", "__hi")


def concatenated(sessions: DataFrame, key: str, session: str, frame: str, dropped: int) -> DataFrame:
    """``sessions`` rows without the first ``dropped`` frames of each session, with at: their frame in the sessions put one after the other."""
    sizes = sessions.groupBy(key, session).agg((F.max(frame) + 1 - dropped).alias("__n")).where("__n > 0")
    edges = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(W.partitionBy(key).orderBy(session).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return sessions.where(F.col(frame) >= dropped).join(edges, [key, session]).withColumn("at", (F.col("__start") + F.col(frame) - dropped).cast("long")).drop("__n", "__start")


def concatenation_edges(sessions: DataFrame, key: str, session: str, frame: str, dropped: int) -> DataFrame:
    """(key, session, start, end) of the sessions put one after the other; ``end`` is the next one's start."""
    at = concatenated(sessions, key, session, frame, dropped)
    return at.groupBy(key, session).agg(F.min("at").alias("start"), (F.max("at") + 1).alias("end"))
