"""Maps over position bins: occupancy, rates, information, smoothing, tuning, shuffles, similarity, components."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def occupancy(df: DataFrame, rate: float, *by: str) -> DataFrame:
    """Seconds in each bin."""
    return df.groupBy(*by).agg((F.count(F.lit(1)) / F.lit(rate)).alias("occ"))


def rate_map(df: DataFrame, spike, rate: float, *by: str) -> DataFrame:
    """occ, n and rate of each visited bin; ``spike`` says which frames hold one."""
    m = df.groupBy(*by).agg((F.count(F.lit(1)) / F.lit(rate)).alias("occ"), F.sum(spike.cast("long")).alias("n"))
    return m.withColumn("rate", F.when(F.col("occ") > 0, F.col("n") / F.col("occ")).otherwise(F.lit(0.0)))


def spatial_information(rates: DataFrame, *by: str) -> DataFrame:
    """Bits a second: sum of p r log2(r / mean + 1e-15) over bins, p a bin's share of the time."""
    w = W.partitionBy(*by)
    p = F.col("occ") / F.sum("occ").over(w)
    m = rates.withColumn("p", p).withColumn("mean", F.sum(F.col("p") * F.col("rate")).over(w))
    each = F.when(F.col("mean") > 0, F.col("rate") * F.log2(F.col("rate") / F.col("mean") + 1e-15) * F.col("p")).otherwise(F.lit(0.0))
    return m.groupBy(*by).agg(F.sum(each).alias("info"))


def mean_vector(df: DataFrame, angle: str, weight: str, *by: str) -> DataFrame:
    """mvl and preferred direction of weighted directions in degrees."""
    a = F.radians(angle)
    s = df.groupBy(*by).agg(F.sum(F.col(weight) * F.cos(a)).alias("c"), F.sum(F.col(weight) * F.sin(a)).alias("s"), F.sum(weight).alias("w"))
    some = F.col("w") > 0
    return s.select(*by, F.when(some, F.hypot("c", "s") / F.col("w")).alias("mvl"), F.when(some, F.pmod(F.degrees(F.atan2("s", "c")), F.lit(360.0))).alias("preferred"))


def smoothed(m: DataFrame, sigma: float, n: tuple[int, int], value: str = "value", key: str = "map_id", truncate: float = 4.0) -> DataFrame:
    """Gaussian smoothing of dense maps, 0 beyond the edge: a bin gives its share to each neighbour, two kernels of one axis after each other."""
    reach = int(truncate * sigma + 0.5)
    off = np.arange(-reach, reach + 1)
    k = np.exp(-0.5 * (off / sigma) ** 2)
    k /= k.sum()
    kernel = F.array(*(F.struct(F.lit(int(o)).alias("o"), F.lit(float(w)).alias("w")) for o, w in zip(off, k, strict=True)))
    for axis, size in (("ix", n[0]), ("iy", n[1])):
        other = "iy" if axis == "ix" else "ix"
        spread = m.select(key, other, axis, value, F.explode(kernel).alias("k"))
        spread = spread.select(key, other, (F.col(axis) + F.col("k.o")).alias(axis), (F.col(value) * F.col("k.w")).alias(value))
        m = spread.where(F.col(axis).between(0, size - 1)).groupBy(key, "ix", "iy").agg(F.sum(value).alias(value))
    return m


def peak_normalised(m: DataFrame, value: str, *by: str) -> DataFrame:
    top = F.max(value).over(W.partitionBy(*by))
    return m.withColumn(value, F.when(top > 0, F.col(value) / top).otherwise(F.lit(0.0)))


def weighted_similarity(pairs: DataFrame, a: str, b: str, w: str, *by: str) -> DataFrame:
    """Weighted Pearson and cosine of two values on common bins, bins, and the effective number (sum w)^2 / sum w^2."""
    s = pairs.where(f"{a} is not null and {b} is not null and {w} > 0").groupBy(*by).agg(
        F.sum(w).alias("w"), F.sum(F.col(w) * F.col(a)).alias("wa"), F.sum(F.col(w) * F.col(b)).alias("wb"), F.sum(F.col(w) * F.col(a) * F.col(a)).alias("waa"),
        F.sum(F.col(w) * F.col(b) * F.col(b)).alias("wbb"), F.sum(F.col(w) * F.col(a) * F.col(b)).alias("wab"), F.sum(F.col(w) * F.col(w)).alias("ww"), F.count(F.lit(1)).alias("bins"),
    )
    va, vb = F.col("waa") - F.col("wa") * F.col("wa") / F.col("w"), F.col("wbb") - F.col("wb") * F.col("wb") / F.col("w")
    pearson = F.when((va > 1e-12) & (vb > 1e-12), (F.col("wab") - F.col("wa") * F.col("wb") / F.col("w")) / F.sqrt(va * vb))
    cosine = F.when((F.col("waa") > 0) & (F.col("wbb") > 0), F.col("wab") / F.sqrt(F.col("waa") * F.col("wbb")))
    return s.select(*by, "bins", pearson.alias("pearson"), cosine.alias("cosine"), (F.col("w") * F.col("w") / F.col("ww")).alias("effective_n"))


def circular_shift_rates(df: DataFrame, flag: str, shifts: int, hz: float, key: str, *bins: str) -> DataFrame:
    """(key, bins, shift, occ, n, rate): rate maps of the flag as it is (shift 0) and moved by ``shifts`` steps around the cell's end.

    Steps are spread evenly over 1 to frames - 1.  Where the cell was doesn't depend on the shift, so occupancy is summed once and
    only frames with the flag are moved, to the bins of the frames that they land on.
    """
    sized = df.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(key))).where("__n > 1")
    every = F.explode(F.sequence(F.lit(0), F.lit(shifts)))
    step = F.when(F.col("shift") == 0, 0).otherwise(1 + F.floor((2 * F.col("shift") - 1) * (F.col("__n") - 1) / (2 * shifts)))
    moved = sized.where(F.col(flag)).select(key, "frame", "__n", every.alias("shift")).select(key, "shift", F.pmod(F.col("frame") - step, F.col("__n")).alias("frame"))
    hits = moved.join(sized.select(key, "frame", *bins), [key, "frame"]).groupBy(key, "shift", *bins).agg(F.count(F.lit(1)).alias("n"))
    occ = sized.groupBy(key, *bins).agg((F.count(F.lit(1)) / hz).alias("occ")).withColumn("shift", every)
    out = occ.join(hits, [key, "shift", *bins], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return out.withColumn("rate", F.col("n") / F.col("occ"))


def shuffle_p(scores: DataFrame, value: str, *by: str) -> DataFrame:
    """value of shift 0 and p, the share of other shifts that reach it."""
    real = F.max(F.when(F.col("shift") == 0, F.col(value)))
    s = scores.groupBy(*by).agg(real.alias(value), F.collect_list(F.when(F.col("shift") > 0, F.col(value))).alias("null"))
    return s.select(*by, value, (F.size(F.filter("null", lambda x: x >= F.col(value))) / F.size("null")).alias("p"))


def components(m: DataFrame, flag: str, key: str, diagonal: bool = False) -> DataFrame:
    """(key, ix, iy, component): connected bins of each map, numbered from 1 in row order; 4 neighbours, or 8.

    A map is a bounded grid, so a map is a group; maps are dealt over all tasks.
    """
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + [(1, 1), (1, -1), (-1, 1), (-1, -1)] * diagonal

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        at = set(zip(pdf.ix.tolist(), pdf.iy.tolist(), strict=True))
        found, n = {}, 0
        for start in sorted(at):
            if start in found:
                continue
            n += 1
            found[start], todo = n, deque([start])
            while todo:
                x, y = todo.popleft()
                for dx, dy in steps:
                    near = (x + dx, y + dy)
                    if near in at and near not in found:
                        found[near] = n
                        todo.append(near)
        rows = [(pdf[key].iloc[0], x, y, c) for (x, y), c in sorted(found.items())]
        return pd.DataFrame(rows, columns=[key, "ix", "iy", "component"])

    return m.where(F.col(flag)).groupBy(key).applyInPandas(label, f"{key} long, ix long, iy long, component long")


def ranked_components(parts: DataFrame, key: str) -> DataFrame:
    """Components with peak and area in order: first the one of the highest peak (larger area, lower number), the rest by area."""
    c = parts.groupBy(key, "component").agg(F.max("value").alias("peak"), F.count(F.lit(1)).alias("area"))
    top = F.row_number().over(W.partitionBy(key).orderBy(F.desc("peak"), F.desc("area"), "component"))
    c = c.withColumn("__top", top)
    place = F.row_number().over(W.partitionBy(key).orderBy(F.when(F.col("__top") == 1, 0).otherwise(1), F.desc("area"), F.desc("peak"), "component"))
    return c.withColumn("place", place.cast("long")).drop("__top")


def dilated(m: DataFrame, key: str, radius: int, n: tuple[int, int]) -> DataFrame:
    """Bins within ``radius`` of a bin of the map (a disk), inside the grid."""
    disk = [(x, y) for x in range(-radius, radius + 1) for y in range(-radius, radius + 1) if x * x + y * y <= radius * radius]
    step = F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in disk)))
    out = m.select(key, "ix", "iy", step.alias("d")).select(key, (F.col("ix") + F.col("d.x")).alias("ix"), (F.col("iy") + F.col("d.y")).alias("iy"))
    return out.where(F.col("ix").between(0, n[0] - 1) & F.col("iy").between(0, n[1] - 1)).distinct()


def area_resampled(m: DataFrame, key: str, width: float, new_width: float, n_new: int) -> DataFrame:
    """Values on bins of ``new_width``, each old bin giving by overlapping area; the bins that an old one meets are listed, so no range join is needed."""

    def pieces(axis: str):
        lo, hi = F.col(axis) * width, (F.col(axis) + 1) * width
        first = F.floor(lo / new_width)
        last = F.least(F.ceil(hi / new_width) - 1, F.lit(n_new - 1))
        return F.filter(
            F.transform(F.sequence(first, last), lambda j: F.struct(j.alias("j"), (F.least(hi, (j + 1) * new_width) - F.greatest(lo, j * new_width)).alias("len"))), lambda p: p["len"] > 0
        )

    spread = m.select(key, "value", F.explode(pieces("ix")).alias("a"), "iy").select(key, "value", "a", F.explode(pieces("iy")).alias("b"))
    area = F.col("a.len") * F.col("b.len")
    return spread.groupBy(key, F.col("a.j").alias("ix"), F.col("b.j").alias("iy")).agg((F.sum(F.col("value") * area) / F.sum(area)).alias("value"))
