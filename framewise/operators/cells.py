"""Cells over sessions: gates, lookups, fields, tuning, poses; small rules that pooled analyses share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewise.operators.grids import circular_shift_rates, mean_vector, rate_map, shuffle_p, spatial_information
from framewise.operators.sequence import KEY, average_rank


def in_all_sessions(df: DataFrame, condition: Column, sessions: int = 2) -> DataFrame:
    """(cell): cells for which the condition holds in at least ``sessions`` sessions."""
    return df.where(condition).groupBy(KEY).agg(F.countDistinct("session").alias("__n")).where(F.col("__n") >= sessions).select(KEY)


def rank_correlation(df: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """(by, rho): correlation of average ranks of rows that hold both values; null where one of them is constant.

    Covariance over the product of standard deviations, from sums of whole numbers (twice the ranks), so the order of rows doesn't show in rho.
    """
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = average_rank(average_rank(both, a, "__ra", *by), b, "__rb", *by)
    twice = {c: (2 * F.col(c)).cast("decimal(13,0)") for c in ("__ra", "__rb")}
    n = F.count(F.lit(1)).cast("decimal(10,0)")
    # twice the ranks of n rows add up to n (n + 1), with ties or without
    moment = lambda x, y: (F.sum(twice[x] * twice[y]) - n * (n + 1) * (n + 1)).cast("double") / (4 * n).cast("double")
    g = ranked.groupBy(*by).agg(moment("__ra", "__rb").alias("__c"), moment("__ra", "__ra").alias("__va"), moment("__rb", "__rb").alias("__vb"))
    return g.select(*by, (F.col("__c") / F.nullif(F.sqrt("__va") * F.sqrt("__vb"), F.lit(0.0))).alias("rho"))


def named_condition(c: Column, aliases: dict[str, str]) -> Column:
    """The name that a text means, whatever its case and its dashes, blanks and underscores; an unknown one is an error, null stays null."""
    plain = F.regexp_replace(F.lower(F.trim(c)), r"[-_\s]+", "")
    out = F.when(c.isNull(), None)
    for alias, name in aliases.items():
        out = out.when(plain == alias, name)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown condition: "), c)))


def looked_up(df: DataFrame, table: DataFrame, on: list[str], value: str, default) -> DataFrame:
    """``df`` with ``value`` of the table's row, or the default."""
    return df.join(table.select(*on, value), on, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def merged_counts(on: list[str], **tables: DataFrame) -> DataFrame:
    """All keys of any table, with n of each as a column of its name, 0 where it has none."""
    out = None
    for name, t in tables.items():
        counts = t.groupBy(*on).agg(F.count(F.lit(1)).alias(name))
        out = counts if out is None else out.join(counts, on, "full")
    return out.na.fill(0, list(tables))


def field_bins(rates: DataFrame, share: float, *by: str) -> DataFrame:
    """(by, ix, iy): bins whose rate passes ``share`` of their map's peak."""
    top = rates.withColumn("__top", F.max("rate").over(W.partitionBy(*by)))
    return top.where(F.col("rate") > share * F.col("__top")).select(*by, "ix", "iy")


def marked(df: DataFrame, bins: DataFrame, out: str, *by: str) -> DataFrame:
    """``df`` with whether its bin is one of ``bins``."""
    on = [*by, "ix", "iy"]
    return df.join(bins.select(*on).distinct().withColumn(out, F.lit(True)), on, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def place_cells(df: DataFrame, flag: str, hz: float, shifts: int) -> DataFrame:
    """(cell, info, p): spatial information of the flagged frames' map, and the share of shifted maps that reach it."""
    info = spatial_information(circular_shift_rates(df, flag, shifts, hz, KEY, "ix", "iy"), KEY, "shift")
    return shuffle_p(info.withColumn("info", F.round("info", 9)), "info", KEY)


def direction_tuning(df: DataFrame, flag: str, angle: str, width: float, hz: float, shifts: int) -> DataFrame:
    """(cell, mvl, p): mean vector length over bins of ``width`` degrees, and the share of shifted spikes that reach it."""
    binned = df.where(F.col(angle).isNotNull()).withColumn("bin", F.floor(F.col(angle) / width).cast("long"))
    rates = circular_shift_rates(binned, flag, shifts, hz, KEY, "bin").withColumn("__centre", (F.col("bin") + 0.5) * width)
    return shuffle_p(mean_vector(rates, "__centre", "rate", KEY, "shift").select(KEY, "shift", F.round("mvl", 9).alias("mvl")), "mvl", KEY)


def wrapped_smoothing(rates: DataFrame, bins: int, sigma: float, least_seconds: float, out: str, *by: str) -> DataFrame:
    """(by, bin, out): rates of circular bins, 0 where the occupancy is under ``least_seconds``, smoothed by a Gaussian of ``sigma`` bins around the circle."""
    reach = bins // 2
    weights = {k: 2.718281828459045 ** (-0.5 * (k / sigma) ** 2) for k in range(-reach, bins - reach)}
    total = sum(weights.values())
    step = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(w / total).alias("w")) for k, w in weights.items())))
    rate = F.when(F.col("occ") >= least_seconds, F.col("rate")).otherwise(0.0)
    spread = rates.select(*by, "bin", rate.alias("__r"), step.alias("s")).select(*by, F.pmod(F.col("bin") + F.col("s.k"), F.lit(bins)).alias("bin"), (F.col("__r") * F.col("s.w")).alias("__p"))
    return spread.groupBy(*by, "bin").agg(F.sum("__p").alias(out))


def region_means(rates: DataFrame, bins: DataFrame, *by: str) -> DataFrame:
    """(by, inside, outside): mean rate of the bins that are in ``bins``, and of the others."""
    return marked(rates, bins, "__in", *by).groupBy(*by).agg(F.avg(F.when(F.col("__in"), F.col("rate"))).alias("inside"), F.avg(F.when(~F.col("__in"), F.col("rate"))).alias("outside"))


def split_rates(df: DataFrame, kinds: dict[str, Column], inside: Column, hz: float, *by: str) -> DataFrame:
    """(by, kind, inside, outside): rates of each kind of spike in frames where the condition holds, and in the others."""
    seconds = lambda c: F.sum(c.cast("long")) / hz
    out = df.groupBy(*by).agg(seconds(inside).alias("__t"), seconds(~inside).alias("__u"), *(F.sum((inside & c).cast("long")).alias(f"__i_{k}") for k, c in kinds.items()), *(F.sum((~inside & c).cast("long")).alias(f"__o_{k}") for k, c in kinds.items()))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"__i_{k}").alias("i"), F.col(f"__o_{k}").alias("o")) for k in kinds)))
    rate = lambda n, t: F.when(F.col(t) > 0, F.col(n) / F.col(t))
    return out.select(*by, "__t", "__u", rows.alias("r")).select(*by, "__t", "__u", "r.*").select(*by, "kind", rate("i", "__t").alias("inside"), rate("o", "__u").alias("outside"))


def band_power(spectra: DataFrame, lo: float, hi: float, *by: str) -> DataFrame:
    """(by, power): sum of ``value`` over frequencies in [lo, hi], as a share of the spectrum's sum."""
    band = F.sum(F.when(F.col("frequency").between(lo, hi), F.col("value")).otherwise(0.0))
    return spectra.groupBy(*by).agg((band / F.sum("value")).alias("power"))


def mean_and_sem(df: DataFrame, value: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), (F.stddev_pop(value) / F.sqrt(F.count(value))).alias("sem"), F.count(value).alias("n"))


def largest_components(parts: DataFrame, key: str, k: int = 1) -> DataFrame:
    """(key, component, area): the k largest components of each map, the first of equals first."""
    c = parts.groupBy(key, "component").agg(F.count(F.lit(1)).alias("area"))
    place = F.row_number().over(W.partitionBy(key).orderBy(F.desc("area"), "component"))
    return c.withColumn("__k", place).where(F.col("__k") <= k).drop("__k")


def resampled_nearest(m: DataFrame, key: str, n: int, n_new: int) -> DataFrame:
    """(key, ix, iy, value) on n_new x n_new bins: the value of the old bin that holds the new one's centre."""
    at = [(i, min(n - 1, int((i + 0.5) * n / n_new))) for i in range(n_new)]
    new = F.array(*(F.struct(F.lit(i).cast("long").alias("new"), F.lit(o).cast("long").alias("old")) for i, o in at))
    of = lambda c: F.explode(F.filter(new, lambda p: p["old"] == F.col(c)))
    out = m.withColumn("__x", of("ix")).withColumn("__y", of("iy"))
    return out.select(key, F.col("__x.new").alias("ix"), F.col("__y.new").alias("iy"), "value")


def refined_pose(df: DataFrame, parts: list[str], least: float) -> DataFrame:
    """``df`` with x, y of the first of ``parts`` (columns p_x, p_y, p_likelihood, from front to back) that is likely enough, and angle from the next such one to it."""
    found = F.filter(F.array(*(F.struct(F.col(f"{p}_x").alias("x"), F.col(f"{p}_y").alias("y"), (F.col(f"{p}_likelihood") >= least).alias("ok")) for p in parts)), lambda s: F.coalesce(s["ok"], F.lit(False)))
    first, second = F.get(found, F.lit(0)), F.get(found, F.lit(1))
    angle = F.pmod(F.degrees(F.atan2(first["y"] - second["y"], first["x"] - second["x"])), F.lit(360.0))
    return df.withColumns({"x": first["x"], "y": first["y"], "angle": angle})


def session_rates(df: DataFrame, spike: Column, hz: float, *bins: str) -> DataFrame:
    """Rate maps of each cell and session."""
    return rate_map(df, spike, hz, KEY, "session", *bins)


def cache_key(*columns: Column) -> Column:
    """MD5 of the values as text, told apart by a bar; null counts as nothing."""
    return F.md5(F.concat_ws("|", *(c.cast("string") for c in columns)))



def information_batches(df: DataFrame, paces: dict[str, Column], kinds: dict[str, Column], hz: float) -> DataFrame:
    """(cell, pace, spikes, info): spatial information of each kind of spike in the frames of each pace, all in one pass."""
    marked_frames = df.withColumn("pace", F.explode(F.filter(F.array(*(F.when(c, F.lit(p)) for p, c in paces.items())), lambda p: p.isNotNull())))
    counted = marked_frames.groupBy(KEY, "pace", "ix", "iy").agg((F.count(F.lit(1)) / hz).alias("occ"), *(F.count_if(c).alias(f"__{k}") for k, c in kinds.items()))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("spikes"), (F.col(f"__{k}") / F.col("occ")).alias("rate")) for k in kinds)))
    rates = counted.select(KEY, "pace", "ix", "iy", "occ", each.alias("r")).select(KEY, "pace", "ix", "iy", "occ", "r.*")
    return spatial_information(rates, KEY, "pace", "spikes")
