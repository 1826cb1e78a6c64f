"""Scales, waveforms, gates and rankings of traces and points, by cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewise.operators.intervals import covered
from framewise.operators.sequence import FRAME, KEY, by_cell, nearest, speed


def z_scored(df: DataFrame, c: str, out: str, *by: str) -> DataFrame:
    """Distance from the mean in population standard deviations; from the mean alone where all values are alike."""
    w = W.partitionBy(*by)
    sd = F.stddev_pop(c).over(w)
    return df.withColumn(out, (F.col(c) - F.avg(c).over(w)) / F.when(sd > 0, sd).otherwise(1.0))


def unit_range(df: DataFrame, c: str, out: str, *by: str) -> DataFrame:
    """The least value at 0 and the largest at 1; 0 where all are alike."""
    lo, hi = F.min(c).over(W.partitionBy(*by)), F.max(c).over(W.partitionBy(*by))
    return df.withColumn(out, F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(0.0))


def median_and_mad(df: DataFrame, c: str, *by: str) -> DataFrame:
    """(by, median, mad): the median, and the median distance from it times 1.4826."""
    j = df.select(*by, c).join(df.groupBy(*by).agg(F.percentile(c, 0.5).alias("median")), list(by))
    return j.groupBy(*by).agg(F.first("median").alias("median"), (F.percentile(F.abs(F.col(c) - F.col("median")), 0.5) * 1.4826).alias("mad"))


def centre_and_scale(df: DataFrame, c: str, *by: str, tail: float = 0.01) -> DataFrame:
    """(by, centre, scale): the median, and the distance between the percentiles ``tail`` and 1 - ``tail``, or 6 standard deviations, or 1."""
    s = df.groupBy(*by).agg(F.percentile(c, F.array(F.lit(tail), F.lit(0.5), F.lit(1 - tail))).alias("q"), F.stddev_pop(c).alias("sd"))
    spread = F.get("q", F.lit(2)) - F.get("q", F.lit(0))
    return s.select(*by, F.get("q", F.lit(1)).alias("centre"), F.when(spread > 0, spread).when(F.col("sd") > 0, 6 * F.col("sd")).otherwise(1.0).alias("scale"))


def with_segment_median(df: DataFrame, c: str, length: int, out: str) -> DataFrame:
    """With ``segment``, the number of the frame's stretch of ``length`` frames, and the stretch's median."""
    s = df.withColumn("segment", F.floor(F.col(FRAME) / length).cast("long"))
    return s.join(s.groupBy(KEY, "segment").agg(F.percentile(c, 0.5).alias(out)), [KEY, "segment"])


def segment_snr(df: DataFrame, c: str, length: int, signal: float = 1.0) -> DataFrame:
    """(cell, segment, snr): ``signal`` over the standard deviation about the segment's median."""
    s = with_segment_median(df, c, length, "__m").groupBy(KEY, "segment").agg(F.stddev_pop(F.col(c) - F.col("__m")).alias("sd")).where("sd > 0")
    return s.select(KEY, "segment", (signal / F.col("sd")).alias("snr"))


def spike_height(df: DataFrame, c: str, spike: Column, before: int, out: str) -> DataFrame:
    """Spikes with their value over the least of the ``before`` frames that precede them; a first frame has none and goes."""
    low = F.min(c).over(by_cell().rowsBetween(-before, -1))
    return df.withColumn("__low", low).where(spike & F.col("__low").isNotNull()).withColumn(out, F.col(c) - F.col("__low")).drop("__low")


def envelope(df: DataFrame, c: str, width: int) -> DataFrame:
    """(cell, bin, frame, c): of each ``width`` frames the first least and the first largest value."""
    point = F.struct(FRAME, c)
    b = df.groupBy(KEY, F.floor(F.col(FRAME) / width).cast("long").alias("bin")).agg(F.min_by(point, F.struct(c, FRAME)).alias("lo"), F.max_by(point, F.struct(F.col(c), -F.col(FRAME))).alias("hi"))
    return b.select(KEY, "bin", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("p")).select(KEY, "bin", f"p.{FRAME}", f"p.{c}")


def waveforms(df: DataFrame, c: str, events: DataFrame, before: int, after: int) -> DataFrame:
    """(cell, at, o, c): the values ``before`` frames before to ``after`` frames after each event that lies whole in the recording."""
    e = events.select(KEY, F.col(FRAME).alias("at"), F.explode(F.sequence(F.lit(-before).cast("long"), F.lit(after).cast("long"))).alias("o"))
    e = e.withColumn(FRAME, F.col("at") + F.col("o")).join(df.select(KEY, FRAME, c), [KEY, FRAME])
    whole = F.count(F.lit(1)).over(W.partitionBy(KEY, "at"))
    return e.withColumn("__n", whole).where(F.col("__n") == before + after + 1).select(KEY, "at", "o", c)


def mean_waveform(waves: DataFrame, c: str, *by: str) -> DataFrame:
    return waves.groupBy(*by, "o").agg(F.count(F.lit(1)).alias("n"), F.avg(c).alias("mean"), (F.stddev_samp(c) / F.sqrt(F.count(F.lit(1)))).alias("sem"))


def scaled_waveforms(waves: DataFrame, c: str, out: str) -> DataFrame:
    """Each waveform between 0 and 1; flat ones go."""
    e = W.partitionBy(KEY, "at")
    w = waves.withColumns({"__lo": F.min(c).over(e), "__hi": F.max(c).over(e)}).where("__hi > __lo")
    return w.withColumn(out, (F.col(c) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).drop("__lo", "__hi")


def without_share(df: DataFrame, condition: Column, most: float) -> DataFrame:
    """(cell): cells in which the condition holds for at most ``most`` of the frames where it is known."""
    gone = df.groupBy(KEY).agg(F.avg(condition.cast("double")).alias("share")).where(F.col("share") > most)
    return df.select(KEY).distinct().join(gone, KEY, "left_anti")


def good_minutes(df: DataFrame, good: Column, hz: float, least: float) -> DataFrame:
    """(cell, minutes): cells with at least ``least`` minutes of good frames."""
    return df.where(good).groupBy(KEY).agg((F.count(F.lit(1)) / (60.0 * hz)).alias("minutes")).where(F.col("minutes") >= least)


def aligned(df: DataFrame, time: str, known: Column, value: str, out: str) -> DataFrame:
    """``out``: a value that is known at some times, along the line between the known ones around each row; held at the ends."""
    ahead, back = (W.partitionBy(KEY).orderBy(t).rowsBetween(W.unboundedPreceding, 0) for t in (time, F.desc(time)))
    point = F.when(known, F.struct(F.col(time).alias("t"), F.col(value).alias("v")))
    b, a = F.col("__b"), F.col("__a")
    line = b["v"] + (a["v"] - b["v"]) * (F.col(time) - b["t"]) / (a["t"] - b["t"])
    fr = df.withColumns({"__b": F.last(point, True).over(ahead), "__a": F.last(point, True).over(back)})
    return fr.withColumn(out, F.when(b.isNull(), a["v"]).when(a.isNull() | (a["t"] == b["t"]), b["v"]).otherwise(line)).drop("__b", "__a")


def nearest_centre(events: DataFrame, at: str, centres: DataFrame, centre: str, cluster: str, radius: float, *ident: str) -> DataFrame:
    """(ident, cluster, dist): the nearest centre at most ``radius`` away; places meet those of their own and the two next cells of that width."""
    e = events.select(*ident, at, F.explode(F.sequence(F.floor(F.col(at) / radius) - 1, F.floor(F.col(at) / radius) + 1)).alias("__k"))
    c = centres.select(cluster, centre, F.floor(F.col(centre) / radius).alias("__k"))
    j = e.join(c, "__k").withColumn("dist", F.abs(F.col(at) - F.col(centre))).where(F.col("dist") <= radius)
    return j.groupBy(*ident).agg(F.min_by(cluster, F.struct("dist", cluster)).alias(cluster), F.min("dist").alias("dist"))


def top(df: DataFrame, k: int, by: list[str], *order) -> DataFrame:
    """The first k rows of each group; Spark drops the others before it shuffles."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= k).drop("__n")


def pages(df: DataFrame, size: int, by: str, order: str, out: str) -> DataFrame:
    """The number, from 0, of the page of ``size`` rows of its group that a row is on."""
    n = F.row_number().over(W.partitionBy(by).orderBy(order))
    return df.withColumn(out, F.floor((n - 1) / size).cast("long"))


def cell_class(counts: Column, peak: Column, least_bursts: int, least_peak: float) -> Column:
    """CS+ for enough bursts and a high peak, CS- for enough bursts, else other."""
    return F.when((counts >= least_bursts) & (peak > least_peak), "CS+").when(counts >= least_bursts, "CS-").otherwise("other")


def through_centres(df: DataFrame, segments: DataFrame, value: str, length: int, out: str) -> DataFrame:
    """Values of segments of ``length`` frames (cell, segment, value) as of every frame: along the lines through the segments' centres, held at the ends."""
    w = W.partitionBy(KEY).orderBy("segment")
    near = lambda f: f(F.struct(F.col("segment").alias("k"), F.col(value).alias("v"))).over(w)
    s = segments.withColumns({"__before": near(F.lag), "__after": near(F.lead)}).select(KEY, "segment", F.col(value).alias("__v"), "__before", "__after")
    j = df.withColumn("segment", F.floor(F.col(FRAME) / length).cast("long")).join(s, [KEY, "segment"])
    off = F.col(FRAME) - (F.col("segment") * length + (length - 1) / 2.0)
    other = F.when(off >= 0, F.col("__after")).otherwise(F.col("__before"))
    line = F.col("__v") + (other["v"] - F.col("__v")) * F.abs(off) / (F.abs(other["k"] - F.col("segment")) * length)
    return j.withColumn(out, F.coalesce(line, F.col("__v"))).drop("segment", "__v", "__before", "__after")


def steady_positions(df: DataFrame, fastest: float, pad: int) -> DataFrame:
    """Positions (x, y, ms) without jumps: frames within ``pad`` of a speed over ``fastest`` take the nearest good position, then ``speed`` is told anew."""
    fast = speed(df).where(F.col("speed") > fastest).select(KEY, (F.col(FRAME) - pad).alias("lo"), (F.col(FRAME) + pad).alias("hi"))
    bare = covered(df, fast, "__fast")
    for c in ("x", "y"):
        bare = nearest(bare.withColumn("__good", F.when(~F.col("__fast"), F.col(c))), "__good", "__near").withColumn(c, F.col("__near")).drop("__good", "__near")
    return speed(bare.drop("__fast"))
