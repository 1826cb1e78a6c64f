"""Map operators on binned positions and on 8 x 8 maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.binding import binned, bursts, frames, maps, returned, spikes
from framewise.functions.scalar import bin_index, circular_distance
from framewise.operators import grids as G
from framewise.operators import intervals as I
from framewise.queries.registry import connected, query, r, with_tables


def is_error() -> Column:
    return F.col("kind") == "error"


@query(with_tables("fb", f"SELECT cell, ix, iy, {r('count(*) / 10.0', 'occ')} FROM fb GROUP BY ALL"))
def a8_occupancy(spark: SparkSession, d: str) -> DataFrame:
    return returned(G.occupancy(binned(frames(spark, d)), 10.0, "cell", "ix", "iy"))


RATE = "rm AS (SELECT cell, ix // 4 AS ix, iy // 4 AS iy, count(*) / 10.0 AS occ, CAST(sum(CASE WHEN kind = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS n FROM fb GROUP BY ALL)"


def _coarse(spark: SparkSession, d: str) -> DataFrame:
    b = binned(frames(spark, d))
    return b.withColumns({"ix": F.floor(F.col("ix") / 4).cast("long"), "iy": F.floor(F.col("iy") / 4).cast("long")})


@query(with_tables("fb", f"SELECT cell, ix, iy, n, {r('n / occ', 'rate')} FROM rm", RATE))
def a9_rate_map(spark: SparkSession, d: str) -> DataFrame:
    return returned(G.rate_map(_coarse(spark, d), is_error(), 10.0, "cell", "ix", "iy"), "cell", "ix", "iy", "n", "rate")


@query(with_tables("fb", f"SELECT ix, iy, {r('avg(v)', 'mean')}, count(*) AS n FROM fb GROUP BY ALL"))
def a10_mean_map(spark: SparkSession, d: str) -> DataFrame:
    return returned(binned(frames(spark, d)).groupBy("ix", "iy").agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n")))


@query(with_tables("bu fb", "SELECT bu.cell, ix, iy, session, count(DISTINCT burst) AS events FROM bu JOIN fb ON fb.cell = bu.cell AND fb.frame BETWEEN lo AND hi GROUP BY ALL"))
def a11_unique_bin_events(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d)
    inside = I.points_inside(binned(fr).select("cell", "frame", "ix", "iy", "session"), bursts(fr), "burst")
    return inside.groupBy("cell", F.col("p_ix").alias("ix"), F.col("p_iy").alias("iy"), F.col("p_session").alias("session")).agg(F.countDistinct("burst").alias("events"))


CIRC = "ch AS (SELECT cell, CAST(floor(hd / 15) AS BIGINT) AS bin, count(*) / 10.0 AS occ, CAST(sum(CASE WHEN kind = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS n FROM fr GROUP BY ALL)"


def _tuning(fr: DataFrame, *by: str) -> DataFrame:
    return G.rate_map(fr.withColumn("bin", F.floor(F.col("hd") / 15).cast("long")), is_error(), 10.0, *by, "bin").withColumn("centre", F.col("bin") * 15 + 7.5)


@query(with_tables("fr", f"SELECT cell, bin, {r('occ', 'occ')}, {r('n / occ', 'rate')} FROM ch", CIRC))
def a12_direction_rates(spark: SparkSession, d: str) -> DataFrame:
    return returned(_tuning(frames(spark, d), "cell"), "cell", "bin", "occ", "rate")


MVL = "mv AS (SELECT cell, sum(n / occ * cos(radians(bin * 15 + 7.5))) AS c, sum(n / occ * sin(radians(bin * 15 + 7.5))) AS s, sum(n / occ) AS w FROM ch GROUP BY cell)"
ANGLE = "((degrees(atan2(s, c)) % 360) + 360) % 360"


@query(with_tables("fr", f"SELECT cell, {r('CASE WHEN w > 0 THEN sqrt(c * c + s * s) / w END', 'mvl')}, {r(f'CASE WHEN w > 0 THEN {ANGLE} END', 'preferred')} FROM mv", CIRC + ",\n" + MVL))
def a13_mean_vector(spark: SparkSession, d: str) -> DataFrame:
    return returned(G.mean_vector(_tuning(frames(spark, d), "cell"), "centre", "rate", "cell"))


@query(with_tables("fb", f"SELECT ix, iy, {r('sqrt(pow(sum(cos(radians(hd))), 2) + pow(sum(sin(radians(hd))), 2)) / count(*)', 'mrl')} FROM fb GROUP BY ALL"))
def a14_mrl_map(spark: SparkSession, d: str) -> DataFrame:
    one = binned(frames(spark, d)).withColumn("one", F.lit(1.0))
    return returned(G.mean_vector(one, "hd", "one", "ix", "iy").withColumnRenamed("mvl", "mrl"), "ix", "iy", "mrl")


@query(
    with_tables("fr", f"SELECT cell, bins, {r('sqrt(c * c + s * s) / w', 'mrl')} FROM (SELECT cell, count(*) AS bins, sum(m * cos(radians(bin * 30 + 15))) AS c, sum(m * sin(radians(bin * 30 + 15))) AS s, sum(m) AS w FROM ab GROUP BY cell HAVING count(*) >= 6)",
                "ab AS (SELECT cell, CAST(floor(hd / 30) AS BIGINT) AS bin, avg(v) AS m FROM fr GROUP BY ALL HAVING count(*) >= 3)")
)
def a15_weighted_mrl(spark: SparkSession, d: str) -> DataFrame:
    b = frames(spark, d).groupBy("cell", F.floor(F.col("hd") / 30).alias("bin")).agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    b = b.withColumn("centre", F.col("bin") * 30 + 15)
    enough = b.groupBy("cell").agg(F.count(F.lit(1)).alias("bins")).where("bins >= 6")
    return returned(G.mean_vector(b, "centre", "m", "cell").join(enough, "cell").withColumnRenamed("mvl", "mrl"), "cell", "bins", "mrl")


INFO = """pr AS (SELECT *, n / occ AS rate, occ / sum(occ) OVER (PARTITION BY cell) AS p FROM rm),
mn AS (SELECT *, sum(p * rate) OVER (PARTITION BY cell) AS mean FROM pr)"""


@query(with_tables("fb", f"SELECT cell, {r('sum(CASE WHEN mean > 0 THEN rate * log2(rate / mean + 1e-15) * p ELSE 0 END)', 'info')} FROM mn GROUP BY cell", RATE + ",\n" + INFO))
def a16_spatial_information(spark: SparkSession, d: str) -> DataFrame:
    return returned(G.spatial_information(G.rate_map(_coarse(spark, d), is_error(), 10.0, "cell", "ix", "iy"), "cell"))


@query(
    with_tables("fb", f"SELECT cell, session, bin, {r('x', 'x')}, {r('y', 'y')}, {r('hd', 'hd')}, spikes FROM tb WHERE n = 5",
                "tb AS (SELECT cell, session, (frame - f0) // 5 AS bin, avg(x) AS x, avg(y) AS y, avg(hd) AS hd, CAST(sum(CASE WHEN kind = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS spikes, count(vn) AS n FROM (SELECT *, min(frame) OVER (PARTITION BY cell, session) AS f0 FROM fb) GROUP BY ALL)")
)
def a17_time_bins(spark: SparkSession, d: str) -> DataFrame:
    """Bins of five frames within a session whose frames are all valid; directions are averaged linearly."""
    from pyspark.sql import Window as W

    fr = frames(spark, d).withColumn("f0", F.min("frame").over(W.partitionBy("cell", "session")))
    t = fr.groupBy("cell", "session", F.floor((F.col("frame") - F.col("f0")) / 5).cast("long").alias("bin")).agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("hd").alias("hd"), F.sum(is_error().cast("long")).alias("spikes"), F.count("vn").alias("n")
    )
    return returned(t.where("n = 5"), "cell", "session", "bin", "x", "y", "hd", "spikes")


@query(with_tables("fb", "SELECT cell, frame FROM (SELECT *, count(*) OVER (PARTITION BY cell, ix, iy) AS n FROM fb) WHERE n / 10.0 >= 0.2"))
def a18_occupied_frames(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    n = F.count(F.lit(1)).over(W.partitionBy("cell", "ix", "iy"))
    return binned(frames(spark, d)).withColumn("n", n).where(F.col("n") / 10.0 >= 0.2).select("cell", "frame")


@query(with_tables("mp", f"SELECT map_id, ix, iy, {r('CASE WHEN top > 0 THEN value / top ELSE 0 END', 'value')} FROM (SELECT *, max(value) OVER (PARTITION BY map_id) AS top FROM mp)"))
def m13_peak_normalised(spark: SparkSession, d: str) -> DataFrame:
    return returned(G.peak_normalised(maps(spark, d), "value", "map_id"), "map_id", "ix", "iy", "value")


KERNEL = """ke AS (SELECT o, w / sum(w) OVER () AS w FROM (SELECT o, exp(-0.5 * (o / CAST(1.0 AS DOUBLE)) * (o / CAST(1.0 AS DOUBLE))) AS w FROM (SELECT unnest(range(-4, 5)) AS o))),
s1 AS (SELECT map_id, ix + o AS ix, iy, sum(value * w) AS value FROM mp, ke WHERE ix + o BETWEEN 0 AND 7 GROUP BY ALL),
s2 AS (SELECT map_id, ix, iy + o AS iy, sum(value * w) AS value FROM s1, ke WHERE iy + o BETWEEN 0 AND 7 GROUP BY ALL)"""


@query(with_tables("mp", f"SELECT map_id, ix, iy, {r('value', 'value')} FROM s2", KERNEL.replace("ix + o AS ix, iy,", "ix + o AS ix, iy,").replace("GROUP BY ALL),\ns2", "GROUP BY map_id, ix + o, iy),\ns2").replace("iy + o BETWEEN 0 AND 7 GROUP BY ALL", "iy + o BETWEEN 0 AND 7 GROUP BY map_id, ix, iy + o")))
def m6_gaussian_smoothing(spark: SparkSession, d: str) -> DataFrame:
    return returned(G.smoothed(maps(spark, d), 1.0, (8, 8)), "map_id", "ix", "iy", "value")


SIM = """pa AS (SELECT a.map_id, a.value AS x, b.value AS y, 1.0 + a.ix % 3 AS w FROM mp a JOIN mp b ON b.map_id = a.map_id + 1 AND a.ix = b.ix AND a.iy = b.iy),
ss AS (SELECT map_id, sum(w) AS w, sum(w * x) AS wa, sum(w * y) AS wb, sum(w * x * x) AS waa, sum(w * y * y) AS wbb, sum(w * x * y) AS wab, sum(w * w) AS ww, count(*) AS bins FROM pa GROUP BY map_id)"""


@query(with_tables("mp", f"SELECT map_id, bins, {r('(wab - wa * wb / w) / sqrt((waa - wa * wa / w) * (wbb - wb * wb / w))', 'pearson')}, {r('wab / sqrt(waa * wbb)', 'cosine')}, {r('w * w / ww', 'effective_n')} FROM ss", SIM))
def m12_map_similarity(spark: SparkSession, d: str) -> DataFrame:
    m = maps(spark, d)
    b = m.select((F.col("map_id") - 1).alias("map_id"), "ix", "iy", F.col("value").alias("y"))
    pairs = m.select("map_id", "ix", "iy", F.col("value").alias("x"), (1.0 + F.col("ix") % 3).alias("w")).join(b, ["map_id", "ix", "iy"])
    return returned(G.weighted_similarity(pairs, "x", "y", "w", "map_id"))


@query(with_tables("mp", f"SELECT a.map_id, {r('corr(a.r, b.r)', 'spearman')} FROM ra a JOIN ra b ON b.map_id = a.map_id + 1 AND a.ix = b.ix AND a.iy = b.iy GROUP BY a.map_id", "ra AS (SELECT *, rank() OVER (PARTITION BY map_id ORDER BY value) + (count(*) OVER (PARTITION BY map_id, value) - 1) / 2.0 AS r FROM mp)"))
def m12_map_rank_correlation(spark: SparkSession, d: str) -> DataFrame:
    from framewise.operators.sequence import average_rank

    m = average_rank(maps(spark, d), "value", "r", "map_id").select("map_id", "ix", "iy", "r")
    b = m.select((F.col("map_id") - 1).alias("map_id"), "ix", "iy", F.col("r").alias("q"))
    return returned(m.join(b, ["map_id", "ix", "iy"]).groupBy("map_id").agg(F.corr("r", "q").alias("spearman")))


SHIFTED = """nn AS (SELECT *, count(*) OVER (PARTITION BY cell) AS nf FROM fb),
sh AS (SELECT a.cell, s.shift, a.ix // 4 AS ix, a.iy // 4 AS iy, b.kind FROM nn a CROSS JOIN (SELECT unnest(range(0, 21)) AS shift) s
  JOIN nn b ON b.cell = a.cell AND b.frame = (a.frame + CASE WHEN s.shift = 0 THEN 0 ELSE 1 + CAST(floor((2 * s.shift - 1) * (a.nf - 1) / 40.0) AS BIGINT) END) % a.nf WHERE a.nf > 1),
rs AS (SELECT cell, shift, ix, iy, count(*) / 10.0 AS occ, sum(CASE WHEN kind = 'error' THEN 1 ELSE 0 END) AS n FROM sh GROUP BY ALL),
ps AS (SELECT *, n / occ AS rate, occ / sum(occ) OVER (PARTITION BY cell, shift) AS p FROM rs),
ms AS (SELECT *, sum(p * rate) OVER (PARTITION BY cell, shift) AS mean FROM ps),
ns AS (SELECT cell, shift, round(sum(CASE WHEN mean > 0 THEN rate * log2(rate / mean + 1e-15) * p ELSE 0 END), 6) + 0.0 AS info FROM ms GROUP BY ALL)"""


@query(with_tables("fb", f"SELECT a.cell, a.info, {r('count(*) FILTER (WHERE b.info >= a.info) / CAST(count(*) AS DOUBLE)', 'p')} FROM ns a JOIN ns b USING (cell) WHERE a.shift = 0 AND b.shift > 0 GROUP BY a.cell, a.info", SHIFTED))
def m2_shuffle_information(spark: SparkSession, d: str) -> DataFrame:
    """Twenty circular shifts of the spikes against the path, and how many of them hold as much information."""
    b = _coarse(spark, d).select("cell", "frame", "ix", "iy", is_error().alias("hit"))
    rates = G.circular_shift_rates(b, "hit", 20, 10.0, "cell", "ix", "iy")
    info = returned(G.spatial_information(rates, "cell", "shift"))
    return returned(G.shuffle_p(info, "info", "cell"))


@query(connected("SELECT map_id, ix, iy, component FROM cp"))
def i10_components(spark: SparkSession, d: str) -> DataFrame:
    return G.components(maps(spark, d).withColumn("on", F.col("value") > 0), "on", "map_id")


@query(connected("SELECT map_id, ix, iy, component FROM cp", diagonal=True))
def i11_components_diagonal(spark: SparkSession, d: str) -> DataFrame:
    return G.components(maps(spark, d).withColumn("on", F.col("value") > 0), "on", "map_id", diagonal=True)


RANKED = """SELECT map_id, component, round(peak, 6) + 0.0 AS peak, area, row_number() OVER (PARTITION BY map_id ORDER BY CASE WHEN top = 1 THEN 0 ELSE 1 END, area DESC, peak DESC, component) AS place
FROM (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY peak DESC, area DESC, component) AS top FROM (SELECT map_id, component, max(value) AS peak, count(*) AS area FROM cp JOIN mp USING (map_id, ix, iy) GROUP BY ALL))"""


@query(connected(RANKED))
def i14_ranked_components(spark: SparkSession, d: str) -> DataFrame:
    m = maps(spark, d)
    parts = G.components(m.withColumn("on", F.col("value") > 0), "on", "map_id").join(m, ["map_id", "ix", "iy"])
    return returned(G.ranked_components(parts, "map_id"))


@query(with_tables("mp", "SELECT DISTINCT map_id, ix + dx AS ix, iy + dy AS iy FROM mp, (SELECT unnest(range(-1, 2)) AS dx), (SELECT unnest(range(-1, 2)) AS dy) WHERE value > 0.2 AND dx * dx + dy * dy <= 1 AND ix + dx BETWEEN 0 AND 7 AND iy + dy BETWEEN 0 AND 7"))
def i16_dilation(spark: SparkSession, d: str) -> DataFrame:
    return G.dilated(maps(spark, d).where("value > 0.2"), "map_id", 1, (8, 8))


@query(
    with_tables("mp", f"SELECT map_id, CAST(jx AS BIGINT) AS ix, CAST(jy AS BIGINT) AS iy, {r('sum(value * ax * ay) / sum(ax * ay)', 'value')} FROM ov WHERE ax > 0 AND ay > 0 GROUP BY ALL",
                "ov AS (SELECT map_id, value, jx, jy, least((ix + 1) * 1.5, (jx + 1) * 2.0) - greatest(ix * 1.5, jx * 2.0) AS ax, least((iy + 1) * 1.5, (jy + 1) * 2.0) - greatest(iy * 1.5, jy * 2.0) AS ay FROM mp, (SELECT unnest(range(0, 6)) AS jx), (SELECT unnest(range(0, 6)) AS jy))")
)
def j15_area_resampled(spark: SparkSession, d: str) -> DataFrame:
    return returned(G.area_resampled(maps(spark, d), "map_id", 1.5, 2.0, 6))


@query(with_tables("mp", f"SELECT map_id, ix // 2 AS ix, iy // 2 AS iy, {r('avg(value)', 'mean')}, {r('max(value)', 'top')}, bool_or(value > 0.2) AS any_high, bool_and(value > 0) AS all_positive FROM mp GROUP BY ALL"))
def a33_block_reduce(spark: SparkSession, d: str) -> DataFrame:
    b = maps(spark, d).groupBy("map_id", F.floor(F.col("ix") / 2).cast("long").alias("ix"), F.floor(F.col("iy") / 2).cast("long").alias("iy"))
    return returned(b.agg(F.avg("value").alias("mean"), F.max("value").alias("top"), F.bool_or(F.col("value") > 0.2).alias("any_high"), F.bool_and(F.col("value") > 0).alias("all_positive")))


@query(with_tables("mp", f"SELECT ix, iy, {r('avg(value)', 'mean')}, {r('stddev_pop(value)', 'sd')} FROM mp GROUP BY ALL"))
def a31_mean_sd_image(spark: SparkSession, d: str) -> DataFrame:
    return returned(maps(spark, d).groupBy("ix", "iy").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd")))


@query(with_tables("mp", f"SELECT map_id, {r('sum(value * (ix + iy)) / sum(ix + iy)', 'trace')} FROM mp GROUP BY map_id"))
def a32_weighted_trace(spark: SparkSession, d: str) -> DataFrame:
    w = F.col("ix") + F.col("iy")
    return returned(maps(spark, d).groupBy("map_id").agg((F.sum(F.col("value") * w) / F.sum(w)).alias("trace")))


@query(with_tables("mp", f"SELECT map_id, min(ix) AS x0, max(ix) AS x1, min(iy) AS y0, max(iy) AS y1, {r('avg(ix)', 'cx')}, {r('avg(iy)', 'cy')} FROM mp WHERE value > 0.2 GROUP BY map_id"))
def a37_bounding_box(spark: SparkSession, d: str) -> DataFrame:
    b = maps(spark, d).where("value > 0.2").groupBy("map_id")
    return returned(b.agg(F.min("ix").alias("x0"), F.max("ix").alias("x1"), F.min("iy").alias("y0"), F.max("iy").alias("y1"), F.avg("ix").alias("cx"), F.avg("iy").alias("cy")))


@query(with_tables("fb sp", "SELECT sp.cell, sp.frame, sp.kind, ix, iy FROM sp JOIN fb USING (cell, frame)"))
def j12_spike_positions(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d)
    return spikes(fr).select("cell", "frame", "kind").join(binned(fr).select("cell", "frame", "ix", "iy"), ["cell", "frame"])


FIELD = "pf AS (SELECT DISTINCT cell, ix, iy FROM fb WHERE kind = 'error')"


@query(with_tables("fb", "SELECT cell, session, ix IS NOT NULL AS in_field, count(*) AS frames, CAST(sum(CASE WHEN kind = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS n FROM (SELECT fb.cell, session, kind, pf.ix FROM fb LEFT JOIN pf ON pf.cell = fb.cell AND pf.ix = fb.ix AND pf.iy = fb.iy) GROUP BY ALL", FIELD))
def a20_state_field_rates(spark: SparkSession, d: str) -> DataFrame:
    b = binned(frames(spark, d))
    field = b.where(is_error()).select("cell", "ix", "iy").distinct().withColumn("in_field", F.lit(True))
    j = b.join(field, ["cell", "ix", "iy"], "left").withColumn("in_field", F.coalesce("in_field", F.lit(False)))
    return j.groupBy("cell", "session", "in_field").agg(F.count(F.lit(1)).alias("frames"), F.sum((F.col("kind") == "view").cast("long")).alias("n"))


@query(with_tables("fb", f"SELECT cell, frame, {r('abs(((hd - pref + 180) % 360 + 360) % 360 - 180)', 'away')} FROM fb JOIN mv2 USING (cell) WHERE pref IS NOT NULL AND abs(((hd - pref + 180) % 360 + 360) % 360 - 180) <= 50", CIRC + ",\n" + MVL + f",\nmv2 AS (SELECT cell, CASE WHEN w > 0 THEN {ANGLE} END AS pref FROM mv)"))
def m30_preferred_frames(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d)
    pref = G.mean_vector(_tuning(fr, "cell"), "centre", "rate", "cell").select("cell", "preferred")
    return returned(fr.join(pref, "cell").withColumn("away", circular_distance(F.col("hd"), F.col("preferred"))).where("away <= 50"), "cell", "frame", "away")


@query(with_tables("fr", "SELECT cell, frame, CAST(least(greatest(floor(v / 50), 0), 9) AS BIGINT) AS bin FROM fr"))
def m24_nearest_bins(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select("cell", "frame", bin_index(F.col("v"), 50.0, 10).alias("bin"))


