"""Sequence operators over the frames of each cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.binding import frames, returned, spikes
from framewise.operators import sequence as S
from framewise.queries.registry import CELL, query, r, with_tables

ROWS5 = f"({CELL} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
ANCHORS = f"""an AS (SELECT *, last_value(CASE WHEN vn IS NOT NULL THEN frame END IGNORE NULLS) OVER b AS bf, last_value(vn IGNORE NULLS) OVER b AS bv,
  first_value(CASE WHEN vn IS NOT NULL THEN frame END IGNORE NULLS) OVER a AS af, first_value(vn IGNORE NULLS) OVER a AS av FROM fr
  WINDOW b AS ({CELL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS ({CELL} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query(with_tables("fr", f"SELECT cell, frame, {r(f'avg(vn) OVER {ROWS5}', 'smooth')} FROM fr"))
def w1_moving_mean(spark: SparkSession, d: str) -> DataFrame:
    return returned(S.moving_mean(frames(spark, d), "vn", 5, "smooth"), "cell", "frame", "smooth")


@query(with_tables("fr", f"SELECT cell, frame, {r(f'quantile_cont(vn, 0.5) OVER {ROWS5}', 'smooth')} FROM fr"))
def w2_moving_median(spark: SparkSession, d: str) -> DataFrame:
    return returned(S.moving_median(frames(spark, d), "vn", 5, "smooth"), "cell", "frame", "smooth")


@query(with_tables("fr", f"SELECT cell, frame, {r('CASE WHEN vn IS NOT NULL THEN vn WHEN bf IS NULL THEN av WHEN af IS NULL THEN bv ELSE bv + (av - bv) * (frame - bf) / (af - bf) END', 'filled')} FROM an", ANCHORS))
def w3_interpolate_linear(spark: SparkSession, d: str) -> DataFrame:
    return returned(S.interpolated(frames(spark, d), "vn", "filled"), "cell", "frame", "filled")


@query(with_tables("fr", f"SELECT cell, frame, {r('CASE WHEN bf IS NULL THEN av WHEN af IS NULL OR frame - bf <= af - frame THEN bv ELSE av END', 'filled')} FROM an", ANCHORS))
def w4_interpolate_nearest(spark: SparkSession, d: str) -> DataFrame:
    return returned(S.nearest(frames(spark, d), "vn", "filled"), "cell", "frame", "filled")


def _padded(value: str) -> str:
    return f"""n AS (SELECT cell, frame, v, count(*) OVER (PARTITION BY cell) AS n FROM fr),
pd AS (SELECT cell, frame, v, n FROM n UNION ALL SELECT cell, -1 - frame, {value}, n FROM n WHERE frame < 2 UNION ALL SELECT cell, 2 * n - 1 - frame, {value}, n FROM n WHERE frame >= n - 2),
w AS (SELECT cell, frame, n, avg(v) OVER {ROWS5} AS mean, quantile_cont(v, 0.5) OVER {ROWS5} AS mid FROM pd)"""


@query(with_tables("fr", f"SELECT cell, frame, {r('mean', 'smooth')} FROM w WHERE frame >= 0 AND frame < n", _padded("v")))
def w5_boxcar_reflect(spark: SparkSession, d: str) -> DataFrame:
    return returned(S.boxcar_reflect(frames(spark, d), "v", 5, "smooth"), "cell", "frame", "smooth")


@query(with_tables("fr", f"SELECT cell, frame, {r(f'coalesce(sum(v) OVER {ROWS5}, 0) / 5.0', 'smooth')} FROM fr"))
def w6_boxcar_zero(spark: SparkSession, d: str) -> DataFrame:
    return returned(S.boxcar_zero(frames(spark, d), "v", 5, "smooth"), "cell", "frame", "smooth")


@query(with_tables("fr", f"SELECT cell, frame, {r('mid', 'smooth')} FROM w WHERE frame >= 0 AND frame < n", _padded("v")))
def w7_median_reflect(spark: SparkSession, d: str) -> DataFrame:
    return returned(S.median_edge(frames(spark, d), "v", 5, "smooth"), "cell", "frame", "smooth")


@query(with_tables("fr", f"SELECT cell, frame, {r('mid', 'smooth')} FROM w WHERE frame >= 0 AND frame < n", _padded("CAST(0 AS DOUBLE)")))
def w8_median_zero(spark: SparkSession, d: str) -> DataFrame:
    return returned(S.median_edge(frames(spark, d), "v", 5, "smooth", "zero"), "cell", "frame", "smooth")


SPEED = f"""dt AS (SELECT cell, (max(ms) - min(ms)) / (count(*) - 1) AS dt FROM fr GROUP BY cell HAVING count(*) > 1),
st AS (SELECT *, sqrt(pow(x - lag(x) OVER ({CELL}), 2) + pow(y - lag(y) OVER ({CELL}), 2)) AS step FROM fr),
sd AS (SELECT st.*, coalesce(CASE WHEN dt > 0 THEN step / dt * 1000.0 END, 0) AS speed FROM st LEFT JOIN dt USING (cell))"""


@query(with_tables("fr", f"SELECT cell, frame, {r('speed', 'speed')} FROM sd", SPEED))
def w9_speed(spark: SparkSession, d: str) -> DataFrame:
    return returned(S.speed(frames(spark, d)), "cell", "frame", "speed")


GRADIENT = f"""ng AS (SELECT *, lag(x) OVER ({CELL}) AS bx, lead(x) OVER ({CELL}) AS ax, lag(y) OVER ({CELL}) AS b_y, lead(y) OVER ({CELL}) AS a_y FROM fr),
gr AS (SELECT *, CASE WHEN bx IS NULL THEN ax - x WHEN ax IS NULL THEN x - bx ELSE (ax - bx) / 2 END AS gx, CASE WHEN b_y IS NULL THEN a_y - y WHEN a_y IS NULL THEN y - b_y ELSE (a_y - b_y) / 2 END AS gy FROM ng),
dr AS (SELECT *, CASE WHEN sqrt(gx * gx + gy * gy) > 0.5 THEN ((degrees(atan2(gy, gx)) % 360) + 360) % 360 END AS direction FROM gr)"""


@query(with_tables("fr", f"SELECT cell, frame, {r('direction', 'direction')} FROM dr", GRADIENT))
def w10_travel_direction(spark: SparkSession, d: str) -> DataFrame:
    return returned(S.travel_direction(frames(spark, d), 0.5), "cell", "frame", "direction")


NEXT = f"nx AS (SELECT *, lag(v) OVER ({CELL}) AS bv, lead(v) OVER ({CELL}) AS av FROM fr)"


@query(with_tables("fr", f"SELECT cell, frame, {r('v', 'v')} FROM nx WHERE v > 300 AND v > bv AND v >= av", NEXT))
def w11_local_peaks(spark: SparkSession, d: str) -> DataFrame:
    return returned(S.local_peaks(frames(spark, d), "v", 300.0), "cell", "frame", "v")


@query(with_tables("fr", "SELECT cell, frame, CASE WHEN bv <= 250 THEN 'rising' ELSE 'falling' END AS edge FROM nx WHERE (bv <= 250 AND v > 250) OR (bv > 250 AND v <= 250)", NEXT))
def w13_edges(spark: SparkSession, d: str) -> DataFrame:
    return S.edges(frames(spark, d), "v", 250.0).select("cell", "frame", "edge")


GROUPS = f"""g0 AS (SELECT *, frame - lag(frame) OVER ({CELL}) AS gap FROM sp),
g AS (SELECT *, CAST(sum(CASE WHEN gap > 2 THEN 1 ELSE 0 END) OVER ({CELL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS grp FROM g0)"""


@query(with_tables("sp", "SELECT cell, frame, grp FROM g", GROUPS))
def w14_isi_groups(spark: SparkSession, d: str) -> DataFrame:
    return S.isi_groups(spikes(frames(spark, d)), 2).select("cell", "frame", "grp")


@query(with_tables("sp", "SELECT cell, frame, CASE WHEN count(*) OVER (PARTITION BY cell, grp) = 1 THEN 'single' WHEN frame = min(frame) OVER (PARTITION BY cell, grp) THEN 'first' ELSE 'burst' END AS role FROM g", GROUPS))
def w15_singles_and_bursts(spark: SparkSession, d: str) -> DataFrame:
    return S.singles_and_bursts(spikes(frames(spark, d)), 2).select("cell", "frame", "role")


ALONE = f"al AS (SELECT *, frame - lag(frame) OVER ({CELL}) AS b, lead(frame) OVER ({CELL}) - frame AS a FROM sp WHERE kind = 'cs')"


@query(with_tables("sp", "SELECT cell, frame FROM al WHERE (b IS NULL OR b > 3) AND (a IS NULL OR a > 3)", ALONE))
def w16_isolated_spikes(spark: SparkSession, d: str) -> DataFrame:
    return S.isolated(spikes(frames(spark, d)).where("kind = 'cs'"), 3).select("cell", "frame")


@query(with_tables("sp", "SELECT cell, frame FROM al WHERE (b IS NULL OR b >= 4) AND (a IS NULL OR a >= 4)", ALONE))
def w17_min_separation(spark: SparkSession, d: str) -> DataFrame:
    return S.isolated(spikes(frames(spark, d)).where("kind = 'cs'"), 4, inclusive=True).select("cell", "frame")


@query(
    with_tables("fr", f"SELECT cell, segment, {r('coalesce(last_value(CASE WHEN h > 0 THEN h END IGNORE NULLS) OVER (PARTITION BY cell ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), quantile_cont(CASE WHEN h > 0 THEN h END, 0.5) OVER (PARTITION BY cell), 1)', 'height')} FROM s",
                "s AS (SELECT cell, frame // 10 AS segment, avg(CASE WHEN event_id % 3 = 0 THEN v END) - 250 AS h FROM fr GROUP BY ALL)")
)
def w18_carried_height(spark: SparkSession, d: str) -> DataFrame:
    seg = frames(spark, d).groupBy("cell", F.floor(F.col("frame") / 10).cast("long").alias("segment")).agg((F.avg(F.when(F.col("event_id") % 3 == 0, F.col("v"))) - 250).alias("h"))
    return returned(S.carried_height(seg, "h", "height"), "cell", "segment", "height")


@query(
    with_tables("fr", f"SELECT cell, frame, {r(f'coalesce(sum(a) OVER ({CELL} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 0) / 3.0', 'rate')} FROM q",
                f"q AS (SELECT cell, frame, coalesce(sum(CAST(kind = 'error' AS DOUBLE)) OVER {ROWS5}, 0) / 5.0 * 10 AS a FROM fr)")
)
def w19_instantaneous_rate(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d).withColumn("hit", (F.col("kind") == "error").cast("double"))
    a = S.boxcar_zero(fr, "hit", 5, "a").withColumn("a", F.col("a") * 10)
    return returned(S.boxcar_zero(a, "a", 3, "rate"), "cell", "frame", "rate")


@query(with_tables("fr", f"SELECT cell, frame, {r('rank() OVER (PARTITION BY cell ORDER BY y) + (count(*) OVER (PARTITION BY cell, y) - 1) / 2.0', 'rank')} FROM fr"))
def w20_average_rank(spark: SparkSession, d: str) -> DataFrame:
    return returned(S.average_rank(frames(spark, d), "y", "rank", "cell"), "cell", "frame", "rank")


@query(with_tables("fr", f"SELECT cell, kind, frame AS at, {r('y', 'top')} FROM (SELECT *, row_number() OVER (PARTITION BY cell, kind ORDER BY y DESC, frame) AS n FROM fr) WHERE n = 1"))
def w21_first_maximum(spark: SparkSession, d: str) -> DataFrame:
    return returned(S.first_maximum(frames(spark, d), "y", "cell", "kind"), "cell", "kind", "at", "top")


BASELINE = """q AS (SELECT cell, frame // 8 AS block, quantile_cont(vn, 0.2) AS q FROM fr GROUP BY ALL),
s AS (SELECT cell, block, avg(q) OVER (PARTITION BY cell ORDER BY block ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM q),
t AS (SELECT *, lag(s) OVER (PARTITION BY cell ORDER BY block) AS p, lead(s) OVER (PARTITION BY cell ORDER BY block) AS n FROM s),
u AS (SELECT f.*, s, (f.frame - (block * 8 + 3.5)) / 8 AS o, CASE WHEN (f.frame - (block * 8 + 3.5)) / 8 >= 0 THEN n ELSE p END AS other FROM fr f JOIN t ON f.cell = t.cell AND f.frame // 8 = t.block),
ba AS (SELECT *, CASE WHEN other IS NULL THEN s ELSE s + abs(o) * (other - s) END AS base FROM u)"""


@query(with_tables("fr", f"SELECT cell, frame, round(base, 9) AS base FROM ba", BASELINE))
def w24_block_baseline(spark: SparkSession, d: str) -> DataFrame:
    return returned(S.block_baseline(frames(spark, d), "vn", 8, 0.2, 3, "base"), "cell", "frame", "base", digits=9)


@query(with_tables("fr", f"SELECT cell, frame // 8 AS block, {r('quantile_cont(vn, 0.2)', 'low')} FROM fr GROUP BY ALL"))
def a5_block_percentile(spark: SparkSession, d: str) -> DataFrame:
    return returned(S.block_percentile(frames(spark, d), "vn", 8, 0.2, "low"))
