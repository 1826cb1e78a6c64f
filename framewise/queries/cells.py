"""Cells over sessions: gates, lookups, fields, tuning, poses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.binding import binned, bursts, frames, maps, returned, spikes, table
from framewise.functions.scalar import selectivity
from framewise.operators import cells as C
from framewise.operators import grids as G
from framewise.operators import intervals as I
from framewise.operators import traces as R
from framewise.queries.maps import is_error
from framewise.queries.registry import connected, query, r, with_tables
from framewise.queries.sequence import SPEED

COARSE = "cb AS (SELECT * REPLACE (ix // 4 AS ix, iy // 4 AS iy) FROM fb)"
RATES = COARSE + ",\nsr AS (SELECT cell, session, ix, iy, count(*) / 10.0 AS occ, count(*) FILTER (WHERE kind = 'error') AS n, count(*) FILTER (WHERE kind = 'error') / (count(*) / 10.0) AS rate FROM cb GROUP BY ALL)"
CELL_RATES = COARSE + ",\ncr AS (SELECT cell, ix, iy, count(*) / 10.0 AS occ, count(*) FILTER (WHERE kind = 'error') / (count(*) / 10.0) AS rate FROM cb GROUP BY ALL)"
FIELD = CELL_RATES + ",\npf AS (SELECT cell, ix, iy FROM (SELECT *, max(rate) OVER (PARTITION BY cell) AS top FROM cr) WHERE rate > 0.5 * top),\nfm AS (SELECT cb.*, pf.ix IS NOT NULL AS inside FROM cb LEFT JOIN pf ON pf.cell = cb.cell AND pf.ix = cb.ix AND pf.iy = cb.iy)"


def _coarse(fr: DataFrame) -> DataFrame:
    return binned(fr).withColumns({c: F.floor(F.col(c) / 4).cast("long") for c in ("ix", "iy")})


def _session_rates(spark: SparkSession, d: str) -> DataFrame:
    return C.session_rates(_coarse(frames(spark, d)), is_error(), 10.0, "ix", "iy")


def _rates(b: DataFrame) -> DataFrame:
    return G.rate_map(b, is_error(), 10.0, "cell", "ix", "iy")


def _in_field(spark: SparkSession, d: str) -> DataFrame:
    b = _coarse(frames(spark, d))
    return C.marked(b, C.field_bins(_rates(b), 0.5, "cell"), "inside", "cell")


@query(with_tables("fb", "SELECT cell FROM (SELECT cell, session, max(rate) AS top FROM sr GROUP BY ALL) WHERE top >= 5 GROUP BY cell HAVING count(*) = 2", RATES))
def p9_peak_rate_gate(spark: SparkSession, d: str) -> DataFrame:
    top = _session_rates(spark, d).groupBy("cell", "session").agg(F.max("rate").alias("top"))
    return C.in_all_sessions(top, F.col("top") >= 5)


OCC = RATES + """,
ob AS (SELECT a.cell, a.ix, a.iy, a.occ AS o1, b.occ AS o2 FROM sr a JOIN sr b ON a.cell = b.cell AND a.ix = b.ix AND a.iy = b.iy WHERE a.session = 1 AND b.session = 2),
rk AS (SELECT cell, rank() OVER (PARTITION BY cell ORDER BY o1) + (count(*) OVER (PARTITION BY cell, o1) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY cell ORDER BY o2) + (count(*) OVER (PARTITION BY cell, o2) - 1) / 2.0 AS rb FROM ob),
rh AS (SELECT cell, CASE WHEN stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN corr(ra, rb) END AS rho FROM rk GROUP BY cell)"""


@query(with_tables("fb", f"SELECT cell, {r('rho', 'rho')} FROM rh WHERE rho > -0.5", OCC))
def p10_similar_occupancy(spark: SparkSession, d: str) -> DataFrame:
    o = _session_rates(spark, d)
    on = ["cell", "ix", "iy"]
    both = o.where("session = 1").select(*on, F.col("occ").alias("o1")).join(o.where("session = 2").select(*on, F.col("occ").alias("o2")), on)
    return returned(C.rank_correlation(both, "o1", "o2", "cell").where("rho > -0.5"))


@query(with_tables("bu fr", "SELECT cell FROM (SELECT bu.cell, session, count(*) AS n FROM bu JOIN fr ON fr.cell = bu.cell AND fr.frame = bu.lo GROUP BY ALL) WHERE n >= 4 GROUP BY cell HAVING count(*) = 2"))
def p11_enough_trials(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d)
    n = bursts(fr).join(fr.select("cell", F.col("frame").alias("lo"), "session"), ["cell", "lo"]).groupBy("cell", "session").agg(F.count(F.lit(1)).alias("n"))
    return C.in_all_sessions(n, F.col("n") >= 4)


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'quiet' WHEN 'view' THEN 'quiet' ELSE 'moving' END AS condition FROM events")
def p16_named_conditions(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit(" "), F.upper(F.substring("event_type", 1, 2)), F.lit("-_"), F.substring("event_type", 3, 20))
    names = {"click": "quiet", "view": "quiet", "signup": "moving", "purchase": "moving", "error": "moving"}
    return table(spark, d, "events").select("event_id", C.named_condition(text, names).alias("condition"))


TRAVEL = "hb AS (SELECT cell, session, CAST(floor(hd / 90) AS BIGINT) AS bin, count(*) AS n FROM fr GROUP BY ALL),\ntb AS (SELECT cell, session, CAST(floor(x / 10) AS BIGINT) AS bin, count(*) AS n FROM fr GROUP BY ALL)"


@query(with_tables("fr", "SELECT cell, session, bin, hb.n AS head, tb.n AS travel FROM hb JOIN tb USING (cell, session, bin)", TRAVEL))
def j4_head_and_travel(spark: SparkSession, d: str) -> DataFrame:
    fr, on = frames(spark, d), ["cell", "session", "bin"]
    count = lambda c, width, name: fr.groupBy("cell", "session", F.floor(F.col(c) / width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias(name))
    return count("hd", 90, "head").join(count("x", 10, "travel"), on)


@query(with_tables("bu sp", "SELECT cell, coalesce(s, 0) AS spikes, coalesce(b, 0) AS bursts, coalesce(m, 0) AS gaps FROM (SELECT cell, count(*) AS s FROM sp GROUP BY cell) FULL JOIN (SELECT cell, count(*) AS b FROM bu GROUP BY cell) USING (cell) FULL JOIN (SELECT cell, count(*) AS m FROM fr WHERE vn IS NULL GROUP BY cell) USING (cell)"))
def j5_merged_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d)
    return C.merged_counts(["cell"], spikes=spikes(fr), bursts=bursts(fr), gaps=fr.where("vn is null"))


@query("SELECT c_custkey, coalesce(s_acctbal, -1.0) AS balance FROM customer LEFT JOIN (SELECT s_suppkey, s_acctbal FROM supplier) ON s_suppkey = c_custkey")
def j6_looked_up(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("balance"))
    return C.looked_up(table(spark, d, "customer").select("c_custkey"), known, ["c_custkey"], "balance", -1.0)


@query(with_tables("fb", "SELECT cell, frame, inside FROM fm", FIELD))
def j13_frames_in_field(spark: SparkSession, d: str) -> DataFrame:
    return _in_field(spark, d).select("cell", "frame", "inside")


BIN_DIRECTION = COARSE + ",\nbd AS (SELECT cell, ix, iy, ((degrees(atan2(sum(sin(radians(hd))), sum(cos(radians(hd))))) % 360) + 360) % 360 AS ref FROM cb GROUP BY ALL)"


@query(with_tables("fb", f"SELECT cell, frame, {r('ref', 'ref')} FROM cb JOIN bd USING (cell, ix, iy)", BIN_DIRECTION))
def j14_bin_direction(spark: SparkSession, d: str) -> DataFrame:
    b = _coarse(frames(spark, d)).withColumn("one", F.lit(1.0))
    ref = G.mean_vector(b, "hd", "one", "cell", "ix", "iy").select("cell", "ix", "iy", F.col("preferred").alias("ref"))
    return returned(b.join(ref, ["cell", "ix", "iy"]), "cell", "frame", "ref")


@query(with_tables("mp", f"SELECT map_id, x.i AS ix, y.i AS iy, {r('value', 'value')} FROM mp JOIN nb x ON x.o = ix JOIN nb y ON y.o = iy", "nb AS (SELECT i, CAST(least(7, floor((i + 0.5) * 8 / 6)) AS BIGINT) AS o FROM (SELECT unnest(range(6)) AS i))"))
def j16_nearest_resampled(spark: SparkSession, d: str) -> DataFrame:
    return returned(C.resampled_nearest(maps(spark, d), "map_id", 8, 6))


@query(with_tables("bu fr", "SELECT cell, count(*) FILTER (WHERE session = 1) AS quiet, count(*) FILTER (WHERE session = 2) AS moving FROM bu JOIN fr USING (cell) WHERE fr.frame = bu.lo GROUP BY cell HAVING count(*) FILTER (WHERE session = 1) > 3 AND count(*) FILTER (WHERE session = 2) > 3"))
def a24_pooled_bursts(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d)
    b = bursts(fr).join(fr.select("cell", F.col("frame").alias("lo"), "session"), ["cell", "lo"])
    n = b.groupBy("cell").agg(F.count(F.when(F.col("session") == 1, 1)).alias("quiet"), F.count(F.when(F.col("session") == 2, 1)).alias("moving"))
    return n.where("quiet > 3 and moving > 3")


@query(with_tables("mp", f"SELECT label, {r('avg(p)', 'mean')}, {r('stddev_pop(p) / sqrt(count(p))', 'sem')}, count(p) AS n FROM bp GROUP BY label", "bp AS (SELECT map_id, label, ix, sum(CASE WHEN iy BETWEEN 2 AND 4 THEN value * value ELSE 0 END) / sum(value * value) AS p FROM mp GROUP BY ALL)"))
def a40_band_power(spark: SparkSession, d: str) -> DataFrame:
    spectra = maps(spark, d).select("map_id", "label", "ix", F.col("iy").alias("frequency"), (F.col("value") * F.col("value")).alias("value"))
    return returned(C.mean_and_sem(C.band_power(spectra, 2, 4, "map_id", "label", "ix"), "power", "label"))


@query(with_tables("fb", f"SELECT cell, {r('avg(rate) FILTER (WHERE pf.ix IS NOT NULL)', 'inside')}, {r('avg(rate) FILTER (WHERE pf.ix IS NULL)', 'outside')} FROM cr LEFT JOIN pf USING (cell, ix, iy) GROUP BY cell".replace("pf.ix IS", "hit IS").replace("LEFT JOIN pf", "LEFT JOIN (SELECT *, 1 AS hit FROM pf) pf"), FIELD))
def m31_region_means(spark: SparkSession, d: str) -> DataFrame:
    rates = _rates(_coarse(frames(spark, d)))
    return returned(C.region_means(rates, C.field_bins(rates, 0.5, "cell"), "cell"))


SPLIT = FIELD + """,
tt AS (SELECT cell, count(*) FILTER (WHERE inside) / 10.0 AS t, count(*) FILTER (WHERE NOT inside) / 10.0 AS u FROM fm GROUP BY cell),
ks AS (SELECT 'all' AS kind, ['error', 'click', 'view'] AS ks UNION ALL SELECT 'cs', ['error'] UNION ALL SELECT 'ss', ['click', 'view'])"""


@query(with_tables("fb", f"SELECT tt.cell, ks.kind, {r('CASE WHEN any_value(t) > 0 THEN count(*) FILTER (WHERE inside AND list_contains(ks.ks, fm.kind)) / any_value(t) END', 'inside')}, {r('CASE WHEN any_value(u) > 0 THEN count(*) FILTER (WHERE NOT inside AND list_contains(ks.ks, fm.kind)) / any_value(u) END', 'outside')} FROM tt JOIN fm USING (cell), ks GROUP BY tt.cell, ks.kind", SPLIT))
def m33_split_rates(spark: SparkSession, d: str) -> DataFrame:
    kinds = {"all": F.col("kind").isin("error", "click", "view"), "cs": is_error(), "ss": F.col("kind").isin("click", "view")}
    return returned(C.split_rates(_in_field(spark, d), kinds, F.col("inside"), 10.0, "cell"))


@query(with_tables("fb", f"SELECT cell, {r('abs((i - o) / (i + o))', 'selectivity')} FROM (SELECT cell, count(*) FILTER (WHERE inside AND kind = 'error') / (count(*) FILTER (WHERE inside) / 10.0) AS i, count(*) FILTER (WHERE NOT inside AND kind = 'error') / nullif(count(*) FILTER (WHERE NOT inside) / 10.0, 0) AS o FROM fm GROUP BY cell HAVING count(*) FILTER (WHERE inside) > 0) WHERE i + o > 0", FIELD))
def m35_field_selectivity(spark: SparkSession, d: str) -> DataFrame:
    s = C.split_rates(_in_field(spark, d), {"cs": is_error()}, F.col("inside"), 10.0, "cell")
    return returned(s.select("cell", F.abs(selectivity(F.col("inside"), F.col("outside"))).alias("selectivity")).where("selectivity is not null"))


@query(with_tables("fb", f"SELECT cell, inside, session, {r('count(*) / 10.0', 'seconds')} FROM fm GROUP BY ALL", FIELD))
def m40_time_by_condition(spark: SparkSession, d: str) -> DataFrame:
    return returned(G.occupancy(_in_field(spark, d), 10.0, "cell", "inside", "session").withColumnRenamed("occ", "seconds"))


SHIFTED = """nd AS (SELECT cell, frame, kind, CAST(floor(hd / 30) AS BIGINT) AS bin, count(*) OVER (PARTITION BY cell) AS nf FROM fr),
sh AS (SELECT a.cell, s.shift, a.bin, b.kind FROM nd a CROSS JOIN (SELECT unnest(range(0, 21)) AS shift) s
  JOIN nd b ON b.cell = a.cell AND b.frame = (a.frame + CASE WHEN s.shift = 0 THEN 0 ELSE 1 + CAST(floor((2 * s.shift - 1) * (a.nf - 1) / 40.0) AS BIGINT) END) % a.nf WHERE a.nf > 1),
rs AS (SELECT cell, shift, bin, count(*) FILTER (WHERE kind = 'error') / (count(*) / 10.0) AS rate FROM sh GROUP BY ALL),
ms AS (SELECT cell, shift, CASE WHEN sum(rate) > 0 THEN round(sqrt(pow(sum(rate * cos(radians(bin * 30 + 15))), 2) + pow(sum(rate * sin(radians(bin * 30 + 15))), 2)) / sum(rate), 9) END AS mvl FROM rs GROUP BY ALL)"""


@query(with_tables("fr", f"SELECT a.cell, {r('a.mvl', 'mvl')}, {r('count(*) FILTER (WHERE b.mvl >= a.mvl) / CAST(count(b.mvl) AS DOUBLE)', 'p')} FROM ms a JOIN ms b USING (cell) WHERE a.shift = 0 AND b.shift > 0 AND a.mvl IS NOT NULL GROUP BY a.cell, a.mvl", SHIFTED))
def m4_direction_tuning(spark: SparkSession, d: str) -> DataFrame:
    tuned = C.direction_tuning(frames(spark, d).withColumn("hit", is_error()), "hit", "hd", 30.0, 10.0, 20)
    return returned(tuned.where("mvl is not null"))


@query(with_tables("fr", f"SELECT cell, (bin + k + 12) % 12 AS bin, {r('sum(rt * w)', 'smooth')} FROM hr, kw GROUP BY cell, (bin + k + 12) % 12",
                   "hr AS (SELECT cell, CAST(floor(hd / 30) AS BIGINT) AS bin, CASE WHEN count(*) / 10.0 >= 0.5 THEN count(*) FILTER (WHERE kind = 'error') / (count(*) / 10.0) ELSE 0 END AS rt FROM fr GROUP BY ALL),\nkw AS (SELECT k, exp(-0.5 * pow(k / 1.5, 2)) / sum(exp(-0.5 * pow(k / 1.5, 2))) OVER () AS w FROM (SELECT unnest(range(-6, 6)) AS k))"))
def m5_smoothed_tuning(spark: SparkSession, d: str) -> DataFrame:
    rates = G.rate_map(frames(spark, d).withColumn("bin", F.floor(F.col("hd") / 30).cast("long")), is_error(), 10.0, "cell", "bin")
    return returned(C.wrapped_smoothing(rates, 12, 1.5, 0.5, "smooth", "cell"))


POSE = """po AS (SELECT cell, frame, x AS ax, y AS ay, event_id % 2 AS al, x + 1 AS bx, y + hd / 100 AS "by", event_id % 3 AS bl, x - 2 AS cx, y - 1 AS cy, event_id % 5 AS cl FROM fr),
pk AS (SELECT cell, frame, list_filter([{'x': ax, 'y': ay, 'l': al}, {'x': bx, 'y': "by", 'l': bl}, {'x': cx, 'y': cy, 'l': cl}], lambda p: p.l >= 1) AS s FROM po)"""


@query(with_tables("fr", f"SELECT cell, frame, {r('s[1].x', 'x')}, {r('s[1].y', 'y')}, {r('((degrees(atan2(s[1].y - s[2].y, s[1].x - s[2].x)) % 360) + 360) % 360', 'angle')} FROM pk", POSE))
def m7_refined_pose(spark: SparkSession, d: str) -> DataFrame:
    fr, e = frames(spark, d), F.col("event_id")
    parts = {"a": (F.col("x"), F.col("y"), e % 2), "b": (F.col("x") + 1, F.col("y") + F.col("hd") / 100, e % 3), "c": (F.col("x") - 2, F.col("y") - 1, e % 5)}
    posed = fr.select("cell", "frame", *(v.alias(f"{p}_{n}") for p, vs in parts.items() for n, v in zip(("x", "y", "likelihood"), vs, strict=True)))
    return returned(C.refined_pose(posed, list(parts), 1.0), "cell", "frame", "x", "y", "angle")


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return G.components(maps(spark, d).withColumn("on", F.col("value") > 0), "on", "map_id")


@query(connected("SELECT map_id, component, area FROM (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY area DESC, component) AS k FROM ca) WHERE k = 1"))
def i12_largest_component(spark: SparkSession, d: str) -> DataFrame:
    return C.largest_components(_parts(spark, d), "map_id")


@query(connected("SELECT map_id, component, area FROM (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY area DESC, component) AS k FROM ca) WHERE k <= 3"))
def k2_largest_components(spark: SparkSession, d: str) -> DataFrame:
    return C.largest_components(_parts(spark, d), "map_id", 3)


@query(with_tables("fb", "SELECT frame, iy AS row, ix AS col, cell FROM fb ORDER BY frame, iy, ix, cell"))
def k4_frame_row_column(spark: SparkSession, d: str) -> DataFrame:
    return binned(frames(spark, d)).select("frame", F.col("iy").alias("row"), F.col("ix").alias("col"), "cell").orderBy("frame", "row", "col", "cell")


@query(with_tables("bu", "SELECT cell, burst, least(greatest(least(lo, hi), 5), 50) AS lo, least(greatest(lo, hi), 50) AS hi FROM bu WHERE least(greatest(lo, hi), 50) >= greatest(least(lo, hi), 5)"))
def p2_sane_epochs(spark: SparkSession, d: str) -> DataFrame:
    return I.clipped(bursts(frames(spark, d)), 5, 50).select("cell", "burst", "lo", "hi")


@query("SELECT event_id, md5(concat_ws('|', user_id, event_type, props)) AS key FROM events")
def fn_cache_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", C.cache_key(F.col("user_id"), F.col("event_type"), F.col("props")).alias("key"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_object('k', CAST(json_extract_string(props, '$.k') AS BIGINT), 'n', user_id)::VARCHAR AS params FROM events")
def fn_json_params(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, d, "events").select("event_id", k.alias("k"), F.to_json(F.struct(k.alias("k"), F.col("user_id").alias("n"))).alias("params"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '([^/]*)$', 1) AS leaf FROM pages")
def fn_path_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract("url", "([^/]*)$", 1).alias("leaf"))


BATCHES = f"""{COARSE},
{SPEED},
pb AS (SELECT cb.cell, CASE WHEN speed >= 0.5 THEN 'run' ELSE 'slow' END AS pace, cb.ix, cb.iy, cb.kind FROM cb JOIN sd ON sd.cell = cb.cell AND sd.frame = cb.frame),
ks AS (SELECT 'all' AS spikes, ['error', 'click', 'view'] AS ks UNION ALL SELECT 'cs', ['error'] UNION ALL SELECT 'ss', ['click', 'view']),
rb AS (SELECT cell, pace, spikes, ix, iy, count(*) / 10.0 AS occ, count(*) FILTER (WHERE list_contains(ks, kind)) / (count(*) / 10.0) AS rate FROM pb, ks GROUP BY cell, pace, spikes, ix, iy),
wb AS (SELECT *, occ / sum(occ) OVER w AS p FROM rb WINDOW w AS (PARTITION BY cell, pace, spikes)),
mb AS (SELECT *, sum(p * rate) OVER (PARTITION BY cell, pace, spikes) AS mean FROM wb)"""


@query(with_tables("fb", f"SELECT cell, pace, spikes, {r('sum(CASE WHEN mean > 0 THEN rate * log2(rate / mean + 1e-15) * p ELSE 0 END)', 'info')} FROM mb GROUP BY ALL", BATCHES))
def m3_information_batches(spark: SparkSession, d: str) -> DataFrame:
    from framewise.operators.sequence import speed

    b = _coarse(speed(frames(spark, d)))
    fast = F.col("speed") >= 0.5
    kinds = {"all": F.col("kind").isin("error", "click", "view"), "cs": is_error(), "ss": F.col("kind").isin("click", "view")}
    return returned(C.information_batches(b, {"run": fast, "slow": ~fast}, kinds, 10.0))


CENTRES = """sg AS (SELECT cell, frame // 10 AS segment, avg(v) AS m FROM fr GROUP BY ALL),
sl AS (SELECT *, lag(m) OVER w AS pm, lag(segment) OVER w AS ps, lead(m) OVER w AS nm, lead(segment) OVER w AS ns FROM sg WINDOW w AS (PARTITION BY cell ORDER BY segment)),
fo AS (SELECT fr.cell, frame, frame - (segment * 10 + 4.5) AS off, sl.* EXCLUDE (cell) FROM fr JOIN sl ON sl.cell = fr.cell AND sl.segment = fr.frame // 10)"""


@query(with_tables("fr", f"SELECT cell, frame, {r('CASE WHEN off >= 0 THEN coalesce(m + (nm - m) * off / ((ns - segment) * 10), m) ELSE coalesce(m + (pm - m) * -off / ((segment - ps) * 10), m) END', 'snr')} FROM fo", CENTRES))
def m39_frame_snr(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d)
    segments = fr.groupBy("cell", F.floor(F.col("frame") / 10).cast("long").alias("segment")).agg(F.avg("v").alias("m"))
    return returned(R.through_centres(fr, segments, "m", 10, "snr"), "cell", "frame", "snr")
