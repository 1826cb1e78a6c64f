"""Aggregates, masks, joins, rankings, statistics and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewise.binding import bursts, frames, returned, spikes, table
from framewise.functions.scalar import bin_index, p_text, selectivity, significance, truth
from framewise.operators import intervals as I
from framewise.operators import sequence as S
from framewise.operators import signals as G
from framewise.operators import statistics as T
from framewise.operators import traces as R
from framewise.plans.trace_view import trace_view
from framewise.queries.maps import is_error
from framewise.queries.models import ONE_FIT, ONE_TERM, chunks_sql
from framewise.queries.registry import CELL, query, r, with_tables
from framewise.queries.sequence import BASELINE
from framewise.streaming.spike_sessions import event_sessions


VIEW = f"""v0 AS (SELECT cell, frame, x, y, CASE WHEN EXISTS (SELECT 1 FROM bu WHERE bu.cell = f.cell AND f.frame BETWEEN lo AND hi) THEN NULL ELSE v END AS vn FROM fr f WHERE frame BETWEEN 4 AND 59),
{chunks_sql(30, 10, ["dx"], "vn").replace("FROM fr)", "FROM v0)")},
vw AS (SELECT cell, frame, sum(w * (val - {ONE_TERM})) AS vn FROM {ONE_FIT} GROUP BY cell, frame),
{BASELINE.replace("FROM fr f JOIN", "FROM vw f JOIN").replace("FROM fr GROUP", "FROM vw GROUP")},
de AS (SELECT cell, frame, vn - base AS d FROM ba),
zs AS (SELECT cell, frame, (frame - 4) // 6 AS bin, (d - avg(d) OVER c) / CASE WHEN stddev_pop(d) OVER c > 0 THEN stddev_pop(d) OVER c ELSE 1 END AS z FROM de WINDOW c AS (PARTITION BY cell)),
zr AS (SELECT *, row_number() OVER (PARTITION BY cell, bin ORDER BY z, frame) AS a, row_number() OVER (PARTITION BY cell, bin ORDER BY z DESC, frame) AS b FROM zs WHERE z IS NOT NULL)"""


@query(with_tables("bu", f"SELECT cell, bin, frame, {r('z', 'z')} FROM zr WHERE a = 1 OR b = 1", VIEW))
def entry_windowed_trace_view(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d)
    return returned(trace_view(fr.select("cell", "frame", "v", "x", "y"), bursts(fr).select("cell", "lo", "hi"), 4, 60, 8, 6, ["dx"], 30, 10))


# --- aggregates


@query(with_tables("fr", f"SELECT cell, frame, {r('(vn - avg(vn) OVER c) / CASE WHEN stddev_pop(vn) OVER c > 0 THEN stddev_pop(vn) OVER c ELSE 1 END', 'z')} FROM fr WINDOW c AS (PARTITION BY cell)"))
def a1_z_score(spark: SparkSession, d: str) -> DataFrame:
    return returned(R.z_scored(frames(spark, d), "vn", "z", "cell"), "cell", "frame", "z")


@query(with_tables("fr", f"SELECT cell, frame, {r('CASE WHEN hi > lo THEN (vn - lo) / (hi - lo) ELSE 0 END', 'n')} FROM (SELECT *, min(vn) OVER (PARTITION BY cell) AS lo, max(vn) OVER (PARTITION BY cell) AS hi FROM fr)"))
def a2_unit_range(spark: SparkSession, d: str) -> DataFrame:
    return returned(R.unit_range(frames(spark, d), "vn", "n", "cell"), "cell", "frame", "n")


MAD = "md AS (SELECT *, quantile_cont(vn, 0.5) OVER (PARTITION BY cell) AS m FROM fr)"


@query(with_tables("fr", f"SELECT cell, {r('any_value(m)', 'median')}, {r('1.4826 * quantile_cont(abs(vn - m), 0.5)', 'mad')} FROM md GROUP BY cell", MAD))
def a3_robust_mad(spark: SparkSession, d: str) -> DataFrame:
    return returned(R.median_and_mad(frames(spark, d), "vn", "cell"))


@query(with_tables("fr", f"SELECT cell, round(quantile_cont(vn, 0.5), 9) AS centre, round(CASE WHEN quantile_cont(vn, 0.99) > quantile_cont(vn, 0.01) THEN quantile_cont(vn, 0.99) - quantile_cont(vn, 0.01) WHEN stddev_pop(vn) > 0 THEN 6 * stddev_pop(vn) ELSE 1 END, 9) AS scale FROM fr GROUP BY cell"))
def a4_robust_scale(spark: SparkSession, d: str) -> DataFrame:
    return returned(R.centre_and_scale(frames(spark, d), "vn", "cell"), digits=9)


SEGMENT = "sm AS (SELECT *, frame // 20 AS segment, quantile_cont(vn, 0.5) OVER (PARTITION BY cell, frame // 20) AS m FROM fr)"


def _segments(fr: DataFrame) -> DataFrame:
    return R.with_segment_median(fr, "vn", 20, "m")


@query(with_tables("fr", f"SELECT cell, segment, {r('any_value(m) + 4 * quantile_cont(abs(vn - m), 0.5)', 'threshold')} FROM sm GROUP BY ALL", SEGMENT))
def a6_segment_threshold(spark: SparkSession, d: str) -> DataFrame:
    s = _segments(frames(spark, d)).groupBy("cell", "segment").agg((F.first("m") + 4 * F.percentile(F.abs(F.col("vn") - F.col("m")), 0.5)).alias("threshold"))
    return returned(s)


@query(
    with_tables("bu", f"SELECT cell, segment, {r('coalesce(quantile_cont(CASE WHEN NOT bad THEN v END, 0.5), quantile_cont(v, 0.5))', 'centre')} FROM ex GROUP BY ALL",
                "ex AS (SELECT cell, frame // 5 AS segment, v, EXISTS (SELECT 1 FROM bu WHERE bu.cell = f.cell AND f.frame BETWEEN lo AND hi) AS bad FROM fr f)")
)
def a7_threshold_without_bursts(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d)
    c = I.covered(fr, bursts(fr), "bad").groupBy("cell", F.floor(F.col("frame") / 5).cast("long").alias("segment"))
    return returned(c.agg(F.coalesce(F.percentile(F.when(~F.col("bad"), F.col("v")), 0.5), F.percentile("v", 0.5)).alias("centre")))


@query(with_tables("fr", f"SELECT cell, CAST(least(greatest(floor(v / 50), 0), 9) AS BIGINT) AS bin, {r('avg(hd)', 'mean')} FROM fr GROUP BY ALL"))
def a19_mean_by_index(spark: SparkSession, d: str) -> DataFrame:
    return returned(frames(spark, d).groupBy("cell", bin_index(F.col("v"), 50.0, 10).alias("bin")).agg(F.avg("hd").alias("mean")))


@query(with_tables("sp", f"SELECT sp.cell, kind, {r('count(*) / any_value(t)', 'rate')} FROM sp JOIN (SELECT cell, count(*) / 10.0 AS t FROM fr GROUP BY cell) USING (cell) GROUP BY ALL"))
def a21_rates_by_kind(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d)
    t = fr.groupBy("cell").agg((F.count(F.lit(1)) / 10.0).alias("t"))
    return returned(spikes(fr).groupBy("cell", "kind").agg(F.count(F.lit(1)).alias("n")).join(t, "cell").select("cell", "kind", (F.col("n") / F.col("t")).alias("rate")))


@query(with_tables("bu", f"SELECT cell, count(*) AS n, {r('CASE WHEN count(*) >= 10 THEN avg(peak) END', 'peak')}, {r('CASE WHEN count(*) >= 10 THEN 100.0 * avg(CAST(hi - lo >= 3 AS INTEGER)) END', 'plateau_pct')} FROM bu GROUP BY cell"))
def a22_burst_means(spark: SparkSession, d: str) -> DataFrame:
    enough = F.count(F.lit(1)) >= 10
    b = bursts(frames(spark, d)).groupBy("cell")
    return returned(b.agg(F.count(F.lit(1)).alias("n"), F.when(enough, F.avg("peak")).alias("peak"), F.when(enough, F.avg((F.col("hi") - F.col("lo") >= 3).cast("double")) * 100).alias("plateau_pct")))


@query(with_tables("bu sp", f"SELECT cell, {r('b / CAST(b + s AS DOUBLE)', 'probability')} FROM (SELECT cell, count(*) AS b FROM bu GROUP BY cell) JOIN (SELECT cell, count(*) AS s FROM sp WHERE kind = 'ss' GROUP BY cell) USING (cell)"))
def a23_burst_probability(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d)
    n = fr.groupBy("cell").agg(F.count_if(F.col("kind") == "purchase").alias("b"), F.count_if(F.col("kind").isin("click", "view")).alias("s")).where("b > 0 and s > 0")
    return returned(n.select("cell", (F.col("b") / (F.col("b") + F.col("s"))).alias("probability")))


@query(with_tables("bu", "SELECT bu.cell, burst, avg(CAST(fr.v >= 250 AS INTEGER)) >= 0.5 AS active FROM bu JOIN fr ON fr.cell = bu.cell AND fr.frame BETWEEN lo AND hi GROUP BY ALL"))
def a25_burst_state(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d)
    inside = I.points_inside(fr.select("cell", "frame", "v"), bursts(fr), "burst")
    return inside.groupBy("cell", "burst").agg((F.avg((F.col("p_v") >= 250).cast("double")) >= 0.5).alias("active"))


LINES = "li AS (SELECT l_suppkey, l_returnflag, l_linestatus, l_quantity AS q, l_extendedprice AS p, s_nationkey, n_regionkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"))


@query(f"SELECT l_returnflag AS category, count(l_quantity) AS n, {r('avg(l_quantity)', 'mean')}, {r('stddev_samp(l_quantity)', 'sd')}, {r('quantile_cont(l_quantity, 0.5)', 'median')}, {r('min(l_quantity)', 'least')}, {r('max(l_quantity)', 'most')}, {r('stddev_samp(l_quantity) / sqrt(count(l_quantity))', 'sem')} FROM lineitem GROUP BY ALL")
def a26_summary(spark: SparkSession, d: str) -> DataFrame:
    return returned(T.summary(_lines(spark, d), "q", "l_returnflag").withColumnRenamed("l_returnflag", "category"))


@query(f"SELECT l_returnflag AS category, {', '.join(f'round(quantile_cont(l_quantity, {q}), 6) AS p{int(q * 100)}' for q in (0.1, 0.25, 0.5, 0.75, 0.9))} FROM lineitem GROUP BY ALL")
def a27_percentiles(spark: SparkSession, d: str) -> DataFrame:
    qs = (0.1, 0.25, 0.5, 0.75, 0.9)
    s = _lines(spark, d).groupBy(F.col("l_returnflag").alias("category")).agg(F.percentile("q", F.array(*map(F.lit, qs))).alias("v"))
    return returned(s.select("category", *(F.get("v", F.lit(i)).alias(f"p{int(q * 100)}") for i, q in enumerate(qs))))


@query(f"SELECT n_name AS category, count(s_suppkey) AS n, {r('100.0 * count(s_suppkey) / sum(count(s_suppkey)) OVER ()', 'pct')} FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY n_name")
def a28_category_shares(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "supplier").where("s_acctbal > 5000").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, d, "nation").join(n, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(F.col("n_name").alias("category"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    total = c.agg(F.sum("n").alias("t"))
    return returned(c.join(F.broadcast(total)).select("category", "n", (F.col("n") * 100.0 / F.col("t")).alias("pct")))


@query(f"SELECT l_suppkey AS cell, {r('sum(CASE WHEN l_returnflag = chr(65) THEN l_quantity END)', 'a')}, {r('sum(CASE WHEN l_returnflag = chr(78) THEN l_quantity END)', 'n')}, {r('sum(CASE WHEN l_returnflag = chr(82) THEN l_quantity END)', 'r')} FROM lineitem GROUP BY ALL")
def a29_pivot(spark: SparkSession, d: str) -> DataFrame:
    p = _lines(spark, d).groupBy(F.col("l_suppkey").alias("cell")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("q"))
    return returned(p.toDF("cell", "a", "n", "r"))


@query(with_tables("fr", f"SELECT cell, frame // 10 AS bin, frame, {r('v', 'v')} FROM (SELECT *, row_number() OVER (PARTITION BY cell, frame // 10 ORDER BY v, frame) AS a, row_number() OVER (PARTITION BY cell, frame // 10 ORDER BY v DESC, frame) AS b FROM fr) WHERE a = 1 OR b = 1"))
def a30_envelope(spark: SparkSession, d: str) -> DataFrame:
    return returned(R.envelope(frames(spark, d), "v", 10))


@query(with_tables("fr", f"SELECT cell, segment, {r('1 / stddev_pop(vn - m)', 'snr')} FROM sm GROUP BY ALL HAVING stddev_pop(vn - m) > 0", SEGMENT))
def a34_segment_snr(spark: SparkSession, d: str) -> DataFrame:
    return returned(R.segment_snr(frames(spark, d), "vn", 20))


@query(with_tables("fr", f"SELECT cell, frame, {r('v - low', 'height')} FROM (SELECT *, min(v) OVER ({CELL} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS low FROM fr) WHERE kind = 'error' AND low IS NOT NULL"))
def a35_spike_height(spark: SparkSession, d: str) -> DataFrame:
    return returned(R.spike_height(frames(spark, d), "v", is_error(), 3, "height"), "cell", "frame", "height")


@query(with_tables("fr", f"SELECT {r('min(m)', 'lo')}, {r('max(m)', 'hi')} FROM (SELECT cell, avg(v) AS m FROM fr GROUP BY cell)"))
def a36_global_limits(spark: SparkSession, d: str) -> DataFrame:
    return returned(frames(spark, d).groupBy("cell").agg(F.avg("v").alias("m")).agg(F.min("m").alias("lo"), F.max("m").alias("hi")))


WAVES = """ev AS (SELECT sp.cell, sp.frame, CAST(o AS BIGINT) AS o, f.v FROM sp, (SELECT unnest(range(-2, 4)) AS o), fr f WHERE sp.kind = 'cs' AND f.cell = sp.cell AND f.frame = sp.frame + o),
wh AS (SELECT *, count(*) OVER (PARTITION BY cell, frame) AS n FROM ev)"""


def _waves(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d)
    return R.waveforms(fr, "v", spikes(fr).where("kind = 'cs'"), 2, 3)


@query(with_tables("sp", f"SELECT cell, o, count(*) AS n, {r('avg(v)', 'mean')}, {r('stddev_samp(v) / sqrt(count(*))', 'sem')} FROM wh WHERE n = 6 GROUP BY cell, o", WAVES))
def a38_event_average(spark: SparkSession, d: str) -> DataFrame:
    return returned(R.mean_waveform(_waves(spark, d), "v", "cell"))


@query(with_tables("sp", f"SELECT cell, frame AS at, o, {r('(v - lo) / (hi - lo)', 'w')} FROM (SELECT *, min(v) OVER (PARTITION BY cell, frame) AS lo, max(v) OVER (PARTITION BY cell, frame) AS hi FROM wh WHERE n = 6) WHERE hi > lo", WAVES))
def a39_normalised_waveform(spark: SparkSession, d: str) -> DataFrame:
    return returned(R.scaled_waveforms(_waves(spark, d), "v", "w"), "cell", "at", "o", "w")


@query(with_tables("fr", "SELECT session, kind, count(*) AS n FROM fr GROUP BY CUBE (session, kind)"))
def a41_state_cube(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).cube("session", "kind").agg(F.count(F.lit(1)).alias("n"))


# --- masks and filters


@query(with_tables("fr", "SELECT cell, frame, coalesce(vn < 50, true) AS bad FROM fr"))
def p4_snr_bad(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select("cell", "frame", F.coalesce(F.col("vn") < 50, F.lit(True)).alias("bad"))


@query(with_tables("fr", "SELECT DISTINCT cell FROM fr WHERE cell NOT IN (SELECT cell FROM fr GROUP BY cell HAVING avg(CAST(v < 250 AS INTEGER)) > 0.55)"))
def p5_kept_cells(spark: SparkSession, d: str) -> DataFrame:
    return R.without_share(frames(spark, d), F.col("v") < 250, 0.55)


@query(with_tables("fr", f"SELECT cell, {r('count(*) / 600.0', 'minutes')} FROM fr WHERE vn >= 50 GROUP BY cell HAVING count(*) / 600.0 >= 0.08"))
def p6_good_minutes(spark: SparkSession, d: str) -> DataFrame:
    return returned(R.good_minutes(frames(spark, d), F.col("vn") >= 50, 10.0, 0.08))


@query(with_tables("fr", f"SELECT cell, count(*) AS n, CAST(count_if(vn IS NULL) AS BIGINT) AS missing, CAST(count_if(hd > 350) AS BIGINT) AS turned, CAST(count_if(vn IS NOT NULL AND hd <= 350 AND v < 50) AS BIGINT) AS snr_only, {r('100.0 * count_if(vn IS NULL OR hd > 350 OR v < 50) / count(*)', 'pct')} FROM fr GROUP BY cell"))
def p7_removed_frames(spark: SparkSession, d: str) -> DataFrame:
    miss, turned, low = F.col("vn").isNull(), F.col("hd") > 350, F.col("v") < 50
    s = frames(spark, d).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count_if(miss).alias("missing"), F.count_if(turned).alias("turned"), F.count_if(~miss & ~turned & low).alias("snr_only"), (F.count_if(miss | turned | low) * 100.0 / F.count(F.lit(1))).alias("pct"))
    return returned(s)


@query(with_tables("fr", "SELECT cell FROM (SELECT cell, session, count(*) AS n FROM fr GROUP BY ALL) WHERE n >= 25 GROUP BY cell HAVING count(*) = 2"))
def p8_both_sessions(spark: SparkSession, d: str) -> DataFrame:
    n = frames(spark, d).groupBy("cell", "session").agg(F.count(F.lit(1)).alias("n")).where("n >= 25")
    return n.groupBy("cell").agg(F.count(F.lit(1)).alias("k")).where("k = 2").select("cell")


@query("SELECT doc_id, lower(trim(lang)) IN ('true', '1', 't', 'yes', 'y') AS truth FROM documents")
def p17_truth(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", truth(F.col("lang")).alias("truth"))


# --- joins

PAIRED = "ss AS (SELECT cell, session, avg(v) AS m, count(*) AS n FROM fr GROUP BY ALL)"


@query(with_tables("fr", f"SELECT a.cell, {r('a.m', 'm_s1')}, {r('b.m', 'm_s2')}, {r('(b.m - a.m) / (b.m + a.m)', 'change')} FROM ss a JOIN ss b USING (cell) WHERE a.session = 1 AND b.session = 2", PAIRED))
def j1_paired_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = frames(spark, d).groupBy("cell").agg(F.avg(F.when(F.col("session") == 1, F.col("v"))).alias("m_s1"), F.avg(F.when(F.col("session") == 2, F.col("v"))).alias("m_s2"))
    return returned(s.where("m_s1 is not null and m_s2 is not null").withColumn("change", selectivity(F.col("m_s2"), F.col("m_s1"))))


@query("SELECT s_suppkey AS cell, n_name AS class, coalesce(r_name, 'none') AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3")
def j2_overlaid_classes(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    s = s.join(table(spark, d, "region").where("r_regionkey < 3"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return s.select(F.col("s_suppkey").alias("cell"), F.col("n_name").alias("class"), F.coalesce("r_name", F.lit("none")).alias("region"))


@query("SELECT a.o_custkey AS cell, a.n AS n_high, b.n AS n_low FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY ALL) a JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice <= 200000 GROUP BY ALL) b USING (o_custkey)")
def j3_metric_merge(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("cell")).agg(F.count_if(F.col("o_totalprice") > 200000).alias("n_high"), F.count_if(F.col("o_totalprice") <= 200000).alias("n_low"))
    return o.where("n_high > 0 and n_low > 0")


@query("SELECT c_custkey AS cell FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)")
def j7_semi_and_anti(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    return c.join(table(spark, d, "nation").where("n_regionkey = 0"), F.col("c_nationkey") == F.col("n_nationkey"), "left_anti").select(F.col("c_custkey").alias("cell"))


ASOF = """be AS (SELECT cell, ms, x FROM fr WHERE event_id % 3 = 0),
al AS (SELECT f.cell, f.frame, f.ms, (SELECT max(b.ms) FROM be b WHERE b.cell = f.cell AND b.ms <= f.ms) AS b0, (SELECT min(b.ms) FROM be b WHERE b.cell = f.cell AND b.ms >= f.ms) AS b1 FROM fr f)"""


@query(with_tables("fr", f"SELECT al.cell, al.frame, {r('CASE WHEN b0 IS NULL THEN q.x WHEN b1 IS NULL OR b0 = b1 THEN p.x ELSE p.x + (q.x - p.x) * (al.ms - b0) / (b1 - b0) END', 'x')} FROM al LEFT JOIN be p ON p.cell = al.cell AND p.ms = b0 LEFT JOIN be q ON q.cell = al.cell AND q.ms = b1", ASOF))
def j10_aligned_position(spark: SparkSession, d: str) -> DataFrame:
    return returned(R.aligned(frames(spark, d), "ms", F.col("event_id") % 3 == 0, "x", "x"), "cell", "frame", "x")


@query(with_tables("fr", "SELECT a.cell, a.frame, b.kind FROM fr a JOIN fr b ON b.cell = a.cell AND b.frame = CAST(round_even(a.frame * 0.9, 0) AS BIGINT)"))
def j11_nearest_frame(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d)
    to = F.bround(F.col("frame") * F.lit(0.9)).cast("long")
    return fr.select("cell", "frame", to.alias("to")).join(fr.select("cell", F.col("frame").alias("to"), "kind"), ["cell", "to"]).select("cell", "frame", "kind")


@query(f"SELECT s_suppkey AS event, min_by(n, dist) AS cluster, {r('min(dist)', 'dist')} FROM (SELECT s_suppkey, n_nationkey AS n, abs(s_acctbal - n_nationkey * 400.5) AS dist FROM supplier, nation) WHERE dist <= 150 GROUP BY s_suppkey")
def j18_cluster_by_radius(spark: SparkSession, d: str) -> DataFrame:
    centres = table(spark, d, "nation").select(F.col("n_nationkey").alias("cluster"), (F.col("n_nationkey") * 400.5).alias("centre"))
    events = table(spark, d, "supplier").select(F.col("s_suppkey").alias("event"), F.col("s_acctbal").alias("at"))
    return returned(R.nearest_centre(events, "at", centres, "centre", "cluster", 150.0, "event"), "event", "cluster", "dist")


@query("SELECT a.r_name AS a, b.r_name AS b FROM region a JOIN region b ON a.r_name < b.r_name")
def j19_category_pairs(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "region").select("r_name")
    return names.select(F.col("r_name").alias("a")).join(names.select(F.col("r_name").alias("b")), F.col("a") < F.col("b"))


# --- rankings and sets


@query(with_tables("sp", f"SELECT cell, frame, {r('v', 'v')} FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY v DESC, frame) AS n FROM sp) WHERE n <= 5"))
def k1_top_spikes(spark: SparkSession, d: str) -> DataFrame:
    return returned(R.top(spikes(frames(spark, d)), 5, ["cell"], F.desc("v"), "frame"), "cell", "frame", "v")


@query(with_tables("fr", f"SELECT cell, round(quantile_cont(v, 0.95), 9) AS cut FROM fr GROUP BY cell"))
def k3_percentile_cut(spark: SparkSession, d: str) -> DataFrame:
    return returned(frames(spark, d).groupBy("cell").agg(F.percentile("v", 0.95).alias("cut")), digits=9)


@query("SELECT s_suppkey AS cell, s_nationkey AS category, CAST((row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) // 3 AS BIGINT) AS page FROM supplier")
def k5_pages(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell"), F.col("s_nationkey").alias("category"))
    return R.pages(s, 3, "category", "cell", "page")


@query(with_tables("fr", "SELECT cell, kind AS best FROM (SELECT cell, kind, row_number() OVER (PARTITION BY cell ORDER BY round(avg(v), 6) DESC, kind) AS n FROM fr GROUP BY cell, kind) WHERE n = 1"))
def k6_best_model(spark: SparkSession, d: str) -> DataFrame:
    m = frames(spark, d).groupBy("cell", "kind").agg(F.round(F.avg("v"), 6).alias("m"))
    return R.top(m, 1, ["cell"], F.desc("m"), "kind").select("cell", F.col("kind").alias("best"))


@query(with_tables("bu sp", "SELECT cell, frame FROM sp WHERE kind = 'cs' UNION SELECT cell, loc AS frame FROM bu"))
def set_spike_union(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d)
    return spikes(fr).where("kind = 'cs'").select("cell", "frame").union(bursts(fr).select("cell", "loc")).distinct()


@query(with_tables("bu sp", "(SELECT cell, frame FROM sp) EXCEPT (SELECT cell, loc FROM bu)"))
def set_spike_difference(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d)
    return spikes(fr).select("cell", "frame").subtract(bursts(fr).select("cell", "loc"))


@query(with_tables("bu sp", "(SELECT cell, frame FROM sp) INTERSECT (SELECT cell, loc FROM bu)"))
def set_spike_intersection(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d)
    return spikes(fr).select("cell", "frame").intersect(bursts(fr).select("cell", "loc"))


# --- classes, statistics


@query(with_tables("bu", "SELECT cell, CASE WHEN n_cb >= 10 AND top > 400 THEN 'CS+' WHEN n_cb >= 10 THEN 'CS-' ELSE 'other' END AS class FROM (SELECT f.cell, count(DISTINCT b.burst) AS n_cb, max(f.v) AS top FROM fr f LEFT JOIN bu b ON b.cell = f.cell AND b.loc = f.frame GROUP BY f.cell)"))
def m9_cell_class(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d)
    n = bursts(fr).join(fr.select("cell", F.col("frame").alias("loc")), ["cell", "loc"]).groupBy("cell").agg(F.count(F.lit(1)).alias("n_cb"))
    c = fr.groupBy("cell").agg(F.max("v").alias("top")).join(n, "cell", "left").withColumn("n_cb", F.coalesce("n_cb", F.lit(0).cast("long")))
    return c.select("cell", R.cell_class(F.col("n_cb"), F.col("top"), 10, 400.0).alias("class"))


PVALUES = "pv AS (SELECT s_suppkey AS test, s_nationkey AS family, ((s_suppkey * 7919) % 1000 + 1) / 5000.0 AS p FROM supplier)"


def _pvalues(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("test"), F.col("s_nationkey").alias("family"), ((F.col("s_suppkey") * 7919 % 1000 + 1) / 5000.0).alias("p"))


@query(f"WITH {PVALUES} SELECT test, family, {r('max(least(1.0, (m - n + 1) * p)) OVER (PARTITION BY family ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'adjusted')} FROM (SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p) AS n FROM pv)")
def m19_holm(spark: SparkSession, d: str) -> DataFrame:
    return returned(T.holm(_pvalues(spark, d), "p", "adjusted", "family"), "test", "family", "adjusted")


@query(f"WITH {PVALUES} SELECT test, family, {r('min(least(1.0, m * p / n)) OVER (PARTITION BY family ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)', 'adjusted')} FROM (SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p) AS n FROM pv)")
def m20_benjamini_hochberg(spark: SparkSession, d: str) -> DataFrame:
    return returned(T.benjamini_hochberg(_pvalues(spark, d), "p", "adjusted", "family"), "test", "family", "adjusted")


@query(f"WITH {PVALUES} SELECT test, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'n.s.' END AS label, CASE WHEN p < 0.0001 THEN 'p<1e-4' ELSE 'p=' || printf('%.3f', p) END AS shown FROM pv")
def fn_significance(spark: SparkSession, d: str) -> DataFrame:
    return _pvalues(spark, d).select("test", significance(F.col("p")).alias("label"), p_text(F.col("p")).alias("shown"))


@query(with_tables("fr", f"SELECT cell, {r('regr_slope(v, frame)', 'slope')}, {r('regr_intercept(v, frame)', 'intercept')}, {r('corr(v, frame)', 'r')} FROM fr GROUP BY cell"))
def m21_regression(spark: SparkSession, d: str) -> DataFrame:
    s = frames(spark, d).withColumn("f", F.col("frame").cast("double")).groupBy("cell")
    return returned(s.agg(F.regr_slope("v", "f").alias("slope"), F.regr_intercept("v", "f").alias("intercept"), F.corr("v", "f").alias("r")))


GROUP2 = "gs AS (SELECT cell, count(v) FILTER (WHERE session = 1) AS n1, avg(v) FILTER (WHERE session = 1) AS m1, var_samp(v) FILTER (WHERE session = 1) AS v1, count(v) FILTER (WHERE session = 2) AS n0, avg(v) FILTER (WHERE session = 2) AS m0, var_samp(v) FILTER (WHERE session = 2) AS v0 FROM fr GROUP BY cell)"


def _sides(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).withColumn("side", F.col("session") == 1)


@query(with_tables("fr", f"SELECT cell, n1 AS n_a, n0 AS n_b, {r('(m1 - m0) / sqrt(v1 / n1 + v0 / n0)', 't')}, {r('pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1))', 'dof')} FROM gs WHERE n1 > 1 AND n0 > 1", GROUP2))
def m16_welch_statistic(spark: SparkSession, d: str) -> DataFrame:
    return returned(T.t_statistics(_sides(spark, d), "v", "side", "cell").where("n_a > 1 and n_b > 1"))


@query(with_tables("fr", f"SELECT cell, n1 AS n_a, n0 AS n_b, {r('(m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1.0 / n1 + 1.0 / n0))', 't')} FROM gs WHERE n1 > 1 AND n0 > 1", GROUP2))
def m16_student_statistic(spark: SparkSession, d: str) -> DataFrame:
    return returned(T.t_statistics(_sides(spark, d), "v", "side", "cell", welch=False).where("n_a > 1 and n_b > 1"), "cell", "n_a", "n_b", "t")


@query()
def m16_welch_test(spark: SparkSession, d: str) -> DataFrame:
    return returned(T.t_test(_sides(spark, d), "v", "side", "cell"))


@query(with_tables("fr", f"SELECT cell, CAST(sum(CASE WHEN session = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_a, CAST(sum(CASE WHEN session = 2 THEN 1 ELSE 0 END) AS BIGINT) AS n_b, {r('sum(CASE WHEN session = 1 THEN rk ELSE 0 END) - sum(CASE WHEN session = 1 THEN 1 ELSE 0 END) * (sum(CASE WHEN session = 1 THEN 1 ELSE 0 END) + 1) / 2.0', 'u')} FROM (SELECT *, rank() OVER (PARTITION BY cell ORDER BY y) + (count(*) OVER (PARTITION BY cell, y) - 1) / 2.0 AS rk FROM fr) GROUP BY cell"))
def m16_rank_sum(spark: SparkSession, d: str) -> DataFrame:
    return returned(T.rank_sum(_sides(spark, d), "y", "side", "cell"), "cell", "n_a", "n_b", "u")


@query(with_tables("fr", f"SELECT cell, count(*) AS n, {r('sum(CASE WHEN dif > 0 THEN rk ELSE 0 END)', 'w')} FROM (SELECT cell, dif, rank() OVER (PARTITION BY cell ORDER BY abs(dif)) + (count(*) OVER (PARTITION BY cell, abs(dif)) - 1) / 2.0 AS rk FROM (SELECT cell, y - 10.0 AS dif FROM fr) WHERE dif <> 0) GROUP BY cell"))
def m15_signed_rank(spark: SparkSession, d: str) -> DataFrame:
    return returned(T.signed_rank(frames(spark, d).withColumn("dif", F.col("y") - 10.0), "dif", "cell"), "cell", "n", "w")


@query(f"WITH {LINES}, g AS (SELECT n_regionkey AS region, l_returnflag AS f, count(*) AS n, avg(q) AS m, var_samp(q) AS v FROM li GROUP BY ALL), t AS (SELECT *, sum(n * m) OVER w / sum(n) OVER w AS gm FROM g WINDOW w AS (PARTITION BY region)) SELECT region, count(*) - 1 AS d1, CAST(sum(n) - count(*) AS BIGINT) AS d2, {r('sum(n * pow(m - gm, 2)) / (count(*) - 1) / (sum((n - 1) * v) / (sum(n) - count(*)))', 'f')} FROM t GROUP BY region")
def m18_anova(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("region"))
    li = _lines(spark, d).join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return returned(T.anova(li, "q", "l_returnflag", "region"))


@query(with_tables("fr", f"SELECT q.cell, dof, {r('(12.0 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - tie / (CAST(n AS DOUBLE) * n * n - n))', 'h')} FROM q JOIN c USING (cell)", """rk AS (SELECT cell, kind, rank() OVER (PARTITION BY cell ORDER BY y) + (count(*) OVER (PARTITION BY cell, y) - 1) / 2.0 AS rk FROM fr),
q AS (SELECT cell, count(*) - 1 AS dof, sum(s * s / k) AS q FROM (SELECT cell, kind, sum(rk) AS s, count(*) AS k FROM rk GROUP BY ALL) GROUP BY cell),
c AS (SELECT cell, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * n * n - n) AS DOUBLE) AS tie FROM (SELECT cell, y, count(*) AS n FROM fr GROUP BY ALL) GROUP BY cell)"""))
def m18_kruskal(spark: SparkSession, d: str) -> DataFrame:
    return returned(T.kruskal(frames(spark, d), "y", "kind", "cell"))


@query()
def m22_outcomes(spark: SparkSession, d: str) -> DataFrame:
    t = T.t_test(_sides(spark, d), "v", "side", "cell")
    side = F.when(F.col("p") >= 0.05, "n.s.").when(F.col("t") > 0, "first").when(F.col("t") < 0, "second").otherwise("n.s.")
    return t.groupBy(side.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(with_tables("fr", "SELECT cell, frame, CAST(floor(frame * 5 / n) AS BIGINT) % 5 AS fold FROM (SELECT *, count(*) OVER (PARTITION BY cell) AS n FROM fr)"))
def m27_sections(spark: SparkSession, d: str) -> DataFrame:
    n = F.count(F.lit(1)).over(W.partitionBy("cell"))
    return frames(spark, d).select("cell", "frame", (F.floor(F.col("frame") * 5 / n) % 5).cast("long").alias("fold"))


@query(with_tables("fr", f"SELECT cell, {r('sum(cos(radians(hd)) * dx + sin(radians(hd)) * dy) / sum(sqrt(dx * dx + dy * dy))', 'agreement')} FROM (SELECT *, x - lag(x) OVER ({CELL}) AS dx, y - lag(y) OVER ({CELL}) AS dy FROM fr) WHERE dx IS NOT NULL GROUP BY cell"))
def m32_heading_agreement(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d).withColumns({"dx": F.col("x") - F.lag("x").over(S.by_cell()), "dy": F.col("y") - F.lag("y").over(S.by_cell())}).where("dx is not null")
    dot = F.cos(F.radians("hd")) * F.col("dx") + F.sin(F.radians("hd")) * F.col("dy")
    return returned(fr.groupBy("cell").agg((F.sum(dot) / F.sum(F.hypot("dx", "dy"))).alias("agreement")))


# --- signals


@query(with_tables("fr", f"SELECT cell, frame, round(x - avg(x) OVER c, 9) + 0.0 AS dx, round(y - avg(y) OVER c, 9) + 0.0 AS dy, round(pow(x - avg(x) OVER c, 2), 9) + 0.0 AS dx2, round(pow(y - avg(y) OVER c, 2), 9) + 0.0 AS dy2, round((x - avg(x) OVER c) * (y - avg(y) OVER c), 9) + 0.0 AS dxdy FROM fr WINDOW c AS (PARTITION BY cell)"))
def g23_motion_regressors(spark: SparkSession, d: str) -> DataFrame:
    c = frames(spark, d).withColumns({"dx": F.col("x") - F.avg("x").over(W.partitionBy("cell")), "dy": F.col("y") - F.avg("y").over(W.partitionBy("cell"))})
    c = c.withColumns({"dx2": F.col("dx") * F.col("dx"), "dy2": F.col("dy") * F.col("dy"), "dxdy": F.col("dx") * F.col("dy")})
    return returned(c, "cell", "frame", "dx", "dy", "dx2", "dy2", "dxdy", digits=9)


@query(with_tables("fr", "SELECT session, CAST(ceil(max(abs(x - 17.75))) AS BIGINT) + 3 AS margin_x, CAST(ceil(max(abs(y - 10))) AS BIGINT) + 3 AS margin_y FROM fr GROUP BY session"))
def g27_valid_view(spark: SparkSession, d: str) -> DataFrame:
    far = lambda c, mid: (F.ceil(F.max(F.abs(F.col(c) - mid))) + 3).cast("long")
    return frames(spark, d).groupBy("session").agg(far("x", 17.75).alias("margin_x"), far("y", 10.0).alias("margin_y"))


@query()
def m15_paired_decision(spark: SparkSession, d: str) -> DataFrame:
    return returned(T.paired_test(frames(spark, d).withColumn("d", F.col("v") - 245), "d", "cell"))


@query()
def m16_unpaired_decision(spark: SparkSession, d: str) -> DataFrame:
    return returned(T.unpaired_test(frames(spark, d).withColumn("side", F.col("session") == 1), "v", "side", "cell"))


@query()
def m18_omnibus_decision(spark: SparkSession, d: str) -> DataFrame:
    return returned(T.omnibus_test(frames(spark, d), "v", "kind", "cell"))


@query()
def g1_butterworth_highpass(spark: SparkSession, d: str) -> DataFrame:
    return returned(G.butterworth(frames(spark, d), "vn", "filtered", 0.05))


@query()
def g3_fft_highpass(spark: SparkSession, d: str) -> DataFrame:
    return returned(G.fft_highpass(frames(spark, d), "vn", "filtered", 0.05))


@query()
def w12_find_peaks(spark: SparkSession, d: str) -> DataFrame:
    return returned(G.find_peaks(frames(spark, d), "v", 250.0, 4))


@query()
def m26_poisson_tuning(spark: SparkSession, d: str) -> DataFrame:
    c = frames(spark, d).groupBy("cell", F.floor(F.col("hd") / 30).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("frames"), F.sum(is_error().cast("long")).alias("spikes"))
    return returned(G.poisson_tuning(c, 12, 1.0))


@query("""SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS "end", count(*) AS n, round(sum(value), 6) AS total FROM (
  SELECT *, sum(CASE WHEN gap IS NULL OR gap > INTERVAL 6 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g
  FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY user_id, g""")
def w14_gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    return returned(event_sessions(table(spark, d, "events"), "6 hours", "1 day"))

