"""Interval operators: runs, merges, masks, interval joins, session slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.binding import bursts, frames, returned, spikes, table
from framewise.operators import intervals as I
from framewise.operators import sequence as S
from framewise.queries.registry import CELL, query, r, with_tables
from framewise.queries.sequence import ANCHORS, SPEED
from framewise.sources.recordings import job_results, split_by_sessions


def runs_sql(source: str, flag: str, name: str = "ru") -> str:
    return f"{name} AS (SELECT cell, min(frame) AS lo, max(frame) AS hi FROM (SELECT cell, frame, frame - row_number() OVER ({CELL}) AS g FROM {source} WHERE {flag}) GROUP BY cell, g)"


def merge_sql(source: str, touch: int, name: str = "me") -> str:
    return f"""{name}0 AS (SELECT *, max(hi) OVER (PARTITION BY cell ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM {source}),
{name}1 AS (SELECT *, sum(CASE WHEN b IS NULL OR lo > b + {touch} THEN 1 ELSE 0 END) OVER (PARTITION BY cell ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM {name}0),
{name} AS (SELECT cell, min(lo) AS lo, max(hi) AS hi FROM {name}1 GROUP BY cell, g)"""


@query(with_tables("fr", "SELECT * FROM ru", runs_sql("fr", "v > 200")))
def i1_runs(spark: SparkSession, d: str) -> DataFrame:
    return I.runs(frames(spark, d).withColumn("on", F.col("v") > 200), "on")


@query(with_tables("bu", "SELECT * FROM me", merge_sql("bu", 1)))
def i2_merge_touching(spark: SparkSession, d: str) -> DataFrame:
    return I.merged(bursts(frames(spark, d)), 1)


@query(with_tables("bu", "SELECT * FROM me", merge_sql("bu", 0)))
def i3_merge_overlapping(spark: SparkSession, d: str) -> DataFrame:
    return I.merged(bursts(frames(spark, d)), 0)


@query(with_tables("bu", "SELECT cell, burst, greatest(lo, 10) AS lo, least(hi, 40) AS hi FROM bu WHERE hi >= 10 AND lo <= 40"))
def i4_clip(spark: SparkSession, d: str) -> DataFrame:
    return I.clipped(bursts(frames(spark, d)), 10, 40).select("cell", "burst", "lo", "hi")


@query(with_tables("fr", "SELECT * FROM ru WHERE hi - lo + 1 >= 2", SPEED + ",\n" + runs_sql("sd", "speed > 0.0005")))
def i5_speed_epochs(spark: SparkSession, d: str) -> DataFrame:
    return I.long_runs(S.speed(frames(spark, d)).withColumn("fast", F.col("speed") > 0.0005), "fast", 2)


@query(with_tables("fr", "SELECT f.cell, f.frame FROM fr f JOIN ru ON f.cell = ru.cell AND f.frame BETWEEN lo AND hi WHERE hi - lo + 1 >= 3", runs_sql("fr", "v > 200")))
def i6_min_duration_frames(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d)
    long = I.long_runs(fr.withColumn("on", F.col("v") > 200), "on", 3)
    return I.covered(fr, long, "keep").where("keep").select("cell", "frame")


MOVING = SPEED + f""",
sv AS (SELECT cell, frame, CASE WHEN speed <= 0.002 THEN speed END AS vn FROM sd),
{ANCHORS.replace("FROM fr", "FROM sv")},
iv AS (SELECT cell, frame, CASE WHEN vn IS NOT NULL THEN vn WHEN bf IS NULL THEN av WHEN af IS NULL THEN bv ELSE bv + (av - bv) * (frame - bf) / (af - bf) END AS i FROM an),
sm AS (SELECT cell, frame, coalesce(sum(i) OVER ({CELL} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0) / 5.0 AS m FROM iv),
{runs_sql("sm", "m > 0.0004")},
lr AS (SELECT * FROM ru WHERE hi - lo + 1 >= 2),
{merge_sql("lr", 3)}"""


@query(with_tables("fr", "SELECT * FROM me", MOVING))
def i7_moving(spark: SparkSession, d: str) -> DataFrame:
    return I.moving(S.speed(frames(spark, d)), 0.002, 5, 0.0004, 2, 3)


@query(
    with_tables("fr", f"""SELECT an.cell, an.frame, {r("CASE WHEN vn IS NOT NULL THEN vn WHEN lo IS NOT NULL AND bf IS NOT NULL AND af IS NOT NULL THEN bv + (av - bv) * (an.frame - bf) / (af - bf) END", "filled")}
    FROM an LEFT JOIN ru ON an.cell = ru.cell AND an.frame BETWEEN lo AND hi AND hi - lo < 1""", ANCHORS + ",\n" + runs_sql("fr", "vn IS NULL"))
)
def i8_short_gap_fill(spark: SparkSession, d: str) -> DataFrame:
    return returned(I.short_gaps_filled(frames(spark, d), "vn", 1, "filled"), "cell", "frame", "filled")


@query(with_tables("bu", "SELECT * FROM me", runs_sql("fr", "v > 300") + ",\nun AS (SELECT cell, lo, hi FROM ru WHERE hi > lo UNION ALL SELECT cell, lo, hi FROM bu WHERE hi - lo >= 3),\n" + merge_sql("un", 1)))
def i9_plateau_union(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d)
    plateaus = I.long_runs(fr.withColumn("on", F.col("v") > 300), "on", 2)
    return I.merged(plateaus.unionByName(bursts(fr).where("hi - lo >= 3").select("cell", "lo", "hi")), 1)


IN = "EXISTS (SELECT 1 FROM bu WHERE bu.cell = f.cell AND f.frame BETWEEN bu.lo AND bu.hi)"


@query(with_tables("bu", f"SELECT cell, frame, {IN} AS bad FROM fr f"))
def p1_bad_mask(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d)
    return I.covered(fr, bursts(fr), "bad").select("cell", "frame", "bad")


@query(with_tables("bu", f"SELECT cell, frame FROM fr f WHERE vn IS NOT NULL AND hd IS NOT NULL AND NOT {IN}"))
def p3_valid_frames(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d)
    return I.covered(fr, bursts(fr), "bad").where("vn is not null and hd is not null and not bad").select("cell", "frame")


@query(with_tables("bu", f"SELECT cell, frame FROM fr f WHERE NOT {IN.replace('BETWEEN bu.lo AND bu.hi', '>= bu.lo AND f.frame < bu.hi')}"))
def p19_manual_exclusion(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d)
    return I.covered(fr, bursts(fr), "bad", end=0).where("not bad").select("cell", "frame")


INSIDE = "ci AS (SELECT bu.cell, bu.burst, bu.lo, bu.loc, count(sp.frame) AS n, min(sp.frame) AS first FROM bu LEFT JOIN sp ON sp.cell = bu.cell AND sp.frame BETWEEN bu.lo AND bu.hi GROUP BY ALL)"


@query(with_tables("bu sp", "SELECT cell, burst, n, first FROM ci", INSIDE))
def j8_spikes_in_windows(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d)
    return I.count_inside(spikes(fr), bursts(fr), "burst").select("cell", "burst", "n", "first")


@query(with_tables("bu sp", "SELECT DISTINCT cell, first AS frame FROM ci WHERE first IS NOT NULL", INSIDE.replace("sp ON", "(SELECT * FROM sp WHERE kind = 'cs') sp ON")))
def j9_first_complex_spike(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d)
    return I.burst_events(bursts(fr), spikes(fr).where("kind = 'cs'"))


@query(with_tables("bu", "SELECT DISTINCT cell, loc AS frame FROM bu"))
def j9_burst_locations(spark: SparkSession, d: str) -> DataFrame:
    """Where no list of complex spikes was made."""
    return I.burst_events(bursts(frames(spark, d)), None)


@query(with_tables("bu sp", "SELECT cell, burst, CASE WHEN n > 1 THEN 'burst' WHEN n = 1 THEN 'simple' ELSE 'dropped' END AS kept_as FROM ci", INSIDE))
def g13_reconcile_bursts(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d)
    c = I.count_inside(spikes(fr), bursts(fr), "burst")
    return c.select("cell", "burst", F.when(F.col("n") > 1, "burst").when(F.col("n") == 1, "simple").otherwise("dropped").alias("kept_as"))


@query(with_tables("bu sp", f"SELECT cell, frame FROM sp f WHERE kind = 'ss' AND v >= 400 AND NOT {IN}"))
def g14_rescued_spikes(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d)
    inside = I.points_inside(spikes(fr), bursts(fr), "burst").select("cell", "frame").distinct()
    return spikes(fr).where("kind = 'ss' and v >= 400").join(inside, ["cell", "frame"], "left_anti").select("cell", "frame")


RANGES = "sr AS (SELECT cell, session, lo, coalesce(lead(lo) OVER (PARTITION BY cell ORDER BY session), last + 1) AS hi FROM (SELECT cell, session, min(frame) AS lo, max(frame) AS last FROM fr GROUP BY ALL))"


@query(with_tables("fr", "SELECT * FROM sr", RANGES))
def p15_session_ranges(spark: SparkSession, d: str) -> DataFrame:
    return I.session_ranges(frames(spark, d))


@query(with_tables("bu", "SELECT bu.cell, burst, session, bu.lo - sr.lo AS lo, bu.hi - sr.lo AS hi FROM bu JOIN sr ON bu.cell = sr.cell AND bu.lo < sr.hi AND bu.hi >= sr.lo", RANGES))
def p14_sliced_bursts(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d)
    return I.sliced(bursts(fr), I.session_ranges(fr)).select("cell", "burst", "session", "lo", "hi")


@query(with_tables("sp", "SELECT DISTINCT sp.cell, CAST(k.frame AS BIGINT) AS frame FROM sp JOIN k ON sp.cell = k.cell AND sp.frame = k.old", f"k AS (SELECT cell, frame AS old, row_number() OVER ({CELL}) - 1 AS frame FROM fr WHERE vn IS NOT NULL)"))
def p13_remapped_spikes(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d)
    return I.remapped(spikes(fr), fr.where("vn is not null"))


@query(with_tables("bu", "SELECT cell, burst, lo, hi FROM bu WHERE lo < 30 AND loc < 30 AND hi < 30"))
def s21_first_minutes(spark: SparkSession, d: str) -> DataFrame:
    return bursts(frames(spark, d)).where("lo < 30 and loc < 30 and hi < 30").select("cell", "burst", "lo", "hi")


@query(with_tables("fr", f"SELECT cell, frame, {r('v', 'v')} FROM fr WHERE ms BETWEEN m + 86400000.0 AND m + 5 * 86400000.0", "").replace("FROM fr WHERE ms", "FROM (SELECT *, min(ms) OVER () AS m FROM fr) WHERE ms"))
def p12_time_window(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d)
    start = fr.agg(F.min("ms").alias("m"))
    return returned(fr.join(F.broadcast(start), (F.col("ms") >= F.col("m") + 86400000.0) & (F.col("ms") <= F.col("m") + 5 * 86400000.0)), "cell", "frame", "v")


@query(with_tables("fr", f"SELECT cell, frame, {r('CASE WHEN frame < lead THEN good ELSE v END', 'v')} FROM l", f"""k AS (SELECT *, min(CASE WHEN v >= 125 THEN frame END) OVER (PARTITION BY cell) AS lead FROM fr),
l AS (SELECT *, max(CASE WHEN frame = lead THEN v END) OVER (PARTITION BY cell) AS good FROM k)"""))
def p20_dark_frame_repair(spark: SparkSession, d: str) -> DataFrame:
    """The leading frames under the level take the first good frame's value."""
    from pyspark.sql import Window as W

    cell = W.partitionBy("cell")
    good = F.min(F.when(F.col("v") >= 125, F.struct("frame", "v"))).over(cell)
    fr = frames(spark, d).withColumn("good", good)
    return returned(fr.withColumn("v", F.when(F.col("frame") < F.col("good.frame"), F.col("good.v")).otherwise(F.col("v"))), "cell", "frame", "v")


@query(
    with_tables("sp", "SELECT cell, frame + off AS frame, kind FROM sp JOIN o USING (cell)",
                "o AS (SELECT cell, CAST(coalesce(sum(n) OVER (ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM (SELECT cell, count(*) AS n FROM fr GROUP BY cell))")
)
def s22_session_merge(spark: SparkSession, d: str) -> DataFrame:
    """Recordings in a row: every cell's spikes move on by the frames of the cells before it (one row per cell meets in that window)."""
    from pyspark.sql import Window as W

    fr = frames(spark, d)
    n = fr.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    off = n.select("cell", F.coalesce(F.sum("n").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("off"))
    return spikes(fr).join(off, "cell").select("cell", (F.col("frame") + F.col("off")).alias("frame"), "kind")


@query(with_tables("sp", "SELECT sp.cell, session, frame - lo AS frame, kind FROM sp JOIN sr ON sr.cell = sp.cell AND frame >= lo AND frame < hi", RANGES))
def s8_split_by_sessions(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d)
    return split_by_sessions(spikes(fr).select("cell", "frame", "kind"), I.session_ranges(fr)).select("cell", "session", "frame", "kind")


@query("SELECT c_custkey, coalesce(status, 'missing') AS status FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderstatus) AS status FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def s12_job_results(spark: SparkSession, d: str) -> DataFrame:
    results = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderstatus").alias("status"))
    return job_results(table(spark, d, "customer").select("c_custkey"), results, "c_custkey").select("c_custkey", "status")
