"""Spike and burst detectors over traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.binding import bursts, frames, returned, spikes
from framewise.operators import detectors as D
from framewise.queries.registry import CELL, query, r, with_tables
from framewise.queries.sequence import ANCHORS, ROWS5


def _complex(fr: DataFrame) -> DataFrame:
    return spikes(fr).where("kind = 'cs'")


def _median(table: str, value: str) -> str:
    """nn, pd, md: the running median of 5 frames with mirrored ends."""
    return f"""nn AS (SELECT cell, frame, {value} AS v, count(*) OVER (PARTITION BY cell) AS n FROM {table}),
pd AS (SELECT * FROM nn UNION ALL SELECT cell, -1 - frame, v, n FROM nn WHERE frame < 2 UNION ALL SELECT cell, 2 * n - 1 - frame, v, n FROM nn WHERE frame >= n - 2),
mw AS (SELECT cell, frame, n, quantile_cont(v, 0.5) OVER {ROWS5} AS mid FROM pd),
md AS (SELECT cell, frame, mid FROM mw WHERE frame >= 0 AND frame < n)"""


BARE = "bl AS (SELECT cell, frame, CASE WHEN NOT EXISTS (SELECT 1 FROM sp WHERE sp.cell = f.cell AND sp.kind = 'cs' AND sp.frame BETWEEN f.frame - 1 AND f.frame + 1) THEN v END AS vn FROM fr f)"
LINE = f"{BARE},\n{ANCHORS.replace('FROM fr', 'FROM bl')},\nln AS (SELECT cell, frame, CASE WHEN vn IS NOT NULL THEN vn WHEN bf IS NULL THEN av WHEN af IS NULL THEN bv ELSE bv + (av - bv) * (frame - bf) / (af - bf) END AS line FROM an)"


@query(with_tables("sp", f"SELECT cell, frame, {r('mid', 'vm')} FROM md", f"{LINE},\n{_median('ln', 'line')}"))
def g15_subthreshold(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d)
    return returned(D.subthreshold(fr, "v", _complex(fr), 5, "vm"))


FIRST = f"""{_median('fr', 'v')},
de AS (SELECT cell, frame, frame // 20 AS segment, fr.v - mid AS d FROM fr JOIN md USING (cell, frame)),
dm AS (SELECT *, quantile_cont(d, 0.5) OVER (PARTITION BY cell, segment) AS m, lag(d) OVER ({CELL}) AS p, lead(d) OVER ({CELL}) AS q FROM de),
th AS (SELECT cell, segment, any_value(m) + 1.5 * 1.4826 * quantile_cont(abs(d - m), 0.5) AS height FROM dm GROUP BY ALL)"""


@query(with_tables("fr", f"SELECT cell, frame, {r('d', 'detrended')} FROM dm JOIN th USING (cell, segment) WHERE d > p AND d >= q AND d > height", FIRST))
def g19_first_round(spark: SparkSession, d: str) -> DataFrame:
    return returned(D.first_round(frames(spark, d), "v", 5, 20, 1.5))


@query(with_tables("fr", f"SELECT cell, segment, {r('height', 'height')} FROM th", FIRST))
def g22_segment_thresholds(spark: SparkSession, d: str) -> DataFrame:
    from framewise.operators.sequence import median_edge

    fr = frames(spark, d)
    flat = median_edge(fr.select("cell", "frame", "v"), "v", 5, "mid").select("cell", "frame", "mid").join(fr, ["cell", "frame"]).withColumn("d", F.col("v") - F.col("mid"))
    return returned(D.segment_thresholds(flat, "d", 20, 1.5))


RISE = f"""ri AS (SELECT cell, frame, v, v - lag(v) OVER ({CELL}) AS rise FROM fr),
iw AS (SELECT bu.cell, burst, frame, ri.v, rise FROM bu JOIN ri ON ri.cell = bu.cell AND frame BETWEEN lo AND hi),
to_ AS (SELECT cell, burst, frame AS steepest FROM (SELECT *, row_number() OVER (PARTITION BY cell, burst ORDER BY rise DESC, frame) AS k FROM iw WHERE rise IS NOT NULL) WHERE k = 1)"""


@query(with_tables("bu", "SELECT cell, burst, steepest, max(CASE WHEN frame <= steepest AND v <= 60 THEN frame END) AS onset FROM to_ JOIN iw USING (cell, burst) GROUP BY ALL", RISE))
def w22_last_before_crossing(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d)
    return D.onsets(fr, "v", bursts(fr), 60.0)


WINDOWS = """hs AS (SELECT cell, frame // 25 AS segment, max(v) AS height FROM fr GROUP BY ALL),
sc AS (SELECT fr.cell, frame, v / height AS s FROM fr JOIN hs ON hs.cell = fr.cell AND hs.segment = fr.frame // 25),
on_ AS (SELECT cell, frame, s, frame - row_number() OVER (PARTITION BY cell ORDER BY frame) AS g FROM sc WHERE s > 0.15),
rw AS (SELECT cell, min(frame) AS lo, max(frame) AS hi, max(s) AS amplitude, count(*) AS frames FROM on_ GROUP BY cell, g),
hi_ AS (SELECT rw.cell, lo, sp.frame, sp.frame - lag(sp.frame) OVER (PARTITION BY rw.cell, lo ORDER BY sp.frame) AS gap FROM rw JOIN (SELECT DISTINCT cell, frame FROM sp) sp ON sp.cell = rw.cell AND sp.frame BETWEEN lo AND hi),
bw AS (SELECT rw.*, coalesce(n, 0) AS n_spikes, least_isi FROM rw LEFT JOIN (SELECT cell, lo, count(*) AS n, min(gap) AS least_isi FROM hi_ GROUP BY ALL) USING (cell, lo))"""


def _windows(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d)
    height = fr.groupBy("cell", F.floor(F.col("frame") / 25).cast("long").alias("segment")).agg(F.max("v").alias("height"))
    return D.burst_windows(fr, "v", height, 25, 0.15, spikes(fr))


@query(with_tables("sp", f"SELECT cell, lo, hi, {r('amplitude', 'amplitude')}, frames, n_spikes, least_isi FROM bw", WINDOWS))
def g17_burst_windows(spark: SparkSession, d: str) -> DataFrame:
    return returned(_windows(spark, d))


@query(with_tables("sp", "SELECT cell, lo, hi, CASE WHEN n_spikes < 3 THEN 'few spikes' WHEN amplitude < 0.6 THEN 'low' WHEN frames < 5 THEN 'short' WHEN NOT coalesce(n_spikes >= 2 AND least_isi <= 1, false) THEN 'slow' ELSE 'complex' END AS verdict FROM bw", WINDOWS))
def g16_burst_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d).select("cell", "lo", "hi", D.burst_verdict(3, 0.6, 5, 1, True).alias("verdict"))


PLATEAU = """on_ AS (SELECT cell, frame, v, frame - row_number() OVER (PARTITION BY cell ORDER BY frame) AS g FROM fr WHERE v > 40),
rw AS (SELECT *, min(frame) OVER (PARTITION BY cell, g) AS lo, max(frame) OVER (PARTITION BY cell, g) AS hi, max(v) OVER (PARTITION BY cell, g) AS peak FROM on_),
st AS (SELECT *, frame - row_number() OVER (PARTITION BY cell, lo ORDER BY frame) AS h FROM rw WHERE v >= 0.5 * peak),
ls AS (SELECT cell, lo, hi, peak, max(n) AS high FROM (SELECT cell, lo, hi, peak, h, count(*) AS n FROM st GROUP BY ALL) GROUP BY ALL)"""


@query(with_tables("fr", f"SELECT cell, lo, hi, {r('peak', 'peak')}, high FROM ls WHERE peak >= 100 AND hi - lo + 1 >= 4 AND high >= 2", PLATEAU))
def g18_plateaus(spark: SparkSession, d: str) -> DataFrame:
    return returned(D.plateaus(frames(spark, d), "v", 40.0, 100.0, 4, 0.5, 2))


@query(with_tables("bu sp", "SELECT DISTINCT cell, frame, CASE WHEN EXISTS (SELECT 1 FROM fw WHERE fw.cell = s.cell AND s.frame BETWEEN lo AND hi) THEN 'complex' ELSE 'simple' END AS kind FROM sp s",
                   "fw AS (SELECT bu.cell, lo, hi FROM bu JOIN sp ON sp.cell = bu.cell AND sp.frame BETWEEN lo AND hi GROUP BY bu.cell, burst, lo, hi HAVING count(*) >= 2)"))
def g20_reassigned_spikes(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d)
    return D.reassigned(spikes(fr), bursts(fr), 2)


@query()
def w23_accepted_in_bursts(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d)
    return D.accepted_in_bursts(spikes(fr), bursts(fr), "v", [20.0, 60.0, 120.0])
