"""Pooled tables, sessions side by side, similarity tables, trial stacks and parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.binding import bursts, frames, maps, returned, table
from framewise.operators import grids as G
from framewise.operators import pooling as P
from framewise.operators import statistics as T
from framewise.queries.registry import query, r, with_tables

POOLED = """ce AS (SELECT CASE WHEN session = 1 THEN 'first' ELSE 'second' END AS dataset, cell, avg(v) AS rate FROM fr GROUP BY ALL),
cn AS (SELECT CASE WHEN fr.session = 1 THEN 'first' ELSE 'second' END AS dataset, fr.cell, count(*) AS n_cb FROM bu JOIN fr ON fr.cell = bu.cell AND fr.frame = bu.lo GROUP BY ALL)"""


@query(with_tables("bu", f"SELECT dataset, cell, {r('rate', 'rate')}, coalesce(n_cb, 0) AS n_cb, CASE WHEN coalesce(n_cb, 0) >= 6 THEN 'CS+' ELSE 'CS-' END AS class FROM ce LEFT JOIN cn USING (dataset, cell) WHERE NOT (cell % 7 = 0 AND dataset = 'first')", POOLED))
def m10_pooled_cells(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d)
    of = lambda k: fr.where(F.col("session") == k).groupBy("cell").agg(F.avg("v").alias("rate"))
    deleted = fr.where("cell % 7 = 0").select(F.lit("first").alias("dataset"), "cell").distinct()
    at = bursts(fr).select("cell", F.col("lo").alias("frame")).join(fr.select("cell", "frame", "session"), ["cell", "frame"])
    counts = at.groupBy(F.when(F.col("session") == 1, "first").otherwise("second").alias("dataset"), "cell").agg(F.count(F.lit(1)).alias("n_cb"))
    return returned(P.pooled_cells({"first": of(1), "second": of(2)}, deleted, counts, "n_cb", F.when(F.col("n_cb") >= 6, "CS+").otherwise("CS-")), "dataset", "cell", "rate", "n_cb", "class")


@query(with_tables("fr", f"SELECT c.cell, k.condition, {r('m', 'mean')}, m IS NOT NULL AS available FROM (SELECT DISTINCT cell FROM fr) c CROSS JOIN (VALUES ('S1'), ('S2'), ('S3')) k(condition) LEFT JOIN (SELECT cell, CASE WHEN session = 1 THEN 'S1' ELSE 'S2' END AS condition, avg(v) AS m FROM fr WHERE cell % 5 <> 0 OR session = 1 GROUP BY ALL) v ON v.cell = c.cell AND v.condition = k.condition"))
def m11_session_groups(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d)
    values = fr.where("cell % 5 != 0 or session = 1").groupBy("cell", F.when(F.col("session") == 1, "S1").otherwise("S2").alias("condition")).agg(F.avg("v").alias("mean"))
    return returned(P.by_condition(fr, values, ["S1", "S2", "S3"]), "cell", "condition", "mean", "available")


SIMILAR = """pa AS (SELECT a.map_id, a.label, a.value AS x, b.value AS y FROM mp a JOIN mp b ON b.map_id = a.map_id + 1 AND a.ix = b.ix AND a.iy = b.iy),
si AS (SELECT map_id // 2 AS pair, label % 3 AS category, CASE WHEN map_id % 2 = 0 THEN 'ss' ELSE 'cs' END AS kind, sum(x * y) / sqrt(sum(x * x) * sum(y * y)) AS cosine FROM pa GROUP BY ALL),
df AS (SELECT a.category, a.cosine - b.cosine AS d FROM si a JOIN si b ON a.pair = b.pair AND a.category = b.category AND a.kind = 'ss' AND b.kind = 'cs')"""


@query(with_tables("mp", f"SELECT category, kind, count(*) AS n, {r('avg(v)', 'mean')}, {r('quantile_cont(v, 0.5)', 'median')}, {r('min(v)', 'least')}, {r('max(v)', 'most')} FROM (SELECT CAST(category AS BIGINT) AS category, kind, cosine AS v FROM si UNION ALL SELECT CAST(category AS BIGINT), 'ss less cs', d FROM df) GROUP BY ALL", SIMILAR))
def m23_similarity_tables(spark: SparkSession, d: str) -> DataFrame:
    m = maps(spark, d)
    b = m.select((F.col("map_id") - 1).alias("map_id"), "ix", "iy", F.col("value").alias("y"))
    pairs = m.select("map_id", "label", "ix", "iy", F.col("value").alias("x"), F.lit(1.0).alias("w")).join(b, ["map_id", "ix", "iy"])
    s = G.weighted_similarity(pairs, "x", "y", "w", "map_id", "label")
    s = s.select(F.floor(F.col("map_id") / 2).alias("pair"), (F.col("label") % 3).cast("long").alias("category"), F.when(F.col("map_id") % 2 == 0, "ss").otherwise("cs").alias("kind"), "cosine")
    each, paired = P.similarity_tables(s, "cosine", "category", "kind", "ss", "cs", "pair")
    return returned(each.unionByName(paired.withColumn("kind", F.lit("ss less cs"))), "category", "kind", "n", "mean", "median", "least", "most")


STACK = """ok AS (SELECT bu.cell, burst, lo, hi FROM bu WHERE NOT EXISTS (SELECT 1 FROM fr WHERE fr.cell = bu.cell AND frame BETWEEN lo - 2 AND hi + 2 AND v < 3)),
cc AS (SELECT cell, burst, frame AS centre FROM (SELECT ok.cell, burst, frame, row_number() OVER (PARTITION BY ok.cell, burst ORDER BY v DESC, frame) AS k FROM ok JOIN fr ON fr.cell = ok.cell AND frame BETWEEN lo AND hi) WHERE k = 1),
sk AS (SELECT cc.cell, burst, frame - centre AS o, v FROM cc JOIN fr ON fr.cell = cc.cell AND frame BETWEEN centre - 4 AND centre + 4)"""


@query(with_tables("bu", f"SELECT cell, burst AS trial, o AS \"offset\", {r('v - coalesce(avg(v) FILTER (o BETWEEN -4 AND -3) OVER (PARTITION BY cell, burst), 0)', 'value')} FROM sk", STACK))
def m36_trial_stacks(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d)
    return returned(P.trial_stack(fr, "v", bursts(fr).withColumnRenamed("burst", "trial"), F.col("v") < 3, 2, 4, -4, -3))


@query("SELECT event_id, round(least(greatest(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 5), 10), 60), 6) + 0.0 AS k, round(CASE WHEN event_type = 'view' THEN 5 ELSE least(greatest(coalesce(TRY_CAST(event_type AS DOUBLE), 7), 0), 50) END, 6) + 0.0 AS j FROM events")
def p18_clamped_parameters(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    j = F.when(F.col("event_type") == "view", F.lit(5.0)).otherwise(P.clamped(F.col("event_type"), 7, 0, 50))
    return returned(e.select("event_id", P.clamped(F.get_json_object("props", "$.k"), 5, 10, 60).alias("k"), j.alias("j")))



@query(with_tables("fr", f"SELECT cell, count(v) AS n, {r('avg(v)', 'mean')}, {r('(avg(v) - 100) / nullif(stddev_samp(v) / sqrt(count(v)), 0)', 't')} FROM fr GROUP BY cell"))
def m17_one_sample(spark: SparkSession, d: str) -> DataFrame:
    return returned(T.one_sample(frames(spark, d), "v", 100.0, "cell"), "cell", "n", "mean", "t")


@query(with_tables("fr", f"SELECT grp, count(d) AS n, {r('avg(d)', 'mean')}, {r('avg(d) / nullif(stddev_samp(d) / sqrt(count(d)), 0)', 't')} FROM (SELECT cell % 3 AS grp, cell, avg(v) FILTER (session = 2) - avg(v) FILTER (session = 1) AS d FROM fr GROUP BY cell) WHERE d IS NOT NULL GROUP BY grp"))
def m14_pooled_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Sessions paired by cell, pooled over groups of cells."""
    of = lambda k: F.avg(F.when(F.col("session") == k, F.col("v")))
    pairs = frames(spark, d).groupBy("cell").agg((of(2) - of(1)).alias("d")).withColumn("grp", F.col("cell") % 3)
    return returned(T.one_sample(pairs, "d", 0.0, "grp"), "grp", "n", "mean", "t")


@query(with_tables("mp", f"SELECT a.map_id, count(*) AS bins, {r('corr(a.value, b.value)', 'pearson')} FROM mp a JOIN mp b ON b.map_id = a.map_id + 1 AND a.ix = b.ix AND a.iy = b.iy WHERE a.value > -0.1 AND b.value > -0.1 GROUP BY a.map_id HAVING count(*) >= 3"))
def j20_paired_maps(spark: SparkSession, d: str) -> DataFrame:
    """Maps of one shape, bin by bin where both have a value."""
    m = maps(spark, d).where("value > -0.1")
    pairs = m.select("map_id", "ix", "iy", F.col("value").alias("x")).join(m.select((F.col("map_id") - 1).alias("map_id"), "ix", "iy", F.col("value").alias("y")), ["map_id", "ix", "iy"])
    return returned(pairs.groupBy("map_id").agg(F.count(F.lit(1)).alias("bins"), F.corr("x", "y").alias("pearson")).where("bins >= 3"))
