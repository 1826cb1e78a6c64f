"""Recordings out of general tables: how cells, frames, bursts and maps are bound to them, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The arena in cm and its bins.
WIDTH, HEIGHT, BIN = 35.5, 20.0, 1.5
NX, NY = 24, 14


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per cell and frame: a trace v (vn with gaps), position, head direction, session, time in ms."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return events.select(
        F.col("user_id").alias("cell"),
        (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("frame"),
        "event_id",
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0).alias("ms"),
        F.col("event_type").alias("kind"),
        F.col("value").alias("v"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("vn"),
        F.pmod(k * 3.6, F.lit(360.0)).alias("hd"),
        F.pmod(F.col("value"), F.lit(WIDTH)).alias("x"),
        F.pmod(k, F.lit(HEIGHT)).alias("y"),
        F.when(F.dayofmonth("ts") <= 15, 1).otherwise(2).alias("session"),
    )


FRAMES = """fr AS (SELECT user_id AS cell, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame, event_id,
  epoch_us(ts) / 1000.0 AS ms, event_type AS kind, value AS v, CASE WHEN event_id % 7 <> 0 THEN value END AS vn,
  (CAST(json_extract_string(props, '$.k') AS DOUBLE) * CAST(3.6 AS DOUBLE)) % CAST(360 AS DOUBLE) AS hd, value % CAST(35.5 AS DOUBLE) AS x,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) % CAST(20 AS DOUBLE) AS y, CASE WHEN day(ts) <= 15 THEN 1 ELSE 2 END AS session FROM events)"""


def bursts(fr: DataFrame) -> DataFrame:
    """Bursts begin at purchases and last up to four more frames: cell, burst, lo, hi (inclusive), loc, peak."""
    length = F.col("event_id") % 5
    return fr.where("kind = 'purchase'").select(
        "cell", F.col("event_id").alias("burst"), F.col("frame").alias("lo"), (F.col("frame") + length).alias("hi"),
        (F.col("frame") + F.floor(length / 2)).cast("long").alias("loc"), F.col("v").alias("peak"),
    )


BURSTS = "bu AS (SELECT cell, event_id AS burst, frame AS lo, frame + event_id % 5 AS hi, frame + (event_id % 5) // 2 AS loc, v AS peak FROM fr WHERE kind = 'purchase')"


def spikes(fr: DataFrame) -> DataFrame:
    """Complex spikes are errors, simple ones clicks and views."""
    return fr.where("kind in ('error', 'click', 'view')").select("cell", "frame", F.when(F.col("kind") == "error", "cs").otherwise("ss").alias("kind"), "v")


SPIKES = "sp AS (SELECT cell, frame, CASE WHEN kind = 'error' THEN 'cs' ELSE 'ss' END AS kind, v FROM fr WHERE kind IN ('error', 'click', 'view'))"


def binned(fr: DataFrame) -> DataFrame:
    """With the bins of the position: ix, iy."""
    from framewise.functions.scalar import bin_index

    return fr.withColumns({"ix": bin_index(F.col("x"), BIN, NX), "iy": bin_index(F.col("y"), BIN, NY)})


BINNED = f"fb AS (SELECT *, CAST(least(greatest(floor(x / 1.5), 0), {NX - 1}) AS BIGINT) AS ix, CAST(least(greatest(floor(y / 1.5), 0), {NY - 1}) AS BIGINT) AS iy FROM fr)"


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 maps: map_id, label, ix, iy, value."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("map_id"), "label", F.posexplode("embedding").alias("p", "value"))
    return e.select("map_id", "label", F.floor(F.col("p") / 8).cast("long").alias("ix"), (F.col("p") % 8).cast("long").alias("iy"), F.col("value").cast("double").alias("value"))


MAPS = """mp AS (SELECT map_id, label, CAST(p // 8 AS BIGINT) AS ix, CAST(p % 8 AS BIGINT) AS iy, CAST(embedding[p + 1] AS DOUBLE) AS value
  FROM (SELECT vec_id AS map_id, label, embedding, unnest(range(len(embedding))) AS p FROM embeddings))"""


def returned(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """The columns, doubles rounded and without NaN."""
    from framewise.functions.scalar import number

    kinds = dict(df.dtypes)
    return df.select(*((F.round(number(F.col(c)), digits) + F.lit(0.0)).alias(c) if kinds[c] == "double" else F.col(c) for c in columns or df.columns))
