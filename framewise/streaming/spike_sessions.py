"""Groups of events by gaps, as a stream: session windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.scratch import scratch_path


def event_sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """(user_id, start, end, n, total) of runs of events no farther apart than ``gap``; state of a run goes once ``late`` has passed."""
    s = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return s.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def drained(spark: SparkSession, stream: DataFrame, tag: str, mode: str = "append") -> DataFrame:
    """What a stream of files gives until its source is used up, written to the shared folder and read back."""
    path = scratch_path(spark, tag)
    q = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
