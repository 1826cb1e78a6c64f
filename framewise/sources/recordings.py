"""Readers of recording side files, and the writer of per-session annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def experiment(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, frame_rate) of experiment descriptions in XML; attributes in any order, null where missing."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("xml"))
    attribute = lambda n: F.nullif(F.regexp_extract("xml", rf'<LSM\b[^>]*\b{n}="([^"]*)"', 1), F.lit(""))
    return files.select("path", attribute("pixelX").cast("int").alias("width"), attribute("pixelY").cast("int").alias("height"), attribute("frameRate").cast("double").alias("frame_rate"))


def pose(spark: SparkSession, path: str) -> DataFrame:
    """(frame, part, x, y, likelihood) of a pose table with three header lines: scorer, body parts, coordinates."""
    #: Three lines of one file: where there are several, all have the same header.
    first = spark.read.format("binaryFile").load(path).select("path").orderBy("path").first()
    head = [x.value.split(",") for x in spark.read.text(first["path"]).limit(3).collect()] if first else []
    if len(head) < 3 or len({len(h) for h in head}) != 1:
        raise ValueError(f"{path} has no header of three equal lines")
    names = ["frame", *(f"{p}|{c}" for p, c in zip(head[1][1:], head[2][1:], strict=True))]
    rows = spark.read.option("mode", "DROPMALFORMED").schema(", ".join(f"`{n}` double" for n in names)).csv(path).where("frame is not null")
    parts = list(dict.fromkeys(head[1][1:]))
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("part"), *(F.col(f"`{p}|{c}`").alias(c) for c in ("x", "y", "likelihood"))) for p in parts)))
    return rows.select(F.col("frame").cast("long").alias("frame"), each.alias("p")).select("frame", "p.*")


def manifest(spark: SparkSession, path: str, old_prefix: str = "", new_prefix: str = "") -> DataFrame:
    """(session, path, n_frames, lo): the sessions of a manifest, their paths moved to another prefix, and where each begins."""
    from pyspark.sql import Window as W

    m = spark.read.schema("sessions array<struct<session:int,path:string,n_frames:long>>").option("multiLine", True).json(path)
    s = m.select(F.explode("sessions").alias("s")).select("s.*")
    moved = F.when(F.startswith("path", F.lit(old_prefix)), F.concat(F.lit(new_prefix), F.substring("path", len(old_prefix) + 1, 1 << 20))).otherwise(F.col("path"))
    before = F.sum("n_frames").over(W.orderBy("session").rowsBetween(W.unboundedPreceding, -1))
    return s.select("session", moved.alias("path"), "n_frames", F.coalesce(before, F.lit(0).cast("long")).alias("lo"))


def write_annotations(frames: DataFrame, path: str) -> None:
    """Frame tables by session and cell, bad frames without a value."""
    frames.withColumn("v", F.when(~F.col("bad"), F.col("v"))).repartition("session", "cell").sortWithinPartitions("cell", "frame").write.partitionBy("session").parquet(path)


def newest_pose(spark: SparkSession, folder: str) -> str:
    """Path of the newest pose table of a folder, of those with ``filtered`` in their names if there are any."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path", "modificationTime")
    best = files.orderBy(F.element_at(F.split("path", "/"), -1).contains("filtered").desc(), F.desc("modificationTime"), "path").first()
    if best is None:
        raise FileNotFoundError(f"no pose table in {folder}")
    return best["path"]


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first of the paths that exists, in any store that Spark reads."""
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return p
    return None


def discovered(spark: SparkSession, pattern: str) -> list[str]:
    """Folders that a glob pattern matches, in order of their names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(x.getPath().toString() for x in found or [] if x.isDirectory())


def write_statistics(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def read_statistics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A statistics table; a column that isn't in the file, or a value of another kind, is an error."""
    return spark.read.option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).schema(schema).csv(path)


def pooled_summaries(spark: SparkSession, paths: list[str], axis: str) -> DataFrame:
    """Parquet tables one under the other, by column name, without those rows whose array ``axis`` isn't that of the first table."""
    tables = [spark.read.parquet(p) for p in paths]
    first = tables[0].select(F.col(axis).alias("__axis")).limit(1)
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.join(F.broadcast(first), F.col(axis) == F.col("__axis"), "left_semi")


def job_results(manifest: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Every job of the manifest with its result, and its status: the result's own, or ``missing``."""
    return manifest.join(results, key, "left").withColumn("status", F.coalesce("status", F.lit("missing")))


def split_by_sessions(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """Points with the session whose frames [lo, hi) hold them, their frames counted from its start; others go.  A cell has a few sessions."""
    r = ranges.select("cell", "session", F.col("lo").alias("__lo"), F.col("hi").alias("__hi"))
    j = points.join(r, "cell").where("frame >= __lo and frame < __hi")
    return j.withColumn("frame", F.col("frame") - F.col("__lo")).drop("__lo", "__hi")
