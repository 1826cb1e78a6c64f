"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.scratch import scratch_path as fresh_path
from framewise.scratch import stored

__all__ = ["bound", "fresh_path", "stored", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once a row, however often ``use`` names it, in lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
