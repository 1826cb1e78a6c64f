"""Labels of what edges connect, spread in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.scratch import stored


def smallest_labels(edges: DataFrame) -> DataFrame:
    """(id, label): for each end of ``edges`` (a, b) the smallest id that it is connected with.

    In a round a label takes the smallest label next to it, and then that label's own; rounds grow with the logarithm of a chain's
    length, and each is a written table.  No task holds more than a join's rows.
    """
    both = stored(edges.select("a", "b").where("a != b").unionAll(edges.select("b", "a").where("a != b")).distinct(), "edges")
    to = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = both.join(to.select(F.col("id").alias("b"), F.col("label").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        leap = to.select(F.col("id").alias("label"), F.col("label").alias("leap"))
        step = to.join(near.withColumnRenamed("a", "id"), "id").join(leap, "label").select("id", F.least("label", "near", "leap").alias("to"), (F.least("near", "leap") < F.col("label")).alias("moved"))
        to = stored(step.withColumnRenamed("to", "label"), "labels")
        if to.where("moved").isEmpty():
            return to.select("id", "label")
