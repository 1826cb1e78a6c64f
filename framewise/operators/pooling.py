"""Tables pooled over recordings: cells with counts and classes, sessions side by side, similarity tables, trial stacks, parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.operators import intervals as I
from framewise.operators import statistics as T
from framewise.operators.sequence import FRAME, KEY


def pooled_cells(datasets: dict[str, DataFrame], deleted: DataFrame, counts: DataFrame, count: str, label: Column, name: str = "dataset") -> DataFrame:
    """The rows of all ``datasets`` under their names, without ``deleted`` (dataset, cell), with ``count`` of ``counts`` (dataset, cell; 0 where there is none) and class, by ``label``."""
    rows = reduce(DataFrame.unionByName, (df.withColumn(name, F.lit(k)) for k, df in datasets.items()))
    kept = rows.join(deleted.select(name, KEY).distinct(), [name, KEY], "left_anti")
    return kept.join(counts.select(name, KEY, count), [name, KEY], "left").withColumn(count, F.coalesce(count, F.lit(0).cast("long"))).withColumn("class", label)


def by_condition(cells: DataFrame, values: DataFrame, conditions: list[str], condition: str = "condition") -> DataFrame:
    """One row per cell of ``cells`` and condition with the columns of ``values`` (cell, condition, ...), and available: whether there were any."""
    every = cells.select(KEY).distinct().withColumn(condition, F.explode(F.array(*map(F.lit, conditions))))
    return every.join(values.withColumn("available", F.lit(True)), [KEY, condition], "left").withColumn("available", F.coalesce("available", F.lit(False)))


def similarity_tables(values: DataFrame, value: str, category: str, kind: str, first: str, second: str, *ident: str) -> tuple[DataFrame, DataFrame]:
    """Summaries of ``value`` by category and kind, and of the paired differences of kind ``first`` less ``second`` of the same ``ident`` by category."""
    wide = values.where(F.col(kind).isin(first, second) & F.col(value).isNotNull()).groupBy(*ident, category).agg(F.max(F.when(F.col(kind) == first, F.col(value))).alias("a"), F.max(F.when(F.col(kind) == second, F.col(value))).alias("b"))
    return T.summary(values, value, category, kind), T.summary(wide.where("a is not null and b is not null").withColumn("difference", F.col("a") - F.col("b")), "difference", category)


def trial_stack(trace: DataFrame, c: str, trials: DataFrame, bad: Column, pad: int, reach: int, base_lo: int, base_hi: int) -> DataFrame:
    """(cell, trial, offset, value): the trace around the centre of each trial (cell, trial, lo, hi), less its mean over offsets ``base_lo`` to ``base_hi``.

    A trial with a ``bad`` frame within ``pad`` frames of it goes; its centre is the first frame of its highest value. A trial without a
    known value in the base keeps its values as they are.
    """
    rows = trace.select(KEY, FRAME, F.col(c).alias("v"), bad.alias("bad"))
    wide = I.points_inside(rows, trials.select(KEY, "trial", (F.col("lo") - pad).alias("lo"), (F.col("hi") + pad).alias("hi")), "trial")
    good = wide.groupBy(KEY, "trial").agg(F.max(F.coalesce("p_bad", F.lit(True))).alias("spoiled")).where("not spoiled").select(KEY, "trial")
    inside = I.points_inside(rows, trials.select(KEY, "trial", "lo", "hi"), "trial").where("p_v is not null").join(good, [KEY, "trial"])
    centre = inside.groupBy(KEY, "trial").agg(F.max_by(F.col(FRAME), F.struct("p_v", -F.col(FRAME))).alias("centre"))
    span = centre.select(KEY, "trial", "centre", (F.col("centre") - reach).alias("lo"), (F.col("centre") + reach).alias("hi"))
    stack = I.points_inside(rows, span, "trial").select(KEY, "trial", (F.col(FRAME) - F.col("centre")).alias("offset"), F.col("p_v").alias("value"))
    base = stack.where(F.col("offset").between(base_lo, base_hi)).groupBy(KEY, "trial").agg(F.avg("value").alias("base"))
    return stack.join(base, [KEY, "trial"], "left").select(KEY, "trial", "offset", (F.col("value") - F.coalesce("base", F.lit(0.0))).alias("value"))


def clamped(value: Column, default: float, least: float | None = None, most: float | None = None) -> Column:
    """A parameter given as text: its number between ``least`` and ``most``, or the default where it is none."""
    x = value.try_cast("double")
    x = F.coalesce(F.when(F.isnan(x), None).otherwise(x), F.lit(float(default)))
    x = F.greatest(x, F.lit(float(least))) if least is not None else x
    return F.least(x, F.lit(float(most))) if most is not None else x
