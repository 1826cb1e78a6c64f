"""Scalar functions of angles, bins, ratios and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """A double whose NaN and infinities are null."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def wrap_degrees(c: Column) -> Column:
    return F.pmod(c, F.lit(360.0))


def circular_distance(a: Column, b: Column) -> Column:
    """Degrees between two directions, 0 to 180."""
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def bin_index(c: Column, width: float, n: int, lo: float = 0.0) -> Column:
    """Bin of a value in n bins from ``lo`` on; values outside count to the first or last bin, null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(F.floor((c - lo) / width), F.lit(0)), F.lit(n - 1)).cast("long"))


def selectivity(a: Column, b: Column, least: float = 0.0) -> Column:
    """(a - b) / (a + b), null unless the sum's absolute value exceeds ``least``."""
    return F.when(F.abs(a + b) > least, (a - b) / (a + b))


def significance(p: Column) -> Column:
    return F.when(p.isNull(), "").when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("n.s.")


def p_text(p: Column) -> Column:
    return F.when(p < 1e-4, "p<1e-4").otherwise(F.concat(F.lit("p="), F.format_string("%.3f", p)))


def truth(c: Column) -> Column:
    """Whether a text says yes."""
    return F.coalesce(F.lower(F.trim(c)).isin("true", "1", "t", "yes", "y"), F.lit(False))
