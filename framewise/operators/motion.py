"""Motion out of traces and pixels: regressors of shifts, least squares by sums of products, chunks that fade into each other.

Rows are (key, frame, value, shifts); a key is a cell, or a movie's pixel.  Spark sums the products of a chunk's regressors and values once,
map-side first; a small task solves each chunk's equations; frames then take their chunk's coefficients.  No task sees a trace.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME = "frame"
#: Names of the regressors of shifts.
SHIFTS = ("dx", "dy", "dx2", "dy2", "dxdy")


def with_regressors(df: DataFrame, x: str, y: str, *recording: str) -> DataFrame:
    """With dx, dy (shifts less the recording's mean), their squares and their product."""
    c = df.join(df.groupBy(*recording).agg(F.avg(x).alias("__mx"), F.avg(y).alias("__my")), [*recording])
    c = c.withColumns({"dx": F.col(x) - F.col("__mx"), "dy": F.col(y) - F.col("__my")}).drop("__mx", "__my")
    return c.withColumns({"dx2": F.col("dx") * F.col("dx"), "dy2": F.col("dy") * F.col("dy"), "dxdy": F.col("dx") * F.col("dy")})


def in_chunks(df: DataFrame, chunk: int, overlap: int, *keys: str) -> DataFrame:
    """Each row in the chunks of ``chunk`` frames that hold it, each beginning ``chunk`` - ``overlap`` after the one before, with its weight: the chunks of an overlap fade from 0 to 1 and from 1 to 0.

    The last chunk is the first that reaches the key's end; an overlap is at most half a chunk.
    """
    if not 0 <= 2 * overlap <= chunk:
        raise ValueError("an overlap is at most half of a chunk")
    stride = chunk - overlap
    sized = df.join(df.groupBy(*keys).agg((F.max(FRAME) + 1).alias("__size")), [*keys])
    last = F.greatest(F.ceil((F.col("__size") - chunk) / stride), F.lit(0))
    first = F.greatest(F.floor((F.col(FRAME) - chunk) / stride) + 1, F.lit(0))
    spread = sized.withColumn("__last", last).withColumn("chunk", F.explode(F.sequence(F.least(first, F.col("__last")), F.least(F.floor(F.col(FRAME) / stride), F.col("__last")))))
    at, fade = F.col(FRAME) - F.col("chunk") * stride, max(overlap - 1, 1)
    weight = F.when((F.col("chunk") > 0) & (at < overlap), at / fade if overlap > 1 else F.lit(0.0)).when((F.col("chunk") < F.col("__last")) & (at >= stride), 1 - (at - stride) / fade if overlap > 1 else F.lit(1.0)).otherwise(F.lit(1.0))
    return spread.withColumn("weight", weight).drop("__size", "__last")


def motion_basis(n: float, sums: np.ndarray, products: np.ndarray, mean: np.ndarray, sd: np.ndarray, components: int) -> np.ndarray | None:
    """Columns that turn z-scored regressors into at most ``components`` orthonormal time courses over the rows that are fitted; none under 3 rows."""
    if n < 3:
        return None
    z = (products - np.outer(mean, sums) - np.outer(sums, mean) + n * np.outer(mean, mean)) / np.outer(sd, sd)
    size, axes = np.linalg.eigh(z)
    size, axes = np.sqrt(np.maximum(size[::-1], 0)), axes[:, ::-1]
    k = min(components, int((size > 1e-8).sum()), len(mean), max(1, int(n) - 1))
    return axes[:, :k] / size[:k] if k else None


def motion_coefficients(s: dict, regressors: int, components: int, ridge: float) -> tuple[np.ndarray, float]:
    """The motion term of a chunk as coefficients of the regressors and a constant, from its sums; zeros where there are too few rows."""
    none = np.zeros(regressors), 0.0
    if s["rows"] < 4:
        return none
    sd = np.where(s["sd"] <= 1e-8, 1.0, s["sd"])
    basis = motion_basis(s["n"], s["x"], s["xx"], s["mean"], sd, components)
    if basis is None or s["ny"] < basis.shape[1] + 1:
        return none
    scale = basis / sd[:, None]  # of regressors less their mean
    m = s["mean"]
    gram = scale.T @ (s["yxx"] - np.outer(m, s["yx"]) - np.outer(s["yx"], m) + s["ny"] * np.outer(m, m)) @ scale + ridge * np.eye(basis.shape[1])
    right = scale.T @ (s["xy"] - m * s["y"] - s["y"] / s["ny"] * (s["yx"] - s["ny"] * m))
    beta = scale @ np.linalg.lstsq(gram, right, rcond=None)[0]
    return beta, float(-beta @ m)


def motion_regressed(df: DataFrame, value: str, regressors: list[str], out: str, *keys: str, chunk: int = 5000, overlap: int = 0, components: int = 5, ridge: float = 0.0, bad: str | None = None) -> DataFrame:
    """``df`` with ``out``: the value less what the regressors explain of it, by chunks of frames.

    In a chunk regressors are z-scored, their principal time courses over the rows that are not ``bad`` (``components`` at most) are fitted to the value
    less its mean by least squares with a ``ridge``, and the fit is taken off all rows; null values stay null, rows with a null regressor lose
    nothing.  A chunk with too few rows stays as it is.
    """
    whole = in_chunks(df.withColumn("__good", ~F.coalesce(F.col(bad), F.lit(False)) if bad else F.lit(True)), chunk, overlap, *keys)
    full = whole.where(" and ".join(f"{r} is not null" for r in regressors))
    x, y = [F.col(r).cast("double") for r in regressors], F.col(value).cast("double")
    pairs = list(combinations_with_replacement(range(len(x)), 2))
    good, known = F.col("__good"), F.col("__good") & F.col(value).isNotNull()
    over = lambda flag, columns: F.array(*(F.coalesce(F.sum(F.when(flag, c)), F.lit(0.0)) for c in columns))
    sums = full.groupBy(*keys, "chunk").agg(
        F.count(F.lit(1)).alias("__rows"), F.array(*map(F.avg, x)).alias("__mean"), F.array(*map(F.stddev_pop, x)).alias("__sd"), F.count(F.when(good, 1)).alias("__n"), over(good, x).alias("__x"), over(good, [x[i] * x[j] for i, j in pairs]).alias("__xx"),
        F.count(F.when(known, 1)).alias("__ny"), over(known, x).alias("__yx"), over(known, [x[i] * x[j] for i, j in pairs]).alias("__yxx"), over(known, [y]).alias("__y"), over(known, [c * y for c in x]).alias("__xy"),
    )
    size = len(x)

    def square(flat) -> np.ndarray:
        a = np.zeros((size, size))
        for (i, j), v in zip(pairs, flat, strict=True):
            a[i, j] = a[j, i] = v
        return a

    @F.pandas_udf("struct<beta:array<double>,base:double>")
    def solve(s: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in s.to_dict("records"):
            given = {k: np.asarray(r[k], float) for k in ("mean", "sd", "x", "yx", "xy")} | {"rows": r["rows"], "n": r["n"], "ny": r["ny"], "y": float(r["y"][0]), "xx": square(r["xx"]), "yxx": square(r["yxx"])}
            beta, base = motion_coefficients(given, size, components, ridge)
            rows.append((beta.tolist(), base))
        return pd.DataFrame(rows, columns=["beta", "base"])

    fit = sums.select(*keys, "chunk", solve(F.struct(*(F.col(f"__{c}").alias(c) for c in ("rows", "mean", "sd", "n", "x", "xx", "ny", "yx", "yxx", "y", "xy")))).alias("__fit"))
    term = sum((F.get(F.col("__fit.beta"), F.lit(i)) * c for i, c in enumerate(x)), F.col("__fit.base"))
    cleaned = y - F.coalesce(term, F.lit(0.0))
    parts = whole.join(fit, [*keys, "chunk"], "left").withColumn("__part", F.col("weight") * cleaned)
    if not overlap:
        return parts.withColumn(out, F.col("__part")).drop("chunk", "weight", "__good", "__fit", "__part")
    mixed = parts.groupBy(*keys, FRAME).agg(F.sum("__part").alias(out))
    return df.join(mixed, [*keys, FRAME])


def explained_variance(df: DataFrame, value: str, cleaned: str, epoch: int, *keys: str) -> DataFrame:
    """(keys, explained, removed_sd): the share of a pixel's variance within epochs that cleaning took, from 0 to 1, and the deviation that it took."""
    e = df.groupBy(*keys, F.floor(F.col(FRAME) / epoch).alias("epoch")).agg(F.count(value).alias("n"), F.var_pop(value).alias("before"), F.var_pop(cleaned).alias("after"))
    g = e.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("before")).alias("before"), F.sum(F.col("n") * F.col("after")).alias("after"))
    took = F.greatest(F.col("before") - F.col("after"), F.lit(0.0))
    return g.select(*keys, F.when(F.col("before") > 0, F.least(took / F.col("before"), F.lit(1.0))).otherwise(F.lit(0.0)).alias("explained"), F.sqrt(took / F.col("n")).alias("removed_sd"))
