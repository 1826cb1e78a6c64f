"""Summaries, tests and corrections.  Test statistics are sums that Spark aggregates; only the p-value of a finished statistic is Python."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewise.operators.sequence import average_rank


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def gamma_tail(a: float, x: float) -> float:
    """1 - the regularised lower incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 1000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d, c = 1 / (an * d + b), b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_p(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return beta_cdf(df / 2, 0.5, df / (df + t * t)) if df > 0 and math.isfinite(t) else math.nan


def f_p(f: float, d1: float, d2: float) -> float:
    return beta_cdf(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if d1 > 0 and d2 > 0 and f >= 0 else math.nan


def normal_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_p(x: float, df: float) -> float:
    return gamma_tail(df / 2, x / 2) if df > 0 else math.nan


def _p(f, *columns: str) -> Column:
    """A p-value column from finished statistics; null where one of them is null."""

    @F.pandas_udf("double")
    def told(*cs: pd.Series) -> pd.Series:
        return pd.Series([f(*map(float, row)) if all(pd.notna(x) for x in row) else None for row in zip(*cs, strict=True)], dtype="float64")

    return told(*columns)


def t_statistics(df: DataFrame, value: str, side: str, *by: str, welch: bool = True) -> DataFrame:
    """t and degrees of freedom between the groups that ``side`` (boolean) makes; Student's with equal variances unless ``welch``."""
    on = lambda c: F.when(F.col(side), F.col(value)) if c else F.when(~F.col(side), F.col(value))
    s = df.groupBy(*by).agg(*(f(on(c)).alias(f"{n}{c}") for c in (1, 0) for f, n in ((F.count, "n"), (F.avg, "m"), (F.var_samp, "v"))))
    a, b = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    if welch:
        t, dof = (F.col("m1") - F.col("m0")) / F.sqrt(a + b), (a + b) * (a + b) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n0") - 1))
    else:
        dof = (F.col("n1") + F.col("n0") - 2).cast("double")
        pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / dof
        t = (F.col("m1") - F.col("m0")) / F.sqrt(pooled * (1.0 / F.col("n1") + 1.0 / F.col("n0")))
    fit = (F.col("n1") > 1) & (F.col("n0") > 1) & (F.col("v1") + F.col("v0") > 0)
    return s.select(*by, F.col("n1").alias("n_a"), F.col("n0").alias("n_b"), F.when(fit, t).alias("t"), F.when(fit, dof).alias("dof"))


def t_test(df: DataFrame, value: str, side: str, *by: str, welch: bool = True) -> DataFrame:
    return t_statistics(df, value, side, *by, welch=welch).withColumn("p", _p(t_p, "t", "dof"))


def rank_sum(df: DataFrame, value: str, side: str, *by: str) -> DataFrame:
    """Mann-Whitney u of the true side and z, with ties corrected and continuity 1/2."""
    r = average_rank(df.where(f"{value} is not null and {side} is not null"), value, "__r", *by)
    ties = r.groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"), F.sum(F.when(F.col(side), F.col("__r")).otherwise(0.0)).alias("ra"), F.sum(F.col(side).cast("long")).alias("na"))
    s = ties.groupBy(*by).agg(F.sum("na").alias("n_a"), F.sum("c").alias("n"), F.sum("ra").alias("ra"), F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("tie"))
    na, nb, n = F.col("n_a").cast("double"), (F.col("n") - F.col("n_a")).cast("double"), F.col("n").cast("double")
    u = F.col("ra") - na * (na + 1) / 2
    sd = F.sqrt(na * nb / 12 * ((n + 1) - F.col("tie") / (n * (n - 1))))
    off = u - na * nb / 2
    z = F.when(sd > 0, F.signum(off) * F.greatest(F.abs(off) - 0.5, F.lit(0.0)) / sd)
    return s.select(*by, "n_a", (F.col("n") - F.col("n_a")).alias("n_b"), u.alias("u"), z.alias("z"))


def signed_rank(df: DataFrame, difference: str, *by: str) -> DataFrame:
    """Wilcoxon w (of positive differences) and z; zero differences take no part."""
    d = df.where(f"{difference} <> 0").withColumn("__a", F.abs(difference))
    r = average_rank(d, "__a", "__r", *by)
    ties = r.groupBy(*by, "__a").agg(F.count(F.lit(1)).alias("c"), F.sum(F.when(F.col(difference) > 0, F.col("__r")).otherwise(0.0)).alias("w"))
    s = ties.groupBy(*by).agg(F.sum("c").alias("n"), F.sum("w").alias("w"), F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("tie"))
    n = F.col("n").cast("double")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tie") / 48.0)
    return s.select(*by, "n", "w", F.when(sd > 0, (F.col("w") - n * (n + 1) / 4) / sd).alias("z"))


def anova(df: DataFrame, value: str, group: str, *by: str) -> DataFrame:
    """f of one-way analysis of variance and its degrees of freedom."""
    g = df.where(f"{value} is not null").groupBy(*by, group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    grand = F.sum(F.col("n") * F.col("m")).over(W.partitionBy(*by)) / F.sum("n").over(W.partitionBy(*by))
    g = g.withColumn("between", F.col("n") * (F.col("m") - grand) * (F.col("m") - grand)).withColumn("within", F.coalesce((F.col("n") - 1) * F.col("v"), F.lit(0.0)))
    s = g.groupBy(*by).agg((F.count(F.lit(1)) - 1).alias("d1"), (F.sum("n") - F.count(F.lit(1))).alias("d2"), F.sum("between").alias("b"), F.sum("within").alias("w"))
    return s.select(*by, "d1", "d2", F.when((F.col("w") > 0) & (F.col("d1") > 0) & (F.col("d2") > 0), F.col("b") / F.col("d1") / (F.col("w") / F.col("d2"))).alias("f"))


def kruskal(df: DataFrame, value: str, group: str, *by: str) -> DataFrame:
    """h of Kruskal and Wallis, ties corrected."""
    r = average_rank(df.where(f"{value} is not null"), value, "__r", *by)
    n = r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    tie = r.groupBy(*by, value).agg(F.count(F.lit(1)).alias("c")).groupBy(*by).agg(F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("tie"))
    g = r.groupBy(*by, group).agg(F.sum("__r").alias("s"), F.count(F.lit(1)).alias("k")).groupBy(*by).agg(F.sum(F.col("s") * F.col("s") / F.col("k")).alias("q"), (F.count(F.lit(1)) - 1).alias("dof"))
    m = F.col("n").cast("double")
    h = (12 / (m * (m + 1)) * F.col("q") - 3 * (m + 1)) / (1 - F.col("tie") / (m * m * m - m))
    return g.join(n, list(by)).join(tie, list(by)).select(*by, "dof", h.alias("h"))


def one_sample(df: DataFrame, value: str, centre: float, *by: str) -> DataFrame:
    """(by, n, mean, t, p): Student's t of values (or of differences of pairs) against ``centre``; t and p are null under 2 values or without spread."""
    g = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    g = g.withColumn("t", (F.col("mean") - centre) / F.nullif(F.col("sd") / F.sqrt("n"), F.lit(0.0))).withColumn("dof", F.col("n") - 1.0)
    return g.withColumn("p", F.when(F.col("t").isNotNull(), _p(t_p, "t", "dof"))).select(*by, "n", "mean", "t", "p")


def holm(df: DataFrame, p: str, out: str, *by: str) -> DataFrame:
    """Step-down: the running maximum of (m - rank + 1) p, at most 1.  A table of tests is small: one row a test."""
    w = W.partitionBy(*by).orderBy(p)
    m = F.count(p).over(W.partitionBy(*by))
    n = F.row_number().over(w)
    stepped = df.where(f"{p} is not null").withColumn("__s", F.least(F.lit(1.0), (m - n + 1) * F.col(p)))
    return stepped.withColumn(out, F.max("__s").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__s")


def benjamini_hochberg(df: DataFrame, p: str, out: str, *by: str) -> DataFrame:
    """The running minimum, from the largest p down, of m p / rank, at most 1."""
    w = W.partitionBy(*by).orderBy(p)
    m = F.count(p).over(W.partitionBy(*by))
    stepped = df.where(f"{p} is not null").withColumn("__s", F.least(F.lit(1.0), m * F.col(p) / F.row_number().over(w)))
    return stepped.withColumn(out, F.min("__s").over(W.partitionBy(*by).orderBy(F.desc(p)).rangeBetween(W.unboundedPreceding, W.currentRow))).drop("__s")


def summary(df: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean, sd and standard error (n - 1), median, least and largest."""
    s = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.percentile(value, 0.5).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"))
    return s.withColumn("sem", F.col("sd") / F.sqrt("n"))


# --- tests that decide by normality and size: a pooled table holds a row for each cell, so a group of it fits a task

#: Royston's fits for the W test of Shapiro and Wilk (1995), fixed values.
_W_LAST = (-2.706056, 4.434685, -2.071190, -0.147981, 0.221157)
_W_BEFORE = (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981)
_SMALL_MEAN, _SMALL_SD = (0.5440, -0.39978, 0.025054, -0.0006714), (1.3822, -0.77857, 0.062767, -0.0020322)
_LARGE_MEAN, _LARGE_SD = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)


def shapiro_p(values: np.ndarray) -> float:
    """p of the W test of normality, for 3 to 5000 values; nan for fewer, and 1 for values that are all alike."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if n < 3:
        return math.nan
    if x[-1] == x[0]:
        return 1.0
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
        square, u = float(m @ m), 1 / math.sqrt(n)
        fit = lambda c, base: base + sum(k * u ** (5 - i) for i, k in enumerate(c))
        last = fit(_W_LAST, m[-1] / math.sqrt(square))
        if n > 5:
            before = fit(_W_BEFORE, m[-2] / math.sqrt(square))
            a = m / math.sqrt((square - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * before**2))
            a[[0, 1, -2, -1]] = -last, -before, before, last
        else:
            a = m / math.sqrt((square - 2 * m[-1] ** 2) / (1 - 2 * last**2))
            a[[0, -1]] = -last, last
    w = min(1.0, float(a @ x) ** 2 / float(((x - x.mean()) ** 2).sum()))
    if n == 3:
        return max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    poly = lambda c, at: sum(k * at**i for i, k in enumerate(c))
    if w == 1:
        return 1.0
    if n <= 11:
        z = (-math.log(0.459 * n - 2.273 - math.log(1 - w)) - poly(_SMALL_MEAN, n)) / math.exp(poly(_SMALL_SD, n))
    else:
        z = (math.log(1 - w) - poly(_LARGE_MEAN, math.log(n))) / math.exp(poly(_LARGE_SD, math.log(n)))
    return 1 - NormalDist().cdf(z)


def _ranks(x: np.ndarray) -> np.ndarray:
    _, at, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[at]


def _two_sided(counts: np.ndarray, at: int) -> float:
    """From how many arrangements give each sum."""
    return min(1.0, 2 * float(min(counts[: at + 1].sum(), counts[at:].sum()) / counts.sum()))


def wilcoxon_p(differences: np.ndarray, exact_up_to: int = 50) -> tuple[float, float]:
    """(w of positive differences, two-sided p): exact for few differences without ties and zeros, else by the normal law; 1 if all are zero."""
    d = np.asarray(differences, float)
    some = d[d != 0]
    if not len(some):
        return 0.0, 1.0
    r, n = _ranks(np.abs(some)), len(some)
    w = float(r[some > 0].sum())
    if n == len(d) and n <= exact_up_to and len(np.unique(np.abs(some))) == n:
        counts = np.zeros(n * (n + 1) // 2 + 1)
        counts[0] = 1
        for k in range(1, n + 1):
            counts[k:] += counts[:-k].copy()
        return w, _two_sided(counts, int(w))
    tie = float(sum(c**3 - c for c in np.unique(np.abs(some), return_counts=True)[1]))
    return w, normal_p((w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie / 48))


def wilcoxon_greater_p(differences: np.ndarray, exact_up_to: int = 50) -> float:
    """One-sided p of the signed ranks of differences being above 0: exact as in ``wilcoxon_p``; 1 if all are 0, NaN without any."""
    d = np.asarray(differences, float)
    if not len(d) or np.abs(d).max() <= 1e-8:
        return 1.0 if len(d) else math.nan
    some = d[d != 0]
    r, n = _ranks(np.abs(some)), len(some)
    w = float(r[some > 0].sum())
    if n == len(d) and n <= exact_up_to and len(np.unique(np.abs(some))) == n:
        counts = np.zeros(n * (n + 1) // 2 + 1)
        counts[0] = 1
        for k in range(1, n + 1):
            counts[k:] += counts[:-k].copy()
        return float(counts[int(w) :].sum() / counts.sum())
    tie = float(sum(c**3 - c for c in np.unique(np.abs(some), return_counts=True)[1]))
    return 0.5 * math.erfc((w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie / 48) / math.sqrt(2))


def mann_whitney_p(a: np.ndarray, b: np.ndarray, exact_up_to: int = 8) -> tuple[float, float]:
    """(u of a, two-sided p): exact if one side is small and nothing is tied, else by the normal law with continuity 1/2."""
    na, nb = len(a), len(b)
    both = np.concatenate((a, b))
    u = float(_ranks(both)[:na].sum()) - na * (na + 1) / 2
    if min(na, nb) <= exact_up_to and len(np.unique(both)) == na + nb:
        counts = np.zeros((na + 1, na * nb + 1))  # by how many of a are placed, and their u
        counts[0, 0] = 1
        for before in range(na + nb):
            for k in range(min(na, before + 1), 0, -1):
                beaten = before - (k - 1)
                if beaten <= nb:
                    counts[k, beaten:] += counts[k - 1, : na * nb + 1 - beaten]
        return u, _two_sided(counts[na], int(u))
    n = na + nb
    tie = float(sum(c**3 - c for c in np.unique(both, return_counts=True)[1]))
    sd = math.sqrt(max(0.0, na * nb / 12 * ((n + 1) - tie / (n * (n - 1)))))
    return u, normal_p(max(0.0, abs(u - na * nb / 2) - 0.5) / sd) if sd else 1.0


def paired_decision(differences: np.ndarray, small: int = 6) -> tuple[str | None, float, float]:
    """(test, statistic, p): none under 3 differences, Wilcoxon up to ``small`` of them or where they aren't normal, else paired t."""
    d = np.asarray(differences, float)
    d = d[np.isfinite(d)]
    if len(d) < 3:
        return None, math.nan, math.nan
    if not d.any():
        return "wilcoxon", 0.0, 1.0
    if len(d) > small and shapiro_p(d) >= 0.05 and d.std(ddof=1) > 0:
        t = d.mean() / (d.std(ddof=1) / math.sqrt(len(d)))
        return "t", float(t), t_p(t, len(d) - 1)
    return "wilcoxon", *wilcoxon_p(d)


def unpaired_decision(a: np.ndarray, b: np.ndarray, welch: bool = False, small: int = 6) -> tuple[str | None, float, float]:
    """(test, statistic, p): none under 3 values a side, Mann-Whitney if a side has ``small`` or fewer or isn't normal, else Student's or Welch's t."""
    a, b = (np.asarray(x, float)[np.isfinite(np.asarray(x, float))] for x in (a, b))
    if min(len(a), len(b)) < 3:
        return None, math.nan, math.nan
    va, vb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
    if min(len(a), len(b)) > small and shapiro_p(a) >= 0.05 and shapiro_p(b) >= 0.05 and va + vb > 0:
        if welch:
            t, dof = (a.mean() - b.mean()) / math.sqrt(va + vb), (va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1))
        else:
            dof = len(a) + len(b) - 2
            t = (a.mean() - b.mean()) / math.sqrt(((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / dof * (1 / len(a) + 1 / len(b)))
        return "welch" if welch else "t", float(t), t_p(t, dof)
    return "mann-whitney", *mann_whitney_p(a, b)


def omnibus_decision(groups: list[np.ndarray]) -> tuple[str | None, float, float]:
    """(test, statistic, p): analysis of variance if all groups are normal, else Kruskal and Wallis; p is 1 if all values are alike."""
    groups = [g for g in (np.asarray(x, float)[np.isfinite(np.asarray(x, float))] for x in groups) if len(g)]
    if len(groups) < 2 or min(map(len, groups)) < 3:
        return None, math.nan, math.nan
    every = np.concatenate(groups)
    n, k = len(every), len(groups)
    if every.min() == every.max():
        return "kruskal", 0.0, 1.0
    inside = sum(float(((g - g.mean()) ** 2).sum()) for g in groups)
    if inside > 0 and all(shapiro_p(g) >= 0.05 for g in groups):
        between = sum(len(g) * (g.mean() - every.mean()) ** 2 for g in groups)
        f = float(between / (k - 1) / (inside / (n - k)))
        return "anova", f, f_p(f, k - 1, n - k)
    r, at = _ranks(every), np.cumsum([0, *map(len, groups)])
    tie = float(sum(c**3 - c for c in np.unique(every, return_counts=True)[1]))
    h = (12 / (n * (n + 1)) * sum(r[i:j].sum() ** 2 / (j - i) for i, j in zip(at, at[1:], strict=False)) - 3 * (n + 1)) / (1 - tie / (n**3 - n))
    return "kruskal", float(h), chi2_p(h, k - 1)


def _decided(df: DataFrame, by: tuple[str, ...], columns: list[str], decide) -> DataFrame:
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        test, statistic, p = decide(pdf)
        return pd.DataFrame([[*(pdf[b].iloc[0] for b in by), len(pdf), test, statistic, p]], columns=[*by, "n", "test", "statistic", "p"])

    return df.select(*by, *columns).groupBy(*by).applyInPandas(run, ", ".join(f"`{b}` {kinds[b]}" for b in by) + ", n long, test string, statistic double, p double")


def paired_test(df: DataFrame, difference: str, *by: str, small: int = 6) -> DataFrame:
    """(by, n, test, statistic, p) of differences of pairs, or of values against 0; null differences don't count."""
    return _decided(df.where(F.col(difference).isNotNull()), by, [difference], lambda pdf: paired_decision(pdf[difference].to_numpy(), small))


def unpaired_test(df: DataFrame, value: str, side: str, *by: str, welch: bool = False, small: int = 6) -> DataFrame:
    """(by, n, test, statistic, p) between the rows where ``side`` is true and the others."""
    known = df.where(F.col(value).isNotNull() & F.col(side).isNotNull())
    return _decided(known, by, [value, side], lambda pdf: unpaired_decision(pdf.loc[pdf[side].astype(bool), value].to_numpy(), pdf.loc[~pdf[side].astype(bool), value].to_numpy(), welch, small))


def omnibus_test(df: DataFrame, value: str, group: str, *by: str) -> DataFrame:
    known = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    return _decided(known, by, [value, group], lambda pdf: omnibus_decision([g.to_numpy() for _, g in pdf.groupby(group)[value]]))


def outcome_counts(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(outcome, n): greater, less or n.s., by the sign of ``effect`` where p is under alpha."""
    told = F.when(F.col("p") < alpha, F.when(F.col("effect") > 0, "greater").otherwise("less")).otherwise("n.s.")
    return tests.groupBy(told.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def confidence_band(df: DataFrame, x: str, y: str, at: list[float], level: float = 0.95) -> DataFrame:
    """(x, fit, lo, hi): the least-squares line and the band of its mean at given places, from sums over all rows."""
    s = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("base"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy")
    )
    places = F.explode(F.array(*(F.lit(float(v)) for v in at)))
    s = s.withColumn("dof", F.col("n") - 2.0).withColumn("q", _p(lambda d: t_quantile(level, d), "dof")).withColumn("x", places)
    sd = F.sqrt((F.col("syy") - F.col("slope") * F.col("sxy")) / F.col("dof") * (1 / F.col("n") + (F.col("x") - F.col("mx")) ** 2 / F.col("sxx")))
    fit = F.col("base") + F.col("slope") * F.col("x")
    return s.select("x", fit.alias("fit"), (fit - F.col("q") * sd).alias("lo"), (fit + F.col("q") * sd).alias("hi"))


def t_quantile(level: float, dof: float) -> float:
    """t whose two-sided p is 1 - level, by bisection."""
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_p(mid, dof) > 1 - level else (lo, mid)
    return lo
