"""Penalised Poisson models of spike counts by binned variables: sufficient statistics, fits, fit metrics, forward selection, profiles.

An observation (a stretch of frames) has a bin of each variable and a spike count.  With one-hot variables a fit needs the observations and
spikes of each joint bin only, so Spark sums those first, by all subsets of variables at once, and a fit of one (cell, model,
fold) is a small task, however long a recording is.  A model is named by its variables' letters in order.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewise.operators.statistics import wilcoxon_greater_p
from framewise.scratch import stored

#: The fold number of the fit to all observations.
ALL = -1
#: Rates are taken from exponents within this.
LIMIT = 50.0


@dataclass(frozen=True)
class Variable:
    """A letter, the column of its bin, its shape (bins, or columns and rows of a grid with bin = row * columns + column), and what a step between neighbours costs."""

    letter: str
    column: str
    shape: tuple[int, ...]
    weight: float
    circular: bool = False

    @property
    def bins(self) -> int:
        return int(np.prod(self.shape))

    def penalty(self) -> np.ndarray:
        """The matrix of the quadratic form ``weight`` * sum of squared steps between neighbours."""

        def steps(n: int) -> np.ndarray:
            if n < 2:
                return np.zeros((n, n))
            d = np.diff(np.eye(n), axis=0)
            if self.circular:
                d = np.vstack((d, np.eye(n)[0] - np.eye(n)[-1]))
            return d.T @ d

        if len(self.shape) == 1:
            return self.weight * steps(self.shape[0])
        nx, ny = self.shape
        return self.weight * (np.kron(np.eye(ny), steps(nx)) + np.kron(steps(ny), np.eye(nx)))


def model_names(variables: list[Variable]) -> list[str]:
    return ["".join(v.letter for v in some) for k in range(1, len(variables) + 1) for some in combinations(variables, k)]


def bin_counts(obs: DataFrame, variables: list[Variable], count: str, *by: str) -> DataFrame:
    """(by, model, a bin column of each variable, n, spikes) of all models; the bins of a model's other variables are null."""
    sets = [[*by, *(v.column for v in some)] for k in range(1, len(variables) + 1) for some in combinations(variables, k)]
    names = [F.when(F.grouping(v.column) == 0, v.letter).otherwise("") for v in variables]
    whole = obs.where(" and ".join(f"{v.column} is not null" for v in variables))
    columns = [*by, *(v.column for v in variables)]
    return whole.groupingSets(sets, *columns).agg(F.count(F.lit(1)).alias("n"), F.sum(count).cast("double").alias("spikes"), F.concat(*names).alias("model"))


def fitted(bins: np.ndarray, n: np.ndarray, spikes: np.ndarray, penalties: list[np.ndarray], steps: int = 100) -> list[np.ndarray]:
    """The parameters of each variable that minimise sum(n exp(u) - spikes u) + half the penalties, u the sum of one parameter a variable, by damped Newton steps.

    What the likelihood and the penalties leave open (a constant moved from one variable to another, bins without neighbours) is
    settled by a ridge of 1e-9.
    """
    at = np.cumsum([0, *(len(p) for p in penalties)])
    columns = bins + at[:-1]
    size = int(at[-1])
    rough = np.zeros((size, size))
    for lo, hi, p in zip(at, at[1:], penalties, strict=False):
        rough[lo:hi, lo:hi] = p
    rough += 1e-9 * np.eye(size)
    pairs = (columns[:, :, None] * size + columns[:, None, :]).reshape(len(n), -1)
    theta = np.zeros(size)
    theta[: at[1]] = np.log(max(spikes.sum(), 0.5) / max(n.sum(), 1))

    def value(t: np.ndarray) -> tuple[float, np.ndarray]:
        u = np.clip(t[columns].sum(axis=1), -LIMIT, LIMIT)
        mean = n * np.exp(u)
        return float((mean - spikes * u).sum() + 0.5 * t @ rough @ t), mean

    now, mean = value(theta)
    for _ in range(steps):
        gradient = np.bincount(columns.reshape(-1), np.repeat(mean - spikes, columns.shape[1]), size) + rough @ theta
        hessian = np.bincount(pairs.reshape(-1), np.repeat(mean, pairs.shape[1]), size * size).reshape(size, size) + rough
        step = np.linalg.solve(hessian, gradient)
        gain = float(gradient @ step)
        scale = 1.0
        while scale > 1e-8:
            then, its_mean = value(theta - scale * step)
            if then <= now - 0.25 * scale * gain:
                break
            scale /= 2
        else:
            break
        theta, now, mean = theta - scale * step, then, its_mean
        if gain < 1e-18 * max(1.0, abs(now)) or np.abs(scale * step).max() < 1e-12:
            break
    return [theta[lo:hi] for lo, hi in zip(at, at[1:], strict=False)]


def fitted_many(fit: np.ndarray, bins: np.ndarray, n: np.ndarray, spikes: np.ndarray, penalties: list[np.ndarray], count: int, steps: int = 100) -> np.ndarray:
    """``fitted`` for ``count`` fits of one model at once, a row of parameters each; ``fit`` says whose a row of ``bins``, ``n`` and ``spikes`` is.

    Each fit takes its own steps and stops by itself; rows of one fit may share their bins.
    """
    at = np.cumsum([0, *(len(p) for p in penalties)])
    size = int(at[-1])
    rough = np.zeros((size, size))
    for lo, hi, p in zip(at, at[1:], penalties, strict=False):
        rough[lo:hi, lo:hi] = p
    rough += 1e-9 * np.eye(size)
    theta = np.zeros((count, size))
    theta[:, : at[1]] = np.log(np.maximum(np.bincount(fit, spikes, count), 0.5) / np.maximum(np.bincount(fit, n, count), 1))[:, None]
    columns = bins + at[:-1]
    open_, now = np.arange(count), np.full(count, np.nan)

    def value(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = np.clip(t[fit[:, None], columns].sum(axis=1), -LIMIT, LIMIT)
        mean = n * np.exp(u)
        return np.bincount(fit, mean - spikes * u, len(t)) + 0.5 * (np.einsum("fi,ij->fj", t, rough) * t).sum(axis=1), mean

    now, mean = value(theta)
    t = theta.copy()
    for _ in range(steps):
        if not len(open_):
            break
        own, width = len(open_), columns.shape[1]
        gradient = np.bincount((fit[:, None] * size + columns).reshape(-1), np.repeat(mean - spikes, width), own * size).reshape(own, size) + np.einsum("fi,ij->fj", t, rough)
        pairs = fit[:, None, None] * (size * size) + columns[:, :, None] * size + columns[:, None, :]
        hessian = np.bincount(pairs.reshape(-1), np.repeat(mean, width * width), own * size * size).reshape(own, size, size) + rough
        step = np.linalg.solve(hessian, gradient[:, :, None])[:, :, 0]
        gain = (gradient * step).sum(axis=1)
        scale, settled = np.ones(own), np.zeros(own, bool)
        then, its_mean = value(t - step)
        while True:
            settled |= then <= now - 0.25 * scale * gain
            short = ~settled & (scale > 1e-8)
            if not short.any():
                break
            scale[short] /= 2
            short &= scale > 1e-8
            if not short.any():
                break
            then, its_mean = value(t - scale[:, None] * step)
        moved = np.where(settled[:, None], scale[:, None] * step, 0.0)
        t = t - moved
        now = np.where(settled, then, now)
        mean = np.where(settled[fit], its_mean, mean)
        done = ~settled | (gain < 1e-18 * np.maximum(1.0, np.abs(now))) | (np.abs(moved).max(axis=1) < 1e-12)
        theta[open_] = t
        if done.any():
            keep = ~done
            rows = keep[fit]
            new = np.cumsum(keep) - 1
            fit, columns, n, spikes, mean = new[fit[rows]], columns[rows], n[rows], spikes[rows], mean[rows]
            t, now, open_ = t[keep], now[keep], open_[keep]
    return theta


#: Cells that are fitted at once.
CELLS_AT_ONCE = 128


def fits(obs: DataFrame, variables: list[Variable], count: str, fold: str | None, folds: int, key: str = "cell") -> DataFrame:
    """(cell, fold, model, theta): parameters of each variable (arrays in the order of the model's letters), fitted to the observations outside of each fold, and to all (fold -1).

    Observations without a bin of some variable don't count; ``fold`` names a column with 0 to ``folds`` - 1 (None: the fit to all only).
    Counts by fold and joint bin are enough for all models and folds.  A cell's are one row of arrays, so rows are dealt over tasks, and a task
    fits some CELLS_AT_ONCE cells together, model by model.
    """
    columns = [v.column for v in variables]
    whole = obs.where(" and ".join(f"{c} is not null" for c in columns)).withColumn("__fold", F.col(fold).cast("long") if fold else F.lit(0).cast("long"))
    counts = whole.groupBy(key, "__fold", *columns).agg(F.count(F.lit(1)).alias("n"), F.sum(count).cast("double").alias("spikes"))
    packed = counts.groupBy(key).agg(F.collect_list(F.struct("__fold", *(F.col(c).cast("long").alias(c) for c in columns), "n", "spikes")).alias("__of"))
    out_of = ([*range(folds)] if fold else []) + [ALL]
    sets = {name: [i for i, v in enumerate(variables) if v.letter in name] for name in model_names(variables)}
    penalties = [v.penalty() for v in variables]
    ends = {name: np.cumsum([0, *(variables[i].bins for i in some)]) for name, some in sets.items()}
    kind = obs.schema[key].dataType.simpleString()

    def fit_some(part: pa.RecordBatch) -> pa.RecordBatch:
        of = part.column(1)
        held, *bins, n, spikes = (of.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(len(columns) + 3))
        bins, own = np.stack(bins, axis=1).astype(np.int64), np.repeat(np.arange(len(part)), of.value_lengths().to_numpy(zero_copy_only=False))
        #: A fit is a cell and a fold that is left out; its rows are those of the cell's other folds.
        row, left = np.nonzero(held[:, None] != np.array(out_of)[None, :])
        pair = own[row] * len(out_of) + left
        some, fit = np.unique(pair, return_inverse=True)
        out = {key: [], "fold": [], "model": [], "theta": []}
        for name, chosen in sets.items():
            #: Summed by the model's own bins, in their order, so that folds alike in these are fitted alike to the last digit.
            shape = [variables[i].bins for i in chosen]
            code, where = np.unique(fit * int(np.prod(shape)) + np.ravel_multi_index(bins[row][:, chosen].T, shape), return_inverse=True)
            whose, own_bins = code // int(np.prod(shape)), np.stack(np.unravel_index(code % int(np.prod(shape)), shape), axis=1)
            theta = fitted_many(whose, own_bins, np.bincount(where, n[row].astype(float)), np.bincount(where, spikes[row].astype(float)), [penalties[i] for i in chosen], len(some))
            out[key].append(part.column(0).take(pa.array(some // len(out_of))))
            out["fold"].append(pa.array(np.array(out_of)[some % len(out_of)], pa.int64()))
            out["model"].append(pa.array([name] * len(some), pa.string()))
            out["theta"].append(pa.array([[t[lo:hi] for lo, hi in zip(ends[name], ends[name][1:], strict=False)] for t in theta], pa.list_(pa.list_(pa.float64()))))
        return pa.record_batch([pa.concat_arrays(x) for x in out.values()], names=list(out))

    def run(parts):
        for part in parts:
            for i in range(0, len(part), CELLS_AT_ONCE):
                yield fit_some(pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(i, CELLS_AT_ONCE)]) for c in part.columns], names=part.schema.names))

    return packed.mapInArrow(run, f"{key} {kind}, fold long, model string, theta array<array<double>>")


def _exponent(variables: list[Variable], model: str, theta: Column, without: str = "") -> Column:
    of = {v.letter: v.column for v in variables}
    parts = [F.element_at(F.element_at(theta, i + 1), (F.col(of[x]) + 1).cast("int")) for i, x in enumerate(model) if x != without]
    return F.greatest(F.least(sum(parts[1:], parts[0]), F.lit(LIMIT)), F.lit(-LIMIT)) if parts else F.lit(0.0)


def predicted(obs: DataFrame, models: DataFrame, variables: list[Variable], fold: str | None, key: str = "cell") -> DataFrame:
    """``obs`` once a model, with model, fold and pred: the count that the fit without the observation's own fold expects (of the fit to all, if ``fold`` is None)."""
    held = obs.withColumn("fold", F.col(fold).cast("long") if fold else F.lit(ALL).cast("long"))
    both = held.join(models.groupBy(key, "fold").agg(F.map_from_entries(F.collect_list(F.struct("model", "theta"))).alias("__of")), [key, "fold"])
    each = [F.struct(F.lit(m).alias("model"), F.exp(_exponent(variables, m, F.col("__of")[m])).alias("pred")) for m in model_names(variables)]
    return both.withColumn("__m", F.explode(F.array(*each))).select(*obs.columns, *(["fold"] if fold != "fold" else []), F.col("__m.model").alias("model"), F.col("__m.pred").alias("pred"))


def gaussian_weights(sigma: float, radius: int) -> list[float]:
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return (w / w.sum()).tolist()


def fit_metrics(pred: DataFrame, count: str, order: str, dt: float, weights: list[float], *by: str) -> DataFrame:
    """(by, var_explained, correlation, llh_bits_spike, mse, n_spikes, n_bins) of predictions ``pred`` against counts.

    Rates are smoothed with ``weights`` along ``order`` (nothing beyond the ends) before they are compared; the likelihood is that of the
    counts, in bits a spike over the mean count, null without spikes.
    """
    w, half = W.partitionBy(*by).orderBy(order), len(weights) // 2

    def smooth(c: Column) -> Column:
        parts = [F.coalesce(F.lag(c, half - i).over(w) if i < half else F.lead(c, i - half).over(w) if i > half else c, F.lit(0.0)) * x for i, x in enumerate(weights)]
        return sum(parts[1:], parts[0])

    n, p = F.col(count).cast("double"), F.greatest(F.col("pred"), F.lit(1e-12))
    s = pred.select(*by, n.alias("n"), F.col("pred"), (n * F.log(p) - p).alias("ll"), smooth(n / dt).alias("rate"), smooth(F.col("pred") / dt).alias("told"))
    error = (F.col("told") - F.col("rate")) ** 2
    g = s.groupBy(*by).agg(
        F.sum(error).alias("sse"), F.var_pop("rate").alias("var"), F.var_pop("told").alias("told_var"), F.covar_pop("rate", "told").alias("cov"), F.avg(error).alias("mse"), F.sum("n").alias("n_spikes"), F.count(F.lit(1)).alias("n_bins"), F.sum("ll").alias("ll")
    )
    total, size = F.nullif(F.col("n_spikes"), F.lit(0.0)), F.col("n_bins").cast("double")
    bits = (F.col("ll") + total - total * F.log(total / size)) / total / float(np.log(2))
    return g.select(
        *by, F.when(F.col("var") > 0, 1 - F.col("sse") / F.nullif(F.col("var") * size, F.lit(0.0))).alias("var_explained"), F.when((F.col("var") > 1e-16) & (F.col("told_var") > 1e-16), F.col("cov") / F.nullif(F.sqrt(F.col("var") * F.col("told_var")), F.lit(0.0))).alias("correlation"),
        bits.alias("llh_bits_spike"), "mse", "n_spikes", "n_bins",
    )


def selected_model(llh: dict[str, np.ndarray], letters: str, alpha: float, baseline: float) -> tuple[str, str, float, float, float, str | None]:
    """(best single, best double, p of double over single, p of all three over double, p of the chosen one over 0, chosen) by the folds' likelihoods of the models of three variables.

    The first of equal means wins; a step up needs a one-sided signed-rank p under ``alpha``, and what isn't above 0 by ``baseline`` is no model.
    """

    def mean(name: str) -> float:
        known = llh[name][np.isfinite(llh[name])]
        return float(known.mean()) if len(known) else -np.inf

    def p(x: np.ndarray) -> float:
        return wilcoxon_greater_p(x[np.isfinite(x)])

    doubles = ["".join(x) for x in combinations(letters, 2)]
    one = max(letters, key=mean)
    two = max((d for d in doubles if one in d), key=mean)
    p12, p23 = p(llh[two] - llh[one]), p(llh[letters] - llh[two])
    chosen = (letters if p23 < alpha else two) if p12 < alpha else one
    base = p(llh[chosen])
    return one, two, p12, p23, base, None if base > baseline else chosen


def forward_selection(metrics: DataFrame, variables: list[Variable], alpha: float = 0.05, baseline: float = 0.05, key: str = "cell") -> DataFrame:
    """(cell, single, double, p_12, p_23, baseline_p, selected) of ``metrics`` (cell, fold, model, llh_bits_spike); a cell's folds meet in a task."""
    letters, kind = "".join(v.letter for v in variables), dict(metrics.dtypes)[key]
    if len(letters) != 3:
        raise ValueError("forward selection takes three variables")

    names = model_names(variables)

    def choose(parts):
        for part in parts:
            got = []
            for folds in part.column(1).to_pylist():
                at = {f: i for i, f in enumerate(sorted({x["fold"] for x in folds}))}
                wide = {m: np.full(len(at), np.nan) for m in names}
                for x in folds:
                    if x["llh_bits_spike"] is not None:
                        wide[x["model"]][at[x["fold"]]] = x["llh_bits_spike"]
                got.append(selected_model(wide, letters, alpha, baseline))
            text, number = pa.string(), pa.float64()
            yield pa.record_batch([part.column(0), *(pa.array([g[i] for g in got], t, from_pandas=t is number) for i, t in enumerate((text, text, number, number, number, text)))], names=[key, "single", "double", "p_12", "p_23", "baseline_p", "selected"])

    of = metrics.where(F.col("fold") != ALL).groupBy(key).agg(F.collect_list(F.struct("fold", "model", "llh_bits_spike")).alias("__of"))
    return of.mapInArrow(choose, f"{key} {kind}, single string, double string, p_12 double, p_23 double, baseline_p double, selected string")


def profiles(obs: DataFrame, models: DataFrame, variables: list[Variable], count: str, dt: float, key: str = "cell") -> DataFrame:
    """(cell, model, variable, bin, rate): the mean rate over all observations if they all had this bin, by the fits to all observations; of variables outside a model the mean rate."""
    columns = [v.column for v in variables]
    joint = obs.where(" and ".join(f"{c} is not null" for c in columns)).groupBy(key, *columns).agg(F.count(F.lit(1)).alias("n"))
    names = model_names(variables)
    #: A written table, as the fits are read for the means and for the rates.
    theta = stored(models.where(F.col("fold") == ALL).groupBy(key).agg(*(F.max(F.when(F.col("model") == m, F.col("theta"))).alias(f"__{m}") for m in names)), "profile-fits")
    mean = lambda m, v: (F.sum(F.col("n") * F.exp(_exponent(variables, m, F.col(f"__{m}"), v.letter))) / F.sum("n") / dt).alias(f"__{m}_{v.letter}")
    means = joint.join(theta, key).groupBy(key).agg(*(mean(m, v) for m in names for v in variables))
    of_bin = lambda m, v: F.element_at(f"__{m}", m.index(v.letter) + 1) if v.letter in m else F.array_repeat(F.lit(0.0), v.bins)
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.lit(v.letter).alias("variable"), F.col(f"__{m}_{v.letter}").alias("mean"), of_bin(m, v).alias("u")) for m in names for v in variables)))
    told = means.join(theta, key).select(key, each.alias("__e")).where("__e.u is not null")
    return told.select(key, "__e.model", "__e.variable", "__e.mean", F.posexplode("__e.u").alias("bin", "u")).select(key, "model", "variable", F.col("bin").cast("long").alias("bin"), (F.col("mean") * F.exp("u")).alias("rate"))


def roughness(maps: DataFrame, value: str, *by: str, column: str = "ix", row: str = "iy", circular: bool = False) -> DataFrame:
    """(by, roughness): the sum of squared steps between neighbours of a grid along both axes, what ``Variable.penalty`` is the matrix of; steps next to a missing bin don't count."""

    def steps(across: str, along: str) -> Column:
        w = W.partitionBy(*by, across).orderBy(along)
        before = F.when(F.lag(along).over(w) == F.col(along) - 1, F.lag(value).over(w))
        if circular:
            last = F.last(value).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
            before = F.coalesce(before, F.when(F.col(along) == 0, last))
        return (F.col(value) - before) ** 2

    return maps.withColumns({"__a": steps(row, column), "__b": steps(column, row)}).groupBy(*by).agg((F.coalesce(F.sum("__a"), F.lit(0.0)) + F.coalesce(F.sum("__b"), F.lit(0.0))).alias("roughness"))
