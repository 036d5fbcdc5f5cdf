"""Count and binary regressions: one aggregate per Newton step, a p x p solve on the driver."""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Fit:
    """Coefficients in term order (intercept first where there is one) with their covariance."""

    terms: list[str]
    beta: np.ndarray
    cov: np.ndarray
    alpha: float = 0.0
    steps: int = 0
    rows: int = 0
    converged: bool = True

    def linear(self, offset: Column | None = None) -> Column:
        eta = offset if offset is not None else F.lit(0.0)
        for name, b in zip(self.terms, self.beta):
            eta = eta + (F.lit(float(b)) if name == "intercept" else float(b) * F.col(name))
        return eta

    def table(self, spark) -> DataFrame:
        """Term, coefficient, ratio with 95% interval, p value."""
        rows = []
        for name, b, v in zip(self.terms, self.beta, np.diag(self.cov)):
            se = math.sqrt(max(v, 0.0))
            if math.isinf(se):  # the data set no bound on this term
                rows.append((name, float(b), _exp(b), 0.0, math.inf, 1.0))
                continue
            z = abs(b) / se if se > 0 else float("inf")
            rows.append((name, float(b), _exp(b), _exp(b - 1.96 * se), _exp(b + 1.96 * se), math.erfc(z / math.sqrt(2))))
        return spark.createDataFrame(rows, "term string, coefficient double, ratio double, ci95_low double, ci95_high double, p_value double")


def _exp(x: float) -> float:
    """exp, infinite beyond the largest double."""
    return math.exp(x) if x < 709.0 else math.inf


def _checked(fit: Fit) -> Fit:
    """Say so when a fit ran out of steps."""
    if not fit.converged:
        warnings.warn(f"no convergence after {fit.steps} steps: {', '.join(fit.terms)}", RuntimeWarning, stacklevel=3)
    return fit


def _upper(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def _matrix(row, p: int, tag: str) -> np.ndarray:
    m = np.zeros((p, p))
    for i, j in _upper(p):
        m[i, j] = m[j, i] = row[f"{tag}{i}_{j}"] or 0.0
    return m


def _x(terms: Sequence[str]) -> list[Column]:
    return [F.lit(1.0) if t == "intercept" else F.col(t) for t in terms]


def _normal_equations(df: DataFrame, terms: Sequence[str], y: str, offset: Column, models: Mapping[int, np.ndarray], alpha: float, fold: str | None):
    """XᵀWX and XᵀWz of every model from one pass; model m never sees rows of fold m."""
    p = len(terms)
    betas = F.array(*[F.struct(F.lit(m).alias("m"), F.lit([float(v) for v in b]).alias("b")) for m, b in models.items()])
    rows = df.select("*", F.explode(betas).alias("__m")).select("*", F.col("__m.m").alias("__id"), F.col("__m.b").alias("__b"))
    if fold:
        rows = rows.filter(F.col("__id") != F.col(fold))
    xs = _x(terms)
    lin = sum((F.get("__b", i) * x for i, x in enumerate(xs)), F.lit(0.0))
    eta = F.least(F.greatest(lin + offset, F.lit(-30.0)), F.lit(30.0))
    rows = rows.withColumn("__mu", F.exp(eta)).withColumn("__lin", lin)
    w = F.col("__mu") / (1 + alpha * F.col("__mu"))
    z = F.col("__lin") + (F.col(y) - F.col("__mu")) / F.col("__mu")
    rows = rows.withColumns({"__w": w, "__z": z})
    aggs = [F.sum(F.col("__w") * xs[i] * xs[j]).alias(f"a{i}_{j}") for i, j in _upper(p)]
    aggs += [F.sum(F.col("__w") * xs[i] * F.col("__z")).alias(f"z{i}") for i in range(p)]
    aggs.append(F.count(F.lit(1)).alias("n"))
    got = rows.groupBy("__id").agg(*aggs).collect()  # one row per model
    return {r["__id"]: (_matrix(r, p, "a"), np.array([r[f"z{i}"] or 0.0 for i in range(p)]), r["n"]) for r in got}


def _dispersion_step(df: DataFrame, y: str, mu: Column, r: float) -> float:
    """One guarded Newton step for r = 1/alpha on the log scale."""
    yy = F.col(y)
    j = F.when(yy > 0, F.sequence(F.lit(0), (yy - 1).cast("int")))
    s1 = F.coalesce(F.aggregate(j, F.lit(0.0), lambda s, k: s + 1 / (k + r)), F.lit(0.0))
    s2 = F.coalesce(F.aggregate(j, F.lit(0.0), lambda s, k: s + 1 / ((k + r) * (k + r))), F.lit(0.0))
    rm = mu + r
    row = df.agg(
        F.sum(s1 + math.log(r) + 1 - F.log(rm) - (yy + r) / rm).alias("g"),
        F.sum(-s2 + 1 / r - 2 / rm + (yy + r) / (rm * rm)).alias("h"),
    ).first()
    g, h = row["g"] * r, row["h"] * r * r + row["g"] * r  # chain rule to log r
    step = -g / h if h < 0 else math.copysign(1.0, g)
    return r * math.exp(max(-1.0, min(1.0, step)))


def fit_negative_binomial(
    df: DataFrame, y: str, terms: Sequence[str], offset: str | None = None, alpha: float | None = None, tol: float = 1e-8, max_steps: int = 40
) -> Fit:
    """NB2 regression with log link. ``alpha=None`` estimates the dispersion, 0 gives Poisson."""
    names = ["intercept", *terms]
    off = F.col(offset) if offset else F.lit(0.0)
    cols = [y, *terms, *([offset] if offset else [])]
    data = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).persist()
    try:
        start = data.agg((F.sum(y) / F.sum(F.exp(off))).alias("r"), F.count(F.lit(1)).alias("n")).first()
        beta = np.zeros(len(names))
        beta[0] = math.log(max(start["r"], 1e-9))
        a = 0.5 if alpha is None else alpha
        cov = np.eye(len(names))
        for step in range(1, max_steps + 1):
            xwx, xwz, n = _normal_equations(data, names, y, off, {0: beta}, a, None)[0]
            new = np.linalg.solve(xwx + 1e-10 * np.eye(len(names)), xwz)
            moved = float(np.max(np.abs(new - beta)))
            if moved > 4:  # far step: go half way
                new = beta + (new - beta) * (4 / moved)
            beta, cov = new, np.linalg.pinv(xwx)
            shift = 0.0
            if alpha is None:
                model = Fit(names, beta, cov)
                r = _dispersion_step(data, y, F.exp(model.linear(off)), 1 / a)
                shift = abs(math.log(r * a))
                a = min(max(1 / r, 1e-6), 1e3)
            if moved < tol and shift < 1e-6:
                break
        return _checked(Fit(names, beta, cov, a, step, n, moved < tol and shift < 1e-6))
    finally:
        data.unpersist()


def fit_negative_binomial_by_fold(df: DataFrame, y: str, terms: Sequence[str], fold: str, folds: int, alpha: float, offset: str | None = None, tol: float = 1e-8, max_steps: int = 30) -> dict[int, Fit]:
    """Fixed-dispersion fits that each leave one fold out; all folds share every pass over the rows."""
    names = ["intercept", *terms]
    off = F.col(offset) if offset else F.lit(0.0)
    cols = [y, *terms, *([offset] if offset else [])]
    data = df.select(*[F.col(c).cast("double").alias(c) for c in cols], fold).persist()
    try:
        start = data.agg((F.sum(y) / F.sum(F.exp(off))).alias("r")).first()["r"]
        betas = {k: np.array([math.log(max(start, 1e-9)), *[0.0] * len(terms)]) for k in range(folds)}
        fits: dict[int, Fit] = {}
        for step in range(1, max_steps + 1):
            parts = _normal_equations(data, names, y, off, betas, alpha, fold)
            moved = 0.0
            for k, (xwx, xwz, n) in parts.items():
                new = np.linalg.solve(xwx + 1e-10 * np.eye(len(names)), xwz)
                gap = float(np.max(np.abs(new - betas[k])))
                betas[k] = new if gap <= 4 else betas[k] + (new - betas[k]) * (4 / gap)
                moved = max(moved, gap)
                fits[k] = Fit(names, betas[k], np.linalg.pinv(xwx), alpha, step, n)
            if moved < tol:
                break
        for fit in fits.values():
            fit.converged = moved < tol
            _checked(fit)
        return fits
    finally:
        data.unpersist()


def predict_out_of_fold(df: DataFrame, fits: Mapping[int, Fit], fold: str, offset: str | None = None, name: str = "mu") -> DataFrame:
    """Every row is scored by the model that never saw its fold."""
    off = F.col(offset) if offset else F.lit(0.0)
    out = None
    for k, fit in fits.items():
        mu = F.exp(fit.linear(off))
        out = F.when(F.col(fold) == k, mu) if out is None else out.when(F.col(fold) == k, mu)
    return df.withColumn(name, out)


def fit_conditional_logit(df: DataFrame, stratum: str, is_case: str, terms: Sequence[str], tol: float = 1e-9, max_steps: int = 30) -> Fit:
    """Matched sets with one case each: Newton on the conditional likelihood.

    Rows are placed by stratum once and kept, so the per-stratum sums of every step need no shuffle.
    Where the sets separate, the likelihood rises without end: the coefficients that run away are infinite, with the
    interval 0 to infinity, and the fit says that it has not converged.
    """
    from kerbline.operators.relational import complete_strata

    p = len(terms)
    data = complete_strata(df, stratum, is_case).select(stratum, is_case, *[F.col(t).cast("double").alias(t) for t in terms]).repartition(F.col(stratum)).persist()
    try:
        beta, cov = np.zeros(p), np.eye(p)
        xs = [F.col(t) for t in terms]
        for step in range(1, max_steps + 1):
            e = F.exp(sum((float(b) * x for b, x in zip(beta, xs)), F.lit(0.0)))
            sets = data.withColumn("__e", e).groupBy(stratum).agg(
                F.sum("__e").alias("__s"),
                *[F.sum(F.col("__e") * xs[i]).alias(f"__m{i}") for i in range(p)],
                *[F.sum(F.col("__e") * xs[i] * xs[j]).alias(f"__q{i}_{j}") for i, j in _upper(p)],
                *[F.sum(F.when(F.col(is_case) == 1, xs[i]).otherwise(0.0)).alias(f"__c{i}") for i in range(p)],
            )
            mean = lambda i: F.col(f"__m{i}") / F.col("__s")
            row = sets.agg(
                *[F.sum(F.col(f"__c{i}") - mean(i)).alias(f"g{i}") for i in range(p)],
                *[F.sum(F.col(f"__q{i}_{j}") / F.col("__s") - mean(i) * mean(j)).alias(f"h{i}_{j}") for i, j in _upper(p)],
                F.count(F.lit(1)).alias("n"),
            ).first()
            g, h = np.array([row[f"g{i}"] or 0.0 for i in range(p)]), _matrix(row, p, "h")
            cov = np.linalg.pinv(h)
            move = cov @ g
            size = float(np.max(np.abs(move))) if p else 0.0
            start = h if step == 1 else start
            if size > 0.1 and move @ h @ move <= 1e-10 * (move @ start @ move):  # no curvature left where it still moves
                away = np.abs(move) > 0.1 * size
                beta, cov = np.where(away, np.copysign(np.inf, move), beta), np.where(np.diag(away), np.inf, cov)
                break
            beta = beta + (move if size <= 2 else move * (2 / size))
            if size < tol:
                break
        return _checked(Fit(list(terms), beta, cov, 0.0, step, row["n"], size < tol))
    finally:
        data.unpersist()


def fit_logistic(df: DataFrame, label: str, terms: Sequence[str]) -> Fit:
    """Logistic regression with standard errors, by Spark ML's GLM."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    data = VectorAssembler(inputCols=list(terms), outputCol="features").transform(
        df.select(F.col(label).cast("double").alias("label"), *[F.col(t).cast("double").alias(t) for t in terms])
    )
    model = GeneralizedLinearRegression(family="binomial", link="logit", maxIter=50, tol=1e-10).fit(data)
    se = np.array(model.summary.coefficientStandardErrors)  # coefficients first, intercept last
    beta = np.array([model.intercept, *model.coefficients.toArray()])
    order = np.array([se[-1], *se[:-1]])
    return Fit(["intercept", *terms], beta, np.diag(order**2))


def probability(eta: Column) -> Column:
    return 1 / (1 + F.exp(-eta))


def counterfactual_means(df: DataFrame, fit: Fit, scenarios: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Mean predicted probability when some columns are set to the same value for every row; one aggregate."""
    aggs = []
    for i, fixed in enumerate(scenarios.values()):
        eta = F.lit(0.0)
        for name, b in zip(fit.terms, fit.beta):
            x = F.lit(1.0) if name == "intercept" else F.lit(float(fixed[name])) if name in fixed else F.col(name).cast("double")
            eta = eta + float(b) * x
        aggs.append(F.avg(probability(eta)).alias(f"s{i}"))
    rows = [F.struct(F.lit(n).alias("scenario"), F.col(f"s{i}").alias("mean_probability")) for i, n in enumerate(scenarios)]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def multipliers(means: DataFrame, base: str) -> DataFrame:
    """Ratio of each scenario to the base scenario, never below 1."""
    ref = means.filter(F.col("scenario") == base).select("mean_probability").scalar()
    held = means.withColumn("__ref", ref)
    return held.withColumn("multiplier", F.bround(F.greatest(F.col("mean_probability") / F.col("__ref"), F.lit(1.0)), 3)).drop("__ref")


def boosted_classifier(train: DataFrame, test: DataFrame, label: str, terms: Sequence[str], trees: int = 20, depth: int = 4) -> DataFrame:
    """Boosted trees as a ceiling check: the test rows with their probability."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    asm = VectorAssembler(inputCols=list(terms), outputCol="features", handleInvalid="keep")
    pack = lambda d: asm.transform(d.withColumn("label", F.col(label).cast("double")))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.1, seed=7).fit(pack(train))
    return model.transform(pack(test)).withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction", "label")
