"""Logistic models on aggregates: every iteration is one Spark aggregation of the design's cross products.

The driver sees k by k matrices only. One fit serves three model types: same coefficients, with a model-based, a
cluster-robust, or a small-sample cluster-robust covariance (an independence GEE equals the second).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import fixed
from .pooling import student_quantile


@dataclass
class Fit:
    """Coefficients of one model, their covariance, and how the fit went."""

    names: list[str]
    beta: np.ndarray
    cov: np.ndarray
    n: int
    status: str
    iterations: int = 0
    clusters: int = 0
    terms: dict[str, Column] = field(default_factory=dict)

    def se(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.cov), 0.0))


def complete(df: DataFrame, outcome: str, columns: Sequence[str]) -> DataFrame:
    """Rows with the outcome and all the columns named (exactly these, not those whose names resemble them)."""
    return df.dropna(subset=[outcome, *columns])


def spline(x: Column, knots: Sequence[float]) -> list[Column]:
    """Natural cubic basis without the constant: linear beyond the outer knots; len(knots) - 1 terms."""
    scale = (knots[-1] - knots[0]) ** 2
    cube = lambda k: F.pow(F.greatest(x - F.lit(float(k)), F.lit(0.0)), F.lit(3.0))
    last, before = knots[-1], knots[-2]
    terms = [x.cast("double")]
    for k in knots[:-2]:
        terms.append((cube(k) - cube(before) * ((last - k) / (last - before)) + cube(last) * ((before - k) / (last - before))) / scale)
    return terms


def gram(df: DataFrame, names: Sequence[str], weight: Column, target: Column) -> tuple[np.ndarray, np.ndarray, float]:
    """X'WX, X'Wz and the sum of the weights, in one aggregation."""
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    x = [F.col(c) for c in names]
    row = df.withColumn("_w", weight).withColumn("_z", target).agg(*[F.sum(F.col("_w") * x[i] * x[j]) for i, j in pairs], *[F.sum(F.col("_w") * x[i] * F.col("_z")) for i in range(k)], F.count("*")).first()
    a = np.zeros((k, k))
    for (i, j), v in zip(pairs, row):
        a[i, j] = a[j, i] = v or 0.0
    return a, np.array([v or 0.0 for v in row[len(pairs) : len(pairs) + k]]), float(row[-1])


def logit(df: DataFrame, outcome: str, terms: dict[str, Column], cluster: str | None = None, kind: str = "asymptotic", most: int = 30, tolerance: float = 1e-9) -> Fit:
    """One fit of `logits`."""
    return logits(df, outcome, terms, cluster, (kind,), most, tolerance)[kind]


def logits(df: DataFrame, outcome: str, terms: dict[str, Column], cluster: str | None = None, kinds: Sequence[str] = ("asymptotic",), most: int = 30, tolerance: float = 1e-9) -> dict[str, Fit]:
    """Maximum likelihood by iteratively reweighted least squares, once, with a covariance for each kind: asymptotic, robust or gee.

    Terms that are linear combinations of others, outcomes without both values and fits that do not settle give a status
    instead of an error. Coefficients are those at the last step.
    """
    names = ["Intercept", *terms]
    cols = [f"_x{i}" for i in range(len(names))]
    data = df.select(F.col(outcome).cast("double").alias("_y"), *([F.col(cluster).alias("_c")] if cluster else []), F.lit(1.0).alias("_x0"), *[e.cast("double").alias(c) for e, c in zip(terms.values(), cols[1:])])
    data = data.dropna(subset=["_y", *cols])
    nothing = lambda status, n=0: {k: Fit(names, np.full(len(names), np.nan), np.full((len(names), len(names)), np.nan), n, status, terms=dict(terms)) for k in kinds}
    data = data.persist()
    try:
        n, ones = data.agg(F.count("*"), F.sum("_y")).first()
        if not n:
            return nothing("no rows")
        if ones in (0, n):
            return nothing("one outcome only", n)
        cross, _, _ = gram(data, cols, F.lit(1.0), F.lit(0.0))
        size = np.sqrt(np.diag(cross))
        if np.linalg.matrix_rank(cross / np.outer(np.where(size > 0, size, 1), np.where(size > 0, size, 1)), tol=1e-10) < len(names):
            return nothing("rank deficient", n)
        beta, settled, turn = np.zeros(len(names)), False, 0
        for turn in range(1, most + 1):
            eta = sum((F.col(c) * float(b) for c, b in zip(cols, beta)), F.lit(0.0))
            p = 1.0 / (1.0 + F.exp(-eta))
            w = F.greatest(p * (1.0 - p), F.lit(1e-10))
            a, b, _ = gram(data, cols, w, eta + (F.col("_y") - p) / w)
            new = np.linalg.solve(a, b)
            done = np.max(np.abs(new - beta)) < tolerance
            beta = new
            if done:
                settled = True
                break
            if np.max(np.abs(beta)) > 1e4:
                break
        bread = np.linalg.inv(a)
        sandwich, g = bread, 0
        if set(kinds) != {"asymptotic"}:
            eta = sum((F.col(c) * float(b) for c, b in zip(cols, beta)), F.lit(0.0))
            residual = F.col("_y") - 1.0 / (1.0 + F.exp(-eta))
            scores = data.groupBy("_c").agg(*[F.sum(F.col(c) * residual).alias(c) for c in cols])
            meat, _, g = gram(scores, cols, F.lit(1.0), F.lit(0.0))
            sandwich = bread @ meat @ bread
        small = (g / (g - 1.0)) * ((n - 1.0) / (n - len(names))) if g > 1 else 1.0
        cov = {"asymptotic": bread, "gee": sandwich, "robust": sandwich * small}
        status = "converged" if settled else "not converged"
        return {k: Fit(names, beta, cov[k], n, status, turn, 0 if k == "asymptotic" else int(g), dict(terms)) for k in kinds}
    finally:
        data.unpersist()


def contrast(fit: Fit, low: Sequence[float], high: Sequence[float], z: float = 1.959963984540054) -> tuple[float, float, float]:
    """Odds ratio of a row `high` against `low` and its interval, by the delta method; NaN where it is not defined."""
    c = np.asarray(high, float) - np.asarray(low, float)
    effect, variance = float(c @ fit.beta), float(c @ fit.cov @ c)
    if not math.isfinite(effect) or not math.isfinite(variance) or variance < 0:
        return (math.nan,) * 3
    se = math.sqrt(variance)
    exp = lambda v: math.exp(v) if v < 700 else math.inf
    return exp(effect), exp(effect - z * se), exp(effect + z * se)


def coefficients(spark: SparkSession, fits: dict[tuple[str, str, str], Fit]) -> DataFrame:
    """Long table of (outcome, model, spec, predictor) with odds ratios; failed fits keep a row with their status."""
    rows = []
    for (outcome, model, spec), f in fits.items():
        if f.status != "converged":
            rows.append((outcome, model, spec, None, None, None, None, None, None, f.n, f.status, "FAIL"))
            continue
        for i, name in enumerate(f.names):
            unit = np.eye(len(f.names))[i]
            rows.append((outcome, model, spec, name, float(f.beta[i]), float(f.se()[i]), *contrast(f, 0 * unit, unit), f.n, f.status, "intercept" if i == 0 else "term"))
    return spark.createDataFrame(rows, "outcome string, model string, spec string, predictor string, log_or double, se double, odds_ratio double, low double, high double, n long, status string, row_type string")


def wide_table(coefs: DataFrame, models: Sequence[str]) -> DataFrame:
    """Formatted odds ratios with stars for p < 0.05, one column a model."""
    star = F.when(F.abs(F.col("log_or") / F.col("se")) > 1.959963984540054, "*").otherwise("")
    text = F.concat(F.format_string("%s (%s, %s)", *[fixed(c, 2) for c in ("odds_ratio", "low", "high")]), star)
    return coefs.where("row_type = 'term'").withColumn("_t", text).groupBy("outcome", "spec", "predictor").pivot("model", list(models)).agg(F.first("_t"))


def marginal_grid(spark: SparkSession, fit: Fit, reference: dict[str, float], vary: str, low: float, high: float, points: int = 50) -> DataFrame:
    """Predicted probability with its interval as one term moves and the others stay at the reference row."""
    rows = []
    for v in np.linspace(low, high, points):
        x = np.array([1.0, *[float(v) if n == vary else float(reference.get(n, 0.0)) for n in fit.names[1:]]])
        eta, se = float(x @ fit.beta), math.sqrt(max(float(x @ fit.cov @ x), 0.0))
        rows.append((float(v), *[1.0 / (1.0 + math.exp(-(eta + k * 1.959963984540054 * se))) for k in (0, -1, 1)]))
    return spark.createDataFrame(rows, "x double, p double, low double, high double")


def grid(df: DataFrame, configs: dict[str, Sequence[str]], specs: dict[str, dict[str, Column]], cluster: str) -> dict[tuple[str, str, str], Fit]:
    """Fits of every outcome (with its kinds) under every set of terms, by (outcome, kind, spec): one fit serves all kinds.

    The rows are made once for all fits, so a side that a join broadcasts goes through the driver once.
    """
    found = {}
    own = not df.is_cached  # rows that the caller keeps stay as they are
    df = df.persist() if own else df
    try:
        for outcome, kinds in configs.items():
            for spec, terms in specs.items():
                for kind, fit in logits(df, outcome, terms, cluster, kinds).items():
                    found[outcome, kind, spec] = fit
    finally:
        if own:
            df.unpersist()
    return found


def quartiles(df: DataFrame, column: str, least: int = 100) -> list[float] | None:
    """Quartiles of the values that are not 0, rounded half up to six digits; None with fewer than `least` of them."""
    some = df.where(F.col(column) != 0).agg(F.count(column).alias("n"), F.expr(f"percentile(`{column}`, array(0.25, 0.5, 0.75))").alias("q"))
    n, q = some.select("n", F.transform("q", lambda x: F.round(x, 6))).first()
    return None if n < least else [float(x) for x in q]


def quartile_knots(df: DataFrame, column: str, least: int = 100) -> list[float] | None:
    """Least, quartiles and greatest of the values that are not 0, as spline knots; None with fewer than `least` of them or fewer than three different ones."""
    inner = quartiles(df, column, least)
    if inner is None:
        return None
    low, high = df.where(F.col(column) != 0).agg(F.min(column), F.max(column)).first()
    knots = sorted({float(low), *inner, float(high)})
    return knots if len(knots) >= 3 else None


def quartile_term(df: DataFrame, column: str, indicator: str | None = None, least: int = 100) -> str:
    """A spline term for a formula: inner knots at the quartiles of the values that are not 0, four functions where there are too few
    or too many equal ones, times its indicator. Its outer knots are the range of all rows of the fit."""
    inner = quartiles(df, column, least)
    text = f"cr({column}, df=4)" if inner is None or len(set(inner)) < 2 else f"cr({column}, knots={sorted(set(inner))})"
    return f"{text}:{indicator}" if indicator else text


def cascade(df: DataFrame, stages: Sequence[tuple[str, Column, str]], terms: dict[str, Column], cluster: str, kind: str = "robust") -> dict[str, Fit]:
    """A fit for each stage (name, rows at risk, outcome), each on its own subset."""
    return {name: logit(df.where(at_risk), outcome, terms, cluster, kind) for name, at_risk, outcome in stages}


def cohort_summary(df: DataFrame, stages: Sequence[tuple[str, Column, str]], cluster: str) -> DataFrame:
    """Rows at risk, clusters, events and their share of every stage, from one pass over the rows."""
    exprs = [e for i, (_, at_risk, outcome) in enumerate(stages) for e in (
        F.count_if(at_risk & F.col(outcome).isNotNull()).alias(f"n{i}"), F.count_distinct(F.when(at_risk & F.col(outcome).isNotNull(), F.col(cluster))).alias(f"c{i}"), F.count_if(at_risk & (F.col(outcome) == 1)).alias(f"e{i}"))]
    rows = [F.struct(F.lit(name).alias("stage"), F.lit(outcome).alias("outcome"), F.col(f"n{i}").alias("n"), F.col(f"c{i}").alias("clusters"), F.col(f"e{i}").alias("events"), F.try_divide(f"e{i}", f"n{i}").alias("share")) for i, (name, _, outcome) in enumerate(stages)]
    return df.agg(*exprs).select(F.inline(F.array(*rows)))


def welch(df: DataFrame, value: str, group: Column) -> DataFrame:
    """Difference of two groups' means, Welch's t, its degrees of freedom and a 95 % interval, from group moments."""
    one = df.groupBy(group.cast("int").alias("g")).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    rows = {r["g"]: r for r in one.collect() if r["g"] is not None}
    a, b = rows[1], rows[0]
    va, vb = a["v"] / a["n"], b["v"] / b["n"]
    se = math.sqrt(va + vb)
    dof = (va + vb) ** 2 / (va**2 / (a["n"] - 1) + vb**2 / (b["n"] - 1))
    half = student_quantile(0.975, dof) * se
    diff = a["m"] - b["m"]
    return df.sparkSession.createDataFrame([(diff, diff / se, dof, diff - half, diff + half)], "difference double, t double, dof double, low double, high double")
