"""Many logistic models at once: every iteration is one pass over the rows for all outcomes and all formulas.

The rows are dealt and sorted by cluster once, and the design is made of them there. Tasks multiply their rows by numpy and send, for each
model, the rows of X'WX, the score and three sums; Spark adds them up and the driver sees k by k matrices only. Cluster-robust
covariances come from one more pass, in which X'WX at the last coefficients and a cluster's scores add up as its rows stream by.
Clusters with more rows than one in MOST_HOT of all are dealt over many tasks, whose sums meet afterwards; there are at most MOST_HOT of
them. Steps use a pseudo-inverse, so designs that are deficient by construction (splines with an intercept) are fitted as well; other
deficient designs are skipped. Coefficients of a deficient design are those of least norm after scaling.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .formulas import Design, all_there, coded_columns, designs, expression, level_counts, needed_columns
from .models import Fit

#: Eigenvalues of a scaled X'WX below this part of the largest count as zero.
ZERO = 1e-10
#: Clusters that are dealt over several tasks, at most; rows that such a cluster has at least, and the tasks that it is dealt over.
MOST_HOT, HOT_ROWS, SALTS = 1_000, 50_000, 64


@dataclass
class Model:
    """One outcome under one formula while it is being fitted."""

    outcome: str
    spec: str
    design: Design
    at: np.ndarray  # its columns among all
    beta: np.ndarray
    status: str = ""
    reason: str = ""
    n: int = 0
    events: int = 0
    turns: int = 0
    likelihood: float = -np.inf
    step: np.ndarray | None = None
    bread: np.ndarray | None = None
    sandwich: np.ndarray | None = None
    clusters: int = 0


def inverse(a: np.ndarray) -> tuple[np.ndarray, int]:
    """Pseudo-inverse and rank of a symmetric matrix, scaled to a unit diagonal first."""
    d = np.sqrt(np.maximum(np.diag(a), 0))
    d = np.where(d > 0, d, 1.0)
    values, vectors = np.linalg.eigh(a / np.outer(d, d))
    good = values > ZERO * max(values.max(initial=0.0), 1e-300)
    scaled = (vectors[:, good] / values[good]) @ vectors[:, good].T
    return scaled / np.outer(d, d), int(good.sum())


def added_up(rows: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Arrays `v` of equal length added up by key, in tasks first."""
    return rows.groupBy(*keys).agg(F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(width)]).alias("v"))


def sums(design: DataFrame, models: dict[int, Model], width: int, outcomes: dict[str, str], ok: dict[int, str], n_columns: int) -> dict[int, np.ndarray]:
    """For each model the rows of X'WX, then the score, then (rows, events, log-likelihood)."""
    told = {i: (outcomes[m.outcome], ok[i], m.at, m.beta) for i, m in models.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {i: np.zeros((len(at) + 2, width)) for i, (_, _, at, _) in told.items()}
        for batch in batches:
            x = matrix(batch, n_columns)
            made: dict = {}  # rows and columns that outcomes share are taken once
            for i, (outcome, flag, at, beta) in told.items():
                if (flag, at.tobytes()) not in made:
                    keep = batch.column(flag).to_numpy(zero_copy_only=False)
                    made[flag, at.tobytes()] = keep, x[np.ix_(keep, at)]
                keep, own = made[flag, at.tobytes()]
                y = batch.column(outcome).to_numpy(zero_copy_only=False)[keep]
                eta = own @ beta
                p = 1.0 / (1.0 + np.exp(-np.clip(eta, -700, 700)))
                k = len(at)
                total[i][:k, :k] += own.T @ (own * (p * (1 - p))[:, None])
                total[i][k, :k] += own.T @ (y - p)
                total[i][k + 1, :3] += len(y), y.sum(), (y * eta - np.logaddexp(0, eta)).sum()
        for i, t in total.items():
            yield pa.RecordBatch.from_pydict({"model": pa.array([i] * len(t), pa.int32()), "row": pa.array(np.arange(len(t)), pa.int32()), "v": pa.array(list(t), pa.list_(pa.float64()))})

    found = added_up(design.drop("cluster", "salt").mapInArrow(run, "model int, row int, v array<double>"), ["model", "row"], width).collect()
    out = {i: np.zeros((len(m.at) + 2, width)) for i, m in models.items()}
    for r in found:
        out[r["model"]][r["row"]] = r["v"]
    return out


def matrix(batch: pa.RecordBatch, n: int) -> np.ndarray:
    """Design columns of a batch; what is missing is in no complete row, and counts as 0."""
    return np.nan_to_num(np.column_stack([batch.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(n)]))


def dealt(rows: DataFrame, by: str = "cluster", salt: str = "salt") -> tuple[DataFrame, list[str]]:
    """Rows by cluster, in order, and the clusters that are spread over several tasks."""
    sizes = rows.groupBy(by).agg(F.count("*").alias("n"))
    total, largest = (v or 0 for v in sizes.agg(F.sum("n"), F.max("n")).first())
    least = max(HOT_ROWS, total // MOST_HOT)
    hot = [r[by] for r in sizes.where(F.col("n") > least).collect()] if largest > least else []
    spread = F.when(F.col(by).isin(hot), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(SALTS))).otherwise(0) if hot else F.lit(0)
    return rows.withColumn(salt, spread.cast("int")).repartition(by, salt).sortWithinPartitions(by, salt), hot


def sandwiches(design: DataFrame, hot: Sequence[str], models: dict[int, Model], width: int, outcomes: dict[str, str], ok: dict[int, str], n_columns: int) -> None:
    """X'WX at the last coefficients, inverted, and cluster-robust covariances, from scores added up by cluster, in one pass."""
    told, spread = {i: (outcomes[m.outcome], ok[i], m.at, m.beta) for i, m in models.items()}, set(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {i: np.zeros((2 * len(t[2]) + 1, width)) for i, t in told.items()}  # sums of scores' products, clusters, X'WX
        parts: dict[tuple[int, str], np.ndarray] = {}
        now, carried = None, {}

        def put(i: int, names: list, v: np.ndarray) -> None:
            """Sums of whole clusters: v has a column for each coefficient, then the number of rows."""
            k = v.shape[1] - 1
            alone = np.array([n not in spread for n in names], dtype=bool)
            own = v[alone]
            total[i][:k, :k] += own[:, :k].T @ own[:, :k]
            total[i][k, 0] += (own[:, k] > 0).sum()
            for j in np.flatnonzero(~alone):
                parts[i, names[j]] = parts.get((i, names[j]), 0) + v[j]

        for batch in batches:
            if not batch.num_rows:
                continue
            x, codes = matrix(batch, n_columns), batch.column("cluster").dictionary_encode()
            code = codes.indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            names = codes.dictionary.take(pa.array(code[starts])).to_pylist()
            for i, (outcome, flag, at, beta) in told.items():
                keep = batch.column(flag).to_numpy(zero_copy_only=False)
                own, y = x[:, at], np.nan_to_num(batch.column(outcome).to_numpy(zero_copy_only=False))
                p, k = 1.0 / (1.0 + np.exp(-np.clip(own @ beta, -700, 700))), len(at)
                kept = own[keep]
                total[i][k + 1 :, :k] += kept.T @ (kept * (p * (1 - p))[keep][:, None])
                s = own * (keep * (y - p))[:, None]
                v = np.add.reduceat(np.column_stack([s, keep]), starts)
                if now == names[0]:
                    v[0] += carried[i]
                elif now is not None:
                    put(i, [now], carried[i][None, :])
                put(i, names[:-1], v[:-1])
                carried[i] = v[-1]
            now = names[-1]
        if now is not None:
            for i, v in carried.items():
                put(i, [now], v[None, :])
        for i, t in total.items():
            yield told_rows([i] * len(t), np.arange(len(t)), [None] * len(t), t)
        if parts:
            yield told_rows([i for i, _ in parts], [-1] * len(parts), [n for _, n in parts], [np.pad(v, (0, width + 1 - len(v)))[:width] for v in parts.values()], [v[len(told[i][2])] for (i, _), v in parts.items()])

    def told_rows(model, row, name, v, n=None) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"model": pa.array(model, pa.int32()), "row": pa.array(row, pa.int32()), "name": pa.array(name, pa.string()), "v": pa.array([*([*w, c] for w, c in zip(v, n if n is not None else [0.0] * len(v)))], pa.list_(pa.float64()))})

    found = added_up(design.mapInArrow(run, "model int, row int, name string, v array<double>"), ["model", "row", "name"], width + 1).collect()
    meat, cross = ({i: np.zeros((len(m.at), len(m.at))) for i, m in models.items()} for _ in range(2))
    for r in found:
        m, k, v = models[r["model"]], len(models[r["model"]].at), np.array(r["v"])
        if r["row"] == -1:
            meat[r["model"]] += np.outer(v[:k], v[:k])
            m.clusters += int(v[width] > 0)
        elif r["row"] == k:
            m.clusters += int(v[0])
        elif r["row"] > k:
            cross[r["model"]][r["row"] - k - 1] = v[:k]
        else:
            meat[r["model"]][r["row"]] += v[:k]
    for i, m in models.items():
        m.bread = inverse(cross[i])[0]
        m.sandwich = m.bread @ meat[i] @ m.bread


def fit_grid(df: DataFrame, configs: Sequence[tuple[str, str]], specs: dict[str, str], cluster: str, by_substring: bool = False, most: int = 500, tolerance: float = 1e-12, left_out: Sequence[str] = ()) -> tuple[dict[tuple[str, str, str], Fit], list[dict]]:
    """Fits of all (outcome, kind) under all formulas (`{outcome}` stands for the outcome), and a ledger row for each.

    Kinds: asymptotic, robust (clusters, small-sample factor), gee (clusters). Statuses: OK, NO_CONVERGE after `most` steps,
    SKIP_SINGULAR for deficient designs without splines, SKIPPED for outcomes left out, FAIL with a reason. Rows are those with all values
    that a formula needs and a cluster. Passes over the rows: one an iteration, and four more (nulls and levels counted, levels and ranges,
    rows of a cluster, covariances), however many models there are. Rows that the caller keeps are not kept a second time.
    """
    pairs = [(o, s) for o in dict.fromkeys(o for o, _ in configs) for s in specs if o not in left_out]
    texts = [specs[s].format(outcome=o) for o, s in pairs]
    needs = [needed_columns(df, t, [cluster], by_substring) for t in texts]
    named = sorted({c for n in needs for c in n})
    own = not df.is_cached
    df = df.select(*[F.col(f"`{c}`") for c in named])
    df = df.persist() if own else df  # read once; dropped when the design is there
    coded = coded_columns(df, texts)
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(named)], *level_counts(coded)).first() if named else ()
    gaps = {c for c, n in zip(named, counts) if n}
    complete = [all_there([c for c in n if c in gaps]) for n in needs]
    made = designs(df, texts, complete, dict(zip(coded, counts[len(named) :])))
    columns: dict[tuple, int] = {}
    for d in made:
        if isinstance(d, Design):
            for _, pieces in d.columns:
                columns.setdefault(pieces, len(columns))
    models, failed = {}, {}
    for i, ((o, s), d) in enumerate(zip(pairs, made)):
        if isinstance(d, Design):
            models[i] = Model(o, s, d, np.array([columns[p] for _, p in d.columns]), np.zeros(len(d.columns)))
        else:
            failed[o, s] = d
    fits, ledger = {}, []
    if not models:
        if own:
            df.unpersist()
    else:
        outcomes = {o: f"y{i}" for i, o in enumerate(dict.fromkeys(o for o, _ in pairs))}
        flags = {str(c._jc): f"ok{i}" for i, c in enumerate(complete)}  # models that need the same values share a flag
        ok = {i: flags[str(complete[i]._jc)] for i in models}
        width = max(3, *(len(m.at) for m in models.values()))
        once = {ok[i]: complete[i] for i in models}
        rows, hot = dealt(df.where(reduce(or_, once.values())).withColumn("_cluster", F.col(f"`{cluster}`").cast("string")), "_cluster", "_salt")
        design = rows.select(F.col("_cluster").alias("cluster"), F.col("_salt").alias("salt"), *[F.col(o).cast("double").alias(y) for o, y in outcomes.items()], *[c.alias(f) for f, c in once.items()], *[expression(p).alias(f"x{i}") for p, i in columns.items()]).persist()
        try:
            found = sums(design, models, width, outcomes, ok, len(columns))
            if own:
                df.unpersist()
            iterate(design, models, found, width, outcomes, ok, len(columns), most, tolerance)
            done = {i: m for i, m in models.items() if m.status == "OK"}
            if done:
                sandwiches(design, hot, done, width, outcomes, ok, len(columns))
        finally:
            design.unpersist()
    by_name = {(m.outcome, m.spec): m for m in models.values()}
    for outcome, kind in configs:
        for spec in specs:
            m = by_name.get((outcome, spec))
            if m is None:
                status, reason = ("SKIPPED", "left out") if outcome in left_out else ("FAIL", failed[outcome, spec])
                ledger.append({"outcome": outcome, "method": kind, "spec": spec, "status": status, "n_obs": 0, "n_events": 0, "n_clusters": 0, "reason": reason})
                continue
            ledger.append({"outcome": outcome, "method": kind, "spec": spec, "status": m.status, "n_obs": m.n, "n_events": m.events, "n_clusters": m.clusters, "reason": m.reason})
            k = len(m.at)
            small = m.clusters / (m.clusters - 1.0) * (m.n - 1.0) / (m.n - k) if m.clusters > 1 and m.n > k else 1.0
            cov = np.full((k, k), np.nan) if m.bread is None else {"asymptotic": m.bread, "gee": m.sandwich, "robust": small * m.sandwich}[kind]
            beta = m.beta if m.bread is not None else np.full(k, np.nan)
            fits[outcome, kind, spec] = Fit(m.design.names(), beta, cov, m.n, "converged" if m.status == "OK" else m.status, m.turns, m.clusters, {"design": m.design})
    return fits, ledger


def iterate(design: DataFrame, models: dict[int, Model], found: dict[int, np.ndarray], width: int, outcomes: dict[str, str], ok: dict[int, str], n_columns: int, most: int, tolerance: float) -> None:
    """Newton steps of all open models together, halved where the likelihood fell, until none is open; the first from the sums `found`."""
    open_ = dict(models)
    while open_:
        for i, t in found.items():
            m = open_[i]
            k = len(m.at)
            a, g, (n, events, likelihood) = t[:k, :k], t[k, :k], t[k + 1, :3]
            if m.turns == 0:
                m.n, m.events = int(n), int(events)
                if not n or events in (0, n):
                    m.status, m.reason = "FAIL", "no rows" if not n else "one outcome only"
                elif not m.design.formula.has_splines() and (rank := inverse(a)[1]) < k:
                    m.status, m.reason = "SKIP_SINGULAR", f"design matrix rank {rank}/{k}"
            elif likelihood < m.likelihood - 1e-9 * abs(m.likelihood):
                m.step = m.step / 2
                m.beta = m.beta - m.step
                m.turns += 1
                if m.turns >= most:
                    m.status, m.reason = "NO_CONVERGE", "most steps reached"
                continue
            if m.status:
                continue
            if likelihood > -1e-6 * n:
                m.status, m.reason = "FAIL", "perfect separation"
                continue
            step = inverse(a)[0] @ g
            m.beta, m.step, m.likelihood, m.turns = m.beta + step, step, likelihood, m.turns + 1
            if g @ step < tolerance * n:
                m.status = "OK"
            elif m.turns >= most or not np.isfinite(m.beta).all():
                m.status, m.reason = "NO_CONVERGE", "most steps reached" if m.turns >= most else "coefficients are not finite"
        open_ = {i: m for i, m in open_.items() if not m.status}
        found = sums(design, open_, width, outcomes, ok, n_columns) if open_ else {}


def percentile_contrast(fit: Fit, reference: dict, predictor: str, low: float, high: float, indicator: str | None = None) -> tuple[float, float, float]:
    """Odds ratio with its interval of a predictor at `high` against `low`, all else at the reference row; its indicator, if any, is 1 in both."""
    from .models import contrast

    nothing = (float("nan"),) * 3
    design = fit.terms.get("design")
    if fit.status != "converged" or design is None or low == high:
        return nothing
    at = lambda x: design.row({**reference, predictor: x, **({indicator: 1} if indicator else {})})
    a, b = at(low), at(high)
    return nothing if np.allclose(a, b) else contrast(fit, a, b)


def staged(df: DataFrame, stages: Sequence[tuple[str, Column, str]]) -> DataFrame:
    """`df` with a column for each stage (name, rows at risk, outcome): its outcome, missing where a row is not at risk. As outcomes of one
    `fit_grid` they give each stage a fit on its own rows, and all stages share the passes."""
    return df.withColumns({name: F.when(at_risk, F.col(outcome)) for name, at_risk, outcome in stages})


def anchors(df: DataFrame, predictors: Sequence[str], indicators: dict[str, str] | None = None, shares: Sequence[float] = (0.1, 0.9)) -> dict[str, tuple[float, ...]]:
    """Percentiles of each predictor over a whole cohort (the 10th and 90th), of the values that are not 0 where it has an indicator."""
    value = lambda c: F.when((F.col(c) != 0) | F.lit(c not in (indicators or {})), F.col(c).cast("double"))
    row = df.select(*[value(c).alias(f"v{i}") for i, c in enumerate(predictors)]).agg(*[F.expr(f"percentile(v{i}, array({', '.join(map(repr, shares))}))").alias(c) for i, c in enumerate(predictors)]).first()
    return {c: tuple(row[c]) for c in predictors if row[c] is not None}
