"""Formulas, spline bases and joint fits against dense numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoward.operators import formulas, jointfits, models
from chronoward.plans import statistics


def natural_by_solve(knots, x):
    """The same basis by another route: a cubic for each piece, from the conditions at the knots as one linear system."""
    n = len(knots)
    pieces = n - 1
    out = np.zeros((len(x), n))
    for m in range(n):
        rows, right = [], []

        def row(j, t, order, value, other=None):
            r = np.zeros(4 * pieces)
            for sign, (jj, tt) in ((1, (j, t)), *(((-1, other),) if other else ())):
                for p in range(order, 4):
                    r[4 * jj + p] += sign * math.perm(p, order) * tt ** (p - order)
            rows.append(r)
            right.append(value)

        for j in range(pieces):
            h = knots[j + 1] - knots[j]
            row(j, 0.0, 0, float(m == j))
            row(j, h, 0, float(m == j + 1))
            if j + 1 < pieces:
                row(j, h, 1, 0.0, (j + 1, 0.0))
                row(j, h, 2, 0.0, (j + 1, 0.0))
        row(0, 0.0, 2, 0.0)
        row(pieces - 1, knots[-1] - knots[-2], 2, 0.0)
        c = np.linalg.solve(np.array(rows), np.array(right))
        for i, v in enumerate(x):
            j = min(max(int(np.searchsorted(knots, v)) - 1, 0), pieces - 1)
            t = v - knots[j]
            if v < knots[0]:
                out[i, m] = c[0] + c[1] * t
            elif v > knots[-1]:
                h = knots[-1] - knots[-2]
                d = c[4 * j : 4 * j + 4]
                out[i, m] = np.polyval(d[::-1], h) + (d[1] + 2 * d[2] * h + 3 * d[3] * h * h) * (v - knots[-1])
            else:
                out[i, m] = np.polyval(c[4 * j : 4 * j + 4][::-1], t)
    return out


def test_cardinal_spline(spark):
    knots = [-2.0, -0.5, 0.0, 1.5, 4.0]
    x = [*np.linspace(-5, 7, 49), *knots]
    want = natural_by_solve(knots, x)
    design = formulas.Design(formulas.parsed("y ~ x"), tuple((str(m), (formulas.Piece("x", knots=tuple(knots), function=m),)) for m in range(5)))
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(999, None)], "i int, x double")
    rows = {r[0]: r[1:] for r in df.select("i", *[e.alias(f"s{m}") for m, e in enumerate(design.expressions())]).collect()}
    assert rows.pop(999) == (None,) * 5
    assert np.allclose([rows[i] for i in range(len(x))], want, atol=1e-12)
    assert np.allclose([design.row({"x": v}) for v in x], want, atol=1e-12)
    assert np.allclose(want.sum(axis=1), 1)  # hence deficient with an intercept
    with pytest.raises(ValueError):
        formulas.cardinal_spline([1.0, 1.0, 2.0])


def test_parsed():
    f = formulas.parsed("y ~ a + C(b) + cr(c, knots=[1, 2.5, -3]):d + cr(e, df=4)")
    assert f.outcome == "y" and f.columns() == ["y", "a", "b", "c", "d", "e"] and f.has_splines()
    assert [[x.kind for x in t] for t in f.terms] == [["plain"], ["levels"], ["spline", "plain"], ["spline"]]
    assert f.terms[2][0].knots == (1.0, 2.5, -3.0) and f.terms[3][0].df == 4
    for bad in ("y ~ log(a)", "y ~ a + ", "y ~ cr(x)", "y ~ C(a, df=3)", "y ~ a*b"):
        with pytest.raises(ValueError):
            formulas.parsed(bad)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    out = []
    for i in range(900):
        x, z, g = rng.gauss(0, 1), max(0.0, rng.gauss(0, 2)), rng.randrange(60)
        b = rng.choice("abc")
        p = 1 / (1 + math.exp(-(0.3 + 0.8 * x - 0.2 * x * x + 0.3 * (b == "b") + 0.1 * (g % 5))))
        out.append((g if i % 50 else None, int(rng.random() < p), int(rng.random() < 0.4), x if i % 13 else None, z, int(z > 0), b if i % 17 else None, 0, 1 if i % 3 else None))
    return spark.createDataFrame(out, "g int, y int, u int, x double, z double, z_any int, b string, never int, x_other int").repartition(5)


def dense(x, y, g):
    """Coefficients of least norm after scaling, fitted values and three covariances, by plain Newton steps."""
    d = np.sqrt((x * x).mean(axis=0))
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        a = x.T @ (x * (p * (1 - p))[:, None])
        beta = beta + np.linalg.pinv(a / np.outer(d, d), rcond=1e-10, hermitian=True) @ (x.T @ (y - p) / d) / d
    p = 1 / (1 + np.exp(-x @ beta))
    a = x.T @ (x * (p * (1 - p))[:, None])
    bread = np.linalg.pinv(a / np.outer(d, d), rcond=1e-10, hermitian=True) / np.outer(d, d)
    s = np.array([(x * (y - p)[:, None])[g == k].sum(axis=0) for k in np.unique(g)])
    k, n = len(s), len(y)
    sandwich = bread @ s.T @ s @ bread
    return beta, x @ beta, {"asymptotic": bread, "gee": sandwich, "robust": sandwich * (k / (k - 1)) * ((n - 1) / (n - x.shape[1]))}


SPECS = {"linear": "{outcome} ~ x + C(b) + z", "spline": "{outcome} ~ cr(x, knots=[-1, 0, 1]) + b + z", "product": "{outcome} ~ cr(z, df=4):z_any + z_any + x", "twice": "{outcome} ~ z + z_any + z:z_any"}
CONFIGS = [("y", "gee"), ("y", "robust"), ("y", "asymptotic"), ("u", "gee"), ("never", "gee")]


def test_joint_fits(spark, rows):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("joint", "joint fits")
    fits, ledger = jointfits.fit_grid(rows, CONFIGS, SPECS, "g")
    jobs = len(tracker.getJobIdsForGroup("joint"))
    spark.sparkContext.setJobGroup("other", "")
    # an iteration is one pass for all 20 fits, which adaptive execution runs as two jobs
    assert jobs <= 2 * max(f.iterations for f in fits.values()) + 36, jobs
    local = rows.toPandas()
    by = {(r["outcome"], r["method"], r["spec"]): r for r in ledger}
    assert len(by) == len(CONFIGS) * len(SPECS)
    for spec in ("linear", "spline", "product"):
        needed = ["x", "b", "z"] if spec != "product" else ["x", "z", "z_any"]
        for outcome in ("y", "u"):
            own = local.dropna(subset=[*needed, outcome, "g"])
            design = fits[outcome, "gee", spec].terms["design"]
            x = np.array([design.row(r) for r in own.to_dict("records")])
            beta, eta, covs = dense(x, own[outcome].to_numpy(float), own["g"].to_numpy())
            for kind, cov in covs.items():
                if (outcome, kind) not in CONFIGS:
                    continue
                f = fits[outcome, kind, spec]
                assert by[outcome, kind, spec]["status"] == "OK" and f.n == len(own) == by[outcome, kind, spec]["n_obs"] and f.clusters == own["g"].nunique()
                assert by[outcome, kind, spec]["n_events"] == own[outcome].sum()
                assert np.allclose(x @ f.beta, eta, atol=1e-6)
                # what a deficient design determines: variances of fitted values
                some = x[:40]
                assert np.allclose(np.einsum("ij,jk,ik->i", some, f.cov, some), np.einsum("ij,jk,ik->i", some, cov, some), rtol=1e-5, atol=1e-10)
                if spec == "linear":
                    assert np.allclose(f.beta, beta, atol=1e-7) and np.allclose(f.cov, cov, rtol=1e-5, atol=1e-12)
    assert all(by["never", "gee", s]["status"] == "FAIL" for s in SPECS)
    assert by["y", "robust", "twice"]["status"] == "SKIP_SINGULAR" and "rank 3/4" in by["y", "robust", "twice"]["reason"]
    table = {(r["spec"], r["row_type"]) for r in models.coefficients(spark, fits).where("outcome = 'y' AND model = 'gee'").collect()}
    assert {("linear", "term"), ("twice", "FAIL")} <= table


def test_hot_clusters(rows, monkeypatch):
    """A cluster that is dealt over tasks gives the same covariances."""
    skewed = rows.where("g IS NOT NULL").withColumn("g", F.when(F.col("g") < 20, 0).otherwise(F.col("g")))
    spec = {"a": "{outcome} ~ x + z"}
    plain, _ = jointfits.fit_grid(skewed, [("y", "gee")], spec, "g")
    monkeypatch.setattr(jointfits, "HOT_ROWS", 100)
    monkeypatch.setattr(jointfits, "MOST_HOT", 4)
    split, _ = jointfits.fit_grid(skewed, [("y", "gee")], spec, "g")
    a, b = plain["y", "gee", "a"], split["y", "gee", "a"]
    assert a.clusters == b.clusters == 41 and np.allclose(a.cov, b.cov, rtol=1e-9)
    design, hot = jointfits.dealt(skewed.select(F.col("g").cast("string").alias("cluster"), "x", "z"))
    assert hot == ["0"] and design.where("cluster = '0'").select("salt").distinct().count() > 30
    fits, ledger = jointfits.fit_grid(skewed.withColumn("apart", (F.col("y") * 2 - 1).cast("double")), [("y", "gee")], {"a": "{outcome} ~ apart"}, "g")
    assert ledger[0]["status"] == "FAIL" and ledger[0]["reason"] == "perfect separation"


def test_rows_of_a_fit(spark, rows):
    exact, by_name = (formulas.complete_rows(rows, "y ~ x_other + z", ["g"], w) for w in (False, True))
    local = rows.toPandas()
    assert rows.where(exact).count() == len(local.dropna(subset=["y", "x_other", "z", "g"]))
    assert rows.where(by_name).count() == len(local.dropna(subset=["y", "x_other", "x", "z", "g"]))  # `x` is part of `x_other`


def test_designs_that_cannot_be(spark, rows):
    fits, ledger = jointfits.fit_grid(rows, [("y", "gee")], {"outside": "{outcome} ~ cr(x, knots=[-99, 0])", "flat": "{outcome} ~ cr(never, df=4)", "good": "{outcome} ~ x"}, "g", left_out=())
    by = {r["spec"]: r for r in ledger}
    assert by["outside"]["status"] == by["flat"]["status"] == "FAIL" and "lie outside" in by["outside"]["reason"] and by["good"]["status"] == "OK"
    _, ledger = jointfits.fit_grid(rows, [("y", "gee")], {"good": "{outcome} ~ x"}, "g", left_out=("y",))
    assert [r["status"] for r in ledger] == ["SKIPPED"]
    _, ledger = jointfits.fit_grid(rows, [("y", "gee")], {"good": "{outcome} ~ x"}, "g", most=1)
    assert [r["status"] for r in ledger] == ["NO_CONVERGE"]
    with pytest.raises(ValueError):
        formulas.designs(spark.range(3000).withColumn("y", F.lit(1)).withColumn("s", F.col("id").cast("string")), ["y ~ s"], [F.lit(True)])


def test_quartile_terms(rows):
    few = rows.limit(60)
    assert models.quartile_term(few, "z").startswith("cr(z, df=4)") and models.quartiles(few, "z") is None
    assert models.quartile_term(rows, "z", "z_any").startswith("cr(z, knots=[") and models.quartile_term(rows, "z", "z_any").endswith(":z_any")
    assert models.quartile_knots(rows.withColumn("z", F.lit(2.0)), "z") is None  # equal quartiles give no knots
    assert models.quartile_term(rows.withColumn("z", F.lit(2.0)), "z") == "cr(z, df=4)"


def test_percentile_contrast(spark, rows):
    fits, _ = jointfits.fit_grid(rows, [("y", "robust")], {"a": "{outcome} ~ cr(z, knots=[1, 2]):z_any + z_any + x", "b": "{outcome} ~ x + z"}, "g")
    low, high = jointfits.anchors(rows, ["z", "x"], {"z": "z_any"})["z"]
    local = rows.toPandas()
    nonzero = local["z"][local["z"] != 0]
    assert np.allclose([low, high], np.percentile(nonzero, [10, 90]))
    f = fits["y", "robust", "b"]
    odds, a, b = jointfits.percentile_contrast(f, {"x": 0.0, "z": 0.0}, "z", low, high)
    assert math.isclose(odds, math.exp(f.beta[2] * (high - low))) and a < odds < b
    design = fits["y", "robust", "a"].terms["design"]
    one = design.row({"z": high, "z_any": 1, "x": 0.0}) - design.row({"z": low, "z_any": 1, "x": 0.0})
    assert math.isclose(jointfits.percentile_contrast(fits["y", "robust", "a"], {"x": 0.0, "z": 0.0, "z_any": 0}, "z", low, high, "z_any")[0], math.exp(one @ fits["y", "robust", "a"].beta))
    assert math.isnan(jointfits.percentile_contrast(f, {"x": 0.0, "z": 0.0}, "z", low, low)[0])


def test_stages_share_their_passes(spark, rows):
    """Each stage's fit is that of its own rows, from one grid; null risks and outcomes, repeated rows and stages without rows included."""
    odd = rows.unionByName(rows.where("g < 5")).withColumn("risk", F.when(F.col("x_other").isNotNull(), F.col("z") > 0.5)).withColumn("late", F.when(F.col("z") < 4, F.col("u")))
    stages = [("all", F.lit(True), "y"), ("risky", F.col("risk"), "y"), ("known", F.col("risk"), "late"), ("none", F.col("z") < 0, "y"), ("constant", F.col("y") == 1, "y")]
    fits, ledger = jointfits.fit_grid(jointfits.staged(odd, stages), [(name, "robust") for name, _, _ in stages], {"a": "{outcome} ~ x + z"}, "g")
    for (name, at_risk, outcome), told in zip(stages, ledger, strict=True):
        alone, (own,) = jointfits.fit_grid(odd.where(at_risk), [(outcome, "robust")], {"a": "{outcome} ~ x + z"}, "g")
        f, a = fits[name, "robust", "a"], alone[outcome, "robust", "a"]
        assert {k: v for k, v in told.items() if k != "outcome"} == {k: v for k, v in own.items() if k != "outcome"} and (f.n, f.clusters, f.iterations) == (a.n, a.clusters, a.iterations)
        assert np.allclose(f.beta, a.beta, rtol=1e-9, equal_nan=True) and np.allclose(f.cov, a.cov, rtol=1e-9, equal_nan=True)
    assert {r["outcome"]: r["status"] for r in ledger} == {"all": "OK", "risky": "OK", "known": "OK", "none": "FAIL", "constant": "FAIL"}


def test_rows_that_the_caller_keeps(rows):
    kept = rows.select("*").persist()
    try:
        jointfits.fit_grid(kept, [("y", "gee")], {"a": "{outcome} ~ x"}, "g")
        assert kept.is_cached and kept.storageLevel.useMemory
    finally:
        kept.unpersist()


def test_percentile_odds_read_their_rows_once(spark, sf_dir, monkeypatch):
    made, n, given = spark.sparkContext.accumulator(0), spark.read.parquet(f"{sf_dir}/orders.parquet").count(), statistics.t

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    def watched(s, d, name):
        df = given(s, d, name)
        return df.mapInArrow(counted, df.schema) if name == "orders" else df

    monkeypatch.setattr(statistics, "t", watched)
    assert statistics.h18c(spark, sf_dir).count() == 5 and made.value == n


def test_percentiles_at_other_shares(rows):
    values = rows.toPandas()["z"]
    assert np.allclose(jointfits.anchors(rows, ["z", "x"], shares=(0.1, 0.5, 0.9))["z"], np.percentile(values, [10, 50, 90]))


def test_passes_over_the_rows(spark, rows):
    """Rows go over the wire as they are, not as a design; nulls and levels are counted together, and the last pass gives X'WX and scores."""
    odd = rows.unionByName(rows.where("g < 5")).withColumns({"cluster": F.col("x") * 2 + F.col("z"), "salt": F.col("z") - F.col("x") * F.col("x")})
    specs = {"names": "{outcome} ~ cluster + salt", "spline": "{outcome} ~ cr(x, knots=[-1, 0, 1]) + C(b)"}
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("passes", "passes")
    fits, ledger = jointfits.fit_grid(odd, [("y", "robust"), ("never", "gee")], specs, "g")
    jobs = len(tracker.getJobIdsForGroup("passes"))
    spark.sparkContext.setJobGroup("other", "")
    turns = max(f.iterations for f in fits.values())
    assert jobs <= 2 * turns + 16, (jobs, turns)
    assert [r["status"] for r in ledger] == ["OK", "OK", "FAIL", "FAIL"]
    local = odd.toPandas().dropna(subset=["g"])
    own = local.dropna(subset=["cluster", "salt"])
    beta, _, covs = dense(np.column_stack([np.ones(len(own)), own["cluster"], own["salt"]]), own["y"].to_numpy(float), own["g"].to_numpy())
    f = fits["y", "robust", "names"]
    assert np.allclose(f.beta, beta, atol=1e-7) and np.allclose(f.cov, covs["robust"], rtol=1e-5, atol=1e-12)
    own = local.dropna(subset=["x", "b"])
    f = fits["y", "robust", "spline"]
    x = np.array([f.terms["design"].row(r) for r in own.to_dict("records")])
    _, eta, covs = dense(x, own["y"].to_numpy(float), own["g"].to_numpy())
    assert np.allclose(x @ f.beta, eta, atol=1e-6) and np.allclose(np.einsum("ij,jk,ik->i", x[:40], f.cov, x[:40]), np.einsum("ij,jk,ik->i", x[:40], covs["robust"], x[:40]), rtol=1e-5, atol=1e-10)


def test_levels_counted_by_the_caller(spark):
    df = spark.createDataFrame([(1, "a"), (0, None), (1, "b")], "y int, s string")
    names = formulas.coded_columns(df, ["y ~ s", "y ~ C(y) + s"])
    assert names == ["s", "y"]
    assert formulas.designs(df, ["y ~ s"], [F.lit(True)], {"s": 2, "y": 2})[0].names() == ["Intercept", "s[T.b]"]
    with pytest.raises(ValueError, match="too many levels"):
        formulas.designs(df, ["y ~ s"], [F.lit(True)], {"s": 5000, "y": 2})
    with pytest.raises(ValueError, match="too many levels"):
        jointfits.fit_grid(spark.range(3000).selectExpr("cast(id % 2 as int) AS y", "cast(id AS string) AS s", "id % 9 AS g"), [("y", "gee")], {"a": "{outcome} ~ s"}, "g")
