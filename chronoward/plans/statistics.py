"""Federated statistics and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import formulas, jointfits, models as K, pooling as P, summary as M
from .base import r, t


def _sites(s, d):
    """Customers with the region as their site."""
    n = t(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    g = t(s, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("site"))
    return t(s, d, "customer").join(n, "c_nationkey").join(g, "n_regionkey")


def _summary(s, d):
    return M.continuous_summary(_sites(s, d), ["c_acctbal"], ["site"])


def h01(s, d):
    return P.pooled_mean_sd(_summary(s, d), ["variable"]).select("variable", "n", r("mean", 3).alias("mean"), r("sd", 3).alias("sd"))


EDGES = [-1000.0, 0.0, 2500.0, 5000.0, 7500.0, 10000.0]


def h02(s, d):
    bins = M.histogram(_sites(s, d), "c_acctbal", EDGES, ["site"]).withColumn("variable", F.lit("c_acctbal"))
    return P.pooled_quantile(bins, ["variable"], 0.5).select("variable", r("quantile", 3).alias("quantile"))


def h02b(s, d):
    bins = M.histogram(_sites(s, d), "c_nationkey", [float(i) for i in range(0, 26)], ["site"]).withColumn("variable", F.lit("c_nationkey"))
    return P.pooled_quantile(bins, ["variable"], 0.25, integer=True)


def h03(s, d):
    per = M.categorical_summary(_sites(s, d), ["c_mktsegment"], ["site"])
    return P.pooled_counts(per, "site").select("variable", "category", "n", "total_n", r("pct").alias("pct"))


def h04(s, d):
    x = _sites(s, d).groupBy("site").agg(F.count_if(F.col("c_acctbal") < 0).alias("k"), F.count("*").alias("n"))
    low, high = P.wilson(F.col("k"), F.col("n"))
    return x.select("site", "k", "n", r(low, 6).alias("low"), r(high, 6).alias("high"))


def h05(s, d):
    rows = [(v["site"], v["n"], v["mean"], v["sd"]) for v in _summary(s, d).select("site", "n", "mean", "sd").collect()]  # a row a site
    out = [(site, n, m - q, m + q) for site, n, m, sd in rows for q in [P.student_quantile(0.975, n - 1) * sd / n**0.5]]
    return s.createDataFrame(out, "site string, n long, low double, high double").select("site", "n", r("low", 3).alias("low"), r("high", 3).alias("high"))


def _effects(s, d):
    return _summary(s, d).select("variable", "site", F.col("mean").alias("effect"), (F.col("sd") * F.col("sd") / F.col("n")).alias("variance"))


def h06(s, d):
    return P.random_effects(_effects(s, d), ["variable"], "effect", "variance").select("variable", "n_studies", *[r(c, 3).alias(c) for c in ("pooled", "se", "tau2", "Q", "I2", "low", "high")])


def h06b(s, d):
    """Q with its p-value; one row reaches the driver."""
    x = P.random_effects(_effects(s, d), ["variable"], "effect", "variance").select("variable", "n_studies", "Q").collect()
    found = s.createDataFrame([(v["variable"], float(v["Q"]), P.chi2_upper(v["Q"], v["n_studies"] - 1)) for v in x], "variable string, Q double, q_pval double")
    return found.select("variable", r("Q", 3).alias("Q"), r("q_pval", 6).alias("q_pval"))


def h07(s, d):
    per = [_sites(s, d).where(F.col("site") == site).groupBy("c_mktsegment").agg(F.count("*").alias("n")).withColumn("site", F.lit(site)) for site in ("ASIA", "EUROPE")]
    return per[0].unionByName(per[1])


def h08(s, d):
    sets = _sites(s, d).groupingSets([["site", "c_mktsegment"], ["c_mktsegment"]], "site", "c_mktsegment")
    return sets.agg(F.grouping("site").alias("g"), F.count("*").alias("n")).select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("site")).alias("site"), "c_mktsegment", "n")


def h09(s, d):
    e = t(s, d, "events").groupBy("event_type", F.hour("ts").alias("hour")).agg(F.count_if(F.col("value") > 50).alias("on"), F.count_if(F.col("value") > 1).alias("n"))
    return e.select("event_type", "hour", r(100.0 * F.try_divide(F.col("on"), F.col("n"))).alias("pct"))


def h10(s, d):
    sites = _sites(s, d).withColumn("debt", F.when(F.col("c_acctbal") < 0, -F.col("c_acctbal")))
    cont = M.continuous_summary(sites, ["c_acctbal", "debt"], ["site"], by_rank=True)  # quantiles as low + (high - low) * share, to the last bit
    return P.table_one(cont, M.categorical_summary(sites, ["c_mktsegment"], ["site"]), "site", ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"])


def _model_rows(s, d):
    o = t(s, d, "orders").withColumn("y", (F.col("o_totalprice") > 150000).cast("int"))
    c = t(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_mktsegment")
    return o.join(c, "o_custkey").withColumn("bal", F.col("c_acctbal") / 1000).withColumn("urgent", (F.col("o_orderpriority") == "1-URGENT").cast("int"))


def _terms():
    return {"bal": F.col("bal"), "urgent": F.col("urgent")}


KINDS = ("asymptotic", "robust", "gee")


def _fits(s, d):
    return {("large", kind, "linear"): f for kind, f in K.logits(_model_rows(s, d), "y", _terms(), "o_custkey", KINDS).items()}


def h11(s, d):
    return K.coefficients(s, _fits(s, d)).select("outcome", "model", "spec", "predictor", *[r(c, 6).alias(c) for c in ("log_or", "se", "odds_ratio", "low", "high")], "n", "status", "row_type")


def h11b(s, d):
    """Outcomes with their kinds of covariance under several sets of terms, with failed fits in the same table."""
    rows = _model_rows(s, d).withColumns({"filled": (F.col("o_orderstatus") == "F").cast("int"), "never": F.lit(0)})
    rows = rows.select("o_custkey", "bal", "urgent", "y", "filled", "never").persist()  # read once for the knots and all fits
    try:
        knots = K.quartile_knots(rows, "bal")
        specs = {"linear": _terms(), "squared": {**_terms(), "bal2": F.col("bal") * F.col("bal")}, "spline": {**{f"s{i}": e for i, e in enumerate(K.spline(F.col("bal"), knots))}, "urgent": F.col("urgent")}}
        fits = K.grid(rows, {"y": KINDS, "filled": ("gee",), "never": ("gee",)}, specs, "o_custkey")
    finally:
        rows.unpersist()
    return K.coefficients(s, fits).select("outcome", "model", "spec", "predictor", *[r(c, 6).alias(c) for c in ("log_or", "se")], "n", "status", "row_type")


def h12(s, d):
    rows = _model_rows(s, d)
    fits = {("large", "asymptotic", "collinear"): K.logit(rows, "y", {**_terms(), "again": F.col("bal") * 2}), ("large", "asymptotic", "constant"): K.logit(rows.where("y = 1"), "y", _terms()), ("large", "asymptotic", "linear"): K.logit(rows, "y", _terms())}
    return s.createDataFrame([(*k, f.status, f.n, f.iterations) for k, f in fits.items()], "outcome string, model string, spec string, status string, n long, iterations int")


def h13(s, d):
    basis = K.spline(F.col("c_acctbal") / 1000, [0.0, 3.0, 6.0, 9.0])
    return t(s, d, "customer").select("c_custkey", *[r(b, 6).alias(f"s{i}") for i, b in enumerate(basis)])


def h13b(s, d):
    """Spline terms with the quartiles of the values that are not 0 as knots."""
    c = t(s, d, "customer").withColumn("x", F.greatest(F.lit(0.0), F.col("c_acctbal") / 1000))
    return c.select("c_custkey", *[r(b, 5).alias(f"s{i}") for i, b in enumerate(K.spline(F.col("x"), K.quartile_knots(c, "x", 10)))])


def h14(s, d):
    f = K.logit(_model_rows(s, d), "y", _terms(), "o_custkey", "robust")
    return s.createDataFrame([("bal 1 to 9", *K.contrast(f, [1, 1, 0], [1, 9, 0])), ("urgent", *K.contrast(f, [1, 0, 0], [1, 0, 1]))], "contrast string, odds_ratio double, low double, high double").select("contrast", *[r(c, 6).alias(c) for c in ("odds_ratio", "low", "high")])


def h15(s, d):
    return K.coefficients(s, {**_fits(s, d), ("large", "asymptotic", "failed"): K.logit(_model_rows(s, d).where("y = 0"), "y", _terms())}).select("outcome", "model", "spec", "predictor", "row_type", "status")


def h16(s, d):
    return K.wide_table(K.coefficients(s, _fits(s, d)), ["asymptotic", "robust", "gee"])


def h17(s, d):
    rows = _model_rows(s, d)
    f = K.logit(rows, "y", _terms(), "o_custkey", "robust")
    low, high = rows.agg(F.expr("percentile(bal, 0.025)"), F.expr("percentile(bal, 0.975)")).first()
    return K.marginal_grid(s, f, {"urgent": 0.0}, "bal", low, high).select(*[r(c, 6).alias(c) for c in ("x", "p", "low", "high")])


def _stages(s, d):
    """Eligible, done, freed: each among those that got so far, and freed for good among the done and the freed."""
    rows = _model_rows(s, d).withColumns({"done": (F.col("o_totalprice") > 200000).cast("int"), "freed": (F.col("o_totalprice") > 250000).cast("int"), "good": (F.col("o_totalprice") > 300000).cast("int")})
    is_ = lambda c: F.col(c) == 1
    return rows, [("stage0", F.lit(True), "y"), ("stage1", is_("y"), "done"), ("stage2", is_("done"), "freed"), ("stage2b", is_("done"), "good"), ("stage3", is_("freed"), "good")]


def h18(s, d):
    rows, stages = _stages(s, d)
    fits = K.cascade(rows, stages, _terms(), "o_custkey")
    found = s.createDataFrame([(k, f.n, f.clusters, f.status, *map(float, f.beta)) for k, f in fits.items()], "stage string, n long, clusters int, status string, intercept double, bal double, urgent double")
    return found.select("stage", "n", "clusters", "status", *[r(c, 6).alias(c) for c in ("intercept", "bal", "urgent")])


def h18b(s, d):
    rows, stages = _stages(s, d)
    return K.cohort_summary(rows, stages, "o_custkey").select("stage", "outcome", "n", "clusters", "events", r("share", 6).alias("share"))


def h19(s, d):
    return K.welch(t(s, d, "events"), "value", (F.hour("ts") >= 7) & (F.hour("ts") < 19)).select(*[r(c, 6).alias(c) for c in ("difference", "t", "dof", "low", "high")])


def h19b(s, d):
    return K.welch(t(s, d, "events"), "value", (F.hour("ts") >= 7) & (F.hour("ts") < 19)).select(r("difference", 6).alias("difference"), r("t", 6).alias("t"), r("dof").alias("dof"))


def h20(s, d):
    locked = K.complete(_model_rows(s, d), "y", ["bal", "urgent"])
    specs = {"linear": _terms(), "squared": {**_terms(), "bal2": F.col("bal") * F.col("bal")}, "spline": {f"s{i}": e for i, e in enumerate(K.spline(F.col("bal"), [0.0, 3.0, 6.0, 9.0]))}}
    return K.coefficients(s, {("large", "asymptotic", k): K.logit(locked, "y", v) for k, v in specs.items()}).select("spec", "predictor", r("log_or", 6).alias("log_or"), "n", "status")


def h22(s, d):
    x = _model_rows(s, d).withColumn("m", F.when(F.col("o_orderkey") % 3 > 0, F.col("bal"))).withColumn("m_other", F.when(F.col("o_orderkey") % 2 > 0, F.lit(1)))
    return K.complete(x, "y", ["m"]).select("o_orderkey")


#: Formulas in the shape of the clinical grid: differences, daytime rates, splines of both, shift-change levels.
ADJUST = "age + nth + C(c_mktsegment) + C(o_orderpriority) + weight"
DIFS, DAYS = ("a_dif", "b_dif", "c_dif"), ("a_day", "b_day", "c_day")
INNER = {"a_dif": [-1.0, 0.0, 1.0], "b_dif": [-3.0, 0.0, 3.0], "c_dif": [-1.0, 0.0, 1.0], "a_day": [0.3, 0.8, 1.3], "b_day": [2.0, 5.0, 8.0], "c_day": [1.0, 2.0, 3.0]}


def _formulas():
    plus = " + ".join
    spline = lambda names: plus(f"cr({v}, knots={INNER[v]})" for v in names)
    base, physio = "{outcome} ~ " + plus(DIFS) + " + " + ADJUST, " + level_am + level_pm"
    rcs_dif, rcs_full = "{outcome} ~ " + spline(DIFS) + " + " + plus(DAYS) + " + " + ADJUST, "{outcome} ~ " + spline(DIFS + DAYS) + " + " + ADJUST
    day = base + " + " + plus(DAYS)
    return {"baseline": base, "daydose": day, "sofa": day + " + score", "daydose_physio": day + physio, "daydose_rcs_diff": rcs_dif, "daydose_rcs_full": rcs_full, "daydose_physio_rcs_diff": rcs_dif + physio, "daydose_physio_rcs_full": rcs_full + physio}


CONFIGS = [(o, kind) for o in ("y1", "y2") for kind in ("gee", "robust", "asymptotic")] + [(f"y{i}", "gee") for i in range(3, 8)]


def _grid_rows(s, d):
    """Orders with seven outcomes and the covariates of the formulas; some rows lack a level or a score."""
    day, key, price = F.dayofmonth("o_orderdate"), F.col("o_orderkey"), F.col("o_totalprice")
    return _model_rows(s, d).select(
        "o_custkey", "c_mktsegment", "o_orderpriority",
        *[e.cast("int").alias(f"y{i + 1}") for i, e in enumerate((price > 150000, F.col("o_orderstatus") == "F", price > 100000, price > 200000, F.col("o_orderstatus") == "O", F.floor(price) % 3 == 0, F.month("o_orderdate") > 6))],
        ((day - 15.5) / 10).alias("a_dif"), (F.col("bal") - 4.5).alias("b_dif"), ((key % 101 - 50) / 25).alias("c_dif"),
        (F.greatest(F.lit(0.0), day - 12.0) / 10).alias("a_day"), (F.col("o_custkey") % 11).cast("double").alias("b_day"), F.greatest(F.lit(0.0), F.col("bal") - 5).alias("c_day"),
        (key % 61 + 18).alias("age"), (F.year("o_orderdate") - 1990).alias("nth"), (key % 37).cast("double").alias("weight"),
        F.when(key % 10 > 0, F.element_at(F.array(*map(F.lit, ("normal", "low", "high"))), (key % 3 + 1).cast("int"))).alias("level_am"),
        F.when(key % 4 == 0, "high").otherwise("normal").alias("level_pm"), F.when(key % 7 > 0, (key % 24).cast("double")).alias("score"),
    )


def h11c(s, d):
    """Every outcome and kind under the eight formulas: 88 fits from one pass an iteration."""
    fits, _ = jointfits.fit_grid(_grid_rows(s, d), CONFIGS, _formulas(), "o_custkey")
    rows = [(o, k, spec, f.n, f.clusters, f.status, n, float(f.beta[i]), float(f.se()[i])) for (o, k, spec), f in fits.items() for i, n in enumerate(f.names)]
    return s.createDataFrame(rows, "outcome string, model string, spec string, n long, clusters long, status string, predictor string, log_or double, se double").select("outcome", "model", "spec", "predictor", r("log_or", 5).alias("log_or"), r("se", 5).alias("se"), "n", "clusters", "status")


def h12b(s, d):
    """The ledger of the linear formulas of the grid, with a constant outcome and a formula that repeats a column."""
    rows, specs = _grid_rows(s, d).withColumns({"never": F.lit(0), "again": F.col("a_dif") * 2}), _formulas()
    specs = {k: specs[k] for k in ("baseline", "sofa", "daydose_physio")} | {"twice": specs["baseline"] + " + again"}
    _, ledger = jointfits.fit_grid(rows, [("y1", "gee"), ("y2", "robust"), ("never", "gee"), ("y3", "gee")], specs, "o_custkey", left_out=("y3",))
    return s.createDataFrame([tuple(x.values()) for x in ledger], "outcome string, method string, spec string, status string, n_obs long, n_events long, n_clusters long, reason string").select("outcome", "method", "spec", "status", "n_obs", "n_events")


def _design(df, formula):
    (design,) = formulas.designs(df, [formula], [formulas.complete_rows(df, formula)])
    return design


def h13c(s, d):
    """Natural cubic regression spline with its outer knots at the ends of the data."""
    c = t(s, d, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("x"), F.lit(1).alias("y"))
    return c.select("c_custkey", *[r(e, 5).alias(f"s{i}") for i, e in enumerate(_design(c, "y ~ cr(x, knots=[0, 3, 6])").expressions()[1:])])


def h13d(s, d):
    """The term of a cascade: knots at quartiles of the values that are not 0, ends of all rows, times an indicator."""
    c = t(s, d, "customer").select("c_custkey", F.greatest(F.lit(0.0), F.col("c_acctbal") / 1000).alias("x"), F.lit(1).alias("y")).withColumn("any", (F.col("x") > 0).cast("int"))
    return c.select("c_custkey", *[r(e, 5).alias(f"s{i}") for i, e in enumerate(_design(c, "y ~ " + K.quartile_term(c, "x", "any", 10)).expressions()[1:])])


def h11d(s, d):
    """Columns of a compiled formula: intercept, levels against the first, an interaction."""
    rows = _grid_rows(s, d)
    names = {"Intercept": "one", "C(o_orderpriority)[T.2-HIGH]": "high", "level_am[T.low]:a_dif": "low_dif", "level_am[T.normal]:a_dif": "normal_dif", "age": "age"}
    design = _design(rows, "y1 ~ C(o_orderpriority) + level_am:a_dif + age")
    picked = [e.alias(names[n]) for n, e in zip(design.names(), design.expressions()) if n in names]
    whole = rows.where(formulas.complete_rows(rows, "y1 ~ C(o_orderpriority) + level_am:a_dif + age")).select(*picked)
    return whole.groupBy("one", "high").agg(F.count("*").alias("n"), *[r(F.sum(c), 3).alias(c) for c in ("low_dif", "normal_dif", "age")])


def h22b(s, d):
    """Complete cases by names that the formula's text contains: `m` is part of `m_rate`, so its nulls count too."""
    x = _model_rows(s, d).select("o_orderkey", "y", F.when(F.col("o_orderkey") % 3 > 0, F.col("bal")).alias("m_rate"), F.when(F.col("o_orderkey") % 2 > 0, F.lit(1)).alias("m"), F.when(F.col("o_orderkey") % 5 > 0, F.lit(1)).alias("n_other"))
    return x.where(formulas.complete_rows(x, "y ~ m_rate", by_substring=True)).select("o_orderkey")


def h18c(s, d):
    """Odds ratios from the 10th to the 90th percentile of the whole cohort, at its medians and modes, stage by stage."""
    rows, stages = _stages(s, d)
    names = [name for name, _, _ in stages]
    rows = jointfits.staged(rows, stages).select("o_custkey", "bal", "urgent", *names).persist()  # read once for the percentiles and all fits
    try:
        found = jointfits.anchors(rows, ["bal", "urgent"], shares=(0.1, 0.5, 0.9))
        low, middle, high = found["bal"]
        reference = {"urgent": found.get("urgent", (None,) * 3)[1], "bal": middle}
        fits, _ = jointfits.fit_grid(rows, [(name, "robust") for name in names], {"linear": "{outcome} ~ bal + urgent"}, "o_custkey")
    finally:
        rows.unpersist()
    out = [(name, *jointfits.percentile_contrast(fits[name, "robust", "linear"], reference, "bal", low, high)) for name in names]
    return s.createDataFrame(out, "stage string, odds_ratio double, low double, high double").select("stage", *[r(c, 6).alias(c) for c in ("odds_ratio", "low", "high")])


SITE = "(SELECT c.*, r_name AS site FROM customer c JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"
EFF = f"SELECT 'c_acctbal' AS variable, site, avg(c_acctbal) AS y, var_samp(c_acctbal) / count(c_acctbal) AS v FROM {SITE} GROUP BY 2"
DL = f"""WITH e AS ({EFF}), f AS (SELECT variable, count(*) AS k, sum(1/v) AS sw, sum(1/(v*v)) AS sw2, sum(y/v) AS swy, sum(y*y/v) AS swy2 FROM e GROUP BY 1),
g AS (SELECT *, greatest(0, swy2 - swy*swy/sw) AS q, sw - sw2/sw AS c FROM f), h AS (SELECT *, greatest(0, (q - (k - 1)) / c) AS tau2 FROM g),
p AS (SELECT h.variable, k, q, h.tau2, sum(1/(v + h.tau2)) AS w, sum(y/(v + h.tau2)) AS wy FROM e JOIN h USING (variable) GROUP BY 1, 2, 3, 4)"""
SITES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
TABLE_ONE = f"""WITH x AS (SELECT site, c_mktsegment, c_acctbal, CASE WHEN c_acctbal < 0 THEN -c_acctbal END AS debt FROM {SITE}),
l AS (SELECT site, 'c_acctbal' AS variable, c_acctbal AS v FROM x UNION ALL SELECT site, 'debt', debt FROM x),
k AS (SELECT site, variable, avg(v) AS m, stddev_samp(v) AS s, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS b, quantile_cont(v, 0.75) AS c FROM l GROUP BY 1, 2),
n AS (SELECT site, c_mktsegment, count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY site) AS p FROM x GROUP BY 1, 2),
f AS (SELECT site, variable, 'mean (SD)' AS statistic, printf('%.1f (%.1f)', m, s) AS t FROM k UNION ALL SELECT site, variable, 'median [Q1, Q3]', printf('%.1f [%.1f, %.1f]', b, a, c) FROM k
    UNION ALL SELECT site, 'c_mktsegment', c_mktsegment || ', n (%)', printf('%d (%.1f)', n, p) FROM n)
SELECT variable, statistic, {', '.join(f"max(t) FILTER (WHERE site = '{x}') AS \"{x}\"" for x in SITES)} FROM f GROUP BY 1, 2"""
STAGE = lambda name, at_risk, outcome, cut: f"SELECT '{name}' AS stage, '{outcome}' AS outcome, count(*) AS n, count(DISTINCT o_custkey) AS clusters, count(*) FILTER (WHERE o_totalprice > {cut}) AS events, round(count(*) FILTER (WHERE o_totalprice > {cut}) / count(*), 6) AS share FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > {at_risk}"
STAGES = " UNION ALL ".join(STAGE(*x) for x in (("stage0", -1, "y", 150000), ("stage1", 150000, "done", 200000), ("stage2", 200000, "freed", 250000), ("stage2b", 200000, "good", 300000), ("stage3", 250000, "good", 300000)))
QUARTILES = """WITH x AS (SELECT c_custkey, greatest(0.0::DOUBLE, c_acctbal / 1000) AS x FROM customer), q AS (SELECT min(x) AS k0, round(quantile_cont(x, 0.25), 6) AS k1, round(quantile_cont(x, 0.5), 6) AS k2, round(quantile_cont(x, 0.75), 6) AS k3, max(x) AS k4 FROM x WHERE x <> 0),
y AS (SELECT x.*, q.*, pow(k4 - k0, 2) AS sc, pow(greatest(x - k0, 0), 3) AS a0, pow(greatest(x - k1, 0), 3) AS a1, pow(greatest(x - k2, 0), 3) AS a2, pow(greatest(x - k3, 0), 3) AS a3, pow(greatest(x - k4, 0), 3) AS a4 FROM x, q)
SELECT c_custkey, round(x, 5) AS s0, round((a0 - a3 * ((k4 - k0) / (k4 - k3)) + a4 * ((k3 - k0) / (k4 - k3))) / sc, 5) AS s1, round((a1 - a3 * ((k4 - k1) / (k4 - k3)) + a4 * ((k3 - k1) / (k4 - k3))) / sc, 5) AS s2, round((a2 - a3 * ((k4 - k2) / (k4 - k3)) + a4 * ((k3 - k2) / (k4 - k3))) / sc, 5) AS s3 FROM y"""
WELCH = """WITH g AS (SELECT hour(ts) >= 7 AND hour(ts) < 19 AS d, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1), x AS (SELECT a.m - b.m AS diff, a.v / a.n AS va, b.v / b.n AS vb, a.n AS na, b.n AS nb FROM g a, g b WHERE a.d AND NOT b.d)
SELECT round(diff, 6) AS difference, round(diff / sqrt(va + vb), 6) AS t, round(pow(va + vb, 2) / (va * va / (na - 1) + vb * vb / (nb - 1)), 4) AS dof FROM x"""
ORDERS = "(SELECT o_custkey AS c, o_totalprice, CAST(o_totalprice > 150000 AS DOUBLE) AS y, c_acctbal / 1000 AS x1, CAST(o_orderpriority = '1-URGENT' AS DOUBLE) AS x2 FROM orders JOIN customer ON c_custkey = o_custkey)"
STEPS = 10


def _newton(rows: str) -> str:
    """CTEs `fitted` (g, n, clusters, b0..b2, i00..i22 of the inverse, m00..m22 of the sandwich) of a logit with two terms for each g of rows (g, c, y, x1, x2)."""
    out = [f"data AS MATERIALIZED ({rows})", "b_0 AS (SELECT DISTINCT g, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM data)"]
    for i in range(STEPS + 1):
        out.append(f"""p_{i} AS (SELECT g, c, x1, x2, b0, b1, b2, p * (1 - p) AS w, y - p AS r FROM (
    SELECT *, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) AS p FROM data JOIN b_{i} USING (g)))""")
        out.append(f"""s_{i} AS (SELECT g, b0, b1, b2, count(*) AS n, count(DISTINCT c) AS clusters, sum(w) AS a00, sum(w * x1) AS a01, sum(w * x2) AS a02, sum(w * x1 * x1) AS a11,
    sum(w * x1 * x2) AS a12, sum(w * x2 * x2) AS a22, sum(r) AS r0, sum(r * x1) AS r1, sum(r * x2) AS r2 FROM p_{i} GROUP BY ALL)""")
        out.append(f"""v_{i} AS (SELECT *, (a11 * a22 - a12 * a12) / det AS i00, (a02 * a12 - a01 * a22) / det AS i01, (a01 * a12 - a02 * a11) / det AS i02,
    (a00 * a22 - a02 * a02) / det AS i11, (a01 * a02 - a00 * a12) / det AS i12, (a00 * a11 - a01 * a01) / det AS i22
    FROM (SELECT *, a00 * (a11 * a22 - a12 * a12) - a01 * (a01 * a22 - a12 * a02) + a02 * (a01 * a12 - a11 * a02) AS det FROM s_{i}))""")
        out.append(f"b_{i + 1} AS (SELECT g, b0 + i00 * r0 + i01 * r1 + i02 * r2 AS b0, b1 + i01 * r0 + i11 * r1 + i12 * r2 AS b1, b2 + i02 * r0 + i12 * r1 + i22 * r2 AS b2 FROM v_{i})")
    meat = ", ".join(f"sum(u{a} * u{b}) AS q{a}{b}" for a in range(3) for b in range(a, 3))
    entry = lambda i, j: f"i{min(i, j)}{max(i, j)}"
    product = lambda i, j: " + ".join(f"{entry(i, a)} * q{min(a, b)}{max(a, b)} * {entry(b, j)}" for a in range(3) for b in range(3))
    sandwich = ", ".join(f"{product(i, j)} AS m{i}{j}" for i in range(3) for j in range(i, 3))
    out.append(f"u AS (SELECT g, c, sum(r) AS u0, sum(r * x1) AS u1, sum(r * x2) AS u2 FROM p_{STEPS} GROUP BY ALL), q AS (SELECT g, {meat} FROM u GROUP BY ALL)")
    out.append(f"fitted AS (SELECT *, {sandwich} FROM v_{STEPS} JOIN q USING (g))")
    return "WITH " + ",\n".join(out)


Z = "1.959963984540054::DOUBLE"
KIND = "clusters / (clusters - 1.0::DOUBLE) * (n - 1.0::DOUBLE) / (n - 3)"
LOGIT = _newton(f"SELECT 'large' AS g, * FROM {ORDERS}") + f""",
k AS (SELECT *, v.* FROM fitted, (VALUES ('asymptotic'), ('robust'), ('gee')) v(model)),
l AS (
    SELECT model, n, 'Intercept' AS predictor, b0 AS b, CASE model WHEN 'asymptotic' THEN i00 WHEN 'gee' THEN m00 ELSE m00 * {KIND} END AS v, 'intercept' AS row_type FROM k
    UNION ALL SELECT model, n, 'bal', b1, CASE model WHEN 'asymptotic' THEN i11 WHEN 'gee' THEN m11 ELSE m11 * {KIND} END, 'term' FROM k
    UNION ALL SELECT model, n, 'urgent', b2, CASE model WHEN 'asymptotic' THEN i22 WHEN 'gee' THEN m22 ELSE m22 * {KIND} END, 'term' FROM k)"""
THREE_WAYS = LOGIT + f"""
SELECT 'large' AS outcome, model, 'linear' AS spec, predictor, round(b, 6) AS log_or, round(sqrt(v), 6) AS se, round(exp(b), 6) AS odds_ratio,
       round(exp(b - {Z} * sqrt(v)), 6) AS low, round(exp(b + {Z} * sqrt(v)), 6) AS high, n, 'converged' AS status, row_type FROM l"""
WIDE = LOGIT + f""",
t AS (SELECT predictor, model, printf('%.2f (%.2f, %.2f)', exp(b), exp(b - {Z} * sqrt(v)), exp(b + {Z} * sqrt(v))) || CASE WHEN abs(b / sqrt(v)) > {Z} THEN '*' ELSE '' END AS t FROM l WHERE row_type = 'term')
SELECT 'large' AS outcome, 'linear' AS spec, predictor, max(t) FILTER (WHERE model = 'asymptotic') AS asymptotic, max(t) FILTER (WHERE model = 'robust') AS robust, max(t) FILTER (WHERE model = 'gee') AS gee FROM t GROUP BY predictor"""
CONTRASTS = LOGIT + f"""
SELECT CASE predictor WHEN 'bal' THEN 'bal 1 to 9' ELSE 'urgent' END AS contrast, round(exp(f * b), 6) AS odds_ratio, round(exp(f * b - {Z} * f * sqrt(v)), 6) AS low, round(exp(f * b + {Z} * f * sqrt(v)), 6) AS high
FROM (SELECT *, CASE predictor WHEN 'bal' THEN 8.0::DOUBLE ELSE 1.0::DOUBLE END AS f FROM l WHERE model = 'robust' AND row_type = 'term')"""
MARGINAL = LOGIT + f""",
e AS (SELECT quantile_cont(x1, 0.025) AS a, quantile_cont(x1, 0.975) AS b FROM data),
x AS (SELECT a + i * (b - a) / 49 AS x FROM e, range(50) t(i)),
m AS (SELECT x, b0 + b1 * x AS eta, sqrt((m00 + 2 * m01 * x + m11 * x * x) * {KIND}) AS se FROM x, fitted)
SELECT round(x, 6) AS x, round(1 / (1 + exp(-eta)), 6) AS p, round(1 / (1 + exp(-(eta - {Z} * se))), 6) AS low, round(1 / (1 + exp(-(eta + {Z} * se))), 6) AS high FROM m"""
STAGE_CUTS = (("stage0", -1, 150000), ("stage1", 150000, 200000), ("stage2", 200000, 250000), ("stage2b", 200000, 300000), ("stage3", 250000, 300000))
STAGED = _newton(" UNION ALL ".join(f"SELECT '{g}' AS g, c, CAST(o_totalprice > {cut} AS DOUBLE) AS y, x1, x2 FROM {ORDERS} WHERE o_totalprice > {least}" for g, least, cut in STAGE_CUTS))
CASCADE = STAGED + """
SELECT g AS stage, n, CAST(clusters AS INTEGER) AS clusters, 'converged' AS status, round(b0, 6) AS intercept, round(b1, 6) AS bal, round(b2, 6) AS urgent FROM fitted"""
CASCADE_ODDS = STAGED + f""",
e AS (SELECT quantile_cont(x1, 0.9) - quantile_cont(x1, 0.1) AS w FROM data WHERE g = 'stage0')
SELECT g AS stage, round(exp(w * b1), 6) AS odds_ratio, round(exp(w * b1 - {Z} * w * sqrt(m11 * {KIND})), 6) AS low, round(exp(w * b1 + {Z} * w * sqrt(m11 * {KIND})), 6) AS high FROM fitted, e"""


def _natural(rows: str, knots: str, factor: str = "1") -> str:
    """Natural spline of rows (c_custkey, x, ...) with three inner knots k1 to k3 from a query, by a tridiagonal solve for each function."""
    is_ = lambda m: f"CAST(m = {m} AS DOUBLE)"
    return f"""WITH x AS ({rows}), k AS (SELECT (SELECT min(x) FROM x) AS k0, k1, k2, k3, (SELECT max(x) FROM x) AS k4 FROM ({knots})),
h AS (SELECT *, k1 - k0 AS h0, k2 - k1 AS h1, k3 - k2 AS h2, k4 - k3 AS h3 FROM k),
d AS (SELECT *, {is_(0)} / h0 - {is_(1)} * (1 / h0 + 1 / h1) + {is_(2)} / h1 AS d1, {is_(1)} / h1 - {is_(2)} * (1 / h1 + 1 / h2) + {is_(3)} / h2 AS d2,
    {is_(2)} / h2 - {is_(3)} * (1 / h2 + 1 / h3) + {is_(4)} / h3 AS d3, (h0 + h1) / 3 AS a1, (h1 + h2) / 3 AS a2, (h2 + h3) / 3 AS a3, h1 / 6 AS u1, h2 / 6 AS u2 FROM h, range(5) t(m)),
e AS (SELECT *, a2 - u1 * u1 / a1 AS w2 FROM d), f AS (SELECT *, a3 - u2 * u2 / w2 AS w3, (d2 - u1 * d1 / a1) / w2 AS e2 FROM e),
g AS (SELECT *, (d3 - u2 * e2) / w3 AS f3 FROM f), i AS (SELECT *, e2 - u2 / w2 * f3 AS f2 FROM g), j AS (SELECT *, (d1 - u1 * f2) / a1 AS f1 FROM i),
l AS (SELECT m, [k0, k1, k2, k3] AS ks, [h0, h1, h2, h3] AS hs, [0, f1, f2, f3, 0] AS fs FROM j),
p AS (SELECT x.*, m, ks, hs, fs, CAST(x > ks[2] AS INTEGER) + CAST(x > ks[3] AS INTEGER) + CAST(x > ks[4] AS INTEGER) AS j FROM x, l),
q AS (SELECT *, x - ks[j + 1] AS s, hs[j + 1] AS h FROM p),
v AS (SELECT c_custkey, m, {factor} * (CAST(m = j AS DOUBLE) * (1 - s / h) + CAST(m = j + 1 AS DOUBLE) * s / h + fs[j + 1] * (pow(h - s, 3) / (6 * h) - h * (h - s) / 6) + fs[j + 2] * (pow(s, 3) / (6 * h) - h * s / 6)) AS v FROM q)
SELECT c_custkey, {', '.join(f'round(max(v) FILTER (WHERE m = {m}), 5) + 0.0::DOUBLE AS s{m}' for m in range(5))} FROM v GROUP BY 1"""


SPLINE_TERMS = _natural("SELECT c_custkey, c_acctbal / 1000 AS x FROM customer", "SELECT 0.0::DOUBLE AS k1, 3.0::DOUBLE AS k2, 6.0::DOUBLE AS k3")
CASCADE_TERMS = _natural(
    "SELECT c_custkey, greatest(0.0::DOUBLE, c_acctbal / 1000) AS x FROM customer",
    "SELECT round(quantile_cont(x, 0.25), 6) AS k1, round(quantile_cont(x, 0.5), 6) AS k2, round(quantile_cont(x, 0.75), 6) AS k3 FROM x WHERE x <> 0",
    "CAST(x > 0 AS DOUBLE)",
)
GRID_ROWS = "(SELECT *, CAST(o_totalprice > 150000 AS INTEGER) AS y1, CAST(o_orderstatus = 'F' AS INTEGER) AS y2 FROM orders JOIN customer ON c_custkey = o_custkey)"
LEDGER = f"""WITH s AS (SELECT * FROM (VALUES ('baseline', 1, 1, 'OK'), ('sofa', 7, 1, 'OK'), ('daydose_physio', 1, 10, 'OK'), ('twice', 1, 1, 'SKIP_SINGULAR')) v(spec, a, b, status)),
o AS (SELECT * FROM (VALUES ('y1', 'gee'), ('y2', 'robust'), ('never', 'gee')) v(outcome, method))
SELECT outcome, method, spec, CASE WHEN outcome = 'never' THEN 'FAIL' ELSE status END AS status, count(*) AS n_obs,
       CAST(sum(CASE outcome WHEN 'y1' THEN y1 WHEN 'y2' THEN y2 ELSE 0 END) AS BIGINT) AS n_events
FROM o, s JOIN {GRID_ROWS} x ON (a = 1 OR o_orderkey % a > 0) AND (b = 1 OR o_orderkey % b > 0) GROUP BY 1, 2, 3, 4
UNION ALL SELECT 'y3', 'gee', spec, 'SKIPPED', 0, 0 FROM s"""
DESIGN = f"""SELECT 1.0::DOUBLE AS one, CAST(o_orderpriority = '2-HIGH' AS DOUBLE) AS high, count(*) AS n, round(sum(CASE WHEN o_orderkey % 3 = 1 THEN a ELSE 0 END), 3) AS low_dif,
       round(sum(CASE WHEN o_orderkey % 3 = 0 THEN a ELSE 0 END), 3) AS normal_dif, CAST(sum(o_orderkey % 61 + 18) AS DOUBLE) AS age
FROM (SELECT *, (day(o_orderdate) - 15.5::DOUBLE) / 10 AS a FROM {GRID_ROWS}) WHERE o_orderkey % 10 > 0 GROUP BY 2"""
CASES = {
    "h01_pooled_mean_sd": (h01, "SELECT 'c_acctbal' AS variable, count(c_acctbal) AS n, round(avg(c_acctbal), 3) AS mean, round(stddev_samp(c_acctbal), 3) AS sd FROM customer JOIN nation ON n_nationkey = c_nationkey"),
    "h02_pooled_quantile": (h02, "WITH b AS (SELECT * FROM (VALUES (-1000.0::DOUBLE, 0.0::DOUBLE), (0.0::DOUBLE, 2500.0::DOUBLE), (2500.0::DOUBLE, 5000.0::DOUBLE), (5000.0::DOUBLE, 7500.0::DOUBLE), (7500.0::DOUBLE, 10000.0::DOUBLE)) v(l, r)), c AS (SELECT l, r, count(*) AS c FROM b JOIN customer ON c_acctbal >= l AND c_acctbal < r GROUP BY 1, 2), d AS (SELECT *, sum(c) OVER (ORDER BY l) AS cum, 0.5::DOUBLE * sum(c) OVER () AS target FROM c) SELECT 'c_acctbal' AS variable, round(l + (target - (cum - c)) / c * (r - l), 3) AS quantile FROM d WHERE cum >= target ORDER BY l LIMIT 1"),
    "h02_pooled_quantile_integer": (h02b, "SELECT 'c_nationkey' AS variable, CAST(min(c_nationkey) AS DOUBLE) AS quantile FROM (SELECT c_nationkey, sum(count(*)) OVER (ORDER BY c_nationkey) AS cum, sum(count(*)) OVER () AS total FROM customer GROUP BY 1) WHERE cum >= 0.25 * total"),
    "h03_pooled_counts": (h03, "SELECT 'c_mktsegment' AS variable, c_mktsegment AS category, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total_n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS pct FROM customer GROUP BY 2"),
    "h04_wilson": (h04, f"WITH x AS (SELECT site, count(*) FILTER (WHERE c_acctbal < 0) AS k, count(*) AS n FROM {SITE} GROUP BY 1), y AS (SELECT *, k / n AS p, 3.841458820694124::DOUBLE AS z2, 1.959963984540054::DOUBLE AS z FROM x) SELECT site, k, n, round(greatest(0, (p + z2/(2*n) - z*sqrt(p*(1-p)/n + z2/(4*n*n))) / (1 + z2/n)), 6) AS low, round(least(1, (p + z2/(2*n) + z*sqrt(p*(1-p)/n + z2/(4*n*n))) / (1 + z2/n)), 6) AS high FROM y"),
    "h05_student_interval": (h05, None),
    "h06_random_effects": (h06, DL + " SELECT variable, k AS n_studies, round(wy/w, 3) AS pooled, round(sqrt(1/w), 3) AS se, round(tau2, 3) AS tau2, round(q, 3) AS \"Q\", round(CASE WHEN q > 0 THEN greatest(0, (q - (k-1)) / q) * 100 ELSE 0 END, 3) AS \"I2\", round(wy/w - 1.959963984540054::DOUBLE * sqrt(1/w), 3) AS low, round(wy/w + 1.959963984540054::DOUBLE * sqrt(1/w), 3) AS high FROM p"),
    # five sites: for four degrees of freedom the upper tail is exp(-q/2) (1 + q/2)
    "h06_heterogeneity_p": (h06b, DL + " SELECT variable, round(q, 3) AS \"Q\", round(exp(-q / 2) * (1 + q / 2), 6) AS q_pval FROM p"),
    "h07_stack_sites": (h07, f"SELECT c_mktsegment, count(*) AS n, site FROM {SITE} WHERE site IN ('ASIA','EUROPE') GROUP BY 1, 3"),
    "h08_with_all_row": (h08, f"SELECT coalesce(site, 'ALL') AS site, c_mktsegment, count(*) AS n FROM {SITE} GROUP BY GROUPING SETS ((site, c_mktsegment), (c_mktsegment))"),
    "h09_percent_by_hour": (h09, "SELECT event_type, CAST(hour(ts) AS INTEGER) AS hour, round(100.0::DOUBLE * count(*) FILTER (WHERE value > 50) / nullif(count(*) FILTER (WHERE value > 1), 0), 4) AS pct FROM events GROUP BY 1, 2"),
    "h10_table_one": (h10, TABLE_ONE),
    "h11_logit_three_ways": (h11, THREE_WAYS),
    "h11_model_grid": (h11b, None),
    "h11_formula_grid": (h11c, None),
    "h11_formula_design": (h11d, DESIGN),
    "h12_fit_ledger": (h12, None),
    "h12_formula_ledger": (h12b, LEDGER),
    "h13_natural_spline": (h13c, SPLINE_TERMS),
    "h13_cascade_spline": (h13d, CASCADE_TERMS),
    "h18_percentile_odds": (h18c, CASCADE_ODDS),
    "h22_complete_by_substring": (h22b, "SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 3 > 0 AND o_orderkey % 2 > 0"),
    "h13_spline": (h13, "WITH x AS (SELECT c_custkey, c_acctbal / 1000 AS x FROM customer), y AS (SELECT *, pow(greatest(x, 0), 3) AS a, pow(greatest(x - 3, 0), 3) AS b, pow(greatest(x - 6, 0), 3) AS c, pow(greatest(x - 9, 0), 3) AS d FROM x) SELECT c_custkey, round(x, 6) AS s0, round((a - c * 3 + d * 2) / 81, 6) AS s1, round((b - c * 2 + d) / 81, 6) AS s2 FROM y"),
    "h13_quartile_spline": (h13b, QUARTILES),
    "h14_contrasts": (h14, CONTRASTS),
    "h15_coefficient_table": (h15, None),
    "h16_wide_table": (h16, WIDE),
    "h17_marginal_grid": (h17, MARGINAL),
    "h18_cascade": (h18, CASCADE),
    "h18_stage_cohorts": (h18b, STAGES),
    "h19_welch": (h19, None),
    "h19_welch_statistic": (h19b, WELCH),
    "h20_ablation": (h20, None),
    "h22_complete_cases": (h22, "SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 3 > 0"),
}
