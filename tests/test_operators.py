"""Edge cases of the operators on small hand-made frames."""

from datetime import datetime as D

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoward.functions import columns as C, dose, localtime as L
from chronoward.operators import asof, machine, models, pooling, relational as R, respiratory, rules, scores, sequence as S, summary as M, waterfall
from chronoward.sources import io

GRID = ["2024-03-09 13:00", "2024-03-09 23:00", "2024-03-10 01:00", "2024-03-10 12:00", "2024-03-10 23:00", "2024-06-01 12:00", "2024-06-01 23:00", "2024-06-02 00:00", "2024-11-03 12:00"]


def ntz(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def grid(spark):
    return ntz(spark, [("h", D.fromisoformat(x)) for x in GRID], "id string, t timestamp_ntz")


@pytest.mark.parametrize("session_tz", ["UTC", "America/Chicago", "America/New_York", "Asia/Tokyo"])
def test_local_shift_across_clock_changes(spark, session_tz):
    spark.conf.set("spark.sql.session.timeZone", session_tz)
    try:
        rows = L.add_day_shift(grid(spark), "id", "t", "America/Chicago").orderBy("t").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [r["_hr"] for r in rows] == [7, 17, 19, 7, 18, 7, 18, 19, 6]
    assert [r["_shift"][0] for r in rows] == list("ddnddddnn")
    assert [r["_nth_day"] for r in rows] == [1, 1, 1, 2, 2, 3, 3, 3, 3]


def test_local_hour_by_site(spark):
    hours = lambda tz: [r["_hr"] for r in L.add_local_hour(grid(spark), "t", tz).orderBy("t").collect()]
    assert hours("UTC") == [13, 23, 1, 12, 23, 12, 23, 0, 12]
    assert hours("America/New_York")[5] == 8


def test_naive_times_to_utc(spark):
    df = ntz(spark, [(D(2019, 11, 3, 1, 30),), (D(2024, 6, 1, 12),), (D(2024, 3, 10, 2, 30),)], "t timestamp_ntz")
    got = [r["t"] for r in L.coerce_times(df, ["t", "absent"], "US/Central").collect()]
    assert got == [D(2019, 11, 3, 7, 30), D(2024, 6, 1, 17), D(2024, 3, 10, 8)]
    with pytest.raises(ValueError):
        L.coerce_times(df, ["t"], None)


def test_other_clock_rules(spark):
    df = ntz(spark, [(D(2019, 11, 3, 1, 30, 20),), (D(2024, 3, 10, 2, 30),)], "t timestamp_ntz")
    assert [r["t"] for r in L.standardize_times(df, ["t"], "US/Central", "minute").collect()] == [D(2019, 11, 3, 6, 30), None]
    with pytest.raises(ValueError):
        L.from_local(F.col("t"), "US/Central", "never")


def test_night_windows_over_clock_changes(spark):
    df = ntz(spark, [("h", D(2024, 3, 9, 18), D(2024, 3, 11, 18)), ("g", D(2024, 11, 2, 17), D(2024, 11, 4, 18))], "id string, a timestamp_ntz, b timestamp_ntz")
    rows = {(r["id"], r["night_start"]): (r["night_end"] - r["night_start"]).total_seconds() / 3600 for r in L.night_windows(df, "id", "a", "b", "America/Chicago").collect()}
    assert rows["h", D(2024, 3, 10, 1)] == 11 and rows["g", D(2024, 11, 3, 0)] == 13 and len(rows) == 4


def test_instants_to_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("SELECT TIMESTAMP'2024-06-01 12:00:00' AS t")
        got = L.coerce_times(df, ["t"], None).select(F.col("t").cast("string")).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == "2024-06-01 16:00:00"


def test_minutes_count_boundaries(spark):
    df = ntz(spark, [(D(2024, 1, 1, 10, 0, 59), D(2024, 1, 1, 10, 1))], "a timestamp_ntz, b timestamp_ntz")
    assert df.select(L.minutes_between(df, "a", "b")).first()[0] == 1


def test_outlier_rules(spark):
    vitals = spark.createDataFrame([("heart_rate", 80.0), ("heart_rate", 400.0), ("SpO2", 95.0), ("spo2", 30.0), ("heart_rate", -5.0), ("spo2", 100.0), ("patient's", 7.0)], "cat string, v double")
    rule = {"v": {"heart_rate": {"min": 0, "max": 300}, "spo2": {"min": 50, "max": 100}, "patient's": {"min": 8, "max": 9}}}
    assert [r["v"] for r in rules.clean(vitals, rule, {"v": ["cat"]}).collect()] == [80.0, None, 95.0, None, None, 100.0, None]
    pair = spark.createDataFrame([("propofol", "mcg/kg/min", 50.0), ("propofol", "mcg/kg/min", 500.0), ("propofol", "mg/hr", 100.0), ("fentanyl", "mcg/min", 20.0)], "drug string, unit string, dose double")
    deep = {"dose": {"propofol": {"mcg/kg/min": {"min": 0, "max": 100}}, "fentanyl": {"mcg/min": {"min": 0, "max": 10}}}}
    assert [r["dose"] for r in rules.clean(pair, deep, {"dose": ["drug", "unit"]}).collect()] == [50.0, None, 100.0, None]
    with pytest.warns(UserWarning):
        assert rules.clean(pair.drop("unit"), deep, {"dose": ["drug", "unit"]}).count() == 4
    flat = spark.createDataFrame([(0.4,), (1.5,), (0.21,), (0.1,)], "f double")
    assert [r["f"] for r in rules.clean(flat, {"f": {"min": 0.21, "max": 1}, "absent": {"min": 0, "max": 1}}, {}).collect()] == [0.4, None, 0.21, None]


def test_asof_edges(spark):
    left = spark.createDataFrame([(1, 10), (1, 5), (2, 1), (1, None), (3, 7)], "k int, t int")
    right = spark.createDataFrame([(1, 10, "tie"), (1, 4, None), (1, 3, "old"), (1, None, "no time"), (3, 8, "after")], "k int, u int, v string")
    get = lambda **kw: {(r["k"], r["t"]): r["v"] for r in asof.asof_join(left, right, ["k"], "t", "u", ["v"], **kw).collect()}
    assert get() == {(1, 10): "tie", (1, 5): None, (2, 1): None, (1, None): None, (3, 7): None}
    assert get(strict=True)[1, 10] is None
    assert get(direction="forward") == {(1, 10): "tie", (1, 5): "tie", (2, 1): None, (1, None): None, (3, 7): "after"}
    assert get(tolerance=F.col("_left_time") - F.col("_right_time") <= 0)[1, 10] == "tie"
    twice = right.union(spark.createDataFrame([(1, 10, "zz")], right.schema))
    assert asof.asof_join(left, twice, ["k"], "t", "u", ["v"], tiebreak=["v"]).where("k = 1 AND t = 10").first()["v"] == "zz"


def test_asof_shuffles_once(spark):
    left, right = spark.range(10).selectExpr("id % 3 AS k", "id AS t"), spark.range(10).selectExpr("id % 3 AS k", "id AS u", "id AS v")
    plan = asof.asof_join(left, right, ["k"], "t", "u", ["v"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_event_within_bounds(spark):
    df = ntz(spark, [(1, D(2024, 1, 1), False), (1, D(2024, 1, 3), True), (1, D(2024, 1, 3, 0, 0, 1), False)], "k int, t timestamp_ntz, e boolean")
    got = [r["x"] for r in S.event_within(df, ["k"], "t", F.col("e"), 48 * 3_600_000_000, "x").orderBy("t").collect()]
    assert got == [1, 0, 0]


def test_islands_with_null_state_and_streak_end(spark):
    df = ntz(spark, [(1, D(2024, 1, 1, h), s) for h, s in enumerate([True, True, None, None, False, True])], "k int, t timestamp_ntz, s boolean")
    assert [r["i"] for r in S.islands(df, ["k"], ["t"], {"i": F.col("s")}).orderBy("t").collect()] == [1, 1, 2, 2, 3, 4]
    runs = S.streaks(df, ["k"], "t", F.col("s")).orderBy("streak_id").collect()
    assert [(r["streak_id"], r["hours"]) for r in runs] == [(1, 2.0), (2, 0.0)]


def test_stitch_chains_overlaps(spark):
    day = lambda n: D(2024, 1, n)
    df = ntz(spark, [("p", 1, day(1), day(9)), ("p", 2, day(2), day(3)), ("p", 3, day(9), day(10)), ("p", 4, day(20), day(21))], "p string, id int, a timestamp_ntz, b timestamp_ntz")
    got = {r["id"]: r["block_id"] for r in S.stitch(df, ["p"], "a", "b", "id", 12 * 3_600_000_000).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def confirm_rows(on, stop, minutes, on_window, off_window):
    """The state machine row by row."""
    out = [[0, 0, 0] for _ in on]
    is_on, since = False, None  # confirmed state, and the row where the opposite state began
    for i, (now, ends) in enumerate(zip(on, stop)):
        if ends:
            if is_on:
                out[since if since is not None else i][1] = 1
            elif since is not None:  # a beginning that was not confirmed yet still closes here
                out[i][1] = 1
            out[i][2] = 1
            break
        if now == is_on:
            since = None
        elif since is None:
            since = i
        elif minutes[i] - minutes[since] >= (off_window if is_on else on_window):
            out[since][1 if is_on else 0] = 1
            is_on, since = not is_on, None
    return [tuple(x) for x in out]


def confirm(states, stops=None, step=10):
    return confirm_rows(states, stops or [False] * len(states), [i * step for i in range(len(states))], 15, 30)


def test_state_machine_against_rows(spark):
    import datetime
    import random

    rng, rows, want = random.Random(3), [], {}
    for entity in range(150):
        n, t = rng.randint(1, 14), 0
        times, on, stop = [], [], []
        for _ in range(n):
            t += rng.choice([0, 1, 5, 14, 15, 16, 29, 30, 31])
            times.append(t), on.append(rng.choice([True, False, None])), stop.append(rng.choice([True, *[False] * 8, None]))
        for i, x in enumerate(confirm_rows([bool(x) for x in on], [bool(x) for x in stop], times, 15, 30)):
            want[entity * 100 + i] = x
        rows += [(entity * 100 + i, entity, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=times[i]), on[i], stop[i]) for i in range(n)]
    df = spark.createDataFrame(rows, "row int, id int, t timestamp_ntz, on boolean, stop boolean")
    got = machine.consensus_events(df, "id", "t", "on", "stop", tiebreak=["row"])
    assert {r["row"]: (r["_on_event"], r["_off_event"], r["_stop_event"]) for r in got.collect()} == want
    assert got.columns == [*df.columns, *machine.FLAGS]


def test_state_machine():
    assert confirm([True, True, True]) == [(1, 0, 0), (0, 0, 0), (0, 0, 0)]
    assert confirm([True, False, True]) == [(0, 0, 0)] * 3
    assert confirm([True, True]) == [(0, 0, 0)] * 2  # 10 minutes are not 15
    off = confirm([True, True, True, False, False, False, False])
    assert off[3] == (0, 1, 0)
    assert confirm([True, True, True, False, True, False])[3:] == [(0, 0, 0)] * 3
    assert confirm([False, False], [False, True])[1] == (0, 0, 1)
    assert confirm([True, True, True, True], [False, False, False, True])[3] == (0, 1, 1)


def test_unit_conversion(spark):
    df = spark.createDataFrame([(1.0, "mg/hr", 60.0), (1.0, "mcg/kg/min", None), (1.0, "mcg/min", None), (1.0, "mcg/lb/min", None), (1.0, None, 1.0), (2.0, "units/hr", 1.0)], "d double, u string, w double")
    got = [(r["convert_status"], None if r["dose_converted"] is None else round(r["dose_converted"], 6)) for r in dose.convert(df, "d", "u", "w").collect()]
    assert got == [("success", round(1000 / 60 / 60, 6)), ("success", 1.0), ("missing weight", None), ("success", 2.20462), ("missing unit", 1.0), ("unknown mass", 2.0)]


def test_six_groups(spark):
    df = spark.createDataFrame([(5.0, 0.0), (1.0, 0.5), (0.0, 0.0), (2.0, 2.0), (None, 0.5), (0.0, 9.0), (None, None)], "d double, n double")
    assert [r[0] for r in df.select(C.six_groups(F.col("d"), F.col("n"), 1.0)).collect()] == [*C.SIX_GROUPS, None]


def test_truthy(spark):
    df = spark.createDataFrame([("1.0",), ("True",), ("Yes",), ("0",), (None,), ("no",)], "x string")
    assert [r[0] for r in df.select(C.truthy(df, "x")).collect()] == [1, 1, 1, 0, 0, 0]


def test_histogram_last_bin_is_closed(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (12.0,), (None,)], "x double")
    assert [r["count"] for r in M.histogram(df, "x", [0, 5, 10]).orderBy("bin_left").collect()] == [1, 3]


def test_pooling(spark):
    x = np.array([1.0, 2.0, 4.0, 8.0])
    sites = spark.createDataFrame([("v", 2, 3.0, 5.0), ("v", 2, 12.0, 80.0), ("one", 1, 3.0, 9.0)], "variable string, n long, sum double, sum_sq double")
    got = {r["variable"]: r for r in pooling.pooled_mean_sd(sites, ["variable"]).collect()}
    assert got["v"]["mean"] == x.mean() and abs(got["v"]["sd"] - x.std(ddof=1)) < 1e-12 and got["one"]["sd"] is None
    few = spark.createDataFrame([("a", 0.5, 0.1), ("a", float("nan"), 0.1), ("a", 0.2, 0.0)], "k string, e double, v double")
    assert pooling.random_effects(few, ["k"], "e", "v").first()["pooled"] is None
    assert abs(pooling.student_quantile(0.975, 10) - 2.228139) < 1e-5 and abs(pooling.chi2_upper(3.841459, 1) - 0.05) < 1e-6


def test_logit_against_newton(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.3 + x @ [1.0, -0.5])))).astype(int)
    df = spark.createDataFrame([(int(a), int(i // 4), float(b), float(c)) for i, (a, (b, c)) in enumerate(zip(y, x))], "y int, g int, a double, b double")
    design, beta = np.column_stack([np.ones(400), x]), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ beta))
        info = design.T @ (design * (p * (1 - p))[:, None])
        beta = beta + np.linalg.solve(info, design.T @ (y - p))
    terms = {"a": F.col("a"), "b": F.col("b")}
    fit = models.logit(df, "y", terms, "g", "gee")
    scores_ = np.array([(design * (y - p)[:, None])[g * 4 : g * 4 + 4].sum(axis=0) for g in range(100)])
    bread = np.linalg.inv(info)
    assert fit.status == "converged" and np.allclose(fit.beta, beta, atol=1e-6)
    assert np.allclose(fit.cov, bread @ (scores_.T @ scores_) @ bread, atol=1e-6)
    assert models.logit(df, "y", {**terms, "c": F.col("a") * 2}).status == "rank deficient"
    assert models.logit(df.where("y = 1"), "y", terms).status == "one outcome only"


def test_waterfall_fills_within_blocks(spark):
    t = lambda h: D(2024, 1, 1, h)
    rows = [("h", t(0), "IMV ", "SIMV", 40.0, None), ("h", t(1), None, None, None, 8.0), ("h", t(2), "imv", None, None, None), ("h", t(3), "Room Air", None, None, None), ("h", t(4), "nasal cannula", None, None, None)]
    df = spark.createDataFrame([(*r, 3.0 if i == 4 else None, 1 if i == 2 else 0) for i, r in enumerate(rows)], "hospitalization_id string, recorded_dttm timestamp_ntz, device_category string, mode_category string, fio2_set double, peep_set double, lpm_set double, tracheostomy int")
    got = respiratory.waterfall(df).orderBy("recorded_dttm").collect()
    assert [r["device_category"] for r in got] == ["imv", "imv", "imv", "room air", "nasal cannula"]
    assert [r["fio2_set"] for r in got] == [0.4, 0.4, 0.4, 0.21, 0.32] and [r["peep_set"] for r in got][:3] == [8.0] * 3
    assert [r["tracheostomy"] for r in got] == [0, 0, 1, 1, 1]


def test_sofa(spark):
    df = spark.createDataFrame([(0.0, 15, 30.0), (None, 15, None)], "norepinephrine double, gcs_total int, platelet_count double")
    a, b = scores.sofa(df).collect()
    assert (a["sofa_cv"], a["sofa_cns"], a["sofa_coag"], a["sofa_total"]) == (3, 0, 3, 6) and b["sofa_total"] == 0


def test_sources_and_sinks(spark, tmp_path, sf_dir):
    path = str(tmp_path / "x.csv")
    with open(path, "w") as f:
        f.write("id,v\n1,2.5\n2,\n")
    assert io.read_table(spark, path, string_ids=["id"]).dtypes == [("id", "string"), ("v", "double")]
    made = []
    make = lambda: made.append(1) or spark.range(3).toDF("id")
    for rebuild in (False, False, True):
        assert io.cached(spark, str(tmp_path / "c"), make, rebuild).count() == 3
    assert len(made) == 2
    io.write_aggregate_csv(spark.range(2), str(tmp_path / "agg"))
    assert io.to_json(spark.range(2)) == '[{"id":0},{"id":1}]'
    with pytest.raises(ValueError):
        io.write_aggregate_csv(spark.range(3), str(tmp_path / "agg2"), most_rows=2)
    spec = io.TableSpec(["id"], {"flag": 0})
    assert spec.apply(spark.range(1)).columns == ["id", "flag"]
    with pytest.raises(ValueError):
        spec.apply(spark.range(1).toDF("x"))
    df, cover = io.read_external(spark, f"{sf_dir}/customer.parquet", io.TableSpec(["c_custkey"]), spark.createDataFrame([(1,), (-5,)], "c_custkey long"), "c_custkey")
    assert df.count() == 1 and cover.first()["ratio"] == 0.5
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    io.write_events(events, str(tmp_path / "ev"), "user_id", "ts")
    assert io.read_entity(spark, str(tmp_path / "ev"), "user_id", 3).count() == events.where("user_id = 3").count()
    many = io.read_table(spark, f"{sf_dir}/events.parquet", ["event_id"], {"event_id": range(1500)})
    assert many.count() == events.where("event_id < 1500").count()


def test_flow_markdown(spark):
    rows = rules.flow(spark.range(10), [("even", F.col("id") % 2 == 0), ("null", F.lit(None).cast("boolean"))]).collect()
    assert [(r["n_remaining"], r["n_excluded"]) for r in rows] == [(10, 0), (5, 5), (0, 5)]
    assert rules.flow_markdown(rows).count("\n") == 4


def test_small_side_is_broadcast_only_when_small(spark, monkeypatch):
    assert "broadcast" in R.small(spark.range(5))._jdf.queryExecution().analyzed().toString().lower()
    monkeypatch.setattr(R, "BROADCAST_ROWS", 3)
    assert "broadcast" not in R.small(spark.range(5))._jdf.queryExecution().analyzed().toString().lower()


def test_configuration_and_rule_files(spark, tmp_path):
    from chronoward.sources.config import SiteConfig, read_rules

    site = tmp_path / "site.json"
    site.write_text('{"site_name": "north", "timezone": "US/Central", "data_directory": "/d/", "other": 1}')
    config = SiteConfig.read(str(site), {"CHRONOWARD_REBUILD": "a,b", "CHRONOWARD_STATE_MACHINE": "false"})
    assert (config.timezone, config.rebuild, config.state_machine, config.path("labs")) == ("US/Central", ("a", "b"), False, "/d/labs.parquet")
    pairs = tmp_path / "rules.json"
    pairs.write_text('{"labs": {"albumin": [0, 15], "ph": {"min": 6, "max": 8}}}')
    found = read_rules(str(pairs))
    df = spark.createDataFrame([("albumin", 20.0), ("PH", 7.0)], "c string, v double")
    assert [r["v"] for r in rules.clean(df, {"v": found["labs"]}, {"v": ["c"]}).collect()] == [None, 7.0]
    pairs.write_text('{"labs": {"albumin": [0]}}')
    with pytest.raises(ValueError):
        read_rules(str(pairs))
    yaml_file = tmp_path / "rules.yaml"
    yaml_file.write_text("tables:\n  vitals:\n    weight:\n      min: 30\n      max: 300\n")
    pytest.importorskip("yaml")
    assert read_rules(str(yaml_file)) == {"vitals": {"weight": {"min": 30.0, "max": 300.0}}}


def model_rows(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    n = 600
    x, u, c = rng.normal(0, 1, n), rng.integers(0, 2, n), rng.integers(0, 60, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.3 + 0.8 * x - 0.5 * u)))).astype(int)
    rows = spark.createDataFrame([(int(a), float(b), int(d), int(e)) for a, b, d, e in zip(y, x, u, c)], "y int, x double, u int, c int")
    return rows, y, np.column_stack([np.ones(n), x, u]), c


def test_one_fit_for_all_covariances(spark):
    """Coefficients and the three covariances against a fit in numpy; tables, contrasts and grids follow from them."""
    import numpy as np

    rows, y, design, cluster = model_rows(spark)
    beta = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ beta))
        beta = beta + np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]), design.T @ (y - p))
    p = 1 / (1 + np.exp(-design @ beta))
    bread = np.linalg.inv(design.T @ (design * (p * (1 - p))[:, None]))
    scores = np.array([(design[cluster == g] * (y - p)[cluster == g][:, None]).sum(axis=0) for g in np.unique(cluster)])
    sandwich, g = bread @ scores.T @ scores @ bread, len(scores)
    want = {"asymptotic": bread, "gee": sandwich, "robust": sandwich * g / (g - 1) * (len(y) - 1) / (len(y) - 3)}
    terms = {"x": F.col("x"), "u": F.col("u")}
    fits = models.logits(rows, "y", terms, "c", list(want))
    for kind, cov in want.items():
        assert np.allclose(fits[kind].beta, beta, atol=1e-6) and np.allclose(fits[kind].cov, cov, rtol=1e-4, atol=1e-9)
    odds, low, high = models.contrast(fits["robust"], [1, 0, 0], [1, 2, 0])
    se = 2 * np.sqrt(want["robust"][1, 1])
    assert np.allclose([odds, low, high], np.exp(2 * beta[1] + np.array([0, -1, 1]) * 1.959963984540054 * se), rtol=1e-4)
    grid = models.marginal_grid(spark, fits["asymptotic"], {"u": 1.0}, "x", -1.0, 1.0, 5).collect()
    at = np.array([1.0, 1.0, 1.0])
    assert np.isclose(grid[-1]["p"], 1 / (1 + np.exp(-at @ beta)), atol=1e-6) and np.isclose(grid[-1]["high"], 1 / (1 + np.exp(-(at @ beta + 1.959963984540054 * np.sqrt(at @ bread @ at)))), atol=1e-5)
    table = {(r["predictor"]): r["gee"] for r in models.wide_table(models.coefficients(spark, {("y", k, "s"): f for k, f in fits.items()}), list(want)).collect()}
    s = np.sqrt(np.diag(sandwich))
    assert table["x"] == "%.2f (%.2f, %.2f)" % tuple(np.exp(beta[1] + np.array([0, -1, 1]) * 1.959963984540054 * s[1])) + ("*" if abs(beta[1] / s[1]) > 1.96 else "")


def test_model_grid_and_stages(spark):
    rows, *_ = model_rows(spark)
    rows = rows.withColumn("never", F.lit(0))
    terms = {"x": F.col("x")}
    fits = models.grid(rows, {"y": ("asymptotic", "gee"), "never": ("gee",)}, {"a": terms, "twice": {**terms, "again": F.col("x") * 2}}, "c")
    assert {k: f.status for k, f in fits.items()} == {
        ("y", "asymptotic", "a"): "converged", ("y", "gee", "a"): "converged", ("y", "asymptotic", "twice"): "rank deficient", ("y", "gee", "twice"): "rank deficient",
        ("never", "gee", "a"): "one outcome only", ("never", "gee", "twice"): "one outcome only",
    }
    alone = models.logit(rows.where("u = 1"), "y", terms, "c", "robust")
    staged = models.cascade(rows, [("all", F.lit(True), "y"), ("some", F.col("u") == 1, "y")], terms, "c")
    assert staged["some"].n == alone.n < staged["all"].n and abs(staged["some"].beta[1] - alone.beta[1]) < 1e-9
    assert models.quartile_knots(rows.where("x > 5"), "x") is None and len(models.quartile_knots(rows, "x")) == 5


def test_model_grid_makes_its_rows_once(spark):
    """All fits share one pass over what makes the rows, however many there are."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows, *_ = model_rows(spark)
    n = rows.count()
    watched = rows.mapInArrow(counted, rows.schema)
    models.grid(watched, {"y": ("asymptotic", "gee")}, {"a": {"x": F.col("x")}, "b": {"x": F.col("x"), "u": F.col("u")}}, "c")
    assert made.value == n
    kept = rows.persist()
    models.grid(kept, {"y": ("gee",)}, {"a": {"x": F.col("x")}}, "c")
    assert kept.is_cached and kept.storageLevel.useMemory
    kept.unpersist()


def test_table_one_rounds_like_c(spark):
    values = [265.15, 4537.45, 0.25, 0.35, 12.75, 0.05, -0.04, 1234567.85]
    rows = spark.createDataFrame([(f"s{i}", "x", 3, v, v, v, v, v) for i, v in enumerate(values)], "site string, variable string, n long, mean double, sd double, median double, q1 double, q3 double")
    none = spark.createDataFrame([("s0", "c", "a", 1, 12.25)], "site string, variable string, category string, n long, pct double")
    got = {r["statistic"]: r for r in pooling.table_one(rows, none, "site", [f"s{i}" for i in range(len(values))]).collect()}
    assert [got["mean (SD)"][f"s{i}"] for i in range(len(values))] == [f"{v:.1f} ({v:.1f})" for v in values]
    assert [got["median [Q1, Q3]"][f"s{i}"] for i in range(len(values))] == [f"{v:.1f} [{v:.1f}, {v:.1f}]" for v in values]
    assert got["a, n (%)"]["s0"] == "1 (12.2)"


def test_waterfall_full_dealt_by_number(spark, monkeypatch):
    """Few rows that span many hours are many rows of the scaffold, and many tasks, not the few that their bytes would be."""
    monkeypatch.setattr(waterfall, "TASK_ROWS", 500, raising=False)
    rows = [(f"h{i}", D(2024, 1, day), "imv", day) for i in range(30) for day in (1, 9)]
    df = spark.createDataFrame(rows, "hospitalization_id string, recorded_dttm timestamp_ntz, device_category string, n int")
    got = waterfall.waterfall_full(df, tiebreak=["n"])
    tasks = got.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.count_distinct("hospitalization_id").alias("k")).collect()
    assert sum(r["n"] for r in tasks) == 30 * (8 * 24 + 1 + 2) and sum(r["k"] for r in tasks) == 30
    assert len(tasks) >= 6
    assert waterfall.waterfall_full(df.limit(0), tiebreak=["n"]).count() == 0


def test_waterfall_full_shuffles_its_rows_once(spark, monkeypatch):
    """Rows and bounds are dealt once each; neither the scaffold nor the commonest names shuffle rows, and ids share a sort with what they split."""
    devices, modes = [" IMV", "nippv", None, "trach collar", "imv"], ["SIMV", None, "assist control-volume control"]
    rows = [(None if i == 0 else f"h{i}", D(2024, 1, 1 + i % 3, hour // 2), devices[(i + hour) % 5], None if hour % 3 else f"d{i % 2}", modes[(i * hour) % 3], f"m{hour % 2}", hour / 3 if hour % 2 else None, hour) for i in range(12) for hour in range(30)]
    rows += [*rows[40:60], ("empty", None, None, None, None, None, None, None), ("late", None, "imv", "d0", "SIMV", None, 1.5, 1)]
    df = spark.createDataFrame(rows, "hospitalization_id string, recorded_dttm timestamp_ntz, device_category string, device_name string, mode_category string, mode_name string, fio2_set double, n int")
    whole = waterfall.waterfall_full(df, tiebreak=["n"]).collect()
    monkeypatch.setattr(waterfall, "TASK_ROWS", 40)
    got = waterfall.waterfall_full(df, tiebreak=["n"])
    assert sorted(map(str, got.collect())) == sorted(map(str, whole))
    plan = got._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    assert plan.count("REPARTITION_BY_NUM") == 2
    after = plan.partition("Union")
    assert after[1] and "Exchange" not in after[0] and after[0].count("Sort ") == 6


def test_fill_both_reads_a_partition_once(spark):
    """Forward, then backward, with null keys, empty and late values; no frame runs from each row to the end, which is quadratic on a hot key."""
    rng = np.random.default_rng(4)
    rows = [(None if i % 9 == 0 else int(i % 5), i, None if rng.random() < 0.7 or i < 40 else int(rng.integers(9)), None if i % 5 == 2 or rng.random() < 0.5 else "" if i % 3 else "x") for i in range(300)]
    df = S.fill_both(spark.createDataFrame(rows, "k int, t int, a int, b string").repartition(7), ["a", "b"], ["k"], ["t"])
    got = {r["t"]: (r["a"], r["b"]) for r in df.collect()}

    def filled(k, t, at):
        own = [(r[1], r[at]) for r in rows if r[0] == k and r[at] is not None]
        return next((v for u, v in reversed(own) if u <= t), next((v for u, v in own if u > t), None))

    assert got == {t: (filled(k, t, 2), filled(k, t, 3)) for k, t, _, _ in rows}
    assert "currentrow$(), unboundedfollowing$()" not in df._jdf.queryExecution().executedPlan().toString()
