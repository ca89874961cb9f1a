"""Cleaning, units, exposure, outcomes, scores and registries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import columns as C
from ..functions import dose as D
from ..functions import localtime as L
from ..operators import exposure as X
from ..operators import audits, machine, registry as G, relational as R, respiratory as V, rules, scores as Z, trials, waterfall as W
from ..operators import sequence as S, summary as M
from .base import HOUR_US, r, t
from . import aggregating as A
from .ordered import CASES as ORDERED, SHIFT, _bounds, ev


def f01(s, d):
    return R.pivot(ev(s, d).withColumn("day", F.to_date("ts")), ["user_id", "day"], "event_type", ["click", "view", "error"], r(F.avg("value")))


def f02(s, d):
    return R.pivot(ev(s, d), ["user_id"], "event_type", ["click", "view", "purchase", "error", "signup"], F.max("value"))


def f03(s, d):
    return R.unpivot(t(s, d, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_partkey"], ["p_size", "p_retailprice"])


def f04(s, d):
    a = ev(s, d).where("event_type = 'click'").select("user_id", F.lit(1).alias("clicked"))
    b = ev(s, d).where("event_type = 'error'").select("user_id", F.lit(1).alias("failed"))
    return R.union_by_name(a, b).distinct().join(ev(s, d).where("event_type = 'signup'").select("user_id"), "user_id", "left_anti")


UNITS = ["mcg/kg/min", "mg/hr", "MCG / min", "mg/kg/h", "units/hr"]


def f05(s, d):
    p = t(s, d, "part").select("p_partkey", F.col("p_retailprice").alias("dose"), F.element_at(F.array(*map(F.lit, UNITS)), (F.col("p_partkey") % 5 + 1).cast("int")).alias("unit"), F.when(F.col("p_size") > 10, F.col("p_size").cast("double")).alias("weight"))
    return D.convert(p, "dose", "unit", "weight").select("p_partkey", "convert_status", r("dose_converted").alias("dose_converted"), "unit_converted")


def f05b(s, d):
    p = t(s, d, "part").select(F.col("p_retailprice").alias("dose"), F.element_at(F.array(*map(F.lit, UNITS)), (F.col("p_partkey") % 5 + 1).cast("int")).alias("unit"), F.when(F.col("p_size") > 10, F.col("p_size").cast("double")).alias("weight"))
    return D.conversion_counts(D.convert(p, "dose", "unit", "weight"), "unit")


RULES = {"value": {"click": {"min": 5, "max": 90}, "Purchase": {"min": 0, "max": 50}}}


def f06(s, d):
    return rules.clean(ev(s, d), RULES, {"value": ["event_type"]}).select("event_id", "value")


def f06b(s, d):
    pair = {"l_quantity": {"R": {"F": {"min": 2, "max": 40}}, "N": {"O": {"min": 5, "max": 45}}}}
    return rules.clean(t(s, d, "lineitem"), pair, {"l_quantity": ["l_returnflag", "l_linestatus"]}).groupBy("l_returnflag", "l_linestatus").agg(F.count("l_quantity").alias("n_kept"), F.count("*").alias("n"))


def f06c(s, d):
    c = t(s, d, "customer")
    return rules.dropped_values(c, rules.clean(c, {"c_acctbal": {"min": 0, "max": 5000}}, {}), ["c_acctbal"])


def _resp(s, d):
    v = F.col("value")
    return ev(s, d).select(
        "user_id", "ts", F.when(v > 60, "IMV").when(v > 40, "Nasal Cannula ").when(v > 30, "Room Air").alias("device_category"),
        F.when(v > 70, "Pressure Control").when(v > 60, "Pressure Support/CPAP").when(v.between(20, 30), "SIMV").alias("mode_category"),
        F.when(F.col("event_type") == "click", v).alias("fio2_set"), F.when(F.col("event_type") == "view", v / 10).alias("peep_set"),
        F.when(F.col("event_type") == "error", v / 8).alias("pressure_support_set"), F.when(F.col("event_type") == "purchase", v / 8).alias("lpm_set"),
        F.when(F.col("event_type") == "signup", "T-piece trial").alias("device_name"), (v > 98).cast("int").alias("tracheostomy"), "event_id",
    )


def f07(s, d):
    return V.waterfall(_resp(s, d), "user_id", "ts", ("event_id",)).select("user_id", "ts", "device_category", "mode_category", r("fio2_set").alias("fio2_set"), "mode_category_id", "tracheostomy")


def _full_resp(s, d):
    e, v, k = ev(s, d), F.col("value"), F.col("event_id")
    device = F.when(v > 75, "IMV").when(v > 60, "nippv").when(v > 45, "trach collar").when(v > 35, "room air")
    mode = F.when(k % 7 == 0, "SIMV").when(k % 7 == 1, "pressure support/cpap").when(k % 7 == 2, "assist control-volume control")
    every = lambda n, x: F.when(k % n == 0, x)
    return e.select(
        "user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "event_id", device.alias("device_category"), F.when(F.col("event_type") == "signup", "T-Piece").when(k % 11 == 0, "trach mask").when(device.isNotNull() & (k % 3 == 0), F.concat(F.lit("dev "), (k % 2).cast("string"))).alias("device_name"),
        mode.alias("mode_category"), F.when(mode.isNotNull() & (k % 4 == 0), F.concat(F.lit("m "), (k % 5).cast("string"))).alias("mode_name"), every(3, v).alias("fio2_set"), every(4, v / 8).alias("lpm_set"), every(2, v / 10).alias("peep_set"), every(2, v * 5).alias("tidal_volume_set"),
        every(3, v / 8).alias("pressure_support_set"), every(4, v / 5).alias("resp_rate_set"), every(3, v / 3).alias("peak_inspiratory_pressure_set"), every(9, (v > 50).cast("int")).alias("tracheostomy"),
    )


def f07b(s, d):
    out = W.waterfall_full(_full_resp(s, d), "user_id", "ts", ["event_id"])
    ids = ["device_category_id", "device_name_id", "mode_category_id", "mode_name_id"]
    return out.select("user_id", "ts", "event_id", "is_scaffold", *W.LABELS, *ids, *[r(c, 6).alias(c) for c in ("fio2_set", "lpm_set", "peep_set", "tidal_volume_set", "pressure_support_set", "resp_rate_set", "peak_inspiratory_pressure_set")], "tracheostomy")


def f08(s, d):
    return C.normalize_categories(t(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_orderpriority", "o_totalprice", "absent"]).select("o_orderkey", "o_orderpriority")


def _mar(s, d):
    return ev(s, d).select("event_id", "user_id", "ts", "value", F.when(F.col("event_type") == "error", "stop").when(F.col("event_type") == "signup", "not_given").when(F.col("event_type") == "view", "going").otherwise("start").alias("mar_action_category"), F.when(F.col("event_type") == "error", "Stopped early").when(F.col("event_type") == "signup", "Not Given").alias("mar_action_name"))


def f09(s, d):
    return _mar(s, d).select("event_id", C.stop_action(True).cast("int").alias("stop_by_category"), C.stop_action(False).cast("int").alias("stop_by_name"), C.given_action(False).cast("int").alias("given"))


def f10(s, d):
    x = _resp(s, d).withColumn("device_category", F.lower(F.trim("device_category"))).withColumn("device", V.device_from_mode(F.col("device_category"), F.col("mode_category")))
    return x.select("event_id", "device", r(V.fio2_filled(F.col("fio2_set") / 100, F.col("device"), F.col("lpm_set"))).alias("fio2"))


def f11(s, d):
    ids = ev(s, d).select("user_id").distinct()
    return rules.value_exclusions(ev(s, d).where("event_type = 'click'"), ids, "user_id", "ts", "value", 5.0, 95.0, 60.0, 24 * HOUR_US, 88.0, ["event_id"])


def f12(s, d):
    return rules.flow(t(s, d, "orders"), [("filled", F.col("o_orderstatus") == "F"), ("large", F.col("o_totalprice") > 100000), ("urgent", F.col("o_orderpriority") == "1-URGENT")])


def _grid(s, d):
    return L.add_day_shift(S.hour_grid(_bounds(s, d), "a", "b", "event_dttm").select("user_id", "event_dttm"), "user_id", "event_dttm", "America/Chicago")


def f13(s, d):
    doses = ev(s, d).where("event_type = 'purchase'")
    return G.long_exposure_days(doses, _grid(s, d).select("user_id", "event_dttm", "_nth_day"), "user_id", "ts", "value", "_nth_day", 6000.0, ["event_id"]).select("user_id", "_nth_day", r("total_minutes", 2).alias("total_minutes"))


def _meds(s, d):
    return ev(s, d).where("event_type <> 'signup'").select("user_id", "event_id", F.col("ts").alias("admin_dttm"), F.when(F.pmod("event_id", F.lit(2)) == 0, "propofol").otherwise("fentanyl").alias("med_category"), (F.col("value") / 10).alias("med_dose"), F.when(F.col("event_type") == "error", "stop").otherwise("going").alias("mar_action_category"))


def f14(s, d):
    grid = S.hour_grid(_bounds(s, d).withColumn("a", F.expr("a + INTERVAL 48 HOUR")).where("a < b"), "a", "b", "event_dttm", by=["user_id"]).select("user_id", "event_dttm")
    x = X.continuous_by_hour(_meds(s, d), grid, "user_id", ["propofol", "fentanyl"], tiebreak=["event_id"])
    return x.select("user_id", "event_dttm", r("propofol_cont", 3).alias("propofol_cont"), r("fentanyl_cont", 3).alias("fentanyl_cont"))


def f15(s, d):
    x = X.bolus_by_hour(_meds(s, d), "user_id", ["propofol", "fentanyl"], tiebreak=["event_id"])
    return x.select("user_id", "event_dttm", r("propofol_bolus").alias("propofol_bolus"), r("fentanyl_bolus").alias("fentanyl_bolus"))


def f16(s, d):
    w = R.pivot(ev(s, d), ["user_id"], "event_type", ["click", "view", "error"], F.sum("value"))
    return X.equivalents(w, {"opioid": {"click": 1, "view": 50}, "benzo": {"error": 2.0 / 60}}).select("user_id", r("opioid", 3).alias("opioid"), r("benzo", 3).alias("benzo"))


def f17(s, d):
    w = R.pivot(ev(s, d), ["user_id"], "event_type", ["click", "view", "error", "purchase", "signup"], F.max("value"))
    n = D.norepinephrine_equivalent(F.col("click"), F.col("view"), F.col("error"), F.col("purchase"), F.col("signup"), F.lit(None).cast("double"))
    return w.select("user_id", r(n).alias("nee"))


def _trial_rows(s, d):
    return _resp(s, d).withColumn("mode_category", F.lower("mode_category")).withColumn("pressure_support_set", F.when(F.pmod("event_id", F.lit(3)) == 0, F.lit(6.0))).withColumn("peep_set", F.when(F.pmod("event_id", F.lit(2)) == 0, F.lit(5.0)))


def f18(s, d):
    return V.trial_states(_trial_rows(s, d)).select("event_id", "state_primary", "state_broad", "state_strict")


def _statuses(s, d):
    e = ev(s, d).where("event_type = 'error'")
    return e.select("user_id", F.col("ts").alias("start_dttm"), "event_id", F.when(F.pmod("event_id", F.lit(3)) == 0, "Full").otherwise("DNR ").alias("code_status_category"))


def _discharges(s, d):
    last = ev(s, d).groupBy("user_id").agg(F.max("ts").alias("discharge_dttm"))
    return last.withColumn("discharge_category", F.when(F.pmod("user_id", F.lit(2)) == 0, "Expired").otherwise("home"))


def f19(s, d):
    rows = _trial_rows(s, d).withColumns({"device_category": F.lower(F.trim("device_category")), "fio2_set": F.col("fio2_set") / 200})
    out = trials.trial_outcomes(rows, "user_id", "ts", _statuses(s, d), _discharges(s, d), ["event_id"], status_tiebreak=["event_id"])
    return out.select("event_id", *trials.VARIANTS, *trials.EXITS, *[f"{c}_v2" for c in trials.EXITS], "_trach_1st", "_trach_v2", "_block_minutes")


def f20(s, d):
    g = _grid(s, d).withColumn("h", F.col("event_dttm"))
    rows = ev(s, d).withColumn("h", F.date_trunc("hour", "ts").cast("timestamp_ntz")).withColumns({"bad": (F.col("event_type") == "error").cast("int"), "bought": (F.col("event_type") == "purchase").cast("int")})
    hourly = G.onto_grid(g.select("user_id", "h", "_nth_day"), rows, ["user_id", "h"], ["bad", "bought"])
    return G.roll_up(hourly, ["user_id", "_nth_day"], ["bad", "bought"])


def f21(s, d):
    x = ev(s, d).select("user_id", "ts", "event_id", (F.col("value") > 50).alias("imv"), (F.col("value") > 99.5).alias("trach"))
    return machine.consensus_events(x, "user_id", "ts", "imv", "trach", 15, 30, ["event_id"]).select("event_id", *machine.FLAGS)


def f22(s, d):
    return ev(s, d).select("event_id", r(Z.pao2_from_spo2(F.col("value")), 3).alias("pao2"))


def f23(s, d):
    return ev(s, d).select("event_id", r(Z.pf_from_sf(F.col("value"), F.lit(0.4)), 3).alias("pf"))


def f24(s, d):
    from ..operators.asof import asof_join

    resp = ev(s, d).where("event_type = 'click' AND value >= 21").select("user_id", F.col("ts").alias("t"), (F.col("value") / 100).alias("fio2"), F.col("event_id").alias("resp_id"))
    limit = F.expr("timestampdiff(MICROSECOND, _right_time, _left_time) <= 240 * 60 * 1000000L")
    p = asof_join(ev(s, d).where("event_type = 'view'").select("event_id", "user_id", "ts", "value"), resp, ["user_id"], "ts", "t", ["fio2"], tolerance=limit, tiebreak=["resp_id"])
    p = p.withColumn("p_f", Z.pf(F.col("value"), F.col("fio2")))
    return p.where("p_f IS NOT NULL").groupBy("user_id").agg(r(F.min("p_f"), 3).alias("worst_pf"), F.min_by("event_id", F.struct("p_f", "event_id")).alias("worst_id"))


def _worst(s, d):
    w = M.extremes(ev(s, d), ["user_id"], "event_type", "value", ["error", "purchase"], ["click", "view", "signup"])
    return w.select("user_id", (F.col("click") * 10).alias("platelet_count"), (F.col("error") / 8).alias("bilirubin_total"), (F.col("purchase") / 20).alias("creatinine"), (F.col("view") * 5 + 60).alias("p_f"), F.when(F.col("view") < 10, "imv").otherwise("room air").alias("device_category"), (F.col("signup") + 60).alias("map"))


def f25(s, d):
    return Z.sofa(_worst(s, d)).select("user_id", *Z.SUBSCORES, "sofa_total")


def f26(s, d):
    v = ev(s, d).select("user_id", "ts", "event_id", F.when(F.col("event_type") == "click", "height_cm").when(F.col("event_type") == "view", "weight_kg").alias("cat"), F.when(F.col("event_type") == "click", F.col("value") * 3).otherwise(F.col("value")).alias("v"))
    return Z.body_mass_index(v, "user_id", "ts", "cat", "v", "event_id").select("user_id", r("height_cm", 3).alias("height_cm"), "weight_kg", r("bmi", 3).alias("bmi"))


def f27(s, d):
    return G.first_stay_window(ev(s, d).where("event_type = 'purchase'"), "user_id", "ts")


def f28(s, d):
    return G.ever(ev(s, d), "user_id", (F.col("event_type") == "error") & (F.col("value") > 30), "ever_bad")


def f29(s, d):
    stay = ev(s, d).groupBy("user_id").agg(F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"))
    flags = G.ever(ev(s, d), "user_id", (F.col("event_type") == "error") & (F.col("value") > 95), "died").join(G.ever(ev(s, d), "user_id", (F.col("event_type") == "purchase") & (F.col("value") > 98), "left"), "user_id")
    return R.left_chain(stay, [(flags, ["user_id"])]).withColumn("exit_mechanism", G.exit_mechanism([("died", "death"), ("left", "discharge")], "unknown"))


def _days(s, d):
    day = ev(s, d).groupBy("user_id", F.to_date("ts").alias("date")).agg(F.max((F.col("event_type") == "error").cast("int")).alias("bad"), r(F.avg("value")).alias("dose"), F.count("*").cast("int").alias("n"))
    return day.withColumn("day", (F.row_number().over(Window.partitionBy("user_id").orderBy("date")) - 1).cast("long"))


def f30(s, d):
    stay = ev(s, d).groupBy("user_id").agg(F.count("*").alias("n_stay"))
    return G.model_input(_days(s, d), "user_id", "day", ["bad"], [(stay, ["user_id"])])


def _outcomes(s, d):
    rows = _trial_rows(s, d).withColumns({"device_category": F.lower(F.trim("device_category")), "fio2_set": F.col("fio2_set") / 200})
    return rows, trials.trial_outcomes(rows, "user_id", "ts", _statuses(s, d), _discharges(s, d), ["event_id"], status_tiebreak=["event_id"])


def f31(s, d):
    rows, out = _outcomes(s, d)
    filled = rows.withColumn("tracheostomy", F.max("tracheostomy").over(S.running(["user_id"], ["ts", "event_id"])))
    return audits.funnel(rows, filled, out, "user_id", F.to_date("ts"))


def f31b(s, d):
    return audits.reclassified(_outcomes(s, d)[1], "user_id")


def f32(s, d):
    """Sections a to h: volume, exclusions over cut-offs, ages of values, round numbers, missing by group, jumps, spread, strategies."""
    e = ev(s, d)
    part = audits.section
    band = F.concat_ws("/", "event_type", F.coalesce("band", F.lit("none")))
    strategies = R.unpivot(A.d31(s, d), ["variable"], ["median", "p95"], "which")
    return audits.stacked([
        M.ledger(e, "a: values", {"rows": (F.count("*"), "rows"), "entities": (F.countDistinct("user_id"), "entities"), "share_over_50": (r(F.avg((F.col("value") > 50).cast("int"))), "share"), "median": (r(F.expr("percentile(value, 0.5)")), "value")}),
        part(A.d24(s, d), "b: cut-offs", F.col("cut").cast("int"), "n_excluded", "entities"),
        part(A.d25(s, d), "c: ages", F.col("age"), "n", "rows"),
        part(R.unpivot(A.d26(s, d), [], ["share_integer", "share_5", "share_10"]), "d: round numbers", F.col("variable"), "value", "share"),
        part(A.d27(s, d), "e: groups", band, "n", "rows"),
        M.ledger(S.jumps(e, ["user_id"], "ts", "value", 90.0, 6 * HOUR_US, ["event_id"]), "f: jumps", {"entities": (F.count("*"), "entities")}),
        M.ledger(S.wide_range(e, ["user_id"], "value", 99.0), "g: spread", {"entities": (F.count("*"), "entities")}),
        part(strategies, "h: strategies", F.concat_ws(" ", "variable", "which"), "value", "value"),
    ])


def f33(s, d):
    return L.night_windows(_bounds(s, d), "user_id", "a", "b", "America/Chicago").select("user_id", "night_start", "night_end")


def f34(s, d):
    e = ev(s, d)
    one = lambda cond, kind: e.where(cond).select("user_id", F.col("ts").alias("at"), F.lit(kind).alias("kind"), F.col("event_type").alias("label"))
    return R.union_by_name(one("event_type = 'error'", "failure"), one("event_type = 'purchase' AND value > 80", "large"), one("value > 99", "extreme"))


def f35(s, d):
    base = R.scaffold(ev(s, d).select("user_id", F.to_date("ts").alias("day")).distinct(), s.createDataFrame([("click",), ("view",)], "event_type string"))
    mean = ev(s, d).groupBy("user_id", F.to_date("ts").alias("day"), "event_type").agg(r(F.avg("value")).alias("mean_value"))
    return S.forward_fill(base.join(mean, ["user_id", "day", "event_type"], "left"), ["mean_value"], ["user_id", "event_type"], ["day"])


def f36(s, d):
    e = ev(s, d).select("event_id", "ts")
    return L.coerce_times(e, ["ts", "absent"], "America/Chicago").select("event_id", F.col("ts").alias("utc"))


def f37(s, d):
    e = ev(s, d).select("event_id", F.expr("CAST(date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS') || ' UTC' AS TIMESTAMP)").alias("t"))
    return L.coerce_times(e, ["t"], None).select("event_id", F.col("t").alias("utc"))


def f38(s, d):
    return L.add_local_hour(ev(s, d).select("event_id", "ts"), "ts", "America/Chicago").select("event_id", "_dh", "_hr")


def f39(s, d):
    return L.standardize_times(ev(s, d).select("event_id", "ts"), ["ts", "absent"], "America/Chicago", "minute").select("event_id", F.col("ts").alias("utc"))


def f40(s, d):
    e = ev(s, d).select("event_id", F.when(F.col("event_type") == "click", F.col("value")).alias("num"), F.when(F.col("event_type") == "view", F.floor("value").cast("string")).otherwise("n/a").alias("txt"), F.when(F.col("value") > 50, "imv").otherwise("room air").alias("dev"))
    return e.select("event_id", C.number_else_text(F.col("num"), "txt").alias("v"), C.lookup(F.col("dev"), Z.DEVICE_RANK).alias("rank"))


def f41(s, d):
    return rules.clean(ev(s, d), {"value": {"min": 50, "max": 100}}, {}).groupBy("event_type").agg(F.count("value").alias("n_kept"), F.count("*").alias("n"))


def f42(s, d):
    e, v, k = ev(s, d), F.col("value"), F.pmod("event_id", F.lit(8))
    windows = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("w0")).withColumn("w1", F.expr("w0 + INTERVAL 240 HOUR"))
    kinds = [("creatinine", v / 20), ("bilirubin_total", v / 8), ("platelet_count", v * 3), ("po2_arterial", v + 40), ("map", v / 2 + 50), ("gcs_total", F.floor(v / 9) + 4), ("norepinephrine", v / 500)]
    name, value = F.lit(None).cast("string"), F.lit(None).cast("double")
    for i, (n, x) in enumerate(kinds):
        name, value = F.when(k == i, n).otherwise(name), F.when(k == i, x).otherwise(value)
    observed = e.where(k < 7).select("user_id", "ts", "event_id", name.alias("category"), value.alias("value"))
    support = e.where(k != 3).select("user_id", "ts", "event_id", F.when(v > 60, "imv").when(v > 40, "nippv").when(v > 20, "nasal cannula").alias("device_category"),
        F.when(F.col("event_type") != "signup", F.when(v > 50, "a").otherwise("b")).alias("mode_category"), F.when(F.col("event_type") == "click", v / 100).alias("fio2_set"))
    out = Z.sofa_windowed(windows, observed, support, "user_id", "ts", "w0", "w1", ["event_id"])
    return out.select("user_id", *Z.SUBSCORES, "sofa_total", r("p_f", 3).alias("p_f"), "device_category")


def f43(s, d):
    o = t(s, d, "orders").withColumn("o_end", F.expr("o_orderdate + INTERVAL 2 DAY"))
    b = S.stitch(o, ["o_custkey"], "o_orderdate", "o_end", "o_orderkey", 60 * 24 * HOUR_US).withColumn("is_first", F.col("o_orderkey") == F.col("block_id"))
    lines = t(s, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    spans = lines.select("o_orderkey", F.expr("timestampdiff(HOUR, a, b)").alias("hours"))
    return audits.stitch_summary(b, ["o_custkey", "block_id"], spans, "o_orderkey", "hours")


def f44(s, d):
    return M.ledger(t(s, d, "lineitem"), "lines", {"rows": (F.count("*"), "rows"), "mean_quantity": (r(F.avg("l_quantity")), "units")})


CODES = ["I21.4", "i50", "E11.9", "E112", "C34.1", "C78", "K70.3", "Z00"]


def x01(s, d):
    from ..operators.comorbidity import charlson

    dx = ev(s, d).where("event_type IN ('error', 'signup')").select("user_id", F.element_at(F.array(*map(F.lit, CODES)), (F.col("event_id") % 8 + 1).cast("int")).alias("code"))
    return charlson(dx, "user_id", "code").select("user_id", "diabetes", "cancer", "metastatic", "cci_score")


DAYQ = "SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY date) - 1 AS BIGINT) AS day FROM (SELECT user_id, CAST(ts AS DATE) AS date, max(CAST(event_type = 'error' AS INTEGER)) AS bad, round(avg(value), 4) AS dose, CAST(count(*) AS INTEGER) AS n FROM events GROUP BY 1, 2)"
EXT = "SELECT user_id, min(value) FILTER (WHERE event_type = 'click') * 10 AS platelet_count, max(value) FILTER (WHERE event_type = 'error') / 8 AS bilirubin_total, max(value) FILTER (WHERE event_type = 'purchase') / 20 AS creatinine, min(value) FILTER (WHERE event_type = 'view') * 5 + 60 AS p_f, min(value) FILTER (WHERE event_type = 'view') AS vw, min(value) FILTER (WHERE event_type = 'signup') + 60 AS map FROM events {j} GROUP BY 1"
COAG = "CASE WHEN platelet_count < 20 THEN 4 WHEN platelet_count < 50 THEN 3 WHEN platelet_count < 100 THEN 2 WHEN platelet_count < 150 THEN 1 WHEN platelet_count >= 150 THEN 0 END"
LIVER = "CASE WHEN bilirubin_total >= 12 THEN 4 WHEN bilirubin_total >= 6 THEN 3 WHEN bilirubin_total >= 2 THEN 2 WHEN bilirubin_total >= 1.2 THEN 1 WHEN bilirubin_total < 1.2 THEN 0 END"
RENAL = "CASE WHEN creatinine >= 5 THEN 4 WHEN creatinine >= 3.5 THEN 3 WHEN creatinine >= 2 THEN 2 WHEN creatinine >= 1.2 THEN 1 WHEN creatinine < 1.2 THEN 0 END"
RESP = "CASE WHEN p_f < 100 AND vw < 10 THEN 4 WHEN p_f >= 100 AND p_f < 200 AND vw < 10 THEN 3 WHEN p_f >= 200 AND p_f < 300 THEN 2 WHEN p_f >= 300 AND p_f < 400 THEN 1 WHEN p_f >= 400 THEN 0 END"
PIECE = "event_type = 'signup'"
SUP = "value > 60 AND value <= 70"
PS, PEEP = "CASE WHEN event_id % 3 = 0 THEN 6.0 END", "CASE WHEN event_id % 2 = 0 THEN 5.0 END"
BROAD = f"CAST(CASE WHEN {PIECE} THEN 1 WHEN {SUP} AND coalesce({PEEP}, 999) <= 8 AND coalesce({PS}, 0) <= 8 THEN 1 ELSE 0 END AS INTEGER)"
UNIT = "CASE p_partkey % 5 WHEN 0 THEN 'mcg/kg/min' WHEN 1 THEN 'mg/hr' WHEN 2 THEN 'MCG / min' WHEN 3 THEN 'mg/kg/h' ELSE 'units/hr' END"
CONV = f"SELECT p_partkey, {UNIT} AS unit, CASE WHEN p_partkey % 5 = 4 THEN 'unknown mass' WHEN p_partkey % 5 IN (1, 2) AND p_size <= 10 THEN 'missing weight' ELSE 'success' END AS convert_status, CASE p_partkey % 5 WHEN 0 THEN p_retailprice WHEN 1 THEN CASE WHEN p_size > 10 THEN p_retailprice * 1000 / 60 / p_size END WHEN 2 THEN CASE WHEN p_size > 10 THEN p_retailprice / p_size END WHEN 3 THEN p_retailprice * 1000 / 60 ELSE p_retailprice END AS dose_converted FROM part"
MEDS = "SELECT user_id, event_id, ts AS admin_dttm, CASE WHEN event_id % 2 = 0 THEN 'propofol' ELSE 'fentanyl' END AS med_category, value / 10 AS med_dose, CASE WHEN event_type = 'error' THEN 'stop' ELSE 'going' END AS mar FROM events WHERE event_type <> 'signup'"
DEDUP = f"SELECT * FROM ({MEDS}) QUALIFY row_number() OVER (PARTITION BY user_id, admin_dttm, med_category ORDER BY CASE mar WHEN 'stop' THEN 8 ELSE 7 END, CASE WHEN med_dose > 0 THEN 1 ELSE 2 END, med_dose DESC NULLS LAST, event_id) = 1"
CONT = f"""WITH m AS (SELECT user_id, admin_dttm AS t, med_category AS c, CASE WHEN mar = 'stop' THEN 0.0 ELSE med_dose END AS x FROM ({DEDUP})),
b AS (SELECT user_id, date_trunc('hour', a + INTERVAL 48 HOUR) AS f, date_trunc('hour', b) AS l FROM (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1) WHERE a + INTERVAL 48 HOUR < b),
g AS (SELECT user_id, unnest(generate_series(f, l, INTERVAL 1 HOUR)) AS t FROM b),
ins AS (SELECT m.* FROM m JOIN b USING (user_id) WHERE t >= f AND t < l + INTERVAL 1 HOUR),
st AS (SELECT b.user_id, b.f AS t, c, arg_max(x, m.t) AS x FROM b JOIN m ON m.user_id = b.user_id AND m.t < b.f GROUP BY 1, 2, 3),
w AS (SELECT user_id, t, avg(x) FILTER (WHERE c = 'propofol') AS p, avg(x) FILTER (WHERE c = 'fentanyl') AS q FROM (SELECT * FROM ins UNION ALL SELECT * FROM st) GROUP BY 1, 2),
u AS (SELECT user_id, t, p, q FROM w FULL JOIN g USING (user_id, t)),
k AS (SELECT user_id, t, last_value(p IGNORE NULLS) OVER o AS p, last_value(q IGNORE NULLS) OVER o AS q, coalesce(epoch_us(lead(t) OVER (PARTITION BY user_id ORDER BY t)) - epoch_us(t), 0) / 60000000.0::DOUBLE AS m FROM u WINDOW o AS (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING))
SELECT user_id, date_trunc('hour', t) AS event_dttm, round(sum(coalesce(p, 0) * m), 3) AS propofol_cont, round(sum(coalesce(q, 0) * m), 3) AS fentanyl_cont FROM k GROUP BY 1, 2"""
PIV = "SELECT user_id, {f}(value) FILTER (WHERE event_type = 'click') AS click, {f}(value) FILTER (WHERE event_type = 'view') AS view, {f}(value) FILTER (WHERE event_type = 'error') AS error, {f}(value) FILTER (WHERE event_type = 'purchase') AS purchase, {f}(value) FILTER (WHERE event_type = 'signup') AS signup FROM events GROUP BY 1"
EVENT_STOP = "CASE WHEN event_type IN ('error','signup') THEN 1 ELSE 0 END"
STRICT = f"CAST(CASE WHEN {PIECE} THEN 1 WHEN {SUP} AND {PS} IS NULL AND {PEEP} = 5 THEN 1 WHEN {SUP} AND {PS} < 7 THEN 1 ELSE 0 END AS INTEGER)"
PRIMARY = f"CAST(CASE WHEN {PIECE} OR ({SUP} AND {PEEP} <= 8 AND {PS} <= 8) THEN 1 ELSE 0 END AS INTEGER)"
#: State machine in SQL over r (id, t, k: tiebreak, o: on, p: stop): columns a, b and c are the on, off and stop events.
MACHINE = """m1 AS (SELECT *, sum(CAST(p AS INTEGER)) OVER (PARTITION BY id ORDER BY t, k ROWS UNBOUNDED PRECEDING) AS ps FROM r),
m2 AS (SELECT *, row_number() OVER w AS rn, lag(o) OVER w AS po, lag(ps) OVER w AS pps FROM m1 WINDOW w AS (PARTITION BY id ORDER BY t, k)),
m3 AS (SELECT *, sum(CASE WHEN rn = 1 OR po <> o AND ps = 0 OR ps <> pps THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY t, k ROWS UNBOUNDED PRECEDING) AS run FROM m2),
m4 AS (SELECT id, run, o, min(rn) AS rn, max(t) - min(t) >= CASE WHEN o THEN INTERVAL 15 MINUTE ELSE INTERVAL 30 MINUTE END AND count(*) > 1 AS lg FROM m3 WHERE ps = 0 GROUP BY id, run, o),
m5 AS (SELECT *, coalesce(last_value(CASE WHEN lg THEN o END IGNORE NULLS) OVER (PARTITION BY id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS was, max(run) OVER (PARTITION BY id) = run AS final FROM m4),
m6 AS (SELECT DISTINCT id, true AS stopped FROM m1 WHERE p),
ev AS (SELECT m3.id, m3.t, m3.k, CAST(coalesce(m5.o AND m5.lg AND NOT m5.was, false) AS INTEGER) AS a,
    CAST(coalesce(NOT m5.o AND m5.was AND (m5.lg OR m5.final AND m6.stopped), false) OR coalesce(m3.p AND m3.ps = 1 AND m3.pps = 0 AND m3.po, false) AS INTEGER) AS b, CAST(m3.p AND m3.ps = 1 AS INTEGER) AS c
    FROM m3 LEFT JOIN m5 ON m5.id = m3.id AND m5.rn = m3.rn LEFT JOIN m6 ON m6.id = m3.id)"""
DONE = lambda cond: f"CAST(coalesce({cond}, false) AS INTEGER)"
EXIT_SQL = lambda x: f"e1{x} AS _extub_1st{x}, f{x} AS _fail_extub{x}, CAST(e1{x} = 1 AND coalesce(lim, false) AS INTEGER) AS _withdrawl_lst{x}, CAST(e1{x} = 1 AND NOT coalesce(lim, false) AND f{x} = 0 AS INTEGER) AS _success_extub{x}"
TRIALS = f"""WITH x AS (SELECT event_id AS k, user_id AS id, ts AS t, CASE WHEN value > 60 THEN 'imv' WHEN value > 40 THEN 'nasal cannula' WHEN value > 30 THEN 'room air' END AS dev,
    CASE WHEN value > 70 THEN 'pressure control' WHEN value > 60 THEN 'pressure support/cpap' WHEN value BETWEEN 20 AND 30 THEN 'simv' END AS md, CASE WHEN event_type = 'click' THEN value / 200 END AS fio2, {PEEP} AS peep,
    CAST(value > 98 AS INTEGER) AS tr, {PRIMARY} AS s1, {BROAD} AS s2, {STRICT} AS s3 FROM events),
y AS (SELECT *, row_number() OVER w AS rn, lag(s1) OVER w AS l1, lag(s2) OVER w AS l2, lag(s3) OVER w AS l3, lag(dev) OVER w AS ld, lag(md) OVER w AS lm, lag(tr) OVER w AS lt FROM x WINDOW w AS (PARTITION BY id ORDER BY t, k)),
z AS (SELECT *, CAST(coalesce(dev, '') = 'imv' AS INTEGER) AS imv, CAST(coalesce(dev, '') = 'imv' AND coalesce(ld, '') <> 'imv' AS INTEGER) AS inn, CAST(coalesce(dev, '') <> 'imv' AND coalesce(ld, '') = 'imv' AS INTEGER) AS ex,
    CAST(coalesce(lt = 0 AND tr = 1, false) AS INTEGER) AS fl, CAST(coalesce(lm IN ('pressure control', 'simv'), false) AS INTEGER) AS con,
    sum(CASE WHEN s1 IS DISTINCT FROM l1 THEN 1 ELSE 0 END) OVER w AS b1, sum(CASE WHEN s2 IS DISTINCT FROM l2 THEN 1 ELSE 0 END) OVER w AS b2, sum(CASE WHEN s3 IS DISTINCT FROM l3 THEN 1 ELSE 0 END) OVER w AS b3,
    sum(CASE WHEN rn = 1 OR (coalesce(dev, '') = 'imv') <> (coalesce(ld, '') = 'imv') THEN 1 ELSE 0 END) OVER w AS bi FROM y WINDOW w AS (PARTITION BY id ORDER BY t, k ROWS UNBOUNDED PRECEDING)),
g1 AS (SELECT id, b1, date_diff('minute', a, coalesce(lead(a) OVER (PARTITION BY id ORDER BY b1), l)) AS m1, c1 FROM (SELECT id, b1, min(t) AS a, max(t) AS l, max(con) AS c1 FROM z GROUP BY ALL)),
g2 AS (SELECT id, b2, date_diff('minute', min(t), max(t)) AS m2 FROM z GROUP BY ALL), g3 AS (SELECT id, b3, date_diff('minute', min(t), max(t)) AS m3 FROM z GROUP BY ALL),
gi AS (SELECT id, bi, min(t) AS ai FROM z GROUP BY ALL),
r AS (SELECT id, t, k, imv = 1 AS o, tr = 1 AS p FROM z), {MACHINE},
q AS (SELECT z.*, m1, m2, m3, c1, CASE WHEN imv = 1 THEN date_diff('minute', ai, z.t) END AS im, ev.a AS on2, ev.b AS off2, ev.c AS st2 FROM z JOIN g1 USING (id, b1) JOIN g2 USING (id, b2) JOIN g3 USING (id, b3) JOIN gi USING (id, bi) JOIN ev ON ev.k = z.k),
u AS (SELECT *, lag(im) OVER (PARTITION BY id ORDER BY t, k) AS lim6, CAST(ex = 1 AND sum(ex) OVER w = 1 AS INTEGER) AS e1, CAST(fl = 1 AND sum(fl) OVER w = 1 AS INTEGER) AS t1, CAST(off2 = 1 AND sum(off2) OVER w = 1 AS INTEGER) AS e1_v2,
    CAST(st2 = 1 AND sum(st2) OVER w = 1 AS INTEGER) AS t2 FROM q WINDOW w AS (PARTITION BY id ORDER BY t, k ROWS UNBOUNDED PRECEDING)),
v AS (SELECT u.*, CAST(e1 = 1 AND EXISTS (SELECT 1 FROM u n WHERE n.id = u.id AND n.inn = 1 AND n.t > u.t AND n.t <= u.t + INTERVAL 48 HOUR) AS INTEGER) AS f,
    CAST(e1_v2 = 1 AND EXISTS (SELECT 1 FROM u n WHERE n.id = u.id AND n.on2 = 1 AND n.t > u.t AND n.t <= u.t + INTERVAL 48 HOUR) AS INTEGER) AS f_v2 FROM u),
cs AS (SELECT u.k, arg_max(c.event_id % 3 = 0, (c.ts, c.event_id)) AS full_code FROM u JOIN events c ON c.user_id = u.id AND c.event_type = 'error' AND c.ts <= u.t GROUP BY 1),
o AS (SELECT v.*, NOT full_code AND id % 2 = 0 AS lim FROM v LEFT JOIN cs ON cs.k = v.k)
SELECT k AS event_id, {DONE('m1 >= 30 AND s1 = 1 AND l1 = 0 AND con = 1')} AS sbt_done, {DONE('m1 >= 30 AND s1 = 1 AND l1 = 0')} AS sbt_done_anyprior, {DONE('m1 >= 30 AND s1 = 1 AND l1 = 0 AND lim6 >= 360')} AS sbt_done_imv6h,
    {DONE('m1 >= 30 AND s1 = 1')} AS sbt_done_prefix, {DONE('m1 >= 30 AND s1 = 1 AND c1 = 1')} AS sbt_done_multiday, {DONE('m1 >= 2 AND s1 = 1 AND l1 = 0 AND con = 1')} AS sbt_done_2min,
    {DONE('m2 >= 30 AND s2 = 1 AND l2 = 0')} AS sbt_done_subira, {DONE('m3 >= 30 AND s3 = 1 AND l3 = 0')} AS sbt_done_abc, {DONE('m1 >= 2 AND s1 = 1 AND l1 = 0')} AS sbt_done_v2,
    {DONE('im >= 360 AND fio2 <= 0.5 AND peep <= 8')} AS sbt_elig, {EXIT_SQL('')}, {EXIT_SQL('_v2')}, t1 AS _trach_1st, t2 AS _trach_v2, m1 AS _block_minutes
FROM o WHERE tr = 0 OR t1 = 1 OR t2 = 1"""
F21 = f"WITH r AS (SELECT event_id AS k, user_id AS id, ts AS t, value > 50 AS o, value > 99.5 AS p FROM events), {MACHINE} SELECT k AS event_id, a AS _on_event, b AS _off_event, c AS _stop_event FROM ev"
EXIT = lambda x, t: f"CASE WHEN max({t}) = 1 THEN 'tracheostomy' WHEN max(_success_extub{x}) = 1 THEN 'successful extubation' WHEN max(_fail_extub{x}) = 1 THEN 'failed extubation' WHEN max(_withdrawl_lst{x}) = 1 THEN 'withdrawal' ELSE 'other' END"
OUTCOMES = f"WITH oc AS (SELECT e.user_id, e.ts, q.* FROM ({TRIALS}) q JOIN events e USING (event_id)), x2 AS (SELECT user_id, {EXIT('', '_trach_1st')} AS v1, {EXIT('_v2', '_trach_v2')} AS v2 FROM oc GROUP BY 1)"
LEDGER = lambda section, source, *rows: " UNION ALL ".join(f"SELECT '{section}' AS section, '{m}' AS metric, CAST({x} AS DOUBLE) AS value, '{u}' AS unit FROM {source}" for m, x, u in rows)
FUNNEL = f"""{OUTCOMES}, rw AS (SELECT user_id, ts, event_id, CAST(value > 98 AS INTEGER) AS tr FROM events), fl AS (SELECT user_id, max(tr) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS tr FROM rw),
dy AS (SELECT user_id, CAST(ts AS DATE) AS day, max(_trach_1st) AS a, max(_trach_v2) AS b FROM oc GROUP BY 1, 2)
{LEDGER('a: cohort', 'rw', ('rows', 'count(*)', 'rows'), ('entities', 'count(DISTINCT user_id)', 'entities'))} UNION ALL
{LEDGER('b: raw', 'rw', ('rows with it', 'sum(tr)', 'rows'), ('entities with it', 'count(DISTINCT user_id) FILTER (WHERE tr = 1)', 'entities'))} UNION ALL
{LEDGER('c: carried on', 'fl', ('rows with it', 'sum(tr)', 'rows'), ('entities with it', 'count(DISTINCT user_id) FILTER (WHERE tr = 1)', 'entities'))} UNION ALL
{LEDGER('d: events', 'oc', ('first changes', 'sum(_trach_1st)', 'rows'), ('entities v1', 'count(DISTINCT user_id) FILTER (WHERE _trach_1st = 1)', 'entities'), ('entities v2', 'count(DISTINCT user_id) FILTER (WHERE _trach_v2 = 1)', 'entities'))} UNION ALL
{LEDGER('e: days', 'dy', ('days', 'count(*)', 'days'), ('days v1', 'sum(a)', 'days'), ('days v2', 'sum(b)', 'days'))} UNION ALL
SELECT 'f: exits v1', v1, CAST(count(*) AS DOUBLE), 'entities' FROM x2 GROUP BY 2 UNION ALL SELECT 'f: exits v2', v2, CAST(count(*) AS DOUBLE), 'entities' FROM x2 GROUP BY 2"""
AUDIT = f"""{LEDGER('a: values', 'events', ('rows', 'count(*)', 'rows'), ('entities', 'count(DISTINCT user_id)', 'entities'), ('share_over_50', 'round(avg(CAST(value > 50 AS INTEGER)), 4)', 'share'), ('median', 'round(median(value), 4)', 'value'))}
UNION ALL SELECT 'b: cut-offs', CAST(CAST(cut AS INTEGER) AS VARCHAR), CAST(n_excluded AS DOUBLE), 'entities' FROM ({A.CASES['d24_cutoffs'][1]})
UNION ALL SELECT 'c: ages', age, CAST(n AS DOUBLE), 'rows' FROM ({A.CASES['d25_staleness'][1]})
UNION ALL SELECT 'd: round numbers', k, v, 'share' FROM (UNPIVOT ({A.CASES['d26_round_numbers'][1]}) ON share_integer, share_5, share_10 INTO NAME k VALUE v)
UNION ALL SELECT 'e: groups', event_type || '/' || coalesce(band, 'none'), CAST(n AS DOUBLE), 'rows' FROM ({A.CASES['d27_null_groups'][1]})
UNION ALL SELECT 'f: jumps', 'entities', CAST(count(*) AS DOUBLE), 'entities' FROM ({ORDERED['e23_jumps'][1]})
UNION ALL SELECT 'g: spread', 'entities', CAST(count(*) AS DOUBLE), 'entities' FROM ({ORDERED['e24_wide_range'][1]})
UNION ALL SELECT 'h: strategies', variable || ' ' || k, v, 'value' FROM (UNPIVOT ({A.CASES['d31_strategies'][1]}) ON median, p95 INTO NAME k VALUE v)"""
WINDOWED = f"""WITH w AS (SELECT user_id, min(ts) AS w0, min(ts) + INTERVAL 240 HOUR AS w1 FROM events WHERE event_type = 'signup' GROUP BY 1),
i AS (SELECT e.user_id, ts, event_id, value AS v, event_id % 8 AS k FROM events e JOIN w USING (user_id) WHERE ts BETWEEN w0 AND w1),
m AS (SELECT user_id, max(v / 20) FILTER (WHERE k = 0) AS creatinine, max(v / 8) FILTER (WHERE k = 1) AS bilirubin_total, min(v * 3) FILTER (WHERE k = 2) AS platelet_count, min(v / 2 + 50) FILTER (WHERE k = 4) AS map, min(floor(v / 9) + 4) FILTER (WHERE k = 5) AS g, max(v / 500) FILTER (WHERE k = 6) AS nor FROM i GROUP BY 1),
s0 AS (SELECT e.user_id, ts, event_id, w0, CASE WHEN value > 60 THEN 'imv' WHEN value > 40 THEN 'nippv' WHEN value > 20 THEN 'nasal cannula' END AS dev, CASE WHEN event_type <> 'signup' THEN CASE WHEN value > 50 THEN 'a' ELSE 'b' END END AS md, CASE WHEN event_type = 'click' THEN value / 100 END AS f
    FROM events e JOIN w USING (user_id) WHERE event_id % 8 <> 3 AND ts BETWEEN w0 - INTERVAL 24 HOUR AND w1),
s1 AS (SELECT * REPLACE (last_value(dev IGNORE NULLS) OVER o AS dev) FROM s0 WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
s2 AS (SELECT *, CASE WHEN dev IS DISTINCT FROM lag(dev) OVER o THEN 1 ELSE 0 END AS c FROM s1 WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
s3 AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS db FROM s2),
s4 AS (SELECT * REPLACE (last_value(md IGNORE NULLS) OVER (PARTITION BY user_id, db ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS md) FROM s3),
s5 AS (SELECT *, CASE WHEN dev IS DISTINCT FROM lag(dev) OVER o OR md IS DISTINCT FROM lag(md) OVER o THEN 1 ELSE 0 END AS c2 FROM s4 WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
s6 AS (SELECT *, sum(c2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS mb FROM s5),
s7 AS (SELECT * REPLACE (last_value(f IGNORE NULLS) OVER (PARTITION BY user_id, mb ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS f) FROM s6),
s8 AS (SELECT user_id, ts, event_id, dev, CASE WHEN f BETWEEN 0.21 AND 1 THEN f END AS f FROM s7 WHERE ts >= w0),
po AS (SELECT i.event_id AS k, i.user_id, i.ts, i.v + 40 AS v, arg_max(struct_pack(f := s8.f, dev := s8.dev, at := s8.ts), (s8.ts, s8.event_id)) AS r FROM i JOIN s8 ON s8.user_id = i.user_id AND s8.ts <= i.ts WHERE i.k = 3 GROUP BY 1, 2, 3, 4),
pf AS (SELECT user_id, min(p) AS p_f, arg_min(dev, (p, ts, k)) AS dev FROM (SELECT user_id, ts, k, v / r.f AS p, r.dev AS dev FROM po WHERE ts - r.at <= INTERVAL 240 MINUTE AND r.f IS NOT NULL) GROUP BY 1),
z AS (SELECT w.user_id, m.* EXCLUDE (user_id), p_f, dev AS device_category, CASE WHEN dev IN ('imv', 'nippv') THEN 1 ELSE 99 END AS vw FROM w LEFT JOIN m USING (user_id) LEFT JOIN pf USING (user_id)),
u AS (SELECT user_id, coalesce(CASE WHEN nor > 0.1 THEN 4 WHEN nor <= 0.1 THEN 3 WHEN map < 70 THEN 1 END, 0) AS sofa_cv, coalesce({COAG}, 0) AS sofa_coag, coalesce({LIVER}, 0) AS sofa_liver, coalesce({RESP}, 0) AS sofa_resp,
    coalesce(CASE WHEN g < 6 THEN 4 WHEN g BETWEEN 6 AND 9 THEN 3 WHEN g BETWEEN 10 AND 12 THEN 2 WHEN g BETWEEN 13 AND 14 THEN 1 END, 0) AS sofa_cns, coalesce({RENAL}, 0) AS sofa_renal, round(p_f, 3) AS p_f, device_category FROM z)
SELECT *, sofa_cv + sofa_coag + sofa_liver + sofa_resp + sofa_cns + sofa_renal AS sofa_total FROM u"""
STITCH = f"""WITH a AS (SELECT *, CASE WHEN max(o_orderdate + INTERVAL 2 DAY) OVER w IS NULL OR o_orderdate - max(o_orderdate + INTERVAL 2 DAY) OVER w >= INTERVAL 60 DAY THEN 1 ELSE 0 END AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT o_orderkey, o_custkey, n, sum(n) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS k FROM a), z AS (SELECT count(*) AS size FROM b GROUP BY o_custkey, k),
h AS (SELECT l_orderkey, date_sub('hour', min(l_shipdate), max(l_shipdate)) AS h FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), l AS (SELECT h FROM b LEFT JOIN h ON l_orderkey = o_orderkey WHERE n = 0)
{LEDGER('block size', 'z', ('blocks', 'count(*)', 'blocks'), ('of one', 'count(*) FILTER (WHERE size = 1)', 'blocks'), ('of two', 'count(*) FILTER (WHERE size = 2)', 'blocks'), ('of more', 'count(*) FILTER (WHERE size > 2)', 'blocks'), ('mean', 'round(avg(size), 4)', 'blocks'), ('sd', 'round(stddev_samp(size), 4)', 'blocks'), ('least', 'min(size)', 'blocks'), ('most', 'max(size)', 'blocks'))} UNION ALL
{LEDGER('later stays', 'l', ('stays', 'count(*)', 'stays'), ('no support', 'count(*) FILTER (WHERE h IS NULL)', 'stays'), ('under 24 h', 'count(*) FILTER (WHERE h < 24)', 'stays'), ('24 h or more', 'count(*) FILTER (WHERE h >= 24)', 'stays'))}"""
CHANGE = lambda name, source, cond: f"SELECT *, sum(_c) OVER (PARTITION BY user_id ORDER BY ts, is_scaffold, event_id ROWS UNBOUNDED PRECEDING) AS {name} FROM (SELECT *, CASE WHEN row_number() OVER o = 1 OR {cond} THEN 1 ELSE 0 END AS _c FROM {source} WINDOW o AS (PARTITION BY user_id ORDER BY ts, is_scaffold, event_id))"
DIFFERS = lambda *cols: " OR ".join(f"{c} IS DISTINCT FROM lag({c}) OVER o" for c in cols)
BOTH = lambda c, part: f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY user_id, {part} ORDER BY ts, is_scaffold, event_id ROWS UNBOUNDED PRECEDING), first_value({c} IGNORE NULLS) OVER (PARTITION BY user_id, {part} ORDER BY ts, is_scaffold, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"
BESIDE = lambda kind: f"(coalesce(lag(dc) OVER o = '{kind}', false) OR coalesce(lead(dc) OVER o = '{kind}', false))"
RULE = lambda name, source, cond, sets: f"{name} AS (SELECT * EXCLUDE (_r) REPLACE ({sets}) FROM (SELECT *, coalesce({cond}, false) AS _r FROM {source} WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)))"
IMV = "CASE WHEN _r THEN 'imv' ELSE dc END AS dc, CASE WHEN _r THEN (SELECT imv FROM nm) ELSE dn END AS dn"
SETS = ("fio2_set", "lpm_set", "peep_set", "tidal_volume_set", "pressure_support_set", "resp_rate_set", "peak_inspiratory_pressure_set")
FULL = f"""WITH r0 AS (SELECT user_id, date_trunc('hour', ts) AS ts, event_id, CASE WHEN value > 75 THEN 'imv' WHEN value > 60 THEN 'nippv' WHEN value > 45 THEN 'trach collar' WHEN value > 35 THEN 'room air' END AS dc,
    CASE event_id % 7 WHEN 0 THEN 'simv' WHEN 1 THEN 'pressure support/cpap' WHEN 2 THEN 'assist control-volume control' END AS mc, event_id % 3 = 0 AS x3, event_id % 2 = 0 AS x2, event_id % 4 = 0 AS x4, value AS v, event_type FROM events),
r1 AS (SELECT user_id, ts, event_id, dc, CASE WHEN event_type = 'signup' THEN 't-piece' WHEN event_id % 11 = 0 THEN 'trach mask' WHEN dc IS NOT NULL AND x3 THEN 'dev ' || event_id % 2 END AS dn, mc, CASE WHEN mc IS NOT NULL AND x4 THEN 'm ' || event_id % 5 END AS mn,
    CASE WHEN x3 THEN CASE WHEN v > 1 AND (SELECT avg(v) FROM r0 WHERE x3) > 1 THEN v / 100 ELSE v END END AS fio2_set, CASE WHEN x4 THEN v / 8 END AS lpm_set, CASE WHEN x2 THEN v / 10 END AS peep_set, CASE WHEN x2 THEN v * 5 END AS tidal_volume_set, CASE WHEN x3 THEN v / 8 END AS pressure_support_set,
    CASE WHEN x4 THEN v / 5 END AS resp_rate_set, CASE WHEN x3 THEN v / 3 END AS peak_inspiratory_pressure_set, CASE WHEN event_id % 9 = 0 THEN CAST(v > 50 AS INTEGER) END AS tracheostomy FROM r0),
nm AS (SELECT (SELECT dn FROM r1 WHERE dc = 'imv' AND dn IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS imv, (SELECT dn FROM r1 WHERE dc = 'nippv' AND dn IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS nippv,
    (SELECT mn FROM r1 WHERE mc = 'assist control-volume control' AND mn IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS cmv),
{RULE('r2', 'r1', "dc IS NULL AND dn IS NULL AND mc IN ('simv', 'assist control-volume control')", IMV)},
{RULE('r3', 'r2', "dc = 'imv' AND dn IS NULL", "CASE WHEN _r THEN (SELECT imv FROM nm) ELSE dn END AS dn")},
{RULE('r4', 'r3', f"dc IS NULL AND {BESIDE('imv')} AND peep_set > 1 AND resp_rate_set > 1 AND tidal_volume_set > 1", IMV)},
{RULE('r5', 'r4', f"dc IS NULL AND {BESIDE('nippv')} AND peak_inspiratory_pressure_set > 1 AND pressure_support_set > 1", "CASE WHEN _r THEN 'nippv' ELSE dc END AS dc, CASE WHEN _r THEN coalesce(dn, (SELECT nippv FROM nm)) ELSE dn END AS dn")},
{RULE('r6', 'r5', f"dc IS NULL AND NOT coalesce(contains(dn, 'trach'), false) AND {BESIDE('imv')} AND tidal_volume_set > 0 AND resp_rate_set > 0", IMV + ", CASE WHEN _r AND mc IS NULL THEN (SELECT cmv FROM nm) ELSE mn END AS mn, CASE WHEN _r AND mc IS NULL THEN 'assist control-volume control' ELSE mc END AS mc")},
c1 AS (SELECT * FROM r6 QUALIFY NOT (count(*) OVER (PARTITION BY user_id, ts) > 1 AND coalesce(dc, '') = 'nippv')), c2 AS (SELECT * FROM c1 QUALIFY NOT (count(*) OVER (PARTITION BY user_id, ts) > 1 AND dc IS NULL)),
c3 AS (SELECT * FROM c2 WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY NOT coalesce(dc = 'nippv' AND lead(dc) OVER o = 'trach collar' AND lag(dc) OVER o IS DISTINCT FROM 'nippv', false)),
c4 AS (SELECT * FROM c3 WHERE coalesce(dc, dn, mc, mn) IS NOT NULL OR coalesce(tracheostomy, {', '.join(SETS)}) IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) = 1),
g AS (SELECT user_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) + INTERVAL '59 minutes 59 seconds' AS ts, true AS is_scaffold FROM r1 GROUP BY user_id),
u0 AS (SELECT *, false AS is_scaffold FROM c4 UNION ALL BY NAME SELECT * FROM g),
u1 AS (SELECT * REPLACE (last_value(dc IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, is_scaffold, event_id ROWS UNBOUNDED PRECEDING) AS dc) FROM u0),
u2 AS ({CHANGE('i1', 'u1', DIFFERS('dc'))}), u3 AS (SELECT * EXCLUDE (_c) REPLACE ({BOTH('dn', 'i1')}) FROM u2), u4 AS ({CHANGE('i2', 'u3', DIFFERS('dn'))}), u5 AS (SELECT * EXCLUDE (_c) REPLACE ({BOTH('mc', 'i2')}) FROM u4),
u6 AS ({CHANGE('i3', 'u5', DIFFERS('i2', 'mc'))}), u7 AS (SELECT * EXCLUDE (_c) REPLACE ({BOTH('mn', 'i3')}) FROM u6), u8 AS ({CHANGE('i4', 'u7', DIFFERS('i3', 'mn'))}),
u9 AS (SELECT * EXCLUDE (_c) REPLACE (CASE WHEN fio2_set IS NULL AND dc = 'room air' THEN 0.21 ELSE fio2_set END AS fio2_set, CASE WHEN coalesce(mc = 'pressure support/cpap' AND pressure_support_set IS NOT NULL, false) OR mc IS NULL AND coalesce(contains(dn, 'trach'), false) OR coalesce(mc = 'pressure support/cpap' AND contains(dn, 'trach'), false) THEN NULL ELSE tidal_volume_set END AS tidal_volume_set),
    sum(CAST(coalesce(dc = 'trach collar', false) AS INTEGER)) OVER (PARTITION BY user_id, i4 ORDER BY ts, is_scaffold, event_id ROWS UNBOUNDED PRECEDING) AS k FROM u8),
z AS (SELECT * REPLACE ({', '.join(BOTH(c, 'i4, k') for c in SETS)}) FROM u9)
SELECT user_id, ts, event_id, is_scaffold, dc AS device_category, dn AS device_name, CASE WHEN mc IS NULL AND coalesce(contains(dn, 't-piece'), false) THEN 'blow by' ELSE mc END AS mode_category, mn AS mode_name,
    CAST(i1 AS BIGINT) AS device_category_id, CAST(i2 AS BIGINT) AS device_name_id, CAST(i3 AS BIGINT) AS mode_category_id, CAST(i4 AS BIGINT) AS mode_name_id, {', '.join(f"round({c}, 6) AS {c}" for c in SETS)},
    last_value(tracheostomy IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, is_scaffold, event_id ROWS UNBOUNDED PRECEDING) AS tracheostomy FROM z"""
W_TS = "PARTITION BY user_id ORDER BY ts"
ALONG = lambda c, part: f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY user_id, {part} ORDER BY ts ROWS UNBOUNDED PRECEDING), first_value({c} IGNORE NULLS) OVER (PARTITION BY user_id, {part} ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"
SHORT = f"""WITH r0 AS (SELECT user_id, ts, event_id, CASE WHEN value > 60 THEN 'imv' WHEN value > 40 THEN 'nasal cannula' WHEN value > 30 THEN 'room air' WHEN value BETWEEN 20 AND 30 THEN 'imv' END AS dc,
    CASE WHEN value > 70 THEN 'pressure control' WHEN value > 60 THEN 'pressure support/cpap' WHEN value BETWEEN 20 AND 30 THEN 'simv' END AS mc,
    CASE WHEN event_type = 'click' THEN CASE WHEN (SELECT avg(value) FROM events WHERE event_type = 'click') > 1 THEN value / 100 ELSE value END END AS fio2, CASE WHEN event_type = 'purchase' THEN value / 8 END AS lpm, CAST(value > 98 AS INTEGER) AS tr, event_type <> 'signup' AS has FROM events),
r1 AS (SELECT * FROM r0 QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY has DESC, dc NULLS LAST, event_id) = 1),
r2 AS (SELECT * REPLACE (CASE WHEN dc IS NULL AND lag(dc) OVER o = lead(dc) OVER o THEN lag(dc) OVER o ELSE dc END AS dc) FROM r1 WINDOW o AS ({W_TS})),
r3 AS (SELECT * REPLACE (last_value(dc IGNORE NULLS) OVER ({W_TS} ROWS UNBOUNDED PRECEDING) AS dc) FROM r2),
r4 AS (SELECT *, CASE WHEN row_number() OVER o = 1 OR dc IS DISTINCT FROM lag(dc) OVER o THEN 1 ELSE 0 END AS c1 FROM r3 WINDOW o AS ({W_TS})), r5 AS (SELECT *, sum(c1) OVER ({W_TS} ROWS UNBOUNDED PRECEDING) AS i1 FROM r4),
r6 AS (SELECT * REPLACE ({ALONG('mc', 'i1')}) FROM r5),
r7 AS (SELECT *, CASE WHEN row_number() OVER o = 1 OR dc IS DISTINCT FROM lag(dc) OVER o OR mc IS DISTINCT FROM lag(mc) OVER o THEN 1 ELSE 0 END AS c2 FROM r6 WINDOW o AS ({W_TS})), r8 AS (SELECT *, sum(c2) OVER ({W_TS} ROWS UNBOUNDED PRECEDING) AS i2 FROM r7),
r9 AS (SELECT * REPLACE ({ALONG('fio2', 'i2')}, {ALONG('lpm', 'i2')}) FROM r8)
SELECT user_id, ts, dc AS device_category, mc AS mode_category, round(CASE WHEN fio2 IS NOT NULL THEN fio2 WHEN dc = 'room air' THEN 0.21 WHEN dc = 'nasal cannula' AND round_even(lpm, 0) BETWEEN 1 AND 10 THEN 0.2 + 0.04 * round_even(lpm, 0) END, 4) AS fio2_set,
    CAST(i2 AS BIGINT) AS mode_category_id, max(tr) OVER ({W_TS} ROWS UNBOUNDED PRECEDING) AS tracheostomy FROM r9"""
CASES = {
    "f01_pivot_avg": (f01, "SELECT user_id, CAST(ts AS DATE) AS day, round(avg(value) FILTER (WHERE event_type = 'click'), 4) AS click, round(avg(value) FILTER (WHERE event_type = 'view'), 4) AS view, round(avg(value) FILTER (WHERE event_type = 'error'), 4) AS error FROM events GROUP BY 1, 2"),
    "f02_pivot_max": (f02, PIV.format(f="max")),
    "f03_unpivot": (f03, "SELECT p_partkey, 'p_size' AS variable, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part"),
    "f04_set_ops": (f04, "SELECT * FROM (SELECT DISTINCT user_id, 1 AS clicked, NULL::INTEGER AS failed FROM events WHERE event_type = 'click' UNION SELECT user_id, NULL, 1 FROM events WHERE event_type = 'error') WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup')"),
    "f05_dose_units": (f05, f"SELECT p_partkey, convert_status, round(dose_converted, 4) AS dose_converted, CASE WHEN convert_status IN ('success', 'missing weight') THEN 'mcg/kg/min' ELSE unit END AS unit_converted FROM ({CONV})"),
    "f05_unit_counts": (f05b, f"SELECT unit, convert_status, count(*) AS n, count(dose_converted) AS n_converted FROM ({CONV}) GROUP BY 1, 2"),
    "f06_outliers": (f06, "SELECT event_id, CASE WHEN event_type = 'click' THEN CASE WHEN value BETWEEN 5 AND 90 THEN value END WHEN event_type = 'purchase' THEN CASE WHEN value BETWEEN 0 AND 50 THEN value END ELSE value END AS value FROM events"),
    "f06_outliers_by_pair": (f06b, "SELECT l_returnflag, l_linestatus, count(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND NOT l_quantity BETWEEN 2 AND 40 THEN NULL WHEN l_returnflag = 'N' AND l_linestatus = 'O' AND NOT l_quantity BETWEEN 5 AND 45 THEN NULL ELSE l_quantity END) AS n_kept, count(*) AS n FROM lineitem GROUP BY 1, 2"),
    "f06_drop_counts": (f06c, "SELECT 'c_acctbal' AS \"column\", count(c_acctbal) AS n_before, count(*) FILTER (WHERE c_acctbal BETWEEN 0 AND 5000) AS n_after, count(c_acctbal) - count(*) FILTER (WHERE c_acctbal BETWEEN 0 AND 5000) AS n_dropped FROM customer"),
    "f07_waterfall": (f07, SHORT),
    "f07_waterfall_full": (f07b, FULL),
    "f08_normalize": (f08, "SELECT o_orderkey, lower(trim(o_orderpriority)) AS o_orderpriority FROM orders"),
    "f09_actions": (f09, f"SELECT event_id, CAST({EVENT_STOP} AS INTEGER) AS stop_by_category, CAST({EVENT_STOP} AS INTEGER) AS stop_by_name, CAST(event_type <> 'signup' AS INTEGER) AS given FROM events"),
    "f10_fio2_from_flow": (f10, "SELECT event_id, dev AS device, CAST(round(CASE WHEN event_type = 'click' THEN value / 100 WHEN dev = 'room air' THEN 0.21 WHEN dev = 'nasal cannula' AND event_type = 'purchase' AND round_even(value / 8, 0) BETWEEN 1 AND 10 THEN 0.20 + 0.04 * round_even(value / 8, 0) END, 4) AS DOUBLE) AS fio2 FROM (SELECT *, CASE WHEN value > 60 THEN 'imv' WHEN value > 40 THEN 'nasal cannula' WHEN value > 30 THEN 'room air' WHEN value BETWEEN 20 AND 30 THEN 'imv' END AS dev FROM events)"),
    "f11_exclusions": (f11, "WITH k AS (SELECT * FROM events WHERE event_type = 'click' AND value BETWEEN 5 AND 95), a AS (SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM k)), j AS (SELECT user_id FROM (SELECT user_id, abs(value - lag(value) OVER w) AS dv, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS dt FROM k WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE dt < 24 * 3600000000 GROUP BY 1 HAVING max(dv) > 60), s AS (SELECT user_id FROM k GROUP BY 1 HAVING max(value) - min(value) > 88) SELECT user_id, 'no_valid_value' AS reason FROM a UNION ALL SELECT user_id, 'jump' FROM j UNION ALL SELECT user_id, 'range' FROM s WHERE user_id NOT IN (SELECT user_id FROM j)"),
    "f12_flow": (f12, "WITH n AS (SELECT count(*) AS a, count(*) FILTER (WHERE o_orderstatus = 'F') AS b, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice > 100000) AS c, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice > 100000 AND o_orderpriority = '1-URGENT') AS d FROM orders) SELECT 0 AS step, 'all' AS label, a AS n_remaining, CAST(0 AS BIGINT) AS n_excluded FROM n UNION ALL SELECT 1, 'filled', b, a - b FROM n UNION ALL SELECT 2, 'large', c, b - c FROM n UNION ALL SELECT 3, 'urgent', d, c - d FROM n"),
    "f13_long_exposure": (f13, f"WITH x AS (SELECT user_id, ts, value, (coalesce(lead(epoch_us(ts)) OVER w, epoch_us(ts)) - epoch_us(ts)) / 60000000.0::DOUBLE AS m FROM events WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT g.user_id, g._nth_day, round(sum(CASE WHEN x.value > 0 THEN x.m ELSE 0 END), 2) AS total_minutes FROM ({SHIFT}) g ASOF LEFT JOIN x ON g.user_id = x.user_id AND g.event_dttm >= x.ts GROUP BY 1, 2 HAVING sum(CASE WHEN x.value > 0 THEN x.m ELSE 0 END) > 6000"),
    "f14_continuous": (f14, CONT),
    "f15_bolus": (f15, f"SELECT user_id, date_trunc('hour', admin_dttm) AS event_dttm, round(sum(med_dose) FILTER (WHERE med_category = 'propofol'), 4) AS propofol_bolus, round(sum(med_dose) FILTER (WHERE med_category = 'fentanyl'), 4) AS fentanyl_bolus FROM ({DEDUP}) GROUP BY 1, 2"),
    "f16_equivalents": (f16, f"SELECT user_id, round(coalesce(click, 0) + 50 * coalesce(view, 0), 3) AS opioid, round(coalesce(error, 0) * (2.0::DOUBLE / 60), 3) AS benzo FROM ({PIV.format(f='sum')})"),
    "f17_nee": (f17, f"SELECT user_id, round(coalesce(click, 0) + coalesce(view, 0) + coalesce(error, 0) / 10 + coalesce(signup, 0) / 100 + coalesce(purchase, 0) * 2.5, 4) AS nee FROM ({PIV.format(f='max')})"),
    "f18_trial_states": (f18, f"SELECT event_id, CAST(CASE WHEN {PIECE} OR ({SUP} AND {PEEP} <= 8 AND {PS} <= 8) THEN 1 ELSE 0 END AS INTEGER) AS state_primary, {BROAD} AS state_broad, CAST(CASE WHEN {PIECE} THEN 1 WHEN {SUP} AND {PS} IS NULL AND {PEEP} = 5 THEN 1 WHEN {SUP} AND {PS} < 7 THEN 1 ELSE 0 END AS INTEGER) AS state_strict FROM events"),
    "f19_trial_outcomes": (f19, TRIALS),
    "f20_roll_up": (f20, f"SELECT g.user_id, g._nth_day, coalesce(max(CAST(e.event_type = 'error' AS INTEGER)), 0) AS bad, coalesce(max(CAST(e.event_type = 'purchase' AS INTEGER)), 0) AS bought FROM ({SHIFT}) g LEFT JOIN events e ON e.user_id = g.user_id AND date_trunc('hour', e.ts) = g.event_dttm GROUP BY 1, 2"),
    "f21_state_machine": (f21, F21),
    "f22_pao2": (f22, "SELECT event_id, CASE WHEN value > 0 AND value < 97 THEN round(pow(sqrt(125000.0::DOUBLE + pow(11700.0::DOUBLE / (100.0::DOUBLE / value - 1), 2)) + 11700.0::DOUBLE / (100.0::DOUBLE / value - 1), 1.0::DOUBLE / 3) - pow(sqrt(125000.0::DOUBLE + pow(11700.0::DOUBLE / (100.0::DOUBLE / value - 1), 2)) - 11700.0::DOUBLE / (100.0::DOUBLE / value - 1), 1.0::DOUBLE / 3), 3) END AS pao2 FROM events"),
    "f23_rice": (f23, "SELECT event_id, CASE WHEN value <= 97 THEN round((value / 0.4::DOUBLE - 64) / 0.84::DOUBLE, 3) END AS pf FROM events"),
    "f24_concurrent_pf": (f24, "WITH p AS (SELECT l.event_id, l.user_id, CASE WHEN l.ts - r.ts <= INTERVAL 240 MINUTE THEN l.value / (r.value / 100) END AS p_f FROM (SELECT * FROM events WHERE event_type = 'view') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click' AND value >= 21) r ON l.user_id = r.user_id AND l.ts >= r.ts) SELECT user_id, round(min(p_f), 3) AS worst_pf, first(event_id ORDER BY p_f, event_id) AS worst_id FROM p WHERE p_f IS NOT NULL GROUP BY 1"),
    "f25_sofa": (f25, f"WITH x AS ({EXT.format(j='')}), y AS (SELECT user_id, CASE WHEN map < 70 THEN 1 WHEN map >= 70 THEN 0 END AS sofa_cv, {COAG} AS sofa_coag, {LIVER} AS sofa_liver, {RESP} AS sofa_resp, NULL::INTEGER AS sofa_cns, {RENAL} AS sofa_renal FROM x) SELECT *, coalesce(sofa_cv, 0) + coalesce(sofa_coag, 0) + coalesce(sofa_liver, 0) + coalesce(sofa_resp, 0) + coalesce(sofa_renal, 0) AS sofa_total FROM y"),
    "f26_bmi": (f26, "WITH h AS (SELECT user_id, first(value * 3 ORDER BY ts, event_id) AS h FROM events WHERE event_type = 'click' AND value * 3 BETWEEN 50 AND 250 GROUP BY 1), w AS (SELECT user_id, first(value ORDER BY ts, event_id) AS w FROM events WHERE event_type = 'view' AND value > 0 GROUP BY 1) SELECT user_id, round(h, 3) AS height_cm, w AS weight_kg, round(w / pow(h / 100, 2), 3) AS bmi FROM h FULL JOIN w USING (user_id)"),
    "f27_first_window": (f27, "SELECT user_id, min(ts) AS window_start, min(ts) + INTERVAL 24 HOUR AS window_end FROM events WHERE event_type = 'purchase' GROUP BY 1"),
    "f28_ever": (f28, "SELECT user_id, max(CASE WHEN event_type = 'error' AND value > 30 THEN 1 ELSE 0 END) AS ever_bad FROM events GROUP BY 1"),
    "f29_stay_registry": (f29, "WITH x AS (SELECT user_id, count(*) AS n_rows, min(ts) AS first_ts, max(CASE WHEN event_type = 'error' AND value > 95 THEN 1 ELSE 0 END) AS died, max(CASE WHEN event_type = 'purchase' AND value > 98 THEN 1 ELSE 0 END) AS \"left\" FROM events GROUP BY 1) SELECT *, CASE WHEN died = 1 THEN 'death' WHEN \"left\" = 1 THEN 'discharge' ELSE 'unknown' END AS exit_mechanism FROM x"),
    "f30_model_input": (f30, f"SELECT * FROM (SELECT x.*, n_stay, lead(bad) OVER (PARTITION BY x.user_id ORDER BY day) AS bad_next_day FROM ({DAYQ}) x JOIN (SELECT user_id, count(*) AS n_stay FROM events GROUP BY 1) s USING (user_id)) WHERE day > 0 AND bad_next_day IS NOT NULL"),
    "f31_funnel_audit": (f31, FUNNEL),
    "f31_reclassified": (f31b, f"{OUTCOMES} SELECT v1, v2, count(*) AS n FROM x2 GROUP BY 1, 2"),
    "f32_audit": (f32, AUDIT),
    "f33_night_windows": (f33, "WITH b AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1), n AS (SELECT user_id, a, b, unnest(generate_series(CAST(CAST(a - INTERVAL 6 HOUR AS DATE) - 1 AS TIMESTAMP), CAST(CAST(b - INTERVAL 6 HOUR AS DATE) AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM b) SELECT user_id, d + INTERVAL 25 HOUR AS night_start, d + INTERVAL 37 HOUR AS night_end FROM n WHERE d + INTERVAL 25 HOUR < b AND d + INTERVAL 37 HOUR > a"),
    "f34_events_long": (f34, "SELECT user_id, ts AS at, 'failure' AS kind, event_type AS label FROM events WHERE event_type = 'error' UNION ALL SELECT user_id, ts, 'large', event_type FROM events WHERE event_type = 'purchase' AND value > 80 UNION ALL SELECT user_id, ts, 'extreme', event_type FROM events WHERE value > 99"),
    "f35_hourly_means": (f35, "WITH g AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, c AS event_type FROM events, (VALUES ('click'), ('view')) v(c)), m AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, round(avg(value), 4) AS mean_value FROM events GROUP BY 1, 2, 3) SELECT user_id, day, event_type, last_value(mean_value IGNORE NULLS) OVER (PARTITION BY user_id, event_type ORDER BY day ROWS UNBOUNDED PRECEDING) AS mean_value FROM g LEFT JOIN m USING (user_id, day, event_type)"),
    "f36_naive_to_utc": (f36, "SELECT event_id, ts + INTERVAL 6 HOUR AS utc FROM events"),
    "f37_instants_to_utc": (f37, "SELECT event_id, ts AS utc FROM events"),
    "f38_local_hour": (f38, "SELECT event_id, date_trunc('hour', ts - INTERVAL 6 HOUR) AS _dh, CAST(hour(ts - INTERVAL 6 HOUR) AS INTEGER) AS _hr FROM events"),
    "f39_standardize_times": (f39, "SELECT event_id, date_trunc('minute', ts + INTERVAL 6 HOUR) AS utc FROM events"),
    "f40_number_else_text": (f40, "SELECT event_id, CASE WHEN event_type = 'click' THEN value WHEN event_type = 'view' THEN floor(value) END AS v, CASE WHEN value > 50 THEN 1 ELSE 9 END AS rank FROM events"),
    "f41_plausible": (f41, "SELECT event_type, count(*) FILTER (WHERE value BETWEEN 50 AND 100) AS n_kept, count(*) AS n FROM events GROUP BY 1"),
    "f42_sofa_windowed": (f42, WINDOWED),
    "f43_stitch_summary": (f43, STITCH),
    "x01_comorbidity": (x01, "WITH k AS (SELECT user_id, max(CAST(event_id % 8 = 0 AS INTEGER)) AS c0, max(CAST(event_id % 8 = 1 AS INTEGER)) AS c1, max(CAST(event_id % 8 = 2 AS INTEGER)) AS c2, max(CAST(event_id % 8 = 3 AS INTEGER)) AS c3, max(CAST(event_id % 8 = 4 AS INTEGER)) AS c4, max(CAST(event_id % 8 = 5 AS INTEGER)) AS c5, max(CAST(event_id % 8 = 6 AS INTEGER)) AS c6 FROM events WHERE event_type IN ('error','signup') GROUP BY 1) SELECT user_id, CASE WHEN c3 = 1 THEN 0 ELSE c2 END AS diabetes, CASE WHEN c5 = 1 THEN 0 ELSE c4 END AS cancer, c5 AS metastatic, c0 + c1 + CASE WHEN c3 = 1 THEN 2 ELSE c2 END + CASE WHEN c5 = 1 THEN 6 ELSE 2 * c4 END + c6 AS cci_score FROM k"),
    "f44_ledger": (f44, "SELECT 'lines' AS section, 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value, 'rows' AS unit FROM lineitem UNION ALL SELECT 'lines', 'mean_quantity', round(avg(l_quantity), 4), 'units' FROM lineitem"),
}
