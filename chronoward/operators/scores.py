"""Severity scores and oxygenation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import first_match
from .asof import asof_join
from .relational import range_join
from .sequence import change_levels, forward_fill

#: Devices from most to least support.
DEVICE_RANK = {"imv": 1, "nippv": 2, "cpap": 3, "high flow nc": 4, "face mask": 5, "trach collar": 6, "nasal cannula": 7, "other": 8, "room air": 9}


def pao2_from_spo2(spo2: Column) -> Column:
    """Oxygen tension from saturation below 97 % (inverse of Severinghaus' dissociation curve)."""
    s = spo2 / 100.0
    a = 11700.0 / (1.0 / s - 1.0)
    b = F.sqrt(F.lit(50.0) ** 3 + a * a)
    return F.when((spo2 > 0) & (spo2 < 97), F.pow(b + a, F.lit(1.0 / 3)) - F.pow(b - a, F.lit(1.0 / 3)))


def pf_from_sf(spo2: Column, fio2: Column) -> Column:
    """P/F from S/F by the inverted linear relation, for saturations up to 97 %."""
    return F.when(spo2 <= 97, (F.try_divide(spo2, fio2) - 64.0) / 0.84)


def pf(po2: Column, fio2: Column) -> Column:
    return F.try_divide(po2, fio2)


def _steps(x: Column, cuts: list[tuple[float, int]], below: bool) -> Column:
    """Points of the first cut that `x` is under (below) or at or over, 0 beyond all, null for null."""
    rules = [(x.isNull(), None)] + [((x < c) if below else (x >= c), p) for c, p in cuts]
    return first_match(rules, 0)


SUBSCORES = ("sofa_cv", "sofa_coag", "sofa_liver", "sofa_resp", "sofa_cns", "sofa_renal")
INPUTS = ("norepinephrine", "epinephrine", "dopamine", "dobutamine", "map", "platelet_count", "bilirubin_total", "p_f", "device_category", "gcs_total", "creatinine")


def sofa(df: DataFrame, nulls_as_zero: bool = False, crrt: str | None = None) -> DataFrame:
    """Six subscores and their total (missing subscores count as 0) from worst values; absent inputs count as missing.

    A charted pressor rate of 0 scores 3, as rates at or under 0.1 do.
    """
    df = df.withColumns({c: F.lit(None).cast("string" if c == "device_category" else "double") for c in INPUTS if c not in df.columns})
    v = {c: F.col(c) for c in INPUTS}
    cv = first_match(
        [
            ((v["dopamine"] > 15) | (v["epinephrine"] > 0.1) | (v["norepinephrine"] > 0.1), 4),
            ((v["dopamine"] > 5) | (v["epinephrine"] <= 0.1) | (v["norepinephrine"] <= 0.1), 3),
            ((v["dopamine"] <= 5) | (v["dobutamine"] > 0), 2), (v["map"] < 70, 1), (v["map"] >= 70, 0),
        ]
    )
    supported = F.coalesce(v["device_category"].isin("imv", "nippv", "cpap"), F.lit(False))
    p = v["p_f"]
    resp = first_match([((p < 100) & supported, 4), ((p >= 100) & (p < 200) & supported, 3), ((p >= 200) & (p < 300), 2), ((p >= 300) & (p < 400), 1), (p >= 400, 0)])
    g = v["gcs_total"]
    cns = first_match([(g < 6, 4), (g.between(6, 9), 3), (g.between(10, 12), 2), (g.between(13, 14), 1), (g == 15, 0)])
    renal = _steps(v["creatinine"], [(5, 4), (3.5, 3), (2, 2), (1.2, 1)], below=False)
    if crrt:
        renal = F.when(F.col(crrt) == 1, 4).otherwise(renal)
    scores = {
        "sofa_cv": cv, "sofa_coag": _steps(v["platelet_count"], [(20, 4), (50, 3), (100, 2), (150, 1)], below=True),
        "sofa_liver": _steps(v["bilirubin_total"], [(12, 4), (6, 3), (2, 2), (1.2, 1)], below=False), "sofa_resp": resp, "sofa_cns": cns, "sofa_renal": renal,
    }
    out = df.withColumns({c: (F.coalesce(e, F.lit(0)) if nulls_as_zero else e).cast("int") for c, e in scores.items()})
    return out.withColumn("sofa_total", sum((F.coalesce(c, F.lit(0)) for c in SUBSCORES), F.lit(0)).cast("int"))


#: Observations whose highest value is the worst, and those whose lowest is; plausible ranges.
HIGHEST = ("creatinine", "bilirubin_total", "norepinephrine", "epinephrine", "dopamine", "dobutamine")
LOWEST = ("platelet_count", "po2_arterial", "map", "spo2", "gcs_total")
PLAUSIBLE = {"po2_arterial": (0.0, 700.0), "spo2": (50.0, 100.0)}
CONCURRENT_MINUTES, LOOK_BACK_HOURS = 240, 24


def filled_support(support: DataFrame, by: Sequence[str], time: str, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Device, then mode within its device, then oxygen share within its mode, each carried forward."""
    order = [time, *tiebreak]
    rows = forward_fill(support, ["device_category"], by, order)
    rows = change_levels(rows, by, order, ["device_category"])
    rows = forward_fill(rows, ["mode_category"], [*by, "device_category_id"], order)
    rows = change_levels(rows, by, order, ["device_category", "mode_category"])
    return forward_fill(rows, ["fio2_set"], [*by, "mode_category_id"], order).drop("device_category_id", "mode_category_id")


def sofa_windowed(windows: DataFrame, observations: DataFrame, support: DataFrame, by: str, time: str, start: str, end: str, tiebreak: Sequence[str] = (), nulls_as_zero: bool = True) -> DataFrame:
    """One row for each window (one an entity): worst values inside it, the worst concurrent P/F, six subscores and the total.

    `observations` has the entity, time, category and value (laboratory, vital, coma scale and pressor rates in mcg/kg/min);
    `support` the device, mode and fio2_set. Support is read from LOOK_BACK_HOURS before the window, so that what was set
    then is carried into it. An oxygen tension meets the last support row of the window at most CONCURRENT_MINUTES before.
    """
    inside = range_join(observations, windows, [by], time, start, end)
    for name, (low, high) in PLAUSIBLE.items():
        inside = inside.withColumn("value", F.when((F.col("category") != name) | F.col("value").between(low, high), F.col("value")))
    worst = inside.groupBy(by).agg(*[f(F.when(F.col("category") == c, F.col("value"))).alias(c) for names, f in ((HIGHEST, F.max), (LOWEST, F.min)) for c in names])
    carried = filled_support(range_join(support, windows, [by], time, start, end, before=F.expr(f"INTERVAL {LOOK_BACK_HOURS} HOUR")), [by], time, tiebreak)
    carried = carried.where(F.col(time) >= F.col(start)).withColumn("fio2_set", F.when(F.col("fio2_set").between(0.21, 1.0), F.col("fio2_set")))
    limit = F.expr(f"timestampdiff(MICROSECOND, _right_time, _left_time) <= {CONCURRENT_MINUTES} * 60 * 1000000L")
    tension = inside.where("category = 'po2_arterial' AND value IS NOT NULL").select(by, time, "value", *tiebreak)
    pairs = asof_join(tension, carried.withColumnRenamed(time, "_at"), [by], time, "_at", ["fio2_set", "device_category"], tolerance=limit, tiebreak=tiebreak)
    pairs = pairs.withColumn("p_f", pf(F.col("value"), F.col("fio2_set"))).where("p_f IS NOT NULL")
    ratio = pairs.groupBy(by).agg(F.min("p_f").alias("p_f"), F.min_by("device_category", F.struct("p_f", time, *tiebreak)).alias("device_category"))
    wide = windows.select(by).join(worst, by, "left").join(ratio, by, "left").withColumn("pao2_imputed", pao2_from_spo2(F.col("spo2")))
    return sofa(wide, nulls_as_zero)


def body_mass_index(vitals: DataFrame, by: str, time: str, category: str, value: str, tiebreak: str) -> DataFrame:
    """First plausible height (50 to 250 cm) and first weight (above 0) of each entity, and their index."""
    first = lambda kind, ok, name: vitals.where((F.col(category) == kind) & ok).groupBy(by).agg(F.min_by(value, F.struct(time, tiebreak)).alias(name))
    both = first("height_cm", F.col(value).between(50, 250), "height_cm").join(first("weight_kg", F.col(value) > 0, "weight_kg"), by, "full")
    return both.withColumn("bmi", F.try_divide(F.col("weight_kg"), F.pow(F.col("height_cm") / 100.0, F.lit(2.0))))
