"""Respiratory support: cleaning, inference of device and mode, and filling within blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import lookup, normalize_categories
from .sequence import change_levels, fill_both

#: Inspired oxygen by litres a minute of a nasal cannula.
FIO2_BY_FLOW = {1: 0.24, 2: 0.28, 3: 0.32, 4: 0.36, 5: 0.40, 6: 0.44, 7: 0.48, 8: 0.52, 9: 0.56, 10: 0.60}
CONTROLLED = r"assist control-volume control|simv|pressure control"
SETTINGS = ("fio2_set", "peep_set", "pressure_support_set", "resp_rate_set", "tidal_volume_set", "lpm_set")


def device_from_mode(device: Column, mode: Column) -> Column:
    """A missing device from the mode: controlled modes are invasive, pressure support without cpap is not."""
    m = F.lower(mode)
    return F.when(device.isNotNull(), device).when(m.rlike(CONTROLLED), "imv").when(m.contains("pressure support") & ~m.contains("cpap"), "nippv")


def fio2_filled(fio2: Column, device: Column, flow: Column) -> Column:
    """Room air is 0.21; a nasal cannula's share follows from its rounded flow of 1 to 10 litres."""
    by_flow = lookup(F.rint(flow).cast("int"), FIO2_BY_FLOW)
    return F.when(fio2.isNotNull(), fio2).when(F.lower(device) == "room air", 0.21).when(F.lower(device) == "nasal cannula", by_flow)


def fio2_as_fraction(df: DataFrame, name: str = "fio2_set") -> DataFrame:
    """Percent to fraction, decided by the table's mean: above 1 means percent. One aggregate joined as one row."""
    mean = df.agg(F.avg(name).alias("_mean"))
    return df.join(F.broadcast(mean)).withColumn(name, F.when(F.col("_mean") > 1, F.col(name) / 100.0).otherwise(F.col(name))).drop("_mean")


def waterfall(df: DataFrame, by: str = "hospitalization_id", time: str = "recorded_dttm", tiebreak: tuple = ()) -> DataFrame:
    """Filled respiratory rows, in stages that each read the one before.

    Lower case; percent to fraction; device from mode and from neighbours that agree; one row for each time (the one with
    more settings); hierarchical ids (device, mode within it); settings filled forward, then backward, within the mode
    block, where a change to a trach collar starts a new block as any device change does; room air; tracheostomy carried on.
    """
    df = normalize_categories(df, ["device_category", "device_name", "mode_category", "mode_name"])
    df = fio2_as_fraction(df)
    df = df.withColumn("device_category", device_from_mode(F.col("device_category"), F.col("mode_category")))
    have = [c for c in SETTINGS if c in df.columns]
    filled = sum((F.col(c).isNotNull().cast("int") for c in have), F.lit(0))
    w = Window.partitionBy(by, time).orderBy(filled.desc(), F.col("device_category").asc_nulls_last(), *tiebreak)
    df = df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    order = Window.partitionBy(by).orderBy(time)
    before, after = F.lag("device_category").over(order), F.lead("device_category").over(order)
    df = df.withColumn("device_category", F.when(F.col("device_category").isNull() & before.eqNullSafe(after), before).otherwise(F.col("device_category")))
    df = df.withColumn("device_category", F.last("device_category", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    df = change_levels(df, [by], [time], ["device_category"])
    df = fill_both(df, ["mode_category"], [by, "device_category_id"], [time])
    df = change_levels(df, [by], [time], ["device_category", "mode_category"])
    df = fill_both(df, have, [by, "mode_category_id"], [time])
    flow = F.col("lpm_set") if "lpm_set" in df.columns else F.lit(None).cast("double")
    df = df.withColumn("fio2_set", fio2_filled(F.col("fio2_set"), F.col("device_category"), flow))
    if "tracheostomy" in df.columns:
        df = df.withColumn("tracheostomy", F.coalesce(F.max("tracheostomy").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    return df


def trial_states(df: DataFrame) -> DataFrame:
    """Three definitions of a breathing trial's state, 0/1; a missing setting fails the primary one."""
    piece = F.coalesce(F.col("device_name").rlike(r"(?i)t[\s_-]?piece"), F.lit(False))
    support = F.coalesce(F.col("mode_category") == "pressure support/cpap", F.lit(False))
    ps, peep = F.col("pressure_support_set"), F.col("peep_set")
    truth = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return df.withColumns(
        {
            "state_primary": truth(piece | (support & (peep <= 8) & (ps <= 8))),
            "state_broad": truth(piece | (support & (F.coalesce(peep, F.lit(999.0)) <= 8) & (F.coalesce(ps, F.lit(0.0)) <= 8))),
            "state_strict": truth(piece | (support & ps.isNull() & (peep == 5)) | (support & F.coalesce(ps < 7, F.lit(False)))),
        }
    )
