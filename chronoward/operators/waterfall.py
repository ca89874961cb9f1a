"""The full filling of respiratory support rows: inference, clean-up, hourly scaffold, four levels of blocks, fills.

Every stage reads the one before. All windows share the entity as their first partition key, so rows are shuffled once on it,
and so are the entities' bounds: the scaffold is made where their rows are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import normalize_categories
from .relational import dealt
from .sequence import change_levels, fill_both, forward_fill, hour_grid, running

#: Rows, with those of the scaffold, of a task.
TASK_ROWS = 250_000

#: Patterns of modes and names, categories, and the columns of the stages.
CONTROLLED = r"assist control-volume control|simv|pressure control"
CMV, SUPPORT, COLLAR = "assist control-volume control", "pressure support/cpap", "trach collar"
LABELS = ("device_category", "device_name", "mode_category", "mode_name")
FILLED = ("fio2_set", "lpm_set", "peep_set", "tidal_volume_set", "pressure_support_set", "resp_rate_set", "resp_rate_obs", "peak_inspiratory_pressure_set")


def usual_names(df: DataFrame) -> DataFrame:
    """One row with the commonest device name of each invasive and non-invasive device and of the controlled mode; ties to the first name."""
    pick = lambda kind, name, value: F.min_by(name, F.struct(-F.col("n"), F.col(name))).alias(value) if kind is None else F.min_by(F.when(kind, F.col(name)), F.when(kind, F.struct(-F.col("n"), F.col(name)))).alias(value)
    device = df.dropna(subset=["device_category", "device_name"]).groupBy("device_category", "device_name").agg(F.count("*").alias("n"))
    mode = df.dropna(subset=["mode_category", "mode_name"]).where(F.col("mode_category") == CMV).groupBy("mode_name").agg(F.count("*").alias("n"))
    devices = device.agg(pick(F.col("device_category") == "imv", "device_name", "_imv_name"), pick(F.col("device_category") == "nippv", "device_name", "_nippv_name"))
    return devices.crossJoin(mode.agg(pick(None, "mode_name", "_cmv_name")))


def with_shares(df: DataFrame, percent: bool | None) -> DataFrame:
    """fio2_set as a fraction: values above 1 are percent if `percent`, or, where that is not said, if the table's mean is above 1."""
    as_share = F.when(F.col("fio2_set") > 1, F.col("fio2_set") / 100.0).otherwise(F.col("fio2_set"))
    if percent is not None:
        return df.withColumn("fio2_set", as_share) if percent else df
    mean = df.agg(F.avg("fio2_set").alias("_mean"))
    return df.join(F.broadcast(mean)).withColumn("fio2_set", F.when(F.col("_mean") > 1, as_share).otherwise(F.col("fio2_set"))).drop("_mean")


def inferred(df: DataFrame, by: str, order: Sequence) -> DataFrame:
    """Missing devices from modes, settings and neighbours, rule after rule."""
    w = Window.partitionBy(by).orderBy(*order)
    category, name = F.col("device_category"), F.col("device_name")
    over = lambda column, least: F.coalesce(F.col(column) > least, F.lit(False))

    def beside(kind: str) -> Column:
        return F.coalesce(F.lag("device_category").over(w) == kind, F.lit(False)) | F.coalesce(F.lead("device_category").over(w) == kind, F.lit(False))

    def put(df: DataFrame, rule: Column, **values: Column) -> DataFrame:
        marked = df.withColumn("_rule", rule)
        return marked.withColumns({c: F.when(F.col("_rule"), v).otherwise(F.col(c)) for c, v in values.items()}).drop("_rule")

    imv = {"device_category": F.lit("imv"), "device_name": F.col("_imv_name")}
    df = put(df, category.isNull() & name.isNull() & F.coalesce(F.col("mode_category").rlike(CONTROLLED), F.lit(False)), **imv)
    df = put(df, category.eqNullSafe("imv") & name.isNull(), device_name=F.col("_imv_name"))
    df = put(df, category.isNull() & beside("imv") & over("peep_set", 1) & over("resp_rate_set", 1) & over("tidal_volume_set", 1), **imv)
    df = put(df, category.isNull() & beside("nippv") & over("peak_inspiratory_pressure_set", 1) & over("pressure_support_set", 1), device_category=F.lit("nippv"), device_name=F.coalesce(name, F.col("_nippv_name")))
    tracheal = F.coalesce(name.contains("trach"), F.lit(False))
    mode_missing = F.col("mode_category").isNull()
    return put(
        df, category.isNull() & ~tracheal & beside("imv") & over("tidal_volume_set", 0) & over("resp_rate_set", 0), **imv,
        mode_name=F.when(mode_missing, F.col("_cmv_name")).otherwise(F.col("mode_name")), mode_category=F.coalesce("mode_category", F.lit(CMV)),
    )


def cleaned(df: DataFrame, by: str, time: str, tiebreak: Sequence[str]) -> DataFrame:
    """Without non-invasive and then missing devices among rows of one time, without a mask support just before a trach
    collar, without empty rows, and one row for each time."""
    same = F.count("*").over(Window.partitionBy(by, time))
    df = df.withColumn("_n", same).where(~((F.col("_n") > 1) & F.col("device_category").eqNullSafe("nippv")))
    df = df.withColumn("_n", same).where(~((F.col("_n") > 1) & F.col("device_category").isNull())).drop("_n")
    w = Window.partitionBy(by).orderBy(time, *tiebreak)
    carried = F.col("device_category").eqNullSafe("nippv") & F.lead("device_category").over(w).eqNullSafe(COLLAR) & ~F.lag("device_category").over(w).eqNullSafe("nippv")
    df = df.withColumn("_carried", carried).where("NOT _carried").drop("_carried")
    df = df.dropna(how="all", subset=[c for c in (*LABELS, "tracheostomy", *FILLED) if c in df.columns])
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(by, time).orderBy(*tiebreak))).where("_rn = 1").drop("_rn")


def waterfall_full(df: DataFrame, by: str = "hospitalization_id", time: str = "recorded_dttm", tiebreak: Sequence[str] = (), percent: bool | None = None) -> DataFrame:
    """Rows and scaffold (`is_scaffold`) with labels and settings filled, and the ids of device category, device name, mode
    category and mode name blocks. A scaffold row stands in the last second of every hour from an entity's first to its last.

    One pass counts rows and hours at once: both are dealt to tasks by one number, since the few bytes of an entity's bounds make many
    rows, and as both sides of the union then lie alike, dealing it again moves nothing. Ids never fall along the order, so windows over
    them share the sort of the block that they split.
    """
    absent = [c for c in (*LABELS, *FILLED) if c not in df.columns]
    df = df.withColumns({c: F.lit(None).cast("string" if c in LABELS else "double") for c in absent})
    named = normalize_categories(df, list(LABELS))
    bounds = named.groupBy(by).agg(F.min(time).alias("_a"), F.max(time).alias("_b"), F.count("*").alias("_n"))
    rows, hours = (x or 0 for x in bounds.agg(F.sum("_n"), F.sum(F.expr("timestampdiff(HOUR, _a, _b)") + 2)).first())
    bounds = dealt(bounds, [by], rows + hours, TASK_ROWS)
    df = dealt(with_shares(named, percent), [by], rows + hours, TASK_ROWS)
    grid = hour_grid(bounds, "_a", "_b", time).select(by, (F.col(time) + F.expr("INTERVAL '59:59' MINUTE TO SECOND")).cast(df.schema[time].dataType).alias(time), F.lit(True).alias("is_scaffold"))
    df = inferred(df.crossJoin(F.broadcast(usual_names(named))), by, [time, *tiebreak]).drop("_imv_name", "_nippv_name", "_cmv_name")
    df = cleaned(df, by, time, tiebreak).withColumn("is_scaffold", F.lit(False)).unionByName(grid, allowMissingColumns=True)
    df = dealt(df, [by], rows + hours, TASK_ROWS)
    order = [time, "is_scaffold", *tiebreak]
    df = forward_fill(df, ["device_category"], [by], order)
    df = change_levels(df, [by], order, ["device_category"])
    df = fill_both(df, ["device_name"], [by, "device_category_id"], order)
    df = change_levels(df, [by], ["device_category_id", *order], ["device_name"])
    df = fill_both(df, ["mode_category"], [by, "device_name_id"], order)
    df = change_levels(df, [by], ["device_name_id", *order], ["device_name_id", "mode_category"]).drop("device_name_id_id")
    df = fill_both(df, ["mode_name"], [by, "mode_category_id"], order)
    df = change_levels(df, [by], ["mode_category_id", *order], ["mode_category_id", "mode_name"]).drop("mode_category_id_id")
    tracheal = F.coalesce(F.col("device_name").contains("trach"), F.lit(False))
    support = F.coalesce(F.col("mode_category") == SUPPORT, F.lit(False))
    no_volume = (support & F.col("pressure_support_set").isNotNull()) | (F.col("mode_category").isNull() & tracheal) | (support & tracheal)
    df = df.withColumn("fio2_set", F.when(F.col("fio2_set").isNull() & (F.col("device_category") == "room air"), 0.21).otherwise(F.col("fio2_set")))
    df = df.withColumn("tidal_volume_set", F.when(~no_volume, F.col("tidal_volume_set")))
    df = df.withColumn("_collar", F.sum(F.coalesce(F.col("device_category") == COLLAR, F.lit(False)).cast("int")).over(running([by, "mode_name_id"], order)))
    df = fill_both(df, list(FILLED), [by, "mode_name_id", "_collar"], order).drop("_collar")
    piece = F.col("mode_category").isNull() & F.coalesce(F.col("device_name").contains("t-piece"), F.lit(False))
    df = df.withColumn("mode_category", F.when(piece, "blow by").otherwise(F.col("mode_category")))
    return forward_fill(df, ["tracheostomy"], [by], order) if "tracheostomy" in df.columns else df
