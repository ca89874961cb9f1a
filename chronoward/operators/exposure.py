"""Drug exposure by hour and day from dose records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.localtime import micros
from .asof import starter_rows
from .relational import dealt, parts_for, pivot
from .rules import priority_dedup

HOUR_US = 3_600_000_000
#: Rows of a task.
TASK_ROWS = 250_000


def continuous_by_hour(meds: DataFrame, grid: DataFrame, by: str, drugs: Sequence[str], time: str = "admin_dttm", grid_time: str = "event_dttm", tiebreak: Sequence[str] = ()) -> DataFrame:
    """Amount of each drug in each grid hour: rates (per minute) hold until the entity's next row.

    `meds` has med_category, med_dose, mar_action_category. Stops count as rate 0 before anything is carried forward;
    each drug's last rate before the grid starts enters as a row at its start; hours beyond the grid do not count.
    """
    parts = parts_for(meds.sparkSession, grid.count(), TASK_ROWS)
    meds = dealt(meds, [by], meds.count(), TASK_ROWS)
    keyed = priority_dedup(meds.where(F.col("med_category").isin(*drugs)), [by, time, "med_category"], True, tiebreak=tiebreak)
    keyed = keyed.withColumn("med_dose", F.when(F.col("mar_action_category").isin("stop", "not_given"), 0.0).otherwise(F.col("med_dose")))
    bounds = grid.groupBy(by).agg(F.min(grid_time).alias("_from"), F.max(grid_time).alias("_to"))
    inside = keyed.join(bounds, by).where((F.col(time) >= F.col("_from")) & (F.col(time) < F.col("_to") + F.expr("INTERVAL 1 HOUR")))
    anchors = bounds.select(by, "_from", F.explode(F.array(*map(F.lit, drugs))).alias("med_category"))
    starts = starter_rows(anchors, keyed.select(by, "med_category", time, "med_dose"), [by, "med_category"], "_from", time, ["med_dose"])
    events = inside.select(by, time, "med_category", "med_dose").unionByName(starts.select(by, time, "med_category", "med_dose"))
    # doses and grid rows of one time meet in a group; groups and windows share one shuffle on the entity
    both = events.unionByName(grid.select(by, F.col(grid_time).alias(time)), allowMissingColumns=True).repartition(parts, by)
    rows = both.groupBy(by, time).agg(*[F.avg(F.when(F.col("med_category") == d, F.col("med_dose"))).alias(d) for d in drugs])
    w = Window.partitionBy(by).orderBy(time)
    rows = rows.withColumns({d: F.last(d, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for d in drugs})
    left = (F.coalesce(F.lead(micros(rows, time)).over(w), micros(rows, time)) - micros(rows, time)) / 60_000_000.0
    rows = rows.withColumn("_min", left).withColumn(grid_time, F.date_trunc("hour", time).cast("timestamp_ntz"))
    return rows.groupBy(by, grid_time).agg(*[F.sum(F.coalesce(d, F.lit(0.0)) * F.col("_min")).alias(f"{d}_cont") for d in drugs])


def bolus_by_hour(meds: DataFrame, by: str, drugs: Sequence[str], time: str = "admin_dttm", grid_time: str = "event_dttm", tiebreak: Sequence[str] = ()) -> DataFrame:
    """Sum of the given single doses of each drug in each hour."""
    meds = dealt(meds, [by], meds.count(), TASK_ROWS)
    keyed = priority_dedup(meds.where(F.col("med_category").isin(*drugs)), [by, time, "med_category"], True, tiebreak=tiebreak)
    given = keyed.where(F.coalesce(F.col("mar_action_category") != "not_given", F.lit(True))).withColumn(grid_time, F.date_trunc("hour", time).cast("timestamp_ntz"))
    return pivot(given, [by, grid_time], "med_category", drugs, F.sum("med_dose")).select(by, grid_time, *[F.col(d).alias(f"{d}_bolus") for d in drugs])


def equivalents(df: DataFrame, factors: dict[str, dict[str, float]]) -> DataFrame:
    """Columns of weighted sums, missing parts as 0: {"opioid": {"fentanyl": 1, "hydromorphone": 50}}."""
    return df.withColumns({name: sum((F.coalesce(c, F.lit(0.0)) * float(f) for c, f in parts.items()), F.lit(0.0)) for name, parts in factors.items()})


def by_shift(hourly: DataFrame, keys: Sequence[str], shift: str, rates: Sequence[str]) -> DataFrame:
    """Mean rate in day and night hours, wide, with the number of hours of each."""
    day = F.col(shift) == "day"
    cols = [F.avg(F.when(c, F.col(x))).alias(f"{x}_{n}") for x in rates for n, c in (("day", day), ("night", ~day))]
    return hourly.groupBy(*keys).agg(*cols, F.count_if(day).alias("n_hours_day"), F.count_if(~day).alias("n_hours_night"))
