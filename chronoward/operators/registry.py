"""Stay and day registries, outcome roll-ups and the modelling table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import first_match
from .sequence import lead_targets


def roll_up(rows: DataFrame, keys: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """1 where any row of the group has the flag; nulls count as 0."""
    return rows.groupBy(*keys).agg(*[F.coalesce(F.max(F.col(f).cast("int")), F.lit(0)).alias(f) for f in flags])


def onto_grid(grid: DataFrame, rows: DataFrame, keys: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Rolled-up flags on every grid row, 0 where nothing was recorded."""
    return grid.join(roll_up(rows, keys, flags), list(keys), "left").withColumns({f: F.coalesce(f, F.lit(0)) for f in flags})


def ever(df: DataFrame, by: str, condition: Column, name: str) -> DataFrame:
    return df.groupBy(by).agg(F.max(F.when(condition, 1).otherwise(0)).alias(name))


def first_stay_window(stays: DataFrame, by: str, start: str, hours: int = 24) -> DataFrame:
    """First start of each entity and the end of the window after it."""
    return stays.groupBy(by).agg(F.min(start).alias("window_start")).withColumn("window_end", F.col("window_start") + F.expr(f"INTERVAL {hours} HOUR"))


def exit_mechanism(flags: Sequence[tuple[str, str]], default: str) -> Column:
    """The first flag that is set decides."""
    return first_match([(F.col(f) == 1, label) for f, label in flags], default)


def long_exposure_days(doses: DataFrame, grid: DataFrame, by: str, time: str, dose: str, day: str, most_minutes: float, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Days on which the minutes of positive dose, added once for each grid hour that they cover, exceed the limit."""
    from ..functions.localtime import micros
    from .asof import asof_join
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(time, *tiebreak)
    spans = doses.withColumn("_minutes", (F.coalesce(F.lead(micros(doses, time)).over(w), micros(doses, time)) - micros(doses, time)) / 60_000_000.0)
    spans = spans.select(by, F.col(time).alias("_at"), F.col(dose).alias("_dose"), "_minutes", *tiebreak)
    hourly = asof_join(grid, spans, [by], "event_dttm", "_at", ["_dose", "_minutes"], tiebreak=tiebreak)
    total = F.sum(F.when(F.col("_dose") > 0, F.col("_minutes")).otherwise(0.0))
    return hourly.groupBy(by, day).agg(total.alias("total_minutes")).where(F.col("total_minutes") > most_minutes)


def model_input(days: DataFrame, by: str, day: str, outcomes: Sequence[str], sides: Sequence[tuple[DataFrame, Sequence[str]]] = ()) -> DataFrame:
    """Day rows with their covariates and next-day outcomes; days before the first and the last day of a stay go."""
    from .relational import left_chain

    wide = lead_targets(left_chain(days, sides), [by], [day], outcomes, "_next_day")
    keep = F.col(day) > 0
    for o in outcomes:
        keep = keep & F.col(f"{o}_next_day").isNotNull()
    return wide.where(keep)
