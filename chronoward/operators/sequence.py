"""Ordered operators within an entity: islands, blocks, fills, grids, priorities, look-aheads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.localtime import micros
from .relational import dealt

HOUR = 3_600_000_000
#: Rows of a grid that a task makes.
GRID_ROWS = 500_000


def running(by: Sequence[str], order: Sequence) -> Window:
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def islands(df: DataFrame, by: Sequence[str], order: Sequence, states: dict[str, Column]) -> DataFrame:
    """For every state a running number of its islands (maximal runs of one value); all states share one sort.

    A null state is a value of its own. The first island of an entity is number 1.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    changed = {f"_chg_{n}": F.when(F.lag(F.struct(s)).over(w).isNull() | ~F.lag(s).over(w).eqNullSafe(s), 1).otherwise(0) for n, s in states.items()}
    marked = df.withColumns(changed)
    return marked.withColumns({n: F.sum(f"_chg_{n}").over(running(by, order)) for n in states}).drop(*changed)


def islands_by_rank(df: DataFrame, by: Sequence[str], order: Sequence, state: str, name: str = "island") -> DataFrame:
    """Island id as the difference of two row numbers; unique within one value of the state."""
    everything = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    own = F.row_number().over(Window.partitionBy(*by, state).orderBy(*order))
    return df.withColumn(name, (everything - own).cast("long"))


def streaks(df: DataFrame, by: Sequence[str], time: str, on: Column, tiebreak: Sequence[str] = (), least_hours: float | None = None) -> DataFrame:
    """Runs of rows where `on` holds: streak_id, start, last, end (the next run's start, else the last row) and hours.

    Minutes are whole minutes crossed, as in `minutes_between`; `least_hours` keeps the runs of that length or more.
    """
    order = [time, *tiebreak]
    flagged = islands(df.withColumn("_on", F.coalesce(on, F.lit(False))), by, order, {"_island": F.col("_on")})
    runs = flagged.groupBy(*by, "_island", "_on").agg(F.min(time).alias("start"), F.max(time).alias("last"), F.count("*").alias("n_rows"))
    w = Window.partitionBy(*by).orderBy("_island")
    ended = runs.withColumn("end", F.coalesce(F.lead("start").over(w), F.col("last"))).where("_on")
    ended = ended.withColumn("streak_id", F.row_number().over(w).cast("long"))
    minutes = F.floor(micros(ended, "end") / 60_000_000) - F.floor(micros(ended, "start") / 60_000_000)
    out = ended.withColumn("hours", minutes.cast("double") / 60.0).select(*by, "streak_id", "start", "last", "end", "n_rows", "hours")
    return out if least_hours is None else out.where(F.col("hours") >= least_hours)


def stitch(df: DataFrame, by: Sequence[str], start: str, end: str, id_: str, gap_micros: int) -> DataFrame:
    """Joins stays into blocks where the next start is less than the gap after the latest end so far; block_id is the first stay's id."""
    order = [start, id_]
    w = Window.partitionBy(*by).orderBy(*order)
    latest = F.max(micros(df, end)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = df.withColumn("_new", F.when(latest.isNull() | (micros(df, start) - latest >= gap_micros), 1).otherwise(0))
    opened = opened.withColumn("_block", F.sum("_new").over(running(by, order)))
    return opened.withColumn("block_id", F.first(id_).over(Window.partitionBy(*by, "_block").orderBy(*order))).drop("_new", "_block")


def first_flag(df: DataFrame, by: Sequence[str], order: Sequence, flag: str, name: str) -> DataFrame:
    """1 on the first row of the entity where the flag is set."""
    return df.withColumn(name, F.when((F.col(flag) == 1) & (F.sum(flag).over(running(by, order)) == 1), 1).otherwise(0))


def pick_first(df: DataFrame, by: Sequence[str], order: Sequence) -> DataFrame:
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where("_rn = 1").drop("_rn")


def dup_clusters(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that share all their keys with another row, and how many do."""
    return df.withColumn("n_in_cluster", F.count("*").over(Window.partitionBy(*keys))).where("n_in_cluster > 1")


def forward_fill(df: DataFrame, names: Sequence[str], by: Sequence[str], order: Sequence, exclusive: bool = False) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in names})


def fill_both(df: DataFrame, names: Sequence[str], by: Sequence[str], order: Sequence) -> DataFrame:
    """Forward, then backward, within the partition. What is left to fill backward lies before the partition's first value, so that is read
    once for all rows; a frame from each row to the end would be read again for every row."""
    before, whole = running(by, order), Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(before), F.first(c, ignorenulls=True).over(whole)) for c in names})


def hour_grid(bounds: DataFrame, start: str, end: str, name: str = "event_dttm", extra_hours: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """One row for every hour from the hour of `start` to that of `end`, both included.

    With `by`, the bounds are first dealt by these columns to tasks that make about GRID_ROWS rows each: a small table of bounds is few
    partitions, and all its hours would be made by them.
    """
    hour = lambda c: F.date_trunc("hour", F.col(c)).cast("timestamp_ntz")
    last = hour(end) + F.expr(f"INTERVAL {extra_hours} HOUR")
    if by:
        rows = bounds.agg(F.sum(F.expr(f"timestampdiff(HOUR, `{start}`, `{end}`)") + 2 + extra_hours)).first()[0] or 0
        bounds = dealt(bounds, by, rows, GRID_ROWS)
    return bounds.withColumn(name, F.explode(F.sequence(hour(start), last, F.expr("INTERVAL 1 HOUR"))))


def event_within(df: DataFrame, by: Sequence[str], time: str, flag: Column, window_micros: int, name: str) -> DataFrame:
    """1 where the flag is set on a row strictly later and at most the window later; a range frame, no join."""
    w = Window.partitionBy(*by).orderBy(micros(df, time)).rangeBetween(1, window_micros)
    return df.withColumn(name, F.coalesce(F.max(flag.cast("int")).over(w), F.lit(0)))


def count_distinct_within(df: DataFrame, by: Sequence[str], time: str, value: str, back_micros: int, name: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(micros(df, time)).rangeBetween(-back_micros, 0)
    return df.withColumn(name, F.size(F.collect_set(value).over(w)).cast("long"))


def lead_targets(df: DataFrame, by: Sequence[str], order: Sequence, names: Sequence[str], suffix: str = "_next") -> DataFrame:
    """Every column's value on the entity's next row, null on its last."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({f"{c}{suffix}": F.lead(c).over(w) for c in names})


def jumps(df: DataFrame, by: Sequence[str], time: str, value: str, most: float, within_micros: int, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Entities with a change of more than `most` between consecutive values less than the window apart."""
    w = Window.partitionBy(*by).orderBy(time, *tiebreak)
    pairs = df.withColumn("_dv", F.abs(F.col(value) - F.lag(value).over(w))).withColumn("_dt", micros(df, time) - F.lag(micros(df, time)).over(w))
    return pairs.where(F.col("_dt") < within_micros).groupBy(*by).agg(F.max("_dv").alias("max_jump")).where(F.col("max_jump") > most)


def wide_range(df: DataFrame, by: Sequence[str], value: str, most: float) -> DataFrame:
    return df.groupBy(*by).agg((F.max(value) - F.min(value)).alias("spread")).where(F.col("spread") > most)


def change_levels(df: DataFrame, by: Sequence[str], order: Sequence, levels: Sequence[str]) -> DataFrame:
    """Hierarchical ids: `<level>_id` grows when the level or any level above it changes."""
    states = {f"{c}_id": F.struct(*[F.col(x) for x in levels[: i + 1]]) for i, c in enumerate(levels)}
    return islands(df, by, order, states)


def segments(df: DataFrame, by: Sequence[str], order: str, key: str) -> DataFrame:
    """Equal consecutive keys as one segment that ends where the next one starts (or at its own last row)."""
    marked = islands(df, by, [order], {"segment": F.col(key)})
    runs = marked.groupBy(*by, "segment", key).agg(F.min(order).alias("start"), F.max(order).alias("last"))
    return runs.withColumn("end", F.coalesce(F.lead("start").over(Window.partitionBy(*by).orderBy("segment")), F.col("last"))).drop("last")


def integrate(df: DataFrame, by: Sequence[str], order: Sequence, rate: str, time: str, name: str = "amount") -> DataFrame:
    """Rate (forward-filled, per minute) times the minutes until the entity's next row, 0 on the last one."""
    filled = forward_fill(df, [rate], by, order)
    w = Window.partitionBy(*by).orderBy(*order)
    minutes = (F.lead(micros(df, time)).over(w) - micros(df, time)) / 60_000_000.0
    return filled.withColumn("minutes", F.coalesce(minutes, F.lit(0.0))).withColumn(name, F.coalesce(F.col(rate), F.lit(0.0)) * F.col("minutes"))
