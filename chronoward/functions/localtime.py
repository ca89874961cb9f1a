"""Local time: instants to and from a site's wall clock, day and shift marks across clock changes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

DAY_START, DAY_END = 7, 19


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a time column, whatever the session's time zone."""
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")
    return F.unix_micros(F.col(name))


def to_local(instant: Column, site_tz: str) -> Column:
    """Wall-clock time of a UTC instant at a site, without a time zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(site_tz), utc_clock(instant))


def utc_clock(instant: Column) -> Column:
    """The UTC wall clock of an instant, independent of the session's time zone."""
    seconds = (F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def from_local(local: Column, site_tz: str, repeated: str = "later", skipped: str = "shift") -> Column:
    """UTC clock of a naive local time, with a rule for times that come twice and times that do not exist.

    A repeated hour in autumn means its `later` pass (standard time) or its `earlier` one. A skipped time in spring moves
    to the end of the gap (`shift`) or becomes null (`null`); the shift holds for gaps of one hour that begin on the hour.
    """
    if repeated not in ("later", "earlier") or skipped not in ("shift", "null"):
        raise ValueError("repeated is later or earlier, skipped is shift or null")
    once = F.convert_timezone(F.lit(site_tz), F.lit("UTC"), local)
    back = F.convert_timezone(F.lit("UTC"), F.lit(site_tz), once)
    later = once + F.expr("INTERVAL 1 HOUR")
    again = F.convert_timezone(F.lit("UTC"), F.lit(site_tz), later)
    gap = F.convert_timezone(F.lit(site_tz), F.lit("UTC"), F.date_trunc("hour", back).cast("timestamp_ntz"))
    first = F.when(back != local, gap if skipped == "shift" else F.lit(None).cast("timestamp_ntz"))
    return (first.when(again == local, later) if repeated == "later" else first).otherwise(once)


def coerce_times(df: DataFrame, names: Iterable[str], site_tz: str | None) -> DataFrame:
    """Time columns as UTC clocks: instants convert, naive ones count as local to the site. Absent names are ignored."""
    out = {}
    for c in names:
        if c not in df.columns:
            continue
        kind = df.schema[c].dataType
        if isinstance(kind, T.TimestampType):
            out[c] = utc_clock(F.col(c))
        elif isinstance(kind, T.TimestampNTZType):
            if site_tz is None:
                raise ValueError(f"{c} has no time zone and none is given")
            out[c] = from_local(F.col(c), site_tz)
    return df.withColumns(out)


def standardize_times(df: DataFrame, names: Iterable[str], site_tz: str, unit: str = "microsecond", repeated: str = "earlier", skipped: str = "null") -> DataFrame:
    """Time columns as UTC clocks cut to one unit, so that columns of different precision compare and join."""
    out = {}
    for c in (c for c in names if c in df.columns):
        local = isinstance(df.schema[c].dataType, T.TimestampNTZType)
        clock = from_local(F.col(c), site_tz, repeated, skipped) if local else utc_clock(F.col(c))
        out[c] = F.date_trunc(unit, clock).cast("timestamp_ntz")
    return df.withColumns(out)


def add_local_hour(df: DataFrame, name: str, site_tz: str) -> DataFrame:
    """_dh (local clock, floored to the hour) and _hr of a UTC clock column."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(site_tz), F.col(name))
    return df.withColumn("_dh", F.date_trunc("hour", local).cast("timestamp_ntz")).withColumn("_hr", F.hour("_dh"))


def add_day_shift(df: DataFrame, by: str, name: str, site_tz: str) -> DataFrame:
    """_shift (day from 7 to 19 local), _is_day_start, _nth_day (7 o'clock crossings so far) and _day_shift."""
    w = Window.partitionBy(by).orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
    marked = add_local_hour(df, name, site_tz)
    marked = marked.withColumn("_shift", F.when((F.col("_hr") >= DAY_START) & (F.col("_hr") < DAY_END), "day").otherwise("night"))
    marked = marked.withColumn("_is_day_start", (F.col("_hr") == DAY_START).cast("int"))
    marked = marked.withColumn("_nth_day", F.sum("_is_day_start").over(w))
    return marked.withColumn("_day_shift", F.concat(F.lit("day"), F.col("_nth_day").cast("string"), F.lit("_"), F.col("_shift")))


def minutes_between(df: DataFrame, start: str, end: str) -> Column:
    """Minute boundaries crossed from start to end (10:00:59 to 10:01:00 is one)."""
    minute = 60_000_000
    return F.floor(micros(df, end) / minute).cast("long") - F.floor(micros(df, start) / minute).cast("long")


def night_windows(df: DataFrame, by: str, start: str, end: str, site_tz: str) -> DataFrame:
    """Local nights (19 to 7) that meet [start, end], with UTC bounds, one row each."""
    local = lambda c: F.convert_timezone(F.lit("UTC"), F.lit(site_tz), F.col(c))
    days = F.sequence(F.date_sub(F.to_date(local(start)), 1), F.to_date(local(end)))
    nights = df.select(by, start, end, F.explode(days).alias("night"))
    at = lambda day, hour: from_local(day.cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(hour)), site_tz)
    bounded = nights.select(by, start, end, "night", at(F.col("night"), DAY_END).alias("night_start"), at(F.date_add("night", 1), DAY_START).alias("night_end"))
    return bounded.where((F.col("night_start") < F.col(end)) & (F.col("night_end") > F.col(start))).drop(start, end)
