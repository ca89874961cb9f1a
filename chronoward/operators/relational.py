"""Joins, set operations and reshaping."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.localtime import micros

#: A side is broadcast by hint only up to this many rows, counted first; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """`df` with a broadcast hint if it has at most BROADCAST_ROWS rows (counting stops there), else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def parts_for(spark: SparkSession, rows: int, most: int) -> int:
    """How many tasks `rows` go to with about `most` rows each; small inputs still use the cores there are."""
    return max(1, -(-rows // most), min(spark.sparkContext.defaultParallelism, rows // 10_000))


def dealt(df: DataFrame, by: Sequence[str], rows: int, most: int) -> DataFrame:
    """`df` dealt by a key to tasks of about `most` rows, so that what a task holds does not grow with the table.

    Adaptive execution joins partitions by their compressed bytes, which say little about wide or repetitive rows in memory; a number that is
    asked for stays. Windows, groups and fills on the key, or on it and more, need no further shuffle.
    """
    return df.repartition(parts_for(df.sparkSession, rows, most), *by)


def cohort(df: DataFrame, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are among `ids`, never more than there were."""
    return df.join(ids.select(*keys), list(keys), "left_semi")


def left_chain(base: DataFrame, sides: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Left joins in turn, each on its own keys; `base` keeps its rows when the sides are unique on their keys."""
    return reduce(lambda df, side: df.join(side[0], list(side[1]), "left"), sides, base)


def merge_all(frames: Sequence[DataFrame], on: Sequence[str], how: str = "outer") -> DataFrame:
    return reduce(lambda a, b: a.join(b, list(on), how), frames)


def range_join(events: DataFrame, windows: DataFrame, by: Sequence[str], time: str, start: str, end: str, how: str = "inner", before: Column | None = None) -> DataFrame:
    """Events inside [start - before, end] of a window of their key: an equi-join on the key and a bin of time, then the exact bounds.

    Windows are dealt to bins of their own length rounded up to a power of two, so each one is in two bins at most, whatever
    the mix of lengths; an event goes to one bin for each power among the windows of its key, and nowhere if there are none. An event meets
    a window at most once, and only windows of about its time. Windows that end before they start hold nothing.
    """
    low = F.col(start) if before is None else F.col(start) - before
    spans = windows.withColumn("_low", low).where(F.col("_low") <= F.col(end))
    first, last = number(spans, "_low"), number(spans, end)
    spans = spans.withColumn("_power", F.ceil(F.log2(F.greatest(last - first, F.lit(2.0**-20)))).cast("int"))
    spans = spans.withColumn("_bin", F.explode(F.sequence(bin_of(number(spans, "_low"), F.col("_power")), bin_of(number(spans, end), F.col("_power")))))
    both = binned(events, spans, by, time).join(spans, [*by, "_power", "_bin"], "inner").where((F.col(time) >= F.col("_low")) & (F.col(time) <= F.col(end))).drop("_power", "_bin", "_low")
    if how == "inner":
        return both
    return both.unionByName(windows.join(both.select(*windows.columns).distinct(), windows.columns, "left_anti"), allowMissingColumns=True)


def bin_of(x: Column, power: Column) -> Column:
    return F.floor(x / F.pow(F.lit(2.0), power))


def binned(events: DataFrame, spans: DataFrame, by: Sequence[str], time: str) -> DataFrame:
    """Events with _power and _bin, once for each power among the spans of their key."""
    powers = spans.groupBy(*by).agg(F.collect_set("_power").alias("_powers"))  # at most one for each bit of a time
    found = events.join(powers, list(by)).withColumn("_power", F.explode("_powers"))
    return found.withColumn("_bin", bin_of(number(events, time), F.col("_power"))).select(*events.columns, "_power", "_bin")


def number(df: DataFrame, column: str) -> Column:
    """A time in microseconds, or a number, as a double."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return micros(df, column).cast("double")
    return F.unix_date(column).cast("double") if isinstance(kind, T.DateType) else F.col(column).cast("double")


def scaffold(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Every row with every category of a small list (checked by count before the cross join)."""
    found = categories.distinct()
    if found.limit(10_001).count() > 10_000:
        raise ValueError("a scaffold takes at most 10000 categories")
    return rows.crossJoin(F.broadcast(found))


def pivot(df: DataFrame, keys: Sequence[str], on: str, values: Sequence[str], agg: Column) -> DataFrame:
    """Long to wide with pinned columns, so that the schema holds whatever the data."""
    return df.groupBy(*keys).pivot(on, list(values)).agg(agg)


def unpivot(df: DataFrame, keys: Sequence[str], values: Sequence[str], variable: str = "variable", value: str = "value") -> DataFrame:
    return df.select(*keys, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(list(keys), list(values), variable, value)


def union_by_name(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
