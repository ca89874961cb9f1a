"""Hourly aggregates, sessions and consensus events over event streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def hourly(events: DataFrame, by: str, time: str, value: str, late: str = "2 hours") -> DataFrame:
    """Count, sum and maximum for each entity and hour; rows later than the watermark are dropped."""
    hours = events.withWatermark(time, late).groupBy(by, F.window(time, "1 hour").alias("w"))
    return hours.agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("top")).select(by, F.col("w.start").alias("hour"), "n", "total", "top")


def sessions(events: DataFrame, by: str, time: str, gap: str, late: str = "2 hours") -> DataFrame:
    """Stays stitched by a gap, as session windows."""
    s = events.withWatermark(time, late).groupBy(by, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def consensus(events: DataFrame, by: str, time: str, on: str, window_minutes: float, late: str = "2 hours") -> DataFrame:
    """Confirmed changes of a boolean state: one row (entity, time the new state began, new state) once it has lasted.

    The state of an entity is its confirmed value and the pending change; rows of one trigger are taken in time order.
    """
    schema = f"{by} long, at timestamp, state boolean"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        confirmed, since = state.get if state.exists else (False, None)
        rows = pd.concat(list(frames)).sort_values(time, kind="stable")
        out = []
        for at, now in zip(rows[time], rows[on].fillna(False).astype(bool)):
            micros = int(at.value // 1000)
            if now == confirmed:
                since = None
            elif since is None:
                since = micros
            elif micros - since >= window_minutes * 60_000_000:
                out.append((key[0], pd.Timestamp(since, unit="us"), bool(now)))
                confirmed, since = bool(now), None
        state.update((confirmed, since))
        yield pd.DataFrame(out, columns=[by, "at", "state"]).astype({by: "int64"}) if out else pd.DataFrame({by: pd.Series(dtype="int64"), "at": pd.Series(dtype="datetime64[us]"), "state": pd.Series(dtype="bool")})

    marked = events.withWatermark(time, late).select(by, time, on)
    return marked.groupBy(by).applyInPandasWithState(step, schema, "confirmed boolean, since long", "append", GroupStateTimeout.NoTimeout)
