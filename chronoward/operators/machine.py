"""Consensus-window state machine over an entity's ordered rows, by windows alone: one shuffle, sorted and spillable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.localtime import micros
from .sequence import islands, running

FLAGS = ("_on_event", "_off_event", "_stop_event")
MINUTE = 60_000_000


def consensus_events(df: DataFrame, by: str, time: str, on: str, stop: str, on_window: float = 15, off_window: float = 30, tiebreak: Sequence[str] = ()) -> DataFrame:
    """`df` with 0/1 columns _on_event, _off_event and _stop_event.

    A change of state counts once the new state has lasted its window (in minutes); the row that began it is the one marked.
    A return inside the window cancels it, and an unconfirmed change at the end marks nothing. The first stop row ends an
    open episode (at the row where an unconfirmed off state began, else at the stop itself) and everything after it. A stop
    before any on row is marked alone. Null states count as off, null stops as none; rows without a time are left out.

    A run of equal states is confirmed if it lasts its window, and changes the state if the last confirmed run before it
    had the other one.
    """
    order = [time, *tiebreak]
    df = df.where(F.col(time).isNotNull())
    stops = F.coalesce(F.col(stop).cast("boolean"), F.lit(False)).cast("int")
    rows = df.withColumn("_stops", F.sum(stops).over(running([by], order)))
    rows = rows.withColumn("_state", F.when(F.col("_stops") == 0, F.coalesce(F.col(on).cast("boolean"), F.lit(False))))
    rows = islands(rows, [by], order, {"_run": F.struct("_state", "_stops")})
    in_run, entity = Window.partitionBy(by, "_run"), Window.partitionBy(by)
    lasted = F.max(micros(df, time)).over(in_run) - F.min(micros(df, time)).over(in_run)
    window = F.when(F.col("_state"), F.lit(on_window * MINUTE)).otherwise(F.lit(off_window * MINUTE))
    rows = rows.withColumn("_long", F.coalesce(F.col("_state").isNotNull() & (F.count("*").over(in_run) > 1) & (lasted >= window), F.lit(False)))
    in_order = Window.partitionBy(by).orderBy(*order)
    first = F.coalesce(F.lag("_run").over(in_order) != F.col("_run"), F.lit(True))
    confirmed = F.last(F.when(F.col("_long"), F.col("_state")), ignorenulls=True).over(entity.orderBy("_run").rangeBetween(Window.unboundedPreceding, -1))
    stop_here = (F.col("_stops") == 1) & (stops == 1)
    rows = rows.withColumns({"_first": first, "_was_on": F.coalesce(confirmed, F.lit(False)), "_before": F.lag("_state").over(in_order), "_stop_run": F.min(F.when(stop_here, F.col("_run"))).over(entity)})
    begins = F.col("_first") & F.col("_state").isNotNull()
    cut_short = F.coalesce(F.col("_run") == F.col("_stop_run") - 1, F.lit(False))
    flags = {
        "_on_event": begins & F.col("_state") & F.col("_long") & ~F.col("_was_on"),
        "_off_event": (begins & ~F.col("_state") & F.col("_was_on") & (F.col("_long") | cut_short)) | (stop_here & F.coalesce(F.col("_before"), F.lit(False))),
        "_stop_event": stop_here,
    }
    return rows.select(*df.columns, *[F.coalesce(e, F.lit(False)).cast("int").alias(n) for n, e in flags.items()])
