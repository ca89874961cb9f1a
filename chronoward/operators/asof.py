"""ASOF joins as one union and one window: one shuffle on the key, sorted and spillable, linear in the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def asof_join(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, take: Sequence[str],
    direction: str = "backward", strict: bool = False, tolerance: Column | None = None, tiebreak: Sequence[str] = (), prefix: str = "", parts: int | None = None,
) -> DataFrame:
    """Every left row with the `take` columns of the nearest right row of its key, null where there is none.

    Backward takes the latest right time at or before the left time (before it, if strict), forward the earliest at or
    after it. The nearest *row* counts, even where its values are null. Right rows without a time are ignored, left rows
    without one match nothing. Among right rows of one time the greatest `tiebreak` wins (the least, going forward).
    `tolerance` is a condition on the columns _left_time and _right_time. `parts` is a number of tasks to deal the rows to, for wide ones.
    """
    back, n_ties = direction == "backward", len(tiebreak)
    keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(by)]
    ties = [F.col(c).alias(f"b{i}") for i, c in enumerate(tiebreak)]
    # `s` puts right rows before left rows of the same time in scan order, or after them if strict
    first, second = (0, 1) if back != strict else (1, 0)
    payload = F.struct(F.col(right_on).alias("_t"), *[F.col(c).alias(f"r_{c}") for c in take])
    a = right.where(F.col(right_on).isNotNull()).select(*keys, F.col(right_on).alias("t"), F.lit(first).alias("s"), *ties, payload.alias("r"))
    b = left.select(*keys, F.col(left_on).alias("t"), F.lit(second).alias("s"), F.struct(*[F.col(c).alias(f"l_{c}") for c in left.columns]).alias("l"))
    direction_of = (lambda c: F.col(c).asc_nulls_first()) if back else (lambda c: F.col(c).desc_nulls_last())
    w = Window.partitionBy(*[f"k{i}" for i in range(len(by))]).orderBy(*map(direction_of, ["t", "s", *[f"b{i}" for i in range(n_ties)]]))
    near = F.last("r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    both = a.unionByName(b, allowMissingColumns=True)
    both = both if parts is None else both.repartition(parts, *[f"k{i}" for i in range(len(by))])
    found = both.withColumn("near", near).where("l IS NOT NULL")
    ok = F.col("t").isNotNull()
    if tolerance is not None:
        found = found.withColumn("_left_time", F.col("t")).withColumn("_right_time", F.col("near._t"))
        ok = ok & F.coalesce(tolerance, F.lit(False))
    return found.select(*[F.col(f"l.l_{c}").alias(c) for c in left.columns], *[F.when(ok, F.col(f"near.r_{c}")).alias(f"{prefix}{c}") for c in take])


def asof_or_first(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, value: str, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Backward ASOF value, else the key's first ever value, with _source telling which (asof, fallback, none)."""
    joined = asof_join(left, right.where(F.col(value).isNotNull()), by, left_on, right_on, [value], tiebreak=tiebreak)
    first = right.where(F.col(value).isNotNull() & F.col(right_on).isNotNull()).groupBy(*by).agg(F.min_by(value, F.struct(right_on, *tiebreak)).alias("_first"))
    both = joined.join(first, list(by), "left")
    source = F.when(F.col(value).isNotNull(), "asof").when(F.col("_first").isNotNull(), "fallback").otherwise("none")
    return both.withColumn("_source", source).withColumn(value, F.coalesce(value, "_first")).drop("_first")


def asof_by_category(spine: DataFrame, events: DataFrame, by: Sequence[str], spine_on: str, events_on: str, category: str, value: str, categories: Sequence[str], tiebreak: Sequence[str] = ()) -> DataFrame:
    """One column a category with its latest value at or before the spine's time: one union and one window for all."""
    keys = list(by)
    wide = {f"v_{c}": F.when(F.col(category) == c, F.struct(F.col(value).alias("x"))) for c in categories}
    a = events.where(F.col(category).isin(*categories) & F.col(events_on).isNotNull()).select(*keys, F.col(events_on).alias("t"), F.lit(0).alias("s"), *[F.col(c).alias(f"b{i}") for i, c in enumerate(tiebreak)], *[e.alias(c) for c, e in wide.items()], F.lit(None).alias("l"))
    b = spine.select(*keys, F.col(spine_on).alias("t"), F.lit(1).alias("s"), F.struct(*[F.col(c).alias(f"l_{c}") for c in spine.columns]).alias("l"))
    w = Window.partitionBy(*keys).orderBy("t", "s", *[f"b{i}" for i in range(len(tiebreak))]).rowsBetween(Window.unboundedPreceding, 0)
    filled = a.unionByName(b, allowMissingColumns=True).withColumns({c: F.last(c, ignorenulls=True).over(w) for c in wide}).where("l IS NOT NULL")
    return filled.select(*[F.col(f"l.l_{c}").alias(c) for c in spine.columns], *[F.col(f"v_{c}.x").alias(c) for c in categories])


def starter_rows(anchors: DataFrame, events: DataFrame, by: Sequence[str], anchor_on: str, event_on: str, carry: Sequence[str], tiebreak: Sequence[str] = ()) -> DataFrame:
    """The state before each anchor as a synthetic event at the anchor; anchors without one give no row."""
    found = asof_join(anchors.select(*by, anchor_on), events, by, anchor_on, event_on, [*carry, event_on] if event_on != anchor_on else list(carry), strict=True, tiebreak=tiebreak, prefix="e_")
    return found.where(F.coalesce(*[F.col(f"e_{c}") for c in carry]).isNotNull()).select(*by, F.col(anchor_on).alias(event_on), *[F.col(f"e_{c}").alias(c) for c in carry])
