"""Audits as long tables: where entities leave a funnel, how two detectors class them, what cleaning rules would drop."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .registry import exit_mechanism
from .summary import ledger

#: How a stay ended, the first that holds.
EXIT_ORDER = (("_trach", "tracheostomy"), ("_success_extub", "successful extubation"), ("_fail_extub", "failed extubation"), ("_withdrawl_lst", "withdrawal"))


def stacked(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def funnel(rows: DataFrame, filled: DataFrame, outcomes: DataFrame, by: str, day: Column) -> DataFrame:
    """Six stages of an event (a tracheostomy) from raw rows to the exit classes, as section, metric, value and unit.

    `rows` and `filled` have `tracheostomy`, before and after it is carried on; `outcomes` the columns of `trial_outcomes`.
    """
    entities = lambda flag: F.countDistinct(F.when(flag, F.col(by)))
    had = F.col("tracheostomy") == 1
    daily = outcomes.groupBy(by, day.alias("_day")).agg(*[F.max(c).alias(c) for c in ("_trach_1st", "_trach_v2")])
    classes = [exit_classes(outcomes, by, suffix).groupBy("class").agg(F.count("*").cast("double").alias("value")).select(F.lit(f"f: exits {name}").alias("section"), F.col("class").alias("metric"), "value", F.lit("entities").alias("unit")) for suffix, name in (("", "v1"), ("_v2", "v2"))]
    return stacked([
        ledger(rows, "a: cohort", {"rows": (F.count("*"), "rows"), "entities": (F.countDistinct(by), "entities")}),
        ledger(rows, "b: raw", {"rows with it": (F.count_if(had), "rows"), "entities with it": (entities(had), "entities")}),
        ledger(filled, "c: carried on", {"rows with it": (F.count_if(had), "rows"), "entities with it": (entities(had), "entities")}),
        ledger(outcomes, "d: events", {"first changes": (F.sum("_trach_1st"), "rows"), "entities v1": (entities(F.col("_trach_1st") == 1), "entities"), "entities v2": (entities(F.col("_trach_v2") == 1), "entities")}),
        ledger(daily, "e: days", {"days": (F.count("*"), "days"), "days v1": (F.sum("_trach_1st"), "days"), "days v2": (F.sum("_trach_v2"), "days")}),
        *classes,
    ])


def exit_classes(outcomes: DataFrame, by: str, suffix: str = "") -> DataFrame:
    """One class for each entity from its outcome flags, by either detector."""
    flag = {"_trach": "_trach_v2" if suffix else "_trach_1st", **{c: f"{c}{suffix}" for c, _ in EXIT_ORDER[1:]}}
    ever = outcomes.groupBy(by).agg(*[F.max(column).alias(name) for name, column in flag.items()])
    return ever.select(by, exit_mechanism(list(EXIT_ORDER), "other").alias("class"))


def reclassified(outcomes: DataFrame, by: str) -> DataFrame:
    """How many entities go from which class of the first detector to which of the second."""
    both = exit_classes(outcomes, by).withColumnRenamed("class", "v1").join(exit_classes(outcomes, by, "_v2").withColumnRenamed("class", "v2"), by)
    return both.groupBy("v1", "v2").agg(F.count("*").alias("n"))


def section(df: DataFrame, name: str, metric: Column, value: str, unit: str) -> DataFrame:
    """Rows of an aggregate as ledger rows."""
    return df.select(F.lit(name).alias("section"), metric.cast("string").alias("metric"), F.col(value).cast("double").alias("value"), F.lit(unit).alias("unit"))


def stitch_summary(blocks: DataFrame, block: Sequence[str], spans: DataFrame, entity: str, hours: str) -> DataFrame:
    """Sizes of stitched blocks and what became of the stays that are not their block's first: without support, under and
    from a day of it. `blocks` has a row a stay with `is_first`; `spans` the hours of support of stays that had any."""
    sizes = blocks.groupBy(*block).agg(F.count("*").alias("size"))
    lost = blocks.where("NOT is_first").join(spans, entity, "left")
    one = {"blocks": F.count("*"), "of one": F.count_if(F.col("size") == 1), "of two": F.count_if(F.col("size") == 2), "of more": F.count_if(F.col("size") > 2), "mean": F.round(F.avg("size"), 4), "sd": F.round(F.stddev_samp("size"), 4), "least": F.min("size"), "most": F.max("size")}
    two = {"stays": F.count("*"), "no support": F.count_if(F.col(hours).isNull()), "under 24 h": F.count_if(F.col(hours) < 24), "24 h or more": F.count_if(F.col(hours) >= 24)}
    return ledger(sizes, "block size", {k: (v, "blocks") for k, v in one.items()}).unionByName(ledger(lost, "later stays", {k: (v, "stays") for k, v in two.items()}))
