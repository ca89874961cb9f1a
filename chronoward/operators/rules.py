"""Rule-driven cleaning: plausible ranges, exclusions and flows of counts."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .sequence import jumps, wide_range

Range = dict[str, float]


def _inside(x: Column, rule: Range) -> Column:
    return (x >= F.lit(float(rule["min"]))) & (x <= F.lit(float(rule["max"])))


def plausible(df: DataFrame, column: str, rule: dict, drivers: Sequence[str]) -> Column:
    """The value where its rule's bounds (both included) hold, else null; values without a rule pass.

    A rule is {min, max}, or a mapping from the driver column's value (compared without case) to a rule.
    """
    x = F.col(column)
    if "min" in rule:
        return F.when(_inside(x, rule), x)
    key = F.lower(F.col(drivers[0]))
    out = None
    for name, inner in rule.items():
        value = plausible(df, column, inner, drivers[1:])
        condition = key == F.lit(name.lower())
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(x)


def depth(rule: dict) -> int:
    return 0 if "min" in rule else 1 + max(depth(r) for r in rule.values())


def clean(df: DataFrame, rules: dict[str, dict], drivers: dict[str, Sequence[str]]) -> DataFrame:
    """Implausible values become null, rows and other columns stay. A rule whose column or driver is missing is skipped."""
    out = {}
    for column, rule in rules.items():
        needed = [column, *drivers.get(column, ())[: depth(rule)]]
        if missing := [c for c in needed if c not in df.columns]:
            warnings.warn(f"rule for {column} skipped: no column {missing}", stacklevel=2)
            continue
        out[column] = plausible(df, column, rule, drivers.get(column, ()))
    return df.withColumns(out)


def dropped_values(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values per column before and after cleaning, and how many went."""
    count = lambda df, name: df.agg(*[F.count(c).alias(c) for c in columns]).unpivot([], list(columns), "column", name)
    return count(before, "n_before").join(count(after, "n_after"), "column").withColumn("n_dropped", F.col("n_before") - F.col("n_after"))


def value_exclusions(df: DataFrame, ids: DataFrame, by: str, time: str, value: str, low: float, high: float, most_jump: float, jump_micros: int, most_range: float | None = None, tiebreak: Sequence[str] = ()) -> DataFrame:
    """(id, reason) of ids without a plausible value, with a jump, or with a wide range; each id has its first reason."""
    kept = df.where(F.col(value).between(low, high))
    none = ids.select(by).distinct().join(kept.select(by).distinct(), by, "left_anti").withColumn("reason", F.lit("no_valid_value"))
    jump = jumps(kept, [by], time, value, most_jump, jump_micros, tiebreak).select(by).withColumn("reason", F.lit("jump"))
    out = none.unionByName(jump.join(ids.select(by), by, "left_semi"))
    if most_range is not None:
        wide = wide_range(kept, [by], value, most_range).select(by).join(out.select(by), by, "left_anti").join(ids.select(by), by, "left_semi")
        out = out.unionByName(wide.withColumn("reason", F.lit("range")))
    return out


def flow(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """step, label, n_remaining and n_excluded after each filter in turn, from one pass over the data."""
    keep, sums = F.lit(True), [F.count("*").alias("n0")]
    for i, (_, condition) in enumerate(steps, 1):
        keep = keep & F.coalesce(condition, F.lit(False))
        sums.append(F.count_if(keep).alias(f"n{i}"))
    labels = ["all", *[name for name, _ in steps]]
    one = df.agg(*sums)
    rows = [F.struct(F.lit(i).alias("step"), F.lit(label).alias("label"), F.col(f"n{i}").alias("n_remaining"), (F.col(f"n{max(i - 1, 0)}") - F.col(f"n{i}")).alias("n_excluded")) for i, label in enumerate(labels)]
    return one.select(F.inline(F.array(*rows)))


def flow_markdown(rows: Sequence) -> str:
    lines = ["| step | label | remaining | excluded |", "| --- | --- | --- | --- |"]
    return "\n".join(lines + [f"| {r['step']} | {r['label']} | {r['n_remaining']} | {r['n_excluded']} |" for r in rows])


def priority_dedup(df: DataFrame, keys: Sequence[str], has_category: bool, dose: str = "med_dose", tiebreak: Sequence[str] = ()) -> DataFrame:
    """One dose record for each key: actions that give a dose first, then doses above 0, then larger doses."""
    from .sequence import pick_first

    if has_category:
        a = F.col("mar_action_category")
        rank = F.when(a.isNull(), 10).when(a.isin("verify", "not_given"), 9).when(a == "stop", 8).when(a == "going", 7).otherwise(1)
    else:
        a = F.col("mar_action_name")
        rank = F.when(a.isNull(), 10).when(a.rlike("(?i)verify"), 9).when(a.rlike("(?i)stopped|held|paused|completed"), 8).otherwise(1)
    return pick_first(df, keys, [rank, F.when(F.col(dose) > 0, 1).otherwise(2), F.col(dose).desc_nulls_last(), *tiebreak])
