"""Dose units: cleaning of unit text and conversion through a table of factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Mass units in micrograms, time units in minutes, pounds in kilograms.
MASS = {"ng": 0.001, "mcg": 1.0, "mg": 1000.0, "g": 1000000.0}
MINUTES = {"min": 1.0, "hr": 60.0}
LB_PER_KG = 2.20462


def clean_unit(unit: Column) -> Column:
    """Lower case, no blanks, 'h', 'hour' as hr, 'm', 'minute' as min, 'u' units and the micro sign spelled out."""
    u = F.regexp_replace(F.lower(unit), r"\s+", "")
    u = F.regexp_replace(u, "^[µμ]g|^ug", "mcg")
    u = F.regexp_replace(u, "/(hour|hours|h)$", "/hr")
    return F.regexp_replace(u, "/(minute|minutes|m)$", "/min")


def convert(df: DataFrame, dose: str, unit: str, weight: str, to: str = "mcg/kg/min") -> DataFrame:
    """Adds dose_converted, unit_converted and convert_status.

    Target units are mass[/kg][/time]. A unit per weight needs a weight: where it is null the dose becomes null and the
    status says so, the row stays. Units that cannot be read keep their dose and say so.
    """
    target = to.split("/")
    parts = F.split(clean_unit(F.col(unit)), "/")
    mass = F.element_at(parts, 1)
    by_weight = F.array_contains(parts, "kg"), F.array_contains(parts, "lb")
    time = F.element_at(parts, -1)
    pick = lambda key, table: F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in table.items()])
    mass_factor, minutes = pick(mass, MASS), pick(time, MINUTES)
    timed = minutes.isNotNull()
    wants_time, wants_weight = target[-1] in MINUTES, "kg" in target
    value = F.col(dose) * mass_factor / F.lit(MASS[target[0]])
    if wants_time:
        value = value / minutes * F.lit(MINUTES[target[-1]])
    kg = F.col(weight)
    needs = ~by_weight[0] & ~by_weight[1] if wants_weight else by_weight[0] | by_weight[1]
    if wants_weight:
        value = F.when(by_weight[0], value).when(by_weight[1], value * LB_PER_KG).otherwise(F.try_divide(value, kg))
    else:
        value = F.when(by_weight[0], value * kg).when(by_weight[1], value * kg * LB_PER_KG).otherwise(value)
    status = (
        F.when(F.col(unit).isNull(), "missing unit").when(mass_factor.isNull(), "unknown mass").when(timed != F.lit(wants_time), "time mismatch")
        .when(needs & kg.isNull(), "missing weight").otherwise("success")
    )
    return df.withColumn("convert_status", status).withColumn("dose_converted", F.when(status == "success", value).when(status == "missing weight", F.lit(None)).otherwise(F.col(dose))).withColumn(
        "unit_converted", F.when(status.isin("success", "missing weight"), F.lit(to)).otherwise(F.col(unit))
    )


def conversion_counts(df: DataFrame, unit: str) -> DataFrame:
    """Rows of each unit and status, rows without a unit included."""
    return df.groupBy(unit, "convert_status").agg(F.count("*").alias("n"), F.count("dose_converted").alias("n_converted"))


def norepinephrine_equivalent(norepinephrine: Column, epinephrine: Column, phenylephrine: Column, vasopressin: Column, dopamine: Column, angiotensin: Column) -> Column:
    """Weighted sum of pressor rates; a missing rate counts as 0."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return z(norepinephrine) + z(epinephrine) + z(phenylephrine) / 10.0 + z(dopamine) / 100.0 + z(vasopressin) * 2.5 + z(angiotensin) * 10.0
