"""Summaries that can leave a site: counts, sums, histograms, profiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import scans
from .relational import unpivot


def continuous_summary(df: DataFrame, variables: Sequence[str], keys: Sequence[str] = (), by_rank: bool = False) -> DataFrame:
    """One row a variable: n, n_missing, mean, sd, sum, sum_sq, median, q1, q3, min, max.

    `by_rank` ranks counted values over many tasks instead of gathering a group's different values in one buffer.
    """
    x = F.col("value")
    long = unpivot(df, keys, variables)
    if by_rank:
        own = [*keys, "variable"]
        moments = long.groupBy(*own).agg(
            F.count("value").alias("n"), F.count_if(x.isNull()).alias("n_missing"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"),
            F.sum("value").alias("sum"), F.sum(x * x).alias("sum_sq"), F.min("value").alias("min"), F.max("value").alias("max"),
        )
        ranks = scans.quantiles(long, "value", {"median": 0.5, "q1": 0.25, "q3": 0.75}, own).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(own)], "median", "q1", "q3")
        both = moments.join(ranks, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(own)]), "left")
        return both.select(*own, "n", "n_missing", "mean", "sd", "sum", "sum_sq", "median", "q1", "q3", "min", "max")
    q = lambda p: F.expr(f"percentile(value, {p})")
    return long.groupBy(*keys, "variable").agg(
        F.count("value").alias("n"), F.count_if(x.isNull()).alias("n_missing"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"),
        F.sum("value").alias("sum"), F.sum(x * x).alias("sum_sq"), q(0.5).alias("median"), q(0.25).alias("q1"), q(0.75).alias("q3"), F.min("value").alias("min"), F.max("value").alias("max"),
    )


def categorical_summary(df: DataFrame, variables: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """variable, category, n, total_n (rows with a value) and pct."""
    long = df.select(*keys, *[F.col(v).cast("string").alias(v) for v in variables]).unpivot(list(keys), list(variables), "variable", "category").where("category IS NOT NULL")
    counts = long.groupBy(*keys, "variable", "category").agg(F.count("*").alias("n"))
    counts = counts.withColumn("total_n", F.sum("n").over(Window.partitionBy(*keys, "variable")))
    return counts.withColumn("pct", 100.0 * F.col("n") / F.col("total_n"))


def histogram(df: DataFrame, value: str, edges: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Counts on fixed edges with zero rows for empty bins; values are clipped to the edges and the last bin holds its right edge."""
    x = F.least(F.greatest(F.col(value).cast("double"), F.lit(float(edges[0]))), F.lit(float(edges[-1])))
    n = len(edges) - 1
    bin_ = F.least(sum(((x >= F.lit(float(e))).cast("int") for e in edges[1:]), F.lit(0)), F.lit(n - 1))
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("count"))
    rows = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(float(a)).alias("bin_left"), F.lit(float(b)).alias("bin_right")) for i, (a, b) in enumerate(zip(edges, edges[1:]))])
    base = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    grid = base.select(*keys, F.inline(rows))
    return grid.join(counts, [*keys, "bin"], "left").select(*keys, "bin_left", "bin_right", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def half_open_bins(df: DataFrame, value: str, width: float, top: float, stratum: str | None = None) -> DataFrame:
    """stratum, bin_left and count: half-open bins and one open bin from `top`, overall (ALL) and by stratum."""
    left = F.least(F.floor(F.col(value) / width) * width, F.lit(float(top))).cast("double")
    rows = df.where(F.col(value).isNotNull()).select(left.alias("bin_left"), *( [F.col(stratum).alias("stratum")] if stratum else []))
    if not stratum:
        return rows.groupBy("bin_left").agg(F.count("*").alias("count")).withColumn("stratum", F.lit("ALL"))
    sets = rows.groupingSets([["stratum", "bin_left"], ["bin_left"]], "stratum", "bin_left")
    return sets.agg(F.grouping("stratum").alias("g"), F.count("*").alias("count")).select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("stratum")).alias("stratum"), "bin_left", "count")


def counts_grid(df: DataFrame, rows: tuple[str, Sequence], columns: tuple[str, Sequence]) -> DataFrame:
    """Counts of every pair of listed values, zeros included."""
    spark = df.sparkSession
    row_kind, column_kind = df.schema[rows[0]].dataType, df.schema[columns[0]].dataType
    grid = spark.range(1).select(F.explode(F.array(*[F.lit(v).cast(row_kind) for v in rows[1]])).alias(rows[0])).withColumn(columns[0], F.explode(F.array(*[F.lit(v).cast(column_kind) for v in columns[1]])))
    counts = df.groupBy(rows[0], columns[0]).agg(F.count("*").alias("n"))
    return grid.join(counts, [rows[0], columns[0]], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def sufficient_statistics(df: DataFrame, keys: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """n, n_on (not null and above 0), mean, sd, sum and sum_sq by key and variable."""
    x = F.col("value")
    return unpivot(df, keys, variables).groupBy(*keys, "variable").agg(
        F.count("value").alias("n"), F.count_if(x > 0).alias("n_on"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.sum("value").alias("sum"), F.sum(x * x).alias("sum_sq")
    )


def correlations(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of the variables that `df` has, over rows with both, in one aggregation."""
    have = [v for v in variables if v in df.columns]
    pairs = [(a, b) for i, a in enumerate(have) for b in have[i:]]
    x = lambda v, w: F.when(F.col(w).isNotNull(), F.col(v).cast("double"))
    one = df.agg(*[F.corr(x(a, b), x(b, a)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])))


def reference_row(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Medians of the numeric and modes of the categorical columns (ties to the smallest)."""
    return df.agg(*[F.expr(f"percentile(`{c}`, 0.5)").alias(c) for c in numeric], *[F.mode(c, True).alias(c) for c in categorical])


def extremes(df: DataFrame, by: Sequence[str], category: str, value: str, worst_max: Sequence[str], worst_min: Sequence[str]) -> DataFrame:
    """Worst value by category, wide: the greatest of some categories, the least of others."""
    pick = lambda c: F.when(F.col(category) == c, F.col(value))
    return df.groupBy(*by).agg(*[F.max(pick(c)).alias(c) for c in worst_max], *[F.min(pick(c)).alias(c) for c in worst_min])


def pattern_fractions(df: DataFrame, by: Sequence[str], label: str, labels: Sequence[str]) -> DataFrame:
    """Share of each label among an entity's labelled rows."""
    n = F.count(label)
    return df.groupBy(*by).agg(n.alias("n"), *[F.try_divide(F.count_if(F.col(label) == v), n).alias(f"share_{i}") for i, v in enumerate(labels)])


def transitions(df: DataFrame, by: Sequence[str], order: Sequence, label: str) -> DataFrame:
    """Counts and row shares of each label followed by each."""
    w = Window.partitionBy(*by).orderBy(*order)
    pairs = df.select(F.col(label).alias("from"), F.lead(label).over(w).alias("to")).where("`from` IS NOT NULL AND `to` IS NOT NULL")
    counts = pairs.groupBy("from", "to").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("from")))


def tail_shares(df: DataFrame, value: str, cuts: Sequence[float]) -> DataFrame:
    """Share of the rows and of the total absolute value that lie beyond each cut."""
    x = F.abs(F.col(value))
    one = df.where(F.col(value).isNotNull()).agg(F.count("*").alias("n"), F.sum(x).alias("total"), *[F.count_if(x > c).alias(f"n{i}") for i, c in enumerate(cuts)], *[F.sum(F.when(x > c, x)).alias(f"s{i}") for i, c in enumerate(cuts)])
    rows = [F.struct(F.lit(float(c)).alias("cut"), F.try_divide(F.col(f"n{i}"), F.col("n")).alias("row_share"), F.try_divide(F.coalesce(f"s{i}", F.lit(0.0)), F.col("total")).alias("value_share")) for i, c in enumerate(cuts)]
    return one.select(F.inline(F.array(*rows)))


def standardized_difference(df: DataFrame, group: Column, variables: Sequence[str]) -> DataFrame:
    """Difference of means over the pooled standard deviation between rows with and without `group`."""
    long = unpivot(df.withColumn("_g", group.cast("int")), ["_g"], variables).groupBy("variable").agg(
        *[f(F.when(F.col("_g") == g, F.col("value"))).alias(f"{n}{g}") for g in (0, 1) for n, f in (("m", F.avg), ("v", F.var_samp))]
    )
    return long.select("variable", F.try_divide(F.col("m1") - F.col("m0"), F.sqrt((F.col("v1") + F.col("v0")) / 2)).alias("smd"))


def ledger(df: DataFrame, section: str, metrics: dict[str, tuple[Column, str]]) -> DataFrame:
    """section, metric, value and unit of aggregates over `df`, one row each."""
    one = df.agg(*[e.cast("double").alias(f"m{i}") for i, (e, _) in enumerate(metrics.values())])
    rows = [F.struct(F.lit(section).alias("section"), F.lit(m).alias("metric"), F.col(f"m{i}").alias("value"), F.lit(u).alias("unit")) for i, (m, (_, u)) in enumerate(metrics.items())]
    return one.select(F.inline(F.array(*rows)))
