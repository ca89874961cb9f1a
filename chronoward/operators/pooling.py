"""Pooling of site summaries: no row-level data crosses sites."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import fixed


def pooled_mean_sd(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and sample SD over sites from n, sum and sum_sq; nulls for no rows, null SD under two."""
    p = rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("sum").alias("s"), F.sum("sum_sq").alias("q"))
    variance = F.greatest(F.lit(0.0), (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1))
    return p.select(*keys, "n", F.try_divide(F.col("s"), F.col("n")).alias("mean"), F.when(F.col("n") > 1, F.sqrt(variance)).alias("sd"))


def pooled_quantile(bins: DataFrame, keys: Sequence[str], q: float, integer: bool = False) -> DataFrame:
    """Quantile from summed histograms: the first bin whose running count reaches q of the total, linear inside it."""
    summed = bins.groupBy(*keys, "bin_left", "bin_right").agg(F.sum("count").alias("c")).where("c > 0")
    w = Window.partitionBy(*keys)
    run = summed.withColumn("cum", F.sum("c").over(w.orderBy("bin_left").rowsBetween(Window.unboundedPreceding, 0))).withColumn("target", q * F.sum("c").over(w))
    hit = run.where(F.col("cum") >= F.col("target")).withColumn("rn", F.row_number().over(w.orderBy("bin_left"))).where("rn = 1")
    inside = F.col("bin_left") + (F.col("target") - (F.col("cum") - F.col("c"))) / F.col("c") * (F.col("bin_right") - F.col("bin_left"))
    return hit.select(*keys, (F.col("bin_left") if integer else inside).alias("quantile"))


def pooled_counts(rows: DataFrame, site: str) -> DataFrame:
    """Counts by variable and category over sites; a site's total counts once for each variable."""
    totals = rows.select("variable", site, "total_n").distinct().groupBy("variable").agg(F.sum("total_n").alias("total_n"))
    counts = rows.groupBy("variable", "category").agg(F.sum("n").alias("n"))
    return counts.join(totals, "variable").withColumn("pct", F.try_divide(100.0 * F.col("n"), F.col("total_n")))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Lower and upper bound of a proportion, null for n = 0."""
    p, z2 = F.try_divide(k.cast("double"), n), z * z
    middle = p + z2 / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    ok = n > 0
    return F.when(ok, F.greatest(F.lit(0.0), (middle - half) / (1 + z2 / n))), F.when(ok, F.least(F.lit(1.0), (middle + half) / (1 + z2 / n)))


def student_quantile(p: float, df: float) -> float:
    """Quantile of Student's t, by bisection on the regularised incomplete beta function."""
    low, high = -1e3, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        x = df / (df + mid * mid)
        tail = 0.5 * incomplete_beta(x, df / 2, 0.5)
        low, high = (mid, high) if (1 - tail if mid > 0 else tail) < p else (low, mid)
    return (low + high) / 2


def incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny, c, d, f = 1e-300, 1.0, 0.0, 1.0
    for i in range(400):  # terms 1, d1, d2, ... of 1 / (1 + d1 / (1 + d2 / ...))
        m = i // 2
        term = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + term * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + term / c
        c = c if abs(c) > tiny else tiny
        f *= c * d
        if abs(1.0 - c * d) < 1e-14:
            break
    f -= 1.0  # the leading 1 only started the recurrence
    return front * f


def chi2_upper(x: float, df: float) -> float:
    """Upper tail of the chi-squared distribution (series for the lower incomplete gamma function)."""
    if x <= 0:
        return 1.0
    a, y = df / 2, x / 2
    term = total = 1.0 / a
    for n in range(1, 2000):
        term *= y / (a + n)
        total += term
        if term < total * 1e-15:
            break
    return max(0.0, 1.0 - total * math.exp(-y + a * math.log(y) - math.lgamma(a)))


def random_effects(rows: DataFrame, keys: Sequence[str], effect: str, variance: str, z: float = 1.959963984540054) -> DataFrame:
    """DerSimonian-Laird pooling over the valid studies of each key; nulls with fewer than two."""
    ok = rows.where(F.col(effect).isNotNull() & ~F.isnan(effect) & (F.col(variance) > 0) & ~F.isnan(variance))
    w = 1.0 / F.col(variance)
    y = F.col(effect)
    fixed = ok.groupBy(*keys).agg(F.count("*").alias("_k"), F.sum(w).alias("_sw"), F.sum(w * w).alias("_sw2"), F.sum(w * y).alias("_swy"), F.sum(w * y * y).alias("_swy2"))
    q = F.greatest(F.lit(0.0), F.col("_swy2") - F.col("_swy") * F.col("_swy") / F.col("_sw"))
    c = F.col("_sw") - F.col("_sw2") / F.col("_sw")
    fixed = fixed.withColumn("Q", q).withColumn("tau2", F.when(c > 0, F.greatest(F.lit(0.0), (F.col("Q") - (F.col("_k") - 1)) / c)).otherwise(0.0))
    again = ok.join(fixed, list(keys)).withColumn("_weight", 1.0 / (F.col(variance) + F.col("tau2")))
    pooled = again.groupBy(*keys).agg(F.first("_k").alias("n_studies"), F.first("Q").alias("Q"), F.first("tau2").alias("tau2"), F.sum("_weight").alias("_w"), F.sum(F.col("_weight") * y).alias("_wy"))
    two = F.col("n_studies") >= 2
    out = {
        "pooled": F.col("_wy") / F.col("_w"), "se": F.sqrt(1.0 / F.col("_w")), "tau2": F.col("tau2"), "Q": F.col("Q"),
        "I2": F.when(F.col("Q") > 0, F.greatest(F.lit(0.0), (F.col("Q") - (F.col("n_studies") - 1)) / F.col("Q")) * 100.0).otherwise(0.0),
    }
    done = pooled.select(*keys, "n_studies", *[F.when(two, e).alias(n) for n, e in out.items()])
    return done.withColumn("low", F.col("pooled") - z * F.col("se")).withColumn("high", F.col("pooled") + z * F.col("se"))


def table_one(continuous: DataFrame, categorical: DataFrame, site: str, sites: Sequence[str]) -> DataFrame:
    """Formatted summaries, one column a site: mean (SD) and median [Q1, Q3] of variables, n (%) of each category."""
    known = continuous.where("sd IS NOT NULL"), continuous.where("median IS NOT NULL")
    means = known[0].select(site, "variable", F.lit("mean (SD)").alias("statistic"), F.format_string("%s (%s)", fixed("mean"), fixed("sd")).alias("_text"))
    medians = known[1].select(site, "variable", F.lit("median [Q1, Q3]").alias("statistic"), F.format_string("%s [%s, %s]", fixed("median"), fixed("q1"), fixed("q3")).alias("_text"))
    counts = categorical.select(site, "variable", F.concat(F.col("category"), F.lit(", n (%)")).alias("statistic"), F.format_string("%d (%s)", "n", fixed("pct")).alias("_text"))
    return means.unionByName(medians).unionByName(counts).groupBy("variable", "statistic").pivot(site, list(sites)).agg(F.first("_text"))
