"""Aggregations and descriptive summaries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import columns as C
from ..functions.localtime import micros
from ..operators import relational as R
from ..operators import scans
from ..operators import summary as M
from .base import HOUR_US, r, t
from .projection import DAY_NIGHT, SIX, _day_night

EDGES = [0.0, 25.0, 50.0, 75.0, 100.0]


def d01(s, d):
    return t(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), r(F.sum("l_quantity")).alias("total"), r(F.avg("l_discount"), 6).alias("mean_discount"), F.count("*").alias("n"))


def d02(s, d):
    return t(s, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("n_click"), F.count_if((F.col("event_type") == "error") & (F.col("value") > 10)).alias("n_bad"))


def d03(s, d):
    h = F.hour("ts")
    return t(s, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max(F.when((h >= 7) & (h < 19), F.col("value"))).alias("top_day"), F.max(F.when((h < 7) | (h >= 19), F.col("value"))).alias("top_night"))


def d04(s, d):
    return t(s, d, "orders").groupBy("o_orderstatus").agg(F.countDistinct("o_custkey").alias("n_customers"), F.countDistinct(F.when(F.col("o_totalprice") > 200000, F.col("o_custkey"))).alias("n_large"))


def d05(s, d):
    return t(s, d, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("ever_bought"))


def d06(s, d):
    return t(s, d, "events").groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"))


def d07(s, d):
    v = F.when(F.col("value") > 50, F.col("value"))
    return t(s, d, "events").withColumn("v", v).where("v IS NOT NULL").groupBy("user_id").agg(F.min_by("v", F.struct("ts", "event_id")).alias("first_large"))


def d08(s, d):
    return t(s, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ";").alias("kinds"))


def d09(s, d):
    return t(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).where("n > 70")


def d10(s, d):
    return t(s, d, "events").groupBy("event_type").agg(r(F.expr("percentile(CASE WHEN value > 5 THEN value END, 0.9)")).alias("p90"))


def d10b(s, d):
    return scans.quantiles(t(s, d, "events").where("value > 5"), "value", {"p90": 0.9}, ["event_type"]).select("event_type", r("p90").alias("p90"))


def d11b(s, d):
    return scans.quantiles(t(s, d, "customer"), "c_acctbal", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["c_mktsegment"]).select("c_mktsegment", *[r(c).alias(c) for c in ("q1", "median", "q3")])


def d12b(s, d):
    df = t(s, d, "customer").select("c_acctbal").withColumn("large", F.expr("CASE WHEN c_acctbal > 0 THEN c_acctbal END"))
    return M.continuous_summary(df, ["c_acctbal", "large"], by_rank=True).select("variable", "n", "n_missing", *[r(c, 2).alias(c) for c in ("mean", "sd", "sum", "median", "q1", "q3", "min", "max")], r(F.col("sum_sq") / 1e6, 2).alias("sum_sq_m"))


def d11(s, d):
    return t(s, d, "customer").groupBy("c_mktsegment").agg(*[r(F.expr(f"percentile(c_acctbal, {p})")).alias(n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])


def d12(s, d):
    df = t(s, d, "customer").select("c_acctbal").withColumn("large", F.expr("CASE WHEN c_acctbal > 0 THEN c_acctbal END"))
    return M.continuous_summary(df, ["c_acctbal", "large"]).select("variable", "n", "n_missing", *[r(c, 2).alias(c) for c in ("mean", "sd", "sum", "median", "q1", "q3", "min", "max")], r(F.col("sum_sq") / 1e6, 2).alias("sum_sq_m"))


def d13(s, d):
    df = t(s, d, "orders").select("o_orderpriority", "o_orderstatus")
    return M.categorical_summary(df, ["o_orderpriority", "o_orderstatus"]).select("variable", "category", "n", "total_n", r("pct").alias("pct"))


def d14(s, d):
    return M.histogram(t(s, d, "events"), "value", EDGES)


def d15(s, d):
    days = t(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.expr("CASE WHEN bool_or(event_type = 'purchase') THEN 'buyer' ELSE 'other' END").alias("kind"))
    return M.half_open_bins(days, "n", 10, 80, "kind")


def d16(s, d):
    df = t(s, d, "events").withColumn("day", C.cap_day(F.dayofmonth("ts"))).select("day", "event_type")
    return M.counts_grid(df, ("day", ["1", "2", "3", "4", "5", "6", "7", "8+"]), ("event_type", ["click", "view", "purchase", "error", "signup", "refund"]))


def d17(s, d):
    # figures of cents can lie half-way between two roundings: they follow from longer ones, by one rule in both engines
    three = lambda x: F.floor(x * 1000 + 0.5) / 1000.0
    return M.sufficient_statistics(_day_night(s, d).withColumn("dom", F.dayofmonth("day")), ["dom"], ["rate_day", "rate_night"]).select("dom", "variable", "n", "n_on", three(r("sum") / F.col("n")).alias("mean"), r("sd", 3).alias("sd"), r("sum").alias("sum"), three(r("sum_sq", 6)).alias("sum_sq"))


def d18(s, d):
    return M.correlations(t(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "absent"]).select("a", "b", r("r").alias("r"))


def d19(s, d):
    e = t(s, d, "events")
    first = e.groupBy("user_id").agg(F.min("ts").alias("first_ts"))
    j = e.join(first, "user_id")
    hour = F.floor((micros(j, "ts") - micros(j, "first_ts")) / HOUR_US).cast("long")
    return j.withColumn("hour_of_stay", hour).where("hour_of_stay < 168").groupBy("hour_of_stay").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("n_click"), r(F.avg("value")).alias("mean_value"))


def d20(s, d):
    return M.reference_row(t(s, d, "customer"), ["c_acctbal"], ["c_mktsegment"]).select(r("c_acctbal").alias("c_acctbal"), "c_mktsegment")


def d21(s, d):
    return M.extremes(t(s, d, "events"), ["user_id"], "event_type", "value", ["error", "purchase"], ["click", "view"])


def d22(s, d):
    return t(s, d, "events").where("value IS NOT NULL").groupBy("user_id").agg(F.min("value").alias("least"), F.min_by("event_type", F.struct("value", "event_id")).alias("source"))


def d23(s, d):
    return t(s, d, "orders").groupBy("o_custkey").agg(r(F.sum("o_totalprice"), 2).alias("spent")).orderBy(F.desc("spent"), "o_custkey").limit(20)


def d24(s, d):
    cuts = [10.0, 25.0, 50.0, 75.0]
    one = t(s, d, "events").groupBy("user_id").agg(F.max("value").alias("top")).agg(F.count("*").alias("n"), *[F.count_if(F.col("top") > c).alias(f"k{i}") for i, c in enumerate(cuts)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("cut"), F.col(f"k{i}").alias("n_excluded"), r(F.col(f"k{i}") / F.col("n")).alias("share")) for i, c in enumerate(cuts)])))


def d25(s, d):
    e = t(s, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    hours = (micros(e, "ts") - F.lag(micros(e, "ts")).over(w)) / float(HOUR_US)
    return e.select(C.bucket(hours, [1, 6, 12, 24], ["<1h", "1-6h", "6-12h", "12-24h", ">=24h"], "first").alias("age")).groupBy("age").agg(F.count("*").alias("n"))


def d26(s, d):
    x = F.round(F.col("p_retailprice")).cast("long")
    return t(s, d, "part").agg(*[r(F.avg((e).cast("int")), 6).alias(n) for n, e in (("share_integer", F.col("p_retailprice") == F.floor("p_retailprice")), ("share_5", x % 5 == 0), ("share_10", x % 10 == 0))])


def d27(s, d):
    e = t(s, d, "events").withColumn("band", F.when(F.col("value") > 50, "high").when(F.col("value") > 10, "mid"))
    return e.groupBy("event_type", "band").agg(F.count("*").alias("n"))


def d28(s, d):
    x = _day_night(s, d)
    single = F.col("rate_day").isNull() != F.col("rate_night").isNull()
    return x.groupBy(F.dayofmonth("day").alias("dom")).agg(F.count("*").alias("n"), F.count_if(single).alias("n_single"), r(F.avg(single.cast("int"))).alias("share_single"))


def d29(s, d):
    return M.continuous_summary(t(s, d, "lineitem"), ["l_quantity"], ["l_returnflag"]).select("l_returnflag", "n", "n_missing", "q1", "median", "q3", "min", "max")


def d30a(s, d):
    labels = list(C.SIX_GROUPS)
    x = _day_night(s, d).withColumn("label", C.six_groups(F.col("rate_day"), F.col("rate_night"), 20.0))
    f = M.pattern_fractions(x, ["user_id"], "label", labels)
    return f.select("user_id", "n", r("share_0").alias("share_day"), r("share_5").alias("share_night"))


def d30b(s, d):
    x = _day_night(s, d).withColumn("label", C.six_groups(F.col("rate_day"), F.col("rate_night"), 20.0))
    return M.transitions(x, ["user_id"], ["day"], "label").select("from", "to", "n", r("share").alias("share"))


def d30c(s, d):
    return M.tail_shares(t(s, d, "events"), "value", [20.0, 50.0, 80.0]).select("cut", r("row_share").alias("row_share"), r("value_share").alias("value_share"))


def d30d(s, d):
    return M.standardized_difference(t(s, d, "customer"), F.col("c_mktsegment") == "BUILDING", ["c_acctbal", "c_nationkey"]).select("variable", r("smd").alias("smd"))


def d31(s, d):
    e = t(s, d, "events").groupBy("user_id").agg(F.avg("value").alias("avg_v"), F.max("value").alias("max_v"), F.min_by("value", F.struct("ts", "event_id")).alias("first_v"))
    diffs = {"max_vs_mean": F.abs(F.col("max_v") - F.col("avg_v")), "first_vs_mean": F.abs(F.col("first_v") - F.col("avg_v")), "first_vs_max": F.abs(F.col("first_v") - F.col("max_v"))}
    long = R.unpivot(e.select(*[x.alias(n) for n, x in diffs.items()]), [], list(diffs))
    return long.groupBy("variable").agg(r(F.expr("percentile(value, 0.5)"), 3).alias("median"), r(F.expr("percentile(value, 0.95)"), 3).alias("p95"))


FIRST = "SELECT user_id, arg_min(CASE WHEN value > 50 THEN value END, ts) FILTER (WHERE value > 50) AS first_large FROM events WHERE value > 50 GROUP BY 1"
CASES = {
    "d01_group_by": (d01, "SELECT l_returnflag, l_linestatus, min(l_quantity) AS lo, max(l_quantity) AS hi, round(sum(l_quantity), 4) AS total, round(avg(l_discount), 6) AS mean_discount, count(*) AS n FROM lineitem GROUP BY 1, 2"),
    "d02_count_filter": (d02, "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS n_click, count(*) FILTER (WHERE event_type = 'error' AND value > 10) AS n_bad FROM events GROUP BY 1"),
    "d03_day_night": (d03, "SELECT user_id, CAST(ts AS DATE) AS day, max(value) FILTER (WHERE hour(ts) >= 7 AND hour(ts) < 19) AS top_day, max(value) FILTER (WHERE hour(ts) < 7 OR hour(ts) >= 19) AS top_night FROM events GROUP BY 1, 2"),
    "d04_count_distinct": (d04, "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n_customers, count(DISTINCT o_custkey) FILTER (WHERE o_totalprice > 200000) AS n_large FROM orders GROUP BY 1"),
    "d05_bool_or": (d05, "SELECT user_id, bool_or(event_type = 'purchase') AS ever_bought FROM events GROUP BY 1"),
    "d06_ordered_first": (d06, "SELECT user_id, first(event_type ORDER BY ts, event_id) AS first_type FROM events GROUP BY 1"),
    "d07_first_not_null": (d07, "SELECT user_id, first(value ORDER BY ts, event_id) AS first_large FROM events WHERE value > 50 GROUP BY 1"),
    "d08_string_agg": (d08, "SELECT user_id, string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS kinds FROM events GROUP BY 1"),
    "d09_having": (d09, "SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 70"),
    "d10_quantile_filter": (d10, "SELECT event_type, round(quantile_cont(value, 0.9) FILTER (WHERE value > 5), 4) AS p90 FROM events GROUP BY 1"),
    "d10_quantile_filter_by_rank": (d10b, "SELECT event_type, round(quantile_cont(value, 0.9) FILTER (WHERE value > 5), 4) AS p90 FROM events GROUP BY 1"),
    "d11_quartiles": (d11, "SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.25), 4) AS q1, round(quantile_cont(c_acctbal, 0.5), 4) AS median, round(quantile_cont(c_acctbal, 0.75), 4) AS q3 FROM customer GROUP BY 1"),
    "d11_quartiles_by_rank": (d11b, "SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.25), 4) AS q1, round(quantile_cont(c_acctbal, 0.5), 4) AS median, round(quantile_cont(c_acctbal, 0.75), 4) AS q3 FROM customer GROUP BY 1"),
    "d12_continuous": (d12, "SELECT variable, count(v) AS n, count(*) - count(v) AS n_missing, round(avg(v), 2) AS mean, round(stddev_samp(v), 2) AS sd, round(sum(v), 2) AS sum, round(median(v), 2) AS median, round(quantile_cont(v, 0.25), 2) AS q1, round(quantile_cont(v, 0.75), 2) AS q3, round(min(v), 2) AS min, round(max(v), 2) AS max, round(sum(v * v) / 1e6, 2) AS sum_sq_m FROM (SELECT 'c_acctbal' AS variable, c_acctbal AS v FROM customer UNION ALL SELECT 'large', CASE WHEN c_acctbal > 0 THEN c_acctbal END FROM customer) GROUP BY 1"),
    "d12_continuous_by_rank": (d12b, "SELECT variable, count(v) AS n, count(*) - count(v) AS n_missing, round(avg(v), 2) AS mean, round(stddev_samp(v), 2) AS sd, round(sum(v), 2) AS sum, round(median(v), 2) AS median, round(quantile_cont(v, 0.25), 2) AS q1, round(quantile_cont(v, 0.75), 2) AS q3, round(min(v), 2) AS min, round(max(v), 2) AS max, round(sum(v * v) / 1e6, 2) AS sum_sq_m FROM (SELECT 'c_acctbal' AS variable, c_acctbal AS v FROM customer UNION ALL SELECT 'large', CASE WHEN c_acctbal > 0 THEN c_acctbal END FROM customer) GROUP BY 1"),
    "d13_categorical": (d13, "SELECT variable, category, n, CAST(sum(n) OVER (PARTITION BY variable) AS BIGINT) AS total_n, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY variable), 4) AS pct FROM (SELECT 'o_orderpriority' AS variable, o_orderpriority AS category, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY 2)"),
    "d14_histogram": (d14, "SELECT b.l AS bin_left, b.r AS bin_right, count(value) AS count FROM (VALUES (0.0::DOUBLE, 25.0::DOUBLE), (25.0::DOUBLE, 50.0::DOUBLE), (50.0::DOUBLE, 75.0::DOUBLE), (75.0::DOUBLE, 100.0::DOUBLE)) b(l, r) LEFT JOIN (SELECT least(greatest(value, 0.0), 100.0) AS value FROM events WHERE value IS NOT NULL) ON value >= l AND (value < r OR (r = 100.0 AND value = 100.0)) GROUP BY 1, 2"),
    "d15_half_open_bins": (d15, "WITH x AS (SELECT least(floor(n / 10) * 10, 80) AS bin_left, kind FROM (SELECT user_id, count(*) AS n, CASE WHEN bool_or(event_type = 'purchase') THEN 'buyer' ELSE 'other' END AS kind FROM events GROUP BY 1)) SELECT coalesce(kind, 'ALL') AS stratum, CAST(bin_left AS DOUBLE) AS bin_left, count(*) AS count FROM x GROUP BY GROUPING SETS ((kind, bin_left), (bin_left))"),
    "d16_counts_grid": (d16, "SELECT g.day, g.event_type, count(e.event_id) AS n FROM (SELECT * FROM (VALUES ('1'),('2'),('3'),('4'),('5'),('6'),('7'),('8+')) a(day), (VALUES ('click'),('view'),('purchase'),('error'),('signup'),('refund')) b(event_type)) g LEFT JOIN events e ON e.event_type = g.event_type AND CASE WHEN day(e.ts) > 7 THEN '8+' ELSE CAST(day(e.ts) AS VARCHAR) END = g.day GROUP BY 1, 2"),
    "d17_sufficient": (d17, f"SELECT CAST(day(day) AS INTEGER) AS dom, variable, count(v) AS n, count(*) FILTER (WHERE v > 0) AS n_on, floor(round(sum(v), 4) / count(v) * 1000 + 0.5) / 1000.0::DOUBLE AS mean, round(stddev_samp(v), 3) AS sd, round(sum(v), 4) AS sum, floor(round(sum(v * v), 6) * 1000 + 0.5) / 1000.0::DOUBLE AS sum_sq FROM (SELECT day, 'rate_day' AS variable, rate_day AS v FROM ({DAY_NIGHT}) UNION ALL SELECT day, 'rate_night', rate_night FROM ({DAY_NIGHT})) GROUP BY 1, 2"),
    "d18_correlations": (d18, "SELECT 'l_quantity' AS a, 'l_quantity' AS b, round(corr(l_quantity, l_quantity), 4) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_extendedprice', round(corr(l_quantity, l_extendedprice), 4) FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 4) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_extendedprice', round(corr(l_extendedprice, l_extendedprice), 4) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 4) FROM lineitem UNION ALL SELECT 'l_discount', 'l_discount', round(corr(l_discount, l_discount), 4) FROM lineitem"),
    "d19_hour_profile": (d19, "SELECT CAST(floor((epoch_us(ts) - epoch_us(first_ts)) / 3600000000) AS BIGINT) AS hour_of_stay, count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS n_click, round(avg(value), 4) AS mean_value FROM events JOIN (SELECT user_id, min(ts) AS first_ts FROM events GROUP BY 1) USING (user_id) GROUP BY 1 HAVING hour_of_stay < 168"),
    "d20_reference_row": (d20, "SELECT (SELECT round(median(c_acctbal), 4) FROM customer) AS c_acctbal, (SELECT c_mktsegment FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS c_mktsegment"),
    "d21_extremes": (d21, "SELECT user_id, max(value) FILTER (WHERE event_type = 'error') AS error, max(value) FILTER (WHERE event_type = 'purchase') AS purchase, min(value) FILTER (WHERE event_type = 'click') AS click, min(value) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY 1"),
    "d22_min_source": (d22, "SELECT user_id, min(value) AS least, first(event_type ORDER BY value, event_id) AS source FROM events WHERE value IS NOT NULL GROUP BY 1"),
    "d23_top_n": (d23, "SELECT o_custkey, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1 ORDER BY spent DESC, o_custkey LIMIT 20"),
    "d24_cutoffs": (d24, "SELECT cut, count(*) FILTER (WHERE top > cut) AS n_excluded, round(count(*) FILTER (WHERE top > cut) / count(*), 4) AS share FROM (SELECT user_id, max(value) AS top FROM events GROUP BY 1), (VALUES (10.0::DOUBLE), (25.0::DOUBLE), (50.0::DOUBLE), (75.0::DOUBLE)) c(cut) GROUP BY 1"),
    "d25_staleness": (d25, "SELECT CASE WHEN h IS NULL THEN 'first' WHEN h < 1 THEN '<1h' WHEN h < 6 THEN '1-6h' WHEN h < 12 THEN '6-12h' WHEN h < 24 THEN '12-24h' ELSE '>=24h' END AS age, count(*) AS n FROM (SELECT (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 3600000000.0 AS h FROM events) GROUP BY 1"),
    "d26_round_numbers": (d26, "SELECT round(avg(CAST(p_retailprice = floor(p_retailprice) AS INTEGER)), 6) AS share_integer, round(avg(CAST(CAST(round(p_retailprice) AS BIGINT) % 5 = 0 AS INTEGER)), 6) AS share_5, round(avg(CAST(CAST(round(p_retailprice) AS BIGINT) % 10 = 0 AS INTEGER)), 6) AS share_10 FROM part"),
    "d27_null_groups": (d27, "SELECT event_type, CASE WHEN value > 50 THEN 'high' WHEN value > 10 THEN 'mid' END AS band, count(*) AS n FROM events GROUP BY 1, 2"),
    "d28_single_shift": (d28, f"SELECT CAST(day(day) AS INTEGER) AS dom, count(*) AS n, count(*) FILTER (WHERE (rate_day IS NULL) <> (rate_night IS NULL)) AS n_single, round(avg(CAST((rate_day IS NULL) <> (rate_night IS NULL) AS INTEGER)), 4) AS share_single FROM ({DAY_NIGHT}) GROUP BY 1"),
    "d29_grouped_summary": (d29, "SELECT l_returnflag, count(l_quantity) AS n, count(*) - count(l_quantity) AS n_missing, quantile_cont(l_quantity, 0.25) AS q1, median(l_quantity) AS median, quantile_cont(l_quantity, 0.75) AS q3, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem GROUP BY 1"),
    "d30_pattern_fractions": (d30a, f"SELECT user_id, count(label) AS n, round(count(*) FILTER (WHERE label = 'Markedly higher at day') / count(label), 4) AS share_day, round(count(*) FILTER (WHERE label = 'Markedly higher at night') / count(label), 4) AS share_night FROM (SELECT user_id, {SIX} AS label FROM ({DAY_NIGHT})) GROUP BY 1"),
    "d30_transitions": (d30b, f"WITH p AS (SELECT label AS f, lead(label) OVER (PARTITION BY user_id ORDER BY day) AS g FROM (SELECT user_id, day, {SIX} AS label FROM ({DAY_NIGHT}))), n AS (SELECT f, g, count(*) AS n FROM p WHERE f IS NOT NULL AND g IS NOT NULL GROUP BY 1, 2) SELECT f AS \"from\", g AS \"to\", n, round(n / sum(n) OVER (PARTITION BY f), 4) AS share FROM n"),
    "d30_tail_shares": (d30c, "SELECT cut, round(count(*) FILTER (WHERE abs(value) > cut) / count(*), 4) AS row_share, round(coalesce(sum(abs(value)) FILTER (WHERE abs(value) > cut), 0) / sum(abs(value)), 4) AS value_share FROM events, (VALUES (20.0::DOUBLE), (50.0::DOUBLE), (80.0::DOUBLE)) c(cut) WHERE value IS NOT NULL GROUP BY 1"),
    "d30_smd": (d30d, "SELECT variable, round((avg(v) FILTER (WHERE g) - avg(v) FILTER (WHERE NOT g)) / sqrt((var_samp(v) FILTER (WHERE g) + var_samp(v) FILTER (WHERE NOT g)) / 2), 4) AS smd FROM (SELECT c_mktsegment = 'BUILDING' AS g, 'c_acctbal' AS variable, c_acctbal AS v FROM customer UNION ALL SELECT c_mktsegment = 'BUILDING', 'c_nationkey', CAST(c_nationkey AS DOUBLE) FROM customer) GROUP BY 1"),
    "d31_strategies": (d31, "WITH e AS (SELECT user_id, avg(value) AS a, max(value) AS m, first(value ORDER BY ts, event_id) AS f FROM events GROUP BY 1) SELECT variable, round(median(v), 3) AS median, round(quantile_cont(v, 0.95), 3) AS p95 FROM (SELECT 'max_vs_mean' AS variable, abs(m - a) AS v FROM e UNION ALL SELECT 'first_vs_mean', abs(f - a) FROM e UNION ALL SELECT 'first_vs_max', abs(f - m) FROM e) GROUP BY 1"),
}
