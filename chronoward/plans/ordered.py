"""Windows, islands, grids and sequences."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.localtime import add_day_shift, micros
from ..operators import relational as R, scans, sequence as S
from .base import HOUR_US, r, t

ORDER = ["ts", "event_id"]
BY = ["user_id"]


def in_order():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def ev(s, d):
    return t(s, d, "events")


def e01(s, d):
    return ev(s, d).select("event_id", F.lag("event_type").over(in_order()).alias("prev_type"), F.coalesce(F.lead("ts").over(in_order()), F.col("ts")).alias("next_ts"))


def e02(s, d):
    return S.islands(ev(s, d), BY, ORDER, {"island": F.col("event_type").isin("click", "view")}).select("event_id", "island")


def hot(s, d):
    """Events with every third user under one key, which then has a third of all rows."""
    return ev(s, d).withColumn("user_id", F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id")))


def e02h(s, d):
    return scans.islands(hot(s, d), BY, ORDER, {"island": F.col("event_type").isin("click", "view")}).select("event_id", "island")


def e14h(s, d):
    df = hot(s, d).withColumns({k: F.when(F.col("event_type") == v, F.col("value")) for k, v in (("c", "click"), ("v", "view"))})
    return scans.forward_fill(df, ["c", "v"], BY, ORDER).select("event_id", "c", "v")


def e22h(s, d):
    return scans.running_sum(hot(s, d), "value", BY, ORDER, "so_far").select("event_id", r("so_far", 2).alias("so_far"))


def e03(s, d):
    return S.streaks(ev(s, d), BY, "ts", F.col("event_type").isin("click", "view"), ["event_id"], 24.0).select("user_id", "streak_id", F.col("start").alias("start_ts"), F.col("end").alias("end_ts"), "n_rows", r("hours").alias("hours"))


def e04(s, d):
    return S.islands_by_rank(ev(s, d), BY, ORDER, "event_type").groupBy("user_id", "event_type", "island").agg(F.count("*").alias("n"), F.min("ts").alias("start_ts"))


def e05(s, d):
    o = t(s, d, "orders").withColumn("o_end", F.expr("o_orderdate + INTERVAL 2 DAY"))
    st = S.stitch(o, ["o_custkey"], "o_orderdate", "o_end", "o_orderkey", 30 * 24 * HOUR_US)
    return st.select("o_orderkey", "o_custkey", "block_id")


def e06(s, d):
    return S.first_flag(ev(s, d).withColumn("bad", (F.col("event_type") == "error").cast("int")), BY, ORDER, "bad", "first_bad").select("event_id", "first_bad")


def e07(s, d):
    states = {f"b{k}": F.col("value") <= k for k in (20, 50, 80)}
    return S.islands(ev(s, d), BY, ORDER, states).select("event_id", *states)


def _blocks(s, d):
    return S.islands(ev(s, d), BY, ORDER, {"block": F.col("value") <= 50})


def e08(s, d):
    w = Window.partitionBy("user_id", "block")
    return _blocks(s, d).select("event_id", F.min("ts").over(w).alias("block_start"), F.max("value").over(w).alias("block_top"))


def e09(s, d):
    b = _blocks(s, d)
    b = b.withColumn("m", ((micros(b, "ts") - F.min(micros(b, "ts")).over(Window.partitionBy("user_id", "block"))) / 60_000_000.0))
    return b.select("event_id", r("m").alias("elapsed"), r(F.lag("m").over(in_order())).alias("prev_elapsed"))


def e10(s, d):
    b = _blocks(s, d).groupBy("user_id", "block").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("last_ts"))
    b = b.withColumn("end_ts", F.coalesce(F.lead("start_ts").over(Window.partitionBy("user_id").orderBy("block")), F.col("last_ts")))
    return b.select("user_id", "block", "start_ts", "end_ts", r((micros(b, "end_ts") - micros(b, "start_ts")) / 60_000_000.0).alias("minutes"))


def e11(s, d):
    return S.pick_first(ev(s, d).where("event_type = 'purchase'"), BY, [F.desc("value"), "event_id"]).select("user_id", "event_id", "value")


def e12(s, d):
    e = ev(s, d).withColumn("h", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    rank = F.when(F.col("event_type") == "signup", 10).when(F.col("event_type") == "error", 9).when(F.col("event_type") == "view", 8).otherwise(1)
    return S.pick_first(e, ["user_id", "h"], [rank, F.when(F.col("value") > 0, 1).otherwise(2), F.desc("value"), "event_id"]).select("user_id", "h", "event_id")


def e13(s, d):
    return S.dup_clusters(t(s, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day")), ["o_custkey", "day"])


def _gaps(s, d):
    return ev(s, d).withColumns({"c": F.when(F.col("event_type") == "click", F.col("value")), "v": F.when(F.col("event_type") == "view", F.col("value"))})


def e14(s, d):
    return S.forward_fill(_gaps(s, d), ["c", "v"], BY, ORDER).select("event_id", "c", "v")


def e14b(s, d):
    return S.forward_fill(_gaps(s, d), ["c"], BY, ORDER, exclusive=True).select("event_id", "c")


def e15(s, d):
    g = S.islands(_gaps(s, d), BY, ORDER, {"block": F.col("value") <= 50})
    return S.fill_both(g, ["c"], ["user_id", "block"], ORDER).select("event_id", "c")


def e16(s, d):
    e = ev(s, d).withColumn("band", F.col("value") > 50)
    return S.change_levels(e, BY, ORDER, ["event_type", "band"]).select("event_id", F.col("event_type_id").alias("device_id"), F.col("band_id").alias("mode_id"))


def _bounds(s, d):
    return ev(s, d).groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))


def e17(s, d):
    return S.hour_grid(_bounds(s, d), "a", "b", "h", 1).select("user_id", "h")


def e18(s, d):
    grid = S.hour_grid(_bounds(s, d), "a", "b", "h", by=BY).select("user_id", F.expr("h + INTERVAL '59:59' MINUTE TO SECOND").alias("ts"), F.lit(1).alias("scaffold"))
    real = ev(s, d).select("user_id", "ts", "value")
    both = real.unionByName(grid, allowMissingColumns=True)
    both = R.dealt(both, BY, both.count(), 500_000)
    return both.select("user_id", "ts", F.coalesce("scaffold", F.lit(0)).alias("scaffold"), F.last("value", True).over(Window.partitionBy("user_id").orderBy("ts", F.coalesce("scaffold", F.lit(0))).rowsBetween(Window.unboundedPreceding, 0)).alias("value"))


def e19(s, d):
    g = S.hour_grid(_bounds(s, d), "a", "b", "event_dttm").select("user_id", "event_dttm")
    return add_day_shift(g, "user_id", "event_dttm", "America/Chicago").select("user_id", "event_dttm", "_hr", "_shift", "_nth_day", "_day_shift")


def e20(s, d):
    g = add_day_shift(S.hour_grid(_bounds(s, d), "a", "b", "event_dttm").select("user_id", "event_dttm"), "user_id", "event_dttm", "America/Chicago")
    w = Window.partitionBy("user_id")
    days = g.groupBy("user_id", F.col("_nth_day").alias("nth_day")).agg(F.count_if(F.col("_shift") == "day").alias("n_hrs_day"), F.count_if(F.col("_shift") == "night").alias("n_hrs_night"))
    first, last = F.col("nth_day") == F.min("nth_day").over(w), F.col("nth_day") == F.max("nth_day").over(w)
    return days.withColumn("day_type", F.when(first & last, "only").when(first, "first").when(last, "last").otherwise("middle"))


def e21(s, d):
    day = ev(s, d).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max((F.col("event_type") == "error").cast("int")).alias("bad"), F.max((F.col("event_type") == "purchase").cast("int")).alias("bought"))
    return S.lead_targets(day, BY, ["day"], ["bad", "bought"])


def e22(s, d):
    e = ev(s, d).withColumn("rate", F.when(F.col("event_type") == "click", F.col("value") / 60.0).when(F.col("event_type") == "error", F.lit(0.0)))
    x = S.integrate(e, BY, ORDER, "rate", "ts")
    return x.groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h")).agg(r(F.sum("amount"), 3).alias("amount"))


def e23(s, d):
    return S.jumps(ev(s, d), BY, "ts", "value", 90.0, 6 * HOUR_US, ["event_id"]).select("user_id", r("max_jump").alias("max_jump"))


def e24(s, d):
    return S.wide_range(ev(s, d), BY, "value", 99.0).select("user_id", r("spread").alias("spread"))


def e25(s, d):
    return S.count_distinct_within(ev(s, d), BY, "ts", "event_type", 72 * HOUR_US, "n_kinds").select("event_id", "n_kinds")


def e26(s, d):
    e = ev(s, d).withColumn("high", F.col("value") > 50)
    return S.segments(e, BY, "ts", "high").select("user_id", "segment", "high", F.col("start").alias("start_ts"), F.col("end").alias("end_ts"))


def e27(s, d):
    day = ev(s, d).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return S.lead_targets(day, BY, ["day"], ["n", "day"])


def e28(s, d):
    first = S.pick_first(ev(s, d).withColumn("prev", F.lag("value").over(in_order())), BY, ORDER)
    return first.select("user_id", "event_id", F.col("prev").isNull().alias("no_prev"))


ISL = "sum(chg) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"


def isl(state, extra="*"):
    return f"SELECT {extra}, CAST({ISL} AS BIGINT) AS block FROM (SELECT *, CASE WHEN row_number() OVER w = 1 OR lag({state}) OVER w IS DISTINCT FROM ({state}) THEN 1 ELSE 0 END AS chg FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


STREAKS = f"""
WITH x AS ({isl("event_type IN ('click','view')", "*, event_type IN ('click','view') AS st")}),
g AS (SELECT user_id, block, st, min(ts) AS start_ts, max(ts) AS last_ts, count(*) AS n_rows FROM x GROUP BY 1, 2, 3),
e AS (SELECT *, coalesce(lead(start_ts) OVER (PARTITION BY user_id ORDER BY block), last_ts) AS end_ts FROM g),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY block) AS streak_id FROM e WHERE st)
SELECT user_id, streak_id, start_ts, end_ts, n_rows, round(date_diff('minute', start_ts, end_ts) / 60.0::DOUBLE, 4) AS hours FROM f WHERE date_diff('minute', start_ts, end_ts) / 60.0 >= 24"""
GRID = "SELECT user_id, unnest(generate_series(date_trunc('hour', a), date_trunc('hour', b){x}, INTERVAL 1 HOUR)) AS h FROM (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1)"
SHIFT = "SELECT user_id, h AS event_dttm, CAST(hour(h - INTERVAL 6 HOUR) AS INTEGER) AS _hr, CASE WHEN hour(h - INTERVAL 6 HOUR) >= 7 AND hour(h - INTERVAL 6 HOUR) < 19 THEN 'day' ELSE 'night' END AS _shift, CAST(sum(CASE WHEN hour(h - INTERVAL 6 HOUR) = 7 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY h ROWS UNBOUNDED PRECEDING) AS BIGINT) AS _nth_day FROM (" + GRID.format(x="") + ")"
FF = "last_value({c} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS {f})"
CL, VI = "CASE WHEN event_type = 'click' THEN value END", "CASE WHEN event_type = 'view' THEN value END"
HOT_EVENTS = "FROM (SELECT * REPLACE (CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS user_id) FROM events)"
CASES = {
    "e01_lag_lead": (e01, "SELECT event_id, lag(event_type) OVER w AS prev_type, coalesce(lead(ts) OVER w, ts) AS next_ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"),
    "e02_islands": (e02, f"SELECT event_id, block AS island FROM ({isl(chr(39).join(['event_type IN (', 'click', ',', 'view', ')']))})"),
    "e02_islands_hot_key": (e02h, f"SELECT event_id, block AS island FROM ({isl(chr(39).join(['event_type IN (', 'click', ',', 'view', ')']))})".replace("FROM events", HOT_EVENTS)),
    "e03_streaks": (e03, STREAKS),
    "e04_rank_islands": (e04, "SELECT user_id, event_type, island, count(*) AS n, min(ts) AS start_ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM events) GROUP BY 1, 2, 3"),
    "e05_stitch": (e05, "WITH a AS (SELECT *, CASE WHEN max(o_orderdate + INTERVAL 2 DAY) OVER w IS NULL OR o_orderdate - max(o_orderdate + INTERVAL 2 DAY) OVER w >= INTERVAL 30 DAY THEN 1 ELSE 0 END AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), b AS (SELECT *, sum(n) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS k FROM a) SELECT o_orderkey, o_custkey, first_value(o_orderkey) OVER (PARTITION BY o_custkey, k ORDER BY o_orderdate, o_orderkey) AS block_id FROM b"),
    "e06_first_flag": (e06, "SELECT event_id, CAST(CASE WHEN event_type = 'error' AND sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) = 1 THEN 1 ELSE 0 END AS INTEGER) AS first_bad FROM events"),
    "e07_parallel_islands": (e07, f"SELECT a.event_id, a.block AS b20, b.block AS b50, c.block AS b80 FROM ({isl('value <= 20')}) a JOIN ({isl('value <= 50')}) b USING (event_id) JOIN ({isl('value <= 80')}) c USING (event_id)"),
    "e08_over_island": (e08, f"SELECT event_id, min(ts) OVER (PARTITION BY user_id, block) AS block_start, max(value) OVER (PARTITION BY user_id, block) AS block_top FROM ({isl('value <= 50')})"),
    "e09_elapsed": (e09, f"SELECT event_id, round(m, 4) AS elapsed, round(lag(m) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS prev_elapsed FROM (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id, block)) / 60000000.0::DOUBLE AS m FROM ({isl('value <= 50')}))"),
    "e10_block_durations": (e10, f"WITH b AS (SELECT user_id, block, min(ts) AS start_ts, max(ts) AS last_ts FROM ({isl('value <= 50')}) GROUP BY 1, 2), c AS (SELECT *, coalesce(lead(start_ts) OVER (PARTITION BY user_id ORDER BY block), last_ts) AS end_ts FROM b) SELECT user_id, block, start_ts, end_ts, round((epoch_us(end_ts) - epoch_us(start_ts)) / 60000000.0::DOUBLE, 4) AS minutes FROM c"),
    "e11_pick_first": (e11, "SELECT user_id, event_id, value FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) = 1"),
    "e12_priority_dedup": (e12, "SELECT user_id, date_trunc('hour', ts) AS h, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY CASE event_type WHEN 'signup' THEN 10 WHEN 'error' THEN 9 WHEN 'view' THEN 8 ELSE 1 END, CASE WHEN value > 0 THEN 1 ELSE 2 END, value DESC NULLS LAST, event_id) = 1"),
    "e13_dup_clusters": (e13, "SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day, count(*) OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE)) AS n_in_cluster FROM orders QUALIFY n_in_cluster > 1"),
    "e14_forward_fill": (e14, f"SELECT event_id, {FF.format(c=CL, f='UNBOUNDED PRECEDING')} AS c, {FF.format(c=VI, f='UNBOUNDED PRECEDING')} AS v FROM events"),
    "e14_fill_hot_key": (e14h, f"SELECT event_id, {FF.format(c=CL, f='UNBOUNDED PRECEDING')} AS c, {FF.format(c=VI, f='UNBOUNDED PRECEDING')} AS v FROM events".replace("FROM events", HOT_EVENTS)),
    "e14_forward_fill_before": (e14b, f"SELECT event_id, {FF.format(c=CL, f='BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING')} AS c FROM events"),
    "e15_fill_both": (e15, f"SELECT event_id, coalesce(last_value({CL} IGNORE NULLS) OVER (PARTITION BY user_id, block ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), first_value({CL} IGNORE NULLS) OVER (PARTITION BY user_id, block ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS c FROM ({isl('value <= 50')})"),
    "e16_change_levels": (e16, f"SELECT a.event_id, a.block AS device_id, b.block AS mode_id FROM ({isl('event_type')}) a JOIN ({isl(chr(123) + chr(39) + 'a' + chr(39) + ': event_type, ' + chr(39) + 'b' + chr(39) + ': value > 50' + chr(125))}) b USING (event_id)"),
    "e17_hour_grid": (e17, GRID.format(x=" + INTERVAL 1 HOUR")),
    "e18_scaffold_rows": (e18, "WITH u AS (SELECT user_id, ts, value, 0 AS scaffold FROM events UNION ALL SELECT user_id, h + INTERVAL 3599 SECOND, NULL, 1 FROM (" + GRID.format(x="") + ")) SELECT user_id, ts, CAST(scaffold AS INTEGER) AS scaffold, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, scaffold ROWS UNBOUNDED PRECEDING) AS value FROM u"),
    "e19_day_shift": (e19, f"SELECT *, 'day' || _nth_day || '_' || _shift AS _day_shift FROM ({SHIFT})"),
    "e20_day_registry": (e20, f"WITH x AS (SELECT user_id, _nth_day AS nth_day, count(*) FILTER (WHERE _shift = 'day') AS n_hrs_day, count(*) FILTER (WHERE _shift = 'night') AS n_hrs_night FROM ({SHIFT}) GROUP BY 1, 2) SELECT *, CASE WHEN nth_day = min(nth_day) OVER w AND nth_day = max(nth_day) OVER w THEN 'only' WHEN nth_day = min(nth_day) OVER w THEN 'first' WHEN nth_day = max(nth_day) OVER w THEN 'last' ELSE 'middle' END AS day_type FROM x WINDOW w AS (PARTITION BY user_id)"),
    "e21_lead_targets": (e21, "WITH x AS (SELECT user_id, CAST(ts AS DATE) AS day, max(CAST(event_type = 'error' AS INTEGER)) AS bad, max(CAST(event_type = 'purchase' AS INTEGER)) AS bought FROM events GROUP BY 1, 2) SELECT *, lead(bad) OVER w AS bad_next, lead(bought) OVER w AS bought_next FROM x WINDOW w AS (PARTITION BY user_id ORDER BY day)"),
    "e22_running_sum_hot_key": (e22h, "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS so_far " + HOT_EVENTS),
    "e22_integrate": (e22, "WITH a AS (SELECT *, last_value(CASE WHEN event_type = 'click' THEN value / 60.0::DOUBLE WHEN event_type = 'error' THEN 0.0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS rate, (lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) - epoch_us(ts)) / 60000000.0::DOUBLE AS m FROM events) SELECT user_id, date_trunc('hour', ts) AS h, round(sum(coalesce(rate, 0) * coalesce(m, 0)), 3) AS amount FROM a GROUP BY 1, 2"),
    "e23_jumps": (e23, "SELECT user_id, round(max(dv), 4) AS max_jump FROM (SELECT user_id, abs(value - lag(value) OVER w) AS dv, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS dt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE dt < 6 * 3600000000 GROUP BY 1 HAVING max(dv) > 90"),
    "e24_wide_range": (e24, "SELECT user_id, round(max(value) - min(value), 4) AS spread FROM events GROUP BY 1 HAVING max(value) - min(value) > 99"),
    "e25_distinct_within": (e25, "SELECT e.event_id, count(DISTINCT p.event_type) AS n_kinds FROM events e JOIN events p ON p.user_id = e.user_id AND p.ts BETWEEN e.ts - INTERVAL 72 HOUR AND e.ts GROUP BY 1"),
    "e26_segments": (e26, f"WITH g AS (SELECT user_id, block AS segment, value > 50 AS high, min(ts) AS start_ts, max(ts) AS l FROM ({isl('value > 50')}) GROUP BY 1, 2, 3) SELECT user_id, segment, high, start_ts, coalesce(lead(start_ts) OVER (PARTITION BY user_id ORDER BY segment), l) AS end_ts FROM g"),
    "e27_shift_minus_one": (e27, "WITH x AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2) SELECT *, lead(n) OVER w AS n_next, lead(day) OVER w AS day_next FROM x WINDOW w AS (PARTITION BY user_id ORDER BY day)"),
    "e28_head_one": (e28, "SELECT user_id, event_id, TRUE AS no_prev FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1"),
}
