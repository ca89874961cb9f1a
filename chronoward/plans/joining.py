"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.localtime import micros
from ..operators import asof as A
from ..operators import relational as R
from ..operators import scans
from ..operators import sequence as S
from .base import HOUR_US, r, t


def _events(s, d, *kinds):
    return t(s, d, "events").where(F.col("event_type").isin(*kinds))


def c01(s, d):
    ids = t(s, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return R.cohort(t(s, d, "orders"), ids, ["o_custkey"]).select("o_orderkey", "o_custkey")


def c02(s, d):
    o = t(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    m = t(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("top_price"))
    n = t(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return R.left_chain(t(s, d, "customer").select("c_custkey", "c_nationkey"), [(o, ["c_custkey"]), (m, ["c_custkey"]), (n, ["c_nationkey"])])


def c03(s, d):
    day = t(s, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    stay = t(s, d, "events").groupBy("user_id").agg(F.min("ts").alias("first_ts"))
    errors = _events(s, d, "error").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n_error"))
    return R.left_chain(day, [(errors, ["user_id", "day"]), (stay, ["user_id"])])


def c04(s, d):
    a = _events(s, d, "click", "view").select("user_id", F.to_date("ts").alias("day")).distinct().withColumn("grid", F.lit(1))
    b = _events(s, d, "purchase").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return a.join(b, ["user_id", "day"], "full")


def c05(s, d):
    o = t(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return t(s, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


def c06(s, d):
    keys = _events(s, d, "error").select("user_id", F.date_trunc("hour", "ts").alias("h"))
    return t(s, d, "events").withColumn("h", F.date_trunc("hour", "ts")).join(keys, ["user_id", "h"], "left_semi").select("event_id", "user_id")


def c07(s, d):
    e = t(s, d, "events").select("user_id").distinct()
    return R.scaffold(e, t(s, d, "events").select("event_type"))


BACK = "SELECT l.event_id, l.user_id, r.event_id AS click_id, r.value AS click_value FROM (SELECT * FROM events WHERE event_type = 'purchase') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') r ON l.user_id = r.user_id AND l.ts >= r.ts"


def _back(s, d, **kw):
    right = _events(s, d, "click").select("user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"), F.col("value").alias("click_value"))
    return A.asof_join(_events(s, d, "purchase").select("event_id", "user_id", "ts"), right, ["user_id"], "ts", "click_ts", ["click_id", "click_value", "click_ts"], tiebreak=["click_id"], **kw)


def c08(s, d):
    return _back(s, d).select("event_id", "user_id", "click_id", "click_value")


def c08h(s, d):
    """The same with every third user under one key."""
    one = lambda df: df.withColumn("user_id", F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id")))
    right = one(_events(s, d, "click")).select("user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"), F.col("value").alias("click_value"))
    left = one(_events(s, d, "purchase")).select("event_id", "user_id", "ts")
    return scans.asof_backward(left, right, ["user_id"], "ts", "click_ts", ["click_id", "click_value"], ["click_id"]).select("event_id", "user_id", "click_id", "click_value")


def c16b(s, d):
    """Errors with all visits (an hour from each view) of their key that they fall into; one key has a third of the rows."""
    one = F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id")).alias("user_id")
    visits = _events(s, d, "view").select(one, F.col("event_id").alias("visit"), F.col("ts").alias("w0"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("w1"))
    return R.range_join(_events(s, d, "error").select(one, "event_id", "ts"), visits, ["user_id"], "ts", "w0", "w1").select("event_id", "visit")


def c09(s, d):
    df = _back(s, d)
    fresh = (micros(df, "ts") - micros(df, "click_ts")) <= 12 * HOUR_US
    return df.select("event_id", F.when(F.coalesce(fresh, F.lit(False)), F.when(F.col("click_value") < 20, "low").otherwise("high")).otherwise("missing").alias("state"))


def c10(s, d):
    limit = F.expr("timestampdiff(MICROSECOND, _right_time, _left_time) <= 240 * 60 * 1000000L")
    return _back(s, d, tolerance=limit).select("event_id", "click_id")


def c11(s, d):
    right = _events(s, d, "error").select("user_id", F.col("ts").alias("t"), F.col("event_id").alias("error_id"))
    return A.asof_join(_events(s, d, "purchase").select("event_id", "user_id", "ts"), right, ["user_id"], "ts", "t", ["error_id"], direction="forward", tiebreak=["error_id"])[["event_id", "error_id"]]


def c12(s, d):
    spine = _events(s, d, "purchase").select("event_id", "user_id", "ts")
    return A.asof_by_category(spine, t(s, d, "events"), ["user_id"], "ts", "ts", "event_type", "value", ["click", "view", "error"], ["event_id"]).drop("ts")


def c13(s, d):
    right = _events(s, d, "click").select("user_id", F.col("ts").alias("click_ts"), F.col("value").alias("click_value"), F.col("event_id").alias("click_id"))
    return A.asof_or_first(_events(s, d, "purchase").select("event_id", "user_id", "ts"), right, ["user_id"], "ts", "click_ts", "click_value", ["click_id"]).drop("ts")


def c14(s, d):
    anchors = _events(s, d, "purchase").groupBy("user_id").agg(F.min("ts").alias("anchor"))
    return A.starter_rows(anchors, _events(s, d, "view").select("user_id", "ts", "value", "event_id"), ["user_id"], "anchor", "ts", ["value"], ["event_id"]).select("user_id", "ts", "value")


def c15(s, d):
    win = _events(s, d, "signup").groupBy("user_id").agg(F.min("ts").alias("w0")).withColumn("w1", F.expr("w0 + INTERVAL 72 HOUR"))
    inside = R.range_join(_events(s, d, "purchase"), win, ["user_id"], "ts", "w0", "w1").select("event_id", "user_id", "ts")
    right = _events(s, d, "click").select("user_id", F.col("ts").alias("t"), F.col("event_id").alias("click_id"), F.col("value").alias("click_value"))
    return A.asof_join(inside, right, ["user_id"], "ts", "t", ["click_value"], tiebreak=["click_id"]).select("event_id", "click_value")


def c16(s, d):
    win = _events(s, d, "signup").groupBy("user_id").agg(F.min("ts").alias("w0"), F.max("ts").alias("w1"))
    return R.range_join(t(s, d, "events"), win, ["user_id"], "ts", "w0", "w1").select("event_id", "user_id")


def c17(s, d):
    win = _events(s, d, "signup").groupBy("user_id").agg(F.min("ts").alias("w0"), F.max("ts").alias("w1"))
    wide = R.range_join(t(s, d, "events"), win, ["user_id"], "ts", "w0", "w1", before=F.expr("INTERVAL 24 HOUR"))
    wide = R.dealt(wide, ["user_id"], t(s, d, "events").count(), 500_000)
    filled = S.forward_fill(wide.withColumn("c", F.when(F.col("event_type") == "click", F.col("value"))), ["c"], ["user_id"], ["ts", "event_id"])
    return filled.where("ts >= w0").select("event_id", "c")


def c18(s, d):
    cut = _events(s, d, "purchase").groupBy("user_id").agg(F.max("ts").alias("cut"))
    both = _events(s, d, "view").join(cut, "user_id").where("ts <= cut")
    return S.pick_first(both, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")


def c19(s, d):
    return S.event_within(t(s, d, "events"), ["user_id"], "ts", F.col("event_type") == "error", 48 * HOUR_US, "error_48h").select("event_id", "error_48h")


def c20(s, d):
    wide = _events(s, d, "click", "view").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    bolus = R.pivot(_events(s, d, "purchase", "error").withColumn("day", F.to_date("ts")), ["user_id", "day"], "event_type", ["purchase", "error"], F.count(F.lit(1)))
    return wide.join(bolus, ["user_id", "day"], "full").withColumn("from_both", (F.col("n").isNotNull() & (F.col("purchase").isNotNull() | F.col("error").isNotNull())).cast("int"))


def c21(s, d):
    per = [_events(s, d, k).groupBy("user_id").agg(F.count("*").alias(f"n_{k}")) for k in ("click", "view", "error")]
    return R.merge_all(per, ["user_id"])


EV = "SELECT * FROM events WHERE event_type"
CASES = {
    "c01_cohort": (c01, "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"),
    "c02_left_chain": (c02, "SELECT c_custkey, c_nationkey, n_orders, top_price, n_name FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, max(o_totalprice) AS top_price FROM orders GROUP BY 1) ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey"),
    "c03_mixed_keys": (c03, "WITH day AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS e FROM events GROUP BY 1, 2) SELECT user_id, day, n, nullif(e, 0) AS n_error, first_ts FROM day LEFT JOIN (SELECT user_id, min(ts) AS first_ts FROM events GROUP BY 1) USING (user_id)"),
    "c04_full_outer": (c04, "SELECT user_id, day, grid, n FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, 1 AS grid FROM events WHERE event_type IN ('click','view')) FULL JOIN (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) USING (user_id, day)"),
    "c05_anti": (c05, "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "c06_semi_hour": (c06, "SELECT event_id, user_id FROM events JOIN (SELECT DISTINCT user_id, date_trunc('hour', ts) AS h FROM events WHERE event_type = 'error') k USING (user_id) WHERE date_trunc('hour', ts) = h"),
    "c07_scaffold": (c07, "SELECT user_id, event_type FROM (SELECT DISTINCT user_id FROM events), (SELECT DISTINCT event_type FROM events)"),
    "c08_asof_backward": (c08, BACK),
    "c09_asof_stale": (c09, "SELECT l.event_id, CASE WHEN l.ts - r.ts <= INTERVAL 12 HOUR THEN CASE WHEN r.value < 20 THEN 'low' ELSE 'high' END ELSE 'missing' END AS state FROM (" + EV + " = 'purchase') l ASOF LEFT JOIN (" + EV + " = 'click') r ON l.user_id = r.user_id AND l.ts >= r.ts"),
    "c10_asof_tolerance": (c10, "SELECT l.event_id, CASE WHEN l.ts - r.ts <= INTERVAL 240 MINUTE THEN r.event_id END AS click_id FROM (" + EV + " = 'purchase') l ASOF LEFT JOIN (" + EV + " = 'click') r ON l.user_id = r.user_id AND l.ts >= r.ts"),
    "c11_asof_forward": (c11, "SELECT l.event_id, r.event_id AS error_id FROM (" + EV + " = 'purchase') l ASOF LEFT JOIN (" + EV + " = 'error') r ON l.user_id = r.user_id AND l.ts <= r.ts"),
    "c12_asof_stacked": (c12, "SELECT l.event_id, l.user_id, a.value AS click, b.value AS view, c.value AS error FROM (" + EV + " = 'purchase') l ASOF LEFT JOIN (" + EV + " = 'click') a ON l.user_id = a.user_id AND l.ts >= a.ts ASOF LEFT JOIN (" + EV + " = 'view') b ON l.user_id = b.user_id AND l.ts >= b.ts ASOF LEFT JOIN (" + EV + " = 'error') c ON l.user_id = c.user_id AND l.ts >= c.ts"),
    "c13_asof_fallback": (c13, "SELECT l.event_id, l.user_id, coalesce(r.value, f.v) AS click_value, CASE WHEN r.value IS NOT NULL THEN 'asof' WHEN f.v IS NOT NULL THEN 'fallback' ELSE 'none' END AS _source FROM (" + EV + " = 'purchase') l ASOF LEFT JOIN (" + EV + " = 'click' AND value IS NOT NULL) r ON l.user_id = r.user_id AND l.ts >= r.ts LEFT JOIN (SELECT user_id, arg_min(value, ts) AS v FROM events WHERE event_type = 'click' AND value IS NOT NULL GROUP BY 1) f ON f.user_id = l.user_id"),
    "c14_starter": (c14, "SELECT a.user_id, a.anchor AS ts, r.value FROM (SELECT user_id, min(ts) AS anchor FROM events WHERE event_type = 'purchase' GROUP BY 1) a ASOF JOIN (" + EV + " = 'view') r ON a.user_id = r.user_id AND a.anchor > r.ts WHERE r.value IS NOT NULL"),
    "c15_asof_window": (c15, "WITH w AS (SELECT user_id, min(ts) AS w0 FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT l.event_id, r.value AS click_value FROM (SELECT e.* FROM events e JOIN w USING (user_id) WHERE event_type = 'purchase' AND ts BETWEEN w0 AND w0 + INTERVAL 72 HOUR) l ASOF LEFT JOIN (" + EV + " = 'click') r ON l.user_id = r.user_id AND l.ts >= r.ts"),
    "c08_asof_hot_key": (c08h, BACK.replace("FROM events", "FROM (SELECT * REPLACE (CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS user_id) FROM events)")),
    "c16_many_windows": (c16b, """WITH e AS (SELECT *, CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS k FROM events)
SELECT a.event_id, b.event_id AS visit FROM e a JOIN e b ON a.k = b.k AND a.ts >= b.ts AND a.ts <= b.ts + INTERVAL 1 HOUR WHERE a.event_type = 'error' AND b.event_type = 'view'"""),
    "c16_range": (c16, "SELECT event_id, user_id FROM events JOIN (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events WHERE event_type = 'signup' GROUP BY 1) USING (user_id) WHERE ts BETWEEN a AND b"),
    "c17_look_back": (c17, "WITH w AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events WHERE event_type = 'signup' GROUP BY 1), x AS (SELECT e.event_id, e.ts, a, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS c FROM events e JOIN w USING (user_id) WHERE ts BETWEEN a - INTERVAL 24 HOUR AND b) SELECT event_id, c FROM x WHERE ts >= a"),
    "c18_most_recent": (c18, "SELECT user_id, event_id FROM (SELECT e.user_id, e.event_id, row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts DESC, e.event_id DESC) AS rn FROM events e JOIN (SELECT user_id, max(ts) AS cut FROM events WHERE event_type = 'purchase' GROUP BY 1) c USING (user_id) WHERE event_type = 'view' AND ts <= cut) WHERE rn = 1"),
    "c19_exists_within": (c19, "SELECT event_id, CAST(EXISTS (SELECT 1 FROM events n WHERE n.user_id = e.user_id AND n.event_type = 'error' AND n.ts > e.ts AND n.ts <= e.ts + INTERVAL 48 HOUR) AS INTEGER) AS error_48h FROM events e"),
    "c20_outer_audit": (c20, "WITH a AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type IN ('click','view') GROUP BY 1, 2), b AS (SELECT user_id, CAST(ts AS DATE) AS day, nullif(count(*) FILTER (WHERE event_type = 'purchase'), 0) AS purchase, nullif(count(*) FILTER (WHERE event_type = 'error'), 0) AS error FROM events WHERE event_type IN ('purchase','error') GROUP BY 1, 2) SELECT user_id, day, n, purchase, error, CAST(n IS NOT NULL AND (purchase IS NOT NULL OR error IS NOT NULL) AS INTEGER) AS from_both FROM a FULL JOIN b USING (user_id, day)"),
    "c21_merge_all": (c21, "SELECT user_id, n_click, n_view, n_error FROM (SELECT user_id, count(*) AS n_click FROM events WHERE event_type = 'click' GROUP BY 1) FULL JOIN (SELECT user_id, count(*) AS n_view FROM events WHERE event_type = 'view' GROUP BY 1) USING (user_id) FULL JOIN (SELECT user_id, count(*) AS n_error FROM events WHERE event_type = 'error' GROUP BY 1) USING (user_id)"),
}
