"""Sources, projections and scalar shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources import io, layout
from .base import r, t


def a01(s, d):
    return t(s, d, "lineitem").select("l_orderkey", "l_quantity", "l_discount").where("l_shipdate >= TIMESTAMP_NTZ'1995-01-01' AND l_discount > 0.05")


def a02(s, d):
    return io.read_table(s, f"{d}/events.parquet", ["event_id", "user_id", "event_type"], {"event_type": ["click", "purchase"]})


def a05(s, d):
    """A sampled load: the limit is the feature, and its rows are the same at every run."""
    return layout.sampled(io.read_table(s, f"{d}/events.parquet", ["event_id", "user_id"]), ["event_id"], rows=100)


def a05b(s, d):
    """All events of a tenth of the users."""
    return layout.sampled(t(s, d, "events"), ["user_id"], share=0.1).select("event_id", "user_id")


def a03(s, d):
    """Counts written as CSV and read again."""
    path = layout.scratch(s, "csv") + ".csv"
    io.write_aggregate_csv(t(s, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total")), path)
    return io.read_table(s, path).select("o_orderpriority", "o_orderstatus", F.col("n").cast("long").alias("n"), F.col("total").cast("double").alias("total"))


def a10(s, d):
    """Events written by entity with instants in UTC, and read again."""
    path = layout.scratch(s, "events")
    io.write_events(t(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "user_id", "ts", "value"), path, "user_id", "ts")
    return s.read.parquet(path).select("event_id", "user_id", F.unix_micros("ts").alias("us"), "value")


def a12(s, d):
    """An aggregate as JSON text and back."""
    text = io.to_json(t(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id")))
    return s.range(1).select(F.inline(F.from_json(F.lit(text), "array<struct<event_type string, n long, first_id long>>")))


def a08(s, d):
    """A result made once, taken from the cache, and made again."""
    path, orders = layout.scratch(s, "cache"), t(s, d, "orders")
    make = lambda: orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    for mode in ("cached", "cached", "fresh"):
        out = layout.result(s, path, make, [orders], "1", mode)
    return out


def a14b(s, d):
    """Customers of three regions in a folder each, beside folders that are no sites, found and stacked."""
    root = layout.scratch(s, "sites")
    nation = t(s, d, "nation").join(t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "r_name")
    customers = t(s, d, "customer").join(nation, "c_nationkey")
    for region, columns in (("ASIA", ["c_custkey", "c_acctbal"]), ("MIDDLE EAST", ["c_custkey", "c_mktsegment"]), ("EUROPE", ["c_custkey", "c_acctbal", "c_mktsegment"])):
        customers.where(F.col("r_name") == region).select(*columns).write.parquet(f"{root}/{region}/customer.parquet")
    for other in ("_pooled", "archive"):
        customers.limit(1).write.parquet(f"{root}/{other}/customer.parquet")
    return layout.stacked_sites(s, root, "customer.parquet", ["archive"]).select("site", "c_custkey", "c_acctbal", "c_mktsegment")


def a06(s, d):
    return io.read_entity(s, f"{d}/events.parquet", "user_id", 7).select("event_id", "user_id", "value")


def a07(s, d):
    cover = io.coverage(t(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), t(s, d, "customer"), "c_custkey")
    return cover.select("n_cohort", "n_covered", r("ratio").alias("ratio"))


def a09(s, d):
    return io.described(t(s, d, "lineitem"))


def a15(s, d):
    """A frame of the session queried by SQL under a name of its own."""
    levels = s.createDataFrame([("click", 1), ("view", 1), ("purchase", 3)], "event_type string, weight int")
    frames = {"shop_events": t(s, d, "events"), "levels": levels}
    return io.query(s, "SELECT user_id, sum(weight) AS score FROM {shop_events} JOIN {levels} USING (event_type) GROUP BY user_id", frames)


def a14(s, d):
    return io.site_labels(t(s, d, "region"), "r_name")


def b01(s, d):
    return C.replace(t(s, d, "customer"), {"c_acctbal": F.round(F.abs("c_acctbal"), 2)}).select("c_custkey", "c_acctbal")


def b02(s, d):
    return C.exclude(t(s, d, "customer"), ["c_name", "c_acctbal"])


def b03(s, d):
    df = t(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("amt_quantity"), F.sum("l_tax").alias("amt_tax"))
    return C.map_columns(df, "^amt_", lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4))


def b04(s, d):
    df = t(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    staged = df.withColumn("grossed", F.col("net") * 1.1)
    return staged.withColumn("band", F.when(F.col("grossed") > 100000, "high").otherwise("low")).select("l_orderkey", r("net").alias("net"), "band")


def b05(s, d):
    e = t(s, d, "events")
    return e.where(F.col("event_type").isin("click", "view") & F.col("value").between(10, 60) & ~F.col("event_type").eqNullSafe("signup") & F.col("props").isNotNull()).select("event_id", "event_type")


def b06(s, d):
    return t(s, d, "events").select("event_id", C.bucket(F.col("value"), [10, 50, 100], ["<10", "10-50", "50-100", ">=100"], "missing").alias("band"))


def b07(s, d):
    e = t(s, d, "events")
    rules = [(F.col("event_type") == "error", "failed"), ((F.col("event_type") == "purchase") & (F.col("value") > 50), "large purchase"), (F.col("event_type") == "purchase", "purchase")]
    return e.select("event_id", C.first_match(rules, "other").alias("outcome"))


def _day_night(s, d):
    h = F.hour("ts")
    e = t(s, d, "events").where("event_type IN ('click', 'view')")
    day = (h >= 7) & (h < 19)
    return e.groupBy("user_id", F.to_date("ts").alias("day")).agg(r(F.avg(F.when(day, F.col("value")))).alias("rate_day"), r(F.avg(F.when(~day, F.col("value")))).alias("rate_night"))


DAY_NIGHT = """
SELECT user_id, CAST(ts AS DATE) AS day,
       round(avg(CASE WHEN hour(ts) >= 7 AND hour(ts) < 19 THEN value END), 4) AS rate_day,
       round(avg(CASE WHEN NOT (hour(ts) >= 7 AND hour(ts) < 19) THEN value END), 4) AS rate_night
FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2"""


def b08(s, d):
    return _day_night(s, d).select("user_id", "day", C.six_groups(F.col("rate_day"), F.col("rate_night"), 20.0).alias("pattern"))


SIX = """CASE WHEN rate_day IS NULL AND rate_night IS NULL THEN NULL
  WHEN coalesce(rate_night,0)-coalesce(rate_day,0) < -20 THEN 'Markedly higher at day'
  WHEN coalesce(rate_night,0)-coalesce(rate_day,0) > 20 THEN 'Markedly higher at night'
  WHEN coalesce(rate_day,0)=0 AND coalesce(rate_night,0)=0 THEN 'Not receiving that day'
  WHEN coalesce(rate_night,0)-coalesce(rate_day,0) < 0 THEN 'Slightly higher at day'
  WHEN coalesce(rate_night,0)-coalesce(rate_day,0) > 0 THEN 'Slightly higher at night'
  ELSE 'Receiving and equal' END"""


def b09(s, d):
    df = _day_night(s, d)
    on = lambda c: (F.coalesce(F.col(c), F.lit(0.0)) > 0).cast("int")
    return df.select("user_id", "day", on("rate_day").alias("on_day"), on("rate_night").alias("on_night"), r(F.col("rate_night") - F.col("rate_day"), 3).alias("diff"))


def b10(s, d):
    n = t(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t(s, d, "customer").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n_orders"))


def b11(s, d):
    return C.clamp(t(s, d, "events").select("event_id", "value"), {"value": 75.0})


def b12(s, d):
    return t(s, d, "events").select("event_id", C.clip(F.col("value"), 20, 80).alias("value"))


def b13(s, d):
    return t(s, d, "events").select("event_id", C.cap_day(F.datediff("ts", F.lit("2023-12-31"))).alias("day_label"))


def b14(s, d):
    return C.rescale(t(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), {"p_size": 10, "p_retailprice": 100, "absent": 5}).select("p_partkey", r("p_size").alias("p_size"), r("p_retailprice").alias("p_retailprice"))


def b15(s, d):
    k = t(s, d, "orders").select(C.composite_key([F.col("o_custkey"), F.to_date("o_orderdate")]).alias("k")).distinct()
    return k.select("k", C.split_key(F.col("k"), 1).cast("long").alias("custkey"), C.split_key(F.col("k"), 2).alias("day"))


def b16(s, d):
    e = t(s, d, "events").select("event_id", F.when(F.col("value") > 50, "Yes").when(F.col("value") > 20, "1.0").when(F.col("value") > 10, "false").alias("flag"))
    return e.select("event_id", C.truthy(e, "flag").alias("flag"))


def b17(s, d):
    e = t(s, d, "events").withColumn("seen", F.when(F.col("event_type") != "view", F.col("ts")))
    return C.drop_missing_times(e, ["seen", "absent"]).select("event_id")


def b18(s, d):
    return t(s, d, "orders").select("o_orderkey", C.lookup(F.col("o_orderstatus"), {"O": "open", "F": "filled"}).alias("status"))


def b19(s, d):
    o = t(s, d, "orders")
    return o.select("o_orderkey", C.by_keyword(F.col("o_orderpriority"), [("urgent", "now"), ("high", "soon")], "later").alias("kind"), C.yes_no((F.col("o_totalprice") > 100000).cast("int")).alias("large"))


CASES = {
    "a01_scan": (a01, "SELECT l_orderkey, l_quantity, l_discount FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_discount > 0.05"),
    "a02_load": (a02, "SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('click','purchase')"),
    "a03_csv_round_trip": (a03, "SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2"),
    "a05_sample": (a05, "SELECT event_id, user_id FROM events ORDER BY md5(CAST(event_id AS VARCHAR)), event_id LIMIT 100"),
    "a05_share_of_entities": (a05b, f"SELECT event_id, user_id FROM events WHERE md5(CAST(user_id AS VARCHAR))[1:8] < '{int(0.1 * 2**32):08x}'"),
    "a08_cached_result": (a08, "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1"),
    "a10_written_events": (a10, "SELECT event_id, user_id, epoch_us(ts) AS us, value FROM events"),
    "a12_json_round_trip": (a12, "SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1"),
    "a14_discovered_sites": (a14b, """SELECT r_name AS site, c_custkey, CASE WHEN r_name <> 'MIDDLE EAST' THEN c_acctbal END AS c_acctbal, CASE WHEN r_name <> 'ASIA' THEN c_mktsegment END AS c_mktsegment
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name IN ('ASIA', 'EUROPE', 'MIDDLE EAST')"""),
    "a09_described": (a09, "SELECT column_name, CASE data_type WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' ELSE lower(data_type) END AS data_type FROM (SELECT column_name, column_type AS data_type FROM (DESCRIBE lineitem))"),
    "a15_frame_as_relation": (a15, "SELECT user_id, CAST(sum(CASE event_type WHEN 'purchase' THEN 3 ELSE 1 END) AS BIGINT) AS score FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1"),
    "a06_entity": (a06, "SELECT event_id, user_id, value FROM events WHERE user_id = 7"),
    "a07_coverage": (a07, "SELECT count(*) AS n_cohort, count(o.k) AS n_covered, round(count(o.k)/count(*), 4) AS ratio FROM (SELECT DISTINCT c_custkey FROM customer) c LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON o.k = c.c_custkey"),
    "a14_site_labels": (a14, "SELECT r_name, 'Site ' || chr(CAST(64 + row_number() OVER (ORDER BY r_name) AS INTEGER)) AS label FROM (SELECT DISTINCT r_name FROM region)"),
    "b01_replace": (b01, "SELECT c_custkey, round(abs(c_acctbal), 2) AS c_acctbal FROM customer"),
    "b02_exclude": (b02, "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer"),
    "b03_map_columns": (b03, "SELECT l_orderkey, round(sum(l_quantity), 4) AS amt_quantity, round(sum(l_tax), 4) AS amt_tax FROM lineitem GROUP BY 1"),
    "b04_staged_aliases": (b04, "SELECT l_orderkey, round(net, 4) AS net, CASE WHEN net * 1.1 > 100000 THEN 'high' ELSE 'low' END AS band FROM (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS net FROM lineitem GROUP BY 1)"),
    "b05_predicates": (b05, "SELECT event_id, event_type FROM events WHERE event_type IN ('click','view') AND value BETWEEN 10 AND 60 AND event_type IS DISTINCT FROM 'signup' AND props IS NOT NULL"),
    "b06_bucket": (b06, "SELECT event_id, CASE WHEN value IS NULL THEN 'missing' WHEN value < 10 THEN '<10' WHEN value < 50 THEN '10-50' WHEN value < 100 THEN '50-100' ELSE '>=100' END AS band FROM events"),
    "b07_first_match": (b07, "SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' AND value > 50 THEN 'large purchase' WHEN event_type = 'purchase' THEN 'purchase' ELSE 'other' END AS outcome FROM events"),
    "b08_six_groups": (b08, f"SELECT user_id, day, {SIX} AS pattern FROM ({DAY_NIGHT})"),
    "b09_flags": (b09, f"SELECT user_id, day, CAST(coalesce(rate_day,0) > 0 AS INTEGER) AS on_day, CAST(coalesce(rate_night,0) > 0 AS INTEGER) AS on_night, round(rate_night - rate_day, 3) AS diff FROM ({DAY_NIGHT})"),
    "b10_default_zero": (b10, "SELECT c_custkey, CAST(coalesce(n, 0) AS BIGINT) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey"),
    "b11_clamp": (b11, "SELECT event_id, CASE WHEN value IS NOT NULL THEN least(value, 75.0::DOUBLE) END AS value FROM events"),
    "b12_clip": (b12, "SELECT event_id, CASE WHEN value IS NOT NULL THEN least(greatest(value, 20.0::DOUBLE), 80.0::DOUBLE) END AS value FROM events"),
    "b13_cap_day": (b13, "SELECT event_id, CASE WHEN date_diff('day', DATE '2023-12-31', CAST(ts AS DATE)) > 7 THEN '8+' ELSE CAST(date_diff('day', DATE '2023-12-31', CAST(ts AS DATE)) AS VARCHAR) END AS day_label FROM events"),
    "b14_rescale": (b14, "SELECT p_partkey, round(CAST(p_size AS DOUBLE) / 10.0::DOUBLE, 4) AS p_size, round(p_retailprice / 100.0::DOUBLE, 4) AS p_retailprice FROM part"),
    "b15_composite_key": (b15, "SELECT DISTINCT CAST(o_custkey AS VARCHAR) || '__' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS k, o_custkey AS custkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders"),
    "b16_truthy": (b16, "SELECT event_id, CAST(CASE WHEN value > 20 THEN 1 ELSE 0 END AS INTEGER) AS flag FROM events"),
    "b17_drop_missing_times": (b17, "SELECT event_id FROM events WHERE event_type <> 'view'"),
    "b18_lookup": (b18, "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' END AS status FROM orders"),
    "b19_keywords": (b19, "SELECT o_orderkey, CASE WHEN lower(o_orderpriority) LIKE '%urgent%' THEN 'now' WHEN lower(o_orderpriority) LIKE '%high%' THEN 'soon' ELSE 'later' END AS kind, CASE WHEN o_totalprice > 100000 THEN 'Yes' ELSE 'No' END AS large FROM orders"),
}
