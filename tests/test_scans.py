"""Scans of hot entities in slices, quantiles by rank and interval joins by bins, against plain answers."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoward.operators import asof, relational, scans, sequence, summary

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    """One entity with most rows, a null entity, ties in time, gaps in values."""
    rng = random.Random(3)
    out = []
    for i in range(3000):
        who = 7 if i % 3 else rng.choice([None, *range(20, 60)])
        out.append((who, "x", START + timedelta(minutes=rng.randrange(4000)), i, rng.choice([None, None, *range(5)]), rng.choice(["a", "b", None])))
    return spark.createDataFrame(out, "who int, kind string, ts timestamp_ntz, id int, v int, state string").repartition(4)


BY, ORDER = ["who", "kind"], ["ts", "id"]


def as_set(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_hot_entities_are_cut(rows):
    cut = scans.sliced(rows, BY, "ts")
    per = {(r["who"], r["_slice"]): r["count"] for r in cut.groupBy("who", "_slice").count().collect()}
    assert len([k for k in per if k[0] == 7]) >= 50 and max(n for (w, _), n in per.items() if w == 7) < 200
    assert {k[1] for k in per if k[0] not in (7, None)} == {0}
    assert cut.where("_hot").select("who").distinct().count() <= 2
    # a slice holds a stretch of time
    spans = sorted((r["_slice"], r["a"], r["b"]) for r in cut.where("who = 7").groupBy("_slice").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).collect())
    assert all(x[2] < y[1] for x, y in zip(spans, spans[1:]))


def test_scans_give_what_windows_give(rows):
    plain = sequence.forward_fill(rows, ["v", "state"], BY, ORDER)
    assert as_set(scans.forward_fill(rows, ["v", "state"], BY, ORDER)) == as_set(plain.select(*rows.columns))
    w = sequence.running(BY, ORDER)
    assert as_set(scans.running_sum(rows, "v", BY, ORDER, "s").select("id", "s")) == as_set(rows.select("id", F.sum("v").over(w)))
    states = {"i": F.col("state"), "j": F.col("v") > 2}
    assert as_set(scans.islands(rows, BY, ORDER, states).select("id", "i", "j")) == as_set(sequence.islands(rows, BY, ORDER, states).select("id", "i", "j"))


def test_asof_of_hot_keys(rows):
    left, right = rows.where("id % 2 = 0").withColumn("ts", F.when(F.col("id") % 50 > 0, F.col("ts"))), rows.where("id % 2 = 1").select("who", "kind", F.col("ts").alias("t2"), F.col("id").alias("other"), F.col("v").alias("w"))
    plain = asof.asof_join(left, right, BY, "ts", "t2", ["other", "w"], tiebreak=["other"])
    assert as_set(scans.asof_backward(left, right, BY, "ts", "t2", ["other", "w"], ["other"])) == as_set(plain)


def test_no_task_scans_a_hot_entity_alone(rows):
    """The window's rows are dealt by entity and slice, and only sums of slices are sent to all tasks."""
    plan = scans.forward_fill(rows, ["v"], BY, ORDER)._jdf.queryExecution().executedPlan().toString()
    assert "who#" in plan and "_slice" in plan.split("Window")[1] and "SortMergeJoin" not in plan


def test_empty_and_even_tables(spark, rows):
    assert scans.forward_fill(rows.limit(0), ["v"], BY, ORDER).count() == 0
    even = rows.where("who BETWEEN 20 AND 59")
    assert scans.sliced(even, BY, "ts", 8).where("_hot").count() == 0
    same = spark.createDataFrame([(1, i, i) for i in range(50)], "who int, v int, id int").withColumn("ts", F.lit(5.0))
    assert sorted(r["s"] for r in scans.running_sum(same, "v", ["who"], ["ts", "id"], "s").collect()) == list(np.cumsum(range(50)))


def test_quantiles(rows):
    df = rows.withColumn("x", F.when(F.col("v").isNotNull(), F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.col("id") * 0.37 % 11)))
    shares = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.975, "e": 1.0}
    local = df.select("who", "x").toPandas()
    got = {r["who"]: r for r in scans.quantiles(df, "x", shares, ["who"]).collect()}
    assert len(got) == local.dropna(subset=["x"])["who"].nunique(dropna=False)
    for who, r in got.items():
        x = local["x"][local["who"].isna() if who is None else local["who"] == who].dropna()
        assert np.allclose([r[k] for k in shares], np.quantile(x, list(shares.values())))
    (whole,) = scans.quantiles(df, "x", shares).collect()
    assert np.allclose([whole[k] for k in shares], np.quantile(local["x"].dropna(), list(shares.values())))
    assert scans.quantiles(df.where("x < -1"), "x", shares).count() == 0
    wide = summary.continuous_summary(df.withColumn("none", F.lit(None).cast("double")), ["x", "none"], ["kind"])
    ranked = summary.continuous_summary(df.withColumn("none", F.lit(None).cast("double")), ["x", "none"], ["kind"], by_rank=True)
    assert ranked.columns == wide.columns
    for a, b in zip(sorted(wide.collect(), key=lambda r: r["variable"]), sorted(ranked.collect(), key=lambda r: r["variable"])):
        assert all(x == y or abs(x - y) < 1e-9 for x, y in zip(a, b))
    assert "percentile" not in ranked._jdf.queryExecution().executedPlan().toString()


def test_interval_join_by_bins(spark):
    rng = random.Random(6)
    at = lambda m: START + timedelta(minutes=m)
    windows = [(rng.choice([1, 2, None]), i, at(a), at(a + length)) for i in range(400) for a, length in [(rng.randrange(2000), rng.choice([0, 1, 7, 60, 900, -5]))]]
    windows += [(1, 1000, at(10**6), at(10**6 + 5)), (1, 1001, None, at(5)), (1, 1002, at(5), None), (3, 1003, at(0), at(9))]
    events = [(rng.choice([1, 2, 9, None]), i, at(rng.randrange(2500))) for i in range(800)] + [(1, 900, None)]
    e, w = spark.createDataFrame(events, "k int, event int, t timestamp_ntz"), spark.createDataFrame(windows, "k int, window int, a timestamp_ntz, b timestamp_ntz")
    for hours in (0, 2):
        before = F.expr(f"INTERVAL {hours} HOUR") if hours else None
        want = sorted((i, j) for k, i, t in events for q, j, a, b in windows if k is not None and k == q and t and a and b and a - timedelta(hours=hours) <= t <= b)
        got = sorted((r["event"], r["window"]) for r in relational.range_join(e, w, ["k"], "t", "a", "b", before=before).collect())
        assert got == want
    left = relational.range_join(e, w, ["k"], "t", "a", "b", how="left")
    assert {r["window"] for r in left.where("event IS NULL").collect()} >= {1000, 1001, 1002, 1003} and left.where("event IS NOT NULL").count() == relational.range_join(e, w, ["k"], "t", "a", "b").count()
    assert relational.range_join(e, w.limit(0), ["k"], "t", "a", "b").count() == 0


def test_many_windows_of_one_key(spark):
    """10,000 windows and 10,000 events of one key: what meets in a bin stays in proportion to the rows, not to their product."""
    w = spark.range(10_000).select(F.lit(1).alias("k"), F.col("id").alias("window"), (F.col("id") * 10.0).alias("a"), (F.col("id") * 10.0 + F.col("id") % 9).alias("b"))
    e = spark.range(10_000).select(F.lit(1).alias("k"), F.col("id").alias("event"), (F.col("id") * 10.0 + 3).alias("t"))
    met = relational.range_join(e, w.withColumn("b", F.col("b")), ["k"], "t", "a", "b")
    assert met.count() == sum(i % 9 >= 3 for i in range(10_000))
    made = met._jdf.queryExecution().executedPlan()
    seen, todo = [], [made]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if "Join" in node.nodeName():
            seen.append(node.toString().split("\n")[0])
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert any("_bin" in s and "_power" in s for s in seen)  # the bins are join keys


def test_events_go_to_the_powers_of_their_own_key(spark):
    """Each key has windows of one length, each another one; some keys have no window."""
    e = spark.createDataFrame([(k, float(i)) for k in range(20) for i in range(20)], "k long, t double")
    w = spark.createDataFrame([(k, k, 0.0, 2.0**k) for k in range(15)], "window long, k long, a double, b double")
    spans = w.withColumn("_power", F.col("k").cast("int"))
    assert relational.binned(e, spans, ["k"], "t").count() == 15 * 20
    assert relational.range_join(e, w, ["k"], "t", "a", "b").count() == sum(min(2**k + 1, 20) for k in range(15))


def test_tasks_hold_a_bounded_number_of_rows(spark):
    df = spark.range(100_000).select((F.col("id") % 5_000).alias("k"), "id")
    sizes = [n for n in relational.dealt(df, ["k"], 100_000, 10_000).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()]
    assert len(sizes) == 10 and max(sizes) < 20_000
    assert relational.parts_for(spark, 500, 10_000) == 1 and relational.parts_for(spark, 10_000_000, 10_000) == 1_000


def test_scaffold_rows_are_dealt_by_number(spark, tmp_path):
    """More scaffold rows than one task takes: hours of thirty years for four users."""
    from chronoward.plans import ordered

    spark.sql("SELECT user_id, make_timestamp_ntz(1990 + 30 * k, 1, 1, 0, 0, 0) AS ts, 1.0D AS value FROM (SELECT explode(sequence(1, 4)) AS user_id), (SELECT explode(array(0, 1)) AS k)").write.parquet(str(tmp_path / "events.parquet"))
    df = ordered.e18(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() >= 3 and df.count() == 4 * (24 * 10_957 + 1 + 2)


def test_hours_are_made_by_more_tasks_than_bounds_fill(spark):
    """Ten entities of thirty years each: 2.6 million hours."""
    from chronoward.operators.sequence import hour_grid

    bounds = spark.sql("SELECT explode(sequence(1, 10)) AS k, TIMESTAMP_NTZ'1990-01-01 00:30:00' AS a, TIMESTAMP_NTZ'2020-01-01 00:10:00' AS b").coalesce(1)
    grid = hour_grid(bounds, "a", "b", "h", by=["k"])
    assert grid.rdd.getNumPartitions() >= 6 and grid.count() == hour_grid(bounds, "a", "b", "h").count() == 10 * (24 * 10_957 + 1)


def test_doses_and_grid_share_groups(spark):
    """A dose at a grid hour, one inside an hour, one of each drug, and none: amounts worked out by hand."""
    from chronoward.operators import exposure

    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    meds = spark.createDataFrame([(1, at(1), "x", 2.0, "going"), (1, at(2, 30), "x", 4.0, "going"), (1, at(2, 30), "y", 1.0, "going"), (1, at(3), "x", 0.0, "stop")], "k long, admin_dttm timestamp_ntz, med_category string, med_dose double, mar_action_category string")
    grid = spark.createDataFrame([(k, at(h)) for k in (1, 2) for h in range(5)], "k long, event_dttm timestamp_ntz")
    got = {(r["k"], r["event_dttm"].hour): (r["x_cont"], r["y_cont"]) for r in exposure.continuous_by_hour(meds, grid, "k", ["x", "y"]).collect()}
    assert got == {(1, 0): (0, 0), (1, 1): (120, 0), (1, 2): (180, 30), (1, 3): (0, 60), (1, 4): (0, 0), **{(2, h): (0, 0) for h in range(5)}}


def test_single_doses_of_an_hour(spark):
    """Sums of an hour without a grid, one record for each time and drug, doses not given left out; a known dose of 0 goes before a missing one."""
    from chronoward.operators import exposure

    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    rows = [
        (1, at(1, 10), "x", 2.0, "going", 1), (1, at(1, 10), "x", 3.0, "going", 2), (1, at(1, 50), "x", 4.0, None, 3), (1, at(1, 50), "y", 1.0, "given", 4), (1, at(1, 55), "z", 9.0, "given", 5),
        (1, at(2), "x", 5.0, "not_given", 6), (1, at(2, 5), "y", 6.0, "given", 7), (2, at(1), "x", None, "given", 8), (2, at(1), "x", 0.0, "given", 9), (2, at(2), "x", None, "given", 10), (2, at(3), "x", 7.0, "not_given", 11),
    ]
    meds = spark.createDataFrame(rows, "k long, admin_dttm timestamp_ntz, med_category string, med_dose double, mar_action_category string, id long")
    got = {(r["k"], r["event_dttm"]): (r["x_bolus"], r["y_bolus"]) for r in exposure.bolus_by_hour(meds, "k", ["x", "y"], tiebreak=["id"]).collect()}
    assert got == {(1, at(1)): (7, 1), (1, at(2)): (None, 6), (2, at(1)): (0, None), (2, at(2)): (None, None)}


def test_trial_rows_are_dealt_by_number(spark, sf_dir, monkeypatch):
    """The number of tasks follows the rows, not the session's shuffle partitions."""
    from chronoward.operators import trials
    from chronoward.plans import domain

    monkeypatch.setattr(trials, "TASK_ROWS", 100)
    n = domain.ev(spark, sf_dir).count()
    assert domain.f19(spark, sf_dir).rdd.getNumPartitions() == -(-n // 100) > 4
