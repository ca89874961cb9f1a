"""Shapes of physical plans: one shuffle on the entity, filters and columns at the scan, no nested-loop join."""

import re

import pytest

from chronoward import catalog

QUERIES = catalog.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["e02_islands", "e03_streaks", "e07_parallel_islands", "e08_over_island", "e14_forward_fill", "e22_integrate", "e25_distinct_within", "c08_asof_backward", "c12_asof_stacked", "c19_exists_within"])
def test_one_shuffle(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert text.count("Exchange hashpartitioning") == 1, text
    assert "Join" not in text


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_nested_loops_over_rows(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text
    # pairs of a row with a one-row aggregate, a literal list or a counted small list are meant
    if name not in ("c07_scaffold", "f07_waterfall", "f07_waterfall_full", "f35_hourly_means"):
        assert "BroadcastNestedLoopJoin" not in text


def test_scan_is_pruned_and_filtered(spark, sf_dir):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    text = plan(QUERIES["a01_scan"](spark, sf_dir))
    assert "GreaterThan(l_discount,0.05)" in text and "GreaterThanOrEqual(l_shipdate" in text
    assert "l_extendedprice" not in re.search(r"ReadSchema: (.*)", text)[1]
    assert "EqualTo(user_id,7)" in plan(QUERIES["a06_entity"](spark, sf_dir))
