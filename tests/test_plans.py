"""What the physical plans look like: columns pruned at the scan, filters pushed down, no cartesian products."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tandem.operators import coincidence as C
from tandem.operators import runs as R
from tandem.plans import catalog
from tandem.sources.tables import node_days, table

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
#: These run their model or stream while they build the result.
EAGER = {"cluster_bundles", "cluster_groups", "streaming_daily_minima"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def schemas(text: str) -> list[set[str]]:
    return [set(re.findall(r"(\w+):", s)) for s in re.findall(r"ReadSchema: struct<([^>]*)>", text)]


def test_scans_read_only_what_they_need(spark):
    assert {"l_suppkey", "l_extendedprice", "l_discount", "l_shipdate"} in schemas(plan(node_days(spark, str(DATA))))
    assert {"s_suppkey", "s_nationkey"} in schemas(plan(node_days(spark, str(DATA))))


def test_filters_reach_the_scan(spark):
    text = plan(table(spark, str(DATA), "customer").where("c_acctbal > 9900").select("c_nationkey"))
    assert "GreaterThan(c_acctbal,9900.0)" in text


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - EAGER))
def test_no_cartesian_products(spark, name):
    assert "CartesianProduct" not in plan(catalog.queries()[name](spark, str(DATA)))


def test_ranges_are_equi_joins(spark):
    days = spark.createDataFrame([], "node bigint, day date, evt int")
    runs = spark.createDataFrame([], "node bigint, run_uid bigint, start date, end date")
    pairs = spark.createDataFrame([], "a bigint, b bigint")
    for df in (C.observed(days, 3), C.overlap(days), R.locked_by_join(runs, pairs, 3)):
        assert "NestedLoopJoin" not in plan(df)


def test_day_windows_are_pre_aggregated(spark):
    text = plan(node_days(spark, str(DATA)).groupBy("node").agg(F.sum("value")))
    assert text.count("partial_sum") >= 2


def test_flags_and_runs_share_one_exchange_and_one_sort(spark):
    from tandem.config import EventConfig
    from tandem.operators import events as E

    days = spark.range(0).select(F.col("id").alias("node"), F.lit("2001-01-01").cast("date").alias("day"), F.rand().alias("value"), F.lit(2001).alias("year"), F.lit(1).alias("month"), F.lit(1).alias("doy"))
    flags = spark.createDataFrame([], "node bigint, day date, value double, evt int")
    for mode in ("row", "calendar"):
        text = plan(E.run_flags(flags, 2, mode))
        assert text.count("Exchange hashpartitioning") == 1 and len(re.findall(r"\bSort \[", text)) == 1
    assert "hashpartitioning(node, doy" not in plan(E.event_flags(days, E.smoothed_thresholds(E.doy_thresholds(days, EventConfig())))).split("Window")[0].replace("#", "")
