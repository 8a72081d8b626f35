import datetime as dt

import pytest
from pyspark.sql import functions as F

from tandem.config import EventConfig
from tandem.operators import events as E

DAY0 = dt.date(2001, 1, 1)


def flags(spark, values, days=None, node=1):
    days = days or range(len(values))
    return spark.createDataFrame([(node, DAY0 + dt.timedelta(d), v) for d, v in zip(days, values)], "node bigint, day date, evt int")


def in_order(df, column):
    return [r[column] for r in df.orderBy("node", "day").collect()]


def test_a_run_is_flagged_from_its_second_day(spark):
    assert in_order(E.run_flags(flags(spark, [1, 1, 1, 0, 1, 0, 1, 1]), 2), "evt_run") == [0, 1, 1, 0, 0, 0, 0, 1]


def test_rows_and_days_differ_over_a_gap(spark):
    f = flags(spark, [1, 1, 1], [1, 2, 10])
    assert in_order(E.run_flags(f, 2, "row"), "evt_run") == [0, 1, 1]
    assert in_order(E.run_flags(f, 2, "calendar"), "evt_run") == [0, 1, 0]
    audit = E.contiguity_audit(f, 2).first()
    assert (audit["rows"], audit["row_flags"], audit["calendar_flags"], audit["mismatches"]) == (3, 2, 1, 1)


def test_runs_do_not_cross_nodes(spark):
    f = flags(spark, [0, 1], node=1).unionByName(flags(spark, [1, 1], node=2))
    assert in_order(E.run_flags(f, 2), "evt_run") == [0, 0, 0, 1]


def test_an_unknown_mode_is_an_error(spark):
    with pytest.raises(ValueError):
        E.run_flags(flags(spark, [1]), 2, "week")


def test_smoothing_counts_rows_and_shortens_at_the_edges(spark):
    raw = spark.createDataFrame([(1, d * 3, float(i)) for i, d in enumerate(range(10))], "node bigint, doy int, thr_raw double")
    got = [r["thr"] for r in E.smoothed_thresholds(raw).orderBy("doy").collect()]
    assert got == pytest.approx([3.5, 4.0, 4.5, 4.5, 4.5, 4.5, 4.5, 4.5, 5.0, 5.5], abs=1e-6) or got == pytest.approx([3.5, 4.0, 4.5, 4.5, 4.5, 4.5, 4.5, 5.0, 5.0, 5.5], abs=1e-6)


def test_percentiles_skip_nan_and_flags_need_a_threshold(spark):
    rows = [(1, dt.date(2001, 1, 1), v, 2001, 1, 1) for v in (1.0, float("nan"), 3.0)]
    days = spark.createDataFrame(rows, "node bigint, day date, value double, year int, month int, doy int")
    cfg = EventConfig(percentile=0.5, baseline=(2001, 2001))
    assert E.doy_thresholds(days, cfg).first()["thr_raw"] == 2.0
    other = spark.createDataFrame([(1, dt.date(2002, 2, 1), 5.0, 2002, 2, 32)], days.schema)
    got = E.event_flags(days.unionByName(other), E.smoothed_thresholds(E.doy_thresholds(days, cfg))).collect()
    assert sorted((r["value"] if r["value"] == r["value"] else -1, r["evt"]) for r in got) == [(-1, 0), (1.0, 0), (3.0, 1), (5.0, 0)]


def test_cold_events_are_at_or_below_the_threshold(spark):
    days = spark.createDataFrame([(1, 1, 2.0), (1, 1, 1.0)], "node bigint, doy int, value double")
    thr = spark.createDataFrame([(1, 1, 1.0, 1.0)], "node bigint, doy int, thr_raw double, thr double")
    assert {(r["value"], r["evt"]) for r in E.event_flags(days, thr, "cold").collect()} == {(2.0, 0), (1.0, 1)}


def test_equal_months_rank_by_number_and_season_comes_before_thresholds(spark):
    rows = [(1, dt.date(2001, m, 1), v, 2001, m, m) for m, v in ((1, 5.0), (2, 5.0), (3, 1.0), (4, 9.0))]
    days = spark.createDataFrame(rows, "node bigint, day date, value double, year int, month int, doy int")
    cfg = EventConfig(baseline=(2001, 2001), season="local-warm2")
    assert [(r["month"], r["warm_rank"]) for r in E.warm_months(days, cfg, 2).orderBy("warm_rank").collect()] == [(4, 1), (1, 2)]
    assert sorted(r["month"] for r in E.event_days(days, cfg).collect()) == [1, 4]


def test_minima_of_local_nights(spark):
    rows = [("2020-01-01 23:30:00", 15.0, 0.0, 290.0, 285.0), ("2020-01-01 02:00:00", 15.0, 0.0, 280.0, 279.0), ("2020-01-01 12:00:00", 15.0, 0.0, 200.0, 199.0)]
    hourly = spark.createDataFrame(rows, "t string, lon double, lat double, temperature_2m double, dewpoint_temperature_2m double").withColumn("time_utc", F.to_timestamp("t"))
    got = {str(r["lt_date"]): round(r["Tmin_C"], 2) for r in E.nightly_minima(hourly).collect()}
    assert got == {"2020-01-01": 6.85, "2020-01-02": 16.85}


def test_panel_union_and_calendar(spark):
    grid = spark.createDataFrame([(0.0, 0.0, 2000, 0.15), (0.0, 0.0, 2001, 0.1), (1.0, 0.0, 2000, None), (2.0, 0.0, 2000, float("nan"))], "lon double, lat double, year int, urban_frac double")
    panel = E.urban_panel(grid)
    assert [r["lon"] for r in E.union_nodes(panel).collect()] == [0.0]
    got = E.annual_counts(spark.createDataFrame([(2001,), (2001,), (1990,)], "year int"), (2000, 2002)).orderBy("year").collect()
    assert [tuple(r) for r in got] == [(2000, 0), (2001, 2), (2002, 0)]


def test_the_first_year_of_a_doubled_day_wins(spark):
    rows = [(1, DAY0, 2001, 1), (1, DAY0, 2000, 0)]
    got = E.first_of_day(spark.createDataFrame(rows, "node bigint, day date, year int, evt_run int")).collect()
    assert [(r["year"], r["evt_run"]) for r in got] == [(2000, 0)]
