"""Queries on event detection, and what their SQL is."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EventConfig, PanelConfig
from ..functions import scalars as S
from ..operators import events as E
from ..sources.tables import BASELINE, node_days, nodes, table
from . import sql as Q
from .kept import kept

HOT = EventConfig(baseline=BASELINE)
COLD = EventConfig.cold(baseline=BASELINE)
WARM = EventConfig(baseline=BASELINE, season="local-warm3")
YEARS = (1995, 2001)
TAU = 0.95


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node-day series, kept once computed: thresholds, flags and seasons all start from it."""
    return kept(spark, sf_dir, "days", node_days(spark, sf_dir))


def hot_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hot event table. It is what most queries start from, so it is kept once it has been computed."""
    return kept(spark, sf_dir, "hot", E.event_days(days(spark, sf_dir), HOT))


def cold_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "cold", E.event_days(days(spark, sf_dir), COLD))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, year, urban_frac, active_y: the share of a customer nation's orders above 40,000."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("node"))
    o = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), (F.col("o_totalprice") > 40_000).cast("double").alias("big"))
    grid = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("node", "year").agg(F.round(F.avg("big"), 6).alias("urban_frac"))
    return E.urban_panel(grid, PanelConfig(tau=TAU))


PANEL = f"""panel as (
    select c_nationkey::bigint as node, year(o_orderdate)::int as year, round(avg((o_totalprice > 40000)::int::double), 6) as urban_frac,
           (round(avg((o_totalprice > 40000)::int::double), 6) >= {TAU})::tinyint as active_y
    from orders join customer on o_custkey = c_custkey group by 1, 2)"""


def nightly_minima(spark, sf_dir):
    user = F.col("user_id")
    hourly = table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("time_utc"), ((user * 37) % 360 - 180).cast("double").alias("lon"), ((user * 17) % 140 - 70).cast("double").alias("lat"),
        (273.15 + F.col("value") % 40).alias("temperature_2m"), (268.15 + F.col("value") % 40).alias("dewpoint_temperature_2m"),
    )
    got = E.nightly_minima(hourly)
    return got.select("lon", "lat", S.day_text(F.col("lt_date")).alias("lt_date"), F.round("Tmin_C", 5).alias("Tmin_C"), F.round("Twmin_C", 5).alias("Twmin_C"))


NIGHTLY = """with h as (
    select ((user_id * 37) % 360 - 180)::double as lon, ((user_id * 17) % 140 - 70)::double as lat, ts,
           273.15 + value % 40 - 273.15 as t, 268.15 + value % 40 - 273.15 as td from events),
l as (
    select *, ts + to_microseconds(round(lon / 15 * 3.6e9)::bigint) as lt,
           greatest(0.0, least(100.0, 100 * exp(17.625 * td / (243.04 + td)) / exp(17.625 * t / (243.04 + t)))) as rh from h),
w as (
    select lon, lat, lt, t, t * atan(0.151977 * sqrt(rh + 8.313659)) + atan(t + rh) - atan(rh - 1.676331)
           + 0.00391838 * pow(rh, 1.5) * atan(0.023101 * rh) - 4.686035 as tw
    from l where hour(lt) between 0 and 6)
select lon, lat, strftime(lt, '%Y-%m-%d') as lt_date, round(min(t), 5) as "Tmin_C", round(min(tw), 5) as "Twmin_C"
from w group by lon, lat, strftime(lt, '%Y-%m-%d')"""


def union_nodes(spark, sf_dir):
    return E.union_nodes(panel(spark, sf_dir), ("node",)).select("node")


def urban_panel(spark, sf_dir):
    return panel(spark, sf_dir).select("node", "year", "urban_frac", F.col("active_y").cast("int").alias("active_y"))


def active_node_year_join(spark, sf_dir):
    got = E.active_only(days(spark, sf_dir), panel(spark, sf_dir))
    return got.groupBy("node", "year").agg(F.count(F.lit(1)).alias("days"), F.round(F.sum("value"), 4).alias("value"))


def warm_months(spark, sf_dir):
    got = E.warm_months(days(spark, sf_dir), WARM, 3)
    return got.select("node", "month", F.round("mean_value", 4).alias("mean_value"), "warm_rank")


def season_filter(spark, sf_dir):
    got = E.season_filter(days(spark, sf_dir), WARM)
    return got.select("node", S.day_text(F.col("day")).alias("day"), "value")


def doy_thresholds(spark, sf_dir):
    return E.doy_thresholds(days(spark, sf_dir), HOT).select("node", "doy", F.round("thr_raw", 7).alias("thr_raw"))


def smoothed_thresholds(spark, sf_dir):
    got = E.smoothed_thresholds(E.doy_thresholds(days(spark, sf_dir), HOT))
    return got.select("node", "doy", "thr")


def _flags(days: DataFrame) -> DataFrame:
    return days.select("node", S.day_text(F.col("day")).alias("day"), "value", "evt", "evt_run")


def event_flags(spark, sf_dir):
    return _flags(hot_days(spark, sf_dir))


def cold_event_flags(spark, sf_dir):
    return _flags(cold_days(spark, sf_dir))


def warm_season_events(spark, sf_dir):
    return _flags(E.event_days(days(spark, sf_dir), WARM))


def run_flags_row(spark, sf_dir):
    return hot_days(spark, sf_dir).groupBy("node", "year").agg(F.sum("evt").alias("events"), F.sum("evt_run").alias("run_events"))


def run_flags_calendar(spark, sf_dir):
    got = E.run_flags(hot_days(spark, sf_dir), 2, "calendar", out="by_day")
    return got.groupBy("node", "year").agg(F.sum("evt").alias("events"), F.sum("by_day").alias("run_events"))


def contiguity_audit(spark, sf_dir):
    return E.contiguity_audit(hot_days(spark, sf_dir), 2)


def event_temperature_summary(spark, sf_dir):
    return E.event_summary(hot_days(spark, sf_dir), limits=(150_000.0, 250_000.0))


def annual_event_counts(spark, sf_dir):
    hot = hot_days(spark, sf_dir).where("evt_run = 1")
    return E.annual_counts(hot, YEARS, name="event_days")


def annual_counts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("year"))
    return E.annual_counts(orders, (1990, 2005), ("status",))


def node_dimension(spark, sf_dir):
    return E.node_dimension(nodes(spark, sf_dir).select("lon", "lat"))


def study_days(spark, sf_dir):
    got = E.clip_days(days(spark, sf_dir), "2000-01-01", "2024-12-31").groupBy("day").agg(F.count(F.lit(1)).alias("nodes"))
    return got.select(S.study_day(F.col("day")).alias("pos"), S.day_text(F.col("day")).alias("day"), "nodes")


def first_of_day(spark, sf_dir):
    d = hot_days(spark, sf_dir).select("node", "day", "year", "evt_run")
    twice = d.unionByName(d.where(F.dayofyear("day") == 1).withColumn("year", F.col("year") - 1))
    return E.first_of_day(twice).groupBy("year").agg(F.count(F.lit(1)).alias("rows"), F.sum("evt_run").alias("events"))


_FLAG_COLUMNS = "select node, strftime(day, '%Y-%m-%d') as day, value, evt, evt_run from ev"
_SEASON = "ws as (select nd.* from nd where (node, month) in (select node, month from warm))"


@cache
def oracles() -> dict[str, str]:
    hot = (Q.ND, Q.events())
    return {
        "nightly_minima": NIGHTLY,
        "union_nodes": Q.query(PANEL, select="select node from panel group by node having max(active_y) = 1"),
        "urban_panel": Q.query(PANEL, select="select node, year, urban_frac, active_y::int as active_y from panel"),
        "active_node_year_join": Q.query(Q.ND, PANEL, select="select node, year, count(*) as days, round(sum(value), 4) as value from nd where (node, year) in (select node, year from panel where active_y = 1) group by node, year"),
        "warm_months": Q.query(Q.ND, Q.warm(3), select="select node, month, round(mean_value, 4) as mean_value, warm_rank from warm"),
        "season_filter": Q.query(Q.ND, Q.warm(3), select="select node, strftime(day, '%Y-%m-%d') as day, value from nd where (node, month) in (select node, month from warm)"),
        "doy_thresholds": Q.query(*hot, select="select node, doy, round(thr_raw, 7) as thr_raw from ev_thr"),
        "smoothed_thresholds": Q.query(*hot, select="select node, doy, thr from ev_sm"),
        "event_flags": Q.query(*hot, select=_FLAG_COLUMNS),
        "cold_event_flags": Q.query(Q.ND, Q.events(kind="cold"), select=_FLAG_COLUMNS),
        "warm_season_events": Q.query(Q.ND, Q.warm(3), _SEASON, Q.events(src="ws"), select=_FLAG_COLUMNS),
        "run_flags_row": Q.query(*hot, select="select node, year, sum(evt)::bigint as events, sum(evt_run)::bigint as run_events from ev group by node, year"),
        "run_flags_calendar": Q.query(*hot, Q.calendar_runs("ev", "cal", 2), select="select node, year, sum(evt)::bigint as events, sum(by_day)::bigint as run_events from cal group by node, year"),
        "contiguity_audit": Q.query(*hot, Q.calendar_runs("ev", "cal", 2), select='select count(*) as "rows", sum(evt_run)::bigint as row_flags, sum(by_day)::bigint as calendar_flags, count(*) filter (where evt_run <> by_day) as mismatches, round(100 * avg((evt_run <> by_day)::int::double), 6) as mismatch_percent from cal'),
        "event_temperature_summary": Q.query(*hot, select="select count(*) as n_events, round(median(value), 6) as median_value, round(100 * avg((value >= 150000)::int::double), 6) as percent_ge_1, round(100 * avg((value >= 250000)::int::double), 6) as percent_ge_2 from ev where evt_run = 1"),
        "annual_event_counts": Q.query(*hot, select=f"select y::int as year, count(node) as event_days from range({YEARS[0]}, {YEARS[1] + 1}) t(y) left join (select * from ev where evt_run = 1) e on e.year = y group by y"),
        "annual_counts": "with o as (select o_orderstatus as status, year(o_orderdate) as year from orders) select s.status, y::int as year, count(o.status) as n from (select distinct status from o) s cross join range(1990, 2006) t(y) left join o on o.status = s.status and o.year = y group by s.status, y",
        "node_dimension": Q.query(Q.NODES, select="select lon, lat, (row_number() over (order by lon, lat) - 1)::bigint as node from (select distinct lon, lat from nodes)"),
        "study_days": Q.query(Q.ND, select="select (day - date '2000-01-01')::int as pos, strftime(day, '%Y-%m-%d') as day, count(*) as nodes from nd where year >= 2000 group by nd.day"),
        "first_of_day": Q.query(*hot, "tw as (select node, day, year, evt_run from ev union all select node, day, year - 1, evt_run from ev where doy = 1)", select='select year::int as year, count(*) as "rows", sum(evt_run)::bigint as events from (select *, row_number() over (partition by node, day order by year) as k from tw) where k = 1 group by year'),
    }


QUERIES = {f.__name__: f for f in (
    nightly_minima, union_nodes, urban_panel, active_node_year_join, warm_months, season_filter, doy_thresholds, smoothed_thresholds, event_flags,
    cold_event_flags, warm_season_events, run_flags_row, run_flags_calendar, contiguity_audit, event_temperature_summary, annual_event_counts,
    annual_counts, node_dimension, study_days, first_of_day,
)}
