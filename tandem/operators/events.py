"""From hourly values to event days: minima, seasons, percentile thresholds, flags and minimum runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import EventConfig, PanelConfig
from ..functions import scalars as S


def urban_panel(grid: DataFrame, config: PanelConfig = PanelConfig()) -> DataFrame:
    """grid (lon, lat, year, urban_frac) with active_y: the fraction reaches tau. Missing fractions aren't active."""
    return grid.withColumn("active_y", F.coalesce(S.as_null(F.col("urban_frac")) >= config.tau, F.lit(False)).cast("tinyint"))


def union_nodes(panel: DataFrame, keys: tuple[str, ...] = ("lon", "lat")) -> DataFrame:
    """Nodes that were active in any year."""
    return panel.groupBy(*keys).agg(F.max("active_y").alias("ever_active")).where("ever_active = 1").drop("ever_active")


def active_only(days: DataFrame, panel: DataFrame, keys: tuple[str, ...] = ("node", "year")) -> DataFrame:
    """Rows of nodes in the years in which they are active."""
    return days.join(panel.where("active_y = 1").select(*keys).distinct(), list(keys), "left_semi")


def nightly_minima(hourly: DataFrame, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """Minima of air and wet-bulb temperature over local hours 0 to 6 of each node and local date.

    hourly: time_utc, lon, lat, temperature_2m, dewpoint_temperature_2m (Kelvin); extra_keys go along if present.
    """
    local = S.local_solar_time(F.col("time_utc"), F.col("lon"))
    t, td = S.as_null(S.kelvin_to_c(F.col("temperature_2m"))), S.as_null(S.kelvin_to_c(F.col("dewpoint_temperature_2m")))
    keys = ["lon", "lat", *(k for k in extra_keys if k in hourly.columns)]
    night = hourly.select(*keys, local.alias("lt"), t.alias("t"), td.alias("td")).where(F.hour("lt").between(0, 6))
    night = night.withColumn("tw", S.wet_bulb(F.col("t"), S.relative_humidity(F.col("t"), F.col("td"))))
    return night.groupBy(*keys, F.to_date("lt").alias("lt_date")).agg(F.min("t").alias("Tmin_C"), F.min("tw").alias("Twmin_C"))


def baseline_days(days: DataFrame, config: EventConfig) -> DataFrame:
    return days.where(F.col("year").between(*config.baseline))


def warm_months(days: DataFrame, config: EventConfig, n: int) -> DataFrame:
    """(node, month, mean_value, warm_rank): each node's n months of highest baseline mean; ties go to the lower month."""
    monthly = baseline_days(days, config).groupBy("node", "month").agg(F.avg("value").alias("mean_value"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("mean_value"), "month"))
    return monthly.withColumn("warm_rank", rank).where(F.col("warm_rank") <= n)


def season_filter(days: DataFrame, config: EventConfig) -> DataFrame:
    n = config.season_months
    return days if n is None else days.join(warm_months(days, config, n).select("node", "month"), ["node", "month"], "left_semi").select(*days.columns)


def doy_thresholds(days: DataFrame, config: EventConfig) -> DataFrame:
    """(node, doy, thr_raw): the exact percentile of baseline values, NaN left out."""
    return baseline_days(days, config).groupBy("node", "doy").agg(F.percentile(S.as_null(F.col("value")), config.percentile).alias("thr_raw"))


def smoothed_thresholds(raw: DataFrame, rows: int = 15, digits: int = 7) -> DataFrame:
    """raw with thr: a centred mean over rows (not days), shorter at the edges.

    Rounded, with a nudge off decimal ties, so that the order in which an engine sums can't move an event.
    """
    around = Window.partitionBy("node").orderBy("doy").rowsBetween(-(rows // 2), rows // 2)
    return raw.withColumn("thr", F.round(F.avg("thr_raw").over(around) + 10.0 ** -(digits + 2), digits))


def event_flags(days: DataFrame, thresholds: DataFrame, kind: str = "hot") -> DataFrame:
    """days with thr_raw, thr and evt; a missing value or threshold is no event.

    A node's thresholds travel as one array by day of year, so days are dealt out by node alone: the run windows that
    follow need no further exchange.
    """
    entry = F.struct("thr_raw", "thr")
    by_doy = F.map_from_entries(F.collect_list(F.struct("doy", entry)))
    dense = F.transform(F.sequence(F.lit(1), F.lit(366)), lambda d: F.try_element_at(F.col("_map"), d))
    per_node = thresholds.groupBy("node").agg(by_doy.alias("_map")).select("node", dense.alias("_thr"))
    joined = days.join(per_node, "node", "left").withColumn("_t", F.try_element_at("_thr", F.col("doy"))).drop("_thr")
    joined = joined.withColumn("thr_raw", F.col("_t.thr_raw")).withColumn("thr", F.col("_t.thr")).drop("_t")
    value = S.as_null(F.col("value"))
    beyond = value >= F.col("thr") if kind == "hot" else value <= F.col("thr")
    return joined.withColumn("evt", F.coalesce(beyond, F.lit(False)).cast("int"))


def run_flags(flags: DataFrame, length: int, mode: str = "row", flag: str = "evt", out: str = "evt_run") -> DataFrame:
    """flags with out: 1 from the length-th day of a run on; earlier days of the run stay 0.

    mode "row" counts adjacent rows, so a run may go on over a gap between seasons; "calendar" starts anew after a gap.
    """
    order = Window.partitionBy("node").orderBy("day")
    on = F.coalesce(F.col(flag) == 1, F.lit(False))
    numbered = flags.withColumn("_row", F.row_number().over(order))
    before = F.when(~on, F.col("_row"))  # the row before a run starts
    if mode == "calendar":
        numbered = numbered.withColumn("_gap", F.coalesce(F.datediff("day", F.lag("day").over(order)) != 1, F.lit(True)))
        before = before.when(F.col("_gap"), F.col("_row") - 1)
    elif mode != "row":
        raise ValueError(f"unknown mode: {mode}")
    # A row's place in its run is its distance from the last such row: one sort by node and day serves all of it.
    place = F.col("_row") - F.coalesce(F.max(before).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return numbered.withColumn(out, (on & (place >= length)).cast("int")).drop("_row", "_gap")


def event_days(days: DataFrame, config: EventConfig = EventConfig()) -> DataFrame:
    """The event table: season filter, then thresholds of what is left, flags and run flags."""
    season = season_filter(days, config)
    thresholds = smoothed_thresholds(doy_thresholds(season, config), config.smoothing_rows)
    return run_flags(event_flags(season, thresholds, config.kind), config.min_run, config.run_mode)


def clip_days(days: DataFrame, first: str, last: str, day: str = "day") -> DataFrame:
    """Rows from the first to the last day of the study, both inclusive."""
    return days.where(F.col(day).between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))


def first_of_day(events: DataFrame) -> DataFrame:
    """One row per node and day: the one of the smallest year."""
    first = F.row_number().over(Window.partitionBy("node", "day").orderBy("year"))
    return events.withColumn("_n", first).where("_n = 1").drop("_n")


def contiguity_audit(flags: DataFrame, length: int) -> DataFrame:
    """How often counting rows and counting days differ: rows, row_flags, calendar_flags, mismatches, mismatch_percent."""
    both = run_flags(run_flags(flags, length, "row", out="by_row"), length, "calendar", out="by_day")
    return both.agg(
        F.count(F.lit(1)).alias("rows"), F.sum("by_row").alias("row_flags"), F.sum("by_day").alias("calendar_flags"),
        F.count_if(F.col("by_row") != F.col("by_day")).alias("mismatches"),
        F.round(100 * F.avg((F.col("by_row") != F.col("by_day")).cast("double")), 6).alias("mismatch_percent"),
    )


def event_summary(events: DataFrame, flag: str = "evt_run", limits: tuple[float, ...] = (20.0, 25.0)) -> DataFrame:
    """n_events, median value and the percentage of event days that reach each limit."""
    hot = events.where(F.col(flag) == 1)
    share = [F.round(100 * F.avg((F.col("value") >= x).cast("double")), 6).alias(f"percent_ge_{k}") for k, x in enumerate(limits, 1)]
    return hot.agg(F.count(F.lit(1)).alias("n_events"), F.round(F.median("value"), 6).alias("median_value"), *share)


def node_dimension(keys: DataFrame, by: tuple[str, ...] = ("lon", "lat")) -> DataFrame:
    """Distinct keys with a dense node id from 0, in key order. For dimension tables: it numbers all rows in one order."""
    return keys.select(*by).distinct().withColumn("node", (F.row_number().over(Window.orderBy(*by)) - 1).cast("bigint"))


def annual_counts(events: DataFrame, years: tuple[int, int], by: tuple[str, ...] = (), year: str = "year", name: str = "n") -> DataFrame:
    """Rows per year (and key), with 0 in years without any, over a dense calendar."""
    spark = events.sparkSession
    calendar = spark.range(years[0], years[1] + 1).select(F.col("id").cast("int").alias(year))
    if by:
        calendar = events.select(*by).distinct().crossJoin(F.broadcast(calendar))  # a calendar has a row a year
    counted = events.groupBy(*by, year).agg(F.count(F.lit(1)).alias(name))
    return calendar.join(counted, [*by, year], "left").select(*by, year, F.coalesce(name, F.lit(0)).alias(name))
