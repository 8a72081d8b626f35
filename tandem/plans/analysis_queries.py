"""Queries on trends, denominators, surrogates, spectra, exposure, sensitivity, set operations and checks."""

from __future__ import annotations

import math
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SurrogateConfig
from ..functions import scalars as S
from ..functions.special import geodesic_km
from ..operators import bundles as B
from ..operators import exposure as X
from ..operators import quality as D
from ..operators import sensitivity as V
from ..operators import spectral as P
from ..operators import stats as T
from ..operators import surrogates as U
from ..sources.tables import node_days, nodes, orders_by_year, table
from ..streaming.minima import streaming_minima
from . import sql as Q
from .event_queries import PANEL, YEARS, cold_days, hot_days, panel

N_YEARS = YEARS[1] - YEARS[0] + 1
THRESHOLD = 0.05
DRAWS = SurrogateConfig().draws


def _orders_series(spark, sf_dir) -> DataFrame:
    return orders_by_year(spark, sf_dir).select("status", F.col("year").cast("double").alias("x"), F.col("n").cast("double").alias("y"))


def theil_sen(spark, sf_dir):
    got = T.theil_sen(_orders_series(spark, sf_dir), ("status",))
    return got.select("status", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "low95", "high95")])


def kendall_tau(spark, sf_dir):
    got = T.kendall_tau(_orders_series(spark, sf_dir), ("status",), p_value=False)
    return got.select("status", "n", "score", F.round("tau", 8).alias("tau"))


def trend_summary(spark, sf_dir):
    return T.trend(_orders_series(spark, sf_dir), ("status",))


def _node_deltas(spark, sf_dir) -> DataFrame:
    """A difference per node: mean of odd years less mean of even years, to whole hundreds, so that some sizes tie."""
    d = node_days(spark, sf_dir)
    odd, even = F.avg(F.when(F.col("year") % 2 == 1, F.col("value"))), F.avg(F.when(F.col("year") % 2 == 0, F.col("value")))
    return d.groupBy("node").agg(F.floor((odd - even) / 500).cast("double").alias("delta"))


def wilcoxon_z(spark, sf_dir):
    got = T.wilcoxon_z(_node_deltas(spark, sf_dir))
    return got.select("n", F.col("w_plus").cast("double").alias("w_plus"), F.round("z", 8).alias("z"))


def wilcoxon_p(spark, sf_dir):
    got = T.wilcoxon(_node_deltas(spark, sf_dir))
    return got.select("n", F.round("p_greater", 8).alias("p_greater"), F.round("p_two_sided", 8).alias("p_two_sided"))


def bundle_sides(spark, sf_dir) -> DataFrame:
    """Three bundles of nations: side by parity, bundle by id modulo 3."""
    n = nodes(spark, sf_dir)
    return n.select((F.col("node") % 3).cast("int").alias("cluster"), F.when(F.col("node") % 2 == 0, "side_a").otherwise("side_b").alias("side"), "node")


SIDES = "sd as (select (n_nationkey % 3)::int as cluster, case when n_nationkey % 2 = 0 then 'side_a' else 'side_b' end as side, n_nationkey::bigint as node from nation)"


def stable_core(spark, sf_dir):
    return V.stable_core(panel(spark, sf_dir).withColumn("active_y", (F.col("urban_frac") > 0.9).cast("tinyint")), N_YEARS)


def _broad_panel(spark, sf_dir) -> DataFrame:
    return panel(spark, sf_dir).withColumn("active_y", (F.col("urban_frac") > 0.9).cast("tinyint"))


def denominator_scenarios(spark, sf_dir):
    return V.denominator_scenarios(hot_days(spark, sf_dir), bundle_sides(spark, sf_dir), _broad_panel(spark, sf_dir), N_YEARS, THRESHOLD)


def denominator_scenarios_dipole(spark, sf_dir):
    return V.denominator_scenarios(hot_days(spark, sf_dir), bundle_sides(spark, sf_dir), _broad_panel(spark, sf_dir), N_YEARS, THRESHOLD, cold=cold_days(spark, sf_dir))


def scenario_bundles(spark, sf_dir):
    dates = V.denominator_dates(hot_days(spark, sf_dir), bundle_sides(spark, sf_dir), _broad_panel(spark, sf_dir), N_YEARS, THRESHOLD)
    got = V.scenario_bundles(dates, bundle_sides(spark, sf_dir))
    return got.withColumns({c: F.round(c, 8) for c in ("median_fraction_a", "median_fraction_b")})


def scenario_trends(spark, sf_dir):
    """Theil–Sen slopes of each scenario's yearly totals, with 0 in years without a day."""
    got = denominator_scenarios(spark, sf_dir).groupBy("scenario", "year").agg(F.sum("n").alias("n"))
    names = spark.createDataFrame([(s.name,) for s in V.SCENARIOS], "scenario string")
    dense = names.crossJoin(spark.range(YEARS[0], YEARS[1] + 1).select(F.col("id").cast("int").alias("year")))  # nine names by seven years
    series = dense.join(got, ["scenario", "year"], "left").select("scenario", F.col("year").cast("double").alias("x"), F.coalesce("n", F.lit(0)).cast("double").alias("y"))
    return T.theil_sen(series, ("scenario",)).select("scenario", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


def _sync_totals(spark, sf_dir, shift) -> DataFrame:
    placed = U.positions(hot_days(spark, sf_dir))
    days = U.shifted_days(placed, DRAWS, shift)
    return U.synchronized_totals(days, bundle_sides(spark, sf_dir), 0.1)


ARITHMETIC = (F.col, lambda c: (c("node") * 31 + c("draw") * 17 + c("year")) % c("n"))


def _arithmetic_shift():
    c, f = ARITHMETIC
    return f(c)


def circular_surrogates(spark, sf_dir):
    return _sync_totals(spark, sf_dir, _arithmetic_shift())


def hashed_surrogates(spark, sf_dir):
    return _sync_totals(spark, sf_dir, U.hashed_shift(20260603))


def surrogate_summary(spark, sf_dir):
    sides = bundle_sides(spark, sf_dir)
    drawn = U.dense_totals(circular_surrogates(spark, sf_dir), sides, DRAWS, ["cluster"])
    dates = B.synchronized_dates(B.daily_signal(hot_days(spark, sf_dir).where("evt_run = 1").select("node", "day"), sides), 0.1)
    observed = dates.groupBy("cluster").agg(F.count(F.lit(1)).cast("double").alias("observed"))
    got = U.surrogate_summary(drawn, observed, ["cluster"])
    return got.select("cluster", "observed", *[F.round(c, 8).alias(c) for c in ("surrogate_mean", "surrogate_p95", "surrogate_p99", "empirical_p")])


def surrogate_layers(spark, sf_dir):
    """Layer totals and slopes against hash-drawn surrogates: hot with hot sides (Coherent), hot with cold sides (Dipole)."""
    sides = bundle_sides(spark, sf_dir)
    hot, cold = hot_days(spark, sf_dir), cold_days(spark, sf_dir)
    of = lambda events, side: events.join(sides.where(F.col("side") == side).select("node"), "node", "left_semi")
    drawn = lambda events, seed: U.shifted_days(U.positions(events), DRAWS, U.hashed_shift(seed))
    seen = lambda events: events.where("evt_run = 1").select(F.lit(0).alias("draw"), "node", "day")
    totals = lambda days, layer: U.synchronized_totals(days, sides, 0.1).withColumn("layer", F.lit(layer))
    seed = SurrogateConfig().seed
    rows = totals(drawn(hot, seed), "Coherent").unionByName(totals(drawn(of(hot, "side_a"), seed).unionByName(drawn(of(cold, "side_b"), seed + 1)), "Dipole"))
    observed = totals(seen(hot), "Coherent").unionByName(totals(seen(of(hot, "side_a")).unionByName(seen(of(cold, "side_b"))), "Dipole"))
    layers = spark.createDataFrame([("Coherent",), ("Dipole",)], "layer string")
    got = U.layer_summary(rows, observed, layers, DRAWS, YEARS)
    return got.select("layer", *[F.round(c, 8).alias(c) for c in got.columns if c != "layer"])


def _waves(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: x.cast("double") * 1000).alias("z"))


def composite_anomaly(spark, sf_dir):
    got = P.composite(_waves(spark, sf_dir), ["label"])
    return got.select("label", "n", F.posexplode("z").alias("i", "v")).select("label", "n", "i", F.round("v", 6).alias("v"))


def _composites(spark, sf_dir) -> DataFrame:
    return P.composite(_waves(spark, sf_dir), ["label"])


def bandpass_dft(spark, sf_dir):
    return P.band_pass_sums(_composites(spark, sf_dir), ["label"], 64, 4, 8).select("label", "i", F.round("wave", 6).alias("wave"))


def bandpass_fft(spark, sf_dir):
    got = P.band_pass(_composites(spark, sf_dir), 4, 8)
    return got.select("label", F.posexplode("wave").alias("i", "wave")).select("label", "i", F.round("wave", 6).alias("wave"))


def _early_late(spark, sf_dir) -> DataFrame:
    w = _waves(spark, sf_dir)
    early, late = P.composite(w.where("vec_id % 2 = 0"), ["label"]), P.composite(w.where("vec_id % 2 = 1"), ["label"])
    return early.select("label", F.col("z").alias("early")).join(late.select("label", F.col("z").alias("late")), "label")


def lag_correlation(spark, sf_dir):
    return P.lag_correlation(_early_late(spark, sf_dir), ["label"], 64).select("label", "shift", F.round("corr", 8).alias("corr"))


def lag_correlation_drift(spark, sf_dir):
    got = P.drift(P.lag_correlation(_early_late(spark, sf_dir), ["label"], 64), ["label"])
    return got.select("label", "best_shift", F.round("drift", 8).alias("drift"))


def wave_diagnostics(spark, sf_dir):
    lon = lambda k: ((F.col("label") * k) % 360 - 180).cast("double")
    rows = _composites(spark, sf_dir).withColumn("lon_a", lon(37)).withColumn("lon_b", lon(101))
    got = P.band_sweep(rows, S.parse_bands("3-8,4-8"), 64)
    return got.select("label", "band", F.round("wave_a", 6).alias("wave_a"), F.round("wave_b", 6).alias("wave_b"), F.round("abs_delta", 6).alias("abs_delta"), "same_sign", "class")


def nearest_days(spark, sf_dir):
    """All order days matched with the nearest order day of their year, three days earlier."""
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"), "o_totalprice").groupBy("date").agg(F.max("o_totalprice").alias("z"))
    return P.nearest_days(o.select("date"), o, -3).select(S.day_text(F.col("date")).alias("day"), "z")


def _pixels(spark, sf_dir) -> DataFrame:
    """Customers as pixels around their nation's node, their balance as population."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("bigint").alias("node"), "c_custkey", F.abs("c_acctbal").alias("population"))
    near = c.join(nodes(spark, sf_dir), "node")
    return near.select((F.col("lon") + (F.col("c_custkey") % 5) * 0.0625 - 0.1).alias("lon"), (F.col("lat") + (F.col("c_custkey") % 3) * 0.0625 - 0.05).alias("lat"), "population")


def _population(spark, sf_dir) -> DataFrame:
    marks = X.footprints(bundle_sides(spark, sf_dir))
    return X.zonal_sum(marks, nodes(spark, sf_dir), _pixels(spark, sf_dir))


def _bundle_dates(spark, sf_dir) -> DataFrame:
    sides = bundle_sides(spark, sf_dir)
    return B.synchronized_dates(B.daily_signal(hot_days(spark, sf_dir).where("evt_run = 1").select("node", "day"), sides), 0.1)


def footprint_sizes(spark, sf_dir):
    return X.footprint_sizes(X.footprints(bundle_sides(spark, sf_dir)))


def exposure_person_nights(spark, sf_dir):
    got = X.person_nights(_population(spark, sf_dir), _bundle_dates(spark, sf_dir))
    return got.select("cluster", "footprint", F.round("population", 4).alias("population"), "event_nights", F.round("person_nights", 2).alias("person_nights"))


def annual_person_nights(spark, sf_dir):
    got = X.annual_person_nights(_population(spark, sf_dir), _bundle_dates(spark, sf_dir))
    return got.select("cluster", "year", "event_nights", F.round("person_nights", 2).alias("person_nights"))


def _corridors(spark, sf_dir) -> DataFrame:
    n = nodes(spark, sf_dir)
    a, b = n.select(F.col("node").alias("a"), F.col("lon").alias("a_lon"), F.col("lat").alias("a_lat")), n.select(F.col("node").alias("b"), F.col("lon").alias("b_lon"), F.col("lat").alias("b_lat"))
    pairs = a.join(b, F.col("b") == F.col("a") + 7)
    setting = F.when(F.col("a") % 3 == 0, "Primary").when(F.col("a") % 3 == 1, "K=1").otherwise("D=3")
    return pairs.select(setting.alias("setting"), F.when(F.col("a") % 2 == 0, "Coherent").otherwise("Dipole").alias("layer"), F.col("a").cast("int").alias("rank"), "a_lon", "a_lat", "b_lon", "b_lat")


def nearest_primary(spark, sf_dir):
    got = V.nearest_primary(_corridors(spark, sf_dir))
    return got.select("setting", "layer", "rank", "closest_primary_rank", F.round("closest_primary_km", 5).alias("closest_primary_km"), "within_1500km", "within_2500km")


def geography_summary(spark, sf_dir):
    label = F.concat(S.region_name(F.col("a_lon"), F.col("a_lat")), F.lit(" - "), S.region_name(F.col("b_lon"), F.col("b_lat")))
    got = V.geography_summary(V.nearest_primary(_corridors(spark, sf_dir)), label)
    return got.withColumn("median_km", F.round("median_km", 5))


def humidity_wetbulb(spark, sf_dir):
    t = F.col("value") % 40
    td = t - F.col("value") % 7
    e = table(spark, sf_dir, "events").select("event_id", t.alias("t"), td.alias("td")).withColumn("rh", S.relative_humidity(F.col("t"), F.col("td")))
    return e.select("event_id", F.round("rh", 6).alias("rh"), F.round(S.wet_bulb(F.col("t"), F.col("rh")), 6).alias("tw"))


def region_case(spark, sf_dir):
    n = nodes(spark, sf_dir)
    long, short = S.region_name(F.col("lon"), F.col("lat")), S.region_name(F.col("lon"), F.col("lat"), True)
    return n.select("node", long.alias("region"), S.safe_name(F.concat(short, F.lit(" -> x"))).alias("safe"), S.lon_360(F.col("lon")).alias("lon360"))


def cell_bounds(spark, sf_dir):
    return nodes(spark, sf_dir).select("node", S.cell_bounds(F.col("lon"), F.col("lat")).alias("c")).select("node", "c.*")


def tag_names(spark, sf_dir):
    rows = [(2, 3, 0.005), (1, 3, 0.005), (2, 5, 0.005), (2, 3, 0.01)]
    label = S.setting_label(F.col("d"), F.col("k"), F.col("alpha"))
    return spark.createDataFrame(rows, "d int, k int, alpha double").select(label.alias("setting"), F.lit(S.tau_tag(0.15) + S.season_suffix("local-warm3")).alias("tag"))


def bundle_labels(spark, sf_dir):
    rows = [(m, r) for m in ("Coherent", "Dipole") for r in (1, 2, 3, 4)]
    label = S.bundle_label(F.col("mechanism"), F.col("rank"))
    return spark.createDataFrame(rows, "mechanism string, rank int").select("mechanism", "rank", label.alias("bundle"), S.replace_first(label, " ", "\n").alias("axis"), S.safe_setting(F.lit("p<0.01")).alias("slug"))


def nearest_year(spark, sf_dir):
    years = orders_by_year(spark, sf_dir).select("year").distinct().where("year % 2 = 0")
    one = lambda y: X.nearest_year(years, F.lit(y)).select(F.lit(y).alias("wanted"), "nearest")
    return one(1999).unionByName(one(1900)).unionByName(one(1996))


def _heights(spark, sf_dir) -> DataFrame:
    """Vectors as height rows: a day each, at one of two levels and three latitudes."""
    i = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.date_add(F.lit("2000-06-01").cast("date"), (F.floor(i / 6) % 150).cast("int")).alias("date"), F.when(i % 2 == 0, 500).otherwise(850).alias("level"),
        (30.0 + 10 * (F.floor(i / 2) % 3)).alias("lat"), F.transform("embedding", lambda x: x * 1000).alias("z"),
    )


def nearest_latitude(spark, sf_dir):
    got = P.nearest_latitude(_heights(spark, sf_dir), 41.0, 520)
    return got.groupBy(S.day_text(F.col("date")).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.element_at("z", 1).cast("double")), 3).alias("z0"))


def bundle_wave_diagnostics(spark, sf_dir):
    bundles = spark.createDataFrame([("C1", -100.0, 40.0, 10.0, 50.0), ("D1", 110.0, 30.0, -90.0, 34.0)], "bundle string, lon_a double, lat_a double, lon_b double, lat_b double")
    dates = _heights(spark, sf_dir).select(F.when(F.dayofyear("date") % 2 == 0, "C1").otherwise("D1").alias("bundle"), "date").distinct()
    got = P.bundle_diagnostics(bundles, dates, _heights(spark, sf_dir), 64)
    return got.withColumns({c: F.round(c, 4) for c in ("wave_a", "wave_b", "abs_delta", "drift")})


def node_distances(spark, sf_dir):
    n = nodes(spark, sf_dir)
    b = n.select(F.col("node").alias("b"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    pairs = n.join(b, F.col("node") < F.col("b"))
    return pairs.select("node", "b", F.round(S.haversine_km(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")), 6).alias("km"))


def geodesic_distances(spark, sf_dir):
    n = nodes(spark, sf_dir)
    b = n.select(F.col("node").alias("b"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    return n.join(b, F.col("node") < F.col("b")).select("node", "b", F.round(geodesic_km("lon", "lat", "lon2", "lat2"), 6).alias("km"))


def poisson_tail(spark, sf_dir):
    grid = spark.range(0, 60).select(F.col("id").cast("int").alias("obs")).crossJoin(spark.range(1, 40).select((F.col("id") * 0.75).alias("lam")))  # 60 by 39 arguments
    return grid.select("obs", "lam", F.round(S.poisson_upper_tail(F.col("obs"), F.col("lam")), 9).alias("p"))


def _node_sets(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").cast("bigint").alias("node"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 7000").select(F.col("s_nationkey").cast("bigint").alias("node"))
    return c, s


def set_ops_nodes(spark, sf_dir):
    c, s = _node_sets(spark, sf_dir)
    tag = lambda df, name: df.select(F.lit(name).alias("op"), "node")
    return tag(c.union(s).distinct(), "union").unionByName(tag(c.intersect(s), "intersect")).unionByName(tag(c.distinct().exceptAll(s.distinct()), "except")).unionByName(tag(c.unionAll(s), "union_all"))


def manifest_diff(spark, sf_dir):
    c, s = _node_sets(spark, sf_dir)
    name = lambda df: df.select(F.format_string("node_%02d.csv", "node").alias("name"))
    return D.manifest_difference(name(c), name(s))


def set_equality(spark, sf_dir):
    c, s = _node_sets(spark, sf_dir)
    return D.same_set(c, s).select(F.lit("customer=supplier").alias("pair"), "same").unionByName(D.same_set(c, c.union(c)).select(F.lit("customer=twice").alias("pair"), "same"))


def quality_checks(spark, sf_dir):
    hot = hot_days(spark, sf_dir)
    checks = {
        "flags are 0 or 1": F.col("evt_run").isin(0, 1), "a run flag is an event": F.col("evt_run") <= F.col("evt"), "values are positive": F.col("value") > 0,
        "thresholds are present": F.col("thr").isNotNull(), "raw is not above smoothed": D.ordered([F.col("thr_raw"), F.col("thr")]),
    }
    return D.check_all(D.require_columns(hot, ["node", "day", "evt_run"]), checks).unionByName(D.row_count(nodes(spark, sf_dir), 25, "25 nations"))


def reference_comparison(spark, sf_dir):
    """Both run modes' yearly counts against each other."""
    from .event_queries import run_flags_calendar, run_flags_row

    row, cal = (f(spark, sf_dir).groupBy("year").agg(F.sum("run_events").alias("run_events"), F.sum("events").alias("events")) for f in (run_flags_row, run_flags_calendar))
    return D.difference(row, cal, ["year"], ["events", "run_events"])


def override_rows(spark, sf_dir):
    o = orders_by_year(spark, sf_dir)
    fixed = o.where("status = 'F' and year % 2 = 0").select("status", "year", (F.col("n") * 10).alias("n"))
    return V.override(o, fixed, ["status", "year"], ["n"]).select("status", "year", "n")


def full_index_add(spark, sf_dir):
    """Two sparse series added over a dense calendar, absent years as 0."""
    o = orders_by_year(spark, sf_dir)
    both = o.where("status = 'F' and year % 2 = 0").select("year", "n").unionByName(o.where("status = 'O' and year % 3 = 0").select("year", "n"))
    summed = both.groupBy("year").agg(F.sum("n").alias("n"))
    calendar = spark.range(1990, 2006).select(F.col("id").cast("int").alias("year"))
    return calendar.join(summed, "year", "left").select("year", F.coalesce("n", F.lit(0)).cast("double").alias("n"))


def event_date_span(spark, sf_dir):
    """First and last event day over the hot and the cold table."""
    span = lambda d: d.where("evt_run = 1").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    both = span(hot_days(spark, sf_dir)).unionByName(span(cold_days(spark, sf_dir)))
    return both.agg(S.day_text(F.min("lo")).alias("first_day"), S.day_text(F.max("hi")).alias("last_day"))


def batch_daily_minima(spark, sf_dir):
    got = streaming_minima(table(spark, sf_dir, "events").select("ts", F.col("user_id").alias("node"), "value"))
    return got.select("node", S.day_text(F.col("day")).alias("day"), "min_value", "n")


def _scenario_sql(hot: str = "ev", cold: str = "ev") -> tuple[str, ...]:
    """CTEs up to `den`: scenario, cluster, year, n."""
    parts = [
        SIDES, "bp as (select node, year, urban_frac > 0.9 as on_ from panel)", f"core as (select node from bp where on_ group by node having count(distinct year) = {N_YEARS})",
        "allsd as (select false as core, * from sd union all select true, * from sd where node in (select node from core))",
        "sz as (select core, cluster, side, count(distinct node) as size from allsd group by all)",
        "ua as (select core, cluster, side, year, count(*) as urban from allsd join bp using (node) where on_ group by all)",
        f"dc as (select core, cluster, side, day, year, count(*) as act, sum(evt_run) as evt from (select core, cluster, side, e.day, e.year, e.evt_run from allsd join {hot} e using (node) where side = 'side_a' union all select core, cluster, side, e.day, e.year, e.evt_run from allsd join {cold} e using (node) where side = 'side_b') group by all)",
        "sc as (select * from (values " + ", ".join(f"('{s.name}', '{s.denominator}', {s.coverage}, {str(s.core).lower()})" for s in V.SCENARIOS) + ") t(scenario, mode, coverage, core))",
        "ps as (select scenario, cluster, side, day, year, evt::double / nullif(case mode when 'fixed' then size when 'active' then act else coalesce(urban, 0) end, 0) as signal, case when mode = 'annual_urban_active' then coalesce(urban, 0) else act end::double / greatest(size, 1) as covered, coverage from dc join sz using (core, cluster, side) left join ua using (core, cluster, side, year) join sc using (core))",
        f"ok as (select * from ps where covered >= coverage and signal > {THRESHOLD})",
        "den as (select x.scenario, x.cluster, x.year, count(*) as n from ok x join ok y on x.scenario = y.scenario and x.cluster = y.cluster and x.day = y.day where x.side = 'side_a' and y.side = 'side_b' group by 1, 2, 3)",
    ]
    return tuple(parts)


def _sens(src: str, key: str) -> str:
    """CTEs up to `ts`: key, slope, intercept, low95, high95 of src (key, x, y)."""
    z = T.Z95
    return f"""sl as (select a.{key}, (b.y - a.y) / (b.x - a.x) as s from {src} a join {src} b on a.{key} = b.{key} and a.x < b.x),
sa as (select {key}, median(s) as slope, list_sort(list(s)) as l, count(*) as k from sl group by 1),
ti as (select {key}, sum(t * (t - 1) * (2 * t + 5))::double as ty from (select {key}, y, count(*) as t from {src} group by 1, 2) group by 1),
md as (select {key}, median(x) as mx, median(y) as my, count(*)::double as n from {src} group by 1),
ts as (select {key}, slope, my - slope * mx as intercept,
              l[greatest(round((k - {z} * sqrt((n * (n - 1) * (2 * n + 5) - ty) / 18)) / 2)::int - 1, 0) + 1] as low95,
              l[least(round((k + {z} * sqrt((n * (n - 1) * (2 * n + 5) - ty) / 18)) / 2)::int, k - 1) + 1] as high95
       from sa join ti using ({key}) join md using ({key}))"""


@cache
def oracles() -> dict[str, str]:
    hot = (Q.ND, Q.events())
    cold = Q.events("cd", "cold")
    series = "se as (select o_orderstatus as status, year(o_orderdate)::double as x, count(*)::double as y from orders group by 1, 2)"
    tau = """pa as (select a.status, sum(sign(b.y - a.y))::bigint as score from se a join se b on a.status = b.status and a.x < b.x group by 1),
tt as (select status, sum(t * (t - 1) / 2)::double as ty from (select status, y, count(*) as t from se group by 1, 2) group by 1),
nn as (select status, count(*) as n from se group by 1)"""
    deltas = "dl as (select node, floor((avg(value) filter (where year % 2 = 1) - avg(value) filter (where year % 2 = 0)) / 500) as delta from nd group by 1)"
    wz = Q.signed_ranks("dl", "wx")
    sur = f"""ps as (select node, year, day, evt_run as evt, row_number() over (partition by node, year order by day) - 1 as pos, count(*) over (partition by node, year) as n, sum(evt_run) over (partition by node, year) as k from ev),
dr as (select d as draw, e.node, e.year, e.n, (e.pos + (e.node * 31 + d * 17 + e.year) % e.n) % e.n as np from ps e cross join range(0, {DRAWS}) t(d) where e.evt = 1 and e.k > 0),
sh as (select draw, dr.node, ps.day from dr join ps on ps.node = dr.node and ps.year = dr.year and ps.pos = np),
sz as (select cluster, side, count(*) as size from sd group by 1, 2),
ab as (select draw, cluster, side, day from sh join sd using (node) join sz using (cluster, side) group by draw, cluster, side, day having count(*)::double / max(size) > 0.1),
st as (select draw, cluster, year(day)::int as year, count(*) as n from (select draw, cluster, day from ab group by 1, 2, 3 having count(*) = 2) group by 1, 2, 3)"""
    signal = "sg as (select cluster, side, day, count(*)::double / max(size) as signal from (select * from ev where evt_run = 1) x join sd using (node) join (select cluster, side, count(*) as size from sd group by 1, 2) z using (cluster, side) group by 1, 2, 3)"
    sync = "sy as (select x.cluster, x.day from sg x join sg y on x.cluster = y.cluster and x.day = y.day and x.side = 'side_a' and y.side = 'side_b' where x.signal > 0.1 and y.signal > 0.1)"
    em = """em as (select label, vec_id, unnest(embedding)::double * 1000 as v, unnest(range(64))::int as i from embeddings),
an as (select label, vec_id, i, v - avg(v) over (partition by vec_id) as v from em)"""
    co = "co as (select label, i, avg(v) as v, count(*) as n from an group by 1, 2)"
    two_pi = repr(2 * math.pi / 64)

    def band(low: int, high: int, out: str) -> str:
        return f"""{out}_s as (select label, k, sum(v * cos({two_pi} * ((k * i) % 64))) as re, sum(v * sin({two_pi} * ((k * i) % 64))) as im from co, range({low}, {high + 1}) t(k) group by 1, 2),
{out} as (select label, j::int as i, sum(2.0 / 64 * (re * cos({two_pi} * ((k * j) % 64)) + im * sin({two_pi} * ((k * j) % 64)))) as wave from {out}_s, range(64) t(j) group by 1, 2)"""

    halves = "ea as (select label, i, avg(v) as x from an where vec_id % 2 = 0 group by 1, 2), la as (select label, i, avg(v) as y from an where vec_id % 2 = 1 group by 1, 2)"
    lag = "lg as (select ea.label, s::int as shift, corr(x, y) as corr from ea, range(-20, 21) t(s), la where la.label = ea.label and la.i = (((ea.i - s) % 64) + 64) % 64 group by 1, 2)"
    nearest = "(select w.i from w where w.label = c.label order by abs(w.i * 360.0 / 64 - ((({0}) % 360) + 360) % 360), w.i limit 1)"
    diag = []
    for low, high in S.parse_bands("3-8,4-8"):
        lon = [nearest.format(f"(c.label * {k}) % 360 - 180").replace("w.", "x.").replace("from w", f"from b{low} x") for k in (37, 101)]
        diag.append(f"select label, '{low}-{high}' as band, (select wave from b{low} y where y.label = c.label and y.i = {lon[0]}) as wa, (select wave from b{low} y where y.label = c.label and y.i = {lon[1]}) as wb from (select distinct label from co) c")
    diagnostics = "dg as (" + " union all ".join(diag) + ")"
    heights = """ht as (
    select vec_id, date '2000-06-01' + (vec_id // 6 % 150)::int as date, case when vec_id % 2 = 0 then 500 else 850 end as level,
           30.0 + 10 * (vec_id // 2 % 3) as lat, embedding from embeddings),
bd as (select * from (values ('C1', -100.0, 10.0, 45.0, 40.0), ('D1', 110.0, -90.0, 32.0, 30.0)) t(bundle, lon_a, lon_b, target_lat, glat)),
dt as (select distinct case when dayofyear(date) % 2 = 0 then 'C1' else 'D1' end as bundle, date from ht),
wn as (select bundle, date, s::int as s, date + s::int as want from dt, (select unnest([0, -3, 3]) as s)),
hd as (select distinct bundle, date as h from ht join bd on lat = glat and level = 500),
pk as (select * from (
    select wn.*, h, row_number() over (partition by wn.bundle, wn.date, s order by abs(h - want), h) as k
    from wn join hd on hd.bundle = wn.bundle and year(h) = year(wn.date) and abs(h - want) <= 31) where k = 1),
em as (
    select pk.bundle, pk.date, s, vec_id, (unnest(embedding) * 1000::float)::double as v, unnest(range(64))::int as i
    from pk join bd using (bundle) join ht on ht.date = h and level = 500 and lat = glat),
an as (select bundle, s, i, v - avg(v) over (partition by bundle, date, s, vec_id) as v from em),
co as (select bundle || ':' || s as label, i, avg(v) as v, count(*) as n from an group by 1, 2)"""
    place = "(select i from (select unnest(range(64)) as i) order by abs(i * 360.0 / 64 - ((({}) % 360) + 360) % 360), i limit 1)"
    moved = "dr as (select bd.bundle, s::int as shift, corr(x.wave, y.wave) as corr from bd, range(-20, 21) t(s), b x, b y where x.label = bd.bundle || ':-3' and y.label = bd.bundle || ':3' and y.i = (((x.i - s) % 64) + 64) % 64 group by 1, 2)"
    values_ = f"va as (select bd.*, (select wave from b where label = bd.bundle || ':0' and i = {place.format('bd.lon_a')}) as wa, (select wave from b where label = bd.bundle || ':0' and i = {place.format('bd.lon_b')}) as wb from bd)"
    cells = """px as (select lon + (c_custkey % 5) * 0.0625 - 0.1 as lon, lat + (c_custkey % 3) * 0.0625 - 0.05 as lat, abs(c_acctbal) as population from customer join nodes on node = c_nationkey),
gr as (select floor(lon / 0.25 + 0.5) as cx, floor(lat / 0.25 + 0.5) as cy, sum(population) as population from px group by 1, 2),
fp as (select distinct cluster, side as footprint, node from sd union select distinct cluster, 'bundle_union', node from sd),
po as (select cluster, footprint, coalesce(sum(population), 0) as population from (select distinct cluster, footprint, floor(lon / 0.25 + 0.5) as cx, floor(lat / 0.25 + 0.5) as cy from fp join nodes using (node)) left join gr using (cx, cy) group by 1, 2)"""
    h = Q.haversine
    corridors = """cr as (select case when x.node % 3 = 0 then 'Primary' when x.node % 3 = 1 then 'K=1' else 'D=3' end as setting,
    case when x.node % 2 = 0 then 'Coherent' else 'Dipole' end as layer, x.node::int as rank, x.lon as a_lon, x.lat as a_lat, y.lon as b_lon, y.lat as b_lat
    from nodes x join nodes y on y.node = x.node + 7)"""
    straight = f"(({h('c.a_lon', 'c.a_lat', 'r.a_lon', 'r.a_lat')}) + ({h('c.b_lon', 'c.b_lat', 'r.b_lon', 'r.b_lat')})) / 2"
    crossed = f"(({h('c.a_lon', 'c.a_lat', 'r.b_lon', 'r.b_lat')}) + ({h('c.b_lon', 'c.b_lat', 'r.a_lon', 'r.a_lat')})) / 2"
    closest = f"""np as (select * from (select *, row_number() over (partition by setting, layer, rank order by km nulls last, ref) as k from (
    select c.*, r.rank as ref, case when c.layer = 'Coherent' then least({straight}, {crossed}) else {straight} end as km
    from cr c left join cr r on r.layer = c.layer and r.setting = 'Primary')) where k = 1)"""
    region = lambda x, y, a="NorthAmerica", b="EastAsia": f"case when {y} > 20 and {x} > -130 and {x} < -60 then '{a}' when {y} > 20 and {x} > 60 and {x} < 150 then '{b}' when {y} > 30 and {x} > -10 and {x} < 40 then 'Europe' else '(' || {x}::bigint || ',' || {y}::bigint || ')' end"
    sets = "c as (select c_nationkey::bigint as node from customer where c_acctbal > 9900), s as (select s_nationkey::bigint as node from supplier where s_acctbal > 7000)"
    rh = "greatest(0.0, least(100.0, 100 * exp(17.625 * td / (243.04 + td)) / exp(17.625 * t / (243.04 + t))))"
    tail = "case when obs <= 0 then 1.0 else greatest(0.0, 1 - list_sum(list_transform(range(0, obs), lambda i: exp(i * ln(lam) - lam - lgamma(i + 1))))) end"
    by_year = "yr as (select year, sum(evt)::bigint as events, sum(evt_run)::bigint as a, sum(by_day)::bigint as b from cal group by year)"
    panel_sql = (Q.ND, Q.events(), PANEL)
    return {
        "theil_sen": Q.query(series, _sens("se", "status"), select="select status, round(slope, 6) as slope, round(intercept, 6) as intercept, round(low95, 6) as low95, round(high95, 6) as high95 from ts"),
        "kendall_tau": Q.query(series, tau, select="select status, n, score, round(score / sqrt((n * (n - 1) / 2) * (n * (n - 1) / 2 - ty)), 8) as tau from pa join tt using (status) join nn using (status)"),
        "wilcoxon_z": Q.query(Q.ND, deltas, wz, select="select n, w_plus, round(z, 8) as z from wx"),
        "wilcoxon_p": Q.query(Q.ND, deltas, wz, select=f"select n, round({Q.upper_tail('z')}, 8) as p_greater, round(case when z is not null then least(1.0, 2 * {Q.upper_tail('abs(z)')}) end, 8) as p_two_sided from wx"),
        "stable_core": Q.query(PANEL, select=f"select node from panel where urban_frac > 0.9 group by node having count(distinct year) = {N_YEARS}"),
        "denominator_scenarios": Q.query(*panel_sql, *_scenario_sql(), select="select * from den"),
        "denominator_scenarios_dipole": Q.query(*panel_sql, cold, *_scenario_sql("ev", "cd"), select="select * from den"),
        "scenario_bundles": Q.query(*panel_sql, *_scenario_sql(), "dd as (select x.scenario, x.cluster, x.day, x.covered as fa, y.covered as fb from ok x join ok y on x.scenario = y.scenario and x.cluster = y.cluster and x.day = y.day where x.side = 'side_a' and y.side = 'side_b')", "nn as (select cluster, count(*) filter (where side = 'side_a') as nodes_a, count(*) filter (where side = 'side_b') as nodes_b from sd group by 1)", select="select s.scenario, nn.cluster, nodes_a, nodes_b, count(d.day) as date_count, coalesce(strftime(min(d.day), '%Y-%m-%d'), '') as first_date, coalesce(strftime(max(d.day), '%Y-%m-%d'), '') as last_date, round(median(fa), 8) as median_fraction_a, round(median(fb), 8) as median_fraction_b from sc s cross join nn left join dd d on d.scenario = s.scenario and d.cluster = nn.cluster group by 1, 2, 3, 4"),
        "scenario_trends": Q.query(*panel_sql, *_scenario_sql(), f"se as (select t.scenario, y::double as x, coalesce(sum(n), 0)::double as y from (select scenario, y from sc, range({YEARS[0]}, {YEARS[1] + 1}) q(y)) t left join den on den.scenario = t.scenario and den.year = t.y group by t.scenario, t.y)", _sens("se", "scenario"), select="select scenario, round(slope, 6) as slope, round(intercept, 6) as intercept from ts"),
        "circular_surrogates": Q.query(*hot, SIDES, sur, select="select draw::int as draw, cluster, year, n from st"),
        "surrogate_summary": Q.query(*hot, SIDES, sur, signal, sync, "ob as (select cluster, count(*)::double as observed from sy group by 1)", f"gr as (select cluster, d as draw from (select distinct cluster from sd) cross join range(0, {DRAWS}) t(d))", "vs as (select draw, cluster, sum(n)::double as value from st group by 1, 2)", "dw as (select gr.draw, gr.cluster, coalesce(vs.value, 0) as value, coalesce(ob.observed, 0) as observed from gr left join vs on vs.draw = gr.draw and vs.cluster = gr.cluster left join ob on ob.cluster = gr.cluster)", select="select cluster, max(observed) as observed, round(avg(value), 8) as surrogate_mean, round(quantile_cont(value, 0.95), 8) as surrogate_p95, round(quantile_cont(value, 0.99), 8) as surrogate_p99, round((count(*) filter (where value >= observed) + 1)::double / (count(*) + 1), 8) as empirical_p from dw group by cluster"),
        "composite_anomaly": Q.query(em, co, select="select label, n, i, round(v, 6) as v from co"),
        "bandpass_dft": Q.query(em, co, band(4, 8, "b"), select="select label, i, round(wave, 6) as wave from b"),
        "bandpass_fft": Q.query(em, co, band(4, 8, "b"), select="select label, i, round(wave, 6) as wave from b"),
        "lag_correlation": Q.query(em, halves, lag, select="select label, shift, round(corr, 8) as corr from lg"),
        "lag_correlation_drift": Q.query(em, halves, lag, select="select label, best_shift, round(-best_shift / 6.0, 8) as drift from (select label, arg_max(shift, corr) as best_shift from lg group by 1)"),
        "wave_diagnostics": Q.query(em, co, band(3, 8, "b3"), band(4, 8, "b4"), diagnostics, select="select label, band, round(wa, 6) as wave_a, round(wb, 6) as wave_b, round(abs(wa - wb), 6) as abs_delta, sign(wa) = sign(wb) and wa <> 0 as same_sign, case when abs(wa - wb) < 45 then 'coherent-like' else 'dipole-like' end as class from dg"),
        "nearest_days": "with o as (select o_orderdate::date as date, max(o_totalprice) as z from orders group by 1), p as (select d.date, h.z, row_number() over (partition by d.date order by abs(h.date - (d.date - 3)), h.date) as place from o d join o h on year(h.date) = year(d.date)) select strftime(date, '%Y-%m-%d') as day, z from p where place = 1",
        "footprint_sizes": Q.query(SIDES, "fp as (select cluster, side as footprint, node from sd union all select distinct cluster, 'bundle_union', node from sd)", select="select cluster, footprint, count(*) as node_count, count(*) as side_sum from fp group by 1, 2"),
        "exposure_person_nights": Q.query(*hot, Q.NODES, SIDES, signal, sync, cells, select="select cluster, footprint, round(population, 4) as population, coalesce(n, 0) as event_nights, round(population * coalesce(n, 0), 2) as person_nights from po left join (select cluster, count(*) as n from sy group by 1) using (cluster)"),
        "annual_person_nights": Q.query(*hot, Q.NODES, SIDES, signal, sync, cells, select="select cluster, year(day)::int as year, count(*) as event_nights, round(max(population) * count(*), 2) as person_nights from sy join po using (cluster) where footprint = 'bundle_union' group by 1, 2"),
        "nearest_primary": Q.query(Q.NODES, corridors, closest, select="select setting, layer, rank, ref as closest_primary_rank, round(km, 5) as closest_primary_km, coalesce(km <= 1500, false) as within_1500km, coalesce(km <= 2500, false) as within_2500km from np"),
        "geography_summary": Q.query(Q.NODES, corridors, closest, select=f"select setting, layer, count(*) as bundles, count(*) filter (where km <= 1500) as within_1500km, count(*) filter (where km <= 2500) as within_2500km, round(median(km), 5) as median_km, string_agg({region('a_lon', 'a_lat')} || ' - ' || {region('b_lon', 'b_lat')}, '; ' order by rank) as corridors from np group by 1, 2"),
        "humidity_wetbulb": f"with e as (select event_id, value % 40 as t, value % 40 - value % 7 as td from events), r as (select *, {rh} as rh from e) select event_id, round(rh, 6) as rh, round(t * atan(0.151977 * sqrt(rh + 8.313659)) + atan(t + rh) - atan(rh - 1.676331) + 0.00391838 * pow(rh, 1.5) * atan(0.023101 * rh) - 4.686035, 6) as tw from r",
        "region_case": Q.query(Q.NODES, select=f"select node, {region('lon', 'lat')} as region, replace({region('lon', 'lat', 'N.America', 'E.Asia')}, ' ', '') || '_to_x' as safe, (lon % 360 + 360) % 360 as lon360 from nodes"),
        "cell_bounds": Q.query(Q.NODES, select="select node, greatest(lon - 0.125, -180.0) as west, least(lon + 0.125, 180.0) as east, greatest(lat - 0.125, -90.0) as south, least(lat + 0.125, 90.0) as north from nodes"),
        "tag_names": "select unnest(['Primary', 'D=1', 'K=5', 'p<0.01']) as setting, 'tau015_local_warm3' as tag",
        "bundle_labels": "select mechanism, rank, label as bundle, regexp_replace(label, ' ', chr(10)) as axis, 'plt0p01' as slug from (values ('Coherent', 1, 'C1 North America-Europe'), ('Coherent', 2, 'C2 North America-East Asia'), ('Coherent', 3, 'C3 Europe-East Asia'), ('Coherent', 4, 'Coherent 4'), ('Dipole', 1, 'D1 East Asia-North America'), ('Dipole', 2, 'D2 West/Central Asia-East Asia'), ('Dipole', 3, 'D3 North Atlantic-North America'), ('Dipole', 4, 'Dipole 4')) t(mechanism, rank, label)",
        "nearest_year": "with y as (select distinct year(o_orderdate)::int as year from orders where year(o_orderdate) % 2 = 0) select w::int as wanted, (select year from y order by abs(year - w), year limit 1) as nearest from (select unnest([1999, 1900, 1996]) as w)",
        "nearest_latitude": "select strftime(date '2000-06-01' + (vec_id // 6 % 150)::int, '%Y-%m-%d') as day, count(*) as n, round(sum(embedding[1]::double * 1000), 3) as z0 from embeddings where vec_id % 2 = 0 and (vec_id // 2) % 3 = 1 group by 1",
        "bundle_wave_diagnostics": Q.query(heights, band(4, 8, "b"), moved, values_, select="select va.bundle, (select max(n) from co where label = va.bundle || ':0') as n_windows, target_lat::double as target_lat, (((lon_a % 360) + 360) % 360)::double as lon_a, (((lon_b % 360) + 360) % 360)::double as lon_b, round(wa, 4) as wave_a, round(wb, 4) as wave_b, round(abs(wa - wb), 4) as abs_delta, sign(wa) = sign(wb) and wa <> 0 as same_sign, case when abs(wa - wb) < 45 then 'coherent-like' else 'dipole-like' end as class, round(-(select arg_max(shift, corr) from dr where dr.bundle = va.bundle) / 6.0, 4) as drift from va"),
        "node_distances": Q.query(Q.NODES, select=f"select x.node, y.node as b, round({h('x.lon', 'x.lat', 'y.lon', 'y.lat')}, 6) as km from nodes x join nodes y on x.node < y.node"),
        "geodesic_distances": Q.query(Q.NODES, "pq as (select x.node as a, y.node as b, x.lon as lon1, x.lat as lat1, y.lon as lon2, y.lat as lat2 from nodes x join nodes y on x.node < y.node)", Q.geodesic("pq", "gd"), select="select a as node, b, round(km, 6) as km from gd"),
        "poisson_tail": f"with g as (select o::int as obs, (l * 0.75)::double as lam from range(0, 60) a(o), range(1, 40) b(l)) select obs, lam, round({tail}, 9) as p from g",
        "set_ops_nodes": f"with {sets} select 'union' as op, node from (select node from c union select node from s) union all select 'intersect', node from (select node from c intersect select node from s) union all select 'except', node from (select node from c except select node from s) union all select 'union_all', node from (select node from c union all select node from s)",
        "manifest_diff": f"with {sets} select printf('node_%02d.csv', node) as name, 'missing' as status from (select node from c except select node from s) union all select printf('node_%02d.csv', node), 'unlisted' from (select node from s except select node from c)",
        "set_equality": f"with {sets} select 'customer=supplier' as pair, not exists (select node from c except select node from s) and not exists (select node from s except select node from c) as same union all select 'customer=twice', true",
        "quality_checks": Q.query(*hot, "f as (select 'flags are 0 or 1' as \"check\", count(*) filter (where evt_run not in (0, 1)) as failures from ev union all select 'a run flag is an event', count(*) filter (where not evt_run <= evt) from ev union all select 'values are positive', count(*) filter (where not value > 0) from ev union all select 'thresholds are present', count(*) filter (where thr is null) from ev union all select 'raw is not above smoothed', count(*) filter (where not coalesce(thr_raw <= thr, false)) from ev union all select '25 nations', abs(count(*) - 25) from nation)", select='select "check", failures = 0 as ok, failures from f'),
        "reference_comparison": Q.query(*hot, Q.calendar_runs("ev", "cal", 2), by_year, select="select 'events' as \"column\", count(*) as \"rows\", 0::bigint as mismatches, 0.0::double as max_abs_diff from yr union all select 'run_events', count(*), count(*) filter (where a <> b), max(abs(a - b))::double from yr"),
        "override_rows": "select status, year, (n * case when status = 'F' and year % 2 = 0 then 10 else 1 end)::bigint as n from (select o_orderstatus as status, year(o_orderdate)::int as year, count(*) as n from orders group by 1, 2)",
        "full_index_add": "with o as (select o_orderstatus as s, year(o_orderdate) as y, count(*) as n from orders group by 1, 2) select t.y::int as year, coalesce(sum(n), 0)::double as n from range(1990, 2006) t(y) left join o on o.y = t.y and ((s = 'F' and o.y % 2 = 0) or (s = 'O' and o.y % 3 = 0)) group by t.y",
        "event_date_span": Q.query(*hot, cold, select="select strftime(min(day), '%Y-%m-%d') as first_day, strftime(max(day), '%Y-%m-%d') as last_day from (select day from ev where evt_run = 1 union all select day from cd where evt_run = 1)"),
        "batch_daily_minima": "select user_id as node, strftime(ts, '%Y-%m-%d') as day, min(value) as min_value, count(*) as n from events where hour(ts) between 0 and 6 group by 1, 2",
    }


QUERIES = {f.__name__: f for f in (
    theil_sen, kendall_tau, trend_summary, wilcoxon_z, wilcoxon_p, stable_core, denominator_scenarios, denominator_scenarios_dipole, scenario_bundles, scenario_trends,
    circular_surrogates, hashed_surrogates, surrogate_summary, surrogate_layers, composite_anomaly, bandpass_dft, bandpass_fft, lag_correlation, lag_correlation_drift,
    wave_diagnostics, nearest_days, footprint_sizes, exposure_person_nights, annual_person_nights, nearest_primary, geography_summary, humidity_wetbulb,
    region_case, bundle_labels, nearest_year, nearest_latitude, bundle_wave_diagnostics, cell_bounds, tag_names, node_distances, geodesic_distances, poisson_tail, set_ops_nodes, manifest_diff, set_equality, quality_checks,
    reference_comparison, override_rows, full_index_add, event_date_span, batch_daily_minima,
)}
