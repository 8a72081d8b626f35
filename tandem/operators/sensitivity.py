"""Sweeps over settings: denominators of daily signals, network parameters and the geography of bundles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S


@dataclass(frozen=True)
class Scenario:
    name: str
    denominator: str
    coverage: float = 0.0
    core: bool = False


#: The nine denominator scenarios.
SCENARIOS = (
    Scenario("fixed_denominator_recomputed", "fixed"),
    Scenario("annual_urban_active_denominator", "annual_urban_active"),
    Scenario("annual_urban_active_denominator_min50pct_coverage", "annual_urban_active", 0.5),
    Scenario("annual_urban_active_denominator_min80pct_coverage", "annual_urban_active", 0.8),
    Scenario("active_denominator_any_coverage", "active"),
    Scenario("active_denominator_min50pct_coverage", "active", 0.5),
    Scenario("active_denominator_min80pct_coverage", "active", 0.8),
    Scenario("stable_urban_core_fixed_denominator", "fixed", core=True),
    Scenario("stable_urban_core_active_denominator", "active", core=True),
)


def stable_core(panel: DataFrame, n_years: int) -> DataFrame:
    """(node) active in every one of n_years distinct years. panel: node, year, active_y."""
    return panel.where("active_y = 1").groupBy("node").agg(F.count_distinct("year").alias("years")).where(F.col("years") == n_years).select("node")


def daily_counts(events: DataFrame, sides: DataFrame, flag: str = "evt_run") -> DataFrame:
    """(cluster, side, day, year, active_count, event_count): rows and events of a side's nodes on a day."""
    return events.join(sides, "node").groupBy("cluster", "side", "day", "year").agg(F.count(F.lit(1)).alias("active_count"), F.sum(flag).alias("event_count"))


def annual_active(panel: DataFrame, sides: DataFrame) -> DataFrame:
    """(cluster, side, year, urban_active): a side's active nodes in a year."""
    return panel.where("active_y = 1").join(sides, "node").groupBy("cluster", "side", "year").agg(F.count(F.lit(1)).alias("urban_active"))


def _passing(counts: DataFrame, sizes: DataFrame, yearly: DataFrame, threshold: float, scenarios: tuple[Scenario, ...]) -> DataFrame:
    joined = counts.join(sizes, ["cluster", "side"]).join(yearly, ["cluster", "side", "year"], "left")
    urban = F.coalesce(F.col("urban_active"), F.lit(0))
    table = F.array(*[F.struct(F.lit(s.name).alias("scenario"), F.lit(s.denominator).alias("mode"), F.lit(s.coverage).alias("coverage")) for s in scenarios])
    each = joined.withColumn("s", F.explode(table)).select("*", "s.*").drop("s")
    denominator = F.when(F.col("mode") == "fixed", F.col("size")).when(F.col("mode") == "active", F.col("active_count")).otherwise(urban).cast("double")
    covered = F.when(F.col("mode") == "annual_urban_active", urban).otherwise(F.col("active_count")) / F.greatest(F.col("size"), F.lit(1))
    return each.withColumn("signal", S.safe_ratio(F.col("event_count"), denominator)).withColumn("fraction", covered).where((F.col("fraction") >= F.col("coverage")) & (F.col("signal") > threshold))


def denominator_dates(events: DataFrame, sides: DataFrame, panel: DataFrame, n_years: int, threshold: float = 0.05, scenarios: tuple[Scenario, ...] = SCENARIOS, cold: DataFrame | None = None) -> DataFrame:
    """(scenario, cluster, day, year) of synchronised days, with both sides' signal and active fraction (_a, _b).

    Each node set (all nodes, stable core) is counted in one pass for all its scenarios. Days are grouped by day and year
    and sides joined on the day alone, so a day that two years hold counts for both.
    """
    out = None
    core = stable_core(panel, n_years)
    for is_core in (False, True):
        some = tuple(s for s in scenarios if s.core == is_core)
        if not some:
            continue
        own = sides.join(core, "node", "left_semi") if is_core else sides
        counts = daily_counts(events, own) if cold is None else daily_counts(events, own.where("side = 'side_a'")).unionByName(daily_counts(cold, own.where("side = 'side_b'")))
        sizes = own.groupBy("cluster", "side").agg(F.count_distinct("node").alias("size"))
        passing = _passing(counts, sizes, annual_active(panel, own), threshold, some)
        side = lambda x, *more: passing.where(F.col("side") == f"side_{x}").select("scenario", "cluster", "day", *more, F.col("signal").alias(f"signal_{x}"), F.col("fraction").alias(f"fraction_{x}"))  # noqa: B023, E731
        part = side("a", "year").join(side("b"), ["scenario", "cluster", "day"])
        out = part if out is None else out.unionByName(part)
    return out


def denominator_scenarios(events: DataFrame, sides: DataFrame, panel: DataFrame, n_years: int, threshold: float = 0.05, scenarios: tuple[Scenario, ...] = SCENARIOS, cold: DataFrame | None = None) -> DataFrame:
    """(scenario, cluster, year, n): synchronised days under each scenario."""
    dates = denominator_dates(events, sides, panel, n_years, threshold, scenarios, cold)
    return dates.groupBy("scenario", "cluster", "year").agg(F.count(F.lit(1)).alias("n"))


def scenario_bundles(dates: DataFrame, sides: DataFrame, scenarios: tuple[Scenario, ...] = SCENARIOS) -> DataFrame:
    """(scenario, cluster): nodes of both sides, dates, the first and last of them, and median active fractions on them.

    Every scenario has every bundle; without a date, counts are 0, texts empty and medians NULL.
    """
    names = F.explode(F.array(*[F.lit(s.name) for s in scenarios])).alias("scenario")
    nodes = sides.groupBy("cluster").agg(*[F.count_distinct(F.when(F.col("side") == f"side_{x}", F.col("node"))).alias(f"nodes_{x}") for x in "ab"]).select("*", names)
    got = dates.groupBy("scenario", "cluster").agg(
        F.count(F.lit(1)).alias("date_count"), S.day_text(F.min("day")).alias("first_date"), S.day_text(F.max("day")).alias("last_date"),
        F.median("fraction_a").alias("median_fraction_a"), F.median("fraction_b").alias("median_fraction_b"),
    )
    return nodes.join(got, ["scenario", "cluster"], "left").fillna({"date_count": 0, "first_date": "", "last_date": ""})


def against_primary(summary: DataFrame, by: list[str], setting: str = "setting", primary: str = "Primary", value: str = "n_edges") -> DataFrame:
    """summary with ratio_to_primary: the value over the primary setting's of the same group; NULL without one."""
    reference = F.max(F.when(F.col(setting) == primary, F.col(value))).over(Window.partitionBy(*by))
    return summary.withColumn("ratio_to_primary", S.safe_ratio(F.col(value), reference.cast("double")))


def centroid_distance(x: dict[str, Column], ref: dict[str, Column], swap: Column, distance=S.haversine_km) -> Column:
    """Mean distance of two pairs of centroids; where swap, the smaller of both pairings."""

    def mean(p: str, q: str) -> Column:
        return (distance(x["a_lon"], x["a_lat"], ref[f"{p}_lon"], ref[f"{p}_lat"]) + distance(x["b_lon"], x["b_lat"], ref[f"{q}_lon"], ref[f"{q}_lat"])) / 2

    return F.when(swap, F.least(mean("a", "b"), mean("b", "a"))).otherwise(mean("a", "b"))


def nearest_primary(rows: DataFrame, tolerances: tuple[float, ...] = (1500.0, 2500.0), distance=S.haversine_km) -> DataFrame:
    """rows with the closest primary bundle of their layer: its rank, distance and whether it is within each tolerance.

    rows: setting, layer, rank, a_lon, a_lat, b_lon, b_lat; sides may be swapped in the layer "Coherent". Each layer has a
    handful of primary bundles, so the join is an equi-join on the layer.
    """
    ends = ["a_lon", "a_lat", "b_lon", "b_lat"]
    reference = rows.where("setting = 'Primary'").select("layer", F.col("rank").alias("ref_rank"), *[F.col(c).alias(f"ref_{c}") for c in ends])
    pairs = rows.join(reference, "layer", "left").withColumn("km", centroid_distance({c: F.col(c) for c in ends}, {c: F.col(f"ref_{c}") for c in ends}, F.col("layer") == "Coherent", distance))
    nearest = F.row_number().over(Window.partitionBy("setting", "layer", "rank").orderBy(F.col("km").asc_nulls_last(), "ref_rank"))
    best = pairs.withColumn("_n", nearest).where("_n = 1")
    within = [F.coalesce(F.col("km") <= t, F.lit(False)).alias(f"within_{t:g}km") for t in tolerances]
    return best.select("setting", "layer", "rank", *ends, F.col("ref_rank").alias("closest_primary_rank"), F.col("km").alias("closest_primary_km"), *within)


def geography_summary(compared: DataFrame, label: Column) -> DataFrame:
    """(setting, layer): matches within each tolerance, median distance and the corridors in rank order."""
    rows = compared.withColumn("_label", label)
    within = [F.count_if(c).alias(c) for c in compared.columns if c.startswith("within_")]
    corridors = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "_label"))), lambda x: x["_label"]), "; ")
    return rows.groupBy("setting", "layer").agg(F.count(F.lit(1)).alias("bundles"), *within, F.median("closest_primary_km").alias("median_km"), corridors.alias("corridors"))


def override(rows: DataFrame, fixed: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """rows with columns taken from fixed where it has the key: an update from another table."""
    other = fixed.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = rows.join(other, keys, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])
