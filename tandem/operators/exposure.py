"""Footprints of bundles, zonal sums of a population table and person-nights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def footprints(sides: DataFrame, by: list[str] = ["cluster"]) -> DataFrame:  # noqa: B006
    """(by, footprint, node): each side, and "bundle_union", the distinct nodes of both. sides: by, side, node."""
    union = sides.select(*by, F.lit("bundle_union").alias("footprint"), "node")
    return sides.select(*by, F.col("side").alias("footprint"), "node").unionByName(union).distinct()


def footprint_sizes(marks: DataFrame, by: list[str] = ["cluster"]) -> DataFrame:  # noqa: B006
    """(by, footprint, node_count, side_sum): distinct nodes, and for the union the sum over sides."""
    counts = marks.groupBy(*by, "footprint").agg(F.count(F.lit(1)).alias("node_count"))
    sides = counts.where("footprint <> 'bundle_union'").groupBy(*by).agg(F.sum("node_count").alias("s"))
    return counts.join(sides, by).select(*by, "footprint", "node_count", F.when(F.col("footprint") == "bundle_union", F.col("s")).otherwise(F.col("node_count")).alias("side_sum"))


def snap(x: Column, cell: float = 0.25) -> Column:
    """The grid cell (an integer) whose centre is nearest: a point-in-cell test becomes an equi-join."""
    return F.floor(x / cell + 0.5).cast("bigint")


def zonal_sum(marks: DataFrame, nodes: DataFrame, pixels: DataFrame, by: list[str] = ["cluster"], cell: float = 0.25) -> DataFrame:  # noqa: B006
    """(by, footprint, population): pixels (lon, lat, population) within the cells of a footprint's nodes, each node once."""
    cells = marks.join(nodes, "node").select(*by, "footprint", snap(F.col("lon"), cell).alias("cx"), snap(F.col("lat"), cell).alias("cy")).distinct()
    grid = pixels.groupBy(snap(F.col("lon"), cell).alias("cx"), snap(F.col("lat"), cell).alias("cy")).agg(F.sum("population").alias("population"))
    got = cells.join(grid, ["cx", "cy"], "left").groupBy(*by, "footprint").agg(F.sum("population").alias("population"))
    return got.withColumn("population", F.coalesce("population", F.lit(0.0)))


def person_nights(population: DataFrame, dates: DataFrame, by: list[str] = ["cluster"]) -> DataFrame:  # noqa: B006
    """(by, footprint, population, event_nights, person_nights) over all years; bundles without dates have 0 nights."""
    nights = dates.groupBy(*by).agg(F.count(F.lit(1)).alias("event_nights"))
    joined = population.join(nights, by, "left").withColumn("event_nights", F.coalesce("event_nights", F.lit(0)))
    return joined.withColumn("person_nights", F.col("population") * F.col("event_nights"))


def annual_person_nights(population: DataFrame, dates: DataFrame, by: list[str] = ["cluster"]) -> DataFrame:  # noqa: B006
    """(by, year, event_nights, person_nights) of bundle unions, for years with dates only."""
    nights = dates.groupBy(*by, F.year("day").alias("year")).agg(F.count(F.lit(1)).alias("event_nights"))
    whole = population.where("footprint = 'bundle_union'").select(*by, "population")
    return nights.join(whole, by).select(*by, "year", "event_nights", (F.col("population") * F.col("event_nights")).alias("person_nights"))


def nearest_year(years: DataFrame, target: Column, key: str = "year") -> DataFrame:
    """(nearest): the available year closest to target; ties go to the earlier one."""
    return years.agg(F.min_by(key, F.struct(F.abs(F.col(key) - target), F.col(key))).alias("nearest"))
