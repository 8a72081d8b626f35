"""Circular-shift surrogates: each node-year's flags are rotated by a seeded offset, which keeps counts and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import stats as T


def hashed_shift(seed: int) -> Column:
    """A draw's offset for a node-year of n days, by a seeded hash: any task can recompute it."""
    return F.pmod(F.xxhash64(F.lit(seed), "draw", "node", "year"), F.col("n"))


def positions(events: DataFrame, flag: str = "evt_run") -> DataFrame:
    """(node, year, day, evt, pos, n) of node-years with an event: a row's place within its year, and the year's rows."""
    year = Window.partitionBy("node", "year")
    pos = F.row_number().over(year.orderBy("day")) - 1
    rows = events.select("node", "year", "day", F.col(flag).alias("evt")).withColumn("pos", pos).withColumn("n", F.count(F.lit(1)).over(year))
    return rows.withColumn("_any", F.sum("evt").over(year)).where("_any > 0").drop("_any")


def shifted_days(placed: DataFrame, draws: int, shift: Column) -> DataFrame:
    """(draw, node, day): event days of each draw. Only events are multiplied by draws, then looked up by place.

    The array of a node-year's days is the lookup, so a draw costs no join on places.
    """
    days = placed.groupBy("node", "year").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "day"))).alias("days"), F.collect_list(F.when(F.col("evt") == 1, F.col("pos"))).alias("events"))
    drawn = days.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("shift", shift)
    moved = drawn.select("draw", "node", F.explode(F.transform("events", lambda p: F.element_at("days", (F.pmod(p + F.col("shift"), F.col("n")) + 1).cast("int"))["day"])).alias("day"))
    return moved


def synchronized_totals(days: DataFrame, sides: DataFrame, threshold: float, by: list[str] = ["cluster"]) -> DataFrame:  # noqa: B006
    """(draw, by, year, n): synchronised days of each draw per year."""
    size = sides.groupBy(*by, "side").agg(F.count_distinct("node").alias("size"))
    daily = days.join(sides, "node").groupBy("draw", *by, "side", "day").agg(F.count(F.lit(1)).alias("k")).join(size, [*by, "side"])
    both = daily.where(F.col("k") / F.col("size") > threshold).groupBy("draw", *by, "day").agg(F.count(F.lit(1)).alias("above")).where("above = 2")
    return both.groupBy("draw", *by, F.year("day").alias("year")).agg(F.count(F.lit(1)).alias("n"))


def empirical_p(observed: Column, draws: Column) -> Column:
    """(draws at least as large as observed + 1) / (draws + 1), as an aggregate."""
    return (F.count_if(draws >= observed) + 1) / (F.count(draws) + 1)


def dense_totals(totals: DataFrame, keys: DataFrame, draws: int, by: list[str], value: str = "value") -> DataFrame:
    """(draw, by, value): one row for every draw and each of keys (by), 0 where totals (draw, by, n) has none."""
    grid = keys.select(*by).distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    summed = totals.groupBy("draw", *by).agg(F.sum("n").cast("double").alias(value))
    return grid.join(summed, ["draw", *by], "left").select("draw", *by, F.coalesce(value, F.lit(0.0)).alias(value))


def surrogate_summary(draws: DataFrame, observed: DataFrame, by: list[str]) -> DataFrame:
    """observed, surrogate mean, 95th and 99th percentile and empirical p. draws: by, value; observed: by, observed.

    draws has a row for every draw, those without a synchronised day as 0 (dense_totals); absent observed rows count as 0.
    """
    got = draws.join(observed, by, "left").withColumn("observed", F.coalesce("observed", F.lit(0.0))).groupBy(*by).agg(
        F.max("observed").alias("observed"), F.avg("value").alias("surrogate_mean"), F.percentile("value", 0.95).alias("surrogate_p95"),
        F.percentile("value", 0.99).alias("surrogate_p99"), empirical_p(F.col("observed"), F.col("value")).alias("empirical_p"),
    )
    return got


def _yearly(totals: DataFrame, grid: DataFrame, keys: list[str], years: tuple[int, int]) -> DataFrame:
    """(keys, x, y): yearly counts of totals (keys, year, n) on every year of each row of grid, 0 where there is none."""
    dense = grid.withColumn("year", F.explode(F.sequence(F.lit(years[0]), F.lit(years[1]))))
    counts = totals.groupBy(*keys, "year").agg(F.sum("n").alias("n"))
    return dense.join(counts, [*keys, "year"], "left").select(*keys, F.col("year").cast("double").alias("x"), F.coalesce("n", F.lit(0)).cast("double").alias("y"))


def layer_summary(totals: DataFrame, observed: DataFrame, layers: DataFrame, draws: int, years: tuple[int, int], by: list[str] = ["layer"]) -> DataFrame:  # noqa: B006
    """surrogate_summary of each layer's totals (total_…) and of its Theil–Sen slopes over all years (slope_…).

    totals: draw, by, year, n (of any number of bundles); observed: by, year, n; layers: by. Years, draws and layers
    without a synchronised day count as 0.
    """
    names = layers.select(*by).distinct()
    drawn = _yearly(totals, names.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))), ["draw", *by], years)
    seen = _yearly(observed, names, by, years)
    sums = surrogate_summary(drawn.groupBy("draw", *by).agg(F.sum("y").alias("value")), seen.groupBy(*by).agg(F.sum("y").alias("observed")), by)
    slopes = surrogate_summary(T.theil_sen(drawn, ("draw", *by)).withColumnRenamed("slope", "value"), T.theil_sen(seen, tuple(by)).select(*by, F.col("slope").alias("observed")), by)
    named = lambda f, k: f.select(*by, *[F.col(c).alias(f"{k}_{c}") for c in f.columns if c not in by])
    return named(sums, "total").join(named(slopes, "slope"), by)
