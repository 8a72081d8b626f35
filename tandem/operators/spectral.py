"""Waves along a circle of longitudes: anomalies, composites, band-pass and drift of the lag correlation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import SpectralConfig
from ..functions import scalars as S


def anomaly(z: Column) -> Column:
    """An array less the mean of its present values."""
    real = F.filter(z, lambda x: x.isNotNull() & ~F.isnan(x))
    mean = F.aggregate(real, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(real), F.lit(0))
    return F.transform(z, lambda x: F.when(~F.isnan(x), x - mean))


def composite(rows: DataFrame, by: list[str], z: str = "z") -> DataFrame:
    """(by, z, n): mean anomaly at each place over a group's rows."""
    places = rows.select(*by, F.posexplode(anomaly(F.col(z))).alias("i", "v"))
    mean = places.groupBy(*by, "i").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n"))
    return mean.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("z"), F.max("n").alias("n"))


def nearest_of(wanted: DataFrame, days: DataFrame, by: list[str]) -> DataFrame:
    """(by, _want, _h): of days (by, _h) the one nearest to each wanted day (by, _want) of the same group, the earlier of two.

    The last day at or before and the first at or after come from one sort of both tables' distinct days.
    """
    day = Window.partitionBy(*by).orderBy("_want")
    none = F.lit(None).cast("date")
    both = wanted.select(*by, "_want", none.alias("_h")).distinct().unionByName(days.select(*by, F.col("_h").alias("_want"), "_h").distinct())
    before = F.max("_h").over(day.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min("_h").over(day.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    placed = both.withColumn("_before", before).withColumn("_after", after).where("_h is null and _want is not null")
    later = F.col("_before").isNull() | (F.datediff("_after", "_want") < F.datediff("_want", "_before"))
    return placed.select(*by, "_want", F.when(later, F.col("_after")).otherwise(F.col("_before")).alias("_h")).where("_h is not null")


def nearest_days(dates: DataFrame, heights: DataFrame, offset: int = 0) -> DataFrame:
    """For each date, shifted by offset days, the height row nearest in time within the date's own calendar year.

    dates: by, date; heights: date, z. A shift over the year's edge is clamped to the year's first or last row.
    """
    keys = dates.columns
    wanted = dates.withColumn("_want", F.date_add("date", offset)).withColumn("_yr", F.year("date"))
    days = heights.select(F.col("date").alias("_h"), F.year("date").alias("_yr")).distinct()
    # The nearest day is found on dates alone; the arrays join once it is known.
    best = wanted.distinct().join(nearest_of(wanted, days, ["_yr"]), ["_yr", "_want"]).select(*keys, "_h")
    return best.join(heights.select(F.col("date").alias("_h"), "z"), "_h").select(*keys, "z")


def nearest_latitude(heights: DataFrame, latitude: float, level: int) -> DataFrame:
    """(date, z) at the level and latitude nearest to those given."""
    grid = heights.select("level", "lat").distinct()
    best = grid.orderBy(F.abs(F.col("level") - level), F.abs(F.col("lat") - latitude), "level", "lat").limit(1)
    return heights.join(F.broadcast(best), ["level", "lat"], "left_semi").select("date", "z")  # best has one row


def band_pass(frame: DataFrame, low: int = 4, high: int = 8, z: str = "z", out: str = "wave") -> DataFrame:
    """frame with the part of z of wavenumbers low to high: real FFT, mask, inverse, in Arrow batches."""

    @F.pandas_udf("array<double>")
    def filtered(arrays: pd.Series) -> pd.Series:
        out, lengths = pd.Series([None] * len(arrays), index=arrays.index, dtype=object), arrays.map(len)
        for n in lengths.unique():  # arrays of one length are transformed together
            at = np.flatnonzero((lengths == n).to_numpy())
            spectrum = np.fft.rfft(np.stack(arrays.iloc[at].to_numpy()).astype(float), axis=1)
            spectrum[:, :low] = 0
            spectrum[:, high + 1 :] = 0
            waves = np.fft.irfft(spectrum, n=n, axis=1)
            for k, wave in zip(at, waves):
                out.iat[k] = wave
        return out

    return frame.withColumn(out, filtered(z))


def band_pass_sums(frame: DataFrame, by: list[str], n: int, low: int, high: int, z: str = "z") -> DataFrame:
    """(by, i, wave): the same as plain sums of cosines and sines, without Python. n: the arrays' length."""
    terms = frame.select(*by, F.posexplode(z).alias("i", "v"))
    wave = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("_wave")
    angle = F.lit(2 * math.pi / n) * F.pmod(F.col("_wave") * F.col("i"), F.lit(n))
    spectrum = terms.select(*by, "i", "v", wave).groupBy(*by, "_wave").agg(F.sum(F.col("v") * F.cos(angle)).alias("re"), F.sum(F.col("v") * F.sin(angle)).alias("im"))
    places = spectrum.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    weight = F.when(F.col("_wave") * 2 == n, 1.0).otherwise(2.0) / n
    return places.groupBy(*by, "i").agg(F.sum(weight * (F.col("re") * F.cos(angle) + F.col("im") * F.sin(angle))).alias("wave"))


def lag_correlation(pairs: DataFrame, by: list[str], n: int, max_shift: int = 20) -> DataFrame:
    """(by, shift, corr): correlation of early with late rolled by each shift. pairs: by, early, late (arrays of length n)."""
    shifted = pairs.withColumn("shift", F.explode(F.sequence(F.lit(-max_shift), F.lit(max_shift))))
    both = shifted.select(*by, "shift", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.element_at("early", i + 1).alias("x"), F.element_at("late", F.pmod(i - F.col("shift"), F.lit(n)) + 1).alias("y")))).alias("p"))
    return both.groupBy(*by, "shift").agg(F.corr("p.x", "p.y").alias("corr"))


def drift(correlations: DataFrame, by: list[str], step_degrees: float = 1.0, days: float = 6.0) -> DataFrame:
    """(by, best_shift, drift): the shift of largest correlation (the first, if several) as steps, or degrees, a day."""
    best = F.max_by("shift", F.struct(F.col("corr"), -F.col("shift")))
    return correlations.where(F.col("corr").isNotNull() & ~F.isnan("corr")).groupBy(*by).agg(best.alias("best_shift")).withColumn("drift", -F.col("best_shift") * step_degrees / days)


def nearest_value(wave: Column, n: int, lon: Column) -> Column:
    """The value at the longitude nearest to lon on a regular circle from 0; ties go to the lower longitude."""
    target = S.lon_360(lon)
    distances = F.transform(S.longitudes(n), lambda x: F.abs(x - target))
    return F.element_at(wave, F.array_position(distances, F.array_min(distances)).cast("int"))


def diagnostics(waves: DataFrame, n: int, config: SpectralConfig = SpectralConfig()) -> DataFrame:
    """waves (wave, lon_a, lon_b, …) with the values at both centroids, their distance, sign and class."""
    a, b = nearest_value(F.col("wave"), n, F.col("lon_a")), nearest_value(F.col("wave"), n, F.col("lon_b"))
    out = waves.withColumn("wave_a", a).withColumn("wave_b", b).withColumn("abs_delta", F.abs(F.col("wave_a") - F.col("wave_b")))
    return out.withColumn("same_sign", S.same_sign(F.col("wave_a"), F.col("wave_b"))).withColumn("class", S.class_by_delta(F.col("abs_delta"), config.class_m))


def bundle_diagnostics(bundles: DataFrame, dates: DataFrame, heights: DataFrame, n: int, config: SpectralConfig = SpectralConfig(), level: int = 500, lag: int = 3) -> DataFrame:
    """Per bundle: windows, the wave's values at both centroids, their difference, sign and class, and the drift.

    bundles: bundle, lon_a, lat_a, lon_b, lat_b; dates: bundle, date; heights: date, level, lat, z (array of n). For each
    date the rows nearest in time (at 0, -lag and +lag days, within the date's year) at the latitude nearest to both
    centroids' mean are composed as anomalies and band-passed.
    """
    target = bundles.withColumn("target_lat", (F.col("lat_a") + F.col("lat_b")) / 2)
    grid = heights.select("level", "lat").distinct()
    choice = F.min_by(F.struct("level", "lat"), F.struct(F.abs(F.col("level") - level), F.abs(F.col("lat") - F.col("target_lat")), F.col("lat"))).alias("g")
    at = target.crossJoin(F.broadcast(grid)).groupBy("bundle").agg(choice).select("bundle", "g.*")  # the grid's levels and latitudes
    rows = heights.join(F.broadcast(at), ["level", "lat"]).select("bundle", F.col("date").alias("h_date"), "z")
    wanted = dates.select("bundle", "date", F.explode(F.array(F.lit(0), F.lit(-lag), F.lit(lag))).alias("shift"), F.year("date").alias("yr")).withColumn("_want", F.date_add("date", F.col("shift"))).distinct()
    days = rows.select("bundle", F.col("h_date").alias("_h"), F.year("h_date").alias("yr"))
    best = wanted.join(nearest_of(wanted, days, ["bundle", "yr"]), ["bundle", "yr", "_want"]).select("bundle", "date", "shift", F.col("_h").alias("h_date"))
    picked = best.join(rows, ["bundle", "h_date"])
    waves = band_pass(composite(picked, ["bundle", "shift"]), config.low, config.high)
    wave = lambda k, c: waves.where(F.col("shift") == k).select("bundle", F.col("wave").alias(c), *(["n"] if k == 0 else []))
    all_ = wave(0, "wave").join(wave(-lag, "early"), "bundle").join(wave(lag, "late"), "bundle")
    moved = drift(lag_correlation(all_, ["bundle"], n, config.max_shift), ["bundle"], days=2.0 * lag)
    values = diagnostics(all_.join(target, "bundle"), n, config)
    return values.join(moved, "bundle").select("bundle", F.col("n").alias("n_windows"), "target_lat", S.lon_360(F.col("lon_a")).alias("lon_a"), S.lon_360(F.col("lon_b")).alias("lon_b"), "wave_a", "wave_b", "abs_delta", "same_sign", "class", "drift")


def band_sweep(frame: DataFrame, bands: list[tuple[int, int]], n: int, z: str = "z") -> DataFrame:
    """diagnostics of the band-passed z for each band."""
    out = None
    for low, high in bands:
        part = diagnostics(band_pass(frame, low, high, z), n).withColumn("band", F.lit(f"{low}-{high}"))
        out = part if out is None else out.unionByName(part)
    return out
