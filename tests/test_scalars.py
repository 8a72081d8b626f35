import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.config import EventConfig, PairConfig, from_args
from tandem.functions import scalars as S
from tandem.functions.special import geodesic_km_array, kendall_exact_p


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_poisson_tail_against_plain_sums(spark):
    cases = [(0, 3.0), (5, 0.0), (1, 1e-3), (3, 3.0), (20, 3.0), (10, 40.0), (400, 364.0), (300, 364.0), (2, 900.0)]
    got = spark.createDataFrame(cases, "obs int, lam double").select("obs", "lam", S.poisson_upper_tail(F.col("obs"), F.col("lam")).alias("p")).collect()
    for r in got:
        if r["obs"] <= 0 or r["lam"] <= 0:
            assert r["p"] == 1
            continue
        pmf = lambda k: math.exp(k * math.log(r["lam"]) - r["lam"] - math.lgamma(k + 1))
        want = math.fsum(pmf(k) for k in range(r["obs"], r["obs"] + 3000)) if r["obs"] > r["lam"] else 1 - math.fsum(pmf(k) for k in range(r["obs"]))
        assert r["p"] == pytest.approx(want, rel=1e-9)


def test_geodesic_known_distances():
    # Known distances on the WGS84 ellipsoid (a quarter meridian, an equator degree, two nearly antipodal pairs).
    assert geodesic_km_array([0], [0], [0], [90])[0] == pytest.approx(10001.965729, abs=1e-5)
    assert geodesic_km_array([0], [0], [1], [0])[0] == pytest.approx(111.319491, abs=1e-5)
    assert geodesic_km_array([10], [20], [10], [20])[0] == 0
    assert geodesic_km_array([0], [0], [179.5], [0.5])[0] == pytest.approx(19936.288579, abs=1e-5)
    assert geodesic_km_array([0], [0], [179.7], [0.5])[0] == pytest.approx(19944.127421, abs=1e-5)


def test_geodesic_is_near_the_sphere(spark):
    rng = np.random.default_rng(1)
    lon1, lon2 = rng.uniform(-180, 180, (2, 50))
    lat1, lat2 = rng.uniform(-85, 85, (2, 50))
    rows = [tuple(map(float, r)) for r in zip(lon1, lat1, lon2, lat2)]
    flat = spark.createDataFrame(rows, "a double, b double, c double, d double").select(S.haversine_km(*map(F.col, "abcd")).alias("km"))
    assert np.allclose([r["km"] for r in flat.collect()], geodesic_km_array(lon1, lat1, lon2, lat2), rtol=0.006)


def test_humidity_is_clipped_and_wet_bulb_is_below_air(spark):
    assert one(spark, S.relative_humidity(F.lit(20.0), F.lit(25.0))) == 100
    rh = one(spark, S.relative_humidity(F.lit(30.0), F.lit(20.0)))
    assert 50 < rh < 60
    assert one(spark, S.wet_bulb(F.lit(20.0), F.lit(50.0))) == pytest.approx(13.7, abs=0.01)  # the formula's own example


def test_missing_stays_missing(spark):
    none = F.lit(None).cast("double")
    assert one(spark, S.relative_humidity(none, F.lit(1.0))) is None
    assert one(spark, S.haversine_km(none, none, F.lit(1.0), F.lit(1.0))) is None
    assert one(spark, S.poisson_upper_tail(F.lit(3), none)) is None


def test_nan_is_missing(spark):
    assert one(spark, S.as_null(F.lit(float("nan")))) is None
    assert one(spark, S.safe_ratio(F.lit(1.0), F.lit(0.0))) is None


@pytest.mark.parametrize("lon,lat,want", [(-100, 40, "NorthAmerica"), (100, 30, "EastAsia"), (10, 50, "Europe"), (-48.4, 43, "(-48,43)"), (0.5, -1.5, "(0,-2)"), (-60, 40, "(-60,40)")])
def test_region_names(spark, lon, lat, want):
    assert one(spark, S.region_name(F.lit(float(lon)), F.lit(float(lat)))) == ("(-60,40)" if lon == -60 else want)


def test_duration_bins(spark):
    got = [one(spark, S.duration_bin(F.lit(d))) for d in (1, 2, 3, 4, 5)]
    assert got == [None, "2", "3-4", "3-4", "5+"]


def test_local_time_moves_an_hour_for_fifteen_degrees(spark):
    t = F.to_timestamp(F.lit("2020-01-01 00:00:00"))
    assert str(one(spark, S.local_solar_time(t, F.lit(-22.5)))) == "2019-12-31 22:30:00"


def test_bands():
    assert S.parse_bands("3-8, 4-8") == [(3, 8), (4, 8)]
    for bad in ("", "8-3", "a-b", "0-4", "5"):
        with pytest.raises(ValueError):
            S.parse_bands(bad)


def test_names_and_settings(spark):
    assert S.tau_tag(0.15) == "tau015" and S.season_suffix("all") == "" and S.season_suffix("local-warm3") == "_local_warm3"
    assert from_args(PairConfig, ["--alpha", "0.01", "--k-days", "1"]) == PairConfig(alpha=0.01, k_days=1)
    assert from_args(EventConfig, ["--baseline", "1996", "2000"]).baseline == (1996, 2000)
    assert EventConfig(season="local-warm4").season_months == 4
    with pytest.raises(ValueError):
        _ = EventConfig(season="summer").season_months


def test_kendall_exact_p_is_a_distribution():
    assert kendall_exact_p(4, 0) == pytest.approx(2 / 24)
    assert kendall_exact_p(5, 5) == 1
