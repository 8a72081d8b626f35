"""Scalar functions as Column expressions; all stay within generated code or built-in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def as_null(x: Column) -> Column:
    """NaN counts as missing: NULL, so that comparisons and aggregates skip it."""
    return F.when(~F.isnan(x), x)


def clip(x: Column, low: float | None, high: float | None) -> Column:
    """x within bounds. least() and greatest() would turn a missing x into a bound."""
    out = F
    if low is not None:
        out = out.when(x < low, low)
    if high is not None:
        out = out.when(x > high, high)
    return out.otherwise(x)


def kelvin_to_c(x: Column) -> Column:
    return x - 273.15


def relative_humidity(temp_c: Column, dew_c: Column) -> Column:
    """Magnus form, in percent, within 0 and 100. The base pressure cancels out."""
    # Coefficients of the Magnus formula.
    a, b = 17.625, 243.04
    ratio = F.exp(a * dew_c / (b + dew_c)) / F.exp(a * temp_c / (b + temp_c))
    return clip(100.0 * ratio, 0.0, 100.0)


def wet_bulb(temp_c: Column, rh: Column) -> Column:
    """Stull's (2011) wet-bulb temperature from temperature and relative humidity."""
    # Stull's coefficients.
    return temp_c * F.atan(0.151977 * F.sqrt(rh + 8.313659)) + F.atan(temp_c + rh) - F.atan(rh - 1.676331) + 0.00391838 * F.pow(rh, F.lit(1.5)) * F.atan(0.023101 * rh) - 4.686035


def local_solar_time(ts: Column, lon: Column) -> Column:
    """UTC plus an hour for each 15 degrees of longitude, to the microsecond."""
    return F.timestamp_micros(F.unix_micros(ts) + F.round(lon / 15 * F.lit(3.6e9)).cast("bigint"))


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), F.lit(2)) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * EARTH_KM * F.asin(F.sqrt(clip(h, None, 1.0)))


def expected_coincidences(n_a: Column, n_b: Column, n_eff: Column, k_days: int) -> Column:
    return n_a.cast("double") * n_b * (2 * k_days + 1) / F.greatest(n_eff, F.lit(1))


def poisson_upper_tail(obs: Column, lam: Column) -> Column:
    """P(X >= obs) for a Poisson mean lam; 1 where obs or lam is 0.

    Starts from a probability in logarithms, so nothing underflows: above the mean the tail is summed upwards from obs,
    below it the complement downwards from obs - 1. The count of terms grows with the mean.
    """
    obs = obs.cast("int")

    def log_pmf(k: Column) -> Column:
        log_factorial = F.when(k < 1, 0.0).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(0.0), lambda acc, i: acc + F.ln(i)))
        return k * F.ln(lam) - lam - log_factorial

    def tail(first: Column, ratio, n: Column) -> Column:
        start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

        def step(acc, i):
            term = acc["term"] * ratio(i)
            return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

        return F.exp(log_pmf(first)) * F.aggregate(F.sequence(F.lit(1), n), start, step)["total"]

    terms = (F.ceil(12 * F.sqrt(F.greatest(obs, F.lit(1)))) + 60).cast("int")
    above = tail(obs, lambda i: lam / (obs + i), terms)
    below = 1 - tail(obs - 1, lambda i: F.greatest(obs - i, F.lit(0)) / lam, F.greatest(obs - 1, F.lit(1)))
    return F.when((obs <= 0) | (lam <= 0), 1.0).when(obs > lam, clip(above, None, 1.0)).otherwise(clip(below, 0.0, None))


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def region_name(lon: Column, lat: Column, compact: bool = False) -> Column:
    """Named regions in order, else "(lon,lat)" without decimals."""
    # The regions' limits and names.
    america, asia = ("N.America", "E.Asia") if compact else ("NorthAmerica", "EastAsia")
    whole = lambda x: half_even(x.cast("double")).cast("bigint").cast("string")
    return (
        F.when((lat > 20) & (lon > -130) & (lon < -60), america)
        .when((lat > 20) & (lon > 60) & (lon < 150), asia)
        .when((lat > 30) & (lon > -10) & (lon < 40), "Europe")
        .otherwise(F.concat(F.lit("("), whole(lon), F.lit(","), whole(lat), F.lit(")")))
    )


def safe_name(name: Column) -> Column:
    """A name for files: no spaces, arrows spelled out."""
    return F.replace(F.replace(F.replace(name, F.lit(" "), F.lit("")), F.lit("->"), F.lit("_to_")), F.lit("<->"), F.lit("_and_"))


def safe_setting(setting: Column) -> Column:
    """A setting's label for files: "p<0.01" as "plt0p01"."""
    return F.replace(F.replace(F.replace(setting, F.lit("<"), F.lit("lt")), F.lit("="), F.lit("")), F.lit("."), F.lit("p"))


def replace_first(text: Column, what: str, by: str) -> Column:
    at = F.instr(text, what)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.lit(by), F.substring(text, at + len(what), F.char_length(text)))).otherwise(text)


#: The names of the six bundles by mechanism and rank.
BUNDLE_LABELS = {
    ("Coherent", 1): "C1 North America-Europe",
    ("Coherent", 2): "C2 North America-East Asia",
    ("Coherent", 3): "C3 Europe-East Asia",
    ("Dipole", 1): "D1 East Asia-North America",
    ("Dipole", 2): "D2 West/Central Asia-East Asia",
    ("Dipole", 3): "D3 North Atlantic-North America",
}


def bundle_label(mechanism: Column, rank: Column) -> Column:
    out = F
    for (m, r), label in BUNDLE_LABELS.items():
        out = out.when((mechanism == m) & (rank == r), label)
    return out.otherwise(F.concat(mechanism, F.lit(" "), rank.cast("string")))


def duration_bin(days: Column) -> Column:
    """(1,2], (2,4], (4,10000]; else NULL."""
    return F.when((days > 1) & (days <= 2), "2").when((days > 2) & (days <= 4), "3-4").when((days > 4) & (days <= 10_000), "5+")


def lon_360(lon: Column) -> Column:
    return F.pmod(lon, F.lit(360))


def canonical_pair(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def longitudes(n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i * 360.0 / n)


def cell_bounds(lon: Column, lat: Column, half: float = 0.125) -> Column:
    """A grid cell's edges, clipped to the globe."""
    return F.struct(
        F.greatest(lon - half, F.lit(-180.0)).alias("west"), F.least(lon + half, F.lit(180.0)).alias("east"),
        F.greatest(lat - half, F.lit(-90.0)).alias("south"), F.least(lat + half, F.lit(90.0)).alias("north"),
    )


def setting_label(duration: Column, k_days: Column, alpha: Column) -> Column:
    primary = (duration == 2) & (k_days == 3) & (F.abs(alpha - 0.005) < 1e-12)
    return F.when(primary, "Primary").when(duration != 2, F.concat(F.lit("D="), duration)).when(k_days != 3, F.concat(F.lit("K="), k_days)).otherwise(F.concat(F.lit("p<"), alpha.cast("string")))


def class_by_delta(delta: Column, limit: float = 45.0) -> Column:
    return F.when(delta < limit, "coherent-like").otherwise("dipole-like")


def same_sign(a: Column, b: Column) -> Column:
    return F.coalesce((a != 0) & (b != 0) & (F.signum(a) == F.signum(b)), F.lit(False))


def safe_ratio(a: Column, b: Column) -> Column:
    """NULL where the denominator is 0."""
    return a / F.nullif(b, F.lit(0).cast("double"))


def day_text(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd")


def study_day(d: Column, origin: str = "2000-01-01") -> Column:
    """The day's place in the study calendar."""
    return F.datediff(d, F.to_date(F.lit(origin)))


def tau_tag(tau: float) -> str:
    return f"tau{round(tau * 100):03d}"


def season_suffix(season: str) -> str:
    return "" if season == "all" else "_" + season.replace("-", "_")


def parse_bands(text: str) -> list[tuple[int, int]]:
    """"3-8,4-8" as pairs; each band has 1 <= low <= high."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        low, sep, high = part.partition("-")
        if not sep or not low.strip().isdigit() or not high.strip().isdigit() or not 1 <= int(low) <= int(high):
            raise ValueError(f"not a band: {part!r}")
        out.append((int(low), int(high)))
    if not out:
        raise ValueError("no band given")
    return out
