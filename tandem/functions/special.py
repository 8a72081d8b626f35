"""Functions without a built-in: vectorised pandas UDFs on numpy, called on small aggregated tables only."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The WGS84 ellipsoid.
_A, _F = 6378137.0, 1 / 298.257223563
_B = _A * (1 - _F)


def geodesic_km_array(lon1, lat1, lon2, lat2) -> np.ndarray:
    """Inverse geodesic on WGS84 by Vincenty's iteration, in kilometres.

    Pairs that are nearly antipodal don't converge; for them the azimuth is bisected instead.
    """
    lon1, lat1, lon2, lat2 = (np.radians(np.asarray(x, float)) for x in (lon1, lat1, lon2, lat2))
    u1, u2 = np.arctan((1 - _F) * np.tan(lat1)), np.arctan((1 - _F) * np.tan(lat2))
    wide = (lon2 - lon1 + np.pi) % (2 * np.pi) - np.pi
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)

    def turn(lam):
        sl, cl = np.sin(lam), np.cos(lam)
        ss = np.hypot(cu2 * sl, cu1 * su2 - su1 * cu2 * cl)
        cs = su1 * su2 + cu1 * cu2 * cl
        sigma = np.arctan2(ss, cs)
        with np.errstate(invalid="ignore", divide="ignore"):
            sa = np.where(ss > 0, cu1 * cu2 * sl / ss, 0.0)
            c2a = 1 - sa**2
            c2m = np.where(c2a > 1e-15, cs - 2 * su1 * su2 / c2a, 0.0)
        c = _F / 16 * c2a * (4 + _F * (4 - 3 * c2a))
        nxt = wide + (1 - c) * _F * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m**2 - 1)))
        return nxt, sigma, ss, cs, c2a, c2m

    lam = wide.copy()
    for _ in range(200):
        nxt = turn(lam)[0]
        if np.all(np.abs(nxt - lam) < 1e-13):
            break
        lam = nxt
    lost = ~(np.abs(turn(lam)[0] - lam) < 1e-10) | (np.abs(lam) > np.pi)
    _, sigma, ss, cs, c2a, c2m = turn(lam)
    k = c2a * (_A**2 - _B**2) / _B**2
    big = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
    small = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
    d = small * ss * (c2m + small / 4 * (cs * (2 * c2m**2 - 1) - small / 6 * c2m * (4 * ss**2 - 3) * (4 * c2m**2 - 3)))
    out = _B * big * (sigma - d) / 1000
    if lost.any():
        out[lost] = _nearly_antipodal_km(u1[lost], u2[lost], np.abs(wide[lost]))
    return out


def _nearly_antipodal_km(u1: np.ndarray, u2: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """The same by bisecting the first azimuth, with the ellipsoid's integrals by quadrature; u1, u2: reduced latitudes."""
    swap = np.abs(u1) < np.abs(u2)
    u1, u2 = np.where(swap, u2, u1), np.where(swap, u1, u2)
    sign = np.where(u1 > 0, -1.0, 1.0)
    u1, u2 = u1 * sign, u2 * sign
    node, weight = np.polynomial.legendre.leggauss(48)
    ep2 = (_A**2 - _B**2) / _B**2

    def geodesic(azimuth):
        sa, ca = np.sin(azimuth), np.cos(azimuth)
        s0, c0 = sa * np.cos(u1), np.hypot(ca, sa * np.sin(u1))
        c2 = np.sqrt(np.maximum(0, (ca * np.cos(u1)) ** 2 + np.cos(u2) ** 2 - np.cos(u1) ** 2))
        first, last = np.arctan2(np.sin(u1), ca * np.cos(u1)), np.arctan2(np.sin(u2), c2)
        turn = np.arctan2(s0 * np.sin(u2), c2) - np.arctan2(s0 * np.sin(u1), ca * np.cos(u1))
        half, mid = (last - first) / 2, (last + first) / 2
        root = np.sqrt(1 + ep2 * (c0[:, None] * np.sin(mid[:, None] + half[:, None] * node)) ** 2)
        shift = half * (((2 - _F) / (1 + (1 - _F) * root)) @ weight)
        return turn - _F * s0 * shift, _B * half * (root @ weight) / 1000

    low, high = np.zeros_like(wide), np.full_like(wide, np.pi)
    for _ in range(80):
        mid = (low + high) / 2
        short = geodesic(mid)[0] < wide
        low, high = np.where(short, mid, low), np.where(short, high, mid)
    return geodesic((low + high) / 2)[1]


@F.pandas_udf(T.DoubleType())
def geodesic_km(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    return pd.Series(geodesic_km_array(lon1, lat1, lon2, lat2))


@F.pandas_udf(T.DoubleType())
def normal_upper_tail(z: pd.Series) -> pd.Series:
    """P(Z >= z)."""
    return z.map(lambda x: None if pd.isna(x) else 0.5 * math.erfc(x / math.sqrt(2)))


def kendall_exact_p(n: int, discordant: int) -> float:
    """Two-sided p of tau without ties: counts of permutations by inversions."""
    total = n * (n - 1) // 2
    c = min(discordant, total - discordant)
    counts = np.array([1.0])
    for j in range(2, n + 1):
        counts = np.convolve(counts, np.full(j, 1.0 / j))
    return float(min(1.0, 2 * counts[: c + 1].sum()))


@F.pandas_udf(T.DoubleType())
def kendall_p(n: pd.Series, score: pd.Series, ties_x: pd.Series, ties_y: pd.Series, x1: pd.Series, x2: pd.Series, y1: pd.Series, y2: pd.Series) -> pd.Series:
    """Two-sided p of Kendall's tau: exact without ties up to 33 values, else the tie-corrected normal approximation.

    score: concordant less discordant pairs; ties: tied pairs; x1 and x2: sums of t(t-1)(t-2) and t(t-1)(2t+5) over ties.
    """

    def one(n, s, tx, ty, a1, a2, b1, b2):
        total = n * (n - 1) // 2
        if n < 2 or tx == total or ty == total:
            return None
        if not tx and not ty and n <= 33:
            return kendall_exact_p(int(n), int((total - s) // 2))
        m = n * (n - 1.0)
        var = (m * (2 * n + 5) - a2 - b2) / 18 + 2 * tx * ty / m + a1 * b1 / (9 * m * (n - 2))
        return math.erfc(abs(s) / math.sqrt(var) / math.sqrt(2))

    return pd.Series([one(*r) for r in zip(n, score, ties_x, ties_y, x1, x2, y1, y2)], dtype="float64")
