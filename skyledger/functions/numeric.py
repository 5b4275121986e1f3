"""Arrow-batched numerics that have no built-in expression."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import constants as C

# Lanczos coefficients (g = 7, n = 9).
_LANCZOS = np.array(
    [
        0.99999999999980993,
        676.5203681218851,
        -1259.1392167224028,
        771.32342877765313,
        -176.61502916214059,
        12.507343278686905,
        -0.13857109526572012,
        9.9843695780195716e-6,
        1.5056327351493116e-7,
    ]
)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    z = x - 1.0
    acc = np.full_like(z, _LANCZOS[0])
    for i in range(1, 9):
        acc += _LANCZOS[i] / (z + i)
    t = z + 7.5
    return 0.5 * np.log(2 * np.pi) + (z + 0.5) * np.log(t) - t + np.log(acc)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = np.ones_like(x)
        for coef in (even, odd):
            d = 1.0 + coef * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + coef / np.where(np.abs(c) < tiny, tiny, c)
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h = h * step
        if np.nanmax(np.abs(step - 1.0), initial=0.0) < 1e-14:
            break
    return h


def t_upper_tail_array(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(T > t) of Student's t with real degrees of freedom."""
    t = np.asarray(t, dtype=float)
    df = np.asarray(df, dtype=float)
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(t) & np.isfinite(df) & (df > 0)
    if ok.any():
        tt, nu = t[ok], df[ok]
        a, b = nu / 2.0, np.full_like(nu, 0.5)
        x = nu / (nu + tt * tt)
        front = np.exp(
            _log_gamma(a + b) - _log_gamma(a) - _log_gamma(b)
            + a * np.log(np.where(x > 0, x, 1e-300)) + b * np.log1p(-np.where(x < 1, x, 1 - 1e-16))
        )
        direct = x < (a + 1.0) / (a + b + 2.0)
        val = np.where(
            direct,
            front * _beta_fraction(a, b, np.where(direct, x, 0.0)) / a,
            1.0 - front * _beta_fraction(b, a, np.where(direct, 0.0, 1.0 - x)) / b,
        )
        half = 0.5 * np.clip(val, 0.0, 1.0)
        out[ok] = np.where(tt >= 0, half, 1.0 - half)
    return out


@F.pandas_udf(T.DoubleType())
def t_upper_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    p = t_upper_tail_array(t.to_numpy(dtype=float), df.to_numpy(dtype=float))
    return pd.Series(p).where(~np.isnan(p), None)


_GEODESIC = T.StructType(
    [T.StructField("dist_m", T.DoubleType()), T.StructField("azimuth_deg", T.DoubleType())]
)


def geodesic_inverse(lon1, lat1, lon2, lat2) -> tuple[np.ndarray, np.ndarray]:
    """Distance (m) and forward azimuth (degrees 0-360) on the WGS84 ellipsoid.

    Vincenty's iteration, and for nearly opposite points, where it does not settle, a
    bisection on the azimuth.
    """
    f, a = C.WGS84_F, C.WGS84_A
    b = a * (1 - f)
    u1 = np.arctan((1 - f) * np.tan(np.radians(lat1)))
    u2 = np.arctan((1 - f) * np.tan(np.radians(lat2)))
    big_l = np.radians(lon2) - np.radians(lon1)
    big_l = np.where(big_l > np.pi, big_l - 2 * np.pi, np.where(big_l < -np.pi, big_l + 2 * np.pi, big_l))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = big_l.copy()
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(60):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
            cs = s1 * s2 + c1 * c2 * cl
            sig = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0.0, c1 * c2 * sl / np.where(ss == 0, 1.0, ss))
            ca2 = 1 - sa * sa
            cm = np.where(ca2 == 0, 0.0, cs - 2 * s1 * s2 / np.where(ca2 == 0, 1.0, ca2))
            cc = f / 16 * ca2 * (4 + f * (4 - 3 * ca2))
            nxt = big_l + (1 - cc) * f * sa * (sig + cc * ss * (cm + cc * cs * (2 * cm * cm - 1)))
            moved = np.abs(nxt - lam)
            lam = nxt
            if np.nanmax(moved, initial=0.0) < 1e-13:
                break
        usq = ca2 * (a * a - b * b) / (b * b)
        big_a = 1 + usq / 16384 * (4096 + usq * (-768 + usq * (320 - 175 * usq)))
        big_b = usq / 1024 * (256 + usq * (-128 + usq * (74 - 47 * usq)))
        ds = big_b * ss * (
            cm + big_b / 4 * (cs * (2 * cm * cm - 1) - big_b / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3))
        )
        dist = b * big_a * (sig - ds)
        az = np.degrees(np.arctan2(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam))) % 360.0
    known = np.isfinite(big_l + u1 + u2)
    open_pairs = known & ~((moved < 1e-12) & (np.abs(lam) <= np.pi) & np.isfinite(dist))
    if open_pairs.any():
        dist, az = np.array(dist), np.array(az)
        dist[open_pairs], az[open_pairs] = _opposite_points(u1[open_pairs], u2[open_pairs], big_l[open_pairs])
    return dist, az


def _opposite_points(u1: np.ndarray, u2: np.ndarray, big_l: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance and forward azimuth between nearly opposite points of reduced latitude (Karney, 2013).

    With the point of larger latitude first and put south, the difference of longitude
    reached at the second latitude grows with the first azimuth, so halving its interval
    finds it. The two integrals along the great ellipse are Gaussian sums.
    """
    f, b = C.WGS84_F, C.WGS84_A * (1 - C.WGS84_F)
    swap = np.abs(u1) < np.abs(u2)
    first, second = np.where(swap, u2, u1), np.where(swap, u1, u2)
    flip = np.where(first > 0, -1.0, 1.0)
    # A point on the equator counts as just south of it, so that every azimuth has one direction there.
    first, second = np.minimum(first * flip, -1e-12), second * flip
    target, east = np.abs(big_l), np.where(big_l < 0, -1.0, 1.0)
    nodes, weights = np.polynomial.legendre.leggauss(48)
    second_ecc = f * (2 - f) / (1 - f) ** 2

    def along(azimuth: np.ndarray):
        sin1, cos1 = np.sin(azimuth), np.cos(azimuth)
        sin0 = sin1 * np.cos(first)
        cos2 = np.sqrt(np.maximum(0.0, (cos1 * np.cos(first)) ** 2 + np.cos(second) ** 2 - np.cos(first) ** 2)) / np.cos(second)
        sin2 = sin0 / np.cos(second)
        s1, s2 = np.arctan2(np.sin(first), cos1 * np.cos(first)), np.arctan2(np.sin(second), cos2 * np.cos(second))
        w1 = np.arctan2(sin0 * np.sin(first), cos1 * np.cos(first))
        w2 = np.arctan2(sin0 * np.sin(second), cos2 * np.cos(second))
        half, middle = (s2 - s1) / 2, (s2 + s1) / 2
        root = np.sqrt(1 + second_ecc * (1 - sin0**2)[:, None] * np.sin(middle[:, None] + half[:, None] * nodes) ** 2)
        lag = half * ((2 - f) / (1 + (1 - f) * root) @ weights)
        return (w2 - w1) - f * sin0 * lag, b * half * (root @ weights), sin2, cos2

    low, high = np.zeros_like(first), np.full_like(first, np.pi)
    for _ in range(80):
        mid = (low + high) / 2
        short = along(mid)[0] < target
        low, high = np.where(short, mid, low), np.where(short, high, mid)
    mid = (low + high) / 2
    _, dist, sin2, cos2 = along(mid)
    sin1, cos1 = np.where(swap, sin2, np.sin(mid)), np.where(swap, cos2, np.cos(mid))
    turned = np.where(swap, -1.0, 1.0)
    return dist, np.degrees(np.arctan2(sin1 * east, cos1 * turned * flip)) % 360.0


@F.pandas_udf(_GEODESIC)
def geodesic(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.DataFrame:
    d, az = geodesic_inverse(*(s.to_numpy(dtype=float) for s in (lon1, lat1, lon2, lat2)))
    return pd.DataFrame({"dist_m": d, "azimuth_deg": az})
