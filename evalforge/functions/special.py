"""Distribution functions for test statistics, on single numbers of the driver."""

from __future__ import annotations

import math

import numpy as np


def chi2_sf(x: float, df: float) -> float:
    """Upper tail of chi-square: the regularised upper incomplete gamma function."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * front)
    tiny = 1e-300
    b, c = x + 1 - a, 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def f_sf(x: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution, by Gauss-Legendre on the beta density."""
    if x <= 0:
        return 1.0
    lo = d2 / (d2 + d1 * x)
    a, b = d2 / 2, d1 / 2
    # Substituting t = lo * s**p removes the singular end.
    p = max(1.0, 2 / a)
    s, w = np.polynomial.legendre.leggauss(200)
    s, w = (s + 1) / 2, w / 2
    t = lo * s**p
    log = (a - 1) * np.log(t) + (b - 1) * np.log1p(-t) + math.log(lo * p) + (p - 1) * np.log(s)
    return float((w * np.exp(log - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b))).sum())


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf)(x / math.sqrt(2)))


def range_cdf(q: float, k: int, df: float = math.inf) -> float:
    """Distribution of the studentized range of k means; df may be infinite."""
    if q <= 0:
        return 0.0
    z, wz = np.polynomial.legendre.leggauss(120)
    z, wz = z * 8.5, wz * 8.5

    def of(values: np.ndarray) -> np.ndarray:
        gap = _normal_cdf(z)[None, :] - _normal_cdf(z[None, :] - values[:, None])
        return k * (wz * np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * gap ** (k - 1)).sum(1)

    if math.isinf(df):
        return float(of(np.array([q]))[0])
    s, ws = np.polynomial.legendre.leggauss(80)
    top = 1 + 10 / math.sqrt(df)
    s, ws = (s + 1) * top / 2, ws * top / 2
    log = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    return float((ws * np.exp(log) * of(q * s)).sum())


def range_quantile(p: float, k: int, df: float = math.inf) -> float:
    lo, hi = 0.0, 200.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if range_cdf(mid, k, df) < p else (lo, mid)
    return (lo + hi) / 2
