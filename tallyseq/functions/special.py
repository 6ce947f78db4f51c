"""Special functions in numpy, and the Arrow UDFs over them. Tails are summed in log space."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

_LGAMMA = np.vectorize(math.lgamma, otypes=[float])


def log_choose(n, k):
    return _LGAMMA(n + 1) - _LGAMMA(k + 1) - _LGAMMA(n - k + 1)


def log_sum(x: np.ndarray) -> float:
    top = x.max() if len(x) else -math.inf
    return top + math.log(np.exp(x - top).sum()) if top > -math.inf else -math.inf


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Sum of all tables with these margins that are no likelier than the one seen (relative slack 1e-7) (ST-10)."""
    rows, col, total = a + b, a + c, a + b + c + d
    low, high = max(0, col - (total - rows)), min(rows, col)
    k = np.arange(low, high + 1, dtype=float)
    logs = log_choose(rows, k) + log_choose(total - rows, col - k) - log_choose(total, col)
    return float(min(1.0, math.exp(log_sum(logs[logs <= logs[a - low] + 1e-7]))))


#: Terms of a tail that are summed at a time.
CHUNK = 1 << 15


def _summed(log_mass, start: int, stop: int, step: int) -> float:
    """log of the sum of exp(log_mass(k)) from ``start`` towards ``stop``, in chunks; ends early where terms fall and add nothing."""
    total = -math.inf
    for low in range(start, stop, step * CHUNK):
        k = np.arange(low, max(stop, low - CHUNK) if step < 0 else min(stop, low + CHUNK), step, dtype=float)
        logs = log_mass(k)
        part = log_sum(logs)
        total = max(total, part) + math.log1p(math.exp(-abs(total - part))) if min(total, part) > -math.inf else max(total, part)
        if logs[-1] < logs[0] and logs[-1] < total - 50 - math.log(max(abs(stop - low), 1)):
            break
    return total


def binomial_tail(x: int, n: int, p: float) -> float:
    """P(X >= x)."""
    if x <= 0:
        return 1.0
    if p <= 0 or x > n:
        return 0.0
    if p >= 1:
        return 1.0
    mass = lambda k: log_choose(n, k) + k * math.log(p) + (n - k) * math.log1p(-p)
    return _shorter(mass, x, n, n * p)


def _shorter(mass, x: int, n: int, mean: float) -> float:
    """P(X >= x) by the tail that falls away from the mean."""
    if x > mean:
        return float(min(1.0, math.exp(_summed(mass, x, n + 1, 1))))
    return float(max(0.0, 1 - math.exp(_summed(mass, x - 1, -1, -1))))


def betabinomial_tail(x: int, n: int, p: float, rho: float) -> float:
    """P(X >= x) with overdispersion rho; binomial where rho is next to nothing (ST-11)."""
    if rho <= 1e-12:
        return binomial_tail(x, n, p)
    if x <= 0:
        return 1.0
    if x > n:
        return 0.0
    kappa = max(1 / rho - 1, 1e-6)
    alpha, beta = max(p * kappa, 1e-12), max((1 - p) * kappa, 1e-12)

    def mass(k):
        return log_choose(n, k) + _LGAMMA(k + alpha) + _LGAMMA(n - k + beta) - _LGAMMA(n + alpha + beta) - (math.lgamma(alpha) + math.lgamma(beta) - math.lgamma(alpha + beta))

    return _shorter(mass, x, n, n * p)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def beta_cdf(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def student_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|); 1 where either is not finite (ST-13). The UDF gives NULL where either is missing."""
    if t is None or df is None or not (math.isfinite(t) and math.isfinite(df)) or df <= 0:
        return 1.0
    return beta_cdf(df / 2, 0.5, df / (df + t * t))


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _udf(f, kind: str = "double"):
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(x) for x in row) else f(*row) for row in zip(*columns)], dtype="float64")

    run.__annotations__ = {}
    return F.pandas_udf(run, kind, F.PandasUDFType.SCALAR)


def fisher_udf():
    return _udf(lambda a, b, c, d: fisher_two_sided(int(a), int(b), int(c), int(d)))


def betabinomial_udf():
    return _udf(lambda x, n, p, rho: betabinomial_tail(int(x), int(n), float(p), float(rho)))


def normal_tails(z: np.ndarray) -> np.ndarray:
    """``normal_tail`` of many values at once: a series near 0, a continued fraction beyond; NaN where missing."""
    z = np.asarray(z, float)
    x = np.abs(z) / math.sqrt(2)
    out = np.full(len(z), np.nan)
    near, far = x < 2.5, x >= 2.5
    u = x[near]
    term, total = u.copy(), u.copy()
    for n in range(1, 80):
        term = term * 2 * u * u / (2 * n + 1)
        total += term
    out[near] = 0.5 - total * np.exp(-u * u) / math.sqrt(math.pi)
    u = np.minimum(x[far], 40.0)
    c = u.copy()
    for n in range(120, 0, -1):
        c = u + (n / 2) / c
    out[far] = 0.5 * np.exp(-u * u) / (c * math.sqrt(math.pi))
    return np.where(z < 0, 1 - out, out)


def beta_cdfs(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``beta_cdf`` of many values at once."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    out = np.where(x >= 1, 1.0, 0.0)
    inside = (x > 0) & (x < 1)
    p, q, y = a[inside], b[inside], x[inside]
    turned = y >= (p + 1) / (p + q + 2)
    front = np.exp(_LGAMMA(p + q) - _LGAMMA(p) - _LGAMMA(q) + p * np.log(y) + q * np.log1p(-y)) if len(y) else y
    p, q, y = np.where(turned, q, p), np.where(turned, p, q), np.where(turned, 1 - y, y)
    part = front * _beta_fractions(p, q, y) / p
    out[inside] = np.where(turned, 1 - part, part)
    return out


def _beta_fractions(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    tiny = 1e-300
    safe = lambda v: np.where(np.abs(v) > tiny, v, tiny)
    c, d = np.ones(len(x)), 1 / safe(1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / safe(1 + num * d)
            c = safe(1 + num / c)
            out = out * c * d
        if not len(x) or np.abs(c * d - 1).max() < 1e-15:
            break
    return out


def students_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """``student_two_sided`` of many values at once."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    good = np.isfinite(t) & np.isfinite(df) & (df > 0)
    out = np.ones(len(t))
    u, n = t[good], df[good]
    out[good] = beta_cdfs(n / 2, np.full(len(n), 0.5), n / (n + u * u))
    return out


def _batched(f):
    """A UDF of whole columns; NULL where any of them is."""

    def run(*columns: pd.Series) -> pd.Series:
        missing = np.logical_or.reduce([c.isna().to_numpy() for c in columns])
        got = f(*[c.fillna(0).to_numpy(float) for c in columns]) if len(missing) else np.zeros(0)
        return pd.Series(got).mask(missing)

    run.__annotations__ = {}
    return F.pandas_udf(run, "double", F.PandasUDFType.SCALAR)


def student_udf():
    return _batched(students_two_sided)


def normal_udf():
    return _batched(normal_tails)
