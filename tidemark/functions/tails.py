"""p-values and sample sizes as Arrow-batched functions.

They only ever see aggregated rows: one per experiment, never one per customer.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY = 1e-300


def _log_beta(a: float, b: float) -> float:
    small, large = min(a, b), max(a, b)
    if large > 1e5 and small < 5.0:
        # The difference of two huge log-gammas would lose all digits.
        return math.lgamma(small) - small * math.log(large) - small * (small - 1.0) / (2.0 * large)
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def beta_ratio(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if not 0.0 < x < 1.0:
        return min(max(x, 0.0), 1.0) if not math.isnan(x) else math.nan
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_ratio(b, a, 1.0 - x)
    d = 1.0 / (1.0 - (a + b) * x / (a + 1.0) or _TINY)
    c, h = 1.0, d
    # Large parameters need about as many terms as their square root.
    for m in range(1, 200 + int(10 * math.sqrt(max(a, b)))):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / (1.0 + step * d or _TINY)
            c = 1.0 + step / c or _TINY
            h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - _log_beta(a, b))
    return front * h / a


def t_tail(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return beta_ratio(df / 2.0, 0.5, df / (df + t * t)) if df > 0 else math.nan


def f_tail(f: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution."""
    if not (d1 > 0 and d2 > 0) or math.isnan(f):
        return math.nan
    return beta_ratio(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def _normal_cdf(z: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(-v / math.sqrt(2.0)) for v in z])


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(200)


def _shifted_t_cdf(t: float, df: float, shift: float) -> float:
    """P(T <= t) for a noncentral t: the normal tail averaged over the scale estimate."""
    # s = sqrt(chi2/df) lies within ten standard deviations of 1.
    spread = 10.0 / math.sqrt(2.0 * df)
    low, high = max(1e-12, 1.0 - spread), 1.0 + spread
    s = 0.5 * (high - low) * _NODES + 0.5 * (high + low)
    log_density = (
        math.log(2.0) + df / 2.0 * math.log(df / 2.0) - math.lgamma(df / 2.0) + (df - 1.0) * np.log(s) - df * s * s / 2.0
    )
    return float(np.sum(_WEIGHTS * np.exp(log_density) * _normal_cdf(t * s - shift)) * 0.5 * (high - low))


def _t_critical(alpha: float, df: float) -> float:
    """The t whose two-sided p-value is alpha, by bisection."""
    low, high = 0.0, 1.0
    while t_tail(high, df) > alpha:
        high *= 2.0
    for _ in range(200):
        mid = 0.5 * (low + high)
        low, high = (mid, high) if t_tail(mid, df) > alpha else (low, mid)
        if high - low < 1e-13 * high:
            break
    return 0.5 * (low + high)


def t_power(effect: float, n1: float, alpha: float, ratio: float) -> float:
    """Power of the two-sided two-sample t-test with group sizes n1 and ratio * n1."""
    df = n1 * (1.0 + ratio) - 2.0
    shift = effect * math.sqrt(n1 * ratio / (1.0 + ratio))
    critical = _t_critical(alpha, df)
    return 1.0 - _shifted_t_cdf(critical, df, shift) + _shifted_t_cdf(-critical, df, shift)


def solve_n1(effect: float, power: float, alpha: float, ratio: float) -> float:
    """Size of the first group that reaches the power; NaN without an effect."""
    if not math.isfinite(effect) or effect == 0.0:
        return math.nan
    low = 2.0 / (1.0 + ratio) + 2.0 / (1.0 + ratio)  # two degrees of freedom
    if t_power(effect, low, alpha, ratio) >= power:
        return low
    high = 2.0 * low
    while t_power(effect, high, alpha, ratio) < power:
        low, high = high, 2.0 * high
    for _ in range(100):
        mid = 0.5 * (low + high)
        low, high = (mid, high) if t_power(effect, mid, alpha, ratio) < power else (low, mid)
        if high - low < 1e-9 * high:
            break
    return 0.5 * (low + high)


def _vector(function, *columns: pd.Series) -> pd.Series:
    """Applies a scalar function row by row; null or undefined input gives null."""
    out = [
        None if any(pd.isna(v) for v in row) else function(*map(float, row)) for row in zip(*columns)
    ]
    return pd.Series([None if v is None or math.isnan(v) else v for v in out], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return _vector(t_tail, t, df)


@F.pandas_udf(T.DoubleType())
def f_p_value(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _vector(f_tail, f, d1, d2)


@F.pandas_udf(T.DoubleType())
def group_size(effect: pd.Series, power: pd.Series, alpha: pd.Series, ratio: pd.Series) -> pd.Series:
    return _vector(solve_n1, effect, power, alpha, ratio)
