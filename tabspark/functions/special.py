"""Tail probabilities and the normal quantile, vectorised over Arrow batches of aggregate tables.

The incomplete beta and gamma functions use their continued fractions and the series from the
standard handbooks; every function takes and returns numpy arrays.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_TINY = 1e-300
_STEPS = 400
_EPS = 1e-15
_NORMAL = NormalDist()


def _lgamma(x):
    return np.vectorize(math.lgamma, otypes=[float])(x)


def _erfc(x):
    return np.vectorize(math.erfc, otypes=[float])(x)


def _arrays(*values):
    return np.broadcast_arrays(*[np.asarray(v, dtype=float) for v in values])


def _nonzero(x):
    return np.where(np.abs(x) < _TINY, _TINY, x)


def _beta_fraction(a, b, x):
    """Modified Lentz evaluation of the continued fraction of the incomplete beta function."""
    c = np.ones_like(x)
    d = 1.0 / _nonzero(1.0 - (a + b) * x / (a + 1.0))
    h = d.copy()
    for m in range(1, _STEPS):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / _nonzero(1.0 + term * d)
            c = _nonzero(1.0 + term / c)
            h = h * d * c
        if np.all(np.abs(d * c - 1.0) < _EPS):
            break
    return h


def beta_inc(a, b, x):
    """Regularised incomplete beta function."""
    a, b, x = _arrays(a, b, x)
    x = np.clip(x, 0.0, 1.0)
    inner = np.clip(x, 1e-320, 1.0)
    with np.errstate(all="ignore"):
        log_front = _lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inner) + b * np.log1p(-x)
        front = np.exp(log_front)
        swap = x >= (a + 1.0) / (a + b + 2.0)
        low = front * _beta_fraction(a, b, np.where(swap, 0.0, x)) / a
        high = 1.0 - front * _beta_fraction(b, a, np.where(swap, 1.0 - x, 0.0)) / b
    out = np.where(swap, high, low)
    return np.where(x <= 0.0, 0.0, np.where(x >= 1.0, 1.0, out))


def gamma_q(a, x):
    """Regularised upper incomplete gamma function."""
    a, x = _arrays(a, x)
    x = np.maximum(x, 0.0)
    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(np.where(x > 0, x, 1.0)) - x - _lgamma(a))
        series_x = np.where(x < a + 1.0, x, 0.0)
        term = 1.0 / a
        total = term.copy()
        for n in range(1, _STEPS * 4):
            term = term * series_x / (a + n)
            total = total + term
            if np.all(np.abs(term) <= np.abs(total) * _EPS):
                break
        tail_x = np.where(x < a + 1.0, a + 2.0, x)
        b = tail_x + 1.0 - a
        c = np.full_like(x, 1.0 / _TINY)
        d = 1.0 / _nonzero(b)
        h = d.copy()
        for n in range(1, _STEPS * 4):
            step = -n * (n - a)
            b = b + 2.0
            d = 1.0 / _nonzero(step * d + b)
            c = _nonzero(b + step / c)
            h = h * d * c
            if np.all(np.abs(d * c - 1.0) < _EPS):
                break
    out = np.where(x < a + 1.0, 1.0 - front * total, front * h)
    return np.where(x <= 0.0, 1.0, np.clip(out, 0.0, 1.0))


def f_sf(value, df1, df2):
    value, df1, df2 = _arrays(value, df1, df2)
    with np.errstate(all="ignore"):
        x = df2 / (df2 + df1 * value)
    out = beta_inc(df2 / 2.0, df1 / 2.0, np.where(np.isnan(x), 0.0, x))
    return np.where(np.isnan(value), np.nan, out)


def chi2_sf(value, dof):
    value, dof = _arrays(value, dof)
    out = gamma_q(np.where(dof > 0, dof, 1.0) / 2.0, np.where(np.isnan(value), 0.0, value) / 2.0)
    return np.where(np.isnan(value) | ~(dof > 0), np.nan, out)


def t_sf_two_sided(value, dof):
    value, dof = _arrays(value, dof)
    with np.errstate(all="ignore"):
        x = dof / (dof + value * value)
    out = beta_inc(dof / 2.0, 0.5, np.where(np.isnan(x), 0.0, x))
    return np.where(np.isnan(value), np.nan, out)


def correlation_p(r, n):
    """Two-sided p of a correlation coefficient over n pairs (t with n - 2 degrees of freedom)."""
    r, n = _arrays(r, n)
    dof = n - 2.0
    with np.errstate(all="ignore"):
        inside = np.clip(1.0 - r * r, 0.0, 1.0)
        out = beta_inc(np.where(dof > 0, dof, 1.0) / 2.0, 0.5, np.where(np.isnan(inside), 0.0, inside))
    return np.where(np.isnan(r) | (dof <= 0), np.nan, out)


def normal_sf_two_sided(z):
    return _erfc(np.abs(np.asarray(z, dtype=float)) / math.sqrt(2.0))


def normal_ppf(p):
    """Inverse normal distribution, each different probability once."""
    p = np.asarray(p, dtype=float)
    values, back = np.unique(p, return_inverse=True)
    inner = (values > 0) & (values < 1)
    out = np.where(values <= 0, -np.inf, np.where(values >= 1, np.inf, np.nan))
    out[inner] = [_NORMAL.inv_cdf(v) for v in values[inner].tolist()]
    return out[back].reshape(p.shape)


def kendall_exact_p(n: int, discordant: int) -> float:
    """Two-sided p from the distribution of inversions of n items (no ties)."""
    total = n * (n - 1) // 2
    tail = min(discordant, total - discordant)
    if 2 * tail == total:
        return 1.0
    ways = [1]
    for size in range(2, n + 1):
        prefix, grown = [0], []
        for w in ways:
            prefix.append(prefix[-1] + w)
        width = min(len(ways) + size - 1, tail + 1)
        for k in range(width):
            grown.append(prefix[min(k + 1, len(ways))] - prefix[max(0, k - size + 1)])
        ways = grown
    return float(min(1.0, 2 * sum(ways[: tail + 1]) / math.factorial(n)))


@F.pandas_udf(DoubleType())
def f_tail(value: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series(f_sf(value, df1, df2))


@F.pandas_udf(DoubleType())
def chi2_tail(value: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(chi2_sf(value, dof))


@F.pandas_udf(DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    return pd.Series(normal_ppf(p))
