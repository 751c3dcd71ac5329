"""Tail probabilities, evaluated in Arrow batches on rows that are already aggregated."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


MAX_TERMS = 100_000
TOLERANCE = 4e-15


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz), to the tolerance or an error.

    Each element stops by itself: rounding may carry one that has converged beyond the tolerance again.
    """
    tiny = 1e-300
    shape, out = x.shape, np.empty(x.size)
    a, b, x, left = a.ravel(), b.ravel(), x.ravel(), np.arange(x.size)
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, MAX_TERMS):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h = h * step
        done = np.abs(step - 1.0) < TOLERANCE
        out[left[done]] = h[done]
        a, b, x, c, d, h, left = (v[~done] for v in (a, b, x, c, d, h, left))
        if not len(left):
            return out.reshape(shape)
    raise ArithmeticError("the incomplete beta function did not converge")


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(inner) + b * np.log1p(-inner))
    low = x < (a + 1.0) / (a + b + 2.0)
    aa, bb, xx = np.where(low, a, b), np.where(low, b, a), np.where(low, inner, 1.0 - inner)
    part = front * _beta_fraction(aa, bb, xx) / aa
    value = np.where(low, part, 1.0 - part)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, value))


def _erfc(x: np.ndarray) -> np.ndarray:
    # Made at each call: once used, a vectorised function cannot be sent to workers.
    return np.vectorize(math.erfc, otypes=[float])(x)


# Beyond this many degrees of freedom the beta function loses digits that the normal keeps.
_NORMAL_FROM = 1e6


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    few = np.minimum(df, _NORMAL_FROM)
    exact = incomplete_beta(few / 2.0, np.full_like(df, 0.5), few / (few + t * t))
    z = t * (1 - 1 / (4 * df)) / np.sqrt(1 + t * t / (2 * df))
    return np.where(df > _NORMAL_FROM, _erfc(np.abs(z) / math.sqrt(2.0)), exact)


def t_critical(level: float, df: np.ndarray) -> np.ndarray:
    """Two-sided critical value by bisection on the tail probability."""
    df = np.asarray(df, dtype=float)
    low, high = np.zeros_like(df), np.full_like(df, 1e8)
    for _ in range(200):
        mid = (low + high) / 2
        above = t_two_sided(mid, df) > 1.0 - level
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    return (low + high) / 2


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    ok = t.notna() & df.notna() & (df > 0)
    out = pd.Series(np.nan, index=t.index)
    if ok.any():
        out[ok] = t_two_sided(t[ok].to_numpy(), df[ok].to_numpy())
    return out.astype(object).where(ok, None)


@F.pandas_udf(T.DoubleType())
def t_quantile_975(df: pd.Series) -> pd.Series:
    ok = df.notna() & (df > 0)
    out = pd.Series(np.nan, index=df.index)
    if ok.any():
        out[ok] = t_critical(0.95, df[ok].to_numpy())
    return out.astype(object).where(ok, None)


@F.pandas_udf(T.DoubleType())
def normal_p_value(z: pd.Series) -> pd.Series:
    ok = z.notna()
    out = pd.Series(_erfc(z.fillna(0.0).abs().to_numpy(dtype=float) / math.sqrt(2.0)), index=z.index)
    return out.astype(object).where(ok, None)
