"""Tail probabilities (t, normal), vectorised; applied to result rows, never to data rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .cols import c


def incomplete_beta(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b) by its continued fraction (modified Lentz)."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    lg = np.vectorize(math.lgamma)
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(lg(p + q) - lg(p) - lg(q) + p * np.log(z) + q * np.log1p(-z)) / p
        tiny = 1e-300
        d = 1 - (p + q) * z / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        cf, h = np.ones_like(z), d.copy()
        for m in range(1, 300):
            for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
                        -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                cf = 1 + num / cf
                cf = np.where(np.abs(cf) < tiny, tiny, cf)
                h = h * d * cf
        part = np.where(z <= 0, 0.0, front * h)
    return np.where(flip, 1 - part, part)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return np.where(np.isinf(t), 0.0, incomplete_beta(df / 2, 0.5, df / (df + np.where(np.isinf(t), 0.0, t) ** 2)))


@F.pandas_udf(DoubleType())
def _corr_p(r: pd.Series, n: pd.Series) -> pd.Series:
    r, n = r.astype(float).to_numpy(), n.astype(float).to_numpy()
    ok = np.isfinite(r) & (n > 2)
    out = np.full(len(r), np.nan)
    rr = np.clip(r[ok], -1, 1)
    with np.errstate(divide="ignore"):
        t = np.where(np.abs(rr) >= 1, np.inf, rr * np.sqrt((n[ok] - 2) / np.maximum(1 - rr * rr, 1e-300)))
    out[ok] = t_two_sided(t, n[ok] - 2)
    return pd.Series(out).where(np.isfinite(out), None)


@F.pandas_udf(DoubleType())
def _normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if v is None or not math.isfinite(v) else min(1.0, math.erfc(v / math.sqrt(2))))


def corr_p(r, n) -> Column:
    """Two-sided p of a correlation with n rows (t with n - 2 degrees of freedom)."""
    return _corr_p(c(r), c(n).cast("double"))


def normal_two_sided(z) -> Column:
    """2 * P(Z > z)."""
    return _normal_two_sided(c(z))
