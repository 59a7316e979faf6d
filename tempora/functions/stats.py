"""Small numeric helpers used on aggregated (one row per group) tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _betacf(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the regularised incomplete beta (modified Lentz),
    all elements stepping together until each has converged."""
    tiny, eps = 1e-300, 1e-15
    safe = lambda v: np.where(np.abs(v) > tiny, v, tiny)
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = np.ones_like(x), 1.0 / safe(1.0 - qab * x / qap)
    h, going = d.copy(), np.ones(len(x), bool)
    for m in range(1, 500):
        m2 = 2 * m
        for aa in (m * (b - m) * x / ((qam + m2) * (a + m2)), -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))):
            d = 1.0 / safe(1.0 + aa * d)
            c = safe(1.0 + aa / c)
            h = np.where(going, h * d * c, h)
        going &= np.abs(d * c - 1.0) >= eps
        if not going.any():
            break
    return h


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def betainc_reg(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function, element by element."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    out = np.where(x >= 1.0, 1.0, 0.0)
    at = (x > 0.0) & (x < 1.0)
    a, b, x = a[at], b[at], x[at]
    if len(x):
        # the fraction converges fast on one side of the mean; mirror the others
        flip = x >= (a + 1.0) / (a + b + 2.0)
        p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1.0 - x, x)
        sizes, back = np.unique(np.stack([a, b]), axis=1, return_inverse=True)
        lg = (_lgamma(sizes[0] + sizes[1]) - _lgamma(sizes[0]) - _lgamma(sizes[1]))[back.reshape(-1)]
        front = np.exp(lg + a * np.log(x) + b * np.log1p(-x)) * _betacf(p, q, y) / p
        out[at] = np.where(flip, 1.0 - front, front)
    return out


def t_two_sided_p(t, dof) -> np.ndarray:
    """P(|T| > |t|) for Student's t with ``dof`` degrees of freedom."""
    t, dof = np.broadcast_arrays(np.asarray(t, float), np.asarray(dof, float))
    ok = ~np.isnan(t) & (dof > 0)
    x = np.where(ok & np.isfinite(t), dof / np.where(ok, dof + t * t, 1.0), 0.0)
    return np.where(ok, betainc_reg(np.where(ok, dof, 1.0) / 2.0, 0.5, x), np.nan)


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Vectorised over Arrow batches of an aggregated table."""
    return pd.Series(t_two_sided_p(t.to_numpy(float), dof.to_numpy(float)), dtype="float64")


def slope_t_stat(slope: Column, r2: Column, var_y: Column, var_x: Column, n: Column) -> Column:
    """t statistic of an OLS slope from aggregate moments:
    SE² = (1 − r²)·Syy / ((n − 2)·Sxx), with S = n·var_pop."""
    se = F.sqrt(F.try_divide((F.lit(1.0) - r2) * var_y, (n - 2) * var_x))
    return F.try_divide(slope, se)
