"""Special functions on arrays of numbers, and as pandas UDFs on columns.

log-gamma by Lanczos' series, incomplete beta and gamma functions by their continued fractions and series.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Lanczos' coefficients for g = 7.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x) -> np.ndarray:
    """log Gamma(x) for x > 0."""
    x = np.asarray(x, float) - 1
    total = np.full_like(x, _LANCZOS[0])
    for k, c in enumerate(_LANCZOS[1:], 1):
        total += c / (x + k)
    t = x + 7.5
    return 0.5 * math.log(2 * math.pi) + (x + 0.5) * np.log(t) - t + np.log(total)


def _floor(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 1e-300, 1e-300, x)


def _beta_fraction(a, b, x) -> np.ndarray:
    c, d = np.ones_like(x), 1 / _floor(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / _floor(1 + step * d)
            c = _floor(1 + step / c)
            h *= d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


def incomplete_beta(a, b, x) -> np.ndarray:
    """Regularised incomplete beta I(a, b; x) for 0 <= x <= 1; NaN outside."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    out = np.full(x.shape, np.nan)
    out[x == 0], out[x == 1] = 0.0, 1.0
    inside = (x > 0) & (x < 1) & (a > 0) & (b > 0)
    a, b, x = a[inside], b[inside], x[inside]
    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(x) + b * np.log1p(-x))
    low = x < (a + 1) / (a + b + 2)
    out[inside] = np.where(low, front * _beta_fraction(np.where(low, a, b), np.where(low, b, a), np.where(low, x, 1 - x)) / np.where(low, a, b), 0)
    flipped = 1 - front * _beta_fraction(b, a, 1 - x) / b
    out[inside] = np.where(low, out[inside], flipped)
    return out


def incomplete_gamma(a, x) -> np.ndarray:
    """Regularised lower incomplete gamma P(a, x) for x >= 0; NaN outside."""
    a, x = (np.array(v, float) for v in np.broadcast_arrays(a, x))
    out = np.full(x.shape, np.nan)
    ok = (x >= 0) & (a > 0)
    a, x = a[ok], x[ok]
    front = np.exp(np.where(x > 0, -x + a * np.log(np.maximum(x, 1e-300)) - log_gamma(a), -np.inf))
    term, total, n = 1 / a, 1 / a, a.copy()
    for _ in range(600):
        n = n + 1
        term = term * x / n
        total = total + term
    b = x + 1 - a
    c, d = np.full_like(x, 1e300), 1 / _floor(b)
    h = d.copy()
    for i in range(1, 600):
        step = -i * (i - a)
        b = b + 2
        d = 1 / _floor(step * d + b)
        c = _floor(b + step / c)
        h = h * d * c
    with np.errstate(all="ignore"):
        out[ok] = np.where(x < a + 1, front * total, 1 - front * h)
    return out


def erf(x) -> np.ndarray:
    return np.vectorize(math.erf, otypes=[float])(np.asarray(x, float))


def t_probability(t, df) -> np.ndarray:
    """Two-sided probability of Student's t; 2 marks an error."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return np.nan_to_num(incomplete_beta(df / 2, 0.5, df / (df + t * t)), nan=2.0)


def f_probability(f, df1, df2) -> np.ndarray:
    """Two-sided probability of a ratio of variances f >= 1, folded to at most 1; 2 marks an error."""
    f, df1, df2 = (np.asarray(v, float) for v in (f, df1, df2))
    p = 2 * incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))
    return np.nan_to_num(np.where(p > 1, 2 - p, p), nan=2.0)


def chi2_probability(chi2, df) -> np.ndarray:
    return 1 - incomplete_gamma(np.asarray(df, float) / 2, np.asarray(chi2, float) / 2)


def _udf(f):
    """A pandas UDF of a function of arrays; NaN results become null."""

    @F.pandas_udf(DoubleType())  # not by name: workers import this module, and names are parsed by the driver
    def call(*columns: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):
            out = pd.Series(f(*[c.to_numpy(dtype=float, na_value=np.nan) for c in columns]))
        return out.where(out.notna(), None)

    return call


erf_udf, one_minus_erf_udf = _udf(erf), _udf(lambda x: 1 - erf(x))
incomplete_gamma_udf, incomplete_beta_udf = _udf(incomplete_gamma), _udf(incomplete_beta)
t_probability_udf, f_probability_udf, chi2_probability_udf = _udf(t_probability), _udf(f_probability), _udf(chi2_probability)
