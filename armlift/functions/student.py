"""Two-sided Student t tail for result tables (a handful of rows)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

TINY = 1e-300
MOST_TERMS = 10_000_000
MANY = 1e6


def _incomplete_beta_fraction(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, modified Lentz recurrence."""
    guard = lambda v: np.where(np.abs(v) < TINY, TINY, v)
    c = np.ones_like(x)
    d = 1 / guard(1 - (a + b) * x / (a + 1))
    value = d.copy()
    for m in range(1, MOST_TERMS):
        step = np.ones_like(x)
        for coefficient in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 / guard(1 + coefficient * d)
            c = guard(1 + coefficient / c)
            step = step * c * d
            value = value * c * d
        if np.all(np.abs(step - 1) < 1e-15):
            return value
    raise ArithmeticError(f"the incomplete beta fraction did not settle in {MOST_TERMS} terms")


def log_beta_half(a: float) -> float:
    """log B(a, 1/2); for large a by the asymptotic series of the ratio of gamma functions, which does not cancel."""
    if a < 50:
        return math.lgamma(a) + math.lgamma(0.5) - math.lgamma(a + 0.5)
    ratio = 0.5 * math.log(a) - 1 / (8 * a) + 1 / (192 * a**3) - 1 / (640 * a**5)
    return 0.5 * math.log(math.pi) - ratio


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) for Student's t; NaN where an input is missing."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    out = np.full(t.shape, np.nan)
    # beyond MANY the fraction would lose digits, and a normal deviate of the same tail is exact to 1e-12
    many = np.isfinite(t) & np.isfinite(df) & (df > MANY)
    z = (8 * df[many] + 1) / (8 * df[many] + 3) * np.sqrt(df[many] * np.log1p(t[many] ** 2 / df[many]))
    out[many] = [math.erfc(v / math.sqrt(2)) for v in z]
    known = np.isfinite(t) & np.isfinite(df) & (df > 0) & ~many
    a, b = df[known] / 2, 0.5
    square = t[known] ** 2
    x = df[known] / (df[known] + square)
    log_beta = np.array([log_beta_half(v) for v in a])
    with np.errstate(divide="ignore"):
        front = np.exp(-a * np.log1p(square / df[known]) + b * np.log(square / (df[known] + square)) - log_beta)
    direct = x < (a + 1) / (a + b + 2)
    tail = np.empty_like(x)
    tail[direct] = front[direct] * _incomplete_beta_fraction(a[direct], b, x[direct]) / a[direct]
    # near t = 0 the fraction converges fast for the complement only
    mirrored = ~direct
    if mirrored.any():
        # the complement of x, without taking it from 1
        rest = square[mirrored] / (df[known][mirrored] + square[mirrored])
        complement = np.array(
            [_incomplete_beta_fraction(np.array([b]), v, np.array([w]))[0] for v, w in zip(a[mirrored], rest)]
        )
        tail[mirrored] = 1 - front[mirrored] * complement / b
    out[known] = np.clip(tail, 0.0, 1.0)
    return out


@F.pandas_udf(T.DoubleType())
def student_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    p = t_two_sided(t.to_numpy(dtype=float), df.to_numpy(dtype=float))
    return pd.Series(p).where(~np.isnan(p), None)
