"""Tail probabilities for small report tables (one value per feature or per test)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    front = math.exp(min(a * math.log(x) - x - math.lgamma(a), 700.0))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - front * total)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(10_000):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + num * d
        d = 1 / (d if abs(d) > tiny else tiny)
        c = 1 + num / c
        c = c if abs(c) > tiny else tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def chi2_tail(stat, dof):
    return gamma_upper(dof / 2.0, stat / 2.0)


def t_two_sided(t, dof):
    return beta_inc(dof / 2.0, 0.5, dof / (dof + t * t))


def normal_two_sided(z):
    return math.erfc(abs(z) / math.sqrt(2.0))


def _lift(fn):
    """Report-level Arrow function: NULL, NaN or impossible arguments give NULL."""
    @F.pandas_udf(T.DoubleType())
    def run(x: pd.Series, dof: pd.Series) -> pd.Series:
        ok = x.notna() & dof.notna() & (dof > 0)
        return pd.Series([fn(a, b) if k else None for a, b, k in zip(x, dof, ok)], dtype="float64")
    return run


chi2_p = _lift(chi2_tail)
t_p = _lift(t_two_sided)
normal_p = _lift(lambda z, _: normal_two_sided(z))
